import math
import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bundlelens.functions import text as T
from bundlelens.operators import advisor, defaults, files, findings, kb, rules, search
from bundlelens.plans import analysis
from bundlelens.streaming import intake


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_text_functions(spark):
    c = F.col("a")
    assert one(spark, T.slug(c), a="--Ab  C/9é!") == "ab-c-9"
    assert one(spark, T.truncate(c, 5), a="abcdefg") == "abcd..."
    assert one(spark, T.short_path(c, "/logs/"), a="x/y/logs/a.log") == "logs/a.log"
    assert one(spark, T.safe_filename(c), a="C:\\d\\a  b?.zip") == "a_b_.zip"
    assert one(spark, T.normal_version(c), a="1.2.3-rc1") == "v1.2.3-rc1" and one(spark, T.normal_version(c), a="1.2") is None
    assert one(spark, T.loose_version(c), a="main-head") == "main-head"
    assert one(spark, T.chart_version(c), a="longhorn-1.7.2+up1") == "v1.7.2+up1"
    assert one(spark, T.ntp_status(c), a='{"ntpSyncStatus":"synced"}') == "synced" and one(spark, T.ntp_status(c), a="x ntpSyncStatus: off") == "off"
    assert one(spark, T.decode_entities(c), a="&#x41;&#233;&#128512; &lt;&amp;lt; &unknown; &#xZZ;") == "Aé😀 <&lt; &unknown; &#xZZ;"
    assert one(spark, T.html_text(c), a="<body><nav>x</nav><p>a<br>b</p><ul><li>c</li></ul><script>s</script></body>").split() == ["a", "b", "-", "c"]
    assert one(spark, T.html_title(c), a="<title>Top | Site</title>") == "Top " and one(spark, T.html_title(c), a='<p class="big title"> Hi </p><h1>no</h1>') == "Hi"
    assert one(spark, T.tokens(c), a="The quick-fox a v1.2 x") == ["quick-fox", "v1.2"]
    assert one(spark, T.keyword_overlap(F.array(F.lit("ab"), F.lit("zz")), c), a="xaby") == pytest.approx(1 / 6**0.5)
    assert one(spark, T.excerpt(c, F.array(F.lit("needle"))), a="x" * 200 + " needle " + "y" * 400).startswith("...")
    assert [one(spark, T.archive_type(c), a=a) for a in ("a.TAR.GZ", "b.zip", "c.txt", "d.tar.zst")] == ["tar", "zip", None, "tar"]
    assert [one(spark, T.unsafe_entry(c), a=a) for a in ("a/b", "../a", "/a", "c:\\x", "")] == [False, True, True, True, True]
    assert one(spark, T.namespace_of(F.lit(None).cast("string"), c), a="b/yamls/namespaced/kube/x.yaml") == "kube"


def test_rules(spark, tmp_path):
    facts = {"a": F.col("a"), "n": F.lit(None).cast("string")}
    ok = lambda when: one(spark, rules.predicate(when, facts), a=" True ")
    assert ok("a == True; a in x|True; a notIn y; a matches ^tr; n != True; a exists; a notEmpty") and not ok("n == x") and not ok("n exists") and not ok("n notEmpty")
    with pytest.raises(ValueError):
        rules.predicate("a ~ b", facts)
    assert one(spark, rules.render("<{a}|{n}|{zz}>", facts), a="v") == "<v||>"
    rule = {"severity": "info", "severityOverrides": "a=v:critical,a=w:warning"}
    assert one(spark, rules.severity(rule, facts), a="w") == "warning"
    path = tmp_path / "r.yaml"
    path.write_text("logs:\n  maxFiles: 1\n  include: [/x/]\n  priorities: []\n  rules:\n  - {id: r, severity: info, category: c, title: t, description: d, regex: 'boom (', flags: i}\n")
    given = rules.load_rules(str(path), defaults.LONGHORN_RULES)
    assert given["logs"]["maxFiles"] == 1 and given["conditions"] == defaults.LONGHORN_RULES["conditions"]
    assert rules.load_rules(str(tmp_path / "none"), defaults.LONGHORN_RULES) is defaults.LONGHORN_RULES
    with pytest.raises(ValueError, match="bad regex"):
        rules.check_rules(spark, given)
    rules.check_rules(spark, defaults.HARVESTER_RULES)
    assert one(spark, rules.log_priority(F.col("a"), defaults.LONGHORN_RULES["logs"]["priorities"]), a="x/csi-1/a.log") == 4
    assert one(spark, rules.in_log_scope(F.col("a"), ["/logs/"]), a="b\\logs\\a.log.1") and not one(spark, rules.in_log_scope(F.col("a"), ["/logs/"]), a="b/logs/a.txt")


def test_files(spark):
    df = spark.createDataFrame([("b", "x/logs/a.log", "k\n\nhit\r\nend"), ("b", "x/a.yaml", "y"), ("c", "z.txt", "")], "bundle string, path string, text string")
    assert files.first_with_suffix(df, "bundle", "path", "a.log").count() == 1
    assert {(r.path, r.likely_log, r.is_default) for r in files.likely_logs(df, "bundle", "path").collect()} == {("x/logs/a.log", True, True), ("x/a.yaml", False, False), ("z.txt", True, True)}
    assert [(r.line_no, r.line) for r in files.log_lines(df.where("path like '%log'"), ["path"], "text").orderBy("line_no").collect()] == [(1, "k"), (3, "hit"), (4, "end")]
    assert [r.line for r in files.log_lines(df.where("path like '%log'"), ["path"], "text", 2).orderBy("line_no").collect()] == ["k"]
    known = spark.createDataFrame([("s1",)], "sha256 string")
    new = spark.createDataFrame([("b2", "s2"), ("b1", "s2"), ("b3", "s1")], "bundle_id string, sha256 string")
    assert [r.bundle_id for r in files.new_bundles(new, known, "sha256", ["bundle_id"]).collect()] == ["b1"]


def test_findings_and_search(spark):
    f = spark.createDataFrame([("b", "x", "info", "t", 1), ("b", "x", "critical", "u", 2), ("b", "y", "warning", "v", 3)], "bundle_id string, id string, severity string, title string, seq int")
    once = findings.first_by_id(f, ["bundle_id", "id"], ["seq"])
    assert findings.first_by_id(once, ["bundle_id", "id"], ["seq"]).count() == once.count() == 2
    none = spark.createDataFrame([("b",), ("empty",)], "bundle_id string")
    assert {(r.bundle_id, r.total, r.warning) for r in findings.severity_summary(once, "bundle_id", "severity", none).collect()} == {("b", 2, 1), ("empty", 0, 0)}
    assert [r.title for r in findings.in_report_order(f, "bundle_id", "severity", [findings.unicode_order("title")]).orderBy("place").collect()] == ["u", "v", "t"]
    lines = spark.createDataFrame([("b", "p", i, f"line {i} {'HIT' if i == 50 else ''}") for i in range(1, 200)], "bundle_id string, path string, line_no long, line string")
    hit = search.first_hits(lines, ["bundle_id", "path"], "line_no", "line", "hit ...", ignore_case=True)
    assert [r.line_no for r in hit.collect()] == [50]
    w = search.line_windows(lines, hit, ["bundle_id", "path"], "line_no", "line")
    assert (w.count(), w.agg(F.max("line_no")).first()[0]) == (130, 130)
    for bad in ({"needle": "(", "regex": True}, {"needle": "short", "least": 16}):
        with pytest.raises(ValueError):
            search.line_filter(F.col("line"), **bad)
    docs = spark.createDataFrame([(1, "xabcx"), (2, None), (3, "")], "d long, t string")
    names = spark.createDataFrame([(7, "abc"), (8, "bc"), (9, ""), (9, None), (6, "abc")], "n long, s string")
    assert {tuple(r) for r in search.mentions(docs, "d", "t", names, "n", "s", block_chars=3).collect()} == {(1, 7), (1, 8), (1, 6)}
    assert search.mentions(docs, "d", "t", names.limit(0), "n", "s").count() == 0


def test_knowledge_base(spark):
    html = '<html><body><a href="/kb/a?x#y">a</a><a href="b/../c">c</a><a href=/kb/z.png>z</a><a href="http://else/kb/q">q</a><a href="/other">o</a></body></html>'
    pages = spark.createDataFrame([("http://H/kb/", html, "text/html"), ("http://H/kb/one", "<p>x</p>", "text/html"), ("u", "x", "image/png"), ("v", None, None)], "url string, html string, kind string")
    links = kb.links(pages, "url", "html")
    assert {tuple(r) for r in links.collect()} == {("http://H/kb/", "http://h/kb/a"), ("http://H/kb/", "http://h/kb/c")}
    assert {tuple(r) for r in kb.expanded(pages.limit(2), links, "url", 1).collect()} == {("http://H/kb/", "http://h/kb/a"), ("http://H/kb/one", "http://H/kb/one")}
    assert [r.failure for r in kb.text_pages(pages, "html", "kind").orderBy("url").collect()] == [None, None, "unsupported content type", "no content"]
    docs = kb.documents(pages.where("kind = 'text/html'"), "url", "html", F.col("kind"), F.lit("Longhorn"))
    d = {r.source_uri: r for r in docs.collect()}
    assert d["http://H/kb/one"].title == "one" and d["http://H/kb/one"].product_type == "longhorn" and d["http://H/kb/one"].id.startswith("kb_")
    body = "para one " * 60 + "\n\n" + "para two " * 300 + "\n\n" + "short tail of the text that is long enough to keep"
    chunks = kb.packed_chunks(body)
    assert max(map(len, chunks)) <= kb.TARGET and chunks[-1].endswith("keep") and len(chunks) == 4
    short = spark.createDataFrame([("i", "u", "t", "p", "tiny"), ("j", "u", "t", "p", None)], "id string, source_uri string, title string, product_type string, body string")
    assert kb.chunks(short).count() == 0
    q = kb.quality(spark.createDataFrame([("Untitled KB article", "w " * 200), ("ABCD Customer Portal", "Loading CSS Error " * 20), ("t", ""), ("t", "y " * 400)], "title string, body string"), F.lit(1), shells=("abcd customer portal",))
    assert [r.status for r in q.collect()] == ["warning", "blocked", "blocked", "ready"]
    v = kb.hash_vectors(spark.createDataFrame([(1, "alpha beta"), (2, "the of"), (3, None)], "k long, t string"), "k", "t", 32)
    got = {r.k: r.vector for r in v.collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5) and got[2] == got[3] == [0.0] * 32
    with pytest.raises(ValueError):
        kb.hash_vectors(short, "id", "body", 8)
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", "x"), ("3", None, "x")], "id string, source_uri string, body string")
    new = spark.createDataFrame([("9", "a", "new", 1), ("9", "a", "newer", 2), ("3", None, "new", 3), ("8", "z", " ", 4)], "id string, source_uri string, body string, seq int")
    up = kb.upsert(old, new, "seq")
    assert {tuple(r) for r in up.collect()} == {("2", "b", "x"), ("9", "a", "newer"), ("3", None, "new")}
    assert {tuple(r) for r in kb.upsert(up, new, "seq").collect()} == {tuple(r) for r in up.collect()}
    assert tuple(kb.upsert_counts(old, new, "seq").first()) == (2, 2, 1)
    previews = q.withColumn("importable", F.col("status") != "blocked")
    assert tuple(kb.preview_summary(previews, links.select(F.col("link").alias("url")), 1).first()) == (1, 1, 2, 2, 2, True)
    assert kb.fnv1a([b"a", b"", b"foobar"]).tolist() == [0xE40C292C, 0x811C9DC5, 0xBF9CF968]
    r = analysis.with_kb_summary(old, docs, short.limit(0)).first()
    assert (r.kb_summary.enabled, r.kb_summary.document_count) == (False, 2)


def test_advisor_and_backfill(spark):
    b = spark.createDataFrame([("b", "longhorn")], "bundle_id string, product_type string")
    g = spark.createDataFrame([("b", f"g{i}", "warning", "t", ["e"]) for i in range(12)], "bundle_id string, group_id string, severity string, title string, evidence array<string>")
    f = spark.createDataFrame([("b", "f", "info", "t", "d" * 2000)], "bundle_id string, id string, severity string, title string, description string")
    w = spark.createDataFrame([], "bundle_id string, namespace string, name string, severity string, status string")
    e = spark.createDataFrame([("b", i, "x" * 5000) for i in range(99)], "bundle_id string, seq int, line string")
    c = advisor.advisor_context(b, g, f, w, e)
    r = c.first()
    assert r.context.count("group_id") == advisor.GROUPS and len(r.context) <= advisor.MOST_JSON
    advice = spark.createDataFrame([("b", "completed", "p", "m", "1", r.fingerprint)], "bundle_id string, status string, provider string, model string, prompt_version string, fingerprint string")
    assert advisor.stale(advice, c, "p", "m", "1").count() == 0 and advisor.stale(advice, c, "p", "other", "1").count() == 1 and advisor.stale(advice.limit(0), c, "p", "m", "1").count() == 1
    old = spark.createDataFrame([("b", None, 1)], "bundle_id string, version string, n int")
    fresh = spark.createDataFrame([("b", "v1", "w")], "bundle_id string, version string, work string")
    assert analysis.backfilled(old, fresh, ["version", "work"]).first().asDict() == {"bundle_id": "b", "version": "v1", "n": 1, "work": "w"}
    assert [t.count() for t in analysis.without_bundles(b, b, g)] == [0, 0]


def test_stream(spark, tmp_path):
    schema = "bundle_id string, sha256 string"
    root = str(tmp_path / "root")

    def land(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def take():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        bad = F.when(F.col("bundle_id") == "bad", "broken")
        intake.intake(stream, lambda df, batch: df.select("bundle_id", bad.alias("error")), root).awaitTermination()
        ledger = spark.read.schema(intake.LEDGER).parquet(f"{root}/ledger")
        return {r.bundle_id: (r.status, r.error) for r in intake.job_states(ledger).collect()}

    land("1", [("a", "s1"), ("b", "s1"), ("bad", "s2")])
    assert take() == {"a": ("completed", None), "b": ("failed", "duplicate checksum"), "bad": ("failed", "broken")}
    land("2", [("c", "s2"), ("d", "s3")])
    assert take() == {"a": ("completed", None), "b": ("failed", "duplicate checksum"), "bad": ("failed", "broken"), "c": ("failed", "duplicate checksum"), "d": ("completed", None)}
    (tmp_path / "zips").mkdir()
    (tmp_path / "zips" / "x.zip").write_bytes(b"1")
    q = intake.binary_stream(spark, str(tmp_path / "zips"), "*.zip").writeStream.format("memory").queryName("zips").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("zips").columns == ["path", "modificationTime", "length"] and spark.table("zips").count() == 1


def test_chunks_leave_a_few_documents_at_a_time():
    import pyarrow as pa

    from bundlelens.operators import kb

    class Docs:  # takes the function that tasks run
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    n = 1000
    texts = {"id": [f"d{k}" for k in range(n)], "body": ["word " * 700] * n} | {c: ["x"] * n for c in ("source_uri", "title", "product_type")}
    got = [b.to_pydict() for b in kb.chunks(Docs())(iter([pa.RecordBatch.from_pydict(texts)]))]
    assert max(len(set(b["document_id"])) for b in got) <= 64
    assert [d for b in got for d in b["id"]] == [f"d{k}:{i}" for k in range(n) for i in (1, 2, 3)][: sum(len(b["id"]) for b in got)]
    assert {d for b in got for d in b["document_id"]} == set(texts["id"])


def test_an_excerpt_flattens_its_text_once(spark):
    out = spark.createDataFrame([("x " * 200 + "Disk  full " + "y " * 200, ["zz", "full", "disk"])], "c string, t array<string>").select(T.excerpt(F.col("c"), F.col("t")).alias("e"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    e = out.first().e
    assert e.startswith("... x ") and e.endswith("y...") and len(e) == 266 and e.index("full") == 93


def _found(block, limit, least, digits, rows):
    """What one task finds of rows(id, part, product, text, vector)."""
    names = ["id", "part", "product", "text", "vector"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64())]
    batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    out = list(kb._best_of_task(SimpleNamespace(value=block), limit, least, digits)(iter([batch])))
    return sorted(tuple(x.values()) for b in out for x in b.to_pylist())


def test_a_row_below_the_places_of_an_earlier_task_is_left_out():
    block = kb.Block([SimpleNamespace(query_id=1, tokens=["ab", "cd"], product_type=None)], 0.0, 1.0)
    task = lambda i, text: [x[1] for x in _found(block, 1, 1e-6, 6, [(i, 0, "unknown", text, None)])]
    assert task(5, "ab cd") == [5]
    assert task(6, "ab") == [] and task(3, "cd ab") == [3] and task(5, "ab cd") == [5]


def test_best_matches_of_a_task_are_those_of_all_pairs():
    r = random.Random(1)
    word = lambda: f"{r.choice('abcdef')}{r.choice(['', 'x', '.y', str(int(r.expovariate(0.01)))])}"
    text = lambda n: " ".join(word() for _ in range(n))
    vector = lambda: [r.choice([0.0, 1.0, r.random()]) for _ in range(4)]
    queries = [SimpleNamespace(query_id=i, tokens=list({word() for _ in range(r.choice([0, 2, 40]))}), vector=[0.0] * 4 if i == 3 else vector(), product_type=r.choice([None, "p", "q"])) for i in range(60)]
    rows = [(r.randrange(400), i, r.choice(["unknown", "p", "q", None]), None if i % 50 == 7 else text(r.choice([0, 3, 60])), [0.0] * 4 if i % 40 == 9 else vector()) for i in range(900)]
    for by_vector, by_words, digits in ((0.72, 0.28, 3), (0.0, 1.0, 6), (1.0, 0.0, 4)):
        expected = []
        for q in queries:
            best = {}
            for key, part, product, said, v in rows:
                if q.product_type and (product or "unknown") not in ("unknown", q.product_type):
                    continue
                norm = math.hypot(*v) * math.hypot(*q.vector)
                n = len(q.tokens)
                s = by_vector * (sum(a * b for a, b in zip(v, q.vector, strict=True)) / norm if norm else 0.0) + (by_words * sum(t in (said or "") for t in q.tokens) / math.sqrt(n * max(n, 3)) if n else 0.0)
                if s >= 0.07:
                    best[key] = min(best.get(key, (1, 0, 0)), (-math.floor(s * 10**digits + 0.5) / 10**digits, part, key))
            expected += [(q.query_id, key, part, -s) for s, part, key in sorted(best.values())[:5]]
        block = kb.Block(queries, by_vector, by_words)
        got = _found(block, 5, 0.07, digits, rows)
        assert [x[:3] for x in got] == [x[:3] for x in sorted(expected)]
        assert [x[3] for x in got] == pytest.approx([x[3] for x in sorted(expected)])
        assert not by_words or 0 < len(block.scorer().asked) < len(block.words)  # both ways of counting are taken
