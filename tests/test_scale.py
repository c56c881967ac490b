"""Operators that deal long files and many names over tasks, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bundlelens.operators import correlate, kb, rules, search
from bundlelens.streaming import intake


def test_names_are_those_of_the_own_bundle(spark):
    rng = random.Random(2)
    words = [f"vm-{k}" for k in range(40)] + ["é", "a"]
    texts = [(f"b{rng.randrange(4)}", k, " ".join(rng.choice(words) for _ in range(rng.randrange(6)))) for k in range(200)] + [("b0", 900, None), ("b9", 901, "vm-1"), (None, 902, "vm-1")]
    names = [(f"b{rng.randrange(4)}", rng.choice(words)) for _ in range(60)] + [("b1", ""), ("b1", None), ("b8", "vm-2")]
    rows, own = spark.createDataFrame(texts, "bundle_id string, k int, text string"), spark.createDataFrame(names, "bundle_id string, name string")
    want = sorted({(b, k, n) for b, k, t in texts if t for c, n in names if n and b == c and n in t})
    for text_chars, name_chars in ((10**6, 10**6), (200, 20)):
        found = search.naming(rows, rows.text, own, "name", text_chars=text_chars, name_chars=name_chars)
        assert found.columns == ["bundle_id", "k", "text", "named"]
        assert sorted((r.bundle_id, r.k, r.named) for r in found.collect()) == want
    assert search.naming(rows, rows.text, own.limit(0), "name").count() == 0


def test_mentions_in_blocks(spark):
    texts = spark.createDataFrame([(k, f"x{k % 7}y z{k % 5}") for k in range(50)], "k long, text string")
    names = spark.createDataFrame([(k, f"x{k}y") for k in range(9)] + [(20, "z3"), (21, ""), (22, None)], "n long, name string")
    want = sorted({(k, n) for k in range(50) for n in range(9) if f"x{n}y" in f"x{k % 7}y"} | {(k, 20) for k in range(50) if k % 5 == 3})
    for chars in (10**6, 8):
        assert sorted(tuple(r) for r in search.mentions(texts, "k", "text", names, "n", "name", chars).collect()) == want


@pytest.mark.parametrize(("before", "after", "most"), [(0, 0, 220), (2, 3, 220), (80, 80, 220), (4, 4, 5)])
def test_windows_around_hits(spark, before, after, most):
    rng = random.Random(before)
    lines = [(f, n) for f in ("a", "b") for n in range(1, 400) if rng.random() < 0.9]
    hits = [x for x in lines if rng.random() < 0.1] + [("a", 399), ("c", 3)]
    want = []
    for f, h in set(hits):
        around = [n for g, n in lines if g == f and h - before <= n <= h + after]
        want += [(f, h, n) for n in sorted(around)[:most]]
    df = spark.createDataFrame([(f, n, f"line {n}") for f, n in lines], "f string, n long, line string")
    got = search.line_windows(df, spark.createDataFrame(sorted(set(hits)), "f string, n long"), ["f"], "n", "line", before, after, most)
    assert sorted((r.f, r.hit_line, r.n) for r in got.collect()) == sorted(want)


def test_texts_that_a_regex_needs():
    assert rules.required_literals(r"(password|token) ?= ?") == ["password", "token"]
    assert rules.required_literals(r"^The And\b.*later") in (["the and"], ["later"])
    assert rules.required_literals(r"(?i)Abc+d?(xy){2,}") == ["ab"] or rules.required_literals(r"(?i)Abc+d?(xy){2,}") == ["xy"]
    for none in (r"(^|[^0-9])[0-9]{16}($|[^0-9])", r"(abc)?", r"abc|d*", r"(?!never)x", r"\d+", r"(?u)kelvin", r"[unclosed", ""):
        assert rules.required_literals(none) is None


def test_literals_first_changes_no_match(spark):
    rng = random.Random(4)
    parts = ["Error", "error", "PANIC=", "time", "out", "token=", "Token = x", "é", "K", " ", "12345678", "timed out", "connection refused", "ſ"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(400)] + ["", "error"]
    regexes = [(r"\b(failed|error)\b", "i"), (r"panic=", "i"), (r"(time(d)?\s?out|refused)", ""), (r"token ?= ?", "i"), (r"[0-9]{8}", ""), (r"err(or)?K", "i"), (r"^error$", ""), (r"s", "iu"), (r"(?:Error){2}", "")]
    table = [{"id": str(k), "regex": x, "flags": f} for k, (x, f) in enumerate(regexes)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")
    plain = {(r.k, i) for r in df.select("k", rules.matching_rules(df.line, table).alias("ids")).collect() for i in r.ids}
    assert {(r.k, r.rule_id) for r in rules.log_matches(df, "line", table).collect()} == plain
    same = {(k, str(i)) for k, x in enumerate(lines) for i, (p, f) in enumerate(regexes) if "u" not in f and re.search(p, x, (re.I if "i" in f else 0) | re.A)}
    assert {x for x in plain if x[1] not in "07"} == {x for x in same if x[1] != "0"}  # word boundaries are the JVM's


def test_best_matches_equal_a_plain_loop(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(30)] + ["w1w2", "x.y", "x"]
    rows = [(f"d{k // 3}", k % 3, [rng.random() for _ in range(8)] if k % 11 else [0.0] * 8, " ".join(rng.choice(words) for _ in range(rng.randrange(9))), rng.choice(["a", "b", "unknown", None])) for k in range(300)]
    rows += [(f"d{900 + k}", 0, rows[5][2], rows[5][3], "unknown") for k in range(40)]  # ties
    queries = [(k, [rng.random() for _ in range(8)], rng.sample(words, rng.randrange(1, 7)), rng.choice([None, "a", "b"])) for k in range(25)] + [(99, [0.0] * 8, [], None)]

    def score(q, r):
        norm = (sum(x * x for x in q[1]) * sum(x * x for x in r[2])) ** 0.5
        hits = sum(t in r[3] for t in set(q[2]))
        n = len(set(q[2]))
        return 0.72 * (sum(x * y for x, y in zip(q[1], r[2], strict=True)) / norm if norm else 0) + 0.28 * (hits / (n * max(n, 3)) ** 0.5 if n else 0)

    want = []
    for q in queries:
        best = {}
        for r in rows:
            if (r[4] or "unknown") in ("unknown", q[3]) or q[3] is None:
                s = score(q, r)
                if s >= 0.3:
                    best[r[0]] = min(best.get(r[0], (9,)), (-int(s * 1000 + 0.5) / 1000, r[1], r[0]))
        want += [(q[0], i + 1, d, p, -s) for i, (s, p, d) in enumerate(sorted(best.values())[:5])]
    qs = spark.createDataFrame(queries, "query_id long, vector array<double>, tokens array<string>, product_type string")
    rs = spark.createDataFrame(rows, "id string, part int, vector array<double>, text string, product string").repartition(3)
    for block in (32 << 20, 500):
        monkeypatch.setattr(kb, "BLOCK_BYTES", block)
        got = kb.best_matches(qs, rs, 5, 0.3, 3)
        assert sorted((r.query_id, r.place, r.id, r.part, round(r.score, 3)) for r in got.collect()) == sorted(want)


def test_a_bundle_that_raises_fails_alone(spark, tmp_path):
    spark.createDataFrame([(f"b{k:02d}", f"h{k % 9}") for k in range(12)], "bundle_id string, sha256 string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("bundle_id string, sha256 string").parquet(str(tmp_path / "in"))

    def analyse(df, batch):
        ids = [r.bundle_id for r in df.collect()]
        if {"b03", "b07"} & set(ids):
            raise RuntimeError("cannot read it")
        return df.selectExpr("bundle_id", "cast(null as string) as error", "1 as found")

    root = str(tmp_path / "out")
    intake.intake(stream, analyse, root).awaitTermination()
    ledger = spark.read.schema(intake.LEDGER).parquet(f"{root}/ledger")
    states = {r.bundle_id: (r.status, r.error) for r in intake.job_states(ledger).collect()}
    assert states == {f"b{k:02d}": ("failed", "RuntimeError: cannot read it") if k in (3, 7) else ("failed", "duplicate checksum") if k > 8 else ("completed", None) for k in range(12)}


def test_events_and_matches_are_found_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(k):
        seen.add(1)
        return f"vm-{k % 3} failed"

    tell = F.udf(told, "string").asNondeterministic()
    events = spark.range(30).select(F.lit("b").alias("bundle_id"), F.lit("default").alias("ns"), F.lit("VirtualMachine").alias("kind"), F.lit("vm-0").alias("involved"), F.lit("r").alias("reason"), tell("id").alias("message"), F.lit("p").alias("path"), F.col("id").cast("int").alias("item_no"))
    w = spark.createDataFrame([("b", "default", f"vm-{k}", [("p", f"m-{k}")]) for k in range(3)], "bundle_id string, ns string, name string, migrations array<struct<path:string,name:string>>")
    few = correlate._few(correlate.event_matches(w, events), "event").collect()
    assert seen.value == 30
    assert {r["name"]: (len(r.events), r.event_total) for r in few} == {"vm-0": (3, 30), "vm-1": (3, 10), "vm-2": (3, 10)}
    rows = events.select("bundle_id", "ns", F.lit("vm-0").alias("name"), F.struct("message").alias("event"))
    assert correlate._few(rows, "event").first().event_total == 30 and seen.value == 60
