import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_simhash import brute_fp
from tests.llm.test_tokens_packing import check_packing, crc, ids_of


def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    said = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = said(20)
    footer = "terms of use apply to all of this"
    rows = [(k, said(60) + "\n" + said(30), "en", "s", 1) for k in range(30)]
    rows += [(100 + k, said(40) + "\n" + footer, "en", "s", 1) for k in range(12)]
    rows += [(200 + k, rows[3][1], "en", "s", 1) for k in range(3)] + [(210, rows[4][1].replace("a", "A", 1), None, None, None)]
    rows += [(300, said(20) + " " + item + " " + said(9), "en", "s", 1), (400, None, "en", "s", 1), (401, "123 -- 456", "en", "s", 1), (402, "", None, None, None), (403, footer, "en", "s", 1), (500, said(3000), "en", "s", 1), (7, said(10), "en", "s", 1), (None, said(15), None, "s", 1)]
    rows += [(600, said(25), "en", "s", 1), (600, said(26), "en", "s", 1), (600, rows[5][1], "en", "s", 1), (7, rows[-2][1], "en", "t", 2)]
    base = said(200).split()
    rows += [(700 + k, " ".join([*base[: 20 * k + 5], f"other{k}", *base[20 * k + 6 :]]).replace("other", "other" * (k > 0)), "en", "s", 1) for k in range(6)]
    rows += [(None, said(9) + " " + item, "en", "s", 1), (800, said(12) + " " + item, "en", "s", 1), (800, said(40), "en", "s", 1), (None, said(41), "en", "s", 1)]
    return rows, [(0, item), (1, None), (2, said(25))]


def brute(rows, items):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    # lines: here no leaf has lines of two kinds, so a template is a line
    where = {}
    for k, t, *_ in rows:
        for line in t.split("\n"):
            if k is not None and len(line.split()) >= 4:
                where.setdefault(line, set()).add(k)
    out, seen = [], set()
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = []
        for line in r[1].split("\n"):
            if r[0] is not None and len(where.get(line, ())) >= 10:
                if line in seen:
                    continue
                seen.add(line)
            lines.append(line)
        if lines:
            out.append((r[0], "\n".join(lines)))
    # near-duplicates: equal rows are one, texts of one key are not
    keyed = sorted({r for r in out if r[0] is not None})
    parent = list(range(len(keyed)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in keyed)]
    for i, a in enumerate(sets):
        for m, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(m)))
                parent[y] = x
    for width in (3, 5):
        fps = [brute_fp(t, width) for _, t in keyed]
        for i, a in enumerate(fps):
            for m, b in enumerate(fps[:i]):
                if (a ^ b).bit_count() <= 2:
                    x, y = sorted((root(i), root(m)))
                    parent[y] = x
    out = [r for k, r in enumerate(keyed) if root(k) == k] + [r for r in out if r[0] is None]
    # benchmark: these texts have neither numbers nor names within sentences, so a template is the words
    def leaks(x):
        d = x.lower().split()
        grams = {tuple(d[i : i + 8]) for i in range(len(d))}
        return any(sum(tuple(w[i : i + 8]) in grams for i in range(len(w) - 7)) >= (len(w) - 7) / 2 for w in (x.lower().split() for _, x in items if x))

    out = [r for r in out if not leaks(r[1])]
    pieces = []
    for k, x in out:
        ids = ids_of(x, 0)
        pieces += [(str(k), p, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for p, a in enumerate(range(0, len(ids), 2048))]
    return sorted(pieces)


def test_run_equals_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(got, 2048)
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute(rows, items)
    kept = {r.doc_id for r in got}
    assert sum(r.doc_id == 600 for r in got) == 2
    assert {3, 500, None, 700, 800} <= kept and not {200, 201, 202, 210, 300, 400, 401, 402, 403, 701, 702, 703, 704, 705} & kept
    assert sum(r.doc_id == 800 for r in got) == 1 and sum(r.doc_id is None for r in got) == 2


def test_decontamination_tells_rows_apart(spark, tmp_path):
    item, clean = " ".join(f"ask{k}" for k in range(20)), " ".join(f"word{'abcdefghij'[k]}" for k in range(10))
    item = item.translate(str.maketrans("0123456789", "abcdefghij"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "so " + item), (5, item), (5, clean), (None, clean + " more"), (6, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in left if r.text) == [("5", clean), ("None", clean + " more")] and len(left) == 3


def test_no_rows(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
    assert docs.where(F.lit(True)).count() == 0
