import numpy as np
from pyspark.sql import functions as F

from bundlelens.llm import neighbours
from tests.conftest import SF


def brute(rows, k, asked):
    keys = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for i, q in enumerate(keys):
        if asked(q):
            s = x @ x[i]
            order = [j for j in np.lexsort((keys, -np.round(s, 9))) if keys[j] != q][:k]
            out[int(q)] = [(int(keys[j]), float(s[j])) for j in order]
    return out


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, 20, lambda q: q % 20 == 0)
    got = {}
    for r in neighbours.op4_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    x = dict((k, np.array(v, float)) for k, v in rows)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(s - x[q] @ x[v]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_copies_bad_vectors_and_few_rows(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=6)
    good = [(k, base.tolist()) for k in range(60)] + [(100 + k, rng.normal(size=6).tolist()) for k in range(30)] + [(0, base.tolist())]
    bad = [(200, None), (201, [0.0] * 6), (202, [float("nan")] * 6), (203, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (204, [float("inf")] * 6), (205, [1.0, 2.0]), (None, base.tolist()), (206, [])]
    df = spark.createDataFrame([(k, v, 3) for k, v in good + bad], "vec_id long, embedding array<double>, rep int").repartition(3)
    want = brute(good[:-1], 5, lambda q: q % 20 == 0)
    got = {}
    for r in neighbours.nearest(df, "vec_id", "embedding", F.col("key") % 20 == 0, k=5, recall=1.0, block=16, query_block=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [v for v, _ in f] for q, f in want.items()}
    two = df.where("vec_id in (100, 101)")
    assert sorted((r.query_id, r.vec_id) for r in neighbours.nearest(two, "vec_id", "embedding", F.lit(True)).collect()) == [(100, 101), (101, 100)]
    assert neighbours.nearest(df.where("vec_id > 199"), "vec_id", "embedding", F.lit(True)).count() in (0, 0)
    assert neighbours.nearest(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, 4), dtype=np.uint8)
    for radius in (0, 5, 11):
        q = codes[:20] ^ np.uint8(1)
        for i, rows in enumerate(neighbours.Index(codes, radius).probe(q)):
            want = np.flatnonzero(neighbours.POPCOUNT[codes ^ q[i]].sum(axis=1) <= radius)
            assert rows.tolist() == want.tolist()
