import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from bundlelens.llm import merkle
from bundlelens.llm.common import dealt_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, i long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def way(levels, i):
    for level in levels[:-1]:
        run = level[i - i % 16 : i - i % 16 + 16]
        yield run[: i % 16], run[i % 16 + 1 :]
        i //= 16


def brute(rows):
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by = {}
    for k, t, lang, source, n, *_ in rows:
        leaf, bad = (h(*map(framed, (k, source, lang, n, x))) for x in (t, lower(t)))
        by.setdefault(source, []).append((k is not None, k or 0, leaf, bad if k is not None and zlib.crc32(str(k).encode()) % 5 == 0 else leaf))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        by[s].sort(key=lambda x: x[:3])
        trees.append(levels_of([x[2] for x in by[s]]))
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for g, s in enumerate(order):
        for i, (known, k, leaf, start) in enumerate(by[s]):
            steps = [*way(trees[g], i), *way(top, g)]
            acc = start
            for a, b in steps:
                acc = h(*a, acc, *b)
            out.append((k if known else None, leaf, trees[g][-1][0], top[-1][0], h(*[x for a, b in steps for x in [*a, *b]]), acc, acc == top[-1][0]))
    return sorted(out, key=str)


def run(spark, tmp_path, rows):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return sorted((tuple(r) for r in merkle.op13_merkle(spark, str(tmp_path)).collect()), key=str)


def corpus():
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("aBcé ") for _ in range(rng.randrange(30))), rng.choice(["en", None]), "hot", rng.randrange(99), "x", "y", 0) for k in range(600)]
    rows += [(1000 + k, f"T{k}", "de", f"s{k}", None, None, None, None) for k in range(300)]  # 300 groups of one leaf
    rows += [(2000 + k, f"U{k}", None, None, 1, None, None, None) for k in range(17)]
    rows += [(None, "No Key", None, "hot", 1, None, None, None), (None, None, None, None, None, None, None, None), (5, "Another", "en", "hot", 7, None, None, None), (6, rows[6][1], *rows[6][2:]), (3000, "Long " * 200_000, "en", "é", 1, None, None, None), (3001, "", "", "", 0, None, None, None)]
    return rows


def test_proofs_equal_brute_force(spark, tmp_path):
    rows = corpus()
    got = run(spark, tmp_path, rows)
    assert got == brute(rows)
    assert 0 < sum(not r[6] for r in got) < len(got) / 2


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_small_tables(spark, tmp_path, n):
    rows = [(k, f"Text {k}", "en", "s", k, None, None, None) for k in range(n)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_a_changed_proof_does_not_verify(spark):
    rows = [("s", k, h(str(k))) for k in range(40)]
    m = merkle.manifest(spark.createDataFrame(rows, "grp string, key long, leaf string"))
    moved = F.transform("steps", lambda s: F.struct(((s["at"] + 1) % 2).alias("at"), s["sibs"].alias("sibs")))
    got = m.select((merkle.folded("steps", F.col("leaf")) == F.col("root")).alias("good"), (merkle.folded(moved, F.col("leaf")) == F.col("root")).alias("bad")).collect()
    assert len(got) == 40 and all(r.good and not r.bad for r in got)


def test_dealt_join_equals_join(spark):
    many = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id % 50) as k", "id as v")
    few = spark.range(40).selectExpr("id as k", "id * 7 as w")
    got = sorted(tuple(r) for r in dealt_join(many, few, "k", ["v"], rows=100).collect())
    assert got == sorted(tuple(r) for r in many.join(few, "k").collect())
