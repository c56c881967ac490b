"""Operator 4: nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (iterative quantisation) turns vectors into binary codes
of a bit a dimension. Codes are cut into substrings, each with an index: for each value of a
substring, the rows whose own value is within `reach` bits, as a bit set. By the pigeonhole
principle, a code within Hamming radius r of the query's has a substring within floor(r / m) bits,
so the union of m bit sets holds every code within the radius; those are verified and the
float vectors reranked by inner product in double precision. The radius is the least that
finds `recall` of the sample's own neighbours; more rows only bring nearer neighbours.

Vectors are indexed in blocks of `block` rows, dealt by hash; queries are dealt in larger blocks, and
each (index block, query block) is a task's group of bounded size, whose k best go to the final
ranking. So a vector is sent, and its block's index built, once for each `query_block` queries. Identical vectors are indexed once: of their rows the k + 1 smallest keys can be in a
result, and those are what their class carries. A query with fewer than k in the radius is searched
again without it.

Semantics. Vectors that are null, zero, of another length than the sample's most frequent one,
or that hold null or non-finite components take no part, nor do null keys. Repeated rows of a key
and vector count once; a key with several vectors may come up with each. With no vectors or no
queries the result is empty. Columns other than key and vector are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bundlelens.llm.common import cut

POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Codes:
    """rotation (dimension x bits, bits a multiple of 8), radius in bits."""

    def __init__(self, sample: np.ndarray, k: int, recall: float, rounds: int = 40, seed: int = 7):
        n, d = sample.shape
        self.bits = -(-d // 8) * 8
        rng = np.random.default_rng(seed)
        scale = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
        basis = np.linalg.qr(rng.normal(size=(self.bits, self.bits)))[0][:d] if d < self.bits else np.linalg.eigh(scale.T @ scale)[1]
        z = scale @ basis
        r = np.linalg.qr(rng.normal(size=(self.bits, self.bits)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ v).T
        self.rotation = basis @ r
        self.radius = self._calibrate(sample, k, recall)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.rotation > 0, axis=1)

    def _calibrate(self, x: np.ndarray, k: int, recall: float) -> int:
        probes = np.arange(0, len(x), max(1, len(x) // 300))
        s = x[probes] @ x.T
        s[np.arange(len(probes)), probes] = -np.inf
        near = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
        c = self.of(x)
        far = POPCOUNT[c[probes][:, None, :] ^ c[near]].sum(axis=2).ravel()
        return int(np.quantile(far, recall, method="higher")) if far.size else self.bits


class Index:
    """A block's substring indexes."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = codes, radius
        n, m = codes.shape
        reach = radius // m
        near = POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= reach
        self.sets = []
        for i in range(m):
            rows = np.zeros((256, n), bool)  # rows of each value
            rows[codes[:, i], np.arange(n)] = True
            packed, out = np.packbits(rows, axis=1), np.zeros((256, -(-n // 8)), np.uint8)
            used = np.flatnonzero(rows.any(axis=1))
            for v in range(256):
                for u in used[near[v, used]]:
                    out[v] |= packed[u]
            self.sets.append(out)

    def probe(self, codes: np.ndarray) -> list[np.ndarray]:
        """Row numbers of all codes within the radius of each of the codes."""
        found = self.sets[0][codes[:, 0]]
        for i in range(1, codes.shape[1]):
            found = found | self.sets[i][codes[:, i]]
        out = []
        for q, bits in zip(codes, found, strict=True):
            rows = np.flatnonzero(np.unpackbits(bits, count=len(self.codes)))
            out.append(rows[POPCOUNT[self.codes[rows] ^ q].sum(axis=1) <= self.radius])
        return out


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _stack(vectors: pd.Series, d: int) -> np.ndarray:
    return np.concatenate(vectors.to_numpy()).astype(np.float64).reshape(-1, d) if len(vectors) else np.zeros((0, d))


def _search(classes: DataFrame, queries: DataFrame, k: int, codes: Codes, d: int, block: int, query_block: int, radius: int) -> DataFrame:
    """query (class), class, score: the k + 1 best of the classes for each query class."""
    spark = classes.sparkSession
    nc, nq = (max(1, -(-df.count() // n)) for df, n in ((classes, block), (queries, query_block)))
    a = classes.select(F.pmod(F.xxhash64("rep"), F.lit(nc)).cast("int").alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), "rep", "vector")
    b = queries.select(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(nq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("ib"), F.col("rep").alias("asked"), F.col("vector").alias("wanted"))
    shared = spark.sparkContext.broadcast(codes)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            c = shared.value
            x, q = _stack(left["vector"], d), _stack(right["wanted"], d)
            index, reps = Index(c.of(x), radius), left["rep"].to_numpy()
            asked = right["asked"].to_numpy()
            for at in range(0, len(q), 256):
                for i, rows in enumerate(index.probe(c.of(q[at : at + 256])), at):
                    s = x[rows] @ q[i]
                    if len(s) > k + 1:
                        least = np.partition(s, -(k + 1))[-(k + 1)]
                        rows, s = rows[s >= least], s[s >= least]
                    best = np.lexsort((reps[rows], -s))[: k + 1]
                    out.append(pd.DataFrame({"query": asked[i], "rep": reps[rows[best]], "score": s[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    pairs = a.groupBy("ib", "qb").cogroup(b.groupBy("ib", "qb")).applyInPandas(run, "query long, rep long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    return pairs.withColumn("p", place).where(F.col("p") <= k + 1).drop("p")


def nearest(rows: DataFrame, key: str, vector: str, is_query: Column, k: int = 20, sample: int = 5000, recall: float = 0.96, block: int = 8192, query_block: int = 32768) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest (largest inner product) rows of each query row.

    is_query: a condition on column `key`. sample: vectors the rotation and radius are learned
    from, those of the smallest hashes of their key.
    """
    v = rows.select(rows[key].cast("long").alias("key"), rows[vector].cast("array<double>").alias("vector")).where("key is not null")
    v = v.where(usable(F.col("vector"))).withColumn("vector", F.transform("vector", lambda x: x + 0.0))  # -0.0 is 0.0
    some = [np.array(r.vector) for r in v.orderBy(F.xxhash64("key"), "key").limit(sample).collect()]
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not some:
        return empty
    d = Counter(map(len, some)).most_common(1)[0][0]
    codes = Codes(np.stack([x for x in some if len(x) == d]), k, recall)
    v = v.where(F.size("vector") == d).distinct()
    of_class = Window.partitionBy("vector").orderBy("key")
    few = v.withColumn("p", F.row_number().over(of_class)).where(F.col("p") <= k + 1)
    classes = cut(few.groupBy("vector").agg(F.sort_array(F.collect_list("key")).alias("keys")).select(F.col("keys")[0].alias("rep"), "vector", "keys"), "classes")
    # a class that shares its smallest key with another (a key of several vectors) keeps its own number
    classes = cut(classes.withColumn("rep", F.struct("rep", F.xxhash64("vector").alias("h"))).withColumn("rep", F.when(F.count("*").over(Window.partitionBy("rep.rep")) == 1, F.col("rep.rep")).otherwise(F.xxhash64("rep"))), "classes")
    asked = cut(v.where(is_query).join(classes.select("vector", "rep"), "vector").select("key", "rep"), "queries")
    reps = classes.join(asked.select("rep").distinct(), "rep", "left_semi")
    found = cut(_search(classes, reps, k, codes, d, block, query_block, codes.radius), "found")
    total = v.count()
    got = found.join(classes.select("rep", F.size("keys").alias("n")), "rep").groupBy("query").agg(F.sum("n").alias("n"))
    short = reps.join(got.select(F.col("query").alias("rep"), "n"), "rep", "left").where(F.coalesce("n", F.lit(0)) < min(k + 1, total)).select("rep", "vector", "keys")
    short = cut(short, "short")
    if not short.isEmpty():
        again = _search(classes, short, k, codes, d, block, query_block, codes.bits)
        found = cut(found.join(short.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(again), "found")
    hits = found.join(classes.select("rep", "keys"), "rep").select("query", "score", F.explode("keys").alias("vec_id"))
    each = asked.select(F.col("key").alias("query_id"), F.col("rep").alias("query")).join(hits, "query").where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, "vec_id", "embedding", F.col("key") % 20 == 0)
