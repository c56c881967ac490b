"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.session import shared_dir

#: Odd multipliers of the two window polynomials (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


#: Shuffle files of a step that has been written are of no more use; Spark then deletes them.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Up to which size a side of a join is broadcast: as estimated before it runs, and as measured when it is shuffled.
ESTIMATED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Estimates up to this are taken: at a hundred times the estimate, rows are some tens of megabytes.
ESTIMATED_BYTES = 256 << 10


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings within the block are these; then they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _bytes(size: str) -> int:
    """Of a size as Spark's settings have it (256k, 10485760b, -1)."""
    number, unit = re.fullmatch(r"(-?\d+) *([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * (" kmgtp".index(unit) if unit else 0)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there,
    and a lost executor costs no more than the tasks it was running.

    Its joins broadcast what is named so, and what adaptive execution has measured as small. Estimates are taken up
    to ESTIMATED_BYTES only: they know nothing of an explode, and a file that is read back counts as it is compressed
    (the segments of `merkle` by a seventieth). Joins of a plan that is returned unwritten need a hint instead.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    estimated = spark.conf.get(ESTIMATED)
    least = str(min(ESTIMATED_BYTES, _bytes(estimated)))
    with settings(spark, {CLEAN_UP: "true", ESTIMATED: least, MEASURED: spark.conf.get(MEASURED, None) or estimated}):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python `rows` at a time where the session has Spark's default of 10,000:
    a batch is held several times over, by the JVM outside its heap and by the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def join_path(base: str, *more: str) -> str:
    return "/".join([base.rstrip("/"), *more])


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word as uint64."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of all windows of `width` words: a polynomial over the word hashes modulo 2^64,
    from prefix sums, so that any window costs two look-ups."""

    def __init__(self, base: int):
        self.base, self.powers, self.inverse = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))
            with np.errstate(over="ignore"):
                self.powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, self.base, np.uint64)]))
                self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, pow(self.base, -1, 1 << 64), np.uint64)]))

    def prefix(self, h: np.ndarray) -> np.ndarray:
        self._grow(len(h) + 1)
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(h * self.powers[: len(h)])])

    def at(self, prefix: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((prefix[starts + width] - prefix[starts]) * self.inverse[starts])


def rows_of(batch, chars: int = 8_000_000):
    """Slices of an Arrow batch that hold about `chars` bytes of its largest column at most
    (one row at least), so that Python objects stay few however long the texts are."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * chars / max(1, batch.nbytes)))
    for k in range(0, n, step):
        yield batch.slice(k, step)


def dealt_join(many: DataFrame, few: DataFrame, key: str, spread: list[str], rows: int = 65536) -> DataFrame:
    """many joined to few on a key that few has once, where one key may hold any share of many:
    its row of few is copied for every `rows` rows of many, which are dealt over the copies by a
    hash of their columns `spread`.

    The keys with copies are one in `rows` rows of many at most, so they are broadcast.
    """
    hot = many.groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts")).where("_parts > 1")
    hot = F.broadcast(cut(hot, "hot"))
    part = F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = many.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    copies = few.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [key, "_part"]).drop("_part")
