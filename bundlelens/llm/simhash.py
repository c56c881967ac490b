"""Operator 10: SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most two bits
have a half that differs in at most one. So each fingerprint is indexed by its two whole halves
(the other half then differs in two bits or fewer) and by every half with one bit as wildcard,
where those with the bit off meet those with it on (the other half then differs in one bit or
none). Links are verified. Only distinct fingerprints are indexed; copies share one.

Index entries that many fingerprints share are not paired: their members are indexed again by
the other half with one or two wildcard bits. Of such an entry all members differ from each
other in those bits alone, at most four fingerprints can be in it, and all of them are links.
So no link is lost, and the work stays in proportion to the number of fingerprints.

Semantics. Null text and text without words have the fingerprint zero, linked like any other.
Rows of one key (repeated or not) keep one row each. A null key comes back as null with
a fingerprint; its component is the smallest non-null key that it reaches, or null. An empty
table gives an empty result. Texts of any length are hashed whole. Columns other than key and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm import minhash
from bundlelens.llm.common import BASES, Windows, cut, dealt_join, rows_of, text_batches
from bundlelens.llm.components import components
from bundlelens.llm.minhash import LOWER

SEED = 42
#: An entry of more fingerprints than this is indexed again instead of being paired.
PAIRED = 96


def shingle_hashes(text: bytes, width: int, seed: int = SEED) -> list[int]:
    """XXH64 of each run of `width` words, joined by one space (of all, if there are fewer)."""
    words = text.translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if not hashes:
        return 0
    h, counts = np.array(hashes, "<u8"), np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            for part in rows_of(batch):
                fps = np.array([fingerprint(shingle_hashes(t or b"", width)) for t in part.column(1).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    text_batches(docs.sparkSession)
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _paired(members: DataFrame, keys: list[str], most: int) -> DataFrame:
    """All pairs within an entry whose other half is close enough. members: keys, side (0 or 1;
    null where members of one side are paired with each other), fp."""
    a = members.where("side = 0 or side is null").select(*keys, F.col("fp").alias("fa"), F.col("side").alias("sa"))
    b = members.where("side = 1 or side is null").select(*keys, F.col("fp").alias("fb"), F.col("side").alias("sb"))
    joined = a.join(b, keys).where("sa is not null or fa < fb")
    return joined.where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= most).select("fa", "fb")


def _starred(members: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Links from each entry's smallest fingerprint, where all members of an entry are links."""
    few = members.groupBy(*keys).agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")  # four at most
    lone = few.select(F.array_min("fps").alias("fa"), F.explode("fps").alias("fb"))
    return lone.where((F.col("fa") != F.col("fb")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= most))


def fingerprint_links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Links (fa, fb) between the distinct fingerprints of fps(fp) that differ in at most two
    bits; transitive ones within a crowded entry may be left to their common neighbour."""
    half = "(shiftrightunsigned(fp, 32 * h) & 4294967295L)"
    halves = fps.selectExpr("fp", "explode(array(0, 1)) as h").selectExpr("fp", "h", f"{half} as own", "(shiftrightunsigned(fp, 32 - 32 * h) & 4294967295L) as other")

    # whole halves: the entry is (h, own)
    whole = cut(halves.withColumn("e", F.expr("own | shiftleft(cast(h as long), 32)")), "halves")
    crowd = whole.groupBy("e").agg(F.count("*").alias("n")).where("n > 1")
    sized = whole.join(crowd, "e").withColumn("side", F.lit(None).cast("int"))
    few, many = sized.where(F.col("n") <= paired), sized.where(F.col("n") > paired)
    same = _paired(few, ["e"], 2)
    bits2 = many.selectExpr("e", "fp", "other", "explode(sequence(0, 30)) as i").selectExpr("e", "fp", "other", "i", "explode(sequence(i + 1, 31)) as j")
    same2 = _starred(bits2.selectExpr("e", "fp", "i * 32 + j as ij", "other & ~(shiftleft(1L, i) | shiftleft(1L, j)) as rest"), ["e", "ij", "rest"], 2)

    # halves with a wildcard bit: the entry is (h, i, own without bit i), the sides the bit's values
    wild = halves.selectExpr("fp", "h", "own", "other", "explode(sequence(0, 31)) as i").selectExpr("fp", "other", "cast(shiftrightunsigned(own, i) & 1 as int) as side", "(own & ~shiftleft(1L, i)) | shiftleft(cast(h * 32 + i as long), 32) as e")
    met = wild.groupBy("e").agg(F.sum(1 - F.col("side")).alias("n0"), F.sum("side").alias("n1")).where("n0 > 0 and n1 > 0")
    met = cut(wild.join(met, "e"), "wild")
    small = F.least("n0", "n1") <= paired
    near = _paired(met.where(small), ["e"], 2)
    bits1 = met.where(~small).selectExpr("e", "fp", "other", "explode(sequence(0, 31)) as i")
    near2 = _starred(bits1.selectExpr("e", "fp", "i", "other & ~shiftleft(1L, i) as rest"), ["e", "i", "rest"], 2)
    return same.unionByName(same2).unionByName(near).unionByName(near2).distinct()


def near_duplicates(docs: DataFrame, key: str, text: str, width: int, paired: int = PAIRED) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    found = cut(fingerprints(docs, key, text, width), "fingerprints")
    nodes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    links = fingerprint_links(nodes.select("fp"), paired)
    a = nodes.select(F.col("fp").alias("fa"), F.col("node").alias("a"))
    b = nodes.select(F.col("fp").alias("fb"), F.col("node").alias("b"))
    linked = components(links.join(a, "fa").join(b, "fb").where("a is not null and b is not null").select("a", "b"))
    label = nodes.join(linked.hint("merge"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return found.join(label.hint("merge"), "fp").select("doc_id", "fp", "component_id")


SKETCH = f"doc_id long, row long, fps array<long>, {minhash.SKETCH}"


def sketches(docs: DataFrame, key: str, text: str, width: int, widths: tuple[int, ...] = ()) -> DataFrame:
    """doc_id, row (hash of the text), node, fps (fingerprints by each of `widths`), and the MinHash sketch
    of the set of shingles of `width` words: the columns of minhash.SKETCH (null without words); one row for equal ones.

    node is the number by which links name a row: the key, but of several texts of one key only
    the first has that, the others a number above 2^62 from the hash of key and text.
    """

    def run(batches):
        windows = Windows(BASES[0])
        for batch in batches:
            for part in rows_of(batch):
                texts = part.column(2).cast(pa.binary()).to_pylist()
                fps = [np.array([fingerprint(shingle_hashes(t or b"", w)) for w in widths], np.uint64).view(np.int64) for t in texts]
                made = minhash.sketch_columns(texts, width, windows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.list_(pa.int64())), *made], names=["doc_id", "row", "fps", *minhash.NAMES])

    text_batches(docs.sparkSession)
    drawn = cut(minhash.keyed(docs, key, text).mapInArrow(run, SKETCH), "drawn").dropDuplicates(["doc_id", "row"])
    several = drawn.groupBy("doc_id").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last").select("doc_id", "first")
    other = F.shiftrightunsigned(F.xxhash64("doc_id", "row"), 2) + F.lit(1 << 62)
    node = F.when(F.col("first").isNull() | (F.col("row") == F.col("first")), F.col("doc_id")).otherwise(other)
    return cut(drawn.join(several, "doc_id", "left").withColumn("node", node).drop("first"), "sketches")


def similar_links(docs: DataFrame, key: str, text: str, found: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes of rows that connect those whose sets of shingles have a Jaccard similarity
    of `percent` or more (see `setjoin`); found: their sketches."""
    _, links = minhash.similar_sets(found, minhash.keyed(docs, key, text), width, percent)
    found = found.where("digest is not null").select("digest", "node")
    first = cut(found.groupBy("digest").agg(F.min("node").alias("a")), "first")
    same = dealt_join(found, first, "digest", ["node"]).where("a <> node").select("a", F.col("node").alias("b"))
    ends = links.join(first.withColumnRenamed("digest", "da"), "da").join(first.select(F.col("digest").alias("db"), F.col("a").alias("b")), "db")
    return same.unionByName(ends.select("a", "b"))


def near_duplicate_groups(docs: DataFrame, key: str, text: str, widths: tuple[int, ...], similar: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row, component_id of rows (told apart by key and hash of the text) linked to a smaller
    one, where a link is one by the fingerprints of any of the shingle widths, or a Jaccard
    similarity of `percent` between the sets of shingles of `similar` words. Rows of one key with
    different texts are linked like any others. Null keys are left out."""
    keyed = docs.where(docs[key].isNotNull())
    drawn = sketches(keyed, key, text, similar, widths)
    links = similar_links(keyed, key, text, drawn, similar, percent)
    for i in range(len(widths)):
        found = drawn.select("node", F.col("fps")[i].alias("fp"))
        nodes = cut(found.groupBy("fp").agg(F.min("node").alias("first")), "nodes")
        near = fingerprint_links(nodes.select("fp"))
        a, b = (nodes.select(F.col("fp").alias(f), F.col("first").alias(n)) for f, n in (("fa", "a"), ("fb", "b")))
        own = found.join(nodes, "fp").select(F.col("first").alias("a"), F.col("node").alias("b")).where("a <> b")
        links = links.unionByName(cut(near.join(a, "fa").join(b, "fb").select("a", "b").unionByName(own), "links"))
    linked = components(links).where("component <> node")
    return drawn.select("node", "doc_id", "row").join(linked, "node").select("doc_id", "row", F.col("component").alias("component_id"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, "doc_id", "text", 3).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
