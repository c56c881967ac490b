"""Operator 12: MinHash near-duplicates with odd sketches.

A text's shingles are a set; equal sets are one. The set's smallest hashes under 104 permutations go into 26
bands of 4, and are folded into a parity bitmap of 256 bits: each (permutation, value) flips one bit. In the
XOR of two bitmaps the values that both sets have cancel out, so its population count z grows with the
differing ones alone, and 1 + m / (4 k) ln(1 - 2 z / m) estimates the similarity, most precisely where it is high. Candidates
agree in a band and must pass the sketches: they are dropped where z is so large that sets of the asked
similarity have it with a probability below 10^-6 (the cut-off follows from the distribution of z). What
passes, and passes the parity of the whole sets as well (a bound without any error, see `setjoin`), is confirmed on full sets. Sets as similar as 0.8 agree in no band with a probability of 10^-6.

How bands are worked through, and what becomes of crowded ones, is said in `setjoin`.

Semantics. Null text and text without words have the empty set and are linked with nothing; of fewer words
than a shingle has, the whole sequence is the one shingle. Shingles are told apart by 64-bit hashes. Rows of one key
keep one row each; their sets link like any others. A null key comes back as null, its component is the
smallest non-null key that it reaches, or null; it is kept if that is null. An empty table gives an empty result. Texts of any
length are taken whole. Columns other than key and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.common import BASES, Windows, cut, dealt_join, mix, rows_of, text_batches, word_hashes
from bundlelens.llm.components import components
from bundlelens.llm.setjoin import linked_sets

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BANDS, ROWS, BITS = 26, 4, 256
SAMPLES, LONGS = BANDS * ROWS, BITS // 64
#: Bits of a whole set's parity: a hash's top bits say which one it flips.
PARITY_BITS = 512
MULTIPLIERS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
#: Rows asked for by name are broadcast up to this number (24 bytes each), joined by a shuffle above it.
BROADCAST_ROWS = 1_000_000


def odd_cutoff(samples: int, bits: int, percent: int, miss: float) -> int:
    """The least z for which sets of that similarity differ in more than z bits of their odd sketches
    with a probability of `miss` at most: each of Binomial(samples, 1 - percent/100) samples flips two
    bits at random."""
    odd = np.zeros(bits + 1)
    odd[0], total, q = 1.0, np.zeros(bits + 1), 1 - percent / 100
    chance, rest = (1 - q) ** samples, np.arange(bits + 1) / bits
    for d in range(samples + 1):
        total += chance * odd
        chance *= (samples - d) / (d + 1) * q / (1 - q)
        for _ in range(2):
            odd = np.concatenate([[0.0], (odd * (1 - rest))[:-1]]) + np.concatenate([(odd * rest)[1:], [0.0]])
    return int(np.searchsorted(np.cumsum(total), 1 - miss))


def shingles(text: bytes, width: int, windows: Windows) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    h = word_hashes(text.translate(LOWER).split())
    n = len(h)
    if not n:
        return h
    prefix = windows.prefix(h)
    if n < width:
        return mix(windows.at(prefix, np.zeros(1, np.int64), n) + np.uint64(n))
    return np.unique(windows.at(prefix, np.arange(n - width + 1), width))


def samples(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of a set (not empty) under each permutation."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 2048):
            low = np.minimum(low, (MULTIPLIERS[:, None] * hashes[None, k : k + 2048]).min(axis=1))
    return low


def bands_and_odd(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        bands = mix((mix(low) * MULTIPLIERS[::-1]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64))
        at = mix(low ^ mix(MULTIPLIERS)) % np.uint64(BITS)
    bits = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return bands.view(np.int64), np.packbits(bits, bitorder="little").view(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    bits = np.bincount((hashes >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def similarity(z: int, samples: int = SAMPLES, bits: int = BITS) -> float:
    """The similarity of two sets whose odd sketches differ in z bits."""
    return 1 + bits / (4 * samples) * float(np.log(max(1 - 2 * z / bits, 1 / bits)))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[text].cast("string")).alias("row"), docs[text].cast("string").alias("text"))


SKETCH = "n int, digest binary, odd array<long>, parity array<long>, bands array<long>"
NAMES = ["n", "digest", "odd", "parity", "bands"]


def sketch_columns(texts: list[bytes | None], width: int, windows: Windows) -> list[pa.Array]:
    n, digests, odds, parities, bands = [], [], [], [], []
    for t in texts:
        own = shingles(t or b"", width, windows)
        n.append(len(own))
        digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
        band, odd = bands_and_odd(samples(own)) if len(own) else (None, None)
        odds.append(odd)
        parities.append(parity(own) if len(own) else None)
        bands.append(band)
    return [pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.array(odds, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))]


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, row and the columns of SKETCH of rows(doc_id, row, text)."""

    def run(batches):
        windows = Windows(BASES[0])
        for batch in batches:
            for part in rows_of(batch):
                made = sketch_columns(part.column(2).cast(pa.binary()).to_pylist(), width, windows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["doc_id", "row", *NAMES])

    text_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"doc_id long, row long, {SKETCH}")


def shingle_sets(rows: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(digest, hashes) of the rows(doc_id, row, text) that asked(doc_id, row, digest) names."""

    def run(batches):
        windows = Windows(BASES[0])
        for batch in batches:
            for part in rows_of(batch, 1_000_000):
                sets = [shingles(t or b"", width, windows).view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "hashes"])

    asked = cut(asked, "asked")
    named = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    named = named.select(F.col("doc_id").alias("k"), F.col("row").alias("r"), "digest")
    texts = rows.join(named, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("row") == F.col("r"))).select("digest", "text")
    return texts.mapInArrow(run, "digest binary, hashes array<long>").dropDuplicates(["digest"])


def similar_sets(drawn: DataFrame, rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The distinct sets of sketches (digest, doc_id and row of one that has it) and links (da, db)
    that connect similar ones."""
    own = drawn.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "row", "n", "odd", "parity", "bands")).alias("own"))
    nodes = cut(own.select("digest", "own.*"), "nodes")
    sets = lambda digests: shingle_sets(rows, nodes.join(digests, "digest").select("doc_id", "row", "digest"), width)
    return nodes, linked_sets(nodes, sets, percent, odd_cutoff(SAMPLES, BITS, percent, 1e-6), LONGS, PARITY_BITS // 64)


def near_duplicates(docs: DataFrame, key: str, text: str, width: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = keyed(docs, key, text)
    drawn = cut(sketches(rows, width), "sketches")
    nodes, links = similar_sets(drawn, rows, width, percent)
    first = drawn.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("low"))
    linked = components(links.toDF("a", "b")).select(F.col("node").alias("digest"), "component")
    first = cut(first.join(linked, "digest", "left").withColumn("component", F.coalesce("component", "digest")), "first")
    lowest = first.groupBy("component").agg(F.min("low").alias("component_id"))
    label = dealt_join(first, lowest, "component", ["digest"]).select("digest", "component_id")
    own = drawn.select("doc_id", "row", "n", "digest")
    out = dealt_join(own.where("digest is not null"), label, "digest", ["doc_id", "row"])
    out = out.unionByName(own.where("digest is null").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", 2, 80)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN words IS NULL OR len(words) = 0 THEN [] WHEN len(words) = 1 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM w),
u AS (SELECT min(doc_id) AS node, list_sort(shingles) AS own, len(own) AS n FROM s WHERE len(shingles) > 0 GROUP BY own),
t AS (SELECT node, n, unnest(own) AS shingle FROM u),
f AS (SELECT shingle, count(*) AS df FROM t GROUP BY shingle),
o AS (SELECT node, n, shingle, row_number() OVER (PARTITION BY node ORDER BY df, shingle) AS pos FROM t JOIN f USING (shingle)),
c AS (SELECT DISTINCT a.node AS x, b.node AS y FROM o a JOIN o b USING (shingle) WHERE a.node < b.node AND a.pos <= a.n - ceil(a.n * 0.8) + 1 AND b.pos <= b.n - ceil(b.n * 0.8) + 1 AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT x, y FROM c JOIN u a ON a.node = x JOIN u b ON b.node = y WHERE 100 * len(list_intersect(a.own, b.own)) >= 80 * (a.n + b.n - len(list_intersect(a.own, b.own)))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT node, node AS low FROM u UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.low),
k AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT s.doc_id, len(s.shingles) AS n_shingles, coalesce(k.low, s.doc_id) AS component_id, s.doc_id = coalesce(k.low, s.doc_id) AS kept
FROM s LEFT JOIN u ON u.own = list_sort(s.shingles) LEFT JOIN k ON k.node = u.node
"""
