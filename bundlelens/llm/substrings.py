"""Operator 6: substring dedup by difference-cover anchors.

Of every document the word windows at cover positions are hashed: positions whose remainder by
a period v is in a difference cover, a set with two members at every difference modulo v. Where
a long window of w words occurs at positions p and q, some shift t < v brings both p + t and
q + t to cover positions, so that both documents hash the same anchor of w - v + 1 words there.
Anchors of one document only are dropped; windows around shared anchors are extended to all w
words and hashed in 128 bits, and a window is a repeat if its hash is in a smaller document.

Semantics. Null text has no words. A window is judged on the input, whatever is removed beside
it. Rows of one key are one document's rows: none of them is smaller than the other, and equal
rows each keep a row. A row with a null key keeps all its words and makes no other lose any.
An empty table gives an empty result. Columns other than key and text are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.common import BASES, Windows, cut, mix, rows_of, word_hashes

#: A perfect difference set: each difference modulo 31 once (fixed values).
COVER_31 = (0, 1, 3, 8, 12, 18)


def difference_cover(period: int) -> np.ndarray:
    """A set of remainders with two at every difference: the perfect one for 31, else the first
    r = ceil(sqrt(period)) remainders with all multiples of r."""
    if period == 31:
        return np.array(COVER_31)
    r = int(np.ceil(np.sqrt(period)))
    return np.unique(np.concatenate([np.arange(r), np.arange(0, period, r)]) % period)


class Anchors:
    def __init__(self, width: int, period: int):
        self.width, self.period, self.length = width, period, width - period + 1
        self.cover, self.windows = difference_cover(period), [Windows(b) for b in BASES]

    def positions(self, n: int) -> np.ndarray:
        """Cover positions of anchors in a document of n words that has a window at all."""
        if n < self.width:
            return np.zeros(0, np.int64)
        at = (np.arange(0, n, self.period)[:, None] + self.cover).ravel()
        return at[at + self.length <= n]

    def hashes(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.windows[0].at(self.windows[0].prefix(h), at, self.length)

    def candidates(self, n: int, shared: np.ndarray) -> np.ndarray:
        """Starts of windows that hold a shared anchor in their first `period` words."""
        delta = np.zeros(n + 2, np.int32)
        np.add.at(delta, np.maximum(shared - self.period + 1, 0), 1)
        np.add.at(delta, shared + 1, -1)
        return np.flatnonzero(np.cumsum(delta)[: max(0, n - self.width + 1)] > 0)

    def extended(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each whole window, from two polynomials over different word hashes."""
        return tuple(w.at(w.prefix(x), at, self.width).view(np.int64) for w, x in zip(self.windows, (h, mix(h)), strict=True))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, row (hash of the text: tells rows of one key apart), text."""
    return docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[text].cast("string")).alias("row"), docs[text].cast("string").alias("text"))


def _anchor_rows(rows: DataFrame, width: int, period: int, placed: bool) -> DataFrame:
    """h, doc_id of each distinct anchor of a document; placed: h, doc_id, row, at of each one."""
    names = ["h", "doc_id", "row", "at"] if placed else ["h", "doc_id"]

    def run(batches):
        a = Anchors(width, period)
        for batch in batches:
            for part in rows_of(batch):
                ids, own, ats, hs, ns = part.column(0).to_numpy(), part.column(1).to_numpy(), [], [], []
                for text in part.column(2).cast(pa.binary()).to_pylist():
                    words = text.split() if text else []
                    at = a.positions(len(words))
                    h = a.hashes(word_hashes(words), at) if len(at) else np.zeros(0, np.uint64)
                    if not placed:
                        h = np.unique(h)
                    hs.append(h)
                    ats.append(at)
                    ns.append(len(h))
                h = np.concatenate(hs).view(np.int64)
                cols = [h, np.repeat(ids, ns)]
                if placed:
                    cols += [np.repeat(own, ns), np.concatenate(ats).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return rows.where("doc_id is not null and text is not null").mapInArrow(run, "h long, doc_id long" + (", row long, at int" if placed else ""))


def copies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, row of documents whose whole text a smaller document has. All their windows are
    repeats, and no other document needs them as evidence."""
    d = docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[text].cast("string")).alias("row"), F.unhex(F.md5(docs[text].cast("binary"))).alias("digest"))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    return cut(d.join(cut(first, "texts"), "digest").where("doc_id > least").select("doc_id", "row").distinct(), "copies")


def repeated_windows(docs: DataFrame, key: str, text: str, width: int = 50, period: int = 31) -> DataFrame:
    """doc_id, row, starts, whole: per document, the positions of windows that a smaller one has
    too; whole (and no starts) if a smaller one has all of its text."""
    rows = _keyed(docs, key, text)
    anchors = _anchor_rows(rows, width, period, False)
    shared = cut(anchors.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"), "shared")
    placed = _anchor_rows(rows, width, period, True).join(shared, "h", "left_semi")
    found = cut(placed.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("at")).alias("ats")), "anchors")

    def extend(batches):
        a = Anchors(width, period)
        for batch in batches:
            for part in rows_of(batch, 2_000_000):
                out, ns, p = [], [], part.to_pydict()
                for words, ats in zip([t.encode().split() for t in p["text"]], p["ats"], strict=True):
                    at = a.candidates(len(words), np.array(ats))
                    out.append((*a.extended(word_hashes(words), at), at.astype(np.int32)))
                    ns.append(len(at))
                a0, b0, at = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a0), pa.array(b0), pa.array(np.repeat(part.column(0).to_numpy(), ns)), pa.array(np.repeat(part.column(1).to_numpy(), ns)), pa.array(at)], names=["h", "g", "doc_id", "row", "at"])

    copied = copies(docs, key, text)
    joined = found.join(copied, ["doc_id", "row"], "left_anti").join(rows, ["doc_id", "row"]).select("doc_id", "row", "text", "ats")
    windows = cut(joined.mapInArrow(extend, "h long, g long, doc_id long, row long, at int"), "windows")
    first = cut(windows.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h", "g", "least"), "first")
    later = windows.join(first, ["h", "g"]).where("doc_id > least")
    starts = later.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("at")).alias("starts"), F.lit(False).alias("whole"))
    return cut(starts.unionByName(copied.withColumns({"starts": F.lit(None).cast("array<int>"), "whole": F.lit(True)})), "repeats")


def without_repeats(docs: DataFrame, key: str, text: str, width: int = 50, period: int = 31) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words that no repeated window covers, joined by one space."""
    rows = _keyed(docs, key, text)
    joined = rows.join(repeated_windows(docs, key, text, width, period), ["doc_id", "row"], "left").select("doc_id", "text", "starts", "whole")

    def run(batches):
        for batch in batches:
            for part in rows_of(batch):
                out = []
                for doc, text, starts, whole in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    words = text.split() if text else []
                    n, kept = len(words), words
                    if whole:
                        kept = words if n < width else []
                    elif starts:
                        delta = np.zeros(n + 1, np.int32)
                        delta[starts] += 1
                        np.add.at(delta, np.array(starts) + width, -1)
                        kept = [words[i] for i in np.flatnonzero(np.cumsum(delta)[:n] == 0).tolist()]
                    out.append((doc, n, n - len(kept), b" ".join(kept).decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = without_repeats(docs, "doc_id", "text")
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
