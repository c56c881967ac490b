"""Operator 1: language identification by rank-order n-gram profiles.

A profile is the `top` most frequent n-grams (1 to 3 letters, words bounded by a mark) in order
of frequency. A document's own profile is compared with each language's: every one of its
n-grams costs the difference of the two ranks, or `top` if the language lacks it, and the language of
the least total is predicted. Profiles are learned from all training rows by sums over
(language, n-gram); what is broadcast is `top` n-grams a language, at most `most_languages`.

Semantics. Letters are what Unicode calls letters, lower-cased one by one; all else bounds
words. Null text, or text without a letter, is `und` with score 0, as is all text if nothing
could be learned. score is 1 - distance / the largest distance possible. Ties go to the
smaller name, ties of n-gram counts to the smaller n-gram. A repeated row gives a row each; a null key
comes back null. Rows with null text or null language teach nothing. Other columns are not read.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bundlelens.llm.common import rows_of, text_batches

MARK = 1
_TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """By code point: the lower-case letter, or MARK if it is none. One per Python worker."""
    if not _TABLE:
        table = np.full(sys.maxunicode + 1, MARK, np.int64)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _TABLE.append(table)
    return _TABLE[0]


def grams(text: str | None) -> np.ndarray:
    """All n-grams of 1 to 3 characters as int64 (21 bits a character); none if there is no letter."""
    c = letter_table()[np.frombuffer((text or "").encode("utf-32-le"), np.uint32)]
    c = np.concatenate([[MARK], c, [MARK]])
    c = c[np.concatenate([[True], (c[1:] != MARK) | (c[:-1] != MARK)])]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[c != MARK], two, three])


def ranked(g: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by n-gram."""
    values, counts = np.unique(g, return_counts=True)
    if len(values) > top:
        least = np.partition(counts, -top)[-top]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.argsort(-counts, kind="stable")][:top]


@dataclass
class Profiles:
    """names: languages; grams: all their n-grams, sorted; ranks: a row per language, `top` where it lacks the n-gram."""

    names: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    top: int

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text)
        if not len(g) or not self.names:
            return "und", 0.0
        doc = ranked(g, self.top)
        at = np.searchsorted(self.grams, doc)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == doc
        place = np.flatnonzero(known)
        r = self.ranks[:, at[place]]
        d = np.where(r == self.top, self.top, np.abs(r - place)).sum(axis=1) + self.top * (len(doc) - len(place))
        k = int(np.argmin(d))
        return self.names[k], float(1 - d[k] / (self.top * len(doc)))


def learn(docs: DataFrame, text: str, lang: str, top: int = 300, most_languages: int = 1000) -> Profiles:
    """Profiles from all rows of docs. Each task sums its own rows before anything is shuffled."""

    def count(batches):
        sums: dict[str, list] = {}

        def folded(parts):
            g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            values, inverse = np.unique(g, return_inverse=True)
            return values, np.bincount(inverse, n).astype(np.int64)

        for batch in batches:
            for part in rows_of(batch, 4_000_000):
                names = part.column(1).to_pylist()
                texts = part.column(0).to_pylist()
                by: dict[str, list] = {}
                for name, t in zip(names, texts, strict=True):
                    by.setdefault(name, []).append(grams(t))
                for name, gs in by.items():
                    values, n = np.unique(np.concatenate(gs), return_counts=True)
                    kept = sums.setdefault(name, [])
                    kept.append((values, n))
                    if len(kept) > 8:
                        sums[name] = [folded(kept)]
        for name, kept in sums.items():
            values, n = folded(kept)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(values), pa.array(n)], names=["lang", "gram", "n"])

    text_batches(docs.sparkSession)
    rows = docs.select(docs[text].cast("string").alias("t"), docs[lang].cast("string").alias("l")).where("t is not null and l is not null")
    total = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = total.withColumn("rank", place - 1).where(F.col("rank") < top).limit(top * most_languages + 1).collect()
    if len(found) > top * most_languages:
        raise ValueError(f"more than {most_languages} languages")
    names = sorted({r.lang for r in found})
    known = np.unique(np.array([r.gram for r in found], np.int64))
    ranks = np.full((len(names), len(known)), top, np.int64)
    if found:
        ranks[np.searchsorted(names, [r.lang for r in found]), np.searchsorted(known, [r.gram for r in found])] = [r["rank"] for r in found]
    return Profiles(names, known, ranks, top)


def identify(docs: DataFrame, text: str, profiles: Profiles, keep: list[Column]) -> DataFrame:
    """The kept columns with lang_pred and score, a row for each row; nothing is shuffled."""
    rows = docs.select(*keep, docs[text].cast("string").alias("__text"))
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        p = shared.value
        for batch in batches:
            for part in rows_of(batch):
                found = [p.predict(t) for t in part.column(part.num_columns - 1).to_pylist()]
                cols = [*part.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its key as text has the remainder 1 by 3 (a null key is not)."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(docs.where(~held_out(F.col("doc_id"))), "text", "lang")
    return identify(docs, "text", profiles, [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])
