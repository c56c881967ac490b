"""A corpus pipeline of the training-data operators: STAGES over documents, and run().

Each stage takes all that the stage before kept and returns a DataFrame; run() writes each one's
result as Parquet in the shared folder and rereads it. Rows with a null doc_id are judged like
others by language ID and decontamination and are packed; line dedup keeps all their lines, and the
near-duplicate stage, which keeps the row of a group's smallest doc_id, keeps them all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm import decontaminate, languages, linededup, packing, simhash
from bundlelens.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles are learned from the stage's own rows that are not held out. Text without a
    letter, or null text, has no language and goes."""
    profiles = languages.learn(docs.where(~languages.held_out(F.col("doc_id"))), "text", "lang")
    out = languages.identify(docs, "text", profiles, [F.col(c) for c in COLUMNS])
    return out.where("lang_pred <> 'und'").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are cut out of the text, n_chars follows; a document of
    such lines only goes. Lines that only begin alike, and rows of numbers, stay."""
    out = linededup.without_recurring_lines(docs, "doc_id", "text")
    kept = out.where((F.col("n_dropped") == 0) | (F.trim(F.translate("kept", "\n\t\r", "   ")) != ""))
    return kept.select(F.col("doc.doc_id").alias("doc_id"), F.col("kept").alias("text"), F.col("doc.lang").alias("lang"), F.col("doc.source").alias("source"), F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("doc.n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group of linked rows: the one of its smallest doc_id. Links are
    those of the fingerprints of three words (as the operator's query has them) or of five, and a
    Jaccard similarity of 0.8 of the sets of five-word shingles. Rows of one doc_id
    with different texts are told apart, so neither goes with the other; of rows equal in both
    one stays."""
    gone = simhash.near_duplicate_groups(docs, "doc_id", "text", (3, 5)).select("doc_id", "row")
    rows = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("row"))
    left = rows.where("doc_id is not null").join(gone, ["doc_id", "row"], "left_anti")
    keyed = left.groupBy("doc_id", "row").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return keyed.unionByName(rows.where("doc_id is null").select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go. Each text is judged by itself: rows of one key with
    different texts, or with a null key, are told apart."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("row"))
    found = decontaminate.contamination(rows, "row", "text", items, "item_id", "text")
    return rows.join(found.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens (columns as those of the packing operator)."""
    return packing.pack_documents(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 0, 2048)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminated), ("best_fit_packing", packed)]

#: XXH64, the tokenizer and component search have no SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
