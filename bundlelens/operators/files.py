"""File index, directory tree, look-ups by suffix, and dedup of whole bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def index_summary(files: DataFrame, by: str, kind: str, size: str, most: int = 5000) -> DataFrame:
    """Counts by type and bytes of each bundle, and whether its report lists all of them."""
    k = F.col(kind)
    return files.groupBy(by).agg(
        F.count_if(k == "file").alias("files"), F.count_if(k == "directory").alias("directories"), F.count_if(k == "symlink").alias("symlinks"),
        F.coalesce(F.sum(F.when(k == "file", F.col(size))), F.lit(0)).cast("long").alias("total_bytes"), (F.count("*") > most).alias("truncated"),
    )


def top_level_entries(files: DataFrame, by: str, path: str, most: int = 20) -> DataFrame:
    counts = files.groupBy(by, F.split(F.col(path), "/")[0].alias("entry")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "entry"))
    return counts.withColumn("place", place).where(F.col("place") <= most)


def largest_files(files: DataFrame, by: str, path: str, size: str, most: int = 10) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(size), path))
    return files.withColumn("place", place).where(F.col("place") <= most)


def directory_tree(files: DataFrame, by: list[str], path: str, size: str) -> DataFrame:
    """Every ancestor directory with the files and bytes below it."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    f = files.select(*by, F.col(size).alias("bytes"), parts.alias("parts")).where("size(parts) > 1")
    above = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))
    return f.select(*by, "bytes", F.explode(above).alias("directory")).groupBy(*by, "directory").agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("total_bytes"))


def with_suffix(files: DataFrame, path: str, suffix: str) -> DataFrame:
    return files.where(F.col(path).endswith(suffix))


def first_with_suffix(files: DataFrame, by: str, path: str, suffix: str) -> DataFrame:
    """The first file by path of each bundle that ends so."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(path))
    return with_suffix(files, path, suffix).withColumn("place", place).where("place = 1").drop("place")


def likely_logs(files: DataFrame, by: str, path: str) -> DataFrame:
    """likely_log, and is_default for the first likely log by path of each bundle."""
    p = F.col(path)
    likely = p.contains("/logs/") | p.endswith(".log") | p.endswith(".txt")
    f = files.withColumn("likely_log", likely)
    first = f.where("likely_log").groupBy(by).agg(F.min(path).alias("first"))
    return f.join(first, by, "left").withColumn("is_default", F.col("likely_log") & (p == F.col("first"))).drop("first")


def log_lines(files: DataFrame, keep: list[str], text: str, sample_bytes: int | None = None) -> DataFrame:
    """A row a line, numbered from 1 before blank ones go; sample_bytes keeps lines that start
    within so many characters of either end (an option: by default all are scanned)."""
    lines = files.select(*keep, F.length(text).alias("size"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("k", "line"))
    out = lines.select(*keep, (F.col("k") + 1).cast("long").alias("line_no"), "line", "size")
    if sample_bytes is not None:
        by = Window.partitionBy(*keep).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
        at = F.coalesce(F.sum(F.length("line") + 1).over(by), F.lit(0))
        out = out.withColumn("at", at).where((F.col("at") < sample_bytes) | (F.col("at") >= F.col("size") - sample_bytes)).drop("at")
    return out.where(F.trim("line") != "").drop("size")


def new_bundles(incoming: DataFrame, known: DataFrame | None, checksum: str, order: list[str]) -> DataFrame:
    """The first of each checksum that isn't known, whatever its product."""
    if known is not None:
        incoming = incoming.join(known.select(checksum).distinct(), checksum, "left_anti")
    row = F.struct(*[incoming[c] for c in incoming.columns])
    return incoming.groupBy(F.col(checksum).alias("__sum")).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def duplicates(rows: DataFrame, checksum: str, key: str) -> DataFrame:
    """Rows whose checksum a smaller key has, with that key as `first`."""
    first = rows.groupBy(checksum).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, checksum).where(F.col(key) > F.col("first"))
