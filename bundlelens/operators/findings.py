"""Findings: summaries, dedup, order, grouping, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bundlelens.functions.text import severity_of, severity_rank

FINDING = "bundle_id string, id string, severity string, category string, title string, description string, evidence array<string>, evidence_refs array<struct<path:string,lineStart:long,lineEnd:long,label:string,excerpt:string>>, count long, path string, seq long"


def severity_summary(rows: DataFrame, by: str, severity: str, all_of: DataFrame | None = None) -> DataFrame:
    """total and counts by severity; all_of(by) gives those without a row zeros."""
    s = F.col(severity)
    out = rows.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(s == x).alias(x) for x in ("critical", "warning", "info")])
    if all_of is not None:
        out = all_of.select(by).distinct().join(out, by, "left").na.fill(0, ["total", "critical", "warning", "info"])
    return out


def highest_severity(rows: DataFrame, by: list[str], severity: str) -> DataFrame:
    return rows.groupBy(*by).agg(severity_of(F.min(severity_rank(F.col(severity)))).alias("severity"))


def first_by_id(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each id in the order given."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__k", place).where("__k = 1").drop("__k")


def in_report_order(rows: DataFrame, by: str, severity: str, keys: list[Column | str], most: int | None = None) -> DataFrame:
    """`place` within the bundle by severity, then by keys."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(severity_rank(F.col(severity)), *keys))
    out = rows.withColumn("place", place)
    return out if most is None else out.where(F.col("place") <= most)


def unicode_order(c: str) -> Column:
    return F.collate(F.col(c), "UNICODE")


def members(groups: DataFrame, group_id: str, ids: str, findings: DataFrame, by: str, id: str) -> DataFrame:
    """(group, finding) by the group's list of finding ids."""
    return groups.select(by, group_id, F.explode(ids).alias(id)).join(findings, [by, id])


def ungrouped(findings: DataFrame, groups: DataFrame, by: str, id: str, ids: str) -> DataFrame:
    return findings.join(groups.select(by, F.explode(ids).alias(id)).distinct(), [by, id], "left_anti")


def group_by_mapping(findings: DataFrame, mapping: DataFrame, on: list[str], by: str) -> DataFrame:
    """A finding may be in several groups: per (bundle, group) its members, count and severity."""
    j = findings.join(F.broadcast(mapping), on)
    return j.groupBy(by, "group_id").agg(F.count("*").alias("findings"), severity_of(F.min(severity_rank(F.col("severity")))).alias("severity"))


def merged_evidence(rows: DataFrame, by: list[str], order: list[str], most: int = 8) -> DataFrame:
    """Of each finding `title: n matches` if it has several, then its evidence, or `title: path`
    without one; distinct in order, the first `most`."""
    own = F.when(F.size("evidence") > 0, F.col("evidence")).when(F.col("path").isNotNull(), F.array(F.concat("title", F.lit(": "), "path"))).otherwise(F.array().cast("array<string>"))
    head = F.when(F.col("count") > 1, F.array(F.concat("title", F.lit(": "), F.col("count").cast("string"), F.lit(" matches")))).otherwise(F.array().cast("array<string>"))
    r = rows.select(*by, *order, F.concat(head, own).alias("__e"))
    sorted_ = F.array_sort(F.collect_list(F.struct(*order, "__e")))
    return r.groupBy(*by).agg(sorted_.alias("__s")).select(*by, F.slice(F.array_distinct(F.flatten("__s.__e")), 1, most).alias("evidence"))


def affected(label: Column, n: Column) -> Column:
    """`label: n`, null without a number."""
    return F.when(n.isNotNull() & ~F.isnan(n.cast("double")), F.concat(label, F.lit(": "), n.cast("string")))


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
