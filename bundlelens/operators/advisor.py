"""The context handed to an advisor: a compacted report, its fingerprint and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundlelens.functions.text import severity_rank, truncate

#: How much of a report the context takes.
GROUPS, FINDINGS, WORKLOADS, CHARS, KEY_ERRORS, MOST_JSON = 8, 10, 8, 900, 16, 30_000


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of the JSON with its keys sorted."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def _top(rows: DataFrame, name: str, cols: list[Column], order: list[Column], most: int) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("bundle_id").orderBy(*order))
    r = rows.withColumn("__k", place).where(F.col("__k") <= most)
    return r.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", F.struct(*cols).alias("v")))), lambda x: x["v"]).alias(name))


def advisor_context(bundles: DataFrame, groups: DataFrame, findings: DataFrame, workloads: DataFrame, errors: DataFrame) -> DataFrame:
    """bundle_id, context (JSON), fingerprint. groups, ungrouped findings, workloads and errors
    (bundle_id, seq, line) are cut to what fits; a JSON over the limit loses workloads and errors,
    then the findings."""
    short = lambda c: truncate(F.col(c), CHARS).alias(c)
    g = _top(groups, "groups", [F.col("group_id"), F.col("severity"), short("title"), F.slice("evidence", 1, 8).alias("evidence")], [severity_rank(F.col("severity")), F.col("group_id")], GROUPS)
    f = _top(findings, "findings", [F.col("id"), F.col("severity"), short("title"), short("description")], [severity_rank(F.col("severity")), F.col("id")], FINDINGS)
    w = _top(workloads, "workloads", [F.col("namespace"), F.col("name"), F.col("severity"), F.col("status")], [severity_rank(F.col("severity")), F.col("namespace"), F.col("name")], WORKLOADS)
    e = _top(errors, "errors", [truncate(F.col("line"), CHARS).alias("line")], [F.col("seq")], KEY_ERRORS)
    j = bundles.select("bundle_id", "product_type")
    for part in (g, f, w, e):
        j = j.join(part, "bundle_id", "left")
    full = F.to_json(F.struct("errors", "findings", "groups", "product_type", "workloads"))
    mid = F.to_json(F.struct("findings", "groups", "product_type"))
    low = F.to_json(F.struct("groups", "product_type"))
    context = F.when(F.length(full) <= MOST_JSON, full).when(F.length(mid) <= MOST_JSON, mid).otherwise(low)
    return j.select("bundle_id", context.alias("context")).withColumn("fingerprint", F.sha2(F.col("context"), 256))


def stale(advice: DataFrame, contexts: DataFrame, provider: str, model: str, prompt: str) -> DataFrame:
    """bundle_id of stored advice that is missing or no longer fits: another status than completed,
    provider, model, prompt version or context."""
    j = contexts.select("bundle_id", F.col("fingerprint").alias("now")).join(advice, "bundle_id", "left")
    fits = (F.col("status") == "completed") & (F.col("provider") == provider) & (F.col("model") == model) & (F.col("prompt_version") == prompt) & (F.col("fingerprint") == F.col("now"))
    return j.where(~F.coalesce(fits, F.lit(False))).select("bundle_id")
