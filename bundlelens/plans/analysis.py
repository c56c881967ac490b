"""From archives to reports: the product registry, the analysis of a fleet, KB enrichment."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.functions import text as T
from bundlelens.operators import checks, correlate, defaults, files, findings, groups, kb, rules
from bundlelens.operators.groups import GROUPS as group_defaults
from bundlelens.session import written
from bundlelens.sources import bundles as source


@dataclass
class Tables:
    """What an analyzer sees of the bundles of its product."""

    spark: SparkSession
    files: DataFrame
    lines: DataFrame
    resources: DataFrame
    alerts: DataFrame


@dataclass
class Analyzer:
    id: str
    label: str
    rules: dict
    analyse: Callable[[Tables, dict], tuple[DataFrame, DataFrame]]
    capabilities: tuple[str, ...] = ("inventory", "findings", "groups")


ANALYZERS: dict[str, Analyzer] = {
    "longhorn": Analyzer("longhorn", "Storage", defaults.LONGHORN_RULES, lambda t, r: checks.longhorn(t.spark, t.resources, t.lines, t.alerts, r)),
    "harvester": Analyzer("harvester", "Virtualization", defaults.HARVESTER_RULES, lambda t, r: checks.harvester(t.spark, t.resources, t.lines, t.alerts, r), ("inventory", "findings", "groups", "correlations")),
}


def register(analyzer: Analyzer) -> None:
    ANALYZERS[analyzer.id] = analyzer


@dataclass
class Analysis:
    findings: DataFrame
    inventory: DataFrame
    groups: DataFrame
    workloads: DataFrame | None
    summary: DataFrame
    versions: DataFrame


def analyse(spark: SparkSession, registry: DataFrame, members: DataFrame, product: str, rule_set: dict | None = None) -> Analysis | None:
    """All bundles of a product in registry(bundle_id, product_type); None for a product without an
    analyzer. members: rows of sources.bundles.expand, best read from a written table."""
    a = ANALYZERS.get(product)
    if a is None:
        return None
    own = registry.where(F.col("product_type") == product).select("bundle_id")
    m = members.join(F.broadcast(own), "bundle_id", "left_semi")
    t = Tables(spark, source.bundle_files(m), written(source.log_lines(m), "lines"), written(source.resources(m), "resources"), written(source.alerts(m), "alerts"))
    r = rule_set or a.rules
    raw, inventory = a.analyse(t, r)
    found = written(findings.first_by_id(raw, ["bundle_id", "id"], ["seq"]), "findings")
    inventory = written(checks.complete_inventory(inventory, own, product), "inventory")
    grouped = groups.finding_groups(spark, found, inventory, product) if any(g.product == product for g in groups.GROUPS) else None
    work = None
    if "correlations" in a.capabilities:
        hits = rules.log_matches(t.lines.where(rules.in_log_scope(F.col("path"), r["logs"]["include"])), "line", r["logs"]["rules"]).select("bundle_id", F.col("rule_id").alias("id"), "path", "line_no", "line")
        work = correlate.correlations(found, t.resources, hits)
    picked = checks.picked_versions(checks.versions(t.resources, product), ["component", "version"] if product == "longhorn" else ["component", "version", "source"])
    return Analysis(found, inventory, written(grouped, "groups") if grouped is not None else None, written(work, "workloads") if work is not None else None, findings.severity_summary(found, "bundle_id", "severity", own), written(picked, "versions"))


def reports(registry: DataFrame, a: Analysis, index: DataFrame, shown: int = 5000) -> DataFrame:
    """One row a bundle: version, summary, findings and groups in report order (severity, then
    names in language order), workloads, file index and its summaries."""

    def in_order(rows, name, names, *cols):
        order = [findings.unicode_order(c) for c in names]
        placed = findings.in_report_order(rows, "bundle_id", "severity", [*order, *names])
        return placed.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", *cols))), lambda x: x.dropFields("place")).alias(name))

    f = in_order(a.findings, "findings", ["category", "title", "id"], "category", "title", "id", "severity", "description", "evidence", "count", "path")
    parts = [f]
    if a.groups is not None:
        parts.append(in_order(a.groups, "groups", ["title", "group_id"], "title", "group_id", "severity", "description", "impact", "affected", "checks", "evidence", "related_ids"))
    parts.append(a.versions.select("bundle_id", "version", F.col("source").alias("version_source"), F.col("path").alias("version_path"), "components"))
    i = a.inventory.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("area", "metric", "value"))).alias("inventory"))
    s = files.index_summary(index, "bundle_id", "type", "size", shown)
    top = files.top_level_entries(index, "bundle_id", "path").groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("place", "entry", "n"))).alias("top_level_entries"))
    big = files.largest_files(index.where("type = 'file'"), "bundle_id", "path", "size").groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("place", "path", "size"))).alias("largest_files"))
    out = registry.join(a.summary, "bundle_id")
    for part in (*parts, i, s, top, big):
        out = out.join(part, "bundle_id", "left")
    if a.workloads is not None:
        w = a.workloads.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("place", "namespace", "name", "severity", "status", "node_name", "signal_count", "related_ids", "evidence"))).alias("workloads"))
        out = out.join(w, "bundle_id", "left")
    return out


def backfilled(old: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that an old report lacks, from a fresh one of the same bundle."""
    b = fresh.select("bundle_id", *[F.col(c).alias(f"__{c}") for c in columns])
    j = old.join(b, "bundle_id", "left")
    for c in columns:
        j = j.withColumn(c, F.coalesce(c, f"__{c}") if c in old.columns else F.col(f"__{c}"))
    return j.drop(*[f"__{c}" for c in columns])


def without_bundles(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables without the rows of deleted bundles."""
    return [t.join(gone.select("bundle_id"), "bundle_id", "left_anti") for t in tables]


def kb_queries(spark: SparkSession, groups: DataFrame, found: DataFrame, registry: DataFrame, metadata: DataFrame | None = None, most: int = 6000, hints: dict[str, str] | None = None) -> DataFrame:
    """query_id (bundle/group), product_type and text of each finding group: hint (by group; by default what the group is
    and does, in its own words), product, version and issue, the group, up to four of its evidence, and its findings with two of theirs."""
    said = hints if hints is not None else {g.id: f"{g.product}: {g.title}. {g.impact}" for g in group_defaults}
    hints = F.broadcast(spark.createDataFrame(list(said.items()), "group_id string, hint string"))
    g = groups.join(registry.select("bundle_id", "product_type"), "bundle_id").join(hints, "group_id", "left")
    if metadata is not None:
        g = g.join(metadata, "bundle_id", "left").withColumns({"k8s": F.try_element_at("metadata", F.lit("kubernetesversion")), "issue": F.try_element_at("metadata", F.lit("issuedescription"))})
    else:
        g = g.withColumns({"k8s": F.lit(None).cast("string"), "issue": F.lit(None).cast("string")})
    text = F.concat(F.array("title", "description"), F.slice("evidence", 1, 2))
    related = g.select("bundle_id", "group_id", F.explode("related_ids").alias("id")).join(found.select("bundle_id", "id", F.array_compact(text).alias("said")), ["bundle_id", "id"])
    said = related.groupBy("bundle_id", "group_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "said"))), lambda x: x["said"])).alias("said"))
    g = g.join(said, ["bundle_id", "group_id"], "left")
    lines = F.concat(F.array("hint", "product_type", "k8s", "issue", "title"), F.slice("evidence", 1, 4), F.coalesce("said", F.array().cast("array<string>")))
    whole = F.array_join(F.filter(lines, lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
    return g.select(F.concat_ws("/", "bundle_id", "group_id").alias("query_id"), "bundle_id", "group_id", "product_type", F.substring(whole, 1, most).alias("text"))


def enriched(spark: SparkSession, queries: DataFrame, chunks: DataFrame, docs: DataFrame, dimensions: int = 256, limit: int = 3, least: float = 0.08) -> DataFrame:
    """bundle_id, group_id, related_kb: the best documents of each group, all groups in one search."""
    q = written(kb.with_vectors(queries, F.col("text"), dimensions).withColumn("tokens", F.array_distinct(T.tokens(F.col("text")))), "asked")
    hits = kb.hybrid_search(q, chunks, docs, limit, least)
    per = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "title", "source_uri", "score", "excerpt"))).alias("related_kb"))
    return queries.select("query_id", "bundle_id", "group_id").join(per, "query_id", "left").drop("query_id")


def with_kb_summary(reports: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Reports with kb_summary: whether there is a knowledge base, its documents, chunks and last update."""
    s = kb.stats(docs, chunks).first()  # one row
    return reports.withColumn("kb_summary", F.struct(F.lit(s.chunk_count > 0).alias("enabled"), F.lit(s.document_count).cast("long").alias("document_count"), F.lit(s.chunk_count).cast("long").alias("chunk_count"), F.lit(s.updated_at).cast("timestamp").alias("updated_at")))
