"""The operators bound to the driver's tables: documents are files and log bodies, events are
cluster events, orders and lineitem resources and containers, pages and documents KB pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bundlelens.functions import text as T
from bundlelens.operators import files, findings, kb, rules, search
from bundlelens.session import spread, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Log rules for the documents: (id, severity, category, title, description, regex, flags).
LOG_RULES = [dict(zip(("id", "severity", "category", "title", "description", "regex", "flags"), r, strict=True)) for r in (
    ("secret-assigned", "critical", "Secrets", "A secret is assigned", "A password or token is written out.", r"(password|token) ?= ?", "i"),
    ("mail-address", "warning", "Personal data", "Mail addresses", "A line holds a mail address.", r"[a-z0-9.]+@mail[0-9]+\.example\.com", "i"),
    ("phone-number", "warning", "Personal data", "Phone numbers", "A line holds a phone number.", r"\+1 \([0-9]{3}\) 555-[0-9]{4}", ""),
    ("long-number", "info", "Personal data", "Card-like numbers", "A line holds sixteen digits.", r"(^|[^0-9])[0-9]{16}($|[^0-9])", ""),
    ("boilerplate", "info", "Text", "Boilerplate", "A line of the usual boilerplate.", r"^the and attion to thanedble", "i"),
)]
CONDITION_RULES = [
    {"id": "order-{slug}-urgent", "resource": "order", "severity": "warning", "category": "Order", "title": "Order {key} is {priority}", "description": "{status} of {key}", "when": "priority in 1-URGENT|2-HIGH; status != F", "evidence": "Status=status,Priority=priority,Missing=none", "severityOverrides": "status=P:critical"},
    {"id": "order-{slug}-late", "resource": "order", "severity": "info", "category": "Order", "title": "Order {key} is open", "description": "", "when": "status == O; priority matches low|not; key notEmpty", "evidence": "Priority=priority"},
    {"id": "order-{slug}-any", "resource": "order", "severity": "info", "category": "Rest", "title": "{key}", "description": "", "when": "status notIn F|O; key exists", "evidence": ""},
]
PRODUCTS = ("thion", "ouoi")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("severity", F.when(F.col("value") >= 90, "critical").when(F.col("value") >= 50, "warning").otherwise("info"))


_SEVERITY = "CASE WHEN value >= 90 THEN 'critical' WHEN value >= 50 THEN 'warning' ELSE 'info' END"
_RANK = f"CASE {_SEVERITY} WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"


def file_index_summary(spark, sf):
    d = table(spark, sf, "documents").select("source", F.lit("file").alias("type"), "n_chars")
    return files.index_summary(d, "source", "type", "n_chars")


def top_level_entries(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.concat_ws("/", "source", "doc_id").alias("path"))
    return files.top_level_entries(d, "lang", "path").select("lang", "entry", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"))


def largest_files(spark, sf):
    d = table(spark, sf, "documents").select("source", F.format_string("%012d", "doc_id").alias("path"), "n_chars")
    return files.largest_files(d, "source", "path", "n_chars").select("source", F.col("path").cast("long").alias("doc_id"), "n_chars", F.col("place").cast("long").alias("place"))


def directory_tree(spark, sf):
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path"), F.length("html").cast("long").alias("size"))
    return files.directory_tree(p, [], "path", "size").select("directory", F.col("files").cast("long").alias("files"), "total_bytes")


def bundle_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return files.new_bundles(d, None, "sha256", ["doc_id"])


def bundle_duplicates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return files.duplicates(d, "sha256", "doc_id").select("doc_id", "first")


def _log_lines(spark, sf):
    return files.log_lines(table(spark, sf, "documents"), ["source", "doc_id"], "text")


def log_lines(spark, sf):
    return _log_lines(spark, sf).select("doc_id", "line_no", F.sha2(F.col("line").cast("binary"), 256).alias("line_sha256"))


def log_rule_matches(spark, sf):
    return rules.log_matches(_log_lines(spark, sf), "line", LOG_RULES).select("doc_id", "line_no", "rule_id")


def log_rule_findings(spark, sf):
    lines = _log_lines(spark, sf).withColumn("path", F.format_string("%012d", "doc_id"))
    out = rules.log_findings(lines, spark, LOG_RULES, "source", "path", "line_no", "line")
    return out.select("source", "id", "severity", "category", "title", "count", F.col("path").cast("long").alias("first_doc"), F.array_join("evidence", " | ").alias("evidence"))


def line_search(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("bundle"), F.lit("log").alias("path"), "turn", F.col("text").alias("line"))
    return search.first_hits(c, ["bundle"], "turn", "line", " Onth...", ignore_case=True).select(F.col("bundle").alias("conv_id"), "turn")


def line_window(spark, sf):
    lines = _log_lines(spark, sf)
    hits = search.first_hits(lines, ["doc_id"], "line_no", "line", r"\d{16}", regex=True)
    return search.line_windows(lines, hits, ["doc_id"], "line_no", "line", 2, 2, 5).select("doc_id", "line_no", F.length("line").cast("long").alias("chars"))


def _order_findings(spark, sf):
    o = table(spark, sf, "orders")
    facts = {"slug": T.slug(F.col("o_orderkey").cast("string")), "key": F.col("o_orderkey"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}
    return o.select("o_orderkey", rules.first_condition(CONDITION_RULES, "order", facts).alias("f")).where("f is not null")


def condition_findings(spark, sf):
    return _order_findings(spark, sf).select("o_orderkey", "f.id", "f.severity", "f.title", "f.description", F.array_join("f.evidence", "; ").alias("evidence"))


def first_rule_wins(spark, sf):
    return _order_findings(spark, sf).groupBy("f.category", "f.severity").agg(F.count("*").alias("n"))


def null_safe_predicate(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_acctbal > 5000")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    return j.where(rules.predicate("segment != BUILDING", {"segment": F.col("c_mktsegment")})).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def alert_filter(spark, sf):
    e = table(spark, sf, "events")
    page = F.get_json_object("props", "$.k")
    return e.where(page.isNotNull() & (page != "0")).select("event_id", page.alias("k"), F.when(F.col("event_type") == "error", "critical").when(F.col("event_type").isin("signup", "purchase"), "warning").otherwise("info").alias("severity"))


def restart_rollup(spark, sf):
    line = table(spark, sf, "lineitem")
    pods = line.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("restarts"))
    return pods.where("restarts > 0").groupBy(F.when(F.col("restarts") >= 5, "warning").otherwise("info").alias("severity")).agg(F.count("*").alias("pods"), F.sum("restarts").cast("long").alias("restarts"))


def event_warnings(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    few = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    n = e.groupBy("user_id").agg(F.count("*").alias("warnings"))
    first = e.withColumn("k", few).where("k <= 3").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("evidence"))
    return n.join(first, "user_id")


def node_health_rollup(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    bad = F.col("s_acctbal") < 0
    return j.groupBy("n_name").agg(F.countDistinct("s_suppkey").alias("total"), F.countDistinct(F.when(bad, F.col("s_suppkey"))).alias("problematic"))


def version_pick(spark, sf):
    p = table(spark, sf, "part")
    pick = F.min_by(F.struct("p_name", "p_type"), F.struct("p_size", "p_partkey"))
    return p.groupBy("p_brand").agg(pick.alias("v"), F.countDistinct("p_name", "p_type").alias("components")).select("p_brand", F.col("v.p_name").alias("component"), F.col("v.p_type").alias("version"), "components")


def chart_version_extract(spark, sf):
    p = table(spark, sf, "part")
    chart = F.concat(F.lower("p_brand"), F.lit("-"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(".3-rc1"))
    return p.select("p_partkey", T.chart_version(chart).alias("version"))


def slug_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"), T.truncate(F.col("text"), 40).alias("short"))


def workload_full_outer(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey", "c_name"), table(spark, sf, "orders")
    m = o.groupBy("o_custkey").agg(F.count("*").alias("migrations"), F.array_join(F.slice(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), 1, 3), ",").alias("evidence"))
    return c.join(m, c.c_custkey == m.o_custkey, "full_outer").select(F.coalesce("c_custkey", "o_custkey").alias("custkey"), "c_name", F.coalesce("migrations", F.lit(0)).alias("migrations"), "evidence")


def mention_join(spark, sf):
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return search.mentions(d, "doc_id", "text", b, "item_id", "text")


def correlation_topk(spark, sf):
    c, o, e = (table(spark, sf, t) for t in ("customer", "orders", "events"))
    o = o.groupBy("o_custkey").agg(F.count("*").alias("order_signals"))
    top = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    e = e.where("event_type = 'error'").withColumn("k", top)
    few = e.where("k <= 3").groupBy("user_id").agg(F.count("*").alias("event_signals"), F.max("value").alias("top_value"))
    j = c.join(o, c.c_custkey == o.o_custkey).join(few, c.c_custkey == few.user_id)
    return j.select("c_custkey", "order_signals", "event_signals", (F.col("order_signals") + F.col("event_signals")).alias("signal_count"), F.round("top_value", 4).alias("top_value"))


def severity_summary(spark, sf):
    return findings.severity_summary(_events(spark, sf), "event_type", "severity")


def highest_severity(spark, sf):
    return findings.highest_severity(_events(spark, sf), ["user_id"], "severity")


def finding_dedup(spark, sf):
    return findings.first_by_id(_events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "severity")


GROUPS = [("click", "interaction"), ("view", "interaction"), ("signup", "accounts"), ("purchase", "accounts"), ("purchase", "revenue"), ("error", "health")]


def finding_groups(spark, sf):
    m = spark.createDataFrame(GROUPS, "event_type string, group_id string")
    return findings.group_by_mapping(_events(spark, sf), m, ["event_type"], "user_id")


def merge_evidence(spark, sf):
    e = _events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("count"), F.min("event_id").alias("seq"))
    rows = e.select("user_id", "seq", F.col("event_type").alias("title"), "count", F.when(F.col("event_type") != "view", F.array(F.concat(F.lit("first "), F.col("seq").cast("string")))).otherwise(F.array().cast("array<string>")).alias("evidence"), F.concat(F.lit("/"), "event_type").alias("path"))
    out = findings.merged_evidence(rows, ["user_id"], ["seq"])
    return out.select("user_id", F.array_join("evidence", "; ").alias("evidence"))


def ungrouped_findings(spark, sf):
    d, g = table(spark, sf, "documents").select(F.lit("b").alias("bundle"), "doc_id", "source"), table(spark, sf, "labels").select(F.lit("b").alias("bundle"), F.array("doc_id").alias("ids"))
    return findings.ungrouped(d, g, "bundle", "doc_id", "ids").select("doc_id", "source")


def latest_job(spark, sf):
    from bundlelens.streaming.intake import latest

    return latest(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def retention(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.retention(F.col("o_orderdate").cast("timestamp")).cast("date").alias("retention_until"))


def kb_html_text(spark, sf):
    d = kb.documents(table(spark, sf, "pages"), "url", "html", F.lit("text/html"))
    return d.select("source_uri", "title", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"), F.length("body").cast("long").alias("chars"))


def kb_links(spark, sf):
    return kb.links(table(spark, sf, "pages"), "url", "html", "/")


def kb_quality(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit("t").alias("title"), F.col("text").alias("body"))
    q = kb.quality(d, F.when(F.length(F.trim("body")) >= 40, 1).otherwise(0))
    return q.groupBy("status").agg(F.count("*").alias("n"), F.count_if("importable").alias("importable"))


def kb_product(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.inferred_product(F.lit(None).cast("string"), F.col("text"), PRODUCTS).alias("product"))


def kb_chunks_fixed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(kb.windows_of(F.col("text"))).alias("chunk", "content"))
    return d.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))


def _kb_documents(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return d.select(F.format_string("kb_%012d", "doc_id").alias("id"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source_uri"), T.plain_title(F.col("text")).alias("title"), F.when(F.col("lang") == "fr", "harvester").when(F.col("lang") == "de", "longhorn").otherwise("unknown").alias("product_type"), T.collapse_whitespace(F.col("text")).alias("body"))


def kb_chunks(spark, sf):
    c = kb.chunks(_kb_documents(spark, sf))
    return c.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("char_count").cast("long").alias("char_count"), F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))


def kb_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def kb_hash_embedding(spark, sf):
    v = kb.hash_vectors(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")
    return v.select("doc_id", F.posexplode("vector").alias("bucket", "x")).where("x <> 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), "x")


def cosine_topk(spark, sf):
    """The ten nearest others of every vector whose id is divisible by 20."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("part"), F.col("embedding").cast("array<double>").alias("vector"), F.lit("unknown").alias("product"))
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector", F.lit(None).cast("string").alias("product_type"))
    found = kb.best_matches(q, e, 11, -1.0, 4, 1.0, 0.0).where("query_id <> id")  # one of the eleven may be the query itself
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.select("query_id", F.col("id").alias("vec_id"), "score", place.cast("long").alias("place")).where("place <= 10")


def _asked(spark, sf):
    """The whole texts of the documents whose id is divisible by 20, as queries."""
    q = table(spark, sf, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("asked"), F.when(F.col("lang") == "fr", "harvester").when(F.col("lang") == "de", "longhorn").alias("product_type"))
    return q.withColumn("tokens", F.array_distinct(T.tokens(F.col("asked"))))


def keyword_overlap(spark, sf):
    """The ten documents that hold most of the words of each query."""
    d = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("part"), F.lower("text").alias("text"), F.lit("unknown").alias("product")))
    found = kb.best_matches(_asked(spark, sf), d, 10, 0.000001, 6, 0.0, 1.0)
    return found.select("query_id", F.col("id").alias("doc_id"), "score", F.col("place").cast("long").alias("place"))


def hybrid_search(spark, sf):
    d = _kb_documents(spark, sf).withColumn("content_type", F.lit("text/plain"))
    c = written(kb.embedded(kb.chunks(d)), "chunks")
    q = kb.with_vectors(_asked(spark, sf), F.col("asked"))
    return kb.hybrid_search(written(q, "asked"), c, d).select("query_id", F.col("place").cast("long").alias("place"), "id", "score", "excerpt", F.col("chunk_index").cast("long").alias("chunk_index"))


def _upserted(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("s"), (F.col("doc_id") % 701).cast("string")).alias("source_uri"), F.col("text").alias("body"), F.col("doc_id").alias("seq"))
    return kb.upsert(d.where("seq % 3 <> 0"), d.where("seq % 3 = 0"), "seq")


def kb_upsert(spark, sf):
    return _upserted(spark, sf).select("id", "source_uri", F.length("body").cast("long").alias("chars"))


def kb_delete(spark, sf):
    d, gone = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return kb.without(d, gone, "doc_id")


def context_fingerprint(spark, sf):
    from bundlelens.operators.advisor import fingerprint

    d = table(spark, sf, "documents")
    return d.select("doc_id", fingerprint({"source": F.col("source"), "lang": F.col("lang"), "chars": F.col("n_chars")}).alias("fingerprint"))


def stream_intake(spark, sf):
    from bundlelens.streaming.intake import intake_of_table

    return intake_of_table(table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256")), "sha256", "doc_id")


QUERIES = {f.__name__: f for f in (file_index_summary, top_level_entries, largest_files, directory_tree, bundle_dedup, bundle_duplicates, log_lines, log_rule_matches, log_rule_findings, line_search, line_window, condition_findings, first_rule_wins, null_safe_predicate, alert_filter, restart_rollup, event_warnings, node_health_rollup, version_pick, chart_version_extract, slug_truncate, workload_full_outer, mention_join, correlation_topk, severity_summary, highest_severity, finding_dedup, finding_groups, merge_evidence, ungrouped_findings, latest_job, retention, kb_html_text, kb_links, kb_quality, kb_product, kb_chunks_fixed, kb_chunks, kb_tokens, kb_hash_embedding, cosine_topk, keyword_overlap, hybrid_search, kb_upsert, kb_delete, context_fingerprint, stream_intake)}
