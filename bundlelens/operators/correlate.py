"""Affected workloads: machines, instances and migrations joined, then matched with images,
networks, events and log lines. Names in texts are found by an automaton of all names, one scan of
the texts; every match is then an equi-join on the bundle and a name or key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bundlelens.functions import text as T
from bundlelens.operators import checks, search
from bundlelens.session import written

LOG_FINDINGS = ("harvester-log-virtualization-scheduling", "harvester-log-error-lines", "harvester-log-webhook-errors", "harvester-log-network-offload")
KEY = ["bundle_id", "ns", "name"]
#: Keys that name an image anywhere in a machine.
IMAGE_KEYS = r'"(?:imageName|imageID|imageId|virtualMachineImageName)":\s*"([^"]+)"'


def _found(section: str, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(section, F.lit(pattern), 1))


def workloads(v: DataFrame, i: DataFrame, m: DataFrame) -> DataFrame:
    """Machine, instance and migrations of each (bundle, namespace, name), any of them missing."""
    ns = T.namespace_of(F.col("namespace"), F.col("path"))
    selector = F.array_distinct(F.concat(_found("spec", r'"(?:kubernetes\.io/hostname|nodeName)":\s*"([^"]+)"')))
    full = _found("spec", r'"networkName":\s*"([^"]+)"')
    nets = F.array_union(full, F.transform(full, lambda x: F.element_at(F.split(x, "/"), -1)))
    vm = v.select("bundle_id", ns.alias("ns"), "name", F.struct("path", "issue", "line", "shown", checks.field("status", "nodeName").alias("node"), selector.alias("desired_nodes"), nets.alias("networks"), _found("text", IMAGE_KEYS).alias("images"), F.lower("text").alias("text")).alias("vm")).dropDuplicates(KEY)
    vmi = i.select("bundle_id", ns.alias("ns"), "name", F.struct("path", "issue", "line", "phase", checks.field("status", "nodeName").alias("node")).alias("vmi")).dropDuplicates(KEY)
    mig = m.where("vmi is not null").select("bundle_id", ns.alias("ns"), F.col("vmi").alias("vmi_name"), F.struct("path", "item_no", "name", "issue", "phase", "source", "target").alias("m"))
    mig = mig.groupBy("bundle_id", "ns", F.col("vmi_name").alias("name")).agg(F.array_sort(F.collect_list("m")).alias("migrations"))
    return vm.join(vmi, KEY, "full_outer").join(mig, KEY, "full_outer").withColumn("migrations", F.coalesce("migrations", F.array().cast(mig.schema["migrations"].dataType)))


def node_names(w: DataFrame) -> Column:
    return F.array_distinct(F.array_compact(F.concat(F.array("vm.node", "vmi.node"), F.coalesce("vm.desired_nodes", F.array().cast("array<string>")), F.transform("migrations", lambda m: m["source"]), F.transform("migrations", lambda m: m["target"]))))


def image_matches(w: DataFrame, images: DataFrame) -> DataFrame:
    """(workload, image): same bundle and namespace (an image without one fits all), and a name of
    the image in the machine's text, of which its list of images is a part."""
    names = F.array_distinct(F.transform(F.array_compact(F.array("name", "display")), F.lower))
    i = images.select("bundle_id", T.blank_to_null(F.col("namespace")).alias("ins"), F.struct("path", "item_no", "display", "name", "issue").alias("image"), F.explode(names).alias("named"))
    i = written(i, "images")
    a = search.naming(w.where("vm is not null").select(*KEY, F.col("vm.text").alias("text")), F.col("text"), i, "named").drop("text")
    j = a.join(i, ["bundle_id", "named"]).where("ins is null or ins = ns")
    return j.select(*KEY, "image").distinct()


def network_matches(w: DataFrame, vlans: DataFrame) -> DataFrame:
    """(workload, network) by a shared network name or node: both kinds of keys, one equi-join."""
    n = vlans.select("bundle_id", F.struct("path", "item_no", F.coalesce("network", "name").alias("label"), "issue").alias("net"), F.array_distinct(F.transform(F.array_compact(F.array("name", "network", checks.field("status", "vlanConfig"))), F.lower)).alias("names"), F.lower("node").alias("node"))
    keys = F.flatten(F.transform("names", lambda x: F.array(x, F.element_at(F.split(x, "/"), -1))))
    right = n.select("bundle_id", "net", F.explode(F.array_distinct(F.transform(keys, lambda k: F.concat(F.lit("n:"), k)))).alias("key")).unionByName(n.where("node is not null").select("bundle_id", "net", F.concat(F.lit("h:"), "node").alias("key")))
    names = F.transform(F.coalesce("vm.networks", F.array().cast("array<string>")), lambda x: F.concat(F.lit("n:"), F.lower(x)))
    left = w.select(*KEY, F.explode(F.array_distinct(F.concat(names, F.transform(node_names(w), lambda x: F.concat(F.lit("h:"), F.lower(x)))))).alias("key"))
    return left.join(right, ["bundle_id", "key"]).select(*KEY, "net").distinct()


def warning_events(resources: DataFrame) -> DataFrame:
    """bundle_id, ns, kind, involved, reason, message, path, item_no of warning events."""
    e = resources.where(F.col("path").rlike(r"/(v1|events\.k8s\.io/v1)/events\.yaml$") & F.col("error").isNull())
    e = checks.computed(e, type=checks.scalar("text", "type")).where("type = 'Warning'")
    refs = [F.when(F.get_json_object("text", f"$.{r}.name").isNotNull(), F.struct(F.get_json_object("text", f"$.{r}.kind").alias("kind"), F.get_json_object("text", f"$.{r}.name").alias("name"), F.get_json_object("text", f"$.{r}.namespace").alias("ns"))) for r in ("involvedObject", "regarding", "related")]
    e = checks.computed(e, ref=F.coalesce(*refs)).where("ref is not null")
    return e.select("bundle_id", F.coalesce(T.blank_to_null(F.col("ref.ns")), T.namespace_of(F.col("namespace"), F.col("path"))).alias("ns"), "ref.kind", F.col("ref.name").alias("involved"), F.coalesce(checks.field("text", "reason"), F.lit("Warning")).alias("reason"), F.coalesce(checks.field("text", "message"), checks.field("text", "note"), F.lit("Warning event")).alias("message"), "path", "item_no")


def _says(text: Column, name: Column, whole_words: bool) -> Column:
    """A name in a text; by default vm-a also hits vm-ab."""
    return text.contains(F.lower(name)) if not whole_words else F.regexp_instr(text, F.concat(F.lit(r"(?<![\w-])\Q"), F.lower(name), F.lit(r"\E(?![\w-])"))) > 0


def _aliases(w: DataFrame) -> DataFrame:
    """The names that stand for a workload: its own and those of its migrations."""
    names = F.array_distinct(F.array_compact(F.concat(F.array("name"), F.transform("migrations", lambda m: m["name"]))))
    return w.select(*KEY, F.explode(names).alias("called"))


def event_matches(w: DataFrame, events: DataFrame, whole_words: bool = False) -> DataFrame:
    """(workload, event) of the same namespace: the event is about one of its names, or says it."""
    names = written(_aliases(w).withColumn("low", F.lower("called")), "aliases")
    e = written(events.select("bundle_id", "ns", "involved", F.struct("path", "item_no", "reason", "message").alias("event")), "events")
    about = e.join(names, [e.bundle_id == names.bundle_id, e.ns == names.ns, e.involved == names.called]).select(*[names[c] for c in KEY], "event")
    text = F.lower(F.concat_ws(" ", "event.reason", "event.message"))
    said = search.naming(e, text, names, "low").withColumnRenamed("named", "low").join(names, ["bundle_id", "ns", "low"])
    said = said.where(_says(text, F.col("called"), True)) if whole_words else said
    return about.unionByName(said.select(*KEY, "event")).distinct()


def log_matches(w: DataFrame, lines: DataFrame, whole_words: bool = False) -> DataFrame:
    """(workload, hit) of all hits(bundle_id, id, path, line_no, line) of the four log rules."""
    names = written(w.select(*KEY, F.lower("name").alias("low")).where("low is not null"), "names")
    h = lines.where(F.col("id").isin(*LOG_FINDINGS)).select("bundle_id", F.struct("id", "path", "line_no", "line").alias("hit"))
    said = search.naming(h, F.lower("hit.line"), names, "low").withColumnRenamed("named", "low").join(names, ["bundle_id", "low"])
    said = said.where(_says(F.lower("hit.line"), F.col("name"), True)) if whole_words else said
    return said.select(*KEY, "hit")


def _few(rows: DataFrame, value: str, most: int | None = 3) -> DataFrame:
    """Per workload the first `most` values in order, and how many there are. Rows are found once for both."""
    rows = written(rows, value)
    k = F.row_number().over(Window.partitionBy(*KEY).orderBy(value))
    n = rows.groupBy(*KEY).agg(F.count("*").alias(f"{value}_total"))
    r = rows if most is None else rows.withColumn("k", k).where(F.col("k") <= most)
    return r.groupBy(*KEY).agg(F.array_sort(F.collect_list(value)).alias(f"{value}s")).join(n, KEY)


def correlations(found: DataFrame, resources: DataFrame, log_hits: DataFrame, most: int = 12) -> DataFrame:
    """workload_correlations: workloads that share at least one finding, the `most` of a bundle.

    found(bundle_id, id, severity). event_count, log_count and signal_count count the three
    first of each kind, as they drive the order; *_total count all.
    """
    v, i, m = checks.machines(resources)
    w = written(workloads(v, i, m), "workloads")
    for rows, value, cut in ((image_matches(w, checks.images(resources)), "image", None), (network_matches(w, checks.vlan_statuses(resources)), "net", None), (event_matches(w, warning_events(resources)), "event", 3), (log_matches(w, log_hits), "hit", 3)):
        few = _few(rows, value, cut)
        w = w.join(few, KEY, "left").withColumn(f"{value}s", F.coalesce(f"{value}s", F.array().cast(few.schema[f"{value}s"].dataType))).withColumn(f"{value}_total", F.coalesce(f"{value}_total", F.lit(0)))
    failed = F.filter("migrations", lambda x: x["issue"])
    bad_images, bad_nets = F.filter("images", lambda x: x["issue"]), F.filter("nets", lambda x: x["issue"])
    w = w.withColumns({"failed": failed, "bad_images": bad_images, "bad_nets": bad_nets, "vm_issue": F.coalesce("vm.issue", F.lit(False)), "vmi_issue": F.coalesce("vmi.issue", F.lit(False))})
    w = written(w, "matched")
    ids = F.array_distinct(F.concat(F.array_compact(F.array(
        F.when(F.col("vm_issue"), "harvester-vms-not-ready"), F.when(F.col("vmi_issue"), "harvester-vmis-not-running"), F.when(F.size("failed") > 0, "harvester-vm-migrations-failed"),
        F.when(F.size("bad_images") > 0, "harvester-vm-images-not-imported"), F.when(F.size("bad_nets") > 0, "harvester-vlan-status-not-ready"), F.when(F.size("events") > 0, "harvester-warning-events"),
    )), F.transform("hits", lambda h: h["id"])))
    w = w.withColumn("related_ids", ids)
    there = w.select(*KEY, F.explode("related_ids").alias("id")).join(found.select("bundle_id", "id", "severity").dropDuplicates(["bundle_id", "id"]), ["bundle_id", "id"])
    level = there.groupBy(*KEY).agg(T.severity_of(F.min(T.severity_rank(F.col("severity")))).alias("severity"))
    first = lambda c: F.get(F.col(c), F.lit(0))
    source = F.get(F.filter(F.transform("migrations", lambda x: x["source"]), lambda x: x.isNotNull()), F.lit(0))
    signal = F.col("vm_issue").cast("int") + F.col("vmi_issue").cast("int") + F.size("failed") + F.size("bad_images") + F.size("bad_nets") + F.size("events") + F.size("hits")
    paths = F.map_filter(F.create_map(F.lit("vm"), F.col("vm.path"), F.lit("vmi"), F.col("vmi.path"), F.lit("migration"), F.coalesce(first("failed")["path"], first("migrations")["path"]), F.lit("image"), F.coalesce(first("bad_images")["path"], first("images")["path"]), F.lit("network"), F.coalesce(first("bad_nets")["path"], first("nets")["path"])), lambda k, x: x.isNotNull())
    label = checks.labelled
    evidence = F.array_compact(F.array(
        F.when(F.col("vm_issue"), label("VM: ", F.col("vm.line"))), F.when(F.col("vmi_issue"), label("VMI: ", F.col("vmi.line"))), F.when(F.size("failed") > 0, label("Migration: ", F.coalesce(first("failed")["phase"], F.lit("failed")))),
        label("Image: ", first("bad_images")["display"]), label("Network: ", first("bad_nets")["label"]),
        F.concat(F.lit("Event: "), first("events")["reason"], F.lit(" "), T.truncate(first("events")["message"], 120)), label("Log: ", T.truncate(F.trim(first("hits")["line"]), 120)),
    ))
    out = w.join(level, KEY).select(
        "bundle_id", F.lit("VirtualMachine").alias("kind"), F.col("ns").alias("namespace"), "name", "severity",
        F.coalesce("vm.shown", label("VMI ", F.col("vmi.phase"))).alias("status"), F.col("vmi.phase").alias("vmi_phase"), F.coalesce("vmi.node", "vm.node", source).alias("node_name"),
        F.coalesce("vm.desired_nodes", F.array().cast("array<string>")).alias("desired_node_names"), F.array_distinct(F.transform("images", lambda x: F.coalesce(x["display"], x["name"]))).alias("image_names"),
        F.array_distinct(F.concat(F.coalesce("vm.networks", F.array().cast("array<string>")), F.transform("nets", lambda x: x["label"]))).alias("network_names"),
        F.slice(F.transform(F.filter("migrations", lambda x: x["issue"] | x["phase"].isNotNull()), lambda x: F.struct(x["name"].alias("name"), x["phase"].alias("phase"), x["source"].alias("source_node"), x["target"].alias("target_node"))), 1, 3).alias("migrations"),
        F.size("events").alias("event_count"), F.size("hits").alias("log_count"), signal.alias("signal_count"), F.col("event_total"), F.col("hit_total").alias("log_total"), "related_ids", paths.alias("paths"), evidence.alias("evidence"),
    )
    place = F.row_number().over(Window.partitionBy("bundle_id").orderBy(T.severity_rank(F.col("severity")), F.desc("signal_count"), "name", "namespace"))
    return out.withColumn("place", place).where(F.col("place") <= most)


__all__ = ["correlations", "event_matches", "image_matches", "log_matches", "network_matches", "warning_events", "workloads"]
