"""Health checks of all bundles at once: each gives findings and inventory counters in long form.

Findings are not cut here; a report view cuts them. Counters come from all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bundlelens.functions import text as T
from bundlelens.operators import defaults, rules
from bundlelens.operators.findings import union_all
from bundlelens.session import written

LH, HV = "yamls/namespaced/longhorn-system", "yamls/namespaced/harvester-system"
#: States of machines.
PROBLEM = "(?i)unschedulable|error|failed|crashloop|imagepull|pvcnotfound|datavolume|waitingforvolumebinding|waitingforreceiver"
CRITICAL_VM, CRITICAL_VMI = "(?i)Unschedulable|Error|Failed|CrashLoop|PvcNotFound|DataVolume", "(?i)Failed|CrashLoop|Unschedulable|Error"
ACCEPTED = "(?i)^(running|starting|migrating|provisioning)$"
PRESSURES = ("MemoryPressure", "DiskPressure", "PIDPressure", "NetworkUnavailable")


def field(section: str, name: str) -> Column:
    """A scalar of a JSON section, null if blank or null."""
    v = F.get_json_object(section, f"$.{name}")
    return F.when((F.trim(v) != "") & (v != "null"), v)


def scalar(section: str, name: str) -> Column:
    """field() with one parse, for computed(), where no other expression shares it."""
    return F.get(F.filter(F.array(F.get_json_object(section, f"$.{name}")), lambda v: (F.trim(v) != "") & (v != "null")), F.lit(0))


def condition(kind: str, lower: bool = False) -> Column:
    """The first condition of a type, or null."""
    return F.get(F.filter("conditions", lambda c: (F.lower(c["type"]) if lower else c["type"]) == kind), F.lit(0))


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are worked out once a row: those of a plain projection are put into each expression that
    reads them, and a JSON field is parsed anew in each place."""
    return rows.select(*[c for c in rows.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def of_first_file(resources: DataFrame, suffix: str) -> DataFrame:
    """Items of each bundle's first file by path with the suffix."""
    r = resources.where(F.col("path").endswith(suffix) & F.col("error").isNull())
    first = r.select("bundle_id", "path").distinct().groupBy("bundle_id").agg(F.min("path").alias("path"))  # a minimum of strings sorts all its rows
    return r.join(first, ["bundle_id", "path"])


def of_first_files(resources: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """Items of each bundle's first file by path with each of the suffixes, `which` tells the suffix's name; one scan for all."""
    which = F.coalesce(*[F.when(F.col("path").endswith(x), F.lit(k)) for k, x in suffixes.items()])
    r = resources.where(F.col("error").isNull()).withColumn("which", which).where("which is not null")
    first = r.select("bundle_id", "which", "path").distinct().groupBy("bundle_id", "which").agg(F.min("path").alias("path"))
    return r.join(first, ["bundle_id", "which", "path"])


def of_all_files(resources: DataFrame, suffix: str, within: str = "") -> DataFrame:
    return resources.where(F.col("path").endswith(suffix) & F.col("path").contains(within) & F.col("error").isNull())


#: The counters of each product's inventory.
METRICS = {
    "longhorn": {
        "volumes": "total unhealthy", "replicas": "total notRunning", "nodes": "total problematic disks diskIssues nodesWithDiskIssues", "pods": "total notRunning withRestarts",
        "events": "total warnings", "collection": "errors", "logs": "scannedFiles matchedLines", "alerts": "total firing",
    },
    "harvester": {
        "nodes": "total notReady pressure ntpUnsynced withIssues", "pods": "total notRunning withRestarts", "apps": "total notDeployed", "addons": "total enabled withIssues",
        "virtualization": "total unavailable", "vmImages": "total withIssues", "workloads": "vms vmIssues vmsDesiredRunning vmsRunning vmsStopped vmis vmisNotRunning vmisRunning migrations migrationsFailed migrationsRunning",
        "networks": "total withIssues", "storage": "volumes unhealthyVolumes replicas replicasNotRunning nodes nodesWithDiskIssues diskIssues replicaSchedulingLogMatches", "events": "total warnings", "collection": "errors", "logs": "scannedFiles matchedLines",
    },
}


def complete_inventory(inventory: DataFrame, bundles: DataFrame, product: str) -> DataFrame:
    """bundle_id, area, metric, value, product: each counter of each of bundles(bundle_id), zero where nothing was counted."""
    names = F.array(*[F.struct(F.lit(a).alias("area"), F.lit(m).alias("metric")) for a, ms in METRICS.get(product, {}).items() for m in ms.split()])
    by = ["bundle_id", "area", "metric"]
    got = inventory.groupBy(*by).agg(F.sum("value").alias("value"))
    if product not in METRICS:
        return got.withColumn("product", F.lit(product))
    every = bundles.select("bundle_id").distinct().select("bundle_id", F.inline(names))
    return every.join(got, by, "full_outer").select(*by, F.coalesce("value", F.lit(0).cast("long")).alias("value"), F.lit(product).alias("product"))


def counters(rows: DataFrame, area: str, **metrics: Column) -> DataFrame:
    """bundle_id, area, metric, value."""
    agg = rows.groupBy("bundle_id").agg(*[c.cast("long").alias(m) for m, c in metrics.items()])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return agg.select("bundle_id", F.lit(area).alias("area"), F.inline(pairs))


def one(rows: DataFrame, id: Column, severity: Column, category: str, title: Column, evidence: list[Column], description: str = "") -> DataFrame:
    """A finding a row."""
    return rows.select("bundle_id", id.alias("id"), severity.alias("severity"), F.lit(category).alias("category"), title.alias("title"), F.lit(description).alias("description"), F.array_compact(F.array(*evidence)).alias("evidence"), F.lit(1).cast("long").alias("count"), "path", F.struct("path", "item_no", F.lit(0).alias("k")).alias("seq"))


def rollup(problems: DataFrame, id: str, severity: Column, category: str, title: str, shown: int = 8) -> DataFrame:
    """One finding a bundle of problems(bundle_id, path, item_no, line): the first lines in order."""
    k = F.row_number().over(Window.partitionBy("bundle_id").orderBy("path", "item_no"))
    few = problems.withColumn("k", k).where(F.col("k") <= shown).groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("evidence"))
    n = problems.groupBy("bundle_id").agg(F.count("*").alias("count"), severity.alias("severity"), F.min("path").alias("path"))
    return n.join(few, "bundle_id").select("bundle_id", F.lit(id).alias("id"), "severity", F.lit(category).alias("category"), F.lit(title).alias("title"), F.lit("").alias("description"), "evidence", "count", "path", F.struct("path", F.lit(0).alias("item_no"), F.lit(1).alias("k")).alias("seq"))


def labelled(label: str, c: Column) -> Column:
    return F.concat(F.lit(label), c.cast("string"))


def dotted(*parts: Column) -> Column:
    return F.concat_ws(" · ", *parts)


def facts(name: Column, c: Column) -> dict[str, Column]:
    useful = T.blank_to_null(c["reason"]).isNotNull() | (T.blank_to_null(c["message"]).isNotNull() & (c["message"] != "null")) | (c["type"] == "Multipathd")
    return {"name": name, "nameSlug": T.slug(name), "condition.type": c["type"], "condition.typeSlug": T.slug(c["type"]), "condition.status": c["status"], "condition.reason": c["reason"], "condition.message": c["message"], "condition.hasUsefulDetail": useful.cast("string")}


def condition_findings(rows: DataFrame, rule_list: list[dict], resource: str, disk: dict[str, Column] | None = None) -> DataFrame:
    """Findings of the first rule that holds of each condition; cond_type tells which it was."""
    e = rows.select("*", F.posexplode("conditions").alias("cond_no", "c"))
    first = rules.first_condition(rule_list, resource, facts(F.coalesce("name", F.lit("unknown")), F.col("c")) | (disk or {}))
    f = e.select("bundle_id", "path", "item_no", "cond_no", F.col("c.type").alias("cond_type"), F.inline(F.array_compact(F.array(first))))  # worked out once a condition
    return f.select("bundle_id", "id", "severity", "category", "title", "description", "evidence", F.lit(1).cast("long").alias("count"), "path", F.struct("path", "item_no", F.col("cond_no").alias("k")).alias("seq"), "cond_type", "item_no")


def disks(nodes: DataFrame) -> DataFrame:
    """A row for each disk of each node, with its own conditions."""
    kind = "map<string,struct<conditions:array<struct<type:string,status:string,reason:string,message:string>>,diskName:string,diskPath:string,storageAvailable:string,storageMaximum:string>>"
    d = nodes.select("bundle_id", "path", "item_no", "name", F.explode(F.from_json(F.get_json_object("status", "$.diskStatus"), kind)).alias("disk_id", "d"))
    return d.select("bundle_id", "path", "item_no", "name", "disk_id", F.coalesce("d.diskName", "disk_id").alias("disk_name"), F.col("d.diskPath").alias("disk_path"), F.col("d.storageAvailable").try_cast("double").alias("available"), F.col("d.storageMaximum").try_cast("double").alias("maximum"), F.filter("d.conditions", lambda c: c["type"].isNotNull()).alias("conditions"))


def restarted() -> Column:
    """(container, restarts) of a pod's containers that restarted, init containers first."""
    kind = "array<struct<name:string,restartCount:string>>"
    both = F.concat(*[F.coalesce(F.from_json(F.get_json_object("status", f"$.{s}"), kind), F.array().cast(kind)) for s in ("initContainerStatuses", "containerStatuses")])
    told = F.transform(both, lambda c: F.struct(F.coalesce(c["name"], F.lit("container")).alias("container"), F.coalesce(c["restartCount"].try_cast("long"), F.lit(0)).alias("restarts")))
    return F.filter(told, lambda c: c["restarts"] > 0)


def pods(resources: DataFrame, root: str, product: str, category: str, shown: int) -> tuple[DataFrame, DataFrame]:
    named = of_first_file(resources, f"{root}/v1/pods.yaml").withColumn("name", F.coalesce("name", F.lit("unknown pod")))
    p = computed(named, phase=scalar("status", "phase"))
    bad = p.where(F.col("phase").isNotNull() & ~F.col("phase").isin("Running", "Succeeded"))
    r = computed(named, restarted=restarted()).where("size(restarted) > 0")
    said = F.array_join(F.transform("restarted", lambda c: F.concat(c["container"], F.lit("="), c["restarts"].cast("string"))), ", ")
    r = r.select("bundle_id", "path", "item_no", F.concat("name", F.lit(": "), said).alias("line"), F.array_max("restarted.restarts").alias("most"))
    out = one(bad, F.concat(F.lit(f"{product}-pod-"), T.slug(F.col("name")), F.lit("-"), T.slug(F.col("phase"))), F.lit("warning"), category, F.concat(F.lit("Pod "), "name", F.lit(" is "), "phase"), [labelled("Phase: ", F.col("phase"))])
    out = out.unionByName(rollup(r, f"{product}-pods-with-container-restarts", F.when(F.max("most") >= 5, "warning").otherwise("info"), category, "Containers have restarted", shown))
    inv = counters(p, "pods", total=F.count("*"), notRunning=F.count_if(F.col("phase").isNotNull() & ~F.col("phase").isin("Running", "Succeeded"))).unionByName(counters(r, "pods", withRestarts=F.count("*")))
    return out, inv


def events(resources: DataFrame, suffix: str, product: str, first: bool) -> tuple[DataFrame, DataFrame]:
    e = of_first_file(resources, suffix) if first else resources.where(F.col("path").rlike(r"/(v1|events\.k8s\.io/v1)/events\.yaml$") & F.col("error").isNull())
    e = computed(e, type=scalar("text", "type"))
    reason, message = F.coalesce(scalar("text", "reason"), F.lit("Warning")), F.coalesce(scalar("text", "message"), scalar("text", "note"), F.lit("Warning event"))
    w = e.where("type = 'Warning'").withColumn("line", F.concat(reason, F.lit(": "), message))
    return rollup(w, f"{product}-warning-events", F.lit("warning"), "Kubernetes Events", "Warning events", 6), counters(e, "events", total=F.count("*"), warnings=F.count_if(F.col("type") == "Warning"))


def collection_errors(lines: DataFrame, product: str) -> tuple[DataFrame, DataFrame]:
    """One product counts lines with an error word, the other every line."""
    e = lines.where(F.col("path").endswith("bundleGenerationError.log"))
    if product == "longhorn":
        e = e.where(F.col("line").rlike(r"(?i)\b(failed|bug|error)\b"))
    e = e.select("bundle_id", "path", F.col("line_no").alias("item_no"), F.trim("line").alias("line"))
    return rollup(e, f"{product}-bundle-generation-errors", F.lit("warning"), "Bundle", "Collection was incomplete", 5 if product == "longhorn" else 6), counters(e, "collection", errors=F.count("*"))


def logs(lines: DataFrame, spark: SparkSession, rule_set: dict, evidence: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Findings of the log rules over each bundle's files in scope, at most maxFiles by priority."""
    scope = rule_set["logs"]
    inside = lines.where(rules.in_log_scope(F.col("path"), scope["include"]))
    prio = rules.log_priority(F.col("path"), scope["priorities"])
    names = inside.select("bundle_id", "path").distinct()
    k = F.row_number().over(Window.partitionBy("bundle_id").orderBy(prio, "path"))
    names = names.withColumn("k", k).where(F.col("k") <= scope["maxFiles"]).drop("k")
    inside = inside.join(names, ["bundle_id", "path"], "left_semi")
    f = rules.log_findings(inside, spark, scope["rules"], "bundle_id", "path", "line_no", "line", evidence, width, prio)
    inv = counters(names, "logs", scannedFiles=F.count("*")).unionByName(counters(f, "logs", matchedLines=F.sum("count")))
    return f.withColumn("seq", F.struct("path", F.lit(0).alias("item_no"), F.lit(2).alias("k"))), inv


def alert_findings(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = F.lower(F.col("labels")["severity"])
    level = F.when(s == "critical", "critical").when(s.isin("warning", "warn"), "warning").otherwise("info")
    a = alerts.where("valid").withColumns({"name": F.coalesce(F.col("labels")["alertname"], F.lit("alert")), "level": level, "item_no": F.col("seq")})
    firing = a.where((F.col("state") == "firing") & s.isNotNull() & (s != "none"))
    text = F.coalesce(F.col("annotations")["summary"], F.col("annotations")["message"], F.col("annotations")["description"])
    out = one(firing, F.concat(F.lit("longhorn-alert-"), T.slug(F.col("name"))), F.col("level"), "Monitoring", F.concat(F.lit("Alert firing: "), "name"), [text])
    bad = alerts.where("not valid").select("bundle_id", "path", F.lit(0).alias("item_no"), F.lit("not valid JSON").alias("line"))
    out = out.unionByName(rollup(bad, "longhorn-prometheus-alerts-invalid-json", F.lit("warning"), "Monitoring", "Alerts could not be read"))
    return out, counters(a, "alerts", total=F.count("*")).unionByName(counters(firing, "alerts", firing=F.count("*")))


def volume_findings(resources: DataFrame, cond: list[dict]) -> tuple[DataFrame, DataFrame]:
    named = of_first_file(resources, f"{LH}/longhorn.io/v1beta2/volumes.yaml").withColumn("name", F.coalesce("name", F.lit("unknown volume")))
    v = computed(named, state_of=scalar("status", "robustness"))
    bad_v = (F.col("state_of") != "healthy") & F.col("state_of").isNotNull()
    volumes = one(v.where(bad_v), F.concat(F.lit("longhorn-volume-"), T.slug(F.col("name")), F.lit("-"), T.slug(F.col("state_of"))), F.when(F.col("state_of") == "faulted", "critical").otherwise("warning"), "Longhorn Volume", F.concat(F.lit("Volume "), "name", F.lit(" is "), "state_of"), [labelled("Robustness: ", F.col("state_of")), labelled("State: ", scalar("status", "state")), labelled("Current node: ", scalar("status", "currentNodeID"))])
    found = volumes.unionByName(condition_findings(named, cond, "longhornVolumeCondition"), allowMissingColumns=True)
    return found, counters(v, "volumes", total=F.count("*"), unhealthy=F.count_if(bad_v))


def replica_findings(resources: DataFrame, cond: list[dict]) -> tuple[DataFrame, DataFrame]:
    named = of_first_file(resources, f"{LH}/longhorn.io/v1beta2/replicas.yaml").withColumn("name", F.coalesce("name", F.lit("unknown replica")))
    r = computed(named, state_of=scalar("status", "currentState"))
    bad = (F.col("state_of") != "running") & F.col("state_of").isNotNull()
    replicas = one(r.where(bad), F.concat(F.lit("longhorn-replica-"), T.slug(F.col("name")), F.lit("-"), T.slug(F.col("state_of"))), F.lit("warning"), "Longhorn Replica", F.concat(F.lit("Replica "), "name", F.lit(" is "), "state_of"), [labelled("State: ", F.col("state_of"))])
    found = replicas.unionByName(condition_findings(named, cond, "longhornReplicaCondition"), allowMissingColumns=True)
    return found, counters(r, "replicas", total=F.count("*"), notRunning=F.count_if(bad))


def storage_node_findings(resources: DataFrame, cond: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Conditions of nodes and of each of their disks."""
    n = of_first_file(resources, f"{LH}/longhorn.io/v1beta2/nodes.yaml")
    d = disks(n)
    disk = {"disk.name": F.col("disk_name"), "disk.nameSlug": T.slug(F.col("disk_name")), "disk.path": F.col("disk_path"), "disk.storageAvailable": F.col("available").cast("decimal(38,0)").cast("string"), "disk.storageMaximum": F.col("maximum").cast("decimal(38,0)").cast("string")}
    on_node, on_disk = condition_findings(n, cond, "longhornNodeCondition"), condition_findings(d, cond, "longhornNodeDiskCondition", disk)
    found = on_node.unionByName(on_disk)
    inv = union_all(counters(n, "nodes", total=F.count("*")), counters(d, "nodes", disks=F.count("*")), counters(found, "nodes", problematic=F.countDistinct("path", "item_no")), counters(on_disk, "nodes", diskIssues=F.count("*"), nodesWithDiskIssues=F.countDistinct("path", "item_no")))
    return found, inv


def longhorn(spark: SparkSession, resources: DataFrame, lines: DataFrame, alerts: DataFrame, rule_set: dict = defaults.LONGHORN_RULES) -> tuple[DataFrame, DataFrame]:
    """Findings and inventory of all storage checks."""
    cond = rule_set["conditions"]["rules"]
    volumes, on_volumes = volume_findings(resources, cond)
    replicas, on_replicas = replica_findings(resources, cond)
    nodes, on_nodes = storage_node_findings(resources, cond)
    parts, inv = [volumes, replicas, nodes], [on_volumes, on_replicas, on_nodes]
    for f, i in (pods(resources, LH, "longhorn", "Longhorn Pod", 6), events(resources, f"{LH}/v1/events.yaml", "longhorn", True), collection_errors(lines, "longhorn"), logs(lines, spark, rule_set, 4, 220), alert_findings(alerts)):
        parts.append(f)
        inv.append(i)
    return union_all(*parts), union_all(*inv).withColumn("product", F.lit("longhorn"))


def vm_columns(v: DataFrame) -> DataFrame:
    """desired, shown status, reason (null if there is no issue) of machines."""
    running, strategy = T.tri_state(field("spec", "running")), field("spec", "runStrategy")
    v = v.withColumns({"running": running, "strategy": strategy, "desired": F.coalesce(running, F.lower(strategy).isNotNull() & ~F.lower(strategy).isin("halted", "manual")), "shown": F.trim(F.coalesce(field("status", "printableStatus"), field("status", "phase"))), "created": T.tri_state(field("status", "created")), "ready": condition("Ready")["status"]})
    d = F.col("desired")
    reason = F.when(F.col("shown").rlike(PROBLEM), F.col("shown")).when(d & F.col("shown").isNotNull() & ~F.col("shown").rlike(ACCEPTED), F.concat(F.lit("desired running but status is "), "shown")).when(d & (F.col("created") == F.lit(False)), "desired running but VMI is not created").when(d & (condition("Ready").isNotNull()) & ~F.col("ready").eqNullSafe("True"), labelled("Ready=", F.coalesce("ready", F.lit("unknown"))))
    return v.withColumn("issue", reason)


def machines(resources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Machines, their instances and migrations, each with `issue` (boolean) and `line`."""
    where = "/kubevirt.io/"
    name = F.coalesce(T.display_name(F.col("namespace"), F.col("name")), F.lit("unknown"))
    v = vm_columns(of_all_files(resources, "/virtualmachines.yaml", where))
    v = v.withColumn("line", dotted(F.concat(name, F.lit(": "), "issue"), labelled("printableStatus=", F.col("shown")), labelled("runStrategy=", F.col("strategy")), labelled("running=", F.col("running")), labelled("Ready=", F.col("ready")), labelled("node=", field("status", "nodeName")))).withColumn("issue", F.col("issue").isNotNull())
    i = of_all_files(resources, "/virtualmachineinstances.yaml", where).withColumns({"phase": field("status", "phase"), "ready": condition("Ready")})
    fine = F.coalesce((F.col("phase") == "Running") & (F.col("ready").isNull() | (F.col("ready.status") == "True")), F.lit(False))
    i = i.withColumns({"issue": ~fine, "line": dotted(F.concat(name, F.lit(": phase="), F.coalesce("phase", F.lit("unknown"))), labelled("node=", field("status", "nodeName")), labelled("reason=", field("status", "reason")), labelled("Ready=", F.col("ready.status")), labelled("Synchronized=", condition("Synchronized")["status"]), labelled("message=", F.col("ready.message")))})
    m = of_all_files(resources, "/virtualmachineinstancemigrations.yaml", where)
    failed = F.get(F.filter("conditions", lambda c: (c["type"] == "Failed") & (c["status"] == "True")), F.lit(0))
    anywhere = lambda k: T.blank_to_null(F.regexp_extract("status", rf'"{k}":\s*"([^"]+)"', 1))
    m = computed(m, phase=scalar("status", "phase"), failed=failed, vmi=F.coalesce(scalar("spec", "vmiName"), anywhere("vmiName")), source=anywhere("sourceNode"), target=anywhere("targetNode"))
    m = m.withColumns({"issue": F.coalesce(F.col("phase").isin("Failed", "Scheduling"), F.lit(False)) | F.col("failed").isNotNull(), "line": dotted(F.concat(name, F.lit(": phase="), F.coalesce("phase", F.lit("unknown"))), labelled("vmi=", F.col("vmi")), labelled("source=", F.col("source")), labelled("target=", F.col("target")), labelled("reason=", F.col("failed.reason")), labelled("message=", F.col("failed.message")))})
    return v, i, m


def vlan_statuses(resources: DataFrame) -> DataFrame:
    s = of_all_files(resources, "network.harvesterhci.io/v1beta1/vlanstatuses.yaml").withColumns({"ready": condition("ready", True), "node": field("status", "node"), "network": field("status", "clusterNetwork")})
    return s.withColumns({"issue": ~F.coalesce(F.col("ready.status") == "True", F.lit(False)), "line": dotted(F.concat(F.coalesce("name", F.lit("unknown vlan status")), F.lit(": ready="), F.coalesce("ready.status", F.lit("unknown"))), labelled("node=", F.col("node")), labelled("clusterNetwork=", F.col("network")), labelled("vlanConfig=", field("status", "vlanConfig")), labelled("message=", F.col("ready.message")))})


def images(resources: DataFrame) -> DataFrame:
    i = of_all_files(resources, "harvesterhci.io/v1beta1/virtualmachineimages.yaml").withColumns({"failed": F.coalesce(field("status", "failed").try_cast("int"), F.lit(0)), "imported": condition("Imported")["status"], "limit": condition("RetryLimitExceeded")["status"], "display": F.coalesce(field("spec", "displayName"), "name", F.lit("unknown image"))})
    return i.withColumns({"issue": (F.col("failed") > 0) | ~F.coalesce(F.col("imported") == "True", F.lit(False)) | F.coalesce(F.col("limit") == "True", F.lit(False)), "line": dotted(F.concat("display", F.lit(": Imported="), F.coalesce("imported", F.lit("unknown"))), labelled("failed=", F.col("failed")), labelled("progress=", field("status", "progress")), labelled("sourceType=", field("spec", "sourceType")), F.when(F.col("limit") == "True", "RetryLimitExceeded=True"))})


def node_findings(resources: DataFrame, cond: list[dict]) -> tuple[DataFrame, DataFrame]:
    n = of_first_file(resources, "yamls/cluster/v1/nodes.yaml").withColumn("name", F.coalesce("name", F.lit("unknown node")))
    on_node = condition_findings(n, cond, "harvesterNodeCondition")
    ntp = n.withColumn("ntp", T.ntp_status(F.coalesce(F.get_json_object("metadata", "$.annotations['node.harvesterhci.io/ntp-service']"), F.get_json_object("metadata", "$.annotations['node.harvesterhci.io/ntp-sync-status']")))).where("ntp <> 'synced'")
    found = on_node.unionByName(one(ntp, F.concat(F.lit("harvester-node-"), T.slug(F.col("name")), F.lit("-ntp-"), T.slug(F.col("ntp"))), F.lit("warning"), "Harvester Node", F.concat(F.lit("Node "), "name", F.lit(" NTP is "), "ntp"), [labelled("NTP sync status: ", F.col("ntp"))]), allowMissingColumns=True)
    return found, union_all(counters(n, "nodes", total=F.count("*")), counters(on_node, "nodes", notReady=F.count_if(F.col("cond_type") == "Ready"), pressure=F.count_if(F.col("cond_type").isin(*PRESSURES))), counters(ntp, "nodes", ntpUnsynced=F.count("*")), counters(on_node.select("bundle_id", "path", "item_no").unionByName(ntp.select("bundle_id", "path", "item_no")), "nodes", withIssues=F.countDistinct("path", "item_no")))


def app_findings(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = of_first_file(resources, f"{HV}/catalog.cattle.io/v1/apps.yaml").withColumn("state", F.coalesce(field("status", "summary.state"), T.blank_to_null(F.regexp_extract("status", r'"state":\s*"([^"]+)"', 1))))
    bad = a.where(F.col("state") != "deployed").withColumn("line", F.concat(F.coalesce("name", F.lit("unknown app")), F.lit(": "), "state"))
    return rollup(bad, "harvester-apps-not-deployed", F.lit("warning"), "Harvester App", "Apps are not deployed"), counters(a, "apps", total=F.count("*"), notDeployed=F.count_if(F.col("state") != "deployed"))


def addon_findings(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    o = of_first_file(resources, f"{HV}/harvesterhci.io/v1beta1/addons.yaml").withColumns({"enabled": F.coalesce(T.tri_state(field("spec", "enabled")), F.lit(False)), "state": field("status", "status")})
    on = lambda t: F.exists("conditions", lambda c: (c["type"] == t) & (c["status"] == "True"))
    o = o.withColumn("issue", F.col("enabled") & (on("OperationFailed") | on("InProgress") | F.coalesce(F.col("state").rlike("(?i)failed"), F.lit(False))))
    bad = o.where("issue").withColumn("line", dotted(F.concat(F.coalesce("name", F.lit("unknown addon")), F.lit(": "), F.coalesce("state", F.lit("unknown status"))), F.when(on("OperationFailed"), "OperationFailed=True"), F.when(on("InProgress"), "InProgress=True")))
    return rollup(bad, "harvester-addons-not-ready", F.lit("warning"), "Harvester Addon", "Enabled add-ons are not ready"), counters(o, "addons", total=F.count("*"), enabled=F.count_if("enabled"), withIssues=F.count_if("issue"))


def stack_findings(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two services that run machines and import disks."""
    stack = []
    for key, label, suffix, versions in (("kubevirt", "KubeVirt", f"{HV}/kubevirt.io/v1/kubevirts.yaml", ("observedKubeVirtVersion", "operatorVersion")), ("cdi", "CDI", "yamls/cluster/cdi.kubevirt.io/v1beta1/cdis.yaml", ("operatorVersion",))):
        stack.append(of_first_file(resources, suffix).withColumns({"key": F.lit(key), "label": F.lit(label), "phase": field("status", "phase"), "version": F.coalesce(*[field("status", k) for k in versions]), "available": condition("Available")["status"], "degraded": condition("Degraded")["status"], "progressing": condition("Progressing")["status"], "has": condition("Available").isNotNull()}))
    s = union_all(*stack)
    issue = F.coalesce(F.col("phase") != "Deployed", F.lit(False)) | (F.col("has") & ~F.col("available").eqNullSafe("True")) | F.coalesce(F.col("degraded") == "True", F.lit(False)) | F.coalesce(F.col("progressing") == "True", F.lit(False))
    found = one(s.where(issue), F.concat(F.lit("harvester-"), "key", F.lit("-not-ready")), F.lit("warning"), "Virtualization", F.concat("label", F.lit(" is not fully ready")), [labelled("Phase: ", F.col("phase")), labelled("Available: ", F.col("available")), labelled("Degraded: ", F.col("degraded")), labelled("Progressing: ", F.col("progressing")), labelled("Version: ", F.col("version"))])
    return found, counters(s, "virtualization", total=F.count("*"), unavailable=F.count_if(issue))


def harvester(spark: SparkSession, resources: DataFrame, lines: DataFrame, alerts: DataFrame, rule_set: dict = defaults.HARVESTER_RULES, storage_rules: dict = defaults.LONGHORN_RULES) -> tuple[DataFrame, DataFrame]:
    """Findings and inventory of all checks of this product, the storage rollup included."""
    warning = F.lit("warning")
    parts, inv = [], []
    on_nodes, node_counters = node_findings(resources, rule_set["conditions"]["rules"])
    parts.append(on_nodes)
    inv.append(node_counters)
    for f, c in (app_findings(resources), addon_findings(resources), stack_findings(resources)):
        parts.append(f)
        inv.append(c)
    im = images(resources)
    parts.append(rollup(im.where("issue"), "harvester-vm-images-not-imported", warning, "Harvester Image", "Images are not fully imported"))
    inv += [counters(im, "vmImages", total=F.count("*"), withIssues=F.count_if("issue"))]
    v, i, m = machines(resources)
    of = lambda pattern: F.when(F.bool_or(F.col("line").rlike(pattern)), "critical").otherwise("warning")
    parts += [rollup(v.where("issue"), "harvester-vms-not-ready", of(CRITICAL_VM), "Harvester VM", "Machines are not ready"), rollup(i.where("issue"), "harvester-vmis-not-running", of(CRITICAL_VMI), "Harvester VM", "Machine instances are not running"), rollup(m.where("issue"), "harvester-vm-migrations-failed", warning, "Harvester VM", "Machine migrations failed")]
    inv += [
        counters(v, "workloads", vms=F.count("*"), vmIssues=F.count_if("issue"), vmsDesiredRunning=F.count_if("desired"), vmsRunning=F.count_if(F.col("shown").rlike("(?i)^running$")), vmsStopped=F.count_if(F.col("shown").rlike("(?i)^(stopped|stopping|halted)$"))),
        counters(i, "workloads", vmis=F.count("*"), vmisNotRunning=F.count_if("issue"), vmisRunning=F.count_if(~F.col("issue"))),
        counters(m, "workloads", migrations=F.count("*"), migrationsFailed=F.count_if("issue"), migrationsRunning=F.count_if(F.col("phase") == "Running")),
    ]
    w = vlan_statuses(resources)
    parts.append(rollup(w.where("issue"), "harvester-vlan-status-not-ready", warning, "Harvester Network", "VLAN statuses are not ready"))
    inv += [counters(w, "networks", total=F.count("*"), withIssues=F.count_if("issue"))]
    for f, c in (pods(resources, HV, "harvester", "Harvester Pod", 8), events(resources, "", "harvester", False), collection_errors(lines, "harvester"), logs(lines, spark, rule_set, 5, 240)):
        parts.append(f)
        inv.append(c)
    lf, li = longhorn(spark, resources, lines, alerts, storage_rules)
    lf, li = written(lf, "storage-findings"), written(li, "storage-inventory")
    parts.append(storage_rollup(lf, li))
    inv.append(storage_inventory(lf, li))
    return union_all(*parts), union_all(*inv).withColumn("product", F.lit("harvester"))


def storage_inventory(found: DataFrame, inv: DataFrame) -> DataFrame:
    names = {("volumes", "total"): "volumes", ("volumes", "unhealthy"): "unhealthyVolumes", ("replicas", "total"): "replicas", ("replicas", "notRunning"): "replicasNotRunning", ("nodes", "total"): "nodes", ("nodes", "nodesWithDiskIssues"): "nodesWithDiskIssues", ("nodes", "diskIssues"): "diskIssues"}
    name = F.coalesce(*[F.when((F.col("area") == a) & (F.col("metric") == m), n) for (a, m), n in names.items()])
    own = inv.select("bundle_id", F.lit("storage").alias("area"), name.alias("metric"), "value").where("metric is not null")
    log = found.where("id = 'longhorn-log-replica-scheduling-storage'").select("bundle_id", F.lit("storage").alias("area"), F.lit("replicaSchedulingLogMatches").alias("metric"), F.col("count").alias("value"))
    return own.unionByName(log)


def storage_rollup(found: DataFrame, inv: DataFrame) -> DataFrame:
    """Four findings from the storage counters and findings; the severity sees all findings, uncut."""
    totals = storage_inventory(found, inv).where("value > 0").select("bundle_id", "metric", "value")
    out = []
    for id, metric, category, title in (("harvester-longhorn-volumes-unhealthy", "unhealthyVolumes", "Longhorn Volume", "Volumes behind workloads are unhealthy"), ("harvester-longhorn-replicas-not-running", "replicasNotRunning", "Longhorn Replica", "Replicas are not running"), ("harvester-longhorn-node-disk-issues", "nodesWithDiskIssues", "Longhorn Node", "Node disks are not ready")):
        f = found.where(F.col("category") == category).select("bundle_id", "path", F.col("seq.item_no").alias("item_no"), "severity", F.concat("title", F.coalesce(F.concat(F.lit(": "), F.get("evidence", F.lit(0))), F.lit(""))).alias("line"))
        level = F.when(F.bool_or(F.col("severity") == "critical"), "critical").otherwise("warning") if metric != "replicasNotRunning" else F.lit("warning")
        r = rollup(f, id, level, "Harvester Storage", title).drop("count")
        out.append(r.join(totals.where(F.col("metric") == metric).select("bundle_id", F.col("value").alias("count")), "bundle_id"))
    refs = ["evidence_refs"] if "evidence_refs" in found.columns else []  # only log findings have them
    log = found.where("id = 'longhorn-log-replica-scheduling-storage'").select("bundle_id", F.lit("harvester-longhorn-replica-scheduling-storage").alias("id"), "severity", F.lit("Harvester Storage").alias("category"), F.lit("Replica scheduling lacks disks").alias("title"), "description", "evidence", *refs, "count", "path", "seq")
    return union_all(*out, log)


#: Images whose tags are versions, with the rank of each.
IMAGES = (("longhorn-manager", 4), ("longhorn-engine", 7), ("longhorn-ui", 8), ("longhorn-instance-manager", 9), ("longhorn-share-manager", 10), ("backing-image-manager", 11))


def versions(resources: DataFrame, product: str) -> DataFrame:
    """Candidates: bundle_id, version, component, source, priority, path, item_no."""
    c = lambda rows, version, component, source, priority: rows.select("bundle_id", version.alias("version"), component.alias("component"), F.lit(source).alias("source"), F.lit(priority).alias("priority"), "path", "item_no").where("version is not null")
    label = lambda k: F.get_json_object("metadata", f"$.labels['{k}']")
    lit = F.lit
    if product == "longhorn":
        kinds = {"settings": "longhorn.io/v1beta2/settings", "configs": "v1/configmaps", "deployments": "apps/v1/deployments", "engines": "longhorn.io/v1beta2/engineimages", "pods": "v1/pods"}
        rows = of_first_files(resources, {k: f"{LH}/{x}.yaml" for k, x in kinds.items()})
        of = lambda *which: F.col("which").isin(*which)
        said = lambda version, component, source, priority: F.struct(version.alias("version"), lit(component).alias("component"), lit(source).alias("source"), lit(priority).alias("priority"))
        named = of("configs", "deployments") & (label("app.kubernetes.io/name") == "longhorn")
        own = [
            said(F.when(of("settings") & (F.col("name") == "current-longhorn-version"), T.normal_version(F.col("value"))), "longhorn", "Longhorn setting", 0),
            said(F.when(named, T.normal_version(label("app.kubernetes.io/version"))), "longhorn", "Kubernetes app label", 1),
            said(F.when(named, T.chart_version(label("helm.sh/chart"))), "longhorn-chart", "Helm chart label", 2),
            said(F.when(of("deployments"), T.normal_version(F.get_json_object("metadata", "$.annotations['driver.longhorn.io/version']"))), "longhorn-driver", "Longhorn driver annotation", 3),
            said(F.when(of("engines"), T.normal_version(field("status", "version"))), "longhorn-engine", "EngineImage status", 6),
        ]
        tagged = lambda image, priority: F.transform(F.array_distinct(T.image_tags(F.col("text"), f"(?:longhornio/|mirrored-longhornio-){image}")), lambda tag: said(T.normal_version(tag), image, f"{image} image", priority))
        images = F.concat(*[tagged(image, priority) for image, priority in IMAGES])
        shown = of("deployments", "engines", "pods") & F.col("text").contains("longhornio")  # no tag without it
        none = F.array().cast("array<struct<version:string,component:string,source:string,priority:int>>")
        found = F.filter(F.concat(F.array(*own), F.when(shown, images).otherwise(none)), lambda x: x["version"].isNotNull())
        rows = computed(rows.select("bundle_id", "path", "item_no", "which", "name", "value", "metadata", "status", "text"), found=found)
        return rows.select("bundle_id", "path", "item_no", F.inline("found")).select("bundle_id", "version", "component", "source", "priority", "path", "item_no")
    apps, pods_, addons, available = (of_first_file(resources, f"{HV}/{x}.yaml") for x in ("catalog.cattle.io/v1/apps", "v1/pods", "harvesterhci.io/v1beta1/addons", "harvesterhci.io/v1beta1/versions"))
    chart = T.blank_to_null(F.regexp_extract("status", r'"chart":.*?"version":\s*"([^"]+)"', 1))
    own = pods_.where(F.col("text").contains("rancher/harvester:") | (label("app.kubernetes.io/name") == "harvester"))
    return union_all(
        c(apps.where("name = 'harvester'"), T.loose_version(F.coalesce(field("status", "chart.metadata.version"), field("spec", "chart.metadata.version"), chart, label("app.kubernetes.io/version"))), lit("harvester"), "Harvester app chart", 0),
        c(own, T.loose_version(label("app.kubernetes.io/version")), lit("harvester"), "Harvester pod label", 1),
        c(own, T.loose_version(T.blank_to_null(F.regexp_extract("text", "rancher/harvester:([A-Za-z0-9_.-]+)", 1))), lit("harvester-image"), "Harvester image", 2),
        c(own, T.loose_version(label("kubevirt.io/install-strategy-version")), lit("kubevirt"), "KubeVirt pod label", 4),
        c(addons, T.loose_version(field("spec", "version")), F.concat_ws("/", lit("addon"), "name"), "Harvester addon spec", 6),
        c(available, T.loose_version(F.col("name")), lit("available-version"), "Harvester Version resource", 8),
    )


def picked_versions(candidates: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """bundle_id, version, source and path of the candidate of least priority, and the distinct components."""
    order = F.struct("priority", "path", "item_no")
    first = candidates.groupBy("bundle_id", *keys).agg(F.min_by(F.struct("component", "version", "source", "path"), order).alias("c"), F.min(order).alias("o"))
    k = F.row_number().over(Window.partitionBy("bundle_id").orderBy("o", "c"))
    few = first.withColumn("k", k).where(F.col("k") <= most)
    won = F.min_by("c", F.struct("o", "k")).alias("won")
    out = few.groupBy("bundle_id").agg(won, F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("components"))
    return out.select("bundle_id", "won.version", "won.source", "won.path", "components")
