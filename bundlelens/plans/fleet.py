"""The bundle checks on bundles that Spark derives from the driver's tables: rows become items of
bundles of up to 500 keys each, whose number follows the rows, are read back by the resource scan
and go through the checks. Where a key may have any number of rows, a bundle has several files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundlelens.operators import checks, correlate, defaults, files, findings, groups, kb
from bundlelens.session import written
from bundlelens.sources import bundles

#: Keys of a bundle, and items of a file where keys repeat.
KEYS, ITEMS = 500, 2000


def _table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def members(rows: DataFrame, path: str, head: str = "apiVersion: v1\nitems:\n", between: str = "", tail: str = "") -> DataFrame:
    """rows(bundle_id, seq, item, and a folder where a bundle has several files) as list files."""
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    several = "folder" in rows.columns
    rows = rows.repartition(tasks, "bundle_id", *(["folder"] if several else []))  # small texts, much work: not to be coalesced
    if not several:
        rows = rows.withColumn("folder", F.lit("bundle"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "item"))), lambda x: x["item"]), between)
    m = rows.groupBy("bundle_id", "folder").agg(F.concat(F.lit(head), text, F.lit(tail)).alias("content"))
    return m.select("bundle_id", F.concat("folder", F.lit(f"/{path}")).alias("path"), F.lit("file").alias("type"), F.lit(False).alias("is_binary"), F.lit(0).alias("part"), F.lit(1).cast("long").alias("first_line"), "content")


def _resources(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return written(bundles.resources(out), "resources")


def _bundle(key: Column) -> Column:
    return F.concat(F.lit("b"), F.floor(key / KEYS).cast("string"))


def _volumes(spark, sf) -> DataFrame:
    o = _table(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "healthy").when(F.col("o_orderstatus") == "O", "degraded").otherwise("faulted")
    cond = F.when(F.col("o_orderpriority") == "1-URGENT", '  conditions:\n    - type: Restore\n      status: "True"\n').otherwise("")
    item = F.concat(F.lit("- kind: Volume\n  metadata:\n    name: o-"), "o_orderkey", F.lit("\n  status:\n    robustness: "), state, F.lit("\n"), F.when(cond != "", F.concat(F.lit("  "), cond)).otherwise(""))
    return members(o.select(_bundle(F.col("o_orderkey")).alias("bundle_id"), F.col("o_orderkey").alias("seq"), item.alias("item")), f"{checks.LH}/longhorn.io/v1beta2/volumes.yaml")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows(bundle_id, seq, item) with a folder: each bundle's rows dealt to as many files of about ITEMS as they fill,
    wherever their numbers lie."""
    n = rows.groupBy("bundle_id").agg(F.ceil(F.count("*") / ITEMS).alias("files"))
    return rows.join(n, "bundle_id").withColumn("folder", F.format_string("part%012d", F.pmod(F.xxhash64("seq"), F.col("files")))).drop("files")


def volume_findings(spark, sf):
    found, _ = checks.volume_findings(_resources(_volumes(spark, sf)), defaults.LONGHORN_RULES["conditions"]["rules"])
    return found.select("bundle_id", "id", "severity", "category")


def volume_inventory(spark, sf):
    _, inv = checks.volume_findings(_resources(_volumes(spark, sf)), defaults.LONGHORN_RULES["conditions"]["rules"])
    return inv


def pod_findings(spark, sf):
    line = _table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.col("l_linenumber").cast("int"))), lambda n: F.concat(F.lit("    - name: c"), n.cast("string"), F.lit("\n      restartCount: "), (n - 1).cast("string"), F.lit("\n"))), "").alias("c"))
    o = _table(spark, sf, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    phase = F.when(F.col("o_orderstatus") == "P", "Pending").otherwise("Running")
    item = F.concat(F.lit("- kind: Pod\n  metadata:\n    name: p-"), "o_orderkey", F.lit("\n  status:\n    phase: "), phase, F.lit("\n    containerStatuses:\n"), "c")
    m = members(o.select(_bundle(F.col("o_orderkey")).alias("bundle_id"), F.col("o_orderkey").alias("seq"), item.alias("item")), f"{checks.LH}/v1/pods.yaml")
    found, _ = checks.pods(_resources(m), checks.LH, "longhorn", "Longhorn Pod", 6)
    return found.select("bundle_id", "id", "severity", "count", F.array_join("evidence", "; ").alias("evidence"))


def _events(spark, sf, key: str) -> DataFrame:
    e = _table(spark, sf, "events")
    item = F.concat(F.lit("- kind: Event\n  metadata:\n    name: e-"), "event_id", F.lit("\n    namespace: default\n  involvedObject:\n    kind: VirtualMachine\n    name: vm-"), "user_id", F.lit("\n    namespace: default\n  type: "), F.when(F.col("event_type") == "error", "Warning").otherwise("Normal"), F.lit("\n  reason: "), "event_type", F.lit("\n  message: number "), "event_id", F.lit("\n"))
    rows = e.select(_bundle(F.col(key)).alias("bundle_id"), F.col("event_id").alias("seq"), item.alias("item"))
    return members(rows if key == "event_id" else _dealt(rows), "v1/events.yaml")


def warning_event_findings(spark, sf):
    found, _ = checks.events(_resources(_events(spark, sf, "event_id")), "", "harvester", False)
    return found.select("bundle_id", "id", "count", F.array_join("evidence", "; ").alias("evidence"))


def alert_findings(spark, sf):
    e = _table(spark, sf, "events")
    labels = F.struct(F.concat(F.lit("Alert "), "event_type", F.lit(" "), "event_id").alias("alertname"), F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warn").when(F.col("event_type") == "view", "none").otherwise("low").alias("severity"))
    item = F.to_json(F.struct(labels.alias("Labels"), F.struct(F.concat(F.lit("value of "), "user_id").alias("summary")).alias("Annotations"), F.when(F.col("event_id") % 3 == 0, "pending").otherwise("firing").alias("State")))
    m = members(e.select(_bundle(F.col("event_id")).alias("bundle_id"), F.col("event_id").alias("seq"), item.alias("item")), "prometheus-alerts.json", "[", ",", "]")
    found, _ = checks.alert_findings(bundles.alerts(m))
    return found.select("bundle_id", "id", "severity", F.array_join("evidence", "; ").alias("evidence"))


def collection_findings(spark, sf):
    d = _table(spark, sf, "documents").where("text is not null").select(F.concat(F.lit("b"), "doc_id").alias("bundle_id"), F.lit("b/bundleGenerationError.log").alias("path"), "text")
    found, _ = checks.collection_errors(files.log_lines(d, ["bundle_id", "path"], "text"), "harvester")
    return found.select("bundle_id", "id", "count", F.sha2(F.array_join("evidence", "\n"), 256).alias("evidence_sha256"))


def storage_groups(spark, sf):
    """Groups of the volumes' findings, with what their counters say."""
    cond = defaults.LONGHORN_RULES["conditions"]["rules"]
    found, inv = checks.volume_findings(_resources(_volumes(spark, sf)), cond)
    found = written(findings.first_by_id(found, ["bundle_id", "id"], ["seq"]), "findings")
    g = groups.finding_groups(spark, found, checks.complete_inventory(inv, found, "longhorn"), "longhorn")
    return g.select("bundle_id", "group_id", "severity", F.size("related_ids").cast("long").alias("findings"), F.array_join("affected", "; ").alias("affected"))


def image_issues(spark, sf):
    p = _table(spark, sf, "part")
    item = F.concat(F.lit("- kind: VirtualMachineImage\n  metadata:\n    name: i-"), "p_partkey", F.lit("\n  spec:\n    displayName: disk-"), "p_partkey", F.lit("\n  status:\n    failed: "), (F.col("p_size") % 3).cast("int").cast("string"), F.lit("\n    conditions:\n    - type: Imported\n      status: \"True\"\n"))
    i = checks.images(_resources(members(p.select(_bundle(F.col("p_partkey")).alias("bundle_id"), F.col("p_partkey").alias("seq"), item.alias("item")), "yamls/x/harvesterhci.io/v1beta1/virtualmachineimages.yaml")))
    return i.where("issue").select("bundle_id", "name", "line")


def vlan_issues(spark, sf):
    s = _table(spark, sf, "supplier")
    item = F.concat(F.lit("- kind: VlanStatus\n  metadata:\n    name: w-"), "s_suppkey", F.lit("\n  status:\n    node: n-"), "s_nationkey", F.lit("\n    conditions:\n    - type: Ready\n      status: \""), F.when(F.col("s_acctbal") < 0, "False").otherwise("True"), F.lit("\"\n"))
    v = checks.vlan_statuses(_resources(members(s.select(_bundle(F.col("s_suppkey")).alias("bundle_id"), F.col("s_suppkey").alias("seq"), item.alias("item")), "yamls/x/network.harvesterhci.io/v1beta1/vlanstatuses.yaml")))
    return v.where("issue").select("bundle_id", "name", "line")


def _migrations(spark, sf) -> DataFrame:
    o = _table(spark, sf, "orders")
    item = F.concat(F.lit("- kind: VirtualMachineInstanceMigration\n  metadata:\n    name: m-"), "o_orderkey", F.lit("\n    namespace: default\n  spec:\n    vmiName: vm-"), "o_custkey", F.lit("\n  status:\n    phase: "), F.when(F.col("o_orderstatus") == "F", "Failed").when(F.col("o_orderstatus") == "O", "Succeeded").otherwise("Scheduling"), F.lit("\n"))
    return members(_dealt(o.select(_bundle(F.col("o_custkey")).alias("bundle_id"), F.col("o_orderkey").alias("seq"), item.alias("item"))), "kubevirt.io/virtualmachineinstancemigrations.yaml")


def migration_issues(spark, sf):
    _, _, m = checks.machines(_resources(_migrations(spark, sf)))
    return m.where("issue").select("bundle_id", "name", "vmi", "line")


def workload_migrations(spark, sf):
    """Machines with their migrations, either of them missing."""
    w = correlate.workloads(*checks.machines(_resources(_machines(spark, sf), _migrations(spark, sf))))
    failed = F.size(F.filter("migrations", lambda m: m["issue"]))
    return w.select("bundle_id", "name", F.col("vm").isNotNull().alias("machine"), F.size("migrations").cast("long").alias("migrations"), failed.cast("long").alias("failed"))


def replica_findings(spark, sf):
    o = _table(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "running").when(F.col("o_orderstatus") == "O", "stopped").otherwise("error")
    item = F.concat(F.lit("- kind: Replica\n  metadata:\n    name: r-"), "o_orderkey", F.lit("\n  status:\n    currentState: "), state, F.lit('\n    conditions:\n    - type: FilesystemReadOnly\n      status: "'), F.when(F.col("o_orderpriority") == "2-HIGH", "True").otherwise("False"), F.lit('"\n'))
    m = members(o.select(_bundle(F.col("o_orderkey")).alias("bundle_id"), F.col("o_orderkey").alias("seq"), item.alias("item")), f"{checks.LH}/longhorn.io/v1beta2/replicas.yaml")
    found, _ = checks.replica_findings(_resources(m), defaults.LONGHORN_RULES["conditions"]["rules"])
    return found.select("bundle_id", "id", "severity")


def _disks(spark, sf) -> DataFrame:
    s = _table(spark, sf, "supplier")
    item = F.concat(F.lit("- kind: Node\n  metadata:\n    name: n-"), "s_suppkey", F.lit("\n  status:\n    diskStatus:\n      d1:\n        diskName: disk-"), "s_nationkey", F.lit('\n        storageAvailable: 5\n        storageMaximum: 100\n        conditions:\n        - type: Ready\n          status: "'), F.when(F.col("s_acctbal") < 0, "False").otherwise("True"), F.lit('"\n        - type: Schedulable\n          status: "'), F.when(F.col("s_acctbal") > 9000, "False").otherwise("True"), F.lit('"\n'))
    m = members(s.select(_bundle(F.col("s_suppkey")).alias("bundle_id"), F.col("s_suppkey").alias("seq"), item.alias("item")), f"{checks.LH}/longhorn.io/v1beta2/nodes.yaml")
    return _resources(m)


def disk_findings(spark, sf):
    found, _ = checks.storage_node_findings(_disks(spark, sf), defaults.LONGHORN_RULES["conditions"]["rules"])
    return found.select("bundle_id", "id")


def disk_inventory(spark, sf):
    _, inv = checks.storage_node_findings(_disks(spark, sf), defaults.LONGHORN_RULES["conditions"]["rules"])
    return inv.where("value > 0")


def app_findings(spark, sf):
    p = _table(spark, sf, "part")
    item = F.concat(F.lit("- kind: App\n  metadata:\n    name: a-"), "p_partkey", F.lit("\n  status:\n    summary:\n      state: "), F.when(F.col("p_size") % 3 == 0, "failed").when(F.col("p_size") % 3 == 1, "pending").otherwise("deployed"), F.lit("\n"))
    m = members(p.select(_bundle(F.col("p_partkey")).alias("bundle_id"), F.col("p_partkey").alias("seq"), item.alias("item")), f"{checks.HV}/catalog.cattle.io/v1/apps.yaml")
    found, _ = checks.app_findings(_resources(m))
    return found.select("bundle_id", "id", "count", F.array_join("evidence", "; ").alias("evidence"))


def addon_findings(spark, sf):
    p = _table(spark, sf, "part")
    item = F.concat(F.lit("- kind: Addon\n  metadata:\n    name: a-"), "p_partkey", F.lit("\n  spec:\n    enabled: "), F.when(F.col("p_partkey") % 2 == 0, "true").otherwise("false"), F.lit("\n  status:\n    status: "), F.when(F.col("p_size") % 5 == 0, "AddonDeployFailed").otherwise("AddonDeploySuccessful"), F.lit('\n    conditions:\n    - type: InProgress\n      status: "'), F.when(F.col("p_size") % 7 == 0, "True").otherwise("False"), F.lit('"\n'))
    m = members(p.select(_bundle(F.col("p_partkey")).alias("bundle_id"), F.col("p_partkey").alias("seq"), item.alias("item")), f"{checks.HV}/harvesterhci.io/v1beta1/addons.yaml")
    found, _ = checks.addon_findings(_resources(m))
    return found.select("bundle_id", "id", "count", F.array_join("evidence", "; ").alias("evidence"))


def stack_findings(spark, sf):
    """A bundle for each customer, with one service."""
    c = _table(spark, sf, "customer")
    item = F.concat(F.lit("- kind: CDI\n  metadata:\n    name: cdi\n  status:\n    phase: "), F.when(F.col("c_mktsegment") == "BUILDING", "Deploying").otherwise("Deployed"), F.lit("\n    operatorVersion: v1.2.3\n    conditions:\n    - type: Available\n      status: \""), F.when(F.col("c_acctbal") < 0, "False").otherwise("True"), F.lit('"\n'))
    m = members(c.select(F.concat(F.lit("c"), "c_custkey").alias("bundle_id"), F.col("c_custkey").alias("seq"), item.alias("item")), "yamls/cluster/cdi.kubevirt.io/v1beta1/cdis.yaml")
    found, _ = checks.stack_findings(_resources(m))
    return found.select("bundle_id", "id", "title", F.array_join("evidence", "; ").alias("evidence"))


def storage_rollup(spark, sf):
    """What the other product says of the volumes."""
    found, inv = checks.volume_findings(_resources(_volumes(spark, sf)), defaults.LONGHORN_RULES["conditions"]["rules"])
    return checks.storage_rollup(written(found, "findings"), written(inv, "inventory")).select("bundle_id", "id", "severity", "count")


def version_candidates(spark, sf):
    """The version of each bundle, from the labels of its deployments, and what else was seen."""
    p = _table(spark, sf, "part")
    version = F.concat("p_size", F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(".0"))
    item = F.concat(F.lit("- kind: Deployment\n  metadata:\n    name: d-"), "p_partkey", F.lit("\n    labels:\n      app.kubernetes.io/name: "), F.when(F.col("p_partkey") % 3 == 0, "longhorn").otherwise("other"), F.lit("\n      app.kubernetes.io/version: v"), version, F.lit("\n      helm.sh/chart: longhorn-"), version, F.lit("\n"))
    m = members(p.select(_bundle(F.col("p_partkey")).alias("bundle_id"), F.col("p_partkey").alias("seq"), item.alias("item")), f"{checks.LH}/apps/v1/deployments.yaml")
    picked = checks.picked_versions(checks.versions(_resources(m), "longhorn"), ["component", "version"])
    return picked.select("bundle_id", "version", "source", F.array_join(F.transform("components", lambda c: F.concat(c["component"], F.lit(" "), c["version"])), "; ").alias("components"))


def log_workloads(spark, sf):
    """Machines that log lines name; the lines of a bundle are those of its own users."""
    w = correlate.workloads(*checks.machines(_resources(_machines(spark, sf))))
    e = _table(spark, sf, "events").where("event_type = 'error'")
    hits = e.select(_bundle(F.col("user_id")).alias("bundle_id"), F.lit("harvester-log-error-lines").alias("id"), F.lit("logs/controller.log").alias("path"), F.col("event_id").alias("line_no"), F.concat(F.lit("error: vm-"), "user_id", F.lit(" failed")).alias("line"))
    return correlate.log_matches(w, hits, whole_words=True).groupBy("bundle_id", "name").agg(F.count("*").alias("lines"), F.min("hit.line_no").alias("first_line"))


def workload_correlations(spark, sf):
    """The workloads of each bundle that its warning events are about, those of most signals first."""
    r = _resources(_machines(spark, sf), _migrations(spark, sf), _events(spark, sf, "user_id"))
    found, _ = checks.events(r, "", "harvester", False)
    hits = spark.createDataFrame([], "bundle_id string, id string, path string, line_no long, line string")
    w = correlate.correlations(written(found, "findings"), r, hits)
    return w.select("bundle_id", F.col("place").cast("long").alias("place"), "name", "severity", F.col("event_count").cast("long").alias("event_count"), "event_total", F.col("signal_count").cast("long").alias("signal_count"), F.array_join("related_ids", ",").alias("related_ids"))


def kb_stats(spark, sf):
    d = _table(spark, sf, "documents").select(F.timestamp_seconds("doc_id").alias("imported_at"))
    s = kb.stats(d, _table(spark, sf, "pages"))
    return s.select("document_count", F.unix_seconds("updated_at").alias("updated_at"), "chunk_count")


def kb_expanded(spark, sf):
    """What an import of each page takes: an index page's links, any other page itself."""
    p = _table(spark, sf, "pages").withColumn("url", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/")))
    return kb.expanded(p, kb.links(p, "url", "html", "/"), "url", 3)


def node_findings(spark, sf):
    s = _table(spark, sf, "supplier")
    ready = F.when(F.col("s_acctbal") < 0, "False").otherwise("True")
    item = F.concat(F.lit("- kind: Node\n  metadata:\n    name: n-"), "s_suppkey", F.lit('\n  status:\n    conditions:\n    - type: Ready\n      status: "'), ready, F.lit('"\n    - type: DiskPressure\n      status: "'), F.when(F.col("s_acctbal") > 9000, "True").otherwise("False"), F.lit('"\n'))
    m = members(s.select(_bundle(F.col("s_suppkey")).alias("bundle_id"), F.col("s_suppkey").alias("seq"), item.alias("item")), "yamls/cluster/v1/nodes.yaml")
    found, _ = checks.node_findings(_resources(m), defaults.HARVESTER_RULES["conditions"]["rules"])
    return found.select("bundle_id", "id", "severity", F.array_join("evidence", "; ").alias("evidence"))


def _machines(spark, sf) -> DataFrame:
    c = _table(spark, sf, "customer")
    status = F.when(F.col("c_acctbal") < 0, "Unschedulable").when(F.col("c_mktsegment") == "BUILDING", "Stopped").otherwise("Running")
    item = F.concat(F.lit("- kind: VirtualMachine\n  metadata:\n    name: vm-"), "c_custkey", F.lit("\n    namespace: default\n  spec:\n    running: "), F.when(F.col("c_mktsegment") == "MACHINERY", "false").otherwise("true"), F.lit("\n  status:\n    printableStatus: "), status, F.lit("\n"))
    return members(c.select(_bundle(F.col("c_custkey")).alias("bundle_id"), F.col("c_custkey").alias("seq"), item.alias("item")), "yamls/namespaced/default/kubevirt.io/v1/virtualmachines.yaml")


def machine_findings(spark, sf):
    v, _, _ = checks.machines(_resources(_machines(spark, sf)))
    return v.where("issue").select("bundle_id", "name", "line", "desired")


def event_workloads(spark, sf):
    r = _resources(_machines(spark, sf), _events(spark, sf, "user_id"))
    w = correlate.workloads(*checks.machines(r))
    j = correlate.event_matches(w, correlate.warning_events(r), whole_words=True)
    return j.groupBy("bundle_id", "ns", "name").agg(F.count("*").alias("events"))


QUERIES = {f.__name__: f for f in (volume_findings, volume_inventory, pod_findings, warning_event_findings, node_findings, machine_findings, event_workloads, alert_findings, collection_findings, storage_groups, image_issues, vlan_issues, migration_issues, workload_migrations, kb_stats, kb_expanded, replica_findings, disk_findings, disk_inventory, app_findings, addon_findings, stack_findings, storage_rollup, version_candidates, log_workloads, workload_correlations)}

_B = "'b' || ({} // 500)"
SQL = {
    "volume_findings": f"""SELECT {_B.format('o_orderkey')} AS bundle_id, 'longhorn-volume-o-' || o_orderkey || CASE o_orderstatus WHEN 'O' THEN '-degraded' ELSE '-faulted' END AS id, CASE o_orderstatus WHEN 'O' THEN 'warning' ELSE 'critical' END AS severity, 'Longhorn Volume' AS category FROM orders WHERE o_orderstatus <> 'F'
      UNION ALL SELECT {_B.format('o_orderkey')}, 'longhorn-volume-o-' || o_orderkey || '-restore', 'warning', 'Longhorn Volume' FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "volume_inventory": f"""SELECT {_B.format('o_orderkey')} AS bundle_id, 'volumes' AS area, 'total' AS metric, count(*) AS value FROM orders GROUP BY 1
      UNION ALL SELECT {_B.format('o_orderkey')}, 'volumes', 'unhealthy', count(*) FILTER (WHERE o_orderstatus <> 'F') FROM orders GROUP BY 1""",
    "pod_findings": f"""WITH c AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) - 1 AS r FROM lineitem),
      p AS (SELECT {_B.format('o_orderkey')} AS bundle_id, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM c)),
      x AS (SELECT bundle_id, o_orderkey, max(r) AS most, 'p-' || o_orderkey || ': ' || string_agg('c' || (r + 1) || '=' || r, ', ' ORDER BY r) AS line FROM p JOIN c ON o_orderkey = l_orderkey WHERE r > 0 GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY o_orderkey) AS k FROM x)
      SELECT bundle_id, 'longhorn-pods-with-container-restarts' AS id, CASE WHEN max(most) >= 5 THEN 'warning' ELSE 'info' END AS severity, count(*) AS count, string_agg(CASE WHEN k <= 6 THEN line END, '; ' ORDER BY k) AS evidence FROM k GROUP BY 1
      UNION ALL SELECT bundle_id, 'longhorn-pod-p-' || o_orderkey || '-pending', 'warning', 1, 'Phase: Pending' FROM p WHERE o_orderstatus = 'P'""",
    "warning_event_findings": f"""SELECT bundle_id, 'harvester-warning-events' AS id, count(*) AS count, string_agg(CASE WHEN k <= 6 THEN 'error: number ' || event_id END, '; ' ORDER BY k) AS evidence
      FROM (SELECT {_B.format('event_id')} AS bundle_id, event_id, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS k FROM events WHERE event_type = 'error') GROUP BY 1""",
    "node_findings": f"""SELECT {_B.format('s_suppkey')} AS bundle_id, 'harvester-node-n-' || s_suppkey || '-ready' AS id, 'critical' AS severity, 'Type: Ready; Status: False' AS evidence FROM supplier WHERE s_acctbal < 0
      UNION ALL SELECT {_B.format('s_suppkey')}, 'harvester-node-n-' || s_suppkey || '-diskpressure', 'warning', 'Type: DiskPressure; Status: True' FROM supplier WHERE s_acctbal > 9000""",
    "machine_findings": f"""WITH v AS (SELECT {_B.format('c_custkey')} AS bundle_id, 'vm-' || c_custkey AS name, c_mktsegment <> 'MACHINERY' AS desired, CASE WHEN c_acctbal < 0 THEN 'Unschedulable' WHEN c_mktsegment = 'BUILDING' THEN 'Stopped' ELSE 'Running' END AS st FROM customer)
      SELECT bundle_id, name, 'default/' || name || ': ' || CASE WHEN st = 'Unschedulable' THEN st ELSE 'desired running but status is ' || st END || ' · printableStatus=' || st || ' · running=' || desired AS line, desired FROM v WHERE st = 'Unschedulable' OR (desired AND st = 'Stopped')""",
    "event_workloads": f"SELECT {_B.format('user_id')} AS bundle_id, 'default' AS ns, 'vm-' || user_id AS name, count(*) AS events FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'error' GROUP BY 1, 2, 3",
    "alert_findings": f"""SELECT {_B.format('event_id')} AS bundle_id, 'longhorn-alert-alert-' || event_type || '-' || event_id AS id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity, 'value of ' || user_id AS evidence
      FROM events WHERE event_id % 3 <> 0 AND event_type <> 'view'""",
    "collection_findings": """WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS no FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS x FROM documents WHERE text IS NOT NULL)),
      k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k FROM l WHERE trim(line, ' ') <> '')
      SELECT 'b' || doc_id AS bundle_id, 'harvester-bundle-generation-errors' AS id, count(*) AS count, sha256(string_agg(CASE WHEN k <= 6 THEN trim(line, ' ') END, chr(10) ORDER BY k)) AS evidence_sha256 FROM k GROUP BY doc_id""",
    "storage_groups": f"""WITH f AS (SELECT {_B.format('o_orderkey')} AS bundle_id, o_orderstatus AS st, o_orderpriority = '1-URGENT' AS urgent FROM orders),
      g AS (SELECT bundle_id, count(*) FILTER (WHERE st <> 'F') AS bad, count(*) AS total, bool_or(st NOT IN ('F', 'O')) AS faulted, count(*) FILTER (WHERE urgent) AS restores FROM f GROUP BY 1)
      SELECT bundle_id, 'longhorn-volume-replica-health' AS group_id, CASE WHEN faulted THEN 'critical' ELSE 'warning' END AS severity, bad + restores AS findings,
        'Unhealthy volumes: ' || bad || '; Replicas not running: 0; Total volumes: ' || total || '; Total replicas: 0' AS affected FROM g WHERE bad > 0""",
    "image_issues": f"SELECT {_B.format('p_partkey')} AS bundle_id, 'i-' || p_partkey AS name, 'disk-' || p_partkey || ': Imported=True · failed=' || (p_size % 3) AS line FROM part WHERE p_size % 3 > 0",
    "vlan_issues": f"SELECT {_B.format('s_suppkey')} AS bundle_id, 'w-' || s_suppkey AS name, 'w-' || s_suppkey || ': ready=False · node=n-' || s_nationkey AS line FROM supplier WHERE s_acctbal < 0",
    "migration_issues": f"SELECT {_B.format('o_custkey')} AS bundle_id, 'm-' || o_orderkey AS name, 'vm-' || o_custkey AS vmi, 'default/m-' || o_orderkey || ': phase=' || CASE o_orderstatus WHEN 'F' THEN 'Failed' ELSE 'Scheduling' END || ' · vmi=vm-' || o_custkey AS line FROM orders WHERE o_orderstatus <> 'O'",
    "workload_migrations": f"""SELECT {_B.format('k')} AS bundle_id, 'vm-' || k AS name, c IS NOT NULL AS machine, coalesce(n, 0) AS migrations, coalesce(bad, 0) AS failed
      FROM (SELECT coalesce(c_custkey, o_custkey) AS k, c_custkey AS c, n, bad FROM customer FULL OUTER JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'O') AS bad FROM orders GROUP BY 1) ON c_custkey = o_custkey)""",
    "replica_findings": f"""SELECT {_B.format('o_orderkey')} AS bundle_id, 'longhorn-replica-r-' || o_orderkey || CASE o_orderstatus WHEN 'O' THEN '-stopped' ELSE '-error' END AS id, 'warning' AS severity FROM orders WHERE o_orderstatus <> 'F'
      UNION ALL SELECT {_B.format('o_orderkey')}, 'longhorn-replica-r-' || o_orderkey || '-filesystemreadonly', 'critical' FROM orders WHERE o_orderpriority = '2-HIGH'""",
    "disk_findings": f"""SELECT {_B.format('s_suppkey')} AS bundle_id, 'longhorn-node-n-' || s_suppkey || '-disk-disk-' || s_nationkey || CASE WHEN s_acctbal < 0 THEN '-ready' ELSE '-schedulable' END AS id FROM supplier WHERE s_acctbal < 0 OR s_acctbal > 9000""",
    "disk_inventory": f"""WITH s AS (SELECT {_B.format('s_suppkey')} AS bundle_id, count(*) AS n, count(*) FILTER (WHERE s_acctbal < 0 OR s_acctbal > 9000) AS bad FROM supplier GROUP BY 1)
      SELECT * FROM (SELECT bundle_id, 'nodes' AS area, unnest(['total', 'disks', 'problematic', 'diskIssues', 'nodesWithDiskIssues']) AS metric, unnest([n, n, bad, bad, bad]) AS value FROM s) WHERE value > 0""",
    "app_findings": f"""WITH a AS (SELECT {_B.format('p_partkey')} AS bundle_id, 'a-' || p_partkey || CASE p_size % 3 WHEN 0 THEN ': failed' ELSE ': pending' END AS line, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) AS k FROM part WHERE p_size % 3 < 2)
      SELECT bundle_id, 'harvester-apps-not-deployed' AS id, count(*) AS count, string_agg(CASE WHEN k <= 8 THEN line END, '; ' ORDER BY k) AS evidence FROM a GROUP BY 1""",
    "addon_findings": f"""WITH a AS (SELECT {_B.format('p_partkey')} AS bundle_id, 'a-' || p_partkey || CASE WHEN p_size % 5 = 0 THEN ': AddonDeployFailed' ELSE ': AddonDeploySuccessful' END || CASE WHEN p_size % 7 = 0 THEN ' · InProgress=True' ELSE '' END AS line, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 0 AND (p_size % 5 = 0 OR p_size % 7 = 0))
      SELECT bundle_id, 'harvester-addons-not-ready' AS id, count(*) AS count, string_agg(CASE WHEN k <= 8 THEN line END, '; ' ORDER BY k) AS evidence FROM a GROUP BY 1""",
    "stack_findings": """SELECT 'c' || c_custkey AS bundle_id, 'harvester-cdi-not-ready' AS id, 'CDI is not fully ready' AS title, 'Phase: ' || CASE c_mktsegment WHEN 'BUILDING' THEN 'Deploying' ELSE 'Deployed' END || '; Available: ' || CASE WHEN c_acctbal < 0 THEN 'False' ELSE 'True' END || '; Version: v1.2.3' AS evidence FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0""",
    "storage_rollup": f"""SELECT bundle_id, 'harvester-longhorn-volumes-unhealthy' AS id, CASE WHEN faulted THEN 'critical' ELSE 'warning' END AS severity, bad AS count
      FROM (SELECT {_B.format('o_orderkey')} AS bundle_id, count(*) FILTER (WHERE o_orderstatus <> 'F') AS bad, bool_or(o_orderstatus NOT IN ('F', 'O')) AS faulted FROM orders GROUP BY 1) WHERE bad > 0""",
    "version_candidates": f"""WITH p AS (SELECT {_B.format('p_partkey')} AS bundle_id, p_partkey, 'v' || p_size || '.' || (p_partkey % 7) || '.0' AS v FROM part WHERE p_partkey % 3 = 0),
      c AS (SELECT bundle_id, r, v, min(p_partkey) AS first_part FROM p, (VALUES (1), (2)) AS t(r) GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY r, first_part) AS k FROM c)
      SELECT bundle_id, min(CASE WHEN k = 1 THEN v END) AS version, 'Kubernetes app label' AS source, string_agg(CASE r WHEN 1 THEN 'longhorn ' ELSE 'longhorn-chart ' END || v, '; ' ORDER BY k) AS components FROM k WHERE k <= 12 GROUP BY 1""",
    "log_workloads": f"SELECT {_B.format('user_id')} AS bundle_id, 'vm-' || user_id AS name, count(*) AS lines, min(event_id) AS first_line FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'error' GROUP BY 1, 2",
    "workload_correlations": f"""WITH v AS (SELECT c_custkey, c_acctbal < 0 OR (c_mktsegment = 'BUILDING') AS issue FROM customer),
      m AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'O') AS bad FROM orders GROUP BY 1),
      e AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
      w AS (SELECT coalesce(c_custkey, o_custkey) AS k, coalesce(issue, false) AS issue, coalesce(bad, 0) AS bad FROM v FULL OUTER JOIN m ON c_custkey = o_custkey),
      s AS (SELECT k, 'vm-' || k AS name, issue, bad, n, CAST(issue AS BIGINT) + bad + least(n, 3) AS signals FROM w JOIN e ON user_id = k)
      SELECT {_B.format('k')} AS bundle_id, row_number() OVER (PARTITION BY k // 500 ORDER BY signals DESC, name) AS place, name, 'warning' AS severity, least(n, 3) AS event_count, n AS event_total, signals AS signal_count,
        concat_ws(',', CASE WHEN issue THEN 'harvester-vms-not-ready' END, CASE WHEN bad > 0 THEN 'harvester-vm-migrations-failed' END, 'harvester-warning-events') AS related_ids
      FROM s QUALIFY place <= 12""",
    "kb_stats": "SELECT (SELECT count(*) FROM documents) AS document_count, (SELECT max(doc_id) FROM documents) AS updated_at, (SELECT count(*) FROM pages) AS chunk_count",
    "kb_expanded": """WITH b AS (SELECT regexp_replace(url, '[?#].*$', '') || '/' AS url, html FROM pages),
      l AS (SELECT DISTINCT url, link FROM (SELECT url, origin, path, origin || p AS link, p
        FROM (SELECT url, origin, path, split_part(split_part(h, '?', 1), '#', 1) AS p FROM (SELECT url, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS path, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*href="([^"]+)"', 1)) AS h FROM b) WHERE h LIKE '/%'))
        WHERE p <> path AND NOT regexp_matches(p, '(?i)\\.(css|js|mjs|map|png|jpe?g|gif|svg|webp|ico|woff2?|ttf|eot|zip|tar|gz|tgz|pdf)$')),
      n AS (SELECT url, count(*) AS n FROM l GROUP BY url)
      SELECT url, link AS target FROM (SELECT l.*, row_number() OVER (PARTITION BY l.url ORDER BY link) AS k FROM l JOIN n USING (url) WHERE n >= 2) WHERE k <= 3
      UNION ALL SELECT DISTINCT b.url, b.url FROM b LEFT JOIN n ON n.url = b.url WHERE coalesce(n, 0) < 2""",
}
