"""Finding groups: which findings belong together, what makes a group appear, and what it says."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.functions import text as T
from bundlelens.operators.findings import affected, merged_evidence, union_all


@dataclass(frozen=True)
class Group:
    """ids and categories are members that make the group; guests join it once it is there, but
    where a bundle has none of `unless`, they make it too. With counters, the group appears where one of
    these inventory counters is above zero, and members alone don't make it.

    metrics: (label, source), a source being `area.metric` of the inventory, `+area.metric` (shown
    above zero only), `#id` (the count of a finding) or `@category` (how many findings it has).
    """

    id: str
    product: str
    title: str
    description: str
    impact: str
    checks: tuple[str, ...]
    ids: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    guests: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    counters: tuple[tuple[str, str], ...] = ()
    metrics: tuple[tuple[str, str], ...] = ()
    title_with: tuple[str, str] | None = None  # (finding id, title where that finding is there)


_SCHEDULING, _WEBHOOK, _ERRORS, _OFFLOAD = "harvester-log-virtualization-scheduling", "harvester-log-webhook-errors", "harvester-log-error-lines", "harvester-log-network-offload"

#: Group ids, their members, what makes them and the counters they show.
GROUPS = (
    Group(
        "longhorn-manager-stability", "longhorn", "Manager logs hold errors", "The manager reconciles volumes and replicas; panics and errors there explain stale state elsewhere.",
        "Operations lag or fail, with symptoms in volumes, replicas and webhooks.", ("Read the first stack trace with the lines around it.", "Look up the manager's version among known problems.", "See if node or webhook findings fall into the same time."),
        ids=("longhorn-manager-observed-panic", "longhorn-log-error-lines"), metrics=(("Panics", "#longhorn-manager-observed-panic"), ("Error lines", "#longhorn-log-error-lines"), ("Log files scanned", "+logs.scannedFiles")),
        title_with=("longhorn-manager-observed-panic", "Manager panics"),
    ),
    Group(
        "longhorn-volume-replica-health", "longhorn", "Volume and replica health", "Volumes that aren't healthy and replicas that don't run tend to have one cause.",
        "Workloads lose redundancy, can't attach, or wait for a rebuild.", ("Match the stopped replicas to the volumes.", "Look at disks and scheduling before a rebuild is forced."),
        categories=("Longhorn Volume", "Longhorn Replica"), counters=(("volumes", "unhealthy"), ("replicas", "notRunning")),
        metrics=(("Unhealthy volumes", "volumes.unhealthy"), ("Replicas not running", "replicas.notRunning"), ("Total volumes", "volumes.total"), ("Total replicas", "replicas.total")),
    ),
    Group(
        "longhorn-replica-scheduling-capacity", "longhorn", "Replica scheduling and capacity", "Prechecks for new replicas find no disk or node to use.",
        "Volumes stay degraded, as their replicas have no place.", ("Compare free and reserved space, tags and selectors of the nodes.", "Settle node findings first."),
        ids=("longhorn-log-replica-scheduling-storage",), metrics=(("Scheduling log matches", "#longhorn-log-replica-scheduling-storage"), ("Replicas not running", "replicas.notRunning"), ("Problematic nodes", "nodes.problematic")),
    ),
    Group(
        "longhorn-node-prerequisites", "longhorn", "Node prerequisites", "Nodes lack packages, kernel modules or services, or aren't ready.",
        "No replicas are placed on these nodes.", ("Install what the conditions name.", "Check multipath before volumes are attached there."),
        categories=("Longhorn Node",), metrics=(("Problematic nodes", "nodes.problematic"), ("Total Longhorn nodes", "nodes.total"), ("Node findings", "@Longhorn Node")),
    ),
    Group(
        "longhorn-control-plane-endpoints", "longhorn", "Control plane endpoints", "Webhook or CSI sockets refused connections, as they do while components start.",
        "Admission and storage calls fail until the endpoint is back.", ("Compare the times with restarts.", "See that the pods became ready afterwards."),
        ids=("longhorn-log-webhook-connection-refused", "longhorn-log-csi-connection-refused"), metrics=(("Webhook matches", "#longhorn-log-webhook-connection-refused"), ("CSI socket matches", "#longhorn-log-csi-connection-refused")),
    ),
    Group(
        "longhorn-pod-restarts", "longhorn", "Pod restarts", "Containers restarted, which explains short connection errors and gaps in logs.",
        "Storage calls break off while a container restarts.", ("Begin with the container that restarted most.",),
        ids=("longhorn-pods-with-container-restarts",), metrics=(("Pods with restarts", "pods.withRestarts"), ("Total Longhorn pods", "pods.total")),
    ),
    Group(
        "longhorn-monitoring-alerts", "longhorn", "Monitoring alerts", "Alerts were firing when the bundle was made.",
        "Monitoring saw the symptoms before.", ("Put the alerts' times beside manager logs and events.",),
        categories=("Monitoring",), metrics=(("Firing alerts", "@Monitoring"),),
    ),
    Group(
        "longhorn-collection-gaps", "longhorn", "Collection gaps", "Some resources or logs could not be collected.",
        "What is missing is not proof of health.", ("Read the collection log before calling anything absent.",),
        ids=("longhorn-bundle-generation-errors",), metrics=(("Collection errors", "#longhorn-bundle-generation-errors"),),
    ),
    Group(
        "harvester-control-plane-health", "harvester", "Control plane health", "API, webhook, add-on and controller pods make up the control plane.",
        "Operations on machines and nodes fail now and then.", ("Begin with the pods that restarted most.", "Open the apps and add-ons named.", "See if webhook errors ended once the pods were ready."),
        ids=("harvester-pods-with-container-restarts", _WEBHOOK), categories=("Harvester App", "Harvester Addon", "Harvester Pod"),
        metrics=(("Harvester pods with restarts", "pods.withRestarts"), ("Apps not deployed", "apps.notDeployed"), ("Addons with issues", "addons.withIssues"), ("Webhook log matches", f"#{_WEBHOOK}")),
    ),
    Group(
        "harvester-virtualization-readiness", "harvester", "Virtualization readiness", "The virtualization stack, image imports and scheduling logs tell if machines can start.",
        "Machines can't be created, moved or given images.", ("See that the stack is deployed and available.", "Open images that aren't imported.", "Compare selectors, taints and labels."),
        categories=("Virtualization", "Harvester Image"), metrics=(("Virtualization findings", "@Virtualization"), ("VM images with issues", "vmImages.withIssues"), ("Scheduling log matches", f"#{_SCHEDULING}")),
    ),
    Group(
        "harvester-vm-workload-health", "harvester", "Machine workload health", "Machines, instances and migrations show if guests run and can be moved.",
        "Machines stay stopped, pending or can't migrate.", ("Open machine and instance together.", "Compare selectors, taints and room on the nodes.", "Read controller logs at the time of a migration."),
        categories=("Harvester VM",), guests=(_SCHEDULING,), metrics=(("VMs with issues", "workloads.vmIssues"), ("VMIs not running", "workloads.vmisNotRunning"), ("Failed migrations", "workloads.migrationsFailed"), ("Scheduling log matches", f"#{_SCHEDULING}")),
    ),
    Group(
        "harvester-network-health", "harvester", "Network health", "VLAN statuses and network logs explain lost connections.",
        "Machines miss their network or lose throughput.", ("See that each VLAN status is ready.", "Check offload settings of the interfaces."),
        categories=("Harvester Network",), metrics=(("Network issues", "networks.withIssues"), ("Network log matches", f"#{_OFFLOAD}")),
    ),
    Group(
        "harvester-storage-health", "harvester", "Storage health", "Disks of machines are volumes with replicas; their trouble reaches running machines.",
        "Machines lose redundancy or can't be recovered.", ("Begin with disks that aren't ready.", "Find the node that keeps replicas from running."),
        categories=("Harvester Storage",),
        metrics=(("Longhorn volumes", "storage.volumes"), ("Unhealthy volumes", "storage.unhealthyVolumes"), ("Replicas not running", "storage.replicasNotRunning"), ("Longhorn nodes with disk issues", "storage.nodesWithDiskIssues"), ("Replica scheduling log matches", "storage.replicaSchedulingLogMatches")),
    ),
    Group(
        "harvester-node-health", "harvester", "Node health", "Readiness, pressure, etcd membership and clocks of the nodes.",
        "Placement, migration and certificates suffer from a bad node.", ("Read all conditions of a node together.", "See that clocks are in step."),
        categories=("Harvester Node",), metrics=(("Nodes with issues", "nodes.withIssues"), ("Total Harvester nodes", "nodes.total")),
    ),
    Group(
        "harvester-platform-events-and-logs", "harvester", "Platform events and logs", "Warning events, or log errors that no other rule explains.",
        "A hint of start-up noise or of something to look into.", ("Compare the first event or line with the reported symptom.",),
        categories=("Kubernetes Events",), guests=(_ERRORS,), unless=(_WEBHOOK, _SCHEDULING), metrics=(("Warning events", "events.warnings"), ("Harvester log error lines", f"#{_ERRORS}")),
    ),
    Group(
        "harvester-collection-gaps", "harvester", "Collection gaps", "Some resources or logs could not be collected.",
        "What is missing is not proof of health.", ("Read the collection log before calling anything absent.",),
        ids=("harvester-bundle-generation-errors",), metrics=(("Collection errors", "#harvester-bundle-generation-errors"),),
    ),
)

BY = ["bundle_id", "group_id"]


def _mapped(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # a few rows for each group


def finding_groups(spark: SparkSession, found: DataFrame, inventory: DataFrame, product: str, groups: tuple[Group, ...] = GROUPS) -> DataFrame:
    """bundle_id, group_id, title, severity, description, impact, checks, affected, evidence,
    related_ids. A finding may be in several groups. found: findings, one for each id of a bundle;
    inventory: bundle_id, area, metric, value."""
    own = [g for g in groups if g.product == product]
    f = found.select("bundle_id", "id", "severity", "category", "title", "evidence", "count", "path")
    by_id = [(g.id, i, not g.counters) for g in own for i in g.ids] + [(g.id, i, False) for g in own for i in g.guests]
    by_category = [(g.id, c, not g.counters) for g in own for c in g.categories]
    parts = [f.join(_mapped(spark, rows, f"group_id string, {on} string, makes boolean"), on).select(*BY, "makes", *f.columns[1:]) for rows, on in ((by_id, "id"), (by_category, "category")) if rows]
    members = union_all(*parts)

    made = [members.where("makes").select(*BY)]
    for g in own:
        if g.guests and g.unless:
            others = f.where(F.col("id").isin(*g.unless)).select("bundle_id").distinct()
            made.append(members.where((F.col("group_id") == g.id) & F.col("id").isin(*g.guests)).select(*BY).join(others, "bundle_id", "left_anti"))
    values = inventory.groupBy("bundle_id", "area", "metric").agg(F.sum("value").alias("value"))
    if counters := [(g.id, *c) for g in own for c in g.counters]:
        made.append(values.where("value > 0").join(_mapped(spark, counters, "group_id string, area string, metric string"), ["area", "metric"]).select(*BY))
    made = union_all(*made).distinct()
    members = members.drop("makes").dropDuplicates([*BY, "id"]).join(made, BY, "left_semi")

    shown = [(g.id, k, label, source.lstrip("+"), source.startswith("+")) for g in own for k, (label, source) in enumerate(g.metrics)]
    sources = union_all(
        values.select("bundle_id", F.concat_ws(".", "area", "metric").alias("source"), "value"),
        f.select("bundle_id", F.concat(F.lit("#"), "id").alias("source"), F.col("count").alias("value")),
        f.groupBy("bundle_id", F.concat(F.lit("@"), "category").alias("source")).agg(F.count("*").alias("value")),
    )
    told = sources.join(_mapped(spark, shown, "group_id string, k int, label string, source string, positive boolean"), "source").where("value > 0 or not positive")
    told = told.join(made, BY, "left_semi").groupBy(*BY).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", affected(F.col("label"), F.col("value")).alias("line")))), lambda x: x["line"]).alias("affected"))

    special = [(g.id, *g.title_with) for g in own if g.title_with]
    named = members.select(*BY, "id").join(_mapped(spark, special, "group_id string, id string, special string"), ["group_id", "id"]).select(*BY, "special") if special else None
    text = _mapped(spark, [(g.id, g.title, g.description, g.impact, list(g.checks)) for g in own], "group_id string, title string, description string, impact string, checks array<string>")
    rank = T.severity_rank(F.col("severity"))
    out = members.groupBy(*BY).agg(T.severity_of(F.min(rank)).alias("severity"), F.sort_array(F.collect_set("id")).alias("related_ids"))
    evidence = merged_evidence(members.withColumn("rank", rank), BY, ["rank", "id"], 8 if product == "longhorn" else 10)
    out = out.join(evidence, BY).join(told, BY, "left").join(text, "group_id")
    if named is not None:
        out = out.join(named, BY, "left").withColumn("title", F.coalesce("special", "title"))
    none = F.array().cast("array<string>")
    return out.select(*BY, "title", "severity", "description", "impact", "checks", F.coalesce("affected", none).alias("affected"), "evidence", "related_ids")
