import hashlib
import io
import json
import tarfile
import zipfile

import pytest
import yaml
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringEndsWith, StringStartsWith

from bundlelens.operators import groups, kb
from bundlelens.plans import analysis
from bundlelens.sources import bundles, reader
from tests.fixtures import MACHINES, STORAGE


def tar(files, mode="w:gz", extra=()):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, text in [*files.items(), *extra]:
            data = text.encode() if isinstance(text, str) else text
            i = tarfile.TarInfo(name)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
    return out.getvalue()


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.fixture(scope="module")
def members(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("bundles")
    (d / "one.tar.gz").write_bytes(tar({f"b/{k}": v for k, v in STORAGE.items()}))
    (d / "two.zip").write_bytes(zipped({f"b/{k}": v for k, v in MACHINES.items()}))
    inner = zipped({"a/deep.log": "deep\n"})
    (d / "three.tar.xz").write_bytes(tar({"b/in.zip": inner, "b/in/here.txt": "x", "b/bin.dat": b"\0\1\2", "b/bad.yaml": "a: [1\n", "b/broken.zip": b"no zip"}, "w:xz"))
    (d / "four.tar").write_bytes(tar({"../up": "x"}, "w"))
    (d / "five.zip").write_bytes(b"not an archive")
    (d / "ignored.txt").write_text("x")
    found = bundles.archives(spark, str(d))
    found = found.withColumn("bundle_id", F.col("name"))  # ids of our own choice
    assert {(r.name, r.kind) for r in found.collect()} == {("one", "tar"), ("two", "zip"), ("three", "tar"), ("four", "tar"), ("five", "zip")}
    path = str(tmp_path_factory.mktemp("members"))
    bundles.expand(found).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_expansion(members):
    assert {r.bundle_id for r in bundles.rejected(members).collect()} == {"four", "five"}
    assert {(r.path, r.status, r.reason) for r in bundles.expansions(members).collect()} == {("b/in.zip", "expanded", "1"), ("b/broken.zip", "skipped", "list-failed")}
    index = {(r.bundle_id, r.path): r for r in bundles.bundle_files(members).collect()}
    assert index["three", "b/in.contents/a/deep.log"].type == "file" and index["three", "b/in.contents"].type == "directory"
    assert index["three", "b/bin.dat"].is_binary and not [k for k in index if k[0] in ("four", "five")]
    sums = {r.bundle_id: r for r in members.where("type = 'checksum'").collect()}
    assert len(sums) == 5 and all(len(r.reason) == 64 for r in sums.values())
    assert bundles.resources(members).where("error is not null").select("bundle_id", "path").collect() == [("three", "b/bad.yaml")]


def test_archives_of_one_name_are_bundles_of_their_own(spark, tmp_path):
    for folder, version in (("a", "v0"), ("b", "v1")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "support-bundle.zip").write_bytes(zipped({"x/metadata.yaml": f"kubernetesversion: v9\nkubernetesversion: {version}\n", "x/logs/x.log": f"only {version}\n"}))
    found = bundles.archives(spark, str(tmp_path))
    m = bundles.expand(found).cache()
    ids = {r.bundle_id: r.uri.split("/")[-2] for r in found.collect()}
    assert len(ids) == 2 and {r.name for r in found.collect()} == {"support-bundle"} and {bundles.bundle_of(r.uri) for r in found.collect()} == set(ids)
    assert {(ids[r.bundle_id], r["metadata"]["kubernetesversion"]) for r in bundles.key_values(m).collect()} == {("a", "v0"), ("b", "v1")}
    assert sorted((ids[r.bundle_id], r.line_no, r.line) for r in bundles.log_lines(m).collect() if r.path.endswith("x.log")) == [("a", 1, "only v0"), ("b", 1, "only v1")]
    registry = found.select("bundle_id", F.lit("longhorn").alias("product_type"))
    a = analysis.analyse(spark, registry, m, "longhorn")
    assert {ids[r.bundle_id] for r in analysis.reports(registry, a, bundles.bundle_files(m)).collect()} == {"a", "b"}


def content_of(rows):
    return sorted((r.path, r.type, r.is_binary, r.part, r.first_line, r.content, r.status, r.reason) for r in rows if r.type != "checksum")


def test_a_large_zip_is_read_by_several_tasks_and_each_byte_once(spark, tmp_path, monkeypatch):
    inner = zipped({"deep.log": "deep\n"})
    data = zipped({f"b/logs/{k}.log": f"line {k}\n" * 300 for k in range(50)} | {"b/in.zip": inner, "b/bin.dat": b"\0" * 9})
    (tmp_path / "big.zip").write_bytes(data)
    (tmp_path / "small.tar.gz").write_bytes(tar({"b/x.log": "x\n"}))
    found = bundles.archives(spark, str(tmp_path))
    whole = bundles.expand(found).collect()
    pieces = bundles.expand(found, piece=len(data) // 4)
    assert pieces.rdd.getNumPartitions() >= 6
    assert sorted(content_of(whole)) == sorted(content_of(pieces.collect()))
    sums = lambda rows: {(r.bundle_id, r.reason, r.size) for r in rows if r.type == "checksum"}
    assert sums(whole) == sums(pieces.collect())
    assert {h for _, h, n in sums(whole) if n == len(data)} == {hashlib.sha256(data).hexdigest()}
    read = []
    real = bundles.Hashed.readinto
    monkeypatch.setattr(bundles.Hashed, "readinto", lambda self, b: read.append(real(self, b)) or read[-1])
    list(bundles.rows_of_archive(str(tmp_path / "big.zip"), "b"))
    assert len(data) <= sum(read) < len(data) + 70_000  # the directory at the end, once more


def test_filters_reach_the_reader_and_unwanted_members_are_not_inflated(spark, tmp_path, monkeypatch):
    inner = zipped({"deep.log": "deep\n", "other.txt": "o"})
    files = {f"b/logs/{k}.log": f"line {k}\n" for k in range(20)} | {"b/yamls/pods.yaml": "items: []\n", "b/in.zip": inner, "b/bin.dat": b"\0" * 100_000}
    (tmp_path / "one.zip").write_bytes(zipped(files))
    (tmp_path / "two.tar").write_bytes(tar(files, "w"))
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    full = bundles.expand(bundles.archives(spark, str(tmp_path)))
    m = reader.read_members(spark, str(tmp_path))
    assert content_of(m.collect()) == content_of(full.collect())
    for where in ("path = 'b/logs/3.log'", "path like '%.log'", "path like 'b/in/%'", "path like '%yaml%'", "path in ('b/bin.dat', 'b/in')", "is_binary = false", "is_binary = true", "path like '%.log' and is_binary = false", "type = 'error'"):
        assert content_of(m.where(where).collect()) == content_of(full.where(where).collect()), where
    own = bundles.bundle_of(str(tmp_path / "one.zip"))
    assert {r.bundle_id for r in m.where(F.col("bundle_id") == own).collect()} == {own}
    opened = []
    real = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, member, *a, **k: opened.append(getattr(member, "filename", member)) or real(self, member, *a, **k))

    def read(*filters):
        opened.clear()
        r = reader.MemberReader({"path": str(tmp_path / "one.zip")})
        assert list(r.pushFilters(list(filters))) == list(filters)
        return [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]

    assert len(read(EqualTo(("path",), "b/logs/3.log"))) == 1 and opened == ["b/logs/3.log"]
    assert len(read(StringEndsWith(("path",), ".yaml"))) == 3 and opened[:2] == ["b/yamls/pods.yaml", "b/in.zip"] and not [x for x in opened if x.startswith("b/logs")]  # a nested archive is checked as a whole
    assert len([x for x in read(StringStartsWith(("path",), "b/in/")) if x["content"]]) == 2 and "b/logs/1.log" not in opened


def in_parts(spark, files, size):
    """Files as text members whose parts are whole lines of about `size` characters."""
    rows = []
    for path, text in files.items():
        part, line, at = 0, 1, 0
        while at < len(text) or not at:
            end = text.rfind("\n", at, at + size) + 1 or (text.find("\n", at) + 1 or len(text))
            end = len(text) if at + size >= len(text) else end
            rows.append(("b", path, "file", False, part, line, text[at:end]))
            part, line, at = part + 1, line + text[at:end].count("\n"), end
            if at >= len(text):
                break
    return spark.createDataFrame(rows, "bundle_id string, path string, type string, is_binary boolean, part int, first_line long, content string").repartition(3)


def test_lists_are_parsed_by_runs_of_items(spark):
    item = lambda k, tab="": f"{tab}- apiVersion: v1\n{tab}  kind: Pod\n{tab}  metadata:\n{tab}    name: p{k}\n{tab}    note: |\n{tab}      - no item\n{tab}      items:\n{tab}  status:\n{tab}    conditions:\n{tab}    - type: Ready\n{tab}      status: \"{k}\"\n"
    many = "".join(item(k) for k in range(40))
    files = {
        "list.yaml": "apiVersion: v1\nitems:\n" + many + "kind: List\nargs:\n- no item\n",
        "deep.yaml": "apiVersion: v1\nitems:\n# said\n\n" + "".join(item(k, "  ") for k in range(30)) + "kind: List\n",
        "bare.yaml": "---\n# said\n" + many,
        "two.yml": "items:\n" + many + "---\nother: x\nitems:\n" + item(40) + item(41),
        "crlf.yaml": ("items:\n" + many).replace("\n", "\r\n"),
        "one.yaml": "kind: Settings\nmetadata:\n  name: s\nvalue: '3'\n", "docs.yaml": "kind: A\n---\nkind: B\n", "empty.yaml": "items: []\n", "none.yaml": "", "bad.yaml": "a: [1\n",
        "long.yaml": "items:\n" + item(0) + "- kind: Long\n  text: |\n" + "    words and words\n" * 500 + item(2),
    }
    whole = {}
    for path, text in files.items():
        try:
            whole[path] = [i for d in yaml.load_all(text, yaml.BaseLoader) for i in (d.get("items", [d]) if isinstance(d, dict) else d or []) if isinstance(i, dict)]
        except yaml.YAMLError:
            whole[path] = None
    for size in (60, 700, 10_000_000):
        parts = in_parts(spark, files, size)
        got = {}
        for r in bundles.resources(parts).collect():
            got.setdefault(r.path, []).append((r.item_no, None if r.error else json.loads(r.text)))
        for path, items in whole.items():
            if items is None:
                assert got[path] == [(-1, None)]
            else:
                assert sorted(got.get(path, []), key=lambda x: x[0]) == list(enumerate(items)), (path, size)
    runs = bundles.item_runs(bundles.text_files(in_parts(spark, {"l.yaml": "items:\n" + many * 20}, 2000))).collect()
    assert sum(len(r.content) for r in runs) == 20 * len(many) and max(len(r.content) for r in runs) < 2000


def test_a_bad_item_is_one_row(spark):
    text = "items:\n- kind: A\n- kind: [B\n- kind: C\n  a: 1\n- kind: D\n"
    for size in (10, 10_000):
        got = {r.item_no: r.kind for r in bundles.resources(in_parts(spark, {"x.yaml": text}, size)).collect()}
        assert got == {0: "A", 1: None, 2: "C", 3: "D"}


def test_lines_metadata_alerts(members):
    lines = bundles.log_lines(members).where("bundle_id = 'one' and path like '%manager.log'")
    got = {r.line_no: r.line for r in lines.collect()}
    assert got[3].startswith("Observed") and 2 not in got and got[12005] == "panic=late"
    meta = {r.bundle_id: r["metadata"] for r in bundles.key_values(members).collect()}
    assert meta["one"]["kubernetesversion"] == "v1.30.1" and meta["two"]["bundlename"] == "two"
    assert bundles.alerts(members).where("valid").count() == 2


def test_long_files_and_rejected_bundles(spark, tmp_path):
    alerts = [{"Labels": {"alertname": f"a{k}", "severity": "warning"}, "Annotations": {"summary": "s" * 200}, "State": "firing"} for k in range(9000)]
    (tmp_path / "long.tar.gz").write_bytes(tar({"b/prometheus-alerts.json": json.dumps(alerts, indent=2), "b/metadata.yaml": "".join(f"k{i}: {'v' * 90}\n" for i in range(20_000)) + "kubernetesversion: v9\n"}))
    (tmp_path / "bad.tar").write_bytes(tar({"b/yamls/namespaced/x/v1/events.yaml": "items:\n- kind: Event\n", "b/logs/longhorn-system/longhorn-manager-a/m.log": "panic=1\n", "b/prometheus-alerts.json": "[]x", "../up": "x"}, "w"))
    m = bundles.expand(bundles.archives(spark, str(tmp_path)).withColumn("bundle_id", F.col("name"))).cache()
    assert m.where("path like '%alerts.json' and part > 0").count() > 1
    assert bundles.alerts(m).where("valid").count() == 9000 and bundles.alerts(m).where("not valid").count() == 0
    assert bundles.key_values(m).first()["metadata"]["kubernetesversion"] == "v9"
    assert [r.bundle_id for r in bundles.rejected(m).collect()] == ["bad"]
    for rows in (bundles.bundle_files(m), bundles.log_lines(m), bundles.resources(m), bundles.alerts(m)):
        assert rows.where("bundle_id = 'bad'").count() == 0


def test_a_condition_alone_makes_no_volume_group(spark):
    found = spark.createDataFrame([("b", "longhorn-volume-v-restore", "warning", "Longhorn Volume", "t", ["e"], 1, "p")], "bundle_id string, id string, severity string, category string, title string, evidence array<string>, count long, path string")
    none = spark.createDataFrame([("b", "volumes", "unhealthy", 0)], "bundle_id string, area string, metric string, value long")
    some = spark.createDataFrame([("b", "volumes", "unhealthy", 1), ("b", "volumes", "total", 4)], "bundle_id string, area string, metric string, value long")
    assert groups.finding_groups(spark, found, none, "longhorn").count() == 0
    [g] = groups.finding_groups(spark, found, some, "longhorn").collect()
    assert g.group_id == "longhorn-volume-replica-health" and g.affected == ["Unhealthy volumes: 1", "Total volumes: 4"] and g.related_ids == ["longhorn-volume-v-restore"]


def values(df):
    out = {}
    for r in df.collect():
        out[r.bundle_id, r.area, r.metric] = out.get((r.bundle_id, r.area, r.metric), 0) + (r.value or 0)
    return out


def test_storage_bundle(spark, members):
    registry = spark.createDataFrame([("one", "longhorn"), ("empty", "longhorn"), ("two", "harvester"), ("three", "other")], "bundle_id string, product_type string")
    a = analysis.analyse(spark, registry, members, "longhorn")
    ids = {r.id: r for r in a.findings.collect()}
    assert {"longhorn-volume-pvc-1-faulted", "longhorn-volume-pvc-1-restore", "longhorn-replica-r-1-stopped", "longhorn-node-node-1-multipathd", "longhorn-node-node-1-disk-fast-ready", "longhorn-node-node-1-disk-fast-schedulable", "longhorn-pod-csi-1-pending", "longhorn-pods-with-container-restarts", "longhorn-warning-events", "longhorn-bundle-generation-errors", "longhorn-manager-observed-panic", "longhorn-log-error-lines", "longhorn-alert-volume-degraded"} == set(ids)
    assert ids["longhorn-volume-pvc-1-faulted"].severity == "critical" and ids["longhorn-node-node-1-disk-fast-ready"].severity == "critical"
    assert ids["longhorn-pods-with-container-restarts"].severity == "warning" and ids["longhorn-bundle-generation-errors"]["count"] == 2
    panic = ids["longhorn-manager-observed-panic"]
    assert panic["count"] == 2 and [r.lineStart for r in panic.evidence_refs] == [3, 12005]
    assert "Storage available: 10" in ids["longhorn-node-node-1-disk-fast-ready"].evidence
    v = values(a.inventory)
    assert v["one", "volumes", "unhealthy"] == 1 and v["one", "nodes", "diskIssues"] == 2 and v["one", "nodes", "nodesWithDiskIssues"] == 1 and v["one", "pods", "withRestarts"] == 1
    severities = {r.group_id: r.severity for r in a.groups.collect()}
    assert severities == {"longhorn-manager-stability": "critical", "longhorn-volume-replica-health": "critical", "longhorn-node-prerequisites": "critical", "longhorn-pod-restarts": "warning", "longhorn-monitoring-alerts": "warning", "longhorn-collection-gaps": "warning"}
    summary = {r.bundle_id: r.total for r in a.summary.collect()}
    assert summary == {"one": 13, "empty": 0}
    assert v["empty", "volumes", "total"] == v["empty", "logs", "matchedLines"] == 0
    told = {r.group_id: r for r in a.groups.collect()}
    assert told["longhorn-manager-stability"].affected[0] == "Panics: 2" and told["longhorn-manager-stability"].title == "Manager panics"
    assert told["longhorn-volume-replica-health"].affected == ["Unhealthy volumes: 1", "Replicas not running: 1", "Total volumes: 2", "Total replicas: 1"]
    assert {r.bundle_id: r.version for r in a.versions.collect()} == {"one": "v1.8.1"}
    assert analysis.analyse(spark, registry, members, "other") is None


def test_machine_bundle_reports_and_search(spark, members, tmp_path):
    registry = spark.createDataFrame([("one", "longhorn"), ("two", "harvester")], "bundle_id string, product_type string")
    a = analysis.analyse(spark, registry, members, "harvester")
    found = a.findings.cache()
    ids = {r.id: r for r in found.collect()}
    assert {"harvester-node-node-a-ready", "harvester-node-node-a-diskpressure", "harvester-node-node-a-ntp-unsynced", "harvester-apps-not-deployed", "harvester-addons-not-ready", "harvester-kubevirt-not-ready", "harvester-vm-images-not-imported", "harvester-vms-not-ready", "harvester-vmis-not-running", "harvester-vm-migrations-failed", "harvester-vlan-status-not-ready", "harvester-pods-with-container-restarts", "harvester-warning-events", "harvester-bundle-generation-errors", "harvester-log-webhook-errors", "harvester-log-error-lines", "harvester-longhorn-volumes-unhealthy", "harvester-longhorn-replicas-not-running", "harvester-longhorn-node-disk-issues", "harvester-longhorn-replica-scheduling-storage"} == set(ids)
    assert ids["harvester-vms-not-ready"].severity == "critical" and ids["harvester-longhorn-node-disk-issues"].severity == "critical" and ids["harvester-pods-with-container-restarts"].severity == "info"
    v = values(a.inventory)
    assert v["two", "nodes", "withIssues"] == 1 and v["two", "workloads", "vms"] == 2 and v["two", "workloads", "vmIssues"] == 1 and v["two", "workloads", "vmsStopped"] == 1 and v["two", "storage", "diskIssues"] == 2 and v["two", "storage", "replicaSchedulingLogMatches"] == 1
    [w] = a.workloads.collect()
    assert (w.name, w.namespace, w.severity, w.node_name, w.desired_node_names, w.event_count) == ("vm-a", "default", "critical", "node-a", ["node-b"], 1)
    assert "ubuntu.qcow2" in w.image_names and "default/vlan-a" in w.network_names and w.paths["vm"].endswith("virtualmachines.yaml")
    assert {"harvester-vms-not-ready", "harvester-vmis-not-running", "harvester-vm-migrations-failed", "harvester-vm-images-not-imported", "harvester-vlan-status-not-ready", "harvester-warning-events", "harvester-log-webhook-errors"} <= set(w.related_ids)
    related = {r.group_id: r.related_ids for r in a.groups.collect()}
    assert {"harvester-control-plane-health", "harvester-virtualization-readiness", "harvester-vm-workload-health", "harvester-network-health", "harvester-storage-health", "harvester-node-health", "harvester-platform-events-and-logs", "harvester-collection-gaps"} == set(related)
    assert set(related["harvester-platform-events-and-logs"]) == {"harvester-warning-events", "harvester-log-error-lines"}
    version = a.versions.first()
    assert version.version == "v1.5.1" and version.components[0].component == "harvester"
    told = {r.group_id: r.affected for r in a.groups.collect()}
    assert told["harvester-vm-workload-health"] == ["VMs with issues: 1", "VMIs not running: 1", "Failed migrations: 1"]
    assert told["harvester-platform-events-and-logs"] == ["Warning events: 1", "Harvester log error lines: 1"]
    r = analysis.reports(registry, a, bundles.bundle_files(members)).collect()
    assert [x.bundle_id for x in r] == ["two"] and len(r[0].findings) == 20 and r[0].findings[0].severity == "critical" and r[0].files == len(MACHINES)
    pages = spark.createDataFrame([("http://k/kb/a-panic", "<h1>Webhook fails</h1><article><p>" + "harvester webhook control plane validator 502 bad gateway. " * 9 + "</p></article>"), ("http://k/kb/other", "<h1>Cooking</h1><article><p>" + "soup and bread recipes for the evening. " * 9 + "</p></article>")], "url string, html string")
    docs = kb.documents(pages, "url", "html", F.lit("text/html"))
    chunks = kb.embedded(kb.chunks(docs), 64)
    q = analysis.kb_queries(spark, a.groups, found, registry, bundles.key_values(members))
    best = {x.group_id: x.related_kb for x in analysis.enriched(spark, q, chunks, docs, 64).collect()}
    assert best["harvester-control-plane-health"][0].title == "Webhook fails"
    bundles.sink_index(chunks, str(tmp_path / "index"))
    back = spark.read.parquet(str(tmp_path / "index"))
    assert kb.visible(back, "local-hash-v1", "fnv1a", 64).count() == 2 and kb.visible(back, "local-hash-v1", "fnv1a", 256).count() == 0
    bundles.sink_reports(analysis.reports(registry, a, bundles.bundle_files(members)), str(tmp_path / "reports"))
    assert spark.read.json(str(tmp_path / "reports")).count() == 1
