"""Checks over resources: one parse of a field, few scans, rows that stay where they are."""

import json
import re

import pytest

from bundlelens.operators import checks, defaults
from bundlelens.sources import bundles

LONGHORN = "b/yamls/namespaced/longhorn-system/"


def plan(df) -> str:
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def resources(spark, tmp_path):
    def make(*items):
        rows = []
        for k, (bundle, path, item) in enumerate(items):
            of = lambda name, item=item: item[name] if isinstance(item.get(name), dict) else {}
            cond = [{c: x.get(c) for c in ("type", "status", "reason", "message")} for x in of("status").get("conditions", [])]
            rows.append((bundle, path, k, None, item.get("kind"), of("metadata").get("namespace"), of("metadata").get("name"), json.dumps(item), json.dumps(of("metadata")), json.dumps(of("spec")), json.dumps(of("status")), item.get("value"), cond, None))
        spark.createDataFrame(rows, bundles.RESOURCE).write.parquet(str(tmp_path / "r"))
        return spark.read.parquet(str(tmp_path / "r"))

    return make


def test_a_state_is_parsed_once_a_row(resources):
    volumes, replicas, other = (LONGHORN + x for x in ("longhorn.io/v1beta2/volumes.yaml", "longhorn.io/v1beta2/replicas.yaml", "x/longhorn-system/longhorn.io/v1beta2/none.yaml"))
    restore, ro = ({"type": t, "status": "True"} for t in ("Restore", "FilesystemReadOnly"))
    r = resources(
        ("one", volumes, {"metadata": {"name": "V_1 "}, "status": {"robustness": "degraded", "conditions": [restore, {"type": "Restore", "status": "False"}]}}),
        ("one", volumes, {"metadata": {"name": "v2"}, "status": {"robustness": " "}}),
        ("one", volumes, {"status": {"robustness": "faulted"}}),
        ("two", "z" + volumes, {"metadata": {"name": "of another file"}, "status": {"robustness": "faulted"}}),
        ("two", volumes, {"metadata": {"name": "v3"}, "status": {"robustness": "null"}}),
        ("one", replicas, {"metadata": {"name": "-r-"}, "status": {"currentState": "error", "conditions": [ro]}}),
        ("one", replicas, {"metadata": {"name": "r2"}, "status": {}}),
        ("one", other, {"metadata": {"name": "n"}, "status": {"robustness": "faulted"}}),
    )
    rules = defaults.LONGHORN_RULES["conditions"]["rules"]
    found, inv = checks.volume_findings(r, rules)
    assert {(x.bundle_id, x.id, x.severity, tuple(x.evidence)) for x in found.collect()} == {
        ("one", "longhorn-volume-v-1-degraded", "warning", ("Robustness: degraded",)),
        ("one", "longhorn-volume-v-1-restore", "warning", ("Type: Restore", "Status: True")),
        ("one", "longhorn-volume-unknown-volume-faulted", "critical", ("Robustness: faulted",)),
    }
    assert {(x.bundle_id, x.metric, x.value) for x in inv.collect()} == {("one", "total", 3), ("one", "unhealthy", 2), ("two", "total", 1), ("two", "unhealthy", 0)}
    on_replicas, _ = checks.replica_findings(r, rules)
    assert {(x.id, x.severity) for x in on_replicas.collect()} == {("longhorn-replica-r-error", "warning"), ("longhorn-replica-r-filesystemreadonly", "critical")}
    for f in (found, on_replicas):
        parsed = re.findall(r"get_json_object\(([^)]*)\)", plan(f))
        assert parsed and len(set(parsed)) == len(parsed)


def test_restarts_of_a_pod_stay_in_its_row(resources):
    pods = LONGHORN + "v1/pods.yaml"
    r = resources(
        ("one", pods, {"metadata": {"name": "p"}, "status": {"phase": "Running", "initContainerStatuses": [{"name": "i", "restartCount": "2"}], "containerStatuses": [{"restartCount": "11"}, {"name": "c", "restartCount": "x"}, None, {"name": "d", "restartCount": "0"}, {"name": "d", "restartCount": "1"}]}}),
        ("one", pods, {"metadata": {"name": "q"}, "status": {"phase": "Pending", "containerStatuses": []}}),
        ("one", pods, {"metadata": {"name": "s"}, "status": {"containerStatuses": [{"name": "c", "restartCount": "1"}]}}),
        ("two", pods, {"status": {"phase": "Succeeded", "containerStatuses": [{"name": "c", "restartCount": "4"}]}}),
    )
    found, inv = checks.pods(r, checks.LH, "longhorn", "Longhorn Pod", 6)
    assert {(x.bundle_id, x.id, x.severity, x["count"], tuple(x.evidence)) for x in found.collect()} == {
        ("one", "longhorn-pod-q-pending", "warning", 1, ("Phase: Pending",)),
        ("one", "longhorn-pods-with-container-restarts", "warning", 2, ("p: i=2, container=11, d=1", "s: c=1")),
        ("two", "longhorn-pods-with-container-restarts", "info", 1, ("unknown pod: c=4",)),
    }
    assert {(x.bundle_id, x.metric, x.value) for x in inv.collect()} == {("one", "total", 3), ("one", "notRunning", 1), ("one", "withRestarts", 2), ("two", "total", 1), ("two", "notRunning", 0), ("two", "withRestarts", 1)}
    assert "posexplode" not in plan(found)


def test_types_of_events_are_parsed_once_a_scan(resources):
    events = "b/yamls/namespaced/x/v1/events.yaml"
    r = resources(
        ("one", events, {"type": "Warning", "reason": "r", "message": "null", "note": "n"}),
        ("one", events, {"type": "Normal", "reason": "r"}),
        ("one", events, {"type": "Warning"}),
        ("two", events, {"reason": "r"}),
    )
    found, inv = checks.events(r, "", "harvester", False)
    assert [(x.bundle_id, x["count"], x.evidence) for x in found.collect()] == [("one", 2, ["r: n", "Warning: Warning event"])]
    assert {(x.bundle_id, x.metric, x.value) for x in inv.collect()} == {("one", "total", 3), ("one", "warnings", 2), ("two", "total", 1), ("two", "warnings", 0)}
    assert plan(found).count("$.type") == plan(found).count("FileScan")


def test_versions_take_one_scan(resources):
    label = lambda **x: {"metadata": {"labels": {"app.kubernetes.io/name": "longhorn", **x}}}
    image = lambda *x: {"metadata": {"name": "d"}, "spec": {"containers": [{"image": i} for i in x]}}
    r = resources(
        ("one", LONGHORN + "longhorn.io/v1beta2/settings.yaml", {"metadata": {"name": "current-longhorn-version"}, "value": "v1.8.1"}),
        ("one", LONGHORN + "longhorn.io/v1beta2/settings.yaml", {"metadata": {"name": "other"}, "value": "v9.9.9"}),
        ("one", LONGHORN + "v1/configmaps.yaml", label(**{"app.kubernetes.io/version": "1.8.2", "helm.sh/chart": "longhorn-1.8.3"})),
        ("one", LONGHORN + "apps/v1/deployments.yaml", {"metadata": {"labels": {"app.kubernetes.io/name": "no", "app.kubernetes.io/version": "7.7.7"}, "annotations": {"driver.longhorn.io/version": "v1.8.4"}}}),
        ("one", LONGHORN + "longhorn.io/v1beta2/engineimages.yaml", {"status": {"version": "v1.8.5"}}),
        ("one", LONGHORN + "v1/pods.yaml", image("longhornio/longhorn-manager:v1.8.6", "longhornio/longhorn-manager:v1.8.6", "rancher/mirrored-longhornio-longhorn-ui:1.8.7", "longhornio/other:v1.0.0", "x/longhorn-manager:v1.0.1")),
        ("two", LONGHORN + "v1/services.yaml", image("longhornio/longhorn-manager:v1.8.6")),
        ("two", "z" + LONGHORN + "apps/v1/deployments.yaml", image("longhornio/longhorn-engine:v1.0.2")),
        ("two", LONGHORN + "apps/v1/deployments.yaml", image("longhornio/longhorn-engine:v1.8.8-rc1")),
    )
    found = checks.versions(r, "longhorn")
    assert sorted((x.bundle_id, x.priority, x.version, x.component, x.source) for x in found.collect()) == [
        ("one", 0, "v1.8.1", "longhorn", "Longhorn setting"),
        ("one", 1, "v1.8.2", "longhorn", "Kubernetes app label"),
        ("one", 2, "v1.8.3", "longhorn-chart", "Helm chart label"),
        ("one", 3, "v1.8.4", "longhorn-driver", "Longhorn driver annotation"),
        ("one", 4, "v1.8.6", "longhorn-manager", "longhorn-manager image"),
        ("one", 6, "v1.8.5", "longhorn-engine", "EngineImage status"),
        ("one", 8, "v1.8.7", "longhorn-ui", "longhorn-ui image"),
        ("two", 7, "v1.8.8-rc1", "longhorn-engine", "longhorn-engine image"),
    ]
    assert plan(found).count("FileScan") == 2  # the rows, and each bundle's first files
