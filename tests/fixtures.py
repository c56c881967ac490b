"""Two small bundles as text, made for these tests."""


def items(*docs: str) -> str:
    out = ["apiVersion: v1", "items:"]
    for d in docs:
        lines = d.strip("\n").split("\n")
        out += [f"- {lines[0]}"] + [f"  {x}" for x in lines[1:]]
    return "\n".join(out) + "\n"


def k8s(kind, name, rest="", namespace=None, api="v1", meta=""):
    ns = f"\n  namespace: {namespace}" if namespace else ""
    return f"apiVersion: {api}\nkind: {kind}\nmetadata:\n  name: {name}{ns}{meta}\n{rest}"


def cond(*pairs, indent=2):
    pad = " " * indent
    return f"{pad}conditions:\n" + "".join(f'{pad}- type: {t}\n{pad}  status: "{s}"\n{pad}  reason: {r}\n{pad}  message: {m}\n' for t, s, r, m in pairs)


LHS, HVS = "yamls/namespaced/longhorn-system", "yamls/namespaced/harvester-system"
STORAGE = {
    "metadata.yaml": 'bundlename: one\nkubernetesversion: "v1.30.1"\nissuedescription: volumes are slow\n',
    "bundleGenerationError.log": "all fine\nfailed to get x\nBUG: cannot get log\n",
    "prometheus-alerts.json": '[{"Labels": {"alertname": "Volume Degraded", "severity": "warning"}, "Annotations": {"summary": "a volume"}, "State": "firing"}, {"Labels": {"alertname": "Watchdog", "severity": "none"}, "State": "firing"}]',
    f"{LHS}/longhorn.io/v1beta2/settings.yaml": items(k8s("Setting", "current-longhorn-version", "value: 1.8.1")),
    f"{LHS}/longhorn.io/v1beta2/volumes.yaml": items(k8s("Volume", "pvc-1", "status:\n  robustness: faulted\n  state: detached\n" + cond(("Restore", "True", "Busy", "restoring"))), k8s("Volume", "pvc-2", "status:\n  robustness: healthy\n")),
    f"{LHS}/longhorn.io/v1beta2/replicas.yaml": items(k8s("Replica", "r-1", "status:\n  currentState: stopped\n")),
    f"{LHS}/longhorn.io/v1beta2/nodes.yaml": items(k8s("Node", "node-1", "status:\n" + cond(("Ready", "True", "Fine", "x"), ("Multipathd", "False", "Running", "multipathd is running")) + "  diskStatus:\n    d-1:\n      diskName: fast\n      diskPath: /var/d\n      storageAvailable: 10\n      storageMaximum: 100\n" + cond(("Ready", "False", "NoDiskInfo", "no disk"), ("Schedulable", "False", "Pressure", "full"), indent=6))),
    f"{LHS}/v1/pods.yaml": items(k8s("Pod", "manager-1", "status:\n  phase: Running\n  containerStatuses:\n  - name: manager\n    restartCount: 7\n"), k8s("Pod", "csi-1", "status:\n  phase: Pending\n")),
    f"{LHS}/v1/events.yaml": items(k8s("Event", "e-1", "type: Warning\nreason: Slow\nmessage: too slow\n"), k8s("Event", "e-2", "type: Normal\nreason: Fine\n")),
    "logs/longhorn-system/longhorn-manager-1/manager.log": "start\n\nObserved a panic: boom\nlevel=error msg=bad\n" + "ok\n" * 12000 + "panic=late\n",
    "logs/other/x.log": "Observed a panic elsewhere\n",
}
MACHINES = {
    "metadata.yaml": "bundlename: two\nkubernetesversion: v1.32.4+rke2r1\n",
    "bundleGenerationError.log": "Failed to get a\nodd line\n",
    f"{HVS}/catalog.cattle.io/v1/apps.yaml": items(k8s("App", "harvester", "status:\n  chart:\n    metadata:\n      version: 1.5.1\n  summary:\n    state: failed\n")),
    f"{HVS}/harvesterhci.io/v1beta1/versions.yaml": items(k8s("Version", "v1.6.1")),
    "yamls/cluster/v1/nodes.yaml": items(k8s("Node", "node-a", "status:\n" + cond(("Ready", "False", "Down", "kubelet is down"), ("DiskPressure", "Unknown", "x", "y")), meta="\n  annotations:\n    node.harvesterhci.io/ntp-service: '{\"ntpSyncStatus\":\"unsynced\"}'")),
    f"{HVS}/v1/pods.yaml": items(k8s("Pod", "api-1", "spec:\n  containers:\n  - image: rancher/harvester:v1.5.1\nstatus:\n  phase: Running\n  containerStatuses:\n  - name: api\n    restartCount: 2\n", meta="\n  labels:\n    app.kubernetes.io/name: harvester\n    app.kubernetes.io/version: v1.5.1")),
    f"{HVS}/harvesterhci.io/v1beta1/addons.yaml": items(k8s("Addon", "importer", "spec:\n  enabled: true\n  version: 1.5.1\nstatus:\n  status: AddonDeployFailed\n" + cond(("OperationFailed", "True", "x", "y")))),
    f"{HVS}/kubevirt.io/v1/kubevirts.yaml": items(k8s("KubeVirt", "kubevirt", "status:\n  phase: Deploying\n  observedKubeVirtVersion: 1.4.0\n" + cond(("Degraded", "True", "x", "y")))),
    "yamls/cluster/cdi.kubevirt.io/v1beta1/cdis.yaml": items(k8s("CDI", "cdi", "status:\n  phase: Deployed\n" + cond(("Available", "True", "x", "y")))),
    "yamls/namespaced/default/kubevirt.io/v1/virtualmachines.yaml": items(
        k8s("VirtualMachine", "vm-a", "spec:\n  running: true\n  template:\n    spec:\n      networks:\n      - name: n\n        multus:\n          networkName: default/vlan-a\n      nodeSelector:\n        kubernetes.io/hostname: node-b\n      volumes:\n      - dataVolume:\n          name: image-a\nstatus:\n  created: false\n  printableStatus: Unschedulable\n" + cond(("Ready", "False", "Unschedulable", "no node")), "default"),
        k8s("VirtualMachine", "vm-b", "spec:\n  runStrategy: Halted\nstatus:\n  printableStatus: Stopped\n", "default"),
    ),
    "yamls/namespaced/default/kubevirt.io/v1/virtualmachineinstances.yaml": items(k8s("VirtualMachineInstance", "vm-a", "status:\n  nodeName: node-a\n  phase: Pending\n" + cond(("Ready", "False", "Unschedulable", "no node")), "default")),
    "yamls/namespaced/default/kubevirt.io/v1/virtualmachineinstancemigrations.yaml": items(k8s("VirtualMachineInstanceMigration", "vm-a-move", "spec:\n  vmiName: vm-a\nstatus:\n  phase: Failed\n  migrationState:\n    sourceNode: node-a\n    targetNode: node-b\n", "default")),
    "yamls/namespaced/default/v1/events.yaml": items(k8s("Event", "w", "involvedObject:\n  kind: VirtualMachine\n  name: vm-a\n  namespace: default\ntype: Warning\nreason: FailedScheduling\nmessage: no nodes for vm-a\n", "default")),
    "yamls/namespaced/default/harvesterhci.io/v1beta1/virtualmachineimages.yaml": items(k8s("VirtualMachineImage", "image-a", "spec:\n  displayName: ubuntu.qcow2\nstatus:\n  failed: 2\n" + cond(("Imported", "False", "x", "y")))),
    "yamls/cluster/network.harvesterhci.io/v1beta1/vlanstatuses.yaml": items(k8s("VlanStatus", "vlan-a", "status:\n  clusterNetwork: vm-net\n  node: node-a\n" + cond(("ready", "False", "x", "link down")))),
    f"{LHS}/longhorn.io/v1beta2/volumes.yaml": items(k8s("Volume", "pvc-1", "status:\n  robustness: degraded\n")),
    f"{LHS}/longhorn.io/v1beta2/replicas.yaml": items(k8s("Replica", "r-1", "status:\n  currentState: stopped\n")),
    f"{LHS}/longhorn.io/v1beta2/nodes.yaml": STORAGE[f"{LHS}/longhorn.io/v1beta2/nodes.yaml"],
    "logs/harvester-system/virt-controller-a/c.log": 'x\nlevel=error failed calling webhook "validator": 502 Bad Gateway for vm-a\n',
    "logs/longhorn-system/longhorn-manager-a/m.log": "Precheck failed for new replica r: no disks found on node-a\n",
}
