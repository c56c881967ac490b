"""Resources of many files: files dealt by rows, lists in plain YAML, batches of bounded size."""

import json
import random

import yaml
from pyspark.sql import functions as F

from bundlelens.plans import fleet
from bundlelens.sources import bundles


def test_plain_lists_are_as_the_loader_has_them():
    rng = random.Random(5)
    lines = ["a: x", "a:", "b:", 'b: "q r"', "c: 'z'", "x", "y z", "a: b: c", "a:b", "k: 1:2", "k: a #b", "d: 12:30:00Z", "a: x:", "---", "k: -", '"a b"', "'a': b", "k: &x y", "k: [a]", "k: é"]
    taken = 0
    for _ in range(20_000):
        text = "- a: 1\n" + "\n".join(" " * rng.choice([0, 0, 2, 2, 4]) + rng.choice(["", "- ", "- - "]) + rng.choice(lines) for _ in range(rng.randrange(1, 6)))
        if (got := bundles.plain_items(text)) is not None:
            assert got == yaml.load(text, yaml.CBaseLoader), text
            taken += 1
    assert taken > 500
    assert bundles.plain_items('- kind: A\n  status:\n    conditions:\n    - type: Ready\n      status: "True"\n  spec:\n- kind: B\n') == [{"kind": "A", "status": {"conditions": [{"type": "Ready", "status": "True"}]}, "spec": ""}, {"kind": "B"}]


def test_small_files_share_batches(spark):
    text = 'apiVersion: v1\nitems:\n- kind: A\n  metadata:\n    name: n-{}\n  status:\n    conditions:\n    - type: Ready\n      status: "False"\n'
    rows = [(f"b{k}", "x/a.yaml", "file", False, 0, 1, text.format(k)) for k in range(300)]
    m = spark.createDataFrame(rows, "bundle_id string, path string, type string, is_binary boolean, part int, first_line long, content string").coalesce(1)
    r = bundles.resources(m)
    batches = r.mapInArrow(lambda x: (b.slice(0, 1).select(["bundle_id"]) for b in x), "bundle_id string")
    assert batches.count() <= 16  # one for each task at most, not one for each file
    got = {x.bundle_id: x for x in r.collect()}
    assert len(got) == 300 and all(got[f"b{k}"].name == f"n-{k}" and got[f"b{k}"].item_no == 0 for k in range(300))
    assert json.loads(got["b7"].text) == {"kind": "A", "metadata": {"name": "n-7"}, "status": {"conditions": [{"type": "Ready", "status": "False"}]}}
    assert json.loads(got["b7"].status) == json.loads(got["b7"].text)["status"] and got["b7"].conditions[0].status == "False"


def test_scattered_rows_fill_files(spark, tmp_path):
    n = 3 * fleet.ITEMS
    o = spark.range(n).select((F.col("id") * 5000).alias("o_orderkey"), (F.col("id") % 500).alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    o.write.parquet(f"{tmp_path}/orders.parquet")
    m = fleet._migrations(spark, str(tmp_path))
    assert m.count() <= 3  # as many as the rows fill, though each row's number lies far from the next
    assert fleet.migration_issues(spark, str(tmp_path)).select("name").distinct().count() == n


def test_items_of_one_shape_are_read_by_it(monkeypatch):
    """Rows of plain items are those of the loader, and only items of a new shape or with empty values are parsed line by line."""
    rng = random.Random(5)
    values = ["a", "vm-1", "x: y", "a b", "1", "true", "100%", "", "null", "w/x:z", "%s", "{}", "<0>"]

    def value():
        v = rng.choice(values)
        q = rng.choice(["", '"', "'"])
        q = q or ('"' if v in ("", "x: y", "{}", "<0>", "%s", "100%") else "")
        return f"{q}{v}{q}"

    def item(pad):
        x = [f"- kind: {value()}", "  metadata:", f"    name: {value()}", f"  value: {value()}"]
        x += ["  status:", f"    phase: {value()}"] * rng.randrange(2)
        x += (["    conditions:"] + [f"    - type: {value()}\n{pad}      status: {value()}" for _ in range(rng.randrange(1, 3))]) if len(x) == 6 and rng.randrange(2) else []
        x += ["  tags:", f"  - {value()}", "  -"[:3] + f" {value()}"] * rng.randrange(2)
        x += ["  kind: again"] * (rng.randrange(9) == 0) + ["  empty:"] * (rng.randrange(5) == 0)
        return "".join(f"{pad}{line}\n" for line in x)

    def rows(content):
        return list(bundles._parsed(("b", "p", *run) for run in bundles._runs_of_file(content)))

    for k in range(300):
        pad = rng.choice(["", "  "])
        content = "items:\n" + "".join(item(pad) if rng.randrange(20) else f"{pad}- {value()}\n" for _ in range(rng.randrange(1, 30)))
        got = rows(content)
        with monkeypatch.context() as m:
            m.setattr(bundles, "_shaped", lambda *a: None)
            assert got == rows(content), content
        with monkeypatch.context() as m:
            m.setattr(bundles, "SHAPES", k % 3)
            assert got == rows(content), content
    read = []
    monkeypatch.setattr(bundles, "plain_items", lambda content: read.append(content))
    assert len(rows("items:\n" + "".join(f"- kind: V\n  metadata:\n    name: o-{k}\n  status:\n    phase: p{k % 7}\n" for k in range(500)))) == 500 and not read


def test_a_list_that_begins_behind_the_first_part(spark):
    parts = [("b", "x.yaml", "file", False, k, 1, c) for k, c in enumerate(["# said\n", "items:\n- kind: A\n- kind: [B\n", "- kind: C\n"])]
    m = spark.createDataFrame(parts, "bundle_id string, path string, type string, is_binary boolean, part int, first_line long, content string")
    assert {r.item_no: r.kind for r in bundles.resources(m).collect()} == {0: "A", 1: None, 2: "C"}
