"""What is broadcast: joins go by measured sizes, not by those that Spark estimates before a step runs."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from bundlelens.llm import merkle, simhash
from bundlelens.llm.common import ESTIMATED, MEASURED, _bytes, cut, settings


@contextmanager
def broadcast_rows(spark):
    """Rows of each broadcast of the block, filled in at its end."""
    state, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before, out = state.executionsCount(), []
    yield out
    bus.waitUntilEmpty()
    runs = state.executionsList()
    for k in range(before, runs.size()):
        run = runs.apply(k)
        values = state.executionMetrics(run.executionId())
        nodes = state.planGraph(run.executionId()).allNodes()
        for n in (nodes.apply(i) for i in range(nodes.size())):
            if n.name() == "BroadcastExchange":
                metrics = n.metrics()
                ids = [metrics.apply(i).accumulatorId() for i in range(metrics.size()) if metrics.apply(i).name() == "number of output rows"]
                out += [int(v.get().replace(",", "")) for v in (values.get(i) for i in ids) if v.isDefined()]


def test_a_table_is_measured_behind_an_explode(spark):
    few = cut(spark.range(60_000).select(F.xxhash64("id").alias("k")))
    many = few.select("k", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    with settings(spark, {ESTIMATED: "1m"}), broadcast_rows(spark) as sent:
        joined = cut(many.join(many.groupBy("k", "i").agg(F.count("*").alias("n")), ["k", "i"]))
        assert spark.conf.get(ESTIMATED) == "1m" and spark.conf.get(MEASURED, None) is None
    assert joined.count() == 1_200_000 and sent == []
    with broadcast_rows(spark) as sent:  # what is small by measure is still broadcast
        assert cut(few.join(few.groupBy("k").agg(F.count("*").alias("n")), "k")).count() == 60_000
    assert sent == [60_000]


def test_sizes_of_settings():
    assert [_bytes(x) for x in ("-1", "0", "10485760b", "256k", "1 MB", "2g")] == [-1, 0, 10 << 20, 256 << 10, 1 << 20, 2 << 30]


def test_settings_are_as_before(spark):
    with settings(spark, {MEASURED: "1m"}):
        with pytest.raises(ZeroDivisionError), settings(spark, {MEASURED: "2m", ESTIMATED: "-1"}):
            1 / 0  # noqa: B018
        assert spark.conf.get(MEASURED) == "1m" and spark.conf.get(ESTIMATED) != "-1"
    assert spark.conf.get(MEASURED, None) is None


def test_fingerprint_entries_are_not_broadcast(spark):
    rng = random.Random(3)
    fps = spark.createDataFrame([(k, " ".join(str(rng.random()) for _ in range(5))) for k in range(30_000)], "doc_id long, text string")
    with settings(spark, {ESTIMATED: "1m"}), broadcast_rows(spark) as sent:
        assert simhash.near_duplicates(fps, "doc_id", "text", 3).where("component_id is null").count() == 0
    assert max(sent, default=0) <= 60_000  # halves, not the 64 entries of each fingerprint


def test_proofs_are_not_broadcast(spark):
    rows = spark.range(150_000).select((F.col("id") % 3).cast("string").alias("grp"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    with settings(spark, {ESTIMATED: "1m"}), broadcast_rows(spark) as sent:
        out = merkle.manifest(rows).select(merkle.folded("steps", F.col("leaf")).alias("r"), "root").distinct().collect()
    assert len(out) == 1 and out[0].r == out[0].root
    assert max(sent, default=0) <= 10  # ranges of groups, not the 9375 runs
