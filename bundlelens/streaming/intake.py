"""Incremental intake of bundles: each is analysed once, copies are refused, states are a ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bundlelens.operators.files import new_bundles
from bundlelens.session import shared_dir, written

LEDGER = "bundle_id string, status string, stage string, at timestamp, error string, batch long"


def latest(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The last row of each key in the order given; the newest of a ledger is its state."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(by).alias("__by")).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def steps(bundles: DataFrame, status: str, stage: str, batch: int, error=None) -> DataFrame:
    return bundles.select("bundle_id", F.lit(status).alias("status"), F.lit(stage).alias("stage"), F.current_timestamp().alias("at"), (error if error is not None else F.lit(None).cast("string")).alias("error"), F.lit(batch).cast("long").alias("batch"))


def intake(stream: DataFrame, analyse: Callable[[DataFrame, int], DataFrame], root: str, checksum: str = "sha256", order: list[str] | None = None) -> StreamingQuery:
    """Run `analyse(new bundles, batch)` on each micro-batch of a stream with bundle_id and a
    checksum. Tables under root, each partitioned by batch so that a repeated batch replaces its
    own part: bundles (accepted), results, ledger. A copy of a bundle of an earlier batch, or of
    the same one, is refused. A row with an `error` in the results fails its bundle only, and so does an analysis that
    raises: the batch is then analysed in halves, and halves of those that raise, until the bad bundles are alone.
    """
    order = order or ["bundle_id"]

    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{root}/{name}")

    def known(spark: SparkSession, schema, batch: int) -> DataFrame:
        return spark.read.schema(f"{schema}, batch long").parquet(f"{root}/bundles").where(F.col("batch") < batch)

    def results(fresh: DataFrame, batch: int) -> DataFrame:
        """Bundles whose analysis raises are failed ones, not a stopped stream, and don't take others with them."""
        try:
            return written(analyse(fresh, batch), "results")
        except Exception as e:
            h = F.hash("bundle_id")  # 32 bits, which the median keeps exactly
            bounds = fresh.agg(F.min(h).alias("low"), F.percentile_approx(h, 0.5, 10_000).alias("middle"), F.max(h).alias("top")).first()
            if bounds.low == bounds.top:  # one bundle, or none
                return fresh.select("bundle_id", F.lit(f"{type(e).__name__}: {e}"[:500]).alias("error"))
            middle = min(bounds.middle, bounds.top - 1)
            low, high = (results(written(fresh.where(side), "half"), batch) for side in (h <= middle, h > middle))
            return low.unionByName(high, allowMissingColumns=True)

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        before = None
        if batch:
            before = known(spark, f"bundle_id string, {checksum} string", batch)
        fresh = new_bundles(df, before, checksum, order).withColumn("batch", F.lit(batch).cast("long"))
        put(fresh, "bundles")
        fresh = spark.read.schema(fresh.schema).parquet(f"{root}/bundles").where(F.col("batch") == batch)
        out = results(fresh.drop("batch"), batch)
        put(out.withColumn("batch", F.lit(batch).cast("long")), "results")
        refused = df.join(fresh.select("bundle_id"), "bundle_id", "left_anti")
        failed = out.where("error is not null").groupBy("bundle_id").agg(F.min("error").alias("error")) if "error" in out.columns else None
        done = fresh if failed is None else fresh.join(failed.select("bundle_id"), "bundle_id", "left_anti")
        ledger = steps(fresh, "queued", "received", batch).unionByName(steps(fresh, "running", "analysis", batch)).unionByName(steps(done, "completed", "report", batch)).unionByName(steps(refused, "failed", "intake", batch, F.lit("duplicate checksum")))
        if failed is not None:
            ledger = ledger.unionByName(steps(failed, "failed", "analysis", batch, F.col("error")))
        put(ledger, "ledger")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def job_states(ledger: DataFrame) -> DataFrame:
    """The last state of each bundle, later stages last among equal times."""
    rank = F.when(F.col("status") == "queued", 0).when(F.col("status") == "running", 1).otherwise(2)
    return latest(ledger.withColumn("__r", rank), "bundle_id", ["batch", "__r", "at"]).drop("__r")


def binary_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Archives as they land: path, length and time; the content isn't read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder).drop("content")


def intake_of_table(rows: DataFrame, checksum: str, key: str, parts: int = 3) -> DataFrame:
    """A table taken in as a stream that is started anew for each of about `parts` ranges of the
    key as they land: what intake() accepts of it, as (key, checksum). Of copies, in one
    batch or over several, the smallest key is accepted."""
    spark = rows.sparkSession
    root = shared_dir(spark, "intake")
    landed = rows.select(F.col(key).cast("string").alias("bundle_id"), F.col(checksum), F.col(key).alias("order"))
    schema = f"bundle_id string, {checksum} string, order long"
    ends = landed.stat.approxQuantile("order", [k / parts for k in range(1, parts)], 0.01) if parts > 1 else []
    low = None
    for high in [*sorted(set(ends)), None]:
        part = landed if low is None else landed.where(F.col("order") > low)
        part = part if high is None else part.where(F.col("order") <= high)
        part.write.mode("append").parquet(f"{root}/landing")
        low = high
        stream = spark.readStream.schema(schema).parquet(f"{root}/landing")
        intake(stream, lambda df, batch: df.select("bundle_id", F.lit(None).cast("string").alias("error")), root, checksum, ["order"]).awaitTermination()
    return spark.read.schema(f"{schema}, batch long").parquet(f"{root}/bundles").select(F.col("order").alias(key), checksum)
