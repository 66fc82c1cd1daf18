"""Structured Streaming jobs and the batch job they must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.functions.times import epoch_micros, instant
from dwellkit.session import checkpoint_root


def session_stints(events: DataFrame, entity: str, ts: str, gap_micros: int) -> DataFrame:
    """(entity, start_us, end_us, n): a gap longer than ``gap_micros`` starts a new stint.

    Events of an entity within one gap-wide bucket always belong together, so they are
    combined on the map side first. The window sees at most span / gap buckets per entity,
    however many events a hot entity has.
    """
    rows = events.select(entity, epoch_micros(F.col(ts)).alias("_us"))
    per = rows.groupBy(entity, F.expr(f"_us div {gap_micros}").alias("_bucket")).agg(
        F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy(entity).orderBy("_bucket")
    prev = F.lag("_hi").over(order)
    marked = per.withColumn("_new", (prev.isNull() | (F.col("_lo") - prev > gap_micros)).cast("int"))
    marked = marked.withColumn("_stint", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(entity, "_stint").agg(
        F.min("_lo").alias("start_us"), F.max("_hi").alias("end_us"), F.sum("_n").alias("n")).drop("_stint")


def session_stream(events: DataFrame, entity: str, ts: str, gap_micros: int, delay: str) -> DataFrame:
    """The same on a stream; a stint is emitted once the watermark has passed its end."""
    window = F.session_window("_at", f"{gap_micros} microseconds")
    rows = events.select(entity, instant(F.col(ts)).alias("_at")).withWatermark("_at", delay)
    per = rows.groupBy(entity, window.alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select(entity, F.unix_micros("_w.start").alias("start_us"),
                      (F.unix_micros("_w.end") - gap_micros).alias("end_us"), "n")


def counts_stream(events: DataFrame, kind: str, ts: str, value: str, period: str, delay: str) -> DataFrame:
    """Tumbling counts and sums by kind; rows later than the watermark are dropped."""
    rows = events.select(kind, value, instant(F.col(ts)).alias("_at")).withWatermark("_at", delay)
    per = rows.groupBy(kind, F.window("_at", period).alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return per.select(kind, F.unix_micros("_w.start").alias("start_us"), F.unix_micros("_w.end").alias("end_us"), "n", "total")


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A growing folder of parquet files as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_available(stream: DataFrame, path: str | None = None, partial_merge: bool = False) -> DataFrame:
    """Process what is there, append finished rows to a table under ``path``, read the table.

    The checkpoint lies next to the table: a later call with the same ``path`` reads only what has come
    since, and keeps open windows and sessions. Without one the run has a folder of its own.
    ``partial_merge`` lets sessions combine before the shuffle.
    """
    spark = stream.sparkSession
    path = path or f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(key, "false")
    if partial_merge:
        spark.conf.set(key, "true")
    try:
        query = (stream.writeStream.format("parquet").option("path", f"{path}/data")
                 .option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        if partial_merge:
            spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
