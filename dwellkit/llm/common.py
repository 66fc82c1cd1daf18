"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellkit.session import shuffle_partitions

#: A key is hot when it holds more than one part in so many, per shuffle partition.
HOT_SHARE = 2


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def width(df: DataFrame) -> int:
    return shuffle_partitions(df.sparkSession)


def hot_keys(counts: DataFrame, n: str, parts: int, total: Column) -> DataFrame:
    """Rows of ``counts`` (one per key, ``n`` rows each, ``total`` in all) whose key is hot, with ``limit``.

    A key is hot beyond 1 / (HOT_SHARE * parts) of all rows, so there are fewer than
    HOT_SHARE * parts of them whatever the data: this is the proof that makes them fit a
    broadcast.
    """
    limit = F.ceil(F.greatest(total, F.lit(1)) / F.lit(HOT_SHARE * parts)).cast("bigint")
    return counts.withColumn("limit", limit).filter(F.col(n) > F.col("limit"))
