"""CSV directory trees and partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _directory() -> Column:
    """Name of the directory a row's file lies in (the value of a ``key=value`` one)."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:[^/=]+=)?([^/]+)/[^/]+$", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))  # the path is percent-encoded


def read_entity_dirs(spark: SparkSession, root: str, name: str, schema: StructType | str, entity: str = "entity") -> DataFrame:
    """One kind of CSV under ``root/<entity>/``; the directory name becomes a column.

    An entity without the file simply contributes nothing. A ``key=value`` directory gives
    its value.
    """
    df = (spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", name).csv(root))
    return df.select("*", _directory().alias(entity))


def read_by_header(spark: SparkSession, root: str, name: str, columns: dict[str, str], entity: str = "entity") -> DataFrame:
    """Like ``read_entity_dirs`` for files whose headers differ: columns are found by name.

    Spark reads the cells by position (quotes, line breaks in quotes and short rows are its
    own matter) and skips the header lines; each file's header then says which position has which
    name. A column a file lacks is NULL, an unreadable number is NULL.
    """
    options = {"recursiveFileLookup": True, "pathGlobFilter": name}
    heads = spark.read.options(**options).text(root, wholetext=True).select(
        F.col("_metadata.file_path").alias("_file"), F.regexp_extract("value", r"^\ufeff?([^\r\n]*)", 1).alias("_line"))
    # One header line per file; the widest tells how many cells to read.
    most = (heads.agg(F.max(F.size(F.split("_line", ",")))).first()[0] or 1)
    cells = ", ".join(f"c{i} string" for i in range(most))
    every = [f"c{i}" for i in range(most)]
    heads = heads.withColumn("_h", F.from_csv("_line", cells)).select("_file", F.array(*[F.col(f"_h.{c}") for c in every]).alias("_names"))
    rows = (spark.read.schema(cells).options(**options).option("header", True).option("enforceSchema", True).option("multiLine", True)
            .csv(root).select(*every, F.col("_metadata.file_path").alias("_at"), _directory().alias(entity)))
    rows = rows.join(heads, F.col("_at") == F.col("_file")).withColumn("_v", F.array(*every))
    out = []
    for c, kind in columns.items():
        at = F.array_position("_names", c)
        text = F.when(at > 0, F.get("_v", (at - 1).cast("int")))
        out.append((text if kind == "string" else F.trim(text).try_cast(kind)).alias(c))
    return rows.select(entity, *out)


def union_variants(frames: list[DataFrame]) -> DataFrame:
    """Frames of one kind with different columns, matched by name; missing ones are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_by_season(df: DataFrame, path: str, season: str, kind: str | None = None, max_records: int = 5_000_000) -> None:
    """One directory per season (and kind), so that a reader opens only the seasons it needs.

    ``rebalance`` brings the rows of a directory together and lets Spark split a season that is
    larger than a task's advisory size and merge small ones, so the number of writers follows the data.
    """
    keys = [season] if kind is None else [kind, season]
    (df.hint("rebalance", *[F.col(k) for k in keys])
     .write.mode("overwrite").option("maxRecordsPerFile", max_records).partitionBy(*keys).parquet(path))


def read_season(spark: SparkSession, path: str, season: str, *years: int) -> DataFrame:
    """Only the listed seasons: a partition filter, resolved before any file is opened."""
    return spark.read.parquet(path).filter(F.col(season).isin(*years))


def write_model_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_model_table(spark: SparkSession, path: str, known_only: str | None = None) -> DataFrame:
    """The modelling table without the stray index column, optionally known classes only."""
    df = spark.read.parquet(path).drop("Unnamed: 0")
    return df if known_only is None else df.filter(F.col(known_only) != -1)
