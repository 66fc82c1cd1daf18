"""Exact duplicates by sorting contents.

The bytes of all texts are cut into ranges by sampled splitters, each range is sorted (Spark
spills the sort to disk), so equal texts stand next to each other, and one pass compares each
text in full with its neighbour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.llm.common import hot_keys, text_or_empty, width

#: Leading bytes that decide the order of the ranges. Splitters hold these and a digest, so
#: the driver's sample stays small however long texts are; equality always uses whole texts.
HEAD_BYTES = 16


ADDED = ("_sha256", "_keep_id", "_size", "_kept")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                normalise: Callable[[Column], Column] | None = None, n_ranges: int | None = None) -> DataFrame:
    """Every input row and column, plus ``_sha256`` (binary), ``_keep_id``, ``_size`` and ``_kept``.

    Input columns of these four names give way to them.

    Texts are equal when their normalised bytes are. Of a group the row with the smallest
    (``keep="max"``: largest) identifier stays, exactly one row even if identifiers repeat; a
    null identifier loses to any other. Null texts count as empty, and empty texts are
    equal to each other. An empty table gives an empty table.

    One group may hold a third of all rows. Digests are counted first (map-side combined), and
    only groups beyond a task's fair share are cut into parts by identifier; the parts are
    separate ranges. Their keys are fewer than two per shuffle partition, hence the broadcast,
    which carries the group's result too. Within a part whole texts are compared; parts of
    one group meet by their SHA-256.
    """
    marked, columns = _marked(docs, id_col, text_col, keep, normalise, n_ranges)
    return marked.select(*[e.alias(c) for c, e in columns.items() if c not in ADDED], *ADDED)


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
              normalise: Callable[[Column], Column] | None = None, n_ranges: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    marked, columns = _marked(docs, id_col, text_col, keep, normalise, n_ranges)
    return marked.filter("_kept").select(*[e.alias(c) for c, e in columns.items()])


def _marked(docs: DataFrame, id_col: str, text_col: str, keep: str, normalise: Callable[[Column], Column] | None,
            n_ranges: int | None) -> tuple[DataFrame, dict[str, Column]]:
    """The decisions on each row, and how the input columns are read from it."""
    parts = n_ranges or width(docs)
    text = text_or_empty(text_col)
    best = F.max if keep == "max" else F.min
    # Other columns travel in a struct, so none of theirs can clash with the ones made here.
    rest = [c for c in docs.columns if normalise or c != text_col]
    rows = docs.select(F.struct(*rest).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).isNull().alias("_null"),
                       (normalise(text) if normalise else text).alias("_text"))
    rows = rows.withColumn("_sha256", F.unhex(F.sha2("_text", 256)))
    counts = rows.groupBy("_sha256").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_top"))
    # The number of rows comes from the files' footers, not from a second count of the digests.
    hot = hot_keys(counts, "_n", parts, docs.agg(F.count(F.lit(1))).scalar()).select(
        F.col("_sha256").alias("_hot_sha"), F.col("_n").alias("_hot_n"), F.col("_top").alias("_hot_top"),
        F.ceil(F.col("_n") / F.col("limit")).alias("_splits"))
    rows = rows.join(F.broadcast(hot), F.col("_sha256") == F.col("_hot_sha"), "left")
    part = F.when(F.col("_splits").isNull(), 0).otherwise(F.pmod(F.xxhash64("_id"), F.col("_splits")))
    rows = rows.withColumns({"_head": F.substring(F.col("_text").cast("binary"), 1, HEAD_BYTES), "_part": part})
    ranged = rows.repartitionByRange(parts, "_head", "_sha256", "_part")

    # The window's keys start with the range keys, so Spark sorts inside the ranges and adds no exchange.
    same = W.partitionBy("_head", "_sha256", "_part", "_text")
    order = F.desc_nulls_last("_id") if keep == "max" else F.asc_nulls_last("_id")
    out = ranged.withColumns({
        "_first": F.row_number().over(same.orderBy(order)) == 1,
        "_near_id": F.first("_id").over(same.orderBy(order)),
        "_near_n": F.count(F.lit(1)).over(same)})
    whole = F.col("_splits").isNull()
    keep_id = F.when(whole, F.col("_near_id")).otherwise(F.col("_hot_top"))
    original = F.col("_row")[text_col] if normalise else F.when(~F.col("_null"), F.col("_text"))
    # Rows with equal identifiers share a part, so the first row of the part with the kept one is unique.
    decided = out.select(
        "_row", "_null", "_text", "_sha256", keep_id.alias("_keep_id"),
        F.when(whole, F.col("_near_n")).otherwise(F.col("_hot_n")).alias("_size"),
        (F.col("_first") & F.col("_id").eqNullSafe(keep_id)).alias("_kept"))
    return decided, {c: original if c == text_col else F.col("_row")[c] for c in docs.columns}
