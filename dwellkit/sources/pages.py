"""Links, rows and headers from page text, as whole-column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.operators.running import RANGE, with_ranges
from dwellkit.session import materialized


def discover_links(pages: DataFrame, html: str, prefix: str, suffix: str, manual: list[str]) -> DataFrame:
    """Distinct links with the prefix and suffix, plus a manual list."""
    links = pages.select(F.explode(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), 1)).alias("link"))
    found = links.filter(F.col("link").startswith(prefix) & F.col("link").endswith(suffix))
    extra = pages.sparkSession.createDataFrame([(m,) for m in manual], "link string")
    return found.unionByName(extra).distinct()


def block_rows(pages: DataFrame, keys: list[str], html: str, tag: str, cells: list[str], skip: str | None = None) -> DataFrame:
    """Repeated elements as rows: (keys, row_no, one column per cell pattern).

    Comment marks are removed first, so elements inside comments count. Rows matching
    ``skip`` (repeated headers) are left out.
    """
    shown = F.regexp_replace(html, "<!--|-->", "")
    blocks = F.regexp_extract_all(shown, F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), 1)
    rows = pages.select(*keys, F.posexplode(blocks).alias("row_no", "_block"))
    if skip is not None:
        rows = rows.filter(~F.col("_block").rlike(skip))
    return rows.select(*keys, "row_no", *[F.regexp_extract("_block", p, 1).alias(f"cell_{i}") for i, p in enumerate(cells)])


def dedupe_headers(headers: DataFrame, keys: list[str], position: str, name: str, suffixes: list[str]) -> DataFrame:
    """Repeated column names of a header get the listed suffixes in order, then a number.

    A header has a bounded number of columns, which is all a window task sees.
    """
    order = W.partitionBy(*keys).orderBy(position)
    repeat = F.row_number().over(W.partitionBy(*keys, name).orderBy(position)) > 1
    marked = headers.withColumn("_rep", repeat.cast("int"))
    marked = marked.withColumn("_no", F.sum("_rep").over(order.rowsBetween(W.unboundedPreceding, 0)))
    listed = F.coalesce(*[F.when(F.col("_no") == i, F.concat(F.col(name), F.lit(" " + s))) for i, s in enumerate(suffixes, 1)],
                        F.concat(F.col(name), F.lit("_"), (F.col("_no") - 1).cast("string")))
    return marked.withColumn("unique_name", F.when(F.col("_rep") == 1, listed).otherwise(F.col(name))).drop("_rep", "_no")


def fill_forward(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last non-null value at or before each row of its group.

    The order (numeric) is cut into ranges of even row counts; a task fills one range and takes what the
    earlier ranges of the group left, so a group of any length is spread over tasks.
    """
    src = with_ranges(materialized(df.withColumn("_value", value)), order)
    cut = [*keys, RANGE]
    left = (src.filter(F.col("_value").isNotNull()).groupBy(*cut).agg(F.max_by("_value", order).alias("_last")))
    blocks = src.select(*cut).distinct().join(left, cut, "left")
    before = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    inside = W.partitionBy(*cut).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = src.join(carried, cut)
    return out.withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(inside), "_carried")).drop(
        "_value", RANGE, "_carried")
