"""Global order without a global sort task: ranks, running sums and exact quantiles.

A window without a partition key puts every row into one task, and a window on a hot key
does nearly the same. Here the order is first cut into ranges. Each range is summed
(map-side combined), the few range totals are accumulated, and only the rows of one range
meet in one window task. Rows are collapsed to distinct order values before, so a value
shared by a third of all rows is one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.session import materialized, shuffle_partitions

RANGE = "_range"


def with_ranges(df: DataFrame, order: str, n_ranges: int | None = None) -> DataFrame:
    """Add a range number that never decreases along ``order`` (a numeric column).

    The cut points are approximate quantiles, so ranges hold similar row counts; the result
    of the operators below is exact wherever the cuts fall.
    """
    n = n_ranges or shuffle_partitions(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    cuts = sorted(set(df.select(F.col(order).cast("double").alias(order))
                      .approxQuantile(order, probs, 1.0 / (4 * n))))
    if not cuts:
        return df.withColumn(RANGE, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    keyed = df.withColumn("_order_d", F.col(order).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="_order_d", outputCol="_range_d", handleInvalid="keep")
    return (cut.transform(keyed)
            .withColumn(RANGE, F.col("_range_d").cast("int")).drop("_order_d", "_range_d"))


HASH_DIGITS = 3


def with_hash_ranges(df: DataFrame, order: str, digits: int = HASH_DIGITS) -> DataFrame:
    """16 ** digits ranges for an order by hex hash: its leading digits are evenly spread already.

    A range meets in one task, so take a digit more for each 16-fold of rows beyond some 1e10.
    """
    return df.withColumn(RANGE, F.conv(F.substring(F.col(order), 1, digits), 16, 10).cast("bigint"))


def mark_first(rows: DataFrame, order: str, key: str, take: Callable[[Column], Column],
               by: list[str] | None = None, name: str = "picked", digits: int = HASH_DIGITS) -> DataFrame:
    """Mark the first ``take(total)`` rows of each group in hash order, without sorting them.

    Counting rows per hash range shows in which range the cut lies. Rows of other ranges are
    decided by their range alone and stay where they are; only the one range with the cut is
    ranked, by hash and then key.
    """
    by = by or []
    src = with_hash_ranges(rows, order, digits)
    cells = src.groupBy(*by, RANGE).agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    # One row per range and group here.
    seen = cells.withColumn("_take", take(F.sum("_n").over(group)).cast("bigint")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(group.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cut = seen.filter((F.col("_before") < F.col("_take")) & (F.col("_take") <= F.col("_before") + F.col("_n")))
    cut = materialized(cut.select(*by, F.col(RANGE).alias("_cut"), "_before", "_take"))
    if by:
        src = src.join(cut, by, "left")
    else:
        one = cut.select(F.struct("_cut", "_before", "_take")).scalar()
        src = src.withColumn("_c", one).select(src.columns + ["_c.*"])
    at_cut = F.coalesce(F.col(RANGE) == F.col("_cut"), F.lit(False))
    clear = src.filter(~at_cut).withColumn(name, F.coalesce(F.col(RANGE) < F.col("_cut"), F.lit(False)))
    # Only the rows of one range are left to rank.
    rank = F.row_number().over(group.orderBy(order, key))
    ranked = src.filter(at_cut).withColumn(name, rank + F.col("_before") <= F.col("_take"))
    return clear.unionByName(ranked).drop(RANGE, "_cut", "_before", "_take")


def running(df: DataFrame, order: str, sums: dict[str, Column], by: list[str] | None = None,
            ranged: bool = False, tie: str | None = None) -> DataFrame:
    """Add ``<name>_before`` and ``<name>_total`` for each summed expression.

    ``before`` sums over strictly smaller ``order`` values of the same ``by`` group, so
    ``df`` needs one row per (by, order), or per (by, order, tie). Pass ``ranged=True`` when the range column is
    already there. Otherwise the input is read for the cut points, the range totals and the
    rows, so it is written once to the shared folder instead of being computed three times.
    """
    by = by or []
    src = df.withColumns({f"_v_{name}": expr for name, expr in sums.items()})
    if not ranged:
        src = with_ranges(materialized(src), order)
    # A null key becomes a marker and a value, so that the join and the window share plain keys,
    # and with them one exchange of the rows.
    named = {f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(by)}
    named |= {f"_n{i}": F.col(k).isNull() for i, k in enumerate(by)}
    src = src.withColumns(named) if named else src
    groups, keys = list(named), [*named, RANGE]
    totals = src.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    # One row per range and group meets here, not one per input row.
    group = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    earlier = group.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(group).alias(f"{n}_total") for n in sums])
    inside = W.partitionBy(*keys).orderBy(order, *([tie] if tie else [])).rowsBetween(W.unboundedPreceding, -1)
    out = src.join(offsets, keys)
    out = out.withColumns({f"{n}_before": F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    wanted = [*df.columns, *[f"{n}_total" for n in sums], *[f"{n}_before" for n in sums]]
    return out.select(*[c for c in wanted if c != RANGE])


def average_ranks(values: DataFrame, value: str, n: str = "n", by: list[str] | None = None) -> DataFrame:
    """Average rank (from 1) of each distinct value, given its count ``n``."""
    out = running(values, value, {"_r": F.col(n)}, by)
    return (out.withColumn("avg_rank", F.col("_r_before") + (F.col(n) + 1) / 2.0)
            .withColumnRenamed("_r_total", "n_all").drop("_r_before"))


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None,
                    n: str | None = None) -> DataFrame:
    """Exact interpolated quantiles per group, also where one group holds most rows.

    Distinct values are counted, their positions come from ``running``, and only the two
    rows around each wanted position are kept. ``n`` names a multiplicity column.
    """
    by = by or []
    count = F.sum(n) if n else F.count(F.lit(1))
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*by, value)
              .agg(count.alias("_n")).filter("_n > 0"))
    pos = running(counts, value, {"_p": F.col("_n")}, by)
    parts = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_p_total") - 1)
        low, frac = F.floor(at), at - F.floor(at)
        holds = lambda k: (F.col("_p_before") <= k) & (k < F.col("_p_before") + F.col("_n"))
        weight = (F.when(holds(low), 1.0 - frac).otherwise(0.0)
                  + F.when((frac > 0) & holds(low + 1), frac).otherwise(0.0))
        parts.append(F.sum(F.col(value).cast("double") * weight).alias(name))
    return pos.groupBy(*by).agg(*parts) if by else pos.agg(*parts)


def last_step(points: DataFrame, at: str, steps: DataFrame, time: str, value: str) -> DataFrame:
    """(at, value): for each distinct point the value of the last step at or before it, null before the first.

    Steps have distinct times. Points and steps are cut into ranges along their common order; a range needs
    only its own rows and the last step of the ranges before, of which there is one row each.
    """
    kind = steps.schema[value].dataType
    both = points.select(F.col(at).cast("double").alias("_o"), F.lit(True).alias("_p"), F.lit(None).cast(kind).alias("_v")).unionByName(
        steps.select(F.col(time).cast("double").alias("_o"), F.lit(False).alias("_p"), F.col(value).alias("_v")))
    src = with_ranges(materialized(both.filter("_o IS NOT NULL")), "_o")
    step = F.when(~F.col("_p"), F.struct("_v"))
    ends = src.filter(~F.col("_p")).groupBy(RANGE).agg(F.max_by(F.struct("_v"), "_o").alias("_end"))
    earlier = W.partitionBy(F.lit(0)).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    ranges = src.select(RANGE).distinct().join(ends, RANGE, "left").select(
        F.col(RANGE).alias("_r"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    inside = W.partitionBy(RANGE).orderBy("_o", "_p").rowsBetween(W.unboundedPreceding, 0)
    out = src.join(ranges, F.col(RANGE) == F.col("_r")).withColumn("_last", F.coalesce(F.last(step, ignorenulls=True).over(inside), "_carried"))
    return out.filter("_p").select(F.col("_o").alias(at), F.col("_last")["_v"].alias(value))
