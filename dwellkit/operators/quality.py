"""Checks and version differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.functions.numeric import nan_to_null
from dwellkit.operators.aggregates import unpivot_row


def key_set_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: its row counts in both versions and added / removed / changed / same."""
    both = (a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
            .unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    # One combined aggregation instead of set operations and a join of counts.
    n = both.groupBy(*keys).agg(F.sum("_a").alias("n_old"), F.sum("_b").alias("n_new"))
    return n.withColumn("status", F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed")
                        .when(F.col("n_old") != F.col("n_new"), "changed").otherwise("same"))


def cell_diff(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 0.01) -> DataFrame:
    """Cells that differ on shared keys: null change (NaN counts as null), numeric beyond the tolerance, or other.

    Rows are joined once by key and only differing cells are exploded.
    """
    kinds = dict(a.dtypes)
    numeric = {n for n, t in a.dtypes if t in ("double", "float", "int", "bigint", "smallint")}
    right = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = a.join(right, [F.col(k) == F.col(f"_k_{k}") for k in keys])
    cells = []
    for c in columns:
        old, new = F.col(c), F.col(f"_n_{c}")
        if kinds[c] in ("double", "float"):
            old, new = nan_to_null(old), nan_to_null(new)
        if c in numeric:
            change = F.when(F.abs(old - new) > tolerance, "numeric")
        else:
            change = F.when(old != new, "other")
        kind = F.when(old.isNull() != new.isNull(), "null_change").otherwise(change)
        cells.append(F.struct(F.lit(c).alias("column"), kind.alias("kind"), old.cast("string").alias("old"),
                              new.cast("string").alias("new")))
    differing = F.filter(F.array(*cells), lambda x: x["kind"].isNotNull())
    return joined.select(*keys, F.explode(differing).alias("_c")).select(*keys, "_c.*")


def diff_summary(diffs: DataFrame, by: list[str], top: int | None = None) -> DataFrame:
    """Differences per group, most first."""
    out = diffs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_diffs"))
    out = out.orderBy(F.desc("n_diffs"), *by)
    return out if top is None else out.limit(top)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def range_checks(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Missing, non-finite and out-of-range counts per column in one pass."""
    aggs = []
    for c, (lo, hi) in ranges.items():
        v = F.col(c).cast("double")
        odd = F.isnan(v) | (F.abs(v) == float("inf"))
        aggs += [F.count_if(v.isNull()).alias(f"_m_{c}"), F.count_if(odd).alias(f"_o_{c}"),
                 F.count_if(~odd & ((v < lo) | (v > hi))).alias(f"_r_{c}")]
    one = df.agg(*aggs)
    return unpivot_row(one, {c: {"n_missing": F.col(f"_m_{c}"), "n_not_finite": F.col(f"_o_{c}"),
                                 "n_out_of_range": F.col(f"_r_{c}")} for c in ranges}, "feature")


def group_leaks(df: DataFrame, group: list[str], side: str) -> DataFrame:
    """Groups whose rows fall on more than one side of a split."""
    return (df.groupBy(*group).agg(F.min(side).alias("first_side"), F.max(side).alias("last_side"),
                                   F.count(F.lit(1)).alias("n"))
            .filter(F.col("first_side") != F.col("last_side")))


def mapping_cover(codes: DataFrame, mapping: DataFrame, code: str) -> DataFrame:
    """Codes the map (alias, key) does not cover, and codes that are both alias and key."""
    missing = (codes.select(F.col(code).alias("code")).distinct()
               .join(mapping.select(F.col("alias").alias("code")), "code", "left_anti")
               .withColumn("issue", F.lit("uncovered")))
    both = (mapping.select(F.col("alias").alias("code")).distinct()
            .join(mapping.select(F.col("key").alias("code")), "code", "left_semi")
            .withColumn("issue", F.lit("alias_and_key")))
    return missing.unionByName(both)


def overlapping_spans(spans: DataFrame, entity: str, start: str, end: str, order: list[str]) -> DataFrame:
    """Consecutive spans of an entity where the next starts before the present one ends."""
    w = W.partitionBy(entity).orderBy(start, *order)
    return (spans.withColumn("next_start", F.lead(start).over(w))
            .filter(F.col("next_start") <= F.col(end)))


def agreement(stored: Column, *derived: Column) -> Column:
    """Do all independent derivations agree with each other and with the stored flag."""
    same = stored.eqNullSafe(derived[0])
    for a, b in zip(derived, derived[1:]):
        same = same & a.eqNullSafe(b)
    return F.when(same, "agree").otherwise("differ")


def curated_truth(actual: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every curated expectation with its actual value: OK, WRONG or n.a."""
    e = expected.select(*keys, F.col(value).alias("expected"))
    hit = actual.select(*keys, F.col(value).alias("actual"))
    verdict = (F.when(F.col("actual").isNull(), "n.a.").when(F.col("actual") == F.col("expected"), "OK")
               .otherwise("WRONG"))
    return e.join(hit, keys, "left").withColumn("verdict", verdict)


def tolerance_check(actual: DataFrame, published: DataFrame) -> DataFrame:
    """Published (name, published, decimals) against actual (name, actual)."""
    gap = F.abs(F.col("actual") - F.col("published"))
    half = 0.5 * F.pow(F.lit(10.0), -F.col("decimals"))
    return published.join(actual, "name", "left").withColumn("ok", gap <= half + 1e-12)
