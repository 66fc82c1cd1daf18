"""Attribution tables: who contributed how much, per row, feature, category and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.functions.numeric import safe_div
from dwellkit.operators.hypothesis import t_interval


def contributions(df: DataFrame, keys: list[str], weights: list[dict[str, float]], means: dict[str, float]) -> DataFrame:
    """(keys, feature, value): mean over the sub-models of |b (x - mean)|.

    A missing x contributes nothing.
    """
    parts = []
    for f, m in means.items():
        total = F.lit(0.0)
        for w in weights:
            total = total + F.abs(F.lit(float(w[f])) * (F.col(f).cast("double") - F.lit(float(m))))
        parts.append(F.struct(F.lit(f).alias("feature"), F.coalesce(total / float(len(weights)), F.lit(0.0)).alias("value")))
    return df.select(*keys, F.explode(F.array(*parts)).alias("_c")).select(*keys, "_c.*")


def mean_attribution(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    return long.groupBy(*(by or []), "feature").agg(F.avg("value").alias("mean_abs"))


def family_ratio(long: DataFrame, keys: list[str], first: list[str], second: list[str]) -> DataFrame:
    """(keys, ratio): mean of the second family over mean of the first; NULL if that is zero."""
    a = F.avg(F.when(F.col("feature").isin(first), F.col("value")))
    b = F.avg(F.when(F.col("feature").isin(second), F.col("value")))
    out = long.groupBy(*keys).agg(a.alias("_a"), b.alias("_b"))
    return out.select(*keys, F.when(F.col("_a") > 0, F.col("_b") / F.col("_a")).alias("ratio"))


def ratio_by_group(ratios: DataFrame, by: list[str], min_n: int = 10) -> DataFrame:
    """Mean ratio and share above one per group with enough rows."""
    out = ratios.dropna(subset=["ratio"]).groupBy(*by).agg(
        F.count("ratio").alias("n"), F.avg("ratio").alias("mean_ratio"),
        F.avg((F.col("ratio") > 1).cast("int")).alias("share_above_one"))
    return out.filter(F.col("n") >= min_n)


def normalized_importance_ci(importances: DataFrame, run: str = "seed", feature: str = "feature", value: str = "value") -> DataFrame:
    """Importances scaled to sum 1 within each run, then mean, t interval and rank."""
    share = importances.withColumn("share", safe_div(F.col(value), F.sum(value).over(W.partitionBy(run))))
    ci = t_interval(share, [feature], "share")
    # One row per feature reaches this window.
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("mean"), feature))
    return ci.withColumn("rank", rank)


def partial_dependence(df: DataFrame, model, feature: str, outputs: list[str], points: int = 50) -> DataFrame:
    """Average prediction with the feature replaced by each of ``points`` grid values.

    The grid spans [min, max]. Rows are copied per grid value in the same task and reduced to
    one partial average, so nothing but the averages is shuffled.
    """
    lo, hi = df.agg(F.min(feature), F.max(feature)).first()
    step = (hi - lo) / (points - 1)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    rows = df.withColumn("_g", grid).withColumn(feature, F.lit(float(lo)) + F.col("_g") * F.lit(float(step)))
    return (model.transform(rows).groupBy(F.col("_g").alias("grid_no"), F.col(feature).alias("grid"))
            .agg(*[F.avg(c).alias(c) for c in outputs]))


def quadrant_matrix(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Counts by predicted class and binned measure."""
    return df.groupBy(first.alias("class_bin"), second.alias("measure_bin")).agg(F.count(F.lit(1)).alias("n"))
