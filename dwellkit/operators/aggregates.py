"""Grouped summaries. Everything but exact medians is one map-side combined pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.functions.numeric import nan_to_null, safe_div
from dwellkit.models.sums import assemble, keyed_sums, matrix
from dwellkit.operators.running import exact_quantiles


def zscore_by_period(df: DataFrame, period: str, columns: list[str], omit_missing: bool = False) -> DataFrame:
    """Standardise each column within its period (population sd).

    A missing value (NULL or NaN) makes the whole period missing unless ``omit_missing``; so does
    a zero sd. Moments are aggregated per period and joined back: a window would pull a whole
    period into one task.
    """
    df = df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in columns})
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"), F.count(c).alias(f"_c_{c}")]
    moments = df.groupBy(period).agg(*aggs)
    out = df.join(moments, period)
    for c in columns:
        usable = F.col(f"_s_{c}") > 0
        if not omit_missing:
            usable = usable & (F.col(f"_c_{c}") == F.col("_n"))
        out = out.withColumn(c, F.when(usable, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")))
    return out.select(df.columns)


# Which sides a role answers for, and the orientation of each (own = +1, opposing = -1).
ROLE_SIDES = {"HC": [("own", 1.0), ("opp", -1.0)], "OC": [("own", 1.0)], "DC": [("opp", -1.0)]}


def pooled_two_sided_mean(role_seasons: DataFrame, sides: DataFrame, unit: str, season: str, role: str,
                          by: list[str], stats: dict[str, float],
                          role_sides: dict = ROLE_SIDES) -> DataFrame:
    """One oriented mean per group over all role-seasons and the sides they answer for."""
    options = F.coalesce(*[
        F.when(F.col(role) == r, F.array(*[F.struct(F.lit(s).alias("side"), F.lit(g).alias("_g")) for s, g in ss]))
        for r, ss in role_sides.items()])
    each = role_seasons.filter(F.col(role).isin(*role_sides)).withColumn("_o", F.explode(options))
    each = each.select(*by, unit, season, "_o.*")
    joined = each.join(sides.select(unit, season, "side", *stats), [unit, season, "side"])
    return joined.groupBy(*by).agg(*[F.avg(F.col("_g") * F.lit(sign) * F.col(s)).alias(s)
                                     for s, sign in stats.items()])


def weighted_collapse(blocks: list[tuple[Column, Column]]) -> Column:
    """Weighted mean of parallel columns given as (value, weight), skipping nulls."""
    num = sum((F.when(v.isNotNull(), v * w).otherwise(0.0) for v, w in blocks[1:]),
              F.when(blocks[0][0].isNotNull(), blocks[0][0] * blocks[0][1]).otherwise(0.0))
    den = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in blocks[1:]),
              F.when(blocks[0][0].isNotNull(), blocks[0][1]).otherwise(0.0))
    return F.when(den > 0, safe_div(num, den))


def distinct_by_condition(df: DataFrame, by: list[str], key: str, conditions: dict[str, Column],
                          extra: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Distinct keys per group under each condition, plus further sums, minima or maxima.

    Several ``count(distinct)`` in one aggregation would copy every row once per distinct
    column. Collapsing to (group, key) first needs one combined pass and no copies. ``extra``
    maps a name to (expression, "sum" | "min" | "max").
    """
    extra = extra or {}
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    first = df.groupBy(*by, key).agg(*[F.max(c.cast("int")).alias(f"_c_{n}") for n, c in conditions.items()],
                                     *[how[h](e).alias(f"_e_{n}") for n, (e, h) in extra.items()])
    return first.groupBy(*by).agg(*[F.sum(f"_c_{n}").alias(n) for n in conditions],
                                  *[how[h](f"_e_{n}").alias(n) for n, (_, h) in extra.items()])


def distinct_in_window(df: DataFrame, unit: str, season: str, member: str, anchors: DataFrame,
                       anchor: str, back: int, name: str = "n_distinct") -> DataFrame:
    """Distinct members of a unit in [anchor - back, anchor - 1].

    Each distinct (unit, season, member) is copied to the anchors it can reach, so the join
    is an equality and ``count_distinct`` combines on the map side.
    """
    reach = F.explode(F.sequence(F.col(season) + 1, F.col(season) + back))
    seen = df.select(unit, season, member).distinct().select(unit, member, reach.alias(anchor))
    counts = seen.groupBy(unit, anchor).agg(F.count_distinct(member).alias(name))
    return anchors.join(counts, [unit, anchor], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def group_summary(df: DataFrame, by: list[str], value: str, min_n: int = 1) -> DataFrame:
    """count, mean, sd, min, max and exact median per group with at least ``min_n`` rows."""
    base = (df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("low"), F.max(value).alias("high")).filter(F.col("n") >= min_n))
    med = exact_quantiles(df, value, {"median": 0.5}, by)
    return base.join(med, by, "left")


def class_distribution(df: DataFrame, label: str, expected: dict[int, float], tolerance: float) -> DataFrame:
    """Counts and shares per class against the expected share."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    want = F.coalesce(*[F.when(F.col(label) == k, F.lit(v)) for k, v in expected.items()])
    # The window sees one row per class.
    share = F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))
    return (counts.withColumn("share", share).withColumn("expected", want)
            .withColumn("ok", F.abs(F.col("share") - F.col("expected")) <= tolerance))


def unpivot_row(df: DataFrame, columns: dict[str, dict[str, Column]], key: str) -> DataFrame:
    """Turn a one-row aggregate into rows: {name: {field: expression}}."""
    rows = [F.struct(F.lit(name).alias(key), *[e.alias(f) for f, e in fields.items()])
            for name, fields in columns.items()]
    return df.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def missingness_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count, share and coverage per column in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_c_{c}") for c in columns])
    n = F.col("_n")
    return unpivot_row(one, {c: {
        "n_missing": n - F.col(f"_c_{c}"), "share_missing": safe_div(n - F.col(f"_c_{c}"), n),
        "coverage": safe_div(F.col(f"_c_{c}"), n)} for c in columns}, "feature")


def corr_with_target(df: DataFrame, columns: list[str], target: str, min_n: int = 10) -> DataFrame:
    """Correlation of each column with the target on complete pairs, NULL if few."""
    one = df.agg(*[e for c in columns for e in (
        F.corr(c, target).alias(f"_r_{c}"), F.regr_count(F.col(target), F.col(c)).alias(f"_n_{c}"))])
    return unpivot_row(one, {c: {
        "n_pairs": F.col(f"_n_{c}"), "r": F.when(F.col(f"_n_{c}") > min_n, F.col(f"_r_{c}"))}
        for c in columns}, "feature")


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each unordered column pair over the rows that hold both, in one pass for all.

    Sums of all pairs are products of a batch's matrix with itself, so the plan is the same for any number of
    columns and the driver receives 4 k x k numbers. NaN is missing; NULL where fewer than two rows hold both or one does not vary.
    """
    k = len(columns)
    x = df.select(F.array(*[nan_to_null(F.col(c).cast("double")) for c in columns]).alias("x"))
    mean = _means(x, k)

    def sums(batch):
        values = matrix(batch["x"])
        held = ~np.isnan(values)
        present, shifted = held.astype(float), np.where(held, values - mean, 0.0)
        return {(): np.concatenate([(present.T @ present).ravel(), (shifted.T @ present).ravel(),
                                    ((shifted * shifted).T @ present).ravel(), (shifted.T @ shifted).ravel()])}
    total = keyed_sums(x, {}, sums).get((), np.zeros(4 * k * k))
    n, sx, sxx, sxy = total.reshape(4, k, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        # Row: the column itself, over the rows that the other one holds.
        spread = sxx - sx * sx / n
        varies = spread > n * (1e-13 * np.abs(mean))[:, None] ** 2
        r = (sxy - sx * sx.T / n) / np.sqrt(spread * spread.T)
        known = (n >= 2) & varies & varies.T
    rows = [(columns[i], columns[j], float(r[i, j]) if known[i, j] else None) for i in range(k) for j in range(i + 1, k)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def _means(rows: DataFrame, k: int) -> np.ndarray:
    """Mean of each place of the arrays ``x``, 0 where no row holds it."""
    def sums(batch):
        values = matrix(batch["x"])
        held = ~np.isnan(values)
        return {(): np.concatenate([held.sum(0), np.where(held, values, 0.0).sum(0)])}
    n, total = keyed_sums(rows, {}, sums).get((), np.zeros(2 * k)).reshape(2, k)
    return total / np.maximum(n, 1)


def slope_last_k(df: DataFrame, keys: list[str], season: str, value: str, k: int = 3) -> DataFrame:
    """Least-squares slope over the values present in the last k seasons, indexed 0..n-1.

    NULL when fewer than two are present: an undefined trend is not a flat one. ``df`` has
    one row per (keys, season).
    """
    recent = W.partitionBy(*keys).orderBy(F.desc(season))
    order = W.partitionBy(*keys).orderBy(season)
    last = df.withColumn("_back", F.row_number().over(recent)).filter(F.col("_back") <= k)
    x = F.row_number().over(order) - 1
    pts = last.filter(F.col(value).isNotNull()).withColumn("_x", x.cast("double"))
    fit = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"),
                                 F.regr_slope(F.col(value), F.col("_x")).alias("_b"))
    fit = fit.withColumn("slope", F.when(F.col("n_points") >= 2, F.col("_b"))).drop("_b")
    return (df.select(*keys).distinct().join(fit, keys, "left")
            .withColumn("n_points", F.coalesce("n_points", F.lit(0))))


def category_rollup(importance: DataFrame, categories: dict[str, str], feature: str = "feature",
                    value: str = "value") -> DataFrame:
    """Total, mean and count of importance per category of a fixed feature list."""
    cat = F.coalesce(*[F.when(F.col(feature) == f, F.lit(c)) for f, c in categories.items()])
    return importance.withColumn("category", cat).groupBy("category").agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("n_features"))


def two_group_ratio(rollup: DataFrame, top: str, bottom: str) -> DataFrame:
    """Ratio of the mean importance of two categories."""
    def mean_of(c):
        return F.max(F.when(F.col("category") == c, F.col("mean")))
    return rollup.agg(safe_div(mean_of(top), mean_of(bottom)).alias("ratio"))


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariance) of complete rows: k x k sums, each batch's as one matrix product."""
    k = len(columns)
    rows = assemble(df, columns, {})
    # Shift by the overall mean first so that the sums stay well conditioned.
    mean = _means(rows, k)

    def sums(batch):
        values = matrix(batch["x"]) - mean
        return {(): np.concatenate([[len(values)], (values.T @ values).ravel()])}
    total = keyed_sums(rows, {}, sums).get((), np.zeros(1 + k * k))
    return int(total[0]), mean, total[1:].reshape(k, k) / max(total[0], 1.0)


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation 1 / (1 - R^2) per column: the diagonal of the inverse correlation."""
    _, _, cov = moments(df, columns)
    sd = np.sqrt(np.diag(cov))
    sd[sd == 0] = 1.0
    corr = cov / np.outer(sd, sd)
    try:
        values = np.diag(np.linalg.inv(corr))
        if np.linalg.cond(corr) > 1e12:
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        # Exact collinearity: R^2 from least squares on the other columns.
        values = []
        for j in range(len(columns)):
            o = [i for i in range(len(columns)) if i != j]
            r2 = corr[j, o] @ np.linalg.pinv(corr[np.ix_(o, o)]) @ corr[o, j]
            values.append(float("inf") if r2 >= 1 - 1e-9 else 1.0 / (1.0 - r2))
    rows = [(c, float(v)) for c, v in zip(columns, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")
