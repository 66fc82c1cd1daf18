"""Survival estimators on (duration, event) and (duration, cause) data.

Durations are whole seasons. Rows are counted per distinct duration first; that table, at
most one row per season of the study span and stratum, is all a window ever sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.functions.numeric import normal_two_sided, safe_div

Z95 = 1.959963984540054


def _group(by: list[str]):
    return W.partitionBy(*by) if by else W.partitionBy(F.lit(0))


def _real(count: str) -> Column:
    """A count as a double: products of large counts leave the range of a long."""
    return F.col(count).cast("double")


def life_table(df: DataFrame, time: str, counts: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Per distinct time: the number at risk and a count for each named condition."""
    by = by or []
    table = df.groupBy(*by, time).agg(
        F.count(F.lit(1)).alias("n_at"),
        *[F.count_if(cond).alias(name) for name, cond in counts.items()])
    after = _group(by).orderBy(time).rowsBetween(0, W.unboundedFollowing)
    return table.withColumn("n_risk", F.sum("n_at").over(after))


def km_curve(df: DataFrame, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    """Kaplan-Meier: n_risk, d, c, s, Greenwood variance and a log-log 95 % band."""
    by = by or []
    t = life_table(df, time, {"d": F.col(event) == 1, "c": F.col(event) == 0}, by)
    upto = _group(by).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    n, d = _real("n_risk"), _real("d")
    green = safe_div(d, n * (n - d))
    s = F.product(1.0 - safe_div(d, n)).over(upto)
    out = (t.withColumn("s", s)
           .withColumn("_g", F.sum(green).over(upto))
           .withColumn("var", F.col("s") * F.col("s") * F.col("_g")))
    # Band on log(-log S); undefined where S is 0 or 1.
    inner = (F.col("s") > 0) & (F.col("s") < 1)
    theta = F.lit(Z95) * F.sqrt("_g") / F.ln("s")
    return (out.withColumn("ci_low", F.when(inner, F.pow("s", F.exp(-theta))))
            .withColumn("ci_high", F.when(inner, F.pow("s", F.exp(theta))))
            .select(*by, time, "n_risk", "d", "c", "s", "var", "ci_low", "ci_high"))


def km_median_ci(curve: DataFrame, time: str, by: list[str] | None = None) -> DataFrame:
    """First time with S <= 0.5 and the times at which the band crosses it."""
    def first(col):
        return F.min(F.when(F.col(col) <= 0.5, F.col(time)))
    # A band that is undefined where S = 0 has crossed as well.
    out = [F.min(F.when(F.col("s") <= 0.5, F.col(time))).alias("median"),
           F.min(F.when((F.col("ci_low") <= 0.5) | (F.col("s") == 0), F.col(time))).alias("median_low"),
           F.min(F.when((F.col("ci_high") <= 0.5) | (F.col("s") == 0), F.col(time))).alias("median_high")]
    return curve.groupBy(*by).agg(*out) if by else curve.agg(*out)


def censoring_curve(df: DataFrame, time: str, event: str, name: str = "g", by: list[str] | None = None) -> DataFrame:
    """G(t): Kaplan-Meier of the censoring time (events flipped)."""
    by = by or []
    flipped = df.select(*by, F.col(time), (1 - F.col(event)).alias("_c"))
    return km_curve(flipped, time, "_c", by).select(*by, time, F.col("s").alias(name))


def logrank(df: DataFrame, time: str, event: str, group: Column) -> DataFrame:
    """Two-group log-rank for the rows where ``group`` holds: O, E, V, chi-square, p."""
    flag = group
    t = life_table(df, time, {"d": F.col(event) == 1, "d1": (F.col(event) == 1) & flag, "n1_at": flag})
    after = _group([]).orderBy(time).rowsBetween(0, W.unboundedFollowing)
    t = t.withColumn("n1", F.sum("n1_at").over(after))
    n, d, n1 = _real("n_risk"), _real("d"), _real("n1")
    e = safe_div(d * n1, n)
    v = F.coalesce(safe_div(d * n1 * (n - n1) * (n - d), n * n * (n - 1)), F.lit(0.0))
    out = t.agg(F.sum("d1").alias("observed"), F.sum(e).alias("expected"), F.sum(v).alias("variance"))
    z2 = safe_div(F.pow(F.col("observed") - F.col("expected"), 2), F.col("variance"))
    return out.withColumn("chi2", z2).withColumn("p", normal_two_sided(F.sqrt("chi2")))


def aalen_johansen(df: DataFrame, time: str, cause: str, causes: list[int],
                   by: list[str] | None = None) -> DataFrame:
    """Cumulative incidence of each cause, exact with ties, and its variance.

    The variance is the delta-method (Aalen) estimator, written out in running sums.
    """
    by = by or []
    t = life_table(df, time, {"d_any": F.col(cause) != 0,
                              **{f"d_{k}": F.col(cause) == k for k in causes}}, by)
    order = _group(by).orderBy(time)
    upto, before = (order.rowsBetween(W.unboundedPreceding, 0),
                    order.rowsBetween(W.unboundedPreceding, -1))
    n, d = _real("n_risk"), _real("d_any")
    t = (t.withColumn("s", F.product(1.0 - safe_div(d, n)).over(upto))
         .withColumn("s_before", F.coalesce(F.product(1.0 - safe_div(d, n)).over(before), F.lit(1.0))))
    s = F.col("s_before")
    for k in causes:
        dk = _real(f"d_{k}")
        t = t.withColumn(f"cif_{k}", F.sum(s * safe_div(dk, n)).over(upto))
        # Var = sum_i [(F(t)-F_i)^2 a_i + S_i^2 b_i - 2 (F(t)-F_i) S_i c_i]
        f = F.col(f"cif_{k}")
        a = F.coalesce(safe_div(d, n * (n - d)), F.lit(0.0))
        b = safe_div(dk * (n - dk), n * n * n)
        c = safe_div(dk, n * n)
        sa, saf, saff = (F.sum(x).over(upto) for x in (a, a * f, a * f * f))
        sb = F.sum(s * s * b).over(upto)
        sc, scf = F.sum(s * c).over(upto), F.sum(s * c * f).over(upto)
        t = t.withColumn(f"var_{k}",
                         f * f * sa - 2.0 * f * saf + saff + sb - 2.0 * f * sc + 2.0 * scf)
    cols = [c for k in causes for c in (f"d_{k}", f"cif_{k}", f"var_{k}")]
    return t.select(*by, time, "n_risk", "s", *cols)


def person_period(df: DataFrame, duration: str, event: str, keep: list[str],
                  period: str = "period") -> DataFrame:
    """One row per period at risk; the event falls into the last one."""
    return (df.select(*keep, duration, event,
                      F.explode(F.sequence(F.lit(1), F.col(duration))).alias(period))
            .withColumn("event_now", F.when((F.col(period) == F.col(duration)) & (F.col(event) == 1), 1)
                        .otherwise(0)))


def hazard_by_period(pp: DataFrame, period: str = "period") -> DataFrame:
    return pp.groupBy(period).agg(F.count(F.lit(1)).alias("at_risk"),
                                  F.sum("event_now").alias("events"),
                                  F.avg("event_now").alias("hazard"))


def conditional_step(curve: DataFrame, time: str, s: str = "s") -> DataFrame:
    """S(t) / S(previous t): the chance to survive one more step."""
    prev = F.lag(s).over(_group([]).orderBy(time))
    return curve.withColumn("step_survival", safe_div(F.col(s), F.coalesce(prev, F.lit(1.0))))


def ipcw_brier(df: DataFrame, time: str, event: str, predictions: dict[float, str],
               g_curve: DataFrame, strict_before: bool = False) -> DataFrame:
    """Graf's weighted Brier score at each horizon, one row per horizon.

    ``predictions`` maps a horizon to the column with the predicted S(horizon). G is read
    at T and at the horizon (or just before, with ``strict_before``) and floored at 1e-8.
    """
    from dwellkit.operators.stints import step_read

    shift = 1 if strict_before else 0
    g = g_curve.select(F.col(time).alias("_gt"), F.col("g"))
    horizons = sorted(predictions)
    # Join the small G table once per distinct duration, then rows by duration.
    at_t = step_read(df.select(time).distinct().withColumn("_at", F.col(time) - shift),
                     "_at", g, "_gt", "g", empty=1.0).select(F.col(time), F.col("g").alias("_g_t"))
    rows = df.join(at_t, time)
    long = rows.select(time, event, "_g_t", F.explode(F.array(*[
        F.struct(F.lit(float(h)).alias("horizon"), F.col(predictions[h]).cast("double").alias("p"))
        for h in horizons])).alias("_h")).select(time, event, "_g_t", "_h.*")
    early = (F.col(time) <= F.col("horizon")) & (F.col(event) == 1)
    late = F.col(time) > F.col("horizon")
    parts = long.groupBy("horizon").agg(
        F.sum(F.when(early, F.col("p") * F.col("p") / F.greatest("_g_t", F.lit(1e-8)))
              .otherwise(0.0)).alias("_early"),
        F.sum(F.when(late, F.pow(1.0 - F.col("p"), 2)).otherwise(0.0)).alias("_late"),
        F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("_at", F.col("horizon") - shift)
    at_h = step_read(parts, "_at", g, "_gt", "g", empty=1.0)
    return at_h.select("horizon", "n", (
        (F.col("_early") + F.col("_late") / F.greatest("g", F.lit(1e-8))) / F.col("n")).alias("brier"))


def integrated_brier(scores: DataFrame) -> DataFrame:
    """Trapezoid over the horizons divided by their range, and skill against 0.25."""
    order = _group([]).orderBy("horizon")
    h0, b0 = F.lag("horizon").over(order), F.lag("brier").over(order)
    area = (F.col("horizon") - h0) * (F.col("brier") + b0) / 2.0
    out = scores.withColumn("_a", area).agg(
        safe_div(F.sum("_a"), F.max("horizon") - F.min("horizon")).alias("ibs"))
    return out.withColumn("skill", (0.25 - F.col("ibs")) / 0.25)


def surv_to_class(s_low: Column, s_high: Column) -> list[Column]:
    """Class probabilities (1 - S2, S2 - S4, S4), clipped at zero and normalised."""
    raw = [F.greatest(x, F.lit(0.0)) for x in (1.0 - s_low, s_low - s_high, s_high)]
    total = raw[0] + raw[1] + raw[2]
    return [safe_div(x, total) for x in raw]


def argmax(cols: list[Column]) -> Column:
    """Index of the largest value, the first on ties."""
    best = F.greatest(*cols)
    chain = F.when(cols[0] == best, 0)
    for i, c in enumerate(cols[1:], 1):
        chain = chain.when(c == best, i)
    return chain
