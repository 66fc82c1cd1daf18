"""Jobs that estimate survival curves, incidence and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellkit.functions.numeric import rounded
from dwellkit.operators import survival as sv
from dwellkit.operators.concordance import harrell, uno
from dwellkit.plans.base import rnd, sql, targets
from dwellkit.plans.registry import job
from dwellkit.session import materialized

RISK = """SELECT duration, sum(count(*)) OVER (ORDER BY duration DESC) AS n, count(*) FILTER (event = 1) AS d,
  count(*) FILTER (event = 0) AS c FROM targets GROUP BY duration"""
KM = """SELECT duration, CAST(n AS BIGINT) AS n_risk, d, c, product(1 - d / n) OVER w AS s,
  sum(CASE WHEN n > d THEN d / (n * (n - d)) END) OVER w AS g FROM risk WINDOW w AS (ORDER BY duration)"""
BAND = """SELECT *, CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(-1.959963984540054 * sqrt(g) / ln(s))) END AS ci_low,
  CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(1.959963984540054 * sqrt(g) / ln(s))) END AS ci_high FROM km"""


@job("km_curve", sql(f"""SELECT duration, n_risk, d, c, {rnd('s')} AS s, {rnd('s * s * g', 8)} AS var,
  {rnd('ci_low')} AS ci_low, {rnd('ci_high')} AS ci_high FROM band""", "targets", risk=RISK, km=KM, band=BAND))
def km_curve(spark, sf):
    c = sv.km_curve(targets(spark, sf), "duration", "event")
    return c.select("duration", "n_risk", "d", "c", rounded(F.col("s")).alias("s"),
                    rounded(F.col("var"), 8).alias("var"), rounded(F.col("ci_low")).alias("ci_low"),
                    rounded(F.col("ci_high")).alias("ci_high"))


@job("km_by_stratum", sql(f"""
SELECT era, duration, CAST(n AS BIGINT) AS n_risk, d, {rnd('product(1 - d / n) OVER (PARTITION BY era ORDER BY duration)')} AS s
FROM (SELECT CASE WHEN start_season < 1998 THEN 'early' ELSE 'late' END AS era, duration,
  sum(count(*)) OVER (PARTITION BY era ORDER BY duration DESC) AS n, count(*) FILTER (event = 1) AS d
  FROM targets GROUP BY 1, 2)""", "targets"))
def km_by_stratum(spark, sf):
    t = targets(spark, sf).withColumn(
        "era", F.when(F.col("start_season") < 1998, "early").otherwise("late"))
    return sv.km_curve(t, "duration", "event", by=["era"]).select(
        "era", "duration", "n_risk", "d", rounded(F.col("s")).alias("s"))


@job("km_median_ci", sql("""SELECT min(duration) FILTER (s <= 0.5) AS median,
  min(duration) FILTER (ci_low <= 0.5 OR s = 0) AS median_low,
  min(duration) FILTER (ci_high <= 0.5 OR s = 0) AS median_high FROM band""", "targets", risk=RISK, km=KM, band=BAND))
def km_median_ci(spark, sf):
    return sv.km_median_ci(sv.km_curve(targets(spark, sf), "duration", "event"), "duration")


def two_sided(z: str) -> str:
    """SQL of the two-sided normal tail: each term of the series by itself, its odd double factorial from gamma functions."""
    x = f"greatest(least(abs({z}), 30.0::DOUBLE), 1e-300::DOUBLE)"
    term = f"exp((2 * k + 1) * ln({x}) - lgamma(2.0::DOUBLE * k + 2) + k * ln(2.0::DOUBLE) + lgamma(k + 1.0::DOUBLE) - {x} * {x} / 2)"
    return f"greatest(1 - 2 * list_sum(list_transform(generate_series(0, 1200), lambda k: {term})) / sqrt(2 * pi()), 0)"


@job("logrank", sql(f"""
SELECT CAST(o AS BIGINT) AS observed, {rnd('e')} AS expected, {rnd('v')} AS variance,
  {rnd('(o - e) * (o - e) / v')} AS chi2, {rnd(two_sided('sqrt((o - e) * (o - e) / v)'))} AS p
FROM (SELECT sum(d1) AS o, sum(d * n1 / n) AS e,
  sum(CASE WHEN n > 1 THEN d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v
  FROM (SELECT duration, CAST(count(*) FILTER (event = 1) AS DOUBLE) AS d,
    CAST(count(*) FILTER (event = 1 AND start_season < 1998) AS DOUBLE) AS d1,
    CAST(sum(count(*)) OVER (ORDER BY duration DESC) AS DOUBLE) AS n,
    CAST(sum(count(*) FILTER (start_season < 1998)) OVER (ORDER BY duration DESC) AS DOUBLE) AS n1
    FROM targets GROUP BY duration))""", "targets"))
def logrank(spark, sf):
    out = sv.logrank(targets(spark, sf), "duration", "event", F.col("start_season") < 1998)
    return out.select("observed", *[rounded(F.col(c)).alias(c) for c in ("expected", "variance", "chi2", "p")])


CIF = """SELECT *, coalesce(lag(s) OVER (ORDER BY duration), 1) AS s0 FROM (
  SELECT duration, n, d1, d2, d1 + d2 AS d, product(1 - (d1 + d2) / n) OVER (ORDER BY duration) AS s FROM (
    SELECT duration, CAST(count(*) FILTER (cause = 1) AS DOUBLE) AS d1, CAST(count(*) FILTER (cause = 2) AS DOUBLE) AS d2,
      CAST(sum(count(*)) OVER (ORDER BY duration DESC) AS DOUBLE) AS n FROM targets GROUP BY duration))"""
CIF2 = """SELECT *, sum(s0 * d1 / n) OVER (ORDER BY duration) AS f1, sum(s0 * d2 / n) OVER (ORDER BY duration) AS f2 FROM cif"""


def _var(k):
    return f"""SELECT t.duration, sum(CASE WHEN i.n > i.d THEN (t.f{k} - i.f{k}) * (t.f{k} - i.f{k}) * i.d / (i.n * (i.n - i.d)) ELSE 0 END
      + i.s0 * i.s0 * i.d{k} * (i.n - i.d{k}) / (i.n * i.n * i.n) - 2 * (t.f{k} - i.f{k}) * i.s0 * i.d{k} / (i.n * i.n)) AS v
      FROM cif2 t JOIN cif2 i ON i.duration <= t.duration GROUP BY t.duration"""


@job("aalen_johansen", sql(f"""
SELECT duration, CAST(n AS BIGINT) AS n_risk, {rnd('s')} AS s, CAST(d1 AS BIGINT) AS d_1, {rnd('f1')} AS cif_1,
  {rnd('v1.v', 8)} AS var_1, CAST(d2 AS BIGINT) AS d_2, {rnd('f2')} AS cif_2, {rnd('v2.v', 8)} AS var_2
FROM cif2 JOIN v1 USING (duration) JOIN v2 USING (duration)""", "targets", cif=CIF, cif2=CIF2, v1=_var(1), v2=_var(2)))
def aalen_johansen(spark, sf):
    out = sv.aalen_johansen(targets(spark, sf), "duration", "cause", [1, 2])
    return out.select("duration", "n_risk", "d_1", "d_2",
                      *[rounded(F.col(c)).alias(c) for c in ("s", "cif_1", "cif_2")],
                      *[rounded(F.col(c), 8).alias(c) for c in ("var_1", "var_2")])


CELLS = "SELECT duration AS t, event AS e, start_season AS score, count(*) AS n FROM targets GROUP BY ALL"


@job("concordance_harrell", sql(f"""
SELECT CAST(sum(i.n * j.n) AS DOUBLE) AS comparable,
  CAST(sum(CASE WHEN j.score > i.score THEN i.n * j.n ELSE 0 END) AS DOUBLE) AS concordant,
  CAST(sum(CASE WHEN j.score = i.score THEN i.n * j.n ELSE 0 END) AS DOUBLE) AS tied,
  {rnd('sum(i.n * j.n * CASE WHEN j.score > i.score THEN 1.0 WHEN j.score = i.score THEN 0.5 ELSE 0 END) / sum(i.n * j.n)')} AS c_index
FROM cells i JOIN cells j ON i.e = 1 AND (j.t > i.t OR (j.t = i.t AND j.e = 0))""", "targets", cells=CELLS))
def concordance_harrell(spark, sf):
    out = harrell(targets(spark, sf), "duration", "event", "start_season")
    # Pair counts are doubles: at scale they leave the range of a long.
    return out.select(*[rounded(F.col(c), 0).alias(c) for c in ("comparable", "concordant", "tied")],
                      rounded(F.col("c_index")).alias("c_index"))


G = """SELECT duration, product(1 - c / n) OVER (ORDER BY duration) AS g FROM risk"""


@job("concordance_uno", sql(f"""
SELECT {rnd('sum(w * i.n * j.n * CASE WHEN j.score > i.score THEN 1.0 WHEN j.score = i.score THEN 0.5 ELSE 0 END) / sum(w * i.n * j.n)')} AS c_uno
FROM (SELECT cells.*, 1.0 / pow(greatest(g, 1e-8), 2) AS w FROM cells JOIN g ON g.duration = cells.t) i
JOIN cells j ON i.e = 1 AND j.t > i.t AND i.t <= (SELECT max(t) FROM cells WHERE e = 1)""",
    "targets", cells=CELLS, risk=RISK, g=G))
def concordance_uno(spark, sf):
    t = materialized(targets(spark, sf))  # read by the curve and by the score
    g = sv.censoring_curve(t, "duration", "event")
    out = uno(t, "duration", "event", "start_season", g)
    return out.select(rounded(F.col("c_uno")).alias("c_uno"))


# Predicted S(h): the pooled curve moved by the entity's start season.
def _predicted(h):
    return F.pow(F.lit(0.8), F.lit(float(h)) * (F.lit(1.0) + (F.col("start_season") - 1998) / F.lit(10.0)))


def _brier_sql(h):
    p = f"pow(0.8, {h}.0 * (1.0 + (start_season - 1998) / 10.0))"
    return f"""SELECT {h}.0::DOUBLE AS horizon, count(*) AS n, sum(CASE
      WHEN t.duration <= {h} AND event = 1 THEN {p} * {p} / greatest(g.g, 1e-8)
      WHEN t.duration > {h} THEN (1 - {p}) * (1 - {p}) / greatest((SELECT arg_max(g, duration) FROM g WHERE duration <= {h}), 1e-8)
      ELSE 0 END) / count(*) AS brier FROM targets t JOIN g ON g.duration = t.duration"""


BRIER = " UNION ALL ".join(_brier_sql(h) for h in (2, 4, 6))


def _brier(spark, sf):
    t = materialized(targets(spark, sf))  # read by the curve and by the score
    g = sv.censoring_curve(t, "duration", "event")
    for h in (2, 4, 6):
        t = t.withColumn(f"p{h}", _predicted(h))
    return sv.ipcw_brier(t, "duration", "event", {2: "p2", 4: "p4", 6: "p6"}, g)


@job("ipcw_brier", sql(f"SELECT horizon, n, {rnd('brier')} AS brier FROM brier", "targets", risk=RISK, g=G, brier=BRIER))
def ipcw_brier(spark, sf):
    return _brier(spark, sf).select("horizon", "n", rounded(F.col("brier")).alias("brier"))


@job("integrated_brier", sql(f"""
SELECT {rnd('ibs')} AS ibs, {rnd('(0.25 - ibs) / 0.25')} AS skill FROM (
  SELECT sum((horizon - h0) * (brier + b0) / 2) / (max(horizon) - min(horizon)) AS ibs FROM (
    SELECT *, lag(horizon) OVER (ORDER BY horizon) AS h0, lag(brier) OVER (ORDER BY horizon) AS b0 FROM brier))""",
    "targets", risk=RISK, g=G, brier=BRIER))
def integrated_brier(spark, sf):
    return sv.integrated_brier(_brier(spark, sf)).select(
        rounded(F.col("ibs")).alias("ibs"), rounded(F.col("skill")).alias("skill"))


@job("person_period", sql(f"""
SELECT period, count(*) AS at_risk, count(*) FILTER (period = duration AND event = 1) AS events,
  {rnd('avg(CASE WHEN period = duration AND event = 1 THEN 1 ELSE 0 END)')} AS hazard
FROM (SELECT duration, event, CAST(unnest(range(1, duration + 1)) AS INTEGER) AS period FROM targets) GROUP BY period""",
    "targets"))
def person_period(spark, sf):
    pp = sv.person_period(targets(spark, sf), "duration", "event", ["entity", "stint_no"])
    h = sv.hazard_by_period(pp)
    return h.select("period", "at_risk", "events", rounded(F.col("hazard")).alias("hazard"))


@job("surv_to_class", sql(f"""
SELECT entity, stint_no, {rnd('p0 / (p0 + p1 + p2)')} AS p0, {rnd('p1 / (p0 + p1 + p2)')} AS p1, {rnd('p2 / (p0 + p1 + p2)')} AS p2,
  CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS predicted,
  CASE WHEN median <= 2 THEN 0 WHEN median <= 4 THEN 1 ELSE 2 END AS predicted_by_median
FROM (SELECT entity, stint_no, greatest(1 - s2, 0) AS p0, greatest(s2 - s4, 0) AS p1, greatest(s4, 0) AS p2,
    least(99, ln(0.5) / (ln(0.8) * (1.0 + (start_season - 1998) / 10.0))) AS median
  FROM (SELECT *, pow(0.8, 2.0 * (1.0 + (start_season - 1998) / 10.0)) AS s2,
    pow(0.8, 4.0 * (1.0 + (start_season - 1998) / 10.0)) AS s4 FROM targets))""", "targets"))
def surv_to_class(spark, sf):
    t = targets(spark, sf).withColumn("s2", _predicted(2)).withColumn("s4", _predicted(4))
    probs = sv.surv_to_class(F.col("s2"), F.col("s4"))
    median = F.least(F.lit(99.0), F.lit(0.5 ** 0.0) * F.ln(F.lit(0.5))
                     / (F.ln(F.lit(0.8)) * (1.0 + (F.col("start_season") - 1998) / 10.0)))
    by_median = F.when(median <= 2, 0).when(median <= 4, 1).otherwise(2)
    return t.select("entity", "stint_no", *[rounded(p).alias(f"p{i}") for i, p in enumerate(probs)],
                    sv.argmax(probs).alias("predicted"), by_median.alias("predicted_by_median"))
