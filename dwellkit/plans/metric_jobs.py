"""Jobs that score predictions: truth from the quantity of a line, prediction from its discount."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellkit.functions.numeric import rounded
from dwellkit.operators import metrics as mt
from dwellkit.plans.base import features, rnd, sql, table, targets
from dwellkit.plans.registry import job
from dwellkit.session import materialized

PAIR = """SELECT l_orderkey, l_linenumber, CAST(least(2, floor(l_quantity / 17)) AS INTEGER) AS truth,
  CAST(least(2, floor(l_discount * 100 / 4)) AS INTEGER) AS pred, l_returnflag AS flag, year(l_shipdate) AS season,
  l_quantity / 100 AS p0, l_discount * 5 AS p1, l_tax * 5 AS p2 FROM lineitem"""
K = 3


def pairs(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.least(F.lit(2), F.floor(F.col("l_quantity") / 17)).cast("int").alias("truth"),
        F.least(F.lit(2), F.floor(F.col("l_discount") * 100 / 4)).cast("int").alias("pred"),
        F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("season"), (F.col("l_quantity") / 100).alias("p0"),
        (F.col("l_discount") * 5).alias("p1"), (F.col("l_tax") * 5).alias("p2"))


@job("confusion_matrix", sql(f"""
SELECT t.c AS truth, p.c AS predicted, count(x.truth) AS n, {rnd('count(x.truth) / (SELECT count(*) FROM pair z WHERE z.truth = t.c)')} AS row_share
FROM (VALUES (0), (1), (2)) t(c), (VALUES (0), (1), (2)) p(c) LEFT JOIN pair x ON x.truth = t.c AND x.pred = p.c GROUP BY 1, 2""", pair=PAIR))
def confusion_matrix(spark, sf):
    out = mt.confusion_matrix(pairs(spark, sf), "truth", "pred", K)
    return out.withColumn("row_share", rounded(F.col("row_share")))


QWK_SQL = """1 - sum((truth - pred) * (truth - pred)) / (
  SELECT sum((a.truth - b.pred) * (a.truth - b.pred) * a.n * b.n / (SELECT count(*) FROM pair))
  FROM (SELECT truth, count(*) AS n FROM pair GROUP BY 1) a, (SELECT pred, count(*) AS n FROM pair GROUP BY 1) b)"""


@job("qwk", sql(f"SELECT {rnd(QWK_SQL)} AS qwk FROM pair", pair=PAIR))
def qwk(spark, sf):
    return pairs(spark, sf).agg(rounded(mt.qwk_expr(F.col("truth"), F.col("pred"))).alias("qwk"))


PRF = """SELECT c.c AS cls, count(*) FILTER (truth = c.c AND pred = c.c) AS tp, count(*) FILTER (truth = c.c) AS sup, count(*) FILTER (pred = c.c) AS said
  FROM pair, (VALUES (0), (1), (2)) c(c) GROUP BY 1"""


@job("ordinal_summary", sql(f"""
SELECT {rnd('avg(abs(truth - pred))')} AS mae, {rnd('avg(CAST(abs(truth - pred) <= 1 AS INTEGER))')} AS adjacent_accuracy,
  {rnd('avg(CAST(truth = pred AS INTEGER))')} AS exact_accuracy, {rnd('(SELECT avg(2.0 * tp / (sup + said)) FROM prf)')} AS macro_f1 FROM pair""",
    pair=PAIR, prf=PRF))
def ordinal_summary(spark, sf):
    out = mt.ordinal_summary(pairs(spark, sf), "truth", "pred", K)
    return out.select(*[rounded(F.col(c)).alias(c) for c in ("mae", "adjacent_accuracy", "exact_accuracy", "macro_f1")])


@job("per_class_prf", sql(f"""
SELECT CAST(cls AS VARCHAR) AS class, {rnd('tp / said')} AS precision, {rnd('tp / sup')} AS recall, {rnd('2.0 * tp / (sup + said)')} AS f1, sup AS support FROM prf""",
    pair=PAIR, prf=PRF))
def per_class_prf(spark, sf):
    out = mt.per_class_prf(pairs(spark, sf), "truth", "pred", K)
    return out.select("class", "support", *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def _auc_sql(c):
    return f"""SELECT {c} AS cls, (sum(rk) FILTER (truth = {c}) - count(*) FILTER (truth = {c}) * (count(*) FILTER (truth = {c}) + 1) / 2.0)
      / (count(*) FILTER (truth = {c}) * count(*) FILTER (truth <> {c})) AS auroc, count(*) FILTER (truth = {c}) AS support
      FROM (SELECT truth, rank() OVER (ORDER BY p{c}) + (count(*) OVER (PARTITION BY p{c}) - 1) / 2.0 AS rk FROM pair)"""


@job("auroc_ovr_macro", sql(f"""SELECT cls AS class, support, {rnd('auroc')} AS auroc, {rnd('avg(auroc) OVER ()')} AS auroc_macro FROM auc""",
                            pair=PAIR, auc=" UNION ALL ".join(_auc_sql(c) for c in range(3))))
def auroc_ovr_macro(spark, sf):
    per = materialized(mt.auroc_ovr(pairs(spark, sf), "truth", {0: "p0", 1: "p1", 2: "p2"}))
    macro = mt.macro_auroc(per).scalar()
    return per.select("class", "support", rounded(F.col("auroc")).alias("auroc"), rounded(macro).alias("auroc_macro"))


@job("regression_summary", f"""
SELECT {rnd('avg(abs(e))')} AS mae, {rnd('avg(e * e)')} AS mse, {rnd('sqrt(avg(e * e))')} AS rmse, {rnd('1 - avg(e * e) / var_pop(y)')} AS r2, {rnd('corr(y, p)')} AS correlation
FROM (SELECT l_quantity AS y, l_discount * 500 AS p, l_quantity - l_discount * 500 AS e FROM lineitem)""")
def regression_summary(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_discount") * 500).alias("p"))
    out = mt.regression_summary(li, "y", "p")
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


@job("spearman", f"""
SELECT {rnd('corr(rx, ry)')} AS rho, count(*) AS n FROM (
  SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx,
    rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)""")
def spearman(spark, sf):
    out = mt.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select(rounded(F.col("rho")).alias("rho"), "n")


GROUPED = " UNION ALL ".join(f"SELECT '{g}' AS grouping, {e} AS subgroup, y, p FROM x" for g, e in (
    ("flag", "flag"), ("tax", "CASE WHEN tax <= 0.04 THEN 'low' ELSE 'high' END"), ("season", "CAST(season AS VARCHAR)")))


@job("subgroup_metrics", sql(f"""
SELECT "grouping", subgroup, count(*) AS n, {rnd('avg(abs(p - y))')} AS mae, {rnd('sqrt(avg((p - y) * (p - y)))')} AS rmse, {rnd('avg(p - y)')} AS bias,
  {rnd('median(abs(p - y))')} AS median_ae, {rnd('avg(y)')} AS mean_truth, {rnd('avg(p)')} AS mean_pred FROM grouped GROUP BY 1, 2""",
    x="SELECT l_quantity AS y, l_discount * 500 AS p, l_returnflag AS flag, l_tax AS tax, year(l_shipdate) AS season FROM lineitem",
    grouped=GROUPED.replace("AS grouping", 'AS "grouping"')))
def subgroup_metrics(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("p", F.col("l_discount") * 500)
    out = mt.subgroup_metrics(li, "l_quantity", "p", {
        "flag": F.col("l_returnflag"), "tax": F.when(F.col("l_tax") <= 0.04, "low").otherwise("high"), "season": F.year("l_shipdate")})
    return out.select("grouping", "subgroup", "n", *[rounded(F.col(c)).alias(c) for c in (
        "mae", "rmse", "bias", "median_ae", "mean_truth", "mean_pred")])


@job("constant_baseline", sql(f"""
SELECT {rnd('h / n')} AS precision, {rnd('2 * (h / n) / (h / n + 1)')} AS f1, {rnd('2 * (h / n) / (h / n + 1) / 3')} AS macro_f1, 0.5::DOUBLE AS auroc
FROM (SELECT count(*) FILTER (label = 2) AS h, count(*) AS n FROM targets)""", "targets"))
def constant_baseline(spark, sf):
    out = mt.constant_baseline(targets(spark, sf), "label", 2, 3)
    return out.select("auroc", *[rounded(F.col(c)).alias(c) for c in ("precision", "f1", "macro_f1")])


BINNED = """SELECT label AS truth, CASE WHEN r <= 2 THEN 0 WHEN r <= 4 THEN 1 ELSE 2 END AS pred
  FROM (SELECT label, greatest(1, round_even(acctbal * 0.5, 0)) AS r FROM features)"""


@job("regress_then_bin", sql(f"""
SELECT count(*) AS n, {rnd('avg(abs(truth - pred))')} AS mae, {rnd('avg(CAST(truth = pred AS INTEGER))')} AS exact_accuracy, {rnd(QWK_SQL)} AS qwk FROM pair""",
    "features", pair=BINNED))
def regress_then_bin(spark, sf):
    f = features(spark, sf).withColumn("pred", mt.regress_then_bin(F.col("acctbal") * 0.5, [2, 4]))
    miss = F.abs(F.col("label") - F.col("pred"))
    return f.agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(miss)).alias("mae"), rounded(F.avg((miss == 0).cast("int"))).alias("exact_accuracy"),
                 rounded(mt.qwk_expr(F.col("label"), F.col("pred"))).alias("qwk"))
