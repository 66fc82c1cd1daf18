"""Jobs that fit, select, tune and explain models on the stint features."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.functions.hashing import hash_int
from dwellkit.functions.numeric import rounded
from dwellkit.models import aft, cox, explain, impute, ordinal, select
from dwellkit.operators import metrics as mt
from dwellkit.operators import splits as sp
from dwellkit.operators.concordance import harrell
from dwellkit.plans.base import FEATURES, rnd, sql, table, targets
from dwellkit.plans.base import features as lazy_features
from dwellkit.plans.registry import job
from dwellkit.plans.resample_jobs import J, MODES, int_of, md5_of
from dwellkit.functions.dist import t_quantile
from dwellkit.session import checkpoint_root, materialized

SEEDS = list(range(50))
COX = ["prior_orders", "mean_filled", "gap_filled", "acctbal", "nation"]


def features(spark, sf):
    """The feature table, written once: a fit reads it many times."""
    return materialized(lazy_features(spark, sf))


def panel(spark, sf):
    """Features with the two that are missing at a first stint filled by their column mean."""
    f = features(spark, sf)
    means = impute.column_means(f, ["mean_price", "gap"])
    return (f.withColumn("mean_filled", F.coalesce("mean_price", F.lit(means["mean_price"])))
            .withColumn("gap_filled", F.coalesce("gap", F.lit(means["gap"]))))


#: Columns that are missing at a first stint, filled by a mean of training rows.
FILL = {"mean_filled": "mean_price", "gap_filled": "gap"}


def filled_split(spark, sf, seed=42):
    """Train and test side; the missing values of both are filled from the training side."""
    train, test = split(features(spark, sf), seed)
    return select.fill_from(train, train, FILL), select.fill_from(train, test, FILL)


def split(df, seed=42):
    """Train and test side, written once: each pool or fit reads them several times."""
    sides = sp.split_stratified(df, "entity", "label", 0.2, seed).select("entity", "side")
    both = materialized(df.join(sides, "entity"))
    return both.filter("side = 'train'").drop("side"), both.filter("side = 'test'").drop("side")


# ------------------------------------------------------------------ survival models

@job("cox_fit")
def cox_fit(spark, sf):
    return cox.hazard_ratios(spark, cox.fit(panel(spark, sf), "duration", "event", COX)[0])


@job("cox_elastic_net")
def cox_elastic_net(spark, sf):
    """The published setting: penalizer 0.5, a quarter of it absolute; dropped features have a hazard ratio of 1."""
    return cox.hazard_ratios(spark, cox.fit(panel(spark, sf), "duration", "event", COX, penalizer=0.5, l1_ratio=0.25)[0]).select(
        "feature", "coef", "hr")


@job("cox_profile_contrast")
def cox_profile_contrast(spark, sf):
    m = cox.fit(panel(spark, sf), "duration", "event", COX, penalizer=0.1)[0]
    return cox.contrast(spark, m, "prior_orders", 0.0, 10.0, [1, 2, 3, 4, 5, 6])


@job("cox_cluster_se")
def cox_cluster_se(spark, sf):
    p = panel(spark, sf)
    m = cox.fit(p, "duration", "event", COX, penalizer=0.1)[0]
    return cox.hazard_ratios(spark, m, cox.cluster_covariance(p, m, "duration", "event", "entity"))


@job("cox_ph_test")
def cox_ph_test(spark, sf):
    return cox.ph_test(spark, cox.fit(panel(spark, sf), "duration", "event", COX, penalizer=0.1)[0])


@job("cox_survival_at")
def cox_survival_at(spark, sf):
    p = panel(spark, sf)
    m = cox.fit(p, "duration", "event", COX, penalizer=0.1)[0]
    return cox.with_survival(p, m, [2, 4, 6]).select("entity", "stint_no", "s_2", "s_4", "s_6", "median")


@job("aft_weibull")
def aft_weibull(spark, sf):
    return _aft(spark, sf, "weibull").drop("sigma")


def _aft(spark, sf, kind):
    p = panel(spark, sf)
    m = aft.fit(p, kind, "duration", "event", COX)[0]
    return p.select("entity", "stint_no", "duration", m.log_time().alias("log_time"), F.lit(m.sigma).alias("sigma"))


@job("aft_lognormal")
def aft_lognormal(spark, sf):
    return _aft(spark, sf, "lognormal")


@job("aft_loglogistic")
def aft_loglogistic(spark, sf):
    return _aft(spark, sf, "loglogistic")


@job("aft_boosted")
def aft_boosted(spark, sf):
    train, test = filled_split(spark, sf)
    _, score = aft.fit_boosted(train, "duration", "event", COX, max_iter=5)
    return score(test).select("entity", "stint_no", "duration", "log_time")


@job("survival_bakeoff")
def survival_bakeoff(spark, sf):
    return select.bakeoff_table(select.bakeoff(features(spark, sf), "entity", "duration", "event", COX, SEEDS, fill=FILL))


@job("split_train_means", sql(f"""
SELECT seed, {rnd('avg(mean_price)')} AS mean_price, {rnd('avg(gap)')} AS gap, count(*) AS n_train FROM (
  SELECT r.seed, entity, row_number() OVER (PARTITION BY r.seed ORDER BY {md5_of('r.seed', 'entity')}) - 1 AS i, count(*) OVER (PARTITION BY r.seed) AS n
  FROM (SELECT DISTINCT entity FROM features), (SELECT CAST(seed AS INTEGER) AS seed FROM range({len(SEEDS)}) s(seed)) r) JOIN features USING (entity)
WHERE i >= floor(n * 0.2) GROUP BY 1""", "features"))
def split_train_means(spark, sf):
    """The means that fill both sides of each split of the bake-off: of its training rows only."""
    rows = select.seed_splits(features(spark, sf), "entity", SEEDS)
    return rows.filter("side = 'train'").groupBy("seed").agg(
        rounded(F.avg("mean_price")).alias("mean_price"), rounded(F.avg("gap")).alias("gap"), F.count(F.lit(1)).alias("n_train"))


@job("expected_vs_null")
def expected_vs_null(spark, sf):
    p = panel(spark, sf)
    base = cox.hazard_ratios(spark, cox.fit(p, "duration", "event", COX[:2])[0])
    full = cox.hazard_ratios(spark, cox.fit(p, "duration", "event", COX)[0])
    f = full.select("feature", F.col("hr").alias("hr_full"))
    return base.select("feature", "hr").join(f, "feature").withColumn("pct_change", 100.0 * (F.col("hr_full") / F.col("hr") - 1))


# ------------------------------------------------------------------ preparation

@job("impute_mean", sql(f"""
SELECT entity, start_season, {rnd('coalesce(mean_price, (SELECT avg(mean_price) FROM features WHERE start_season < 2000))', 12)} AS mean_price,
  {rnd('coalesce(gap, (SELECT avg(gap) FROM features WHERE start_season < 2000))', 12)} AS gap,
  {rnd('coalesce(CASE WHEN start_season > 2050 THEN acctbal END, 0)')} AS never FROM features""", "features"))
def impute_mean(spark, sf):
    # "never" has no training value at all, so it becomes 0.
    f = features(spark, sf).withColumn("never", F.when(F.col("start_season") > 2050, F.col("acctbal")))
    means = impute.column_means(f.filter("start_season < 2000"), ["mean_price", "gap", "never"])
    return impute.impute_mean(f, means).select("entity", "start_season", *[rounded(F.col(c), 12).alias(c) for c in ("mean_price", "gap", "never")])


@job("standardize", sql(f"""
SELECT entity, start_season, {rnd('(acctbal - m1) / s1')} AS acctbal, {rnd('(prior_orders - m2) / s2')} AS prior_orders, 0.0::DOUBLE AS flat
FROM features, (SELECT avg(acctbal) AS m1, stddev_pop(acctbal) AS s1, avg(prior_orders) AS m2, stddev_pop(prior_orders) AS s2 FROM features WHERE start_season < 2000)""", "features"))
def standardize(spark, sf):
    f = features(spark, sf).withColumn("flat", F.lit(3.0))
    z = impute.standardize(f.filter("start_season < 2000"), f, ["acctbal", "prior_orders", "flat"])
    return z.select("entity", "start_season", *[rounded(F.col(c)).alias(c) for c in ("acctbal", "prior_orders", "flat")])


def holed(spark, sf):
    """Embeddings with a hash-chosen tenth of the cells missing."""
    e = table(spark, sf, "embeddings")
    gone = lambda x, i: F.when(hash_int(5, F.col("vec_id"), i) % 10 != 0, x.cast("double"))
    return e.select("vec_id", F.transform("embedding", gone).alias("x"))


@job("impute_lowrank")
def impute_lowrank(spark, sf):
    rows = holed(spark, sf)
    fitted = impute.fit_low_rank(rows, "x", n_components=10, max_iter=12)
    return fitted.transform(rows, "x")


SIDES = f"""SELECT entity, CASE WHEN before < floor(q.n * 0.2) THEN 'test' ELSE 'train' END AS side FROM (
  SELECT *, coalesce(sum(n_rows) OVER (PARTITION BY stratum ORDER BY {md5_of("'42'", 'entity')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM modes)
JOIN (SELECT label, count(*) AS n FROM targets GROUP BY 1) q ON q.label = stratum"""


@job("leakage_free_split", sql(f"""
SELECT entity, start_season, side, label, {", ".join(
    f"{rnd(f'coalesce({c}, (SELECT avg({c}) FROM features JOIN sides USING (entity) WHERE side = {chr(39)}train{chr(39)}))', 12)} AS {c}__filled"
    for c in FEATURES)}
FROM features JOIN sides USING (entity)""", "features", modes=MODES, sides=SIDES))
def leakage_free_split(spark, sf):
    """Grouped split; means are fitted on the training side only and applied to both."""
    train, test = split(features(spark, sf))
    prep = Pipeline(stages=ordinal.preparation(FEATURES)).fit(train)
    tag = lambda d, s: prep.transform(d).select("entity", "start_season", F.lit(s).alias("side"), "label",
                                                *[rounded(F.col(f"{c}__filled"), 12).alias(f"{c}__filled") for c in FEATURES])
    return tag(train, "train").unionByName(tag(test, "test"))


# ------------------------------------------------------------------ class and value models

@job("ordinal_frank_hall")
def ordinal_frank_hall(spark, sf):
    train, test = split(features(spark, sf))
    model = ordinal.FrankHall(FEATURES).fit(train, "label")
    return model.transform(test).select("entity", "start_season", "label", "p0", "p1", "p2", "prediction")


ABOVE = ("1 / (1 + exp(-(duration - 2.5)))", "1 / (1 + exp(-(duration - 3.5 - (start_season - 1998) / 2.0)))")


@job("ordinal_proba_math", sql(f"""
SELECT entity, start_season, {rnd('c0 / (c0 + c1 + c2)')} AS p0, {rnd('c1 / (c0 + c1 + c2)')} AS p1, {rnd('c2 / (c0 + c1 + c2)')} AS p2
FROM (SELECT entity, start_season, 1 - a0 AS c0, greatest(a0 - a1, 0) AS c1, a1 AS c2 FROM (SELECT entity, start_season, {ABOVE[0]} AS a0, {ABOVE[1]} AS a1 FROM targets))""", "targets"))
def ordinal_proba_math(spark, sf):
    d, y = F.col("duration"), F.col("start_season")
    above = [1 / (1 + F.exp(-(d - 2.5))), 1 / (1 + F.exp(-(d - 3.5 - (y - 1998) / 2.0)))]
    out = ordinal.with_classes(targets(spark, sf), above)
    return out.select("entity", "start_season", *[rounded(F.col(f"p{i}")).alias(f"p{i}") for i in range(3)])


@job("multiclass_trees")
def multiclass_trees(spark, sf):
    train, test = split(features(spark, sf))
    return ordinal.multiclass_trees(FEATURES, "label", max_iter=3).fit(train).transform(test).select("entity", "start_season", "label", "prediction")


@job("regress_trees")
def regress_trees(spark, sf):
    train, test = split(features(spark, sf))
    gbt = GBTRegressor(featuresCol="features", labelCol="duration", maxIter=5, maxDepth=3, seed=7)
    return Pipeline(stages=[*ordinal.preparation(FEATURES), gbt]).fit(train).transform(test).select(
        "entity", "start_season", "duration", "prediction")


@job("baseline_linear")
def baseline_linear(spark, sf):
    """Linear baselines and a small network on the same split: (model, n, score)."""
    train, test = split(features(spark, sf))
    prep = Pipeline(stages=[*ordinal.preparation(FEATURES), StandardScaler(inputCol="features", outputCol="z", withMean=True)]).fit(train)
    tr, te = prep.transform(train).persist(), prep.transform(test)
    fits = {"logistic": LogisticRegression(featuresCol="z", labelCol="label", regParam=0.05, elasticNetParam=0.5, maxIter=30),
            "mlp": MultilayerPerceptronClassifier(featuresCol="z", labelCol="label", layers=[len(FEATURES), 8, 3], maxIter=30, seed=7),
            "svm": OneVsRest(classifier=LinearSVC(featuresCol="z", maxIter=10), featuresCol="z", labelCol="label")}
    out = None
    for name, est in fits.items():
        pred = est.fit(tr).transform(te)
        row = pred.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("score"))
        row = row.select(F.lit(name).alias("model"), "n", "score")
        out = row if out is None else out.unionByName(row)
    lin = LinearRegression(featuresCol="z", labelCol="duration", regParam=0.1).fit(tr).transform(te)
    out = out.unionByName(lin.agg(F.lit("linear").alias("model"), F.count(F.lit(1)).alias("n"), mt.regression_summary(
        lin.withColumn("duration", F.col("duration").cast("double")), "duration", "prediction").select("rmse").scalar().alias("score")))
    tr.unpersist()
    return out


@job("tune_random_search")
def tune_random_search(spark, sf):
    """Distinct hash-sampled settings scored by kappa over grouped folds: (trees, depth, kappa, best)."""
    import hashlib

    f = features(spark, sf)
    data = f.join(sp.kfold(f, "entity", 3, 42, "label").select("entity", "fold"), "entity").persist()
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", seed=7)
    grid = [(t, d) for t in (3, 5, 8) for d in (2, 3, 4)]
    grid.sort(key=lambda p: hashlib.md5(f"42:{p}".encode()).hexdigest())
    settings = [{rf.numTrees: t, rf.maxDepth: d} for t, d in grid[:3]]
    cv = CrossValidator(estimator=Pipeline(stages=[*ordinal.preparation(FEATURES), rf]), estimatorParamMaps=settings,
                        evaluator=ordinal.KappaEvaluator("label", "prediction"), foldCol="fold", numFolds=3, parallelism=3)
    scores = cv.fit(data).avgMetrics
    data.unpersist()
    best = max(scores)
    return spark.createDataFrame([(t, d, float(s), bool(s == best)) for (t, d), s in zip(grid, scores)],
                                 "trees int, depth int, kappa double, best boolean")


@job("tune_survival_models")
def tune_survival_models(spark, sf):
    """Penalised Cox and accelerated failure models by C-index over grouped folds."""
    f = features(spark, sf)
    data = materialized(f.join(sp.kfold(f, "entity", 3, 42, "label").select("entity", "fold"), "entity"))
    spaces = [("cox", select.cox_builder("duration", "event", COX),
               [{"penalizer": p, "l1_ratio": r} for p in (0.01, 0.1) for r in (0.0, 0.5)]),
              ("aft", select.aft_builder("duration", "event", COX), [{"kind": k} for k in ("weibull", "lognormal", "loglogistic")])]
    return select.tune(data, spaces, lambda d, by: harrell(d, "duration", "event", "score", by=by).select(
        *by, F.col("c_index").alias("value")), 3, FILL)


@job("oof_predictions")
def oof_predictions(spark, sf):
    """Every row predicted exactly once by a model that has not seen its entity."""
    f = features(spark, sf)
    data = materialized(f.join(sp.kfold(f, "entity", 5, 42), "entity"))
    pipe = Pipeline(stages=[*ordinal.preparation(FEATURES), LinearRegression(labelCol="duration", regParam=0.1)])
    out = None
    for k in range(5):
        part = pipe.fit(data.filter(F.col("fold") != k)).transform(data.filter(F.col("fold") == k))
        part = part.select("entity", "start_season", "fold", "duration", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(train):
    return [r["feature"] for r in cox.importance(train.sparkSession, cox.fit(train, "duration", "event", COX, penalizer=0.1)).orderBy("rank").collect()]


def _scored(train, test, feats):
    if not feats:
        return test.withColumn("score", F.lit(0.0))
    return test.withColumn("score", -cox.fit(train, "duration", "event", feats, penalizer=0.1)[0].linear_predictor())


@job("topk_sweep")
def topk_sweep(spark, sf):
    """C on the test side for the k best features, ranked on the training side."""
    train, test = filled_split(spark, sf)
    train, out = train.persist(), None
    order = _ranked(train)
    for k in (1, 2, 3, 5):
        row = _scored(train, test, order[:k]).withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    train.unpersist()
    per = harrell(out, "duration", "event", "score", by=["k"]).select("k", "c_index")
    # One row per k reaches the window.
    best = F.max_by("k", F.struct("c_index", -F.col("k"))).over(W.partitionBy(F.lit(0)))
    return per.withColumn("best", F.col("k") == best)


BLOCKS = {"none": [], "history": ["prior_orders", "mean_filled"], "timing": ["gap_filled"], "profile": ["acctbal", "nation"], "all": COX}


@job("block_ablation")
def block_ablation(spark, sf):
    """C on the test side by named feature block; without features it is one half."""
    train, test = filled_split(spark, sf)
    train, out = train.persist(), None
    for name, feats in BLOCKS.items():
        row = _scored(train, test, feats).withColumns({"block": F.lit(name), "n_features": F.lit(len(feats))})
        out = row if out is None else out.unionByName(row)
    train.unpersist()
    by = ["block", "n_features"]
    return harrell(out, "duration", "event", "score", by=by).select(*by, "c_index")


@job("population_ablation")
def population_ablation(spark, sf):
    """C on the test side when the training pool, its era or its open stints are left out."""
    train, test = split(features(spark, sf))
    pools = {"all": F.lit(True), "first stints": F.col("stint_no") == 1, "before 1998": F.col("start_season") < 1998,
             "from 1998": F.col("start_season") >= 1998, "closed stints": F.col("cause") != 0}
    out = None
    for name, keep in pools.items():
        part = train.filter(keep)
        row = _scored(select.fill_from(part, part, FILL), select.fill_from(part, test, FILL), COX).withColumn("pool", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return harrell(out, "duration", "event", "score", by=["pool"]).select("pool", "c_index")


@job("stability_selection")
def stability_selection(spark, sf):
    return select.stability_selection(features(spark, sf), "entity", "duration", "event", COX, [1, 2, 3], fill=FILL)


@job("importance_rank")
def importance_rank(spark, sf):
    return cox.importance(spark, cox.fit(panel(spark, sf), "duration", "event", COX, penalizer=0.1)).select("feature", "value", "rank")


# ------------------------------------------------------------------ explanation

SHAP = ["prior_orders", "prior_spend", "acctbal", "nation"]


def _slopes(f):
    """Per threshold of the label, the slope of (label > k) on each feature; and the means."""
    one = f.agg(*[F.regr_slope((F.col("label") > k).cast("double"), F.col(c)).alias(f"b{k}_{c}") for k in (0, 1) for c in SHAP],
                *[F.avg(c).alias(f"m_{c}") for c in SHAP]).first()
    return [{c: one[f"b{k}_{c}"] for c in SHAP} for k in (0, 1)], {c: one[f"m_{c}"] for c in SHAP}


CONTRIB = " UNION ALL ".join(f"""SELECT entity, start_season, '{c}' AS feature,
  (abs((SELECT regr_slope(CAST(label > 0 AS DOUBLE), {c}) FROM features) * ({c} - (SELECT avg({c}) FROM features)))
   + abs((SELECT regr_slope(CAST(label > 1 AS DOUBLE), {c}) FROM features) * ({c} - (SELECT avg({c}) FROM features)))) / 2 AS value FROM features""" for c in SHAP)


def _contributions(spark, sf):
    f = features(spark, sf)
    weights, means = _slopes(f)
    return f, explain.contributions(f, ["entity", "start_season"], weights, means)


@job("linear_attribution", sql(f"SELECT feature, {rnd('avg(value)')} AS mean_abs FROM contrib GROUP BY 1", "features", contrib=CONTRIB))
def linear_attribution(spark, sf):
    _, long = _contributions(spark, sf)
    return explain.mean_attribution(long).select("feature", rounded(F.col("mean_abs")).alias("mean_abs"))


@job("attribution_by_group", sql(f"""
SELECT segment, era, count(*) AS n, {rnd('avg(ratio)', 4)} AS mean_ratio, {rnd('avg(CAST(ratio > 1 AS INTEGER))')} AS share_above_one FROM (
  SELECT entity, start_season, CASE WHEN start_season < 1998 THEN 'early' ELSE 'late' END AS era,
    avg(value) FILTER (feature IN ('acctbal', 'nation')) / avg(value) FILTER (feature IN ('prior_orders', 'prior_spend')) AS ratio
  FROM contrib GROUP BY 1, 2) JOIN (SELECT c_custkey, c_mktsegment AS segment FROM customer) ON c_custkey = entity GROUP BY 1, 2 HAVING count(*) >= 10""",
    "features", contrib=CONTRIB))
def attribution_by_group(spark, sf):
    _, long = _contributions(spark, sf)
    ratios = explain.family_ratio(long, ["entity", "start_season"], SHAP[:2], SHAP[2:])
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"))
    rows = ratios.join(cust, "entity").withColumn("era", F.when(F.col("start_season") < 1998, "early").otherwise("late"))
    out = explain.ratio_by_group(rows, ["segment", "era"])
    return out.select("segment", "era", "n", rounded(F.col("mean_ratio"), 4).alias("mean_ratio"),
                      rounded(F.col("share_above_one")).alias("share_above_one"))


SEEDED = f"""SELECT seed, feature, abs(CASE feature {" ".join(f"WHEN '{c}' THEN c_{c}" for c in SHAP)} END) AS value FROM (
  SELECT seed, {", ".join(f"corr(duration, {c}) AS c_{c}" for c in SHAP)} FROM (SELECT CAST(seed AS INTEGER) AS seed, f.* FROM features f, range({J}) r(seed)
    WHERE {int_of('seed', 'entity')} % 5 <> 0) GROUP BY 1), (VALUES {", ".join(f"('{c}')" for c in SHAP)}) v(feature)"""


@job("normalized_importance_ci", sql(f"""
SELECT feature, n, {rnd('m')} AS mean, {rnd(f'm - {t_quantile(0.975, J - 1)!r} * sd / sqrt(n)')} AS ci_low, {rnd(f'm + {t_quantile(0.975, J - 1)!r} * sd / sqrt(n)')} AS ci_high,
  CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank
FROM (SELECT feature, count(*) AS n, avg(share) AS m, stddev_samp(share) AS sd FROM (SELECT feature, value / sum(value) OVER (PARTITION BY seed) AS share FROM seeded) GROUP BY 1)""",
    "features", seeded=SEEDED))
def normalized_importance_ci(spark, sf):
    f = features(spark, sf).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(J - 1))))
    train = f.filter(hash_int(F.col("seed"), F.col("entity")) % 5 != 0)
    wide = train.groupBy("seed").agg(*[F.abs(F.corr("duration", c)).alias(c) for c in SHAP])
    out = explain.normalized_importance_ci(wide.unpivot(["seed"], SHAP, "feature", "value"))
    return out.select("feature", "n", "rank", *[rounded(F.col(c)).alias(c) for c in ("mean", "ci_low", "ci_high")])


@job("partial_dependence")
def partial_dependence(spark, sf):
    f = features(spark, sf)
    model = ordinal.FrankHall(FEATURES, max_iter=3).fit(f, "label")
    return explain.partial_dependence(f, model, "prior_orders", ["p0", "p1", "p2"])


@job("score_recent")
def score_recent(spark, sf):
    """Open stints scored; entities known from training by a model refitted without them."""
    f = panel(spark, sf)
    train, recent = f.filter("cause <> 0"), f.filter("cause = 0")
    known = recent.join(train.select("entity").distinct(), "entity", "left_semi").select("entity").distinct()
    seen, new = recent.join(known, "entity", "left_semi"), recent.join(known, "entity", "left_anti")
    pipe = Pipeline(stages=[*ordinal.preparation(FEATURES), LinearRegression(labelCol="duration", regParam=0.1)])
    full, refit = pipe.fit(train), pipe.fit(train.join(known, "entity", "left_anti"))
    out = lambda m, d, flag: m.transform(d).select("entity", "start_season", F.lit(flag).alias("refit"), "prediction")
    return out(refit, seen, True).unionByName(out(full, new, False))


@job("quadrant_matrix", sql("""
SELECT label AS class_bin, CASE WHEN spend IS NULL THEN -1 WHEN spend <= 3 THEN 0 WHEN spend <= 9 THEN 1 ELSE 2 END AS measure_bin, count(*) AS n
FROM (SELECT label, prior_spend AS spend FROM features) GROUP BY 1, 2""", "features"))
def quadrant_matrix(spark, sf):
    from dwellkit.functions.numeric import bin_right_closed
    return explain.quadrant_matrix(features(spark, sf), F.col("label"), bin_right_closed(F.col("prior_spend"), [3, 9]))


@job("model_persist", sql("SELECT count(*) AS n, 0.0::DOUBLE AS largest_gap FROM features", "features"))
def model_persist(spark, sf):
    """Fit, save to the shared folder, load, predict: (rows, largest difference of predictions)."""
    f = features(spark, sf)
    pipe = Pipeline(stages=[*ordinal.preparation(FEATURES), LinearRegression(labelCol="duration", regParam=0.1)])
    fitted = pipe.fit(f)
    path = f"{checkpoint_root(spark)}/model-{uuid.uuid4().hex}"
    fitted.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(fitted.transform(f).select(*f.columns, F.col("prediction").alias("before")))
    return again.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("prediction") - F.col("before"))).alias("largest_gap"))
