"""What must hold of fitted models, next to the value that SQL expects.

The numbers of an iterative fit have no SQL form, but its score equations, the rows that it
predicts and the sums of its probabilities do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellkit.functions.numeric import rounded
from dwellkit.models import aft, cox
from dwellkit.plans import model_jobs as mj
from dwellkit.plans.base import sql
from dwellkit.plans.model_jobs import COX, FILL, SIDES
from dwellkit.plans.registry import job
from dwellkit.plans.resample_jobs import MODES, ORDERED

AFT_KINDS = ["loglogistic", "lognormal", "weibull"]


@job("fit_score_equations", " UNION ALL ".join(
    f"SELECT '{m}' AS model, CAST({j} AS INTEGER) AS parameter, 0.0::DOUBLE AS score"
    for m, n in [("cox", len(COX)), ("cox penalised", len(COX)), *[(k, len(COX) + 2) for k in AFT_KINDS]] for j in range(n)))
def fit_score_equations(spark, sf):
    """The gradient at each optimum, per row of data: all zero."""
    p = mj.panel(spark, sf)
    n = p.count()
    found = {"cox": cox.fit(p, "duration", "event", COX)[0].gradient,
             "cox penalised": cox.fit(p, "duration", "event", COX, penalizer=0.1)[0].gradient}
    found |= {k: aft.fit(p, k, "duration", "event", COX)[0].gradient for k in AFT_KINDS}
    rows = [(m, j, float(g) / n) for m, gs in found.items() for j, g in enumerate(gs)]
    return spark.createDataFrame(rows, "model string, parameter int, score double").withColumn("score", rounded(F.col("score")))


@job("cox_days_score_equations", " UNION ALL ".join(
    f"SELECT CAST({j} AS INTEGER) AS parameter, 0.0::DOUBLE AS score, (SELECT count(DISTINCT days) FROM d) AS n_times" for j in range(2)).join(
    ["WITH d AS (SELECT c_custkey, date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 AS days FROM customer JOIN orders ON c_custkey = o_custkey "
     "GROUP BY 1) SELECT * FROM (", ")"]))
def cox_days_score_equations(spark, sf):
    """The same for durations in days, of which there are as many as customers: from the first to the last order."""
    orders = mj.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("n_orders"))
    d = mj.table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select(
        (F.datediff("last", "first") + 1).alias("days"), (F.col("last") < "1998-06-01").cast("int").alias("over"), "n_orders", "c_acctbal")
    m = cox.fit(d, "days", "over", ["n_orders", "c_acctbal"])[0]
    rows = [(j, float(g) / m.n, m.life.count()) for j, g in enumerate(m.gradient)]
    return spark.createDataFrame(rows, "parameter int, score double, n_times bigint").withColumn("score", rounded(F.col("score")))


@job("cox_survival_shape", sql("SELECT count(*) AS n, 0 AS n_rising, 0 AS n_outside FROM features", "features"))
def cox_survival_shape(spark, sf):
    """Predicted survival never rises with the horizon and stays between 0 and 1."""
    s = mj.cox_survival_at(spark, sf)
    rising = (F.col("s_4") > F.col("s_2")) | (F.col("s_6") > F.col("s_4"))
    outside = F.greatest("s_2", "s_4", "s_6") > 1
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if(rising).cast("int").alias("n_rising"),
                 F.count_if(outside | (F.least("s_2", "s_4", "s_6") < 0)).cast("int").alias("n_outside"))


@job("oof_folds", sql("SELECT entity, start_season, CAST(least(floor(i / floor(n / 5)), 4) AS INTEGER) AS fold, duration, true AS predicted "
                      "FROM features JOIN ordered USING (entity)", "features", ordered=ORDERED))
def oof_folds(spark, sf):
    """Each row is predicted once, in the fold of its entity."""
    return mj.oof_predictions(spark, sf).select("entity", "start_season", "fold", "duration", F.col("prediction").isNotNull().alias("predicted"))


@job("score_recent_rows", sql("SELECT entity, start_season, entity IN (SELECT entity FROM features WHERE cause <> 0) AS refit, true AS predicted "
                              "FROM features WHERE cause = 0", "features"))
def score_recent_rows(spark, sf):
    """Each open stint is scored once; the refitted model serves the entities that training knows."""
    return mj.score_recent(spark, sf).select("entity", "start_season", "refit", F.col("prediction").isNotNull().alias("predicted"))


@job("frank_hall_probabilities", sql("SELECT entity, start_season, label, 1.0::DOUBLE AS total, true AS is_class FROM features JOIN sides USING (entity) WHERE side = 'test'",
                                     "features", modes=MODES, sides=SIDES))
def frank_hall_probabilities(spark, sf):
    """On the test side of the grouped split the class probabilities add up to one."""
    p = mj.ordinal_frank_hall(spark, sf)
    fine = (F.least("p0", "p1", "p2") >= 0) & F.col("prediction").isin(0, 1, 2)
    return p.select("entity", "start_season", "label", rounded(F.col("p0") + F.col("p1") + F.col("p2")).alias("total"), fine.alias("is_class"))


@job("tree_test_rows", sql("SELECT model, entity, start_season FROM features JOIN sides USING (entity), (VALUES ('boosted aft'), ('classes'), ('values')) m(model) WHERE side = 'test'",
                           "features", modes=MODES, sides=SIDES))
def tree_test_rows(spark, sf):
    """Every tree model predicts the whole test side of the grouped split and nothing else."""
    out = None
    for name, query, value in (("boosted aft", mj.aft_boosted, "log_time"), ("classes", mj.multiclass_trees, "prediction"),
                               ("values", mj.regress_trees, "prediction")):
        rows = query(spark, sf)
        if name == "boosted aft":
            keys = mj.features(spark, sf).select("entity", "stint_no", "start_season")
            rows = rows.join(keys, ["entity", "stint_no"])
        row = rows.filter(F.col(value).isNotNull()).select(F.lit(name).alias("model"), "entity", "start_season")
        out = row if out is None else out.unionByName(row)
    return out


@job("partial_dependence_sums", sql("SELECT 1.0::DOUBLE AS lowest, 1.0::DOUBLE AS highest"))
def partial_dependence_sums(spark, sf):
    """The class probabilities add up to one at every point of the grid."""
    total = rounded(F.col("p0") + F.col("p1") + F.col("p2"))
    return mj.partial_dependence(spark, sf).agg(F.min(total).alias("lowest"), F.max(total).alias("highest"))


@job("lowrank_keeps_values", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n_cells, 0 AS n_changed, 0 AS n_missing FROM embeddings""")
def lowrank_keeps_values(spark, sf):
    """Imputation fills every missing cell and leaves the others as they were."""
    filled = mj.impute_lowrank(spark, sf).select("vec_id", F.col("x").alias("f"))
    both = mj.holed(spark, sf).join(filled, "vec_id")
    pairs = F.arrays_zip("x", "f")
    changed = F.filter(pairs, lambda p: p["x"].isNotNull() & ~p["x"].eqNullSafe(p["f"]))
    missing = F.filter("f", lambda v: v.isNull() | F.isnan(v))
    return both.select("vec_id", F.size("f").alias("n_cells"), F.size(changed).alias("n_changed"), F.size(missing).alias("n_missing"))


@job("bakeoff_without_features", sql("SELECT metric, CAST(50 AS BIGINT) AS n, 0.5::DOUBLE AS mean FROM (VALUES ('harrell'), ('uno')) m(metric)"))
def bakeoff_without_features(spark, sf):
    """The model without features orders nothing: its concordance is one half in every split."""
    from dwellkit.models import select
    f = mj.features(spark, sf)
    table = select.bakeoff_table(select.bakeoff(f, "entity", "duration", "event", COX, mj.SEEDS, models=("null",), fill=FILL))
    return table.select("metric", "n", rounded(F.col("mean")).alias("mean"))


@job("stability_frequencies", " UNION ALL ".join(
    f"SELECT CAST({k} AS INTEGER) AS k, {float(k)}::DOUBLE AS total, 0 AS n_outside" for k in (1, 2, 3)))
def stability_frequencies(spark, sf):
    """Frequencies are shares, and k features are in the top k of every subsample."""
    s = mj.stability_selection(spark, sf)
    return s.groupBy("k").agg(rounded(F.sum("frequency")).alias("total"),
                              F.count_if((F.col("frequency") < 0) | (F.col("frequency") > 1)).cast("int").alias("n_outside"))
