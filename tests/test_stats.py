import math
import random
import statistics as stt

import pytest
from pyspark.sql import functions as F

from dwellkit.functions import dist
from dwellkit.functions.numeric import normal_two_sided
from dwellkit.operators import aggregates as ag
from dwellkit.operators import hypothesis as hy
from dwellkit.operators import metrics as mt
from dwellkit.operators import resample as rs
from dwellkit.operators import running as rn
from dwellkit.operators import splits as sp


def test_tails_against_known_values():
    t = dist.t_quantile(0.975, 9)
    th = math.atan(t / 3)       # closed form of the tail for nine degrees of freedom
    c = math.cos(th)
    area = (th + math.sin(th) * (c + 2 / 3 * c ** 3 + 8 / 15 * c ** 5 + 48 / 105 * c ** 7)) / math.pi
    assert 0.5 - area == pytest.approx(0.025, abs=1e-14)
    assert t == pytest.approx(2.26215716, abs=1e-8)
    assert dist.t_sf(2.0, 5) == pytest.approx(0.05096973941492914, rel=1e-10)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert dist.chi2_sf(30.0, 4) == pytest.approx(math.exp(-15) * 16, rel=1e-10)
    assert dist.binom_sf(8, 10) == pytest.approx(56 / 1024, rel=1e-12)
    assert dist.binom_sf(0, 10) == 1.0


def test_normal_tail_expression(spark):
    zs = [0.0, 0.5, -1.96, 2.999, 3.0, 4.0, 9.0, 30.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_two_sided(F.col("z")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-12)


def test_running_sums_with_ties_groups_and_negative_values(spark):
    rng = random.Random(1)
    rows = [(g, float(v), rng.randint(1, 9)) for g in "ab" for v in range(-40, 40)]
    out = rn.running(spark.createDataFrame(rows, "g string, v double, n int"), "v", {"c": F.col("n")}, ["g"]).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["c_before"] == sum(n for g, v, n in rows if g == r["g"] and v < r["v"])
        assert r["c_total"] == sum(n for g, _, n in rows if g == r["g"])


@pytest.mark.parametrize("n", [1, 2, 5, 200])
def test_exact_quantiles(spark, n):
    rng = random.Random(n)
    values = [rng.choice([1.0, 2.5, rng.random()]) for _ in range(n)]
    df = spark.createDataFrame([("x", v) for v in values] + [("y", 3.0)] * 50, "g string, v double")
    got = {r["g"]: r["m"] for r in rn.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert got["x"] == pytest.approx(stt.median(values)) and got["y"] == 3.0


def test_quantiles_of_a_very_hot_group(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 != 1, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
                                   (F.col("id") % 1000).cast("double").alias("v"))
    got = {r["g"]: r["m"] for r in rn.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == want


def test_kappa_edges(spark):
    def kappa(rows):
        return spark.createDataFrame(rows, "t int, p int").agg(mt.qwk_expr(F.col("t"), F.col("p")).alias("k")).first()["k"]
    assert kappa([(1, 1), (1, 1)]) == 1.0
    assert kappa([(0, 0), (1, 1), (2, 2)]) == 1.0
    assert kappa([(0, 2), (2, 0)]) == pytest.approx(-1.0)


def test_class_metrics_with_missing_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "t int, p int")
    per = {r["class"]: r for r in mt.per_class_prf(df, "t", "p", 3).collect()}
    assert per["2"]["f1"] == 0.0 and per["2"]["support"] == 0
    assert per["0"]["recall"] == 0.5 and per["0"]["precision"] == 1.0
    # Macro F1 leaves out a class that never occurs.
    assert mt.ordinal_summary(df, "t", "p", 3).first()["macro_f1"] == pytest.approx(2 / 3)


def test_auroc_missing_class_is_null(spark):
    df = spark.createDataFrame([(0, 0.9, 0.1), (0, 0.4, 0.2)], "t int, a double, b double")
    per = mt.auroc_ovr(df, "t", {0: "a", 1: "b"})
    assert mt.macro_auroc(per).first()["auroc_macro"] is None


def test_mannwhitney_all_equal_and_small(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0), ("b", 3.0)], "g string, v double")
    out = hy.mannwhitney(df, "v", "g", "a", "b").first()
    assert out["u"] == 2.0 and out["effect"] == "negligible"
    same = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    assert hy.mannwhitney(same, "v", "g", "a", "b").first()["u"] == 1.0


def test_split_quota_and_whole_groups(spark):
    rng = random.Random(4)
    rows = [(g, rng.randint(0, 2)) for g in range(300) for _ in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "g int, l int")
    sides = sp.split_stratified(df, "g", "l", 0.2, 7)
    got = sides.collect()
    assert len(got) == 300 and {r["side"] for r in got} == {"test", "train"}
    for c in range(3):
        quota = int(sum(1 for _, x in rows if x == c) * 0.2)
        taken = [r["n_rows"] for r in got if r["stratum"] == c and r["side"] == "test"]
        assert sum(taken) >= quota and sum(taken) - max(taken) < quota


def test_fewer_groups_than_folds(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "g int, l int")
    folds = [r["fold"] for r in sp.kfold(df, "g", 5, 1, "l").collect()]
    assert len(folds) == 3 and all(0 <= f < 5 for f in folds)


def test_subsample_size(spark):
    df = spark.range(101).select(F.col("id").alias("g"))
    n = {r["b"]: r["n"] for r in sp.subsample(df, "g", 0.5, 4, 1).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {b: 50 for b in range(4)}


def test_poisson_weights_have_mean_one(spark):
    df = spark.range(4000).select("id", F.lit(2.0).alias("v"))
    out = rs.poisson_sums(df, "id", {"v": F.col("v")}, 20, 3).collect()
    assert len(out) == 20
    assert stt.mean(r["n"] for r in out) == pytest.approx(4000, rel=0.02)
    assert all(r["v"] == 2.0 * r["n"] for r in out)


def test_bootstrap_cells_of_many_combinations_are_the_draws(spark):
    rows = [(i % 7, i * i % 11) for i in range(300)]
    df = spark.createDataFrame(rows, "x int, y int")
    got = {(r["b"], r["x"], r["y"]): r["n"] for r in rs.bootstrap_cells(df, ["x", "y"], 5, 1).collect()}
    ordered, want = sorted(rows), {}
    for r in rs.draws(spark, len(rows), 5, 1).collect():
        key = (r["b"], *ordered[r["u"]])
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_zscore_with_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, 3.0), (2, 5.0), (2, 7.0)], "p int, v double")
    every = sorted((r["p"], r["v"]) for r in ag.zscore_by_period(df, "p", ["v"]).collect() if r["v"] is not None)
    assert every == [(2, -1.0), (2, 1.0)]
    some = [(r["p"], r["v"]) for r in ag.zscore_by_period(df, "p", ["v"], omit_missing=True).collect()]
    assert sorted(x for x in some if x[1] is not None) == [(1, -1.0), (1, 1.0), (2, -1.0), (2, 1.0)]
    assert (1, None) in some


def test_running_exchanges_its_rows_once(spark):
    src = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", F.lit(0).alias(rn.RANGE))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = rn.running(src, "id", {"s": F.col("id")}, ["g"], ranged=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    top, below = plan.split("SortMergeJoin", 1)
    assert "Exchange" not in top and below[:below.index("Window")].count("Exchange") == 1


def test_running_keeps_null_groups(spark):
    src = spark.range(100).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), "id")
    got = rn.running(src, "id", {"s": F.lit(1)}, ["g"])
    per = {r["g"]: (r["n"], r["t"], r["b"]) for r in got.groupBy("g").agg(
        F.count("*").alias("n"), F.max("s_total").alias("t"), F.max("s_before").alias("b")).collect()}
    assert per == {None: (34, 34, 33), 1: (33, 33, 32), 2: (33, 33, 32)}
