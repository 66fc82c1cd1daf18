import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellkit.models import aft, cox, impute, ordinal, select
from dwellkit.operators.aggregates import vif
from dwellkit.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        a, b = rng.gauss(0, 1), rng.gauss(2, 3)
        t = max(1, min(9, int(rng.expovariate(0.25 * math.exp(0.5 * a - 0.1 * b))) + 1))
        rows.append((i, i // 3, t, int(rng.random() < 0.8), a, b))
    return rows, spark.createDataFrame(rows, "id int, g int, t int, e int, a double, b double").cache()


def efron(rows, beta):
    ll = 0.0
    for t in {r[2] for r in rows if r[3] == 1}:
        dead = [r for r in rows if r[2] == t and r[3] == 1]
        eta = lambda r: beta[0] * r[4] + beta[1] * r[5]
        risk = sum(math.exp(eta(r)) for r in rows if r[2] >= t)
        own = sum(math.exp(eta(r)) for r in dead)
        ll += sum(eta(r) for r in dead) - sum(math.log(risk - k / len(dead) * own) for k in range(len(dead)))
    return ll


def test_cox_is_at_the_optimum(sample):
    rows, df = sample
    m = cox.fit(df, "t", "e", ["a", "b"])[0]
    assert np.max(np.abs(m.gradient)) < 1e-6
    best = efron(rows, m.coef)
    for step in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)):
        assert efron(rows, m.coef + np.array(step)) < best


def test_cox_covariance_is_the_inverse_curvature(sample):
    rows, df = sample
    m = cox.fit(df, "t", "e", ["a", "b"])[0]
    h = 1e-4
    second = (efron(rows, m.coef + [h, 0]) - 2 * efron(rows, m.coef) + efron(rows, m.coef - [h, 0])) / h ** 2
    cross = (efron(rows, m.coef + [h, h]) - efron(rows, m.coef + [h, -h]) - efron(rows, m.coef + [-h, h]) + efron(rows, m.coef - [h, h])) / (4 * h * h)
    last = (efron(rows, m.coef + [0, h]) - 2 * efron(rows, m.coef) + efron(rows, m.coef - [0, h])) / h ** 2
    cov = np.linalg.inv(-np.array([[second, cross], [cross, last]]))
    assert m.cov / np.outer(m.sd, m.sd) == pytest.approx(cov, rel=1e-3)


@pytest.mark.parametrize("s0,e0,d", [(50.0, 20.0, 6000), (20.0, 20.0, 6000), (20.0, 20.0, 2001), (5.0, 4.999999, 10 ** 6), (1e3, 1.0, 1999),
                                     (1e9, 1e4, 10 ** 4), (1e11, 1e4, 10 ** 4), (1e12, 1e6, 10 ** 6), (3.0, 2.0, 1)])
def test_tied_sums_equal_direct_sums(s0, e0, d):
    u = np.arange(d) / d
    phi = s0 - u * e0
    want = [math.fsum(x) for x in (1 / phi, u / phi, 1 / phi ** 2, u / phi ** 2, (u / phi) ** 2, np.log(phi))]
    assert cox._efron(s0, e0, d) == pytest.approx(want, rel=1e-9)


def test_lasso_drops_features_and_many_fits_agree(spark, sample):
    _, df = sample
    assert np.all(cox.fit(df, "t", "e", ["a", "b"], penalizer=10.0, l1_ratio=1.0)[0].beta == 0)
    # Bit 0 for all rows, bit 1 for even ones.
    mask = F.when(F.col("id") % 2 == 0, F.lit(b"\x03")).otherwise(F.lit(b"\x01"))
    joint = cox.fit(df, "t", "e", ["a", "b"], mask, 2)
    alone = cox.fit(df.filter("id % 2 = 0"), "t", "e", ["a", "b"])[0]
    assert joint[1].beta == pytest.approx(alone.beta, abs=1e-8)


def test_cluster_covariance_with_own_clusters_is_near_model_based(sample):
    _, df = sample
    m = cox.fit(df, "t", "e", ["a", "b"])[0]
    robust = cox.cluster_covariance(df, m, "t", "e", "id")
    assert np.sqrt(np.diag(robust)) == pytest.approx(np.sqrt(np.diag(m.cov)), rel=0.5)
    # Score residuals add up to the gradient, so one cluster for all rows gives (almost) nothing.
    assert np.max(np.abs(cox.cluster_covariance(df.withColumn("one", F.lit(1)), m, "t", "e", "one"))) < 1e-9


def test_survival_predictions_fall_and_ph_test_is_a_probability(spark, sample):
    _, df = sample
    m = cox.fit(df, "t", "e", ["a", "b"])[0]
    for r in cox.with_survival(df, m, [1, 3, 9]).collect():
        assert 1 >= r["s_1"] >= r["s_3"] >= r["s_9"] >= 0
    assert all(0 <= r["p"] <= 1 for r in cox.ph_test(spark, m).collect())


@pytest.mark.parametrize("kind", ["lognormal", "loglogistic"])
def test_aft_is_at_the_optimum(sample, kind):
    rows, df = sample
    m = aft.fit(df, kind, "t", "e", ["a", "b"])[0]
    assert np.max(np.abs(m.gradient)) < 1e-5

    def loglik(theta):
        x = np.column_stack([np.ones(len(rows)), (np.array([r[4:6] for r in rows]) - m.mean) / m.sd])
        y, e = np.log([r[2] for r in rows]), np.array([r[3] for r in rows])
        z = (y - x @ theta[:-1]) / math.exp(theta[-1])
        if kind == "lognormal":
            dens = -z * z / 2 - math.log(math.sqrt(2 * math.pi))
            tail = np.log([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
        else:
            dens, tail = z - 2 * np.log1p(np.exp(z)), -np.log1p(np.exp(z))
        return float(np.where(e == 1, dens - theta[-1] - y, tail).sum())
    assert loglik(m.theta) == pytest.approx(m.loglik, rel=1e-9)
    for j in range(4):
        for h in (0.01, -0.01):
            t = m.theta.copy()
            t[j] += h
            assert loglik(t) < m.loglik


def reference_low_rank(x, r, iters):
    miss = np.isnan(x)
    cur = np.where(miss, np.nanmean(x, axis=0), x)
    for _ in range(iters):
        _, _, vt = np.linalg.svd(cur, full_matrices=False)
        cur = np.where(miss, (cur @ vt[:r].T) @ vt[:r], cur)
    return cur, vt[:r]


@pytest.mark.parametrize("every", [2, 50])
def test_low_rank_equals_plain_svd(spark, every):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 6)) + 0.01 * rng.normal(size=(60, 6))
    x[rng.random(x.shape) < 0.15] = np.nan
    rows = [(i, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    m = impute.fit_low_rank(df, "x", n_components=2, max_iter=7, tol=0.0, checkpoint_every=every)
    _, basis = reference_low_rank(x, 2, 7)
    assert m.components.T @ m.components == pytest.approx(basis.T @ basis, abs=1e-8)
    out = {r["id"]: r["x"] for r in m.transform(df, "x").collect()}
    for i, row in enumerate(x):
        seen = ~np.isnan(row)
        assert np.array(out[i])[seen] == pytest.approx(row[seen])
        assert not np.isnan(out[i]).any()


def test_frank_hall_probabilities(spark):
    df = spark.createDataFrame([(0.7, 0.9), (0.6, 0.2), (0.0, 0.0)], "a double, b double")
    out = ordinal.with_classes(df, [F.col("a"), F.col("b")]).collect()
    for r in out:
        assert r["p0"] + r["p1"] + r["p2"] == pytest.approx(1.0)
        assert min(r["p0"], r["p1"], r["p2"]) >= 0
    assert out[0]["p1"] == 0.0 and out[2]["prediction"] == 0.0


def test_vif_of_collinear_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i % 7)) for i in range(30)], "a double, b double, c double")
    v = {r["feature"]: r["vif"] for r in vif(df, ["a", "b", "c"]).collect()}
    assert math.isinf(v["a"]) and math.isinf(v["b"]) and v["c"] >= 1.0


def test_out_of_fold_covers_every_row_once(spark):
    out = QUERIES["oof_predictions"](spark, SF)
    assert out.count() == out.select("entity", "start_season").distinct().count() == QUERIES["stint_islands"](spark, SF).count()


def test_reloaded_model_predicts_the_same(spark):
    assert QUERIES["model_persist"](spark, SF).first()["largest_gap"] == 0.0


def test_split_fits_on_training_rows_only(spark):
    out = QUERIES["leakage_free_split"](spark, SF).cache()
    sides = out.groupBy("entity").agg(F.count_distinct("side").alias("n")).filter("n > 1")
    assert sides.count() == 0
    assert out.filter("gap__filled IS NULL").count() == 0


def test_ordinal_model_probabilities(spark):
    for r in QUERIES["ordinal_frank_hall"](spark, SF).collect():
        assert r["p0"] + r["p1"] + r["p2"] == pytest.approx(1.0)


def test_bakeoff_null_model_is_one_half(spark):
    out = {(r["model"], r["metric"]): r["mean"] for r in QUERIES["survival_bakeoff"](spark, SF).collect()}
    assert out[("null", "harrell")] == 0.5 and out[("null", "uno")] == 0.5


def test_recent_scores_cover_open_stints_once(spark):
    out = QUERIES["score_recent"](spark, SF)
    assert out.count() == out.select("entity", "start_season").distinct().count()


def test_weibull_newton_agrees_with_the_single_fit_estimator(sample):
    _, df = sample
    ours = aft.fit(df, "weibull", "t", "e", ["a", "b"])[0]
    theirs, _ = aft.fit_weibull(df, "t", "e", ["a", "b"], max_iter=200)
    assert ours.coef == pytest.approx(theirs.coefficients.toArray(), abs=1e-3)
    assert ours.sigma == pytest.approx(theirs.scale, rel=1e-3)
    assert np.abs(ours.gradient).max() < 1e-5


def test_contrast_is_survival_at_the_means(spark, sample):
    _, df = sample
    m = cox.fit(df, "t", "e", ["a", "b"])[0]
    got = {(r["profile"], r["season"]): r for r in cox.contrast(spark, m, "a", -1.0, 1.0, [1, 2, 3]).collect()}
    at = spark.createDataFrame([(v, float(m.mean[1])) for v in (-1.0, 1.0)], "a double, b double")
    want = {r["a"]: r for r in cox.with_survival(at, m, [1, 2, 3]).collect()}
    for name, v in (("low", -1.0), ("high", 1.0)):
        assert [got[name, t]["survival"] for t in (1, 2, 3)] == pytest.approx([want[v][f"s_{t}"] for t in (1, 2, 3)])
        assert got[name, 2]["season_survival"] == pytest.approx(want[v]["s_2"] / want[v]["s_1"])
        assert got[name, 1]["median"] == want[v]["median"]


def test_fills_come_from_the_training_side_only(spark):
    rows = [(0, "train", 1.0), (0, "train", None), (0, "test", None), (0, "test", 50.0), (1, "train", 4.0), (1, "test", None), (1, "test", float("nan"))]
    df = spark.createDataFrame(rows, "seed int, side string, v double")
    for extra in (50.0, -7.0):
        changed = df.withColumn("v", F.when((F.col("side") == "test") & (F.col("v") == 50.0), extra).otherwise(F.col("v")))
        out = select.fill_from(changed.filter("side = 'train'"), changed, {"f": "v"}, ["seed"]).collect()
        assert sorted((r["seed"], r["side"], r["f"]) for r in out) == sorted(
            [(0, "train", 1.0), (0, "train", 1.0), (0, "test", 1.0), (0, "test", extra), (1, "train", 4.0), (1, "test", 4.0), (1, "test", 4.0)])


def test_any_model_can_rank_in_stability_selection(sample):
    _, df = sample
    rows = df.select("id", "t", "e", "a", F.col("b").alias("z"))

    def by_correlation(taken):
        per = taken.groupBy(F.col("b").alias("fit")).agg(F.abs(F.corr("t", "a")).alias("a"), F.abs(F.corr("t", "z")).alias("z"))
        first = F.when(F.col("a") >= F.col("z"), 1).otherwise(2)
        ranks = F.array(F.struct(F.lit("a").alias("feature"), first.alias("rank")), F.struct(F.lit("z").alias("feature"), (3 - first).alias("rank")))
        return per.select("fit", F.explode(ranks).alias("r")).select("fit", "r.*")
    out = select.stability_selection(rows, "id", "t", "e", ["a", "z"], [1, 2], times=6, importance_fn=by_correlation).collect()
    assert {(r["k"], r["feature"]) for r in out} == {(k, f) for k in (1, 2) for f in "az"}
    assert all(r["frequency"] == 1.0 for r in out if r["k"] == 2)
