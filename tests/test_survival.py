import itertools
import math
import random

import pytest

from dwellkit.operators import survival as sv
from dwellkit.operators.concordance import harrell, uno


def frame(spark, rows, schema="t int, e int, s double"):
    return spark.createDataFrame(rows, schema)


def test_km_all_censored_stays_one(spark):
    c = sv.km_curve(frame(spark, [(1, 0, 0.0), (2, 0, 0.0)]), "t", "e").orderBy("t").collect()
    assert [r["s"] for r in c] == [1.0, 1.0]
    assert c[0]["ci_low"] is None


def test_km_event_at_last_time_reaches_zero_and_median(spark):
    curve = sv.km_curve(frame(spark, [(1, 1, 0.0), (2, 1, 0.0), (2, 0, 0.0), (3, 1, 0.0)]), "t", "e")
    s = {r["t"]: r["s"] for r in curve.collect()}
    assert s == pytest.approx({1: 0.75, 2: 0.5, 3: 0.0})
    assert sv.km_median_ci(curve, "t").first()["median"] == 2


def test_incidences_and_survival_sum_to_one(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 6), rng.choice([0, 1, 2]), 0.0) for _ in range(200)]
    out = sv.aalen_johansen(frame(spark, rows), "t", "e", [1, 2]).collect()
    for r in out:
        assert r["s"] + r["cif_1"] + r["cif_2"] == pytest.approx(1.0)
        assert r["var_1"] >= 0


def brute(rows, weight=lambda t: 1.0, uno_rule=False):
    comp = conc = tie = 0.0
    for (t, e, s), (u, f, q) in itertools.permutations(rows, 2):
        if e == 1 and (u > t or (not uno_rule and u == t and f == 0)):
            w = weight(t)
            comp, conc, tie = comp + w, conc + w * (q > s), tie + w * (q == s)
    return comp, conc, tie


@pytest.mark.parametrize("seed,spread", [(1, 4), (2, 50), (3, 1000)])
def test_concordance_equals_all_pairs(spark, seed, spread):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 9), rng.randint(0, 1), float(rng.randint(0, spread))) for _ in range(150)]
    got = harrell(frame(spark, rows), "t", "e", "s").first()
    assert (got["comparable"], got["concordant"], got["tied"]) == brute(rows)


def test_concordance_equal_scores_and_no_pairs(spark):
    assert harrell(frame(spark, [(1, 1, 2.0), (3, 1, 2.0)]), "t", "e", "s").first()["c_index"] == 0.5
    assert harrell(frame(spark, [(1, 0, 2.0), (3, 0, 1.0)]), "t", "e", "s").first()["c_index"] is None


def test_concordance_with_one_very_frequent_score(spark):
    rng = random.Random(9)
    rows = [(rng.randint(1, 5), 1, 7.0 if i % 3 == 0 else rng.random()) for i in range(120)]
    got = harrell(frame(spark, rows), "t", "e", "s").first()
    assert (got["comparable"], got["concordant"], got["tied"]) == brute(rows)


def test_uno_equals_all_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.randint(1, 7), rng.randint(0, 1), float(rng.randint(0, 9))) for _ in range(120)]
    df = frame(spark, rows)
    g = sv.censoring_curve(df, "t", "e")
    gv = {r["t"]: r["g"] for r in g.collect()}
    comp, conc, tie = brute(rows, lambda t: 1 / max(gv[t], 1e-8) ** 2, uno_rule=True)
    assert uno(df, "t", "e", "s", g).first()["c_uno"] == pytest.approx((conc + tie / 2) / comp)


def test_brier_by_hand(spark):
    rows = [(1, 1, 0.8), (2, 0, 0.6), (3, 1, 0.4), (4, 1, 0.9)]
    df = frame(spark, rows)
    g = sv.censoring_curve(df, "t", "e")           # one censoring at 2 among 3 at risk
    out = sv.ipcw_brier(df, "t", "e", {2.0: "s"}, g).first()
    expected = (0.8 ** 2 / 1.0 + ((1 - 0.4) ** 2 + (1 - 0.9) ** 2) / (2 / 3)) / 4
    assert out["brier"] == pytest.approx(expected)


def test_logrank_p_value(spark):
    from pyspark.sql import functions as F
    rows = [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (4, 1, 0.0), (5, 1, 0.0), (6, 0, 0.0)]
    out = sv.logrank(frame(spark, rows), "t", "e", F.col("s") == 1.0).first()
    assert out["p"] == pytest.approx(math.erfc(math.sqrt(out["chi2"] / 2)), rel=1e-6)
