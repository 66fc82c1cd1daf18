"""Many columns and long names: sizes of plans and rows that do not grow with them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellkit.operators import aggregates as ag
from dwellkit.operators import lookups as lk

K = 171


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(7)
    values = rng.normal(size=(600, K)) @ rng.normal(size=(K, K)) * 0.1 + rng.normal(size=(600, K)) + 1e6
    names = [f"c{i}" for i in range(K)]
    df = spark.createDataFrame([(v.tolist(),) for v in values], "v array<double>").repartition(5)
    return values, names, df.select(*[F.col("v")[i].alias(c) for i, c in enumerate(names)])


def test_correlations_of_many_columns(wide):
    values, names, df = wide
    got = {(r["a"], r["b"]): r["r"] for r in ag.corr_matrix(df, names).collect()}
    want = np.corrcoef(values.T)
    assert len(got) == K * (K - 1) // 2
    assert max(abs(got[a, b] - want[i, j]) for i, a in enumerate(names) for j, b in enumerate(names) if i < j) < 1e-8


def test_inflation_of_many_columns(wide):
    values, names, df = wide
    got = {r["feature"]: r["vif"] for r in ag.vif(df, names).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(values.T)))
    assert max(abs(got[c] / w - 1) for c, w in zip(names, want)) < 1e-6


def test_correlation_of_pairs_with_gaps(spark):
    rng = np.random.default_rng(3)
    cells = [[None if u < 0.2 else float("nan") if u < 0.25 else float(v) for u, v in zip(rng.random(4), rng.normal(size=4))] + [5.1, None]
             for _ in range(300)]
    names = list("abcdef")
    df = spark.createDataFrame([tuple(c) for c in cells], ", ".join(f"{c} double" for c in names))
    got = {(r["a"], r["b"]): r["r"] for r in ag.corr_matrix(df, names).collect()}
    x = np.array([[np.nan if v is None else v for v in c] for c in cells])
    for i, a in enumerate(names):
        for j in range(i + 1, 6):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if i < 4 and j < 4:
                assert got[a, names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-12)
            else:
                assert got[a, names[j]] is None
    assert [r["r"] for r in ag.corr_matrix(df.filter("false"), ["a", "b"]).collect()] == [None]
    assert {r["vif"] for r in ag.vif(df.filter("false"), ["a", "b"]).collect()} == {1.0}


def test_index_rows_follow_the_length_of_a_name(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(10_000))
    n = spark.createDataFrame([(long,)], "s string").select(F.size(lk._grams("s", F.array(F.lit(1), F.lit(2), F.lit(3))))).first()[0]
    assert 0 < n < 3 * len(long)


def test_names_that_contain_a_token(spark):
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abC"), rng.integers(0, 9))) for _ in range(150)] + [None, "x" * 10_000 + "needle"]
    tokens = ["".join(rng.choice(list("abc"), rng.integers(0, 6))) for _ in range(80)] + [None, "needle", "zzz", "é"]
    got = lk.containing(spark.createDataFrame([(t,) for t in tokens], "t string"), "t", spark.createDataFrame([(s,) for s in names], "s string"), "s")
    want = {}
    for t in tokens:
        hits = sorted(s for s in names if s and t and t in s.lower())
        if hits:
            want[t] = hits[0]
    assert {r["t"]: r["_found"] for r in got.collect()} == want and len(want) > 20
