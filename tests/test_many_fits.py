"""Many fits over one copy of the rows, and models over any number of distinct times."""

import math
import os
import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellkit.functions.hashing import md5_table
from dwellkit.models import aft, cox, select
from dwellkit.models.design import design
from dwellkit.operators import resample as rs
from dwellkit.operators import splits as sp
from dwellkit.operators.running import last_step


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(600):
        a, b = rng.gauss(0, 1), rng.gauss(5, 2)
        t = round(1 + rng.expovariate(0.01 * math.exp(0.5 * a - 0.1 * b)))
        out.append((i, i // 4, t, int(rng.random() < 0.7), a, None if rng.random() < 0.2 else b, float("nan") if rng.random() < 0.1 else b))
    return spark.createDataFrame(out, "id int, g int, t int, e int, a double, b double, c double").cache()


def test_md5_of_many_short_texts():
    rng = random.Random(1)
    before = [b"", b"42:7:", b"x" * 30, b"y" * 70]
    keys = [bytes(rng.randrange(256) for _ in range(n % 61)) for n in range(300)]
    got = md5_table(before, keys)
    for i, k in enumerate(keys):
        for j, p in enumerate(before):
            assert got[i, j].tolist() == [int.from_bytes(md5(p + k).digest()[h:h + 8], "big") for h in (0, 8)]


@pytest.mark.parametrize("n", [1, 3, 500])
def test_cuts_are_the_hashes_of_the_last_taken(spark, n):
    groups = spark.createDataFrame([(f"g{i}",) for i in range(n)] + [(None,)], "g string")
    before = sp.prefixes(9, 40)
    for share in (0.0, 0.2, 0.5, 1.0):
        take = math.floor(n * share)
        cuts = sp.hash_cuts(groups, "g", before, lambda m: math.floor(m * share))
        got = {r["g"]: r["d"] for r in groups.select("g", sp.draws_of(F.col("g"), before, cuts).alias("d")).collect()}
        want = {f"g{i}": [] for i in range(n)} | {None: []}
        for b, p in enumerate(before):
            for g in sorted((f"g{i}" for i in range(n)), key=lambda g: md5((p + g).encode()).digest())[:take]:
                want[g].append(b)
        assert got == want
        masks = {r["g"]: r["m"] for r in groups.select("g", sp.mask_of(F.col("g"), before, cuts).alias("m")).collect()}
        assert all([b for b in range(40) if m[b // 8] >> b % 8 & 1] == want[g] for g, m in masks.items())


def test_cuts_outside_the_expected_place(spark, monkeypatch):
    monkeypatch.setattr(sp, "CUT_WIDTH", 1e-6)
    groups = spark.createDataFrame([(i,) for i in range(300)], "g int")
    before = sp.prefixes(1, 30)
    cuts = sp.hash_cuts(groups, "g", before, lambda m: m // 3)
    assert groups.select(F.explode(sp.draws_of(F.col("g"), before, cuts)).alias("b")).groupBy("b").count().filter("count = 100").count() == 30


def test_fits_with_masks_and_fills_equal_single_fits(spark, rows):
    fits = {0: F.col("id") % 2 == 0, 1: F.col("id") % 3 > 0, 2: F.col("g") < 90}
    bits = sum((F.when(keep, 1 << f).otherwise(0) for f, keep in fits.items()), F.lit(0))
    masked = rows.withColumn("m", F.unhex(F.lpad(F.hex(bits), 2, "0")))
    fill = {"bb": "b", "cc": "c"}
    joint = cox.fit(masked, "t", "e", ["a", "bb", "cc"], F.col("m"), 3, 0.1, fill=fill)
    joint_aft = aft.fit(masked, "weibull", "t", "e", ["a", "bb"], F.col("m"), 3, fill={"bb": "b"})
    for f, keep in fits.items():
        part = select.fill_from(rows.filter(keep), rows.filter(keep), fill)
        alone = cox.fit(part, "t", "e", ["a", "bb", "cc"], penalizer=0.1)[0]
        assert joint[f].n == alone.n and joint[f].coef == pytest.approx(alone.coef, abs=1e-8)
        assert joint[f].mean == pytest.approx(alone.mean) and joint[f].sd == pytest.approx(alone.sd)
        alone = aft.fit(part, "weibull", "t", "e", ["a", "bb"])[0]
        assert joint_aft[f].coef == pytest.approx(alone.coef, abs=1e-6) and joint_aft[f].sigma == pytest.approx(alone.sigma)


def test_times_in_many_ranges_give_the_same_model(spark, rows, monkeypatch):
    whole = cox.fit(rows, "t", "e", ["a"])[0]
    monkeypatch.setattr(cox, "RANGE_TIMES", 20)
    cut = cox.fit(rows, "t", "e", ["a"])[0]
    assert len(cut.source[3]) > 5 and whole.source[3] == []
    assert cut.beta == pytest.approx(whole.beta, abs=1e-9) and cut.cov == pytest.approx(whole.cov)
    assert cut.loglik == pytest.approx(whole.loglik)
    life = [{r["t"]: r for r in m.life.collect()} for m in (whole, cut)]
    assert life[0].keys() == life[1].keys() and len(life[0]) == rows.select("t").distinct().count()
    for t, r in life[0].items():
        for c in ("deaths", "deaths_before", "h0", "a", "a_own", "b", "b_own", "xbar", "xsum"):
            assert life[1][t][c] == pytest.approx(r[c], abs=1e-9)
    assert cox.cluster_covariance(rows, cut, "t", "e", "g") == pytest.approx(cox.cluster_covariance(rows, whole, "t", "e", "g"))
    got, want = (sorted(map(tuple, cox.with_survival(rows.select("id", "a"), m, [50, 200]).collect())) for m in (cut, whole))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want):
        assert a[2:] == pytest.approx(b[2:])


def test_medians_are_the_first_time_with_enough_hazard(spark, rows):
    m = cox.fit(rows, "t", "e", ["a"])[0]
    steps = sorted((r["t"], r["h0"]) for r in m.life.collect())
    for r in cox.with_survival(rows, m, [10]).collect():
        risk = math.exp(m.coef[0] * (r["a"] - m.mean[0]))
        want = next((t for t, h in steps if h * risk >= math.log(2)), None)
        assert r["median"] == want


def test_the_driver_receives_no_times(spark, rows):
    """What a step brings to the driver depends on fits and features, not on distinct times."""
    few = rows.withColumn("t", F.col("t") % 7 + 1)
    shapes = []
    for df in (few, rows):
        d = design(df, F.col("t"), F.col("e"), ["a"])
        cuts = cox._time_cuts(d.rows)
        sums = cox._time_sums(d, np.array([0]), np.zeros((d.width, 1)), cuts)
        shapes.append(cox._newton_sums(sums, d.width, 1, cuts).shape)
    assert shapes[0] == shapes[1]


def test_rows_are_written_once_however_many_fits(spark, rows):
    sizes = []
    for times in (8, 800):
        groups = rows.select("g").distinct()
        mask = sp.mask_of(F.col("g"), *sp.subsample_cuts(groups, "g", 0.5, times, 0))
        d = design(rows, F.col("t"), F.col("e"), ["a", "b"], mask, times, {"b": "b"})
        assert d.rows.count() == rows.count()
        assert d.n == pytest.approx([300] * times, abs=60)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in d.rows.inputFiles()))
    # A bit for each fit, 100 bytes a row at most; no row is copied.
    assert sizes[1] - sizes[0] < 120 * rows.count()


def test_last_step(spark):
    steps = spark.createDataFrame([(float(t), f"s{t}" if t % 5 else None) for t in range(10, 400, 3)], "t double, v string")
    points = spark.createDataFrame([(float(p),) for p in [*range(0, 450), 100, 100]] + [(None,)], "p double")
    got = {r["p"]: r["v"] for r in last_step(points, "p", steps, "t", "v").collect()}
    known = sorted((r["t"], r["v"]) for r in steps.collect())
    want = {float(p): next((v for t, v in reversed(known) if t <= p), None) for p in range(450)}
    assert got == want


def test_one_hot_time_and_no_events(spark):
    df = spark.createDataFrame([(i, 5 if i % 3 else 1 + i, int(i % 2), float(i % 7)) for i in range(300)], "id int, t int, e int, a double")
    m = cox.fit(df, "t", "e", ["a"])[0]
    assert abs(m.gradient[0]) < 1e-6
    calm = cox.fit(df.withColumn("e", F.lit(0)), "t", "e", ["a"])[0]
    assert calm.loglik == 0 and calm.beta[0] == 0
    assert cox.fit(df.limit(0), "t", "e", ["a"]) == {}


def test_shuffles_add_up_the_first_rows_in_hash_order_without_copying_rows(spark):
    rows = [(i, float(i % 7) - 2.5, i % 3 == 0) for i in range(400)] + [(400, None, True)]
    df = spark.createDataFrame(rows, "id int, v double, f boolean")
    got = {r["b"]: r["diff"] for r in rs.permutation_diffs(df, "id", "v", F.col("f"), 30, 5).collect()}
    kept = [r for r in rows if r[1] is not None]
    k = sum(r[2] for r in kept)
    for b in range(30):
        order = sorted(kept, key=lambda r: md5(f"5:{b}:{r[0]}".encode()).hexdigest())
        left, right = [r[1] for r in order[:k]], [r[1] for r in order[k:]]
        assert got[b] == pytest.approx(sum(right) / len(right) - sum(left) / len(left))
    # Rows written for the cut: far fewer than rows x shuffles.
    found, _ = sp._cut(df.filter("v is not null").select(F.col("id").cast("string").alias("key"), F.col("v").alias("value")),
                           sp.prefixes(5, 30), lambda n: k, True)
    assert found.count() < 400 * 30 / 10


@pytest.mark.parametrize("first", [0, 1, 5])
def test_shuffles_with_an_empty_or_a_full_group(spark, first):
    df = spark.createDataFrame([(i, 1.0, i < first) for i in range(5)], "id int, v double, f boolean")
    diffs = [r["diff"] for r in rs.permutation_diffs(df, "id", "v", F.col("f"), 3, 5).collect()]
    assert diffs == ([0.0] * 3 if first == 1 else [None] * 3)
    assert rs.permutation_diffs(df.limit(0), "id", "v", F.col("f"), 3, 5).filter("diff IS NOT NULL").count() == 0


def test_the_hashes_of_all_draws_are_made_once(spark):
    """The rows are read for their number and for their hashes; what is ranked after that comes from the written windows."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b
    rows = spark.range(4000).select(F.col("id").cast("string").alias("key"), F.lit(1.0).alias("value")).mapInArrow(seen, "key string, value double")
    found, sums = sp._cut(rows, sp.prefixes(3, 20), lambda n: n // 2, True)
    part = {r["b"]: r["n"] for r in found.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert [part[b] + sums[b] for b in range(20)] == pytest.approx([2000] * 20)
    # A draw that ends outside its window (here rather never) reads once more.
    assert read.value <= 2 * 4000


def test_sides_of_a_split_are_written_once(spark):
    from dwellkit.plans import model_jobs
    df = spark.createDataFrame([(i, i % 3) for i in range(60)], "entity int, label int")
    train, test = model_jobs.split(df)
    for side in (train, test):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
    assert train.count() + test.count() == 60
