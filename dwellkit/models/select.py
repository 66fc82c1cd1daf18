"""Feature selection and evaluation over repeated grouped splits."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellkit.functions.hashing import hash_hex
from dwellkit.models import aft, cox
from dwellkit.models.design import Design, design, read_batches
from dwellkit.operators import concordance as cc
from dwellkit.operators.concordance import harrell, uno
from dwellkit.operators.hypothesis import t_interval
from dwellkit.operators.running import mark_first
from dwellkit.operators.splits import draws_of, hash_cuts, mask_of, subsample, subsample_cuts
from dwellkit.operators.survival import censoring_curve
from dwellkit.session import materialized, shuffle_partitions


def fill_from(train: DataFrame, rows: DataFrame, fill: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Add each column of ``fill`` (new name -> source): the source, or its mean over the training rows.

    With ``by`` every fit (seed, subsample) has means of its own. Rows outside the training side never
    enter a mean; a source without any training value becomes 0.
    """
    by = by or []
    means = train.groupBy(*by).agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(f"_m_{n}") for n, c in fill.items()])
    out = rows.join(means, by) if by else rows.withColumns({f"_m_{n}": means.select(f"_m_{n}").scalar() for n in fill})
    out = out.withColumns({n: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)), f"_m_{n}", F.lit(0.0)) for n, c in fill.items()})
    return out.drop(*[f"_m_{n}" for n in fill])


def stability_selection(df: DataFrame, group: str, duration: str, event: str, features: list[str], ks: list[int],
                        times: int = 2000, fraction: float = 0.5, seed: int = 0, penalizer: float = 0.1,
                        threshold: float = 0.6, fill: dict[str, str] | None = None,
                        importance_fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(k, feature, frequency, selected): how often a feature ranks in the top k over group
    subsamples. All subsamples are fitted by the same jobs over one copy of the rows, which carries a bit for each
    of them; ``fill`` (see ``fill_from``) takes its means from each subsample. ``importance_fn`` takes rows copied for their
    subsamples ``b`` and gives (fit, feature, value, rank), so any model can rank; the default is Cox."""
    if importance_fn is not None:
        rows = df.join(subsample(df, group, fraction, times, seed), group)
        return membership(importance_fn(fill_from(rows, rows, fill, ["b"]) if fill else rows), ks, threshold)
    groups = materialized(df.select(group).distinct())
    # Written, so that each mask is made once and the join knows their size: an estimate takes a made column for nothing,
    # and the masks of all groups would be sent through the driver.
    taken = materialized(groups.repartition(shuffle_partitions(df.sparkSession)).select(
        group, mask_of(F.col(group), *subsample_cuts(groups, group, fraction, times, seed)).alias("_mask")))
    models = cox.fit(df.join(taken, group), duration, event, features, F.col("_mask"), times, penalizer, fill=fill)
    return membership(cox.importance(df.sparkSession, models), ks, threshold)


def membership(ranks: DataFrame, ks: list[int], threshold: float = 0.6) -> DataFrame:
    """Top-k frequency per feature from (fit, feature, rank), for several k in one pass."""
    each = ranks.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    out = each.groupBy("k", "feature").agg(F.avg((F.col("rank") <= F.col("k")).cast("int")).alias("frequency"))
    return out.withColumn("selected", F.col("frequency") >= threshold)


def seed_splits(df: DataFrame, group: str, seeds: list[int], fraction: float = 0.2) -> DataFrame:
    """Rows copied per seed with their side of that seed's grouped split."""
    groups = materialized(df.select(group).distinct())
    each = groups.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    each = each.withColumn("_h", hash_hex(F.col("seed"), F.col(group)))
    marked = mark_first(each, "_h", group, lambda n: F.floor(n * F.lit(fraction)), ["seed"])
    sides = marked.select(group, "seed", F.when(F.col("picked"), "test").otherwise("train").alias("side"))
    return df.join(sides, group)


def _held_out(df: DataFrame, group: str, seeds: list[int], fraction: float) -> DataFrame:
    """The rows once, with the numbers of the seeds whose test side they are on (``_test``) and a bit for each
    other seed (``_train``): the same sides as ``seed_splits``."""
    groups = materialized(df.select(group).distinct())
    before = [f"{s}:" for s in seeds]
    cuts = hash_cuts(groups, group, before, lambda n: math.floor(n * fraction))
    sides = materialized(groups.repartition(shuffle_partitions(df.sparkSession)).select(
        group, draws_of(F.col(group), before, cuts).alias("_test"), mask_of(F.col(group), before, cuts, rest=True).alias("_train")))
    return materialized(df.join(sides, group))


def _test_scores(d: Design, coefs: dict[str, np.ndarray]) -> DataFrame:
    """(seed number, t, e, model, score) for each fit and each row outside it; ``coefs[model]`` weigh (1, y), [fit, width]."""
    width, n_fits, names = d.width, d.n_fits, list(coefs)

    def run(batches):
        for b in read_batches(width, np.arange(n_fits), batches, n_fits):
            row, fit = np.nonzero(b.mask == 0)
            scores = [(b.y[row] * coefs[n][fit]).sum(1) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fit, b.t[row], b.e[row].astype(np.int32), *scores)],
                                             names=["number", "t", "e", *names])
    wide = d.rows.mapInArrow(run, "number bigint, t double, e int, " + ", ".join(f"`{n}` double" for n in names))
    return wide.unpivot(["number", "t", "e"], names, "model", "score")


def _test_pairs(d: Design, coefs: dict[str, np.ndarray], times: np.ndarray) -> DataFrame:
    """(number, model, t, pairs of the events at t) on the test side of each fit, as ``time_pairs`` counts them. Scores leave their task packed."""
    width, n_fits, names = d.width, d.n_fits, list(coefs)
    n = d.rows.count()
    parts = [-(-int(n - d.n[f]) // cc.RANGE_ROWS) for f in range(n_fits)]
    cuts = {(f, name): np.zeros(0) for f in range(n_fits) for name in names}
    if max(parts) > 1:
        # The cuts decide which scores meet, not what is counted.
        some = np.array([r["y"] for r in d.rows.sample(min(1.0, cc.CUT_ROWS / n), 0).select("y").collect()]).reshape(-1, width - 1)
        if len(some):
            for f, name in cuts:
                score = coefs[name][f, 0] + some @ coefs[name][f, 1:]
                cuts[f, name] = np.unique(np.quantile(score, np.arange(1, parts[f]) / max(parts[f], 1)))

    def run(batches):
        for b in read_batches(width, np.arange(n_fits), batches, n_fits):
            code = 2 * np.searchsorted(times, b.t) + (b.e != 1)
            out = []
            for f in range(n_fits):
                held = np.flatnonzero(b.mask[:, f] == 0)
                if len(held):
                    for m, name in enumerate(names):
                        # Row by row as everywhere, so that equal rows have equal scores.
                        score = (b.y[held] * coefs[name][f]).sum(1)
                        out += cc.packed(f * len(names) + m, score, code[held], cuts[f, name])
            columns = zip(*out) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["grp", "range", "s", "c", "n"])
    pairs = cc.time_pairs(d.rows.mapInArrow(run, cc.PACKED), times)
    model = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("grp") % len(names)).cast("int") + 1)
    return pairs.select(F.floor(F.col("grp") / len(names)).alias("number"), model.alias("model"), *pairs.columns[1:])


def bakeoff(df: DataFrame, group: str, duration: str, event: str, features: list[str], seeds: list[int],
            models: tuple[str, ...] = ("null", "cox", "weibull", "lognormal", "loglogistic"), fraction: float = 0.2,
            penalizer: float = 0.1, fill: dict[str, str] | None = None) -> DataFrame:
    """Long (seed, model, metric, value) of Harrell's and Uno's C on the test side.

    All seeds are fitted over one copy of the rows, and with few distinct times their test rows are scored where they are. ``models`` may also name ``boosted``, whose trees are fitted seed by seed.
    ``fill`` (see ``fill_from``) takes its means from the training side of each seed.
    """
    held = _held_out(df, group, seeds, fraction)
    kind = df.schema[duration].dataType
    seed = F.element_at(F.array(*[F.lit(s) for s in seeds]), F.col("number").cast("int") + 1)
    d = design(held, F.col(duration), F.col(event), features, F.col("_train"), len(seeds), fill)
    coefs = {}
    for name in models:
        coefs[name] = np.zeros((len(seeds), d.width))
        if name == "cox":
            for f, m in cox.fit_design(d, penalizer).items():
                coefs[name][f] = -m.beta @ d.maps[f]
        elif name not in ("null", "boosted"):
            for f, m in aft.fit_design(d, name).items():
                coefs[name][f] = m.theta[1:-1] @ d.maps[f]
                coefs[name][f, 0] += m.theta[0]
    coefs.pop("boosted", None)
    by = ["model", "seed"]
    # Test pairs are weighted by the censoring curve of the training side.
    numbers = F.array_except(F.sequence(F.lit(0), F.lit(len(seeds) - 1)), "_test")
    train = held.select(F.explode(numbers).alias("number"), duration, event).withColumn("seed", seed)
    g = materialized(censoring_curve(train, duration, event, by=["seed"]))
    g = g.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    out, scored = [], []
    times = cc.few_times(d.rows, "t")
    if coefs and times is not None:
        pairs = _test_pairs(d, coefs, times)
        pairs = materialized(pairs.select(seed.alias("seed"), "model", F.col("t").cast(kind).alias(duration), *pairs.columns[3:]))
        out += [(cc.harrell_of_times(pairs, by), cc.uno_of_times(pairs, duration, g, by))]
    elif coefs:
        scored.append(_test_scores(d, coefs).select(
            seed.alias("seed"), F.col("t").cast(kind).alias(duration), F.col("e").alias(event), "model", "score"))
    if "boosted" in models:
        for number, s in enumerate(seeds):
            test = held.filter(F.array_contains("_test", number))
            train = held.filter(~F.array_contains("_test", number))
            if fill:
                train, test = fill_from(train, train, fill), fill_from(train, test, fill)
            _, score = aft.fit_boosted(train, duration, event, features, seed=s)
            scored.append(score(test).select(F.lit(s).alias("seed"), duration, event, F.lit("boosted").alias("model"), F.col("log_time").alias("score")))
    if scored:
        rows = materialized(reduce(DataFrame.unionByName, scored))
        out += [(harrell(rows, duration, event, "score", by=by), uno(rows, duration, event, "score", g, by=by))]
    long = [x.select(*by, F.lit(metric).alias("metric"), F.col(c).alias("value"))
            for both in out for x, metric, c in zip(both, ("harrell", "uno"), ("c_index", "c_uno"))]
    return reduce(DataFrame.unionByName, long)


def bakeoff_table(results: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Mean and corrected interval per model and metric."""
    return t_interval(results, ["model", "metric"], "value", fraction)


def cox_builder(duration: str, event: str, features: list[str]) -> Callable[[dict], Callable]:
    """builder(params) for ``tune``: penalised Cox; a larger score lives longer."""
    def build(params):
        def fit(train):
            model = cox.fit(train, duration, event, features, penalizer=params["penalizer"], l1_ratio=params["l1_ratio"])[0]
            return lambda test: test.withColumn("score", -model.linear_predictor())
        return fit
    return build


def aft_builder(duration: str, event: str, features: list[str]) -> Callable[[dict], Callable]:
    """builder(params) for ``tune``: an accelerated failure time model of the given kind."""
    def build(params):
        def fit(train):
            model = aft.fit(train, params["kind"], duration, event, features)[0]
            return lambda test: test.withColumn("score", model.log_time())
        return fit
    return build


def tune(folded: DataFrame, spaces: list[tuple[str, Callable, list[dict]]], scorer: Callable[[DataFrame, list[str]], DataFrame],
         folds: int, fill: dict[str, str] | None = None) -> DataFrame:
    """(space, params, mean, sd, n): each setting of each space scored on every held-out ``fold``.

    A space is (name, builder, settings); builder(params)(train) gives a function that adds ``score``
    to other rows, and scorer(rows, by) gives one ``value`` for each ``by`` group. All held-out
    rows of a space are scored in one job.
    """
    out = None
    for name, builder, settings in spaces:
        scored = None
        for params in settings:
            for k in range(folds):
                train, test = folded.filter(F.col("fold") != k), folded.filter(F.col("fold") == k)
                if fill:
                    train, test = fill_from(train, train, fill), fill_from(train, test, fill)
                one = builder(params)(train)(test).withColumns({"params": F.lit(str(params)), "fold": F.lit(k)})
                scored = one if scored is None else scored.unionByName(one)
        values = scorer(scored, ["params", "fold"]).groupBy("params").agg(
            F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
        values = values.withColumn("space", F.lit(name))
        out = values if out is None else out.unionByName(values)
    return out.select("space", "params", "mean", "sd", "n")
