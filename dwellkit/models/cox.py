"""Cox proportional hazards with Efron ties, for any number of distinct durations and of fits.

One Newton step needs, at each event time, the sums of w, w x and w x x' over the rows still at risk and over
those that die, with w = exp(x b). Rows are added up per distinct time; the times are cut into ranges, totals
of later ranges are carried into each range, and the range turns its times into log-likelihood, gradient and
information. Only these, fits x k x k numbers, come to the driver. Fits (subsamples, seeds) share one copy of
the rows, see ``design``.

Objective: partial log-likelihood / n - penalizer * ((1 - l1) / 2 * |b|^2 + l1 * |b|_1) with
b on standardised features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.functions.dist import chi2_sf, norm_sf
from dwellkit.models.design import STEP_NUMBERS, Batch, Design, design, read_batches, square, sum_rows
from dwellkit.models.sums import assemble, keyed_sums, matrix
from dwellkit.operators.running import last_step
from dwellkit.session import materialized


@dataclass
class CoxModel:
    features: list[str]
    mean: np.ndarray
    sd: np.ndarray
    beta: np.ndarray              # on standardised features
    cov: np.ndarray               # of beta, model-based
    loglik: float
    n: int
    gradient: np.ndarray
    iterations: int
    source: tuple                 # what the life table is made of
    _life: DataFrame | None = field(default=None, repr=False)

    @property
    def coef(self) -> np.ndarray:
        return self.beta / self.sd

    @property
    def life(self) -> DataFrame:
        """One row per distinct time, written on first use: t, deaths, deaths before, the cumulative hazard h0 at the mean, risk-set
        means xbar and event sums xsum of standardised features, and the sums that score residuals need."""
        if self._life is None:
            self._life = materialized(_life_table(*self.source))
        return self._life

    def linear_predictor(self) -> Column:
        """b (x - mean) as a column expression."""
        out = F.lit(0.0)
        for f, c, m in zip(self.features, self.coef, self.mean):
            out = out + F.lit(float(c)) * (F.col(f).cast("double") - F.lit(float(m)))
        return out


#: Terms next to the smallest risk set that are added one by one.
DIRECT_TERMS = 2000
_NODES, _NODE_WEIGHTS = np.polynomial.legendre.leggauss(20)


def _terms(u: np.ndarray, s0: float, e0: float) -> np.ndarray:
    phi = s0 - u * e0
    return np.array([1 / phi, u / phi, 1 / phi ** 2, u / phi ** 2, (u / phi) ** 2, np.log(phi)])


def _slopes(u: float, s0: float, e0: float) -> np.ndarray:
    phi = s0 - u * e0
    return np.array([e0 / phi ** 2, s0 / phi ** 2, 2 * e0 / phi ** 3, 1 / phi ** 2 + 2 * u * e0 / phi ** 3,
                     2 * u / phi ** 2 + 2 * u * u * e0 / phi ** 3, -e0 / phi])


def _efron(s0: float, e0: float, d: int) -> np.ndarray:
    """Over the d tied events with u = l/d and phi = s0 - u e0: sums of 1/phi, u/phi,
    1/phi^2, u/phi^2, u^2/phi^2 and log phi.

    The last terms, where phi may come near zero, are added directly, all before them by
    Euler-Maclaurin. Every part is a sum of terms of one sign, so nothing cancels however
    large the risk set is against the ties. The integral is cut at halving distances from the
    pole at s0 / e0.
    """
    first = max(0, d - DIRECT_TERMS)
    total = _terms(np.arange(first, d) / d, s0, e0).sum(axis=1)
    if first == 0:
        return total
    end, pole = first / d, s0 / e0
    cuts = [0.0]
    while pole - cuts[-1] > 2 * (pole - end):
        cuts.append(min(end, (cuts[-1] + pole) / 2))
    cuts.append(end)
    area = np.zeros(6)
    for lo, hi in zip(cuts, cuts[1:]):
        half = (hi - lo) / 2
        area += (_terms((lo + hi) / 2 + half * _NODES, s0, e0) * _NODE_WEIGHTS).sum(axis=1) * half
    ends = _terms(np.array([0.0, end]), s0, e0)
    return (total + d * area + (ends[:, 0] - ends[:, 1]) / 2
            + (_slopes(end, s0, e0) - _slopes(0.0, s0, e0)) / (12 * d))


#: Distinct times that meet in one task, and the most ranges of times.
RANGE_TIMES, MOST_RANGES = 2000, 2048
#: Rows and fits whose weights are made together.
TIME_ROWS, FIT_BLOCK = 4096, 32


def _sizes(width: int) -> tuple[int, int]:
    """Numbers of a risk set, and of one time of one fit: event sums of y, then products under w, of all and of the dead."""
    products = width * (width + 1) // 2
    return products, width + 2 * products


def _time_cuts(rows: DataFrame) -> list[float]:
    times = rows.select("t").distinct()
    n = times.count()
    parts = min(MOST_RANGES, -(-n // RANGE_TIMES))
    if parts < 2:
        return []
    return sorted(set(times.approxQuantile("t", [i / parts for i in range(1, parts)], 1 / (4 * parts))))


def _starts(t: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1))


def _time_sums(d: Design, fits: np.ndarray, coefs: np.ndarray, cuts: list[float]) -> DataFrame:
    """(range, block, t, v): the sums of each time for blocks of fits; ``coefs`` weigh y, [width, fit]."""
    width = d.width
    products, numbers = _sizes(width)

    def few(b: Batch, starts: np.ndarray, table: dict) -> None:
        # Of a time those that die come first. A block of fits at a time, whose weights stay in the cache.
        ends = [*starts[1:].tolist(), len(b.t)]
        dead = np.add.reduceat(b.e == 1, starts, dtype=int) + starts
        totals = [table.setdefault(t, np.zeros((len(fits), numbers))) for t in b.t[starts].tolist()]
        for at in range(0, len(fits), FIT_BLOCK):
            some = slice(at, at + FIT_BLOCK)
            mask, w = b.mask_of(fits[some]), b.y @ coefs[:, some]
            np.exp(np.clip(w, -50, 50, out=w), out=w)
            w *= mask
            for total, i, m, j in zip(totals, starts.tolist(), dead.tolist(), ends):
                part, own = total[some], w[i:m].T @ b.z[i:m]
                part[:, :width] += mask[i:m].T @ b.y[i:m]
                part[:, width:width + products] += own + w[m:j].T @ b.z[m:j]
                part[:, width + products:] += own

    def many(b: Batch, table: dict) -> None:
        # Nearly every row has a time of its own.
        starts, died = _starts(b.t), (b.e == 1)[:, None]
        w = np.exp(np.clip(b.y @ coefs, -50, 50)) * b.mask
        sums = np.empty((len(starts), len(fits), numbers))
        for f in range(len(fits)):
            one = np.concatenate(((b.mask[:, f:f + 1] * died) * b.y, w[:, f:f + 1] * b.z, (w[:, f:f + 1] * died) * b.z), axis=1)
            sums[:, f] = np.add.reduceat(one, starts, axis=0)
        for at, total in zip(b.t[starts].tolist(), sums):
            table[at] = table[at] + total if at in table else total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[float, np.ndarray] = {}
        for b in read_batches(width, fits, batches, STEP_NUMBERS // TIME_ROWS):
            b = b.take(np.lexsort((b.e != 1, b.t)))
            starts = _starts(b.t)
            size = max(64, STEP_NUMBERS // len(fits))
            if len(b.t) > 8 * len(starts):
                few(b, starts, table)
            else:
                for at in range(0, len(b.t), size):
                    many(b.take(slice(at, at + size)), table)
            if len(table) * len(fits) * numbers > 1 << 23:
                yield from sum_rows(table, True)
                table = {}
        yield from sum_rows(table, True)
    # A time's range is the number of cuts at or below it.
    bins = F.lit(0) if not cuts else F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("t")))
    partial = d.rows.mapInArrow(run, "t double, block int, v array<double>").select(
        bins.cast("int").alias("range"), "block", "t", array_to_vector("v").alias("v"))
    return partial.groupBy("range", "block", "t").agg(Summarizer.sum(F.col("v")).alias("v"))


def _by_range(sums: DataFrame, numbers: int, cuts: list[float], of, schema: str) -> DataFrame:
    """``of(range, block, times, values, offset)`` for each range and block: times descend, ``offset`` adds up what later
    ranges hold."""
    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t = table["t"].to_numpy()
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(t), -1, numbers)
        order = np.argsort(-t)
        return t[order], v[order]
    if not cuts:
        alone = sums.select("block", "t", vector_to_array("v").alias("v"))
        return alone.groupBy("block").applyInArrow(
            lambda key, table: of(0, key[0].as_py(), *arrays(table), 0.0), schema)
    sums = materialized(sums.select("range", "block", "t", vector_to_array("v").alias("v")))
    totals = sums.groupBy("range", "block").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select(
        "range", "block", vector_to_array("v").alias("v"))

    def later(key: tuple, table: pa.Table) -> pa.Table:
        # One row per range.
        r = table["range"].to_numpy()
        order = np.argsort(-r)
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(r), -1)[order]
        return pa.table({"range": pa.array(r[order]), "block": pa.array([key[0].as_py()] * len(r), pa.int32()),
                         "v": pa.array(list(np.cumsum(v, axis=0) - v), pa.list_(pa.float64()))})
    offsets = totals.groupBy("block").applyInArrow(later, "range int, block int, v array<double>")

    def meet(key: tuple, table: pa.Table, offset: pa.Table) -> pa.Table:
        off = offset["v"].combine_chunks().flatten().to_numpy().reshape(-1, numbers)
        return of(key[0].as_py(), key[1].as_py(), *arrays(table), off)
    return sums.groupBy("range", "block").cogroup(offsets.groupBy("range", "block")).applyInArrow(meet, schema)


def _ties(v: np.ndarray, offset, width: int) -> tuple[np.ndarray, ...]:
    """Per time and fit: deaths, event sums, risk and event products, and Efron's sums over the ties, [6, times, fits]."""
    products, _ = _sizes(width)
    dead, own = v[:, :, :width], v[:, :, width + products:]
    risk = np.cumsum(v[:, :, width:width + products], axis=0) + (offset if np.isscalar(offset) else offset[:, width:width + products])
    d = np.rint(dead[:, :, 0]).astype(np.int64)
    sums = np.zeros((6, *d.shape))
    s0 = risk[:, :, 0]
    one = d == 1
    sums[0][one], sums[2][one], sums[5][one] = 1 / s0[one], 1 / s0[one] ** 2, np.log(s0[one])
    for i, f in np.argwhere(d > 1).tolist():
        sums[:, i, f] = _efron(s0[i, f], own[i, f, 0], int(d[i, f]))
    return d, dead, risk, own, sums


def _newton_sums(sums: DataFrame, width: int, n_fits: int, cuts: list[float]) -> np.ndarray:
    """fits x (log of the ties, event sums of y, gradient in y, information in y)."""
    products, numbers = _sizes(width)

    def of(_, block, times, v, offset) -> pa.Table:
        d, dead, risk, own, (i0, u1, q0, q1, q2, log) = _ties(v, offset, width)
        s1, e1 = risk[:, :, :width], own[:, :, :width]
        seen = np.where((d > 0)[:, :, None], dead, 0).sum(0)
        g = seen - (s1 * i0[:, :, None] - e1 * u1[:, :, None]).sum(0)
        info = square((risk * i0[:, :, None] - own * u1[:, :, None]).sum(0), width)
        cross = np.einsum("tfi,tfj,tf->fij", s1, e1, q1)
        info -= np.einsum("tfi,tfj,tf->fij", s1, s1, q0) - cross - cross.transpose(0, 2, 1) + np.einsum("tfi,tfj,tf->fij", e1, e1, q2)
        out = np.concatenate((log.sum(0)[:, None], seen, g, info.reshape(len(info), -1)), axis=1)
        return pa.table({"block": pa.array([block], pa.int32()), "v": pa.array([out.ravel()], pa.list_(pa.float64()))})
    parts = _by_range(sums, numbers, cuts, of, "block int, v array<double>")
    found = parts.groupBy("block").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()
    flat = np.concatenate([r["v"].toArray() for r in sorted(found, key=lambda r: r["block"])])
    return flat.reshape(n_fits, -1)


def _life_table(d: Design, f: int, coef: np.ndarray, cuts: list[float]) -> DataFrame:
    """See ``CoxModel.life``; one fit."""
    width, map_ = d.width, d.maps[f]
    k = len(map_)
    names = ["deaths", "h", "a_full", "a_die", *[f"{n}{j}" for n in ("bf", "bd", "xbar", "xsum") for j in range(k)]]

    def of(range_, _, times, v, offset) -> pa.Table:
        died, dead, risk, own, efron = _ties(v, offset, width)
        died, dead, risk, own, (i0, u1, q0, q1, q2, _log) = died[:, 0], dead[:, 0], risk[:, 0], own[:, 0], efron[:, :, 0]
        s1, e1, xsum = risk[:, :width] @ map_.T, own[:, :width] @ map_.T, dead @ map_.T
        bf, bd = s1 * q0[:, None] - e1 * q1[:, None], s1 * (q0 - q1)[:, None] - e1 * (q1 - q2)[:, None]
        xbar = (s1 * i0[:, None] - e1 * u1[:, None]) / np.maximum(died, 1)[:, None]
        h = died / np.maximum(risk[:, 0], 1e-300)
        columns = [died.astype(float), h, i0, i0 - u1, *bf.T, *bd.T, *xbar.T, *xsum.T]
        return pa.table([pa.array([range_] * len(times), pa.int32()), pa.array(times), *[pa.array(np.ascontiguousarray(c)) for c in columns]],
                        names=["range", "t", *names])
    sums = _time_sums(d, np.array([f]), coef[:, None], cuts)
    steps = materialized(_by_range(sums, _sizes(width)[1], cuts, of, "range int, t double, " + ", ".join(f"{n} double" for n in names)))
    added = ["deaths", "h", "a_full", *[f"bf{j}" for j in range(k)]]
    # At most MOST_RANGES rows.
    totals = {r["range"]: np.array(r[1:]) for r in steps.groupBy("range").agg(*[F.sum(c).alias(c) for c in added]).collect()}
    before = {r: sum((v for q, v in totals.items() if q < r), np.zeros(len(added))) for r in totals}

    def cumulate(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        upto = np.cumsum(np.stack([table[c].to_numpy() for c in added], axis=1), axis=0) + before[key[0].as_py()]

        def lists(name):
            return pa.array(list(np.stack([table[f"{name}{j}"].to_numpy() for j in range(k)], axis=1)), pa.list_(pa.float64()))
        deaths = table["deaths"].to_numpy()
        return pa.table({"t": table["t"], "deaths": pa.array(np.rint(deaths).astype(np.int64)), "deaths_before": pa.array(upto[:, 0] - deaths),
                         "h0": pa.array(np.ascontiguousarray(upto[:, 1])), "a": pa.array(np.ascontiguousarray(upto[:, 2])),
                         "a_own": pa.array(table["a_full"].to_numpy() - table["a_die"].to_numpy()),
                         "b": pa.array(list(upto[:, 3:]), pa.list_(pa.float64())),
                         "b_own": pa.array(list(np.stack([table[f"bf{j}"].to_numpy() - table[f"bd{j}"].to_numpy() for j in range(k)], axis=1)),
                                           pa.list_(pa.float64())),
                         "xbar": lists("xbar"), "xsum": lists("xsum")})
    return steps.groupBy("range").applyInArrow(
        cumulate, "t double, deaths bigint, deaths_before double, h0 double, a double, a_own double, b array<double>, b_own array<double>, "
                  "xbar array<double>, xsum array<double>")


def _newton_direction(g, info, beta, n, lam, l1):
    """Maximiser of the quadratic model with the elastic-net term (coordinate descent)."""
    k = len(beta)
    h = info / n + lam * (1 - l1) * np.eye(k)
    grad = g / n - lam * (1 - l1) * beta
    if lam * l1 == 0:
        return beta + np.linalg.lstsq(h, grad, rcond=None)[0]
    b = beta.copy()
    lin = grad + h @ beta
    for _ in range(500):
        old = b.copy()
        for j in range(k):
            r = lin[j] - h[j] @ b + h[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - lam * l1, 0.0) / max(h[j, j], 1e-12)
        if np.max(np.abs(b - old)) < 1e-12:
            break
    return b


def _objective(ll, beta, n, lam, l1):
    return ll / n - lam * (0.5 * (1 - l1) * float(beta @ beta) + l1 * float(np.abs(beta).sum()))


def fit(df: DataFrame, duration: str, event: str, features: list[str], mask: Column | None = None, n_fits: int = 1,
        penalizer: float = 0.0, l1_ratio: float = 0.0, max_iter: int = 30, tol: float = 1e-9,
        fill: dict[str, str] | None = None) -> dict:
    """{fit number: CoxModel}; a single fit has number 0. Rows with missing features are left out, but for
    those of ``fill``; ``mask`` has one bit per fit (see ``design``)."""
    d = design(df, F.col(duration), F.col(event), features, mask, n_fits, fill)
    return fit_design(d, penalizer, l1_ratio, max_iter, tol)


def fit_design(d: Design, penalizer: float = 0.0, l1_ratio: float = 0.0, max_iter: int = 30, tol: float = 1e-9) -> dict:
    k, width = len(d.features), d.width
    cuts = _time_cuts(d.rows)
    open_ = [f for f in range(d.n_fits) if d.n[f] > 0]
    beta = {f: np.zeros(k) for f in open_}
    best: dict = {}
    for it in range(1, max_iter + 1):
        if not open_:
            break
        fits = np.array(open_)
        coefs = np.stack([beta[f] @ d.maps[f] for f in open_], axis=1)
        found = _newton_sums(_time_sums(d, fits, coefs, cuts), width, len(fits), cuts)
        for at, f in enumerate(fits.tolist()):
            v, map_, n = found[at], d.maps[f], d.n[f]
            seen, g_y = v[1:1 + width], v[1 + width:1 + 2 * width]
            ll, g = float(seen @ coefs[:, at] - v[0]), map_ @ g_y
            info = map_ @ v[1 + 2 * width:].reshape(width, width) @ map_.T
            obj = _objective(ll, beta[f], n, penalizer, l1_ratio)
            if f in best and obj < best[f][0] - 1e-12 and it < max_iter:
                beta[f] = 0.5 * (beta[f] + best[f][1])    # went too far: halve the step
                continue
            moved = np.inf if f not in best else float(np.max(np.abs(beta[f] - best[f][1]), initial=0.0))
            best[f] = (obj, beta[f].copy(), ll, g, info, it)
            nxt = _newton_direction(g, info, beta[f], n, penalizer, l1_ratio)
            if moved < tol or float(np.max(np.abs(nxt - beta[f]), initial=0.0)) < tol:
                open_.remove(f)
            else:
                beta[f] = nxt
    models = {}
    for f, (_, b, ll, g, info, it) in best.items():
        n = int(round(d.n[f]))
        cov = np.linalg.pinv(info + n * penalizer * (1 - l1_ratio) * np.eye(k))
        models[f] = CoxModel(d.features, d.mean[f], d.sd[f], b, cov, ll, n, g - n * penalizer * (1 - l1_ratio) * b, it,
                             (d, f, b @ d.maps[f], cuts))
    return models


def hazard_ratios(spark, model: CoxModel, cov: np.ndarray | None = None) -> DataFrame:
    """(feature, coef, hr, se, z, p, hr_low, hr_high); pass the robust covariance if wanted."""
    cov = model.cov if cov is None else cov
    rows = []
    for j, f in enumerate(model.features):
        c, se = float(model.coef[j]), float(math.sqrt(max(cov[j, j], 0.0)) / model.sd[j])
        z = c / se if se > 0 else float("nan")
        rows.append((f, c, math.exp(c), se, z, 2 * norm_sf(abs(z)), math.exp(c - 1.959963984540054 * se),
                     math.exp(c + 1.959963984540054 * se)))
    return spark.createDataFrame(rows, "feature string, coef double, hr double, se double, z double, p double, "
                                       "hr_low double, hr_high double")


def cluster_covariance(df: DataFrame, model: CoxModel, duration: str, event: str, cluster: str) -> np.ndarray:
    """Sandwich covariance with score residuals summed per cluster.

    The residual of a row needs only its own x and the life table at its duration, which is joined; the sums per
    cluster are a combined aggregation, and one k x k sum of their products is left.
    """
    k = len(model.features)
    rows = assemble(df, model.features, {"c": F.col(cluster), "t": F.col(duration).cast("double"), "e": F.col(event).cast("int")})
    mean, sd, beta = model.mean, model.sd, model.beta
    kind = dict(df.dtypes)[cluster]

    def residuals(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = (matrix(pdf["x"]) - mean) / sd
            w = np.exp(np.clip(x @ beta, -50, 50))[:, None]
            died = (pdf["e"].to_numpy() == 1)[:, None]
            # An event leaves during its own tied step, others stay for all of it.
            a = pdf["a"].to_numpy()[:, None] - np.where(died, pdf["a_own"].to_numpy()[:, None], 0.0)
            b = matrix(pdf["b"]) - np.where(died, matrix(pdf["b_own"]), 0.0)
            r = np.where(died, x - matrix(pdf["xbar"]), 0.0) - w * (x * a - b)
            out = pdf[["c"]].copy()
            out["r"] = list(r)
            yield out

    life = model.life.select(F.col("t").alias("_t"), "a", "a_own", "b", "b_own", "xbar")
    met = rows.join(life, F.col("t") == F.col("_t")).drop("_t")
    res = met.mapInPandas(residuals, f"c {kind}, r array<double>")
    per = res.groupBy("c").agg(Summarizer.sum(array_to_vector("r")).alias("r")).select(vector_to_array("r").alias("r"))

    def products(pdf):
        r = matrix(pdf["r"])
        return {(): (r.T @ r).ravel()}
    meat = keyed_sums(per, {}, products)[()].reshape(k, k)
    return model.cov @ meat @ model.cov


def ph_test(spark, model: CoxModel) -> DataFrame:
    """Scaled Schoenfeld residuals against the rank of the event time: (feature, statistic, p).

    The residuals enter only through their sum per time, which the life table holds.
    """
    rank = F.col("deaths_before") + (F.col("deaths") + 1) / 2.0
    life = model.life.filter("deaths > 0").select(F.col("deaths").cast("double").alias("d"), rank.alias("g"), "xbar", "xsum")
    total, middle = life.agg(F.sum("d"), F.sum(F.col("d") * F.col("g"))).first()

    def sums(pdf):
        d, g = pdf["d"].to_numpy(), pdf["g"].to_numpy() - middle / total
        return {(): np.concatenate((g @ (matrix(pdf["xsum"]) - d[:, None] * matrix(pdf["xbar"])), [(d * g * g).sum()]))}
    v = keyed_sums(life, {}, sums)[()]
    scaled = total * v[:-1] @ model.cov
    stat = scaled ** 2 / (total * np.diag(model.cov) * float(v[-1]))
    rows = [(f, float(s), chi2_sf(float(s), 1)) for f, s in zip(model.features, stat)]
    return spark.createDataFrame(rows, "feature string, statistic double, p double")


def _hazards_at(model: CoxModel, times: list[float]) -> list[float]:
    """The cumulative baseline hazard at each time; one number each."""
    one = model.life.agg(*[F.max(F.when(F.col("t") <= t, F.col("h0"))).alias(f"h{i}") for i, t in enumerate(times)]).first()
    return [one[i] or 0.0 for i in range(len(times))]


def with_survival(df: DataFrame, model: CoxModel, horizons: list[float], prefix: str = "s_") -> DataFrame:
    """Add S(h | x) per horizon and the median season (NULL when never reached)."""
    out = df.withColumn("_hz", F.exp(model.linear_predictor()))
    for h, h0 in zip(horizons, _hazards_at(model, horizons)):
        out = out.withColumn(f"{prefix}{h:g}", F.exp(-F.lit(float(h0)) * F.col("_hz")))
    # The median is the first time at which the hazard reaches ln 2 / hz: the last step of the falling order.
    out = materialized(out.withColumn("_need", -F.lit(math.log(2.0)) / F.col("_hz")))
    steps = model.life.groupBy((-F.col("h0")).alias("_h")).agg(F.min("t").alias("median"))
    reached = last_step(out.select("_need").distinct(), "_need", steps, "_h", "median").withColumnRenamed("_need", "_at")
    return out.join(reached, F.col("_need") == F.col("_at"), "left").drop("_hz", "_need", "_at")


def contrast(spark, model: CoxModel, feature: str, low: float, high: float, seasons: list[int]) -> DataFrame:
    """(profile, value, season, survival, season_survival, median) of two rows at the feature means.

    They differ in one feature only; ``season_survival`` is S(t) over S of the season before.
    """
    j = model.features.index(feature)
    asked = sorted({t for s in seasons for t in (s, s - 1)})
    h0 = dict(zip(asked, _hazards_at(model, asked)))
    rows = []
    for name, value in (("low", low), ("high", high)):
        risk = math.exp(float(model.coef[j]) * (value - float(model.mean[j])))
        median = model.life.filter(F.col("h0") * risk >= math.log(2.0)).agg(F.min("t")).first()[0]
        s = {t: math.exp(-risk * h) for t, h in h0.items()}
        rows += [(name, float(value), int(t), s[t], s[t] / s[t - 1], median) for t in seasons]
    return spark.createDataFrame(rows, "profile string, value double, season int, survival double, season_survival double, median double")


def baseline(spark, model: CoxModel) -> DataFrame:
    return model.life.select(F.col("t").alias("time"), F.col("deaths").cast("int").alias("deaths"), "h0", F.exp(-F.col("h0")).alias("s0"))


def importance(spark, models: dict) -> DataFrame:
    """(fit, feature, value, rank): |standardised coefficient|, largest first."""
    rows = []
    for f, m in models.items():
        value = np.abs(m.beta)
        for r, j in enumerate(np.argsort(-value, kind="stable"), 1):
            rows.append((int(f), m.features[j], float(value[j]), r))
    return spark.createDataFrame(rows, "fit int, feature string, value double, rank int")
