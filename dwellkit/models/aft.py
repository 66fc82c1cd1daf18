"""Accelerated failure time models: log T = x b + sigma * error, with right censoring.

Log-normal, log-logistic and Weibull share one Newton loop: each step adds up gradient and
Hessian over one copy of the rows, for all fits in one job (see ``design``), and solves locally.
``fit_weibull`` is Spark's own estimator, for a single fit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.models.design import Batch, Design, design, fit_sums, square
from dwellkit.operators.stints import step_read
from dwellkit.operators.survival import censoring_curve


@dataclass
class AftModel:
    kind: str
    features: list[str]
    mean: np.ndarray
    sd: np.ndarray
    theta: np.ndarray   # intercept, b (standardised), log sigma
    loglik: float
    gradient: np.ndarray
    n: int
    iterations: int

    @property
    def sigma(self) -> float:
        return math.exp(self.theta[-1])

    @property
    def coef(self) -> np.ndarray:
        return self.theta[1:-1] / self.sd

    def log_time(self) -> Column:
        """Predicted median log time; its exponential is the median."""
        out = F.lit(float(self.theta[0]) + MEDIANS[self.kind] * self.sigma)
        for f, c, m in zip(self.features, self.coef, self.mean):
            out = out + F.lit(float(c)) * (F.col(f).cast("double") - F.lit(float(m)))
        return out


def _normal(z, died):
    """Log density or log survival of the standard normal with two derivatives."""
    erfc = np.frompyfunc(math.erfc, 1, 1)
    far = z > 8.0
    zc = np.where(far, 8.0, z)
    sf = np.ones_like(z)
    # Value by value, so only where it is used.
    sf[~died] = 0.5 * erfc(zc[~died] / math.sqrt(2.0)).astype(float)
    dens = np.exp(-0.5 * zc * zc) / math.sqrt(2.0 * math.pi)
    hz = np.where(far, z + 1.0 / z - 2.0 / z ** 3, dens / sf)   # hazard, asymptotic far out
    log_sf = np.where(far, -0.5 * z * z - np.log(np.maximum(hz, 1e-300)) - 0.5 * math.log(2 * math.pi), np.log(sf))
    ll = np.where(died, -0.5 * z * z - 0.5 * math.log(2 * math.pi), log_sf)
    return ll, np.where(died, -z, -hz), np.where(died, -1.0, -hz * (hz - z))


def _logistic(z, died):
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    soft = np.logaddexp(0.0, z)
    ll = np.where(died, z - 2.0 * soft, -soft)
    return ll, np.where(died, 1.0 - 2.0 * p, -p), np.where(died, -2.0 * p * (1 - p), -p * (1 - p))


def _extreme(z, died):
    """Smallest extreme value, the error of a Weibull time."""
    grow = np.exp(np.clip(z, -500, 500))
    return np.where(died, z - grow, -grow), np.where(died, 1.0 - grow, -grow), -grow


ERRORS = {"lognormal": _normal, "loglogistic": _logistic, "weibull": _extreme}
#: Median of the error: what the median log time adds to the location, in units of sigma.
MEDIANS = {"lognormal": 0.0, "loglogistic": 0.0, "weibull": math.log(math.log(2.0))}


def fit(df: DataFrame, kind: str, duration: str, event: str, features: list[str], mask: Column | None = None, n_fits: int = 1,
        max_iter: int = 40, tol: float = 1e-8, fill: dict[str, str] | None = None) -> dict:
    """{fit number: AftModel} for ``lognormal``, ``loglogistic`` or ``weibull`` times; rows, fits and ``fill`` as in ``design``."""
    return fit_design(design(df, F.col(duration), F.col(event), features, mask, n_fits, fill), kind, max_iter, tol)


def fit_design(d: Design, kind: str, max_iter: int = 40, tol: float = 1e-8) -> dict:
    k, every = len(d.features), np.arange(d.n_fits)

    def logs(batch: Batch) -> np.ndarray:
        y = np.log(batch.t)
        return batch.mask.T @ np.stack((np.ones(len(y)), y, y * y), axis=1)
    sums = fit_sums(d.rows, d.width, d.n_fits, every, logs)
    theta = {}
    for f in every.tolist():
        if d.n[f] > 0:
            n, s, q = sums[f]
            sd = math.sqrt(max(q / n - (s / n) ** 2, 0.0))
            theta[f] = np.concatenate([[s / n], np.zeros(k), [math.log(max(sd, 0.1))]])
    # Intercept and standardised features from (1, y).
    maps = np.concatenate((np.zeros((d.n_fits, 1, d.width)), d.maps), axis=1)
    maps[:, 0, 0] = 1.0
    best: dict = {}
    open_ = list(theta)
    for it in range(1, max_iter + 1):
        if not open_:
            break
        fits = np.array(open_)
        coefs = np.stack([theta[f][:-1] @ maps[f] for f in open_], axis=1)
        found = fit_sums(d.rows, d.width, d.n_fits, fits, _contribution(coefs, np.array([theta[f][-1] for f in open_]), ERRORS[kind]))
        for at, f in enumerate(fits.tolist()):
            ll, g, h = _in_features(found[at], maps[f])
            # A sum over many rows is known to so many digits only.
            if f in best and ll < best[f][0] - max(1e-10, 1e-12 * abs(best[f][0])) and it < max_iter:
                theta[f] = 0.5 * (theta[f] + best[f][1])
                continue
            best[f] = (ll, theta[f].copy(), g, it)
            # Keep the negative Hessian positive definite far from the optimum.
            val, vec = np.linalg.eigh(-h)
            step = vec @ ((vec.T @ g) / np.maximum(np.abs(val), 1e-6 * np.abs(val).max()))
            if np.max(np.abs(step)) < tol:
                open_.remove(f)
            else:
                theta[f] = theta[f] + step * min(1.0, 2.0 / np.max(np.abs(step)))
    return {f: AftModel(kind, d.features, d.mean[f], d.sd[f], th, ll, g, int(round(d.n[f])), it)
            for f, (ll, th, g, it) in best.items()}


def _contribution(coefs, log_sigma, err):
    """Per fit: log-likelihood, then its first and second derivatives in the weights of (1, y) and in log sigma."""
    sigma = np.exp(log_sigma)

    def contribution(batch: Batch) -> np.ndarray:
        died = (batch.e == 1)[:, None]
        y = np.log(batch.t)[:, None]
        z = (y - batch.y @ coefs) / sigma
        ll, a, b = err(z, np.broadcast_to(died, z.shape))
        a, b = a * batch.mask, b * batch.mask
        total = (ll - np.where(died, log_sigma + y, 0.0)) * batch.mask
        return np.concatenate((total.sum(0)[:, None], -(a / sigma).T @ batch.y, (-a * z - died * batch.mask).sum(0)[:, None],
                               (b / sigma ** 2).T @ batch.z, ((b * z + a) / sigma).T @ batch.y, (b * z * z + a * z).sum(0)[:, None]), axis=1)
    return contribution


def _in_features(v: np.ndarray, map_: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    width, m = map_.shape[1], len(map_)
    cut = np.cumsum([1, width, 1, width * (width + 1) // 2, width])
    ll, g, gs, h, hs, hss = np.split(v, cut)
    hessian = np.empty((m + 1, m + 1))
    hessian[:m, :m] = map_ @ square(h, width) @ map_.T
    hessian[:m, m] = hessian[m, :m] = map_ @ hs
    hessian[m, m] = hss[0]
    return float(ll[0]), np.concatenate((map_ @ g, gs)), hessian


def fit_weibull(df: DataFrame, duration: str, event: str, features: list[str], max_iter: int = 50):
    """Spark's Weibull AFT; returns (model, scorer) where the scorer adds ``log_time``."""
    va = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")
    rows = va.transform(df.select(F.col(duration).cast("double").alias("_t"), F.col(event).cast("double").alias("_e"), *features))
    model = AFTSurvivalRegression(featuresCol="_features", labelCol="_t", censorCol="_e", maxIter=max_iter).fit(rows)

    def score(new: DataFrame) -> DataFrame:
        out = model.transform(va.transform(new))
        return out.withColumn("log_time", F.ln("prediction")).drop("_features", "prediction")
    return model, score


def fit_boosted(df: DataFrame, duration: str, event: str, features: list[str], max_iter: int = 10, max_depth: int = 3,
                seed: int = 0):
    """Boosted trees on log time of the observed events, weighted by 1 / G(T)."""
    g = censoring_curve(df, duration, event)
    times = step_read(df.select(duration).distinct(), duration, g.withColumnRenamed(duration, "_gt"), "_gt", "g", empty=1.0)
    seen = (df.filter(F.col(event) == 1).join(times, duration)
            .withColumn("_w", 1.0 / F.greatest("g", F.lit(1e-8))).withColumn("_y", F.ln(F.col(duration).cast("double"))))
    va = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")
    gbt = GBTRegressor(featuresCol="_features", labelCol="_y", weightCol="_w", maxIter=max_iter, maxDepth=max_depth, seed=seed)
    model = gbt.fit(va.transform(seen))

    def score(new: DataFrame) -> DataFrame:
        return model.transform(va.transform(new)).withColumnRenamed("prediction", "log_time").drop("_features")
    return model, score
