"""Missing values: column means and iterative low-rank completion."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellkit.models.sums import keyed_sums
from dwellkit.session import checkpointed


def column_means(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Means of the observed training values, 0 for a column without any."""
    one = train.agg(*[F.avg(F.when(~F.isnan(F.col(c)), F.col(c))).alias(c) for c in columns]).first()
    return {c: 0.0 if one[c] is None else float(one[c]) for c in columns}


def impute_mean(df: DataFrame, means: dict[str, float]) -> DataFrame:
    """Fill missing (NULL or NaN) values with the training means."""
    return df.withColumns({c: F.coalesce(F.when(~F.isnan(F.col(c)), F.col(c)), F.lit(m)) for c, m in means.items()})


def standardize(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with the training mean and population sd; a zero sd counts as one."""
    one = train.agg(*[e for c in columns for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(one[f"m_{c}"])) / F.lit(one[f"s_{c}"] or 1.0) for c in columns})


@dataclass
class LowRank:
    """Fitted completion: training means and the fixed basis (rank x columns)."""
    means: np.ndarray
    components: np.ndarray
    rank: int
    iterations: int
    change: float | None
    max_iter: int = 50
    tol: float = 1e-6

    def transform(self, df: DataFrame, column: str) -> DataFrame:
        """Complete new rows with the fixed basis; each row stops by its own change."""
        means, comp, max_iter, tol = self.means, self.components, self.max_iter, self.tol
        i = df.columns.index(column)

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    x, miss = _matrix(pdf.iloc[:, i])
                    cur = np.where(miss, means, x)
                    open_ = miss.any(axis=1)
                    prev = None
                    for _ in range(max_iter):
                        if not open_.any():
                            break
                        new = np.where(miss, (cur @ comp.T) @ comp, cur)
                        cur = np.where(open_[:, None], new, cur)
                        if prev is not None:
                            gap = np.where(miss, np.abs(new - prev), 0.0).sum(axis=1) / np.maximum(miss.sum(axis=1), 1)
                            open_ = open_ & (gap >= tol)
                        prev = new
                    pdf = pdf.copy()
                    pdf[column] = cur.tolist()
                yield pdf

        schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == column else f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(run, schema)


def _matrix(column: pd.Series):
    x = np.array([[np.nan if v is None else v for v in row] for row in column], dtype=float)
    return x, np.isnan(x)




def fit_low_rank(df: DataFrame, column: str, n_components: int = 50, max_iter: int = 50, tol: float = 1e-6,
                 checkpoint_every: int = 10) -> LowRank:
    """Iterative truncated SVD (uncentred) on an array column with NULL as missing.

    The SVD basis is the leading eigenvectors of X'X, which tasks add up in one p x p matrix.
    Nothing is written between iterations: a task refills its rows by applying the bases found
    so far, and every ``checkpoint_every`` iterations the filled rows are checkpointed so that
    this replay stays short.
    """
    rows = df.select(F.col(column).alias("x")).persist()
    try:
        first = _gram(rows, None, [])
        n, means = int(first["n"]), first["means"]
        rank = int(min(n_components, n, len(means) - 1))
        stored, bases, change, comp = rows.select("x", F.lit(None).cast("array<double>").alias("f")), [], None, None
        for it in range(1, max_iter + 1):
            part = _gram(stored, means, bases)
            # change = mean |new - previous| over missing cells made by the last basis.
            if it > 2 and part["missing"] > 0:
                change = part["moved"] / part["missing"]
                if change < tol:
                    break
            val, vec = np.linalg.eigh(part["gram"])
            comp = vec[:, np.argsort(val)[::-1][:rank]]
            bases = [*bases, comp]
            if part["missing"] == 0:
                break
            if len(bases) >= checkpoint_every:
                stored, bases = checkpointed(_store(stored, means, bases)), []
        return LowRank(means, comp.T, rank, it, change, max_iter, tol)
    finally:
        rows.unpersist()


def _state(pdf, means, bases):
    x, miss = _matrix(pdf["x"])
    held = pdf["f"].notna().to_numpy()
    start = np.where(miss, means, x)
    if held.any():
        start[held] = np.array(pdf["f"][held].tolist(), dtype=float)
    cur = prev = start
    for v in bases:
        prev, cur = cur, np.where(miss, (cur @ v) @ v.T, cur)
    return x, miss, cur, prev


def _store(stored, means, bases):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                _, _, cur, _ = _state(pdf, means, bases)
                pdf = pdf.copy()
                pdf["f"] = cur.tolist()
            yield pdf
    return stored.mapInPandas(run, "x array<double>, f array<double>")


def _gram(rows: DataFrame, means, bases) -> dict:
    if means is None:
        def contribution(pdf):
            x, miss = _matrix(pdf["x"])
            return {(): np.concatenate([[len(x)], np.where(miss, 0.0, x).sum(axis=0), (~miss).sum(axis=0)])}
        v = keyed_sums(rows, {}, contribution)[()]
        p = (len(v) - 1) // 2
        seen = v[1 + p:]
        return {"n": v[0], "means": np.where(seen > 0, v[1:1 + p] / np.maximum(seen, 1), 0.0)}

    def contribution(pdf):
        _, miss, cur, prev = _state(pdf, means, bases)
        return {(): np.concatenate([[miss.sum(), np.abs(cur - prev)[miss].sum()], (cur.T @ cur).ravel()])}
    v = keyed_sums(rows, {}, contribution)[()]
    p = len(means)
    return {"missing": v[0], "moved": v[1], "gram": v[2:].reshape(p, p)}
