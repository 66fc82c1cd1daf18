"""One copy of the rows for many fits.

A row carries its features once, on one common scale, and one bit for each fit that it belongs to. Fits differ in
their rows and in the means that fill their missing values, so a fit's features are an affine map of what
the row carries: (1, values with 0 where missing, a flag per feature that may be missing). Sums of weighted products
of that vector serve all fits at once, as one matrix product of weights and products per batch of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.session import materialized

#: Numbers in one row of partial sums, and in the arrays of one step of a task.
ROW_NUMBERS, STEP_NUMBERS = 4096, 1 << 20


def pairs(p: int) -> tuple[np.ndarray, np.ndarray]:
    """The products of p numbers, each once."""
    return np.triu_indices(p)


def square(products: np.ndarray, p: int) -> np.ndarray:
    """Symmetric p x p matrices from their upper triangles."""
    i, j = pairs(p)
    out = np.empty((*products.shape[:-1], p, p))
    out[..., i, j] = out[..., j, i] = products
    return out


@dataclass
class Batch:
    t: np.ndarray
    e: np.ndarray
    y: np.ndarray        # 1, values, flags
    z: np.ndarray        # products of y
    bits: np.ndarray | None
    fits: np.ndarray

    @cached_property
    def mask(self) -> np.ndarray:
        """Rows x fits, 0 or 1."""
        return self.mask_of(self.fits)

    def mask_of(self, fits: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones((len(self.t), len(fits)))
        return (self.bits[:, fits >> 3] >> (fits & 7).astype(np.uint8) & 1).astype(float)

    def take(self, rows: np.ndarray | slice) -> Batch:
        return Batch(self.t[rows], self.e[rows], self.y[rows], self.z[rows], None if self.bits is None else self.bits[rows], self.fits)


@dataclass
class Design:
    """Rows (t, e, y, mask) and what each fit makes of y."""

    rows: DataFrame
    features: list[str]
    n_fits: int
    maps: np.ndarray     # fits x features x len(y): standardised features
    n: np.ndarray        # rows of each fit
    mean: np.ndarray     # fits x features, raw
    sd: np.ndarray

    @property
    def width(self) -> int:
        return self.maps.shape[2]


def read_batches(width: int, fits: np.ndarray, batches: Iterator[pa.RecordBatch], numbers: int) -> Iterator[Batch]:
    """Pieces of at most STEP_NUMBERS // ``numbers`` rows, with the masks of ``fits``."""
    i, j = pairs(width)
    size = max(64, STEP_NUMBERS // max(1, numbers))
    for whole in batches:
        for at in range(0, len(whole), size):
            batch = whole.slice(at, size)
            values = batch["y"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width - 1)
            y = np.concatenate((np.ones((len(batch), 1)), values), axis=1)
            bits = None if batch["mask"].null_count else np.frombuffer(b"".join(batch["mask"].to_pylist()), np.uint8).reshape(len(batch), -1)
            yield Batch(batch["t"].to_numpy(), batch["e"].fill_null(0).to_numpy(zero_copy_only=False), y, y[:, i] * y[:, j], bits, fits)


def design(df: DataFrame, t: Column, e: Column, features: list[str], mask: Column | None = None, n_fits: int = 1,
           fill: dict[str, str] | None = None) -> Design:
    """Write the rows once and learn each fit's means and scales in one pass.

    ``mask`` holds the fits of a row as bits; without it there is one fit with all rows. A feature of ``fill`` (name
    -> source) takes its missing values from the mean of the fit's rows, 0 without any; rows without a value of another
    feature are left out. NaN is missing. A null mask belongs to no fit.
    """
    fill = fill or {}
    source = {f: F.nanvl(F.col(fill.get(f, f)).cast("double"), F.lit(None).cast("double")) for f in features}
    gaps = [f for f in features if f in fill]
    found = df.select(t.cast("double").alias("t"), e.cast("int").alias("e"), F.lit(None).cast("binary").alias("mask") if mask is None else mask.alias("mask"),
                      *[source[f].alias(f"_f{i}") for i, f in enumerate(features)])
    needed = [f"_f{i}" for i, f in enumerate(features) if f not in fill]
    if needed:
        found = found.dropna(subset=needed)
    if mask is not None:
        found = found.filter("mask IS NOT NULL")
    found = materialized(found.filter("t IS NOT NULL"))
    # Two numbers for each feature.
    common = found.agg(*[x for i in range(len(features)) for x in (F.avg(f"_f{i}").alias(f"m{i}"), F.stddev_pop(f"_f{i}").alias(f"s{i}"))]).first()
    centre = np.array([common[f"m{i}"] or 0.0 for i in range(len(features))])
    scale = np.array([common[f"s{i}"] or 1.0 for i in range(len(features))])
    y = F.array(*[F.coalesce((F.col(f"_f{i}") - F.lit(float(centre[i]))) / F.lit(float(scale[i])), F.lit(0.0)) for i in range(len(features))],
                *[F.col(f"_f{features.index(f)}").isNull().cast("double") for f in gaps])
    rows = found.select("t", "e", "mask", y.alias("y"))
    width, k = 1 + len(features) + len(gaps), len(features)

    m = square(fit_sums(rows, width, n_fits, np.arange(n_fits), lambda batch: batch.mask.T @ batch.z), width)
    n = m[:, 0, 0]
    many = np.maximum(n, 1)[:, None]
    maps = np.zeros((n_fits, k, width))
    maps[:, np.arange(k), 1 + np.arange(k)] = 1.0
    for at, f in enumerate(gaps, 1 + k):
        i = features.index(f)
        present = n - m[:, 0, at]
        maps[:, i, at] = np.where(present > 0, m[:, 0, 1 + i] / np.maximum(present, 1), -centre[i] / scale[i])
    mu = np.einsum("fkw,fw->fk", maps, m[:, 0]) / many
    maps[:, :, 0] -= mu
    # The mean is 0 now; what is left is the variance.
    var = np.einsum("fkw,fwv,fkv->fk", maps, m, maps) / many
    sd = np.where(var > 1e-24, np.sqrt(np.maximum(var, 0)), 1.0 / scale)
    return Design(rows, features, n_fits, maps / sd[:, :, None], n, centre + scale * mu, scale * sd)


def fit_sums(rows: DataFrame, width: int, n_fits: int, fits: np.ndarray, contribution: Callable[[Batch], np.ndarray]) -> np.ndarray:
    """fits x numbers: ``contribution(batch)`` of all rows, added up in the tasks and then by Spark.

    The driver receives fits x numbers, however many rows and tasks there are.
    """
    def run(batches):
        total = None
        for batch in read_batches(width, fits, batches, len(fits)):
            one = contribution(batch)
            total = one if total is None else total + one
        if total is not None:
            yield from sum_rows({None: total}, False)
    partial = rows.mapInArrow(run, "block int, v array<double>").select("block", array_to_vector("v").alias("v"))
    found = partial.groupBy("block").agg(Summarizer.sum(F.col("v")).alias("v")).collect()
    if not found:
        return np.zeros((len(fits), width * (width + 1) // 2))
    flat = np.concatenate([r["v"].toArray() for r in sorted(found, key=lambda r: r["block"])])
    return flat.reshape(len(fits), -1)


def fits_in_block(numbers: int) -> int:
    return max(1, ROW_NUMBERS // numbers)


def sum_rows(table: dict, timed: bool) -> Iterator[pa.RecordBatch]:
    """Rows of partial sums: blocks of fits, one array each; with the time when ``timed``."""
    for t, total in table.items():
        size = fits_in_block(total.shape[1])
        starts = range(0, len(total), size)
        columns = [pa.array([s // size for s in starts], pa.int32()), pa.array([total[s:s + size].ravel() for s in starts], pa.list_(pa.float64()))]
        names = ["block", "v"]
        if timed:
            columns, names = [pa.array([t] * len(starts), pa.float64()), *columns], ["t", *names]
        yield pa.RecordBatch.from_arrays(columns, names=names)
