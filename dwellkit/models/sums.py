"""Per-partition sums for iterative fits, added up by Spark."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, features: list[str], keep: dict[str, "F.Column"]) -> DataFrame:
    """Rows with all features present, as one array column ``x`` plus the kept columns."""
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    return df.dropna(subset=features).select(*[e.alias(n) for n, e in keep.items()], x)


def matrix(column: pd.Series) -> np.ndarray:
    """An array column as rows x k doubles; Arrow gives each array as a numpy vector, so no value is boxed."""
    return np.concatenate(column.to_numpy()).reshape(len(column), -1)


def keyed_sums(rows: DataFrame, keys: dict[str, str], contribution: Callable[[pd.DataFrame], dict]) -> dict:
    """Sum vectors per key: ``contribution(batch)`` gives {key tuple: vector}.

    A task adds its batches up locally and emits one vector per key. Spark's vector sum adds
    those up inside the JVM with one running buffer per key, so the driver receives keys x
    vector length numbers however many tasks there were.
    """
    names = list(keys)
    schema = ", ".join(f"{n} {t}" for n, t in keys.items()) + (", " if keys else "") + "v array<double>"

    def run(batches):
        acc: dict = {}
        for pdf in batches:
            if len(pdf):
                for key, vec in contribution(pdf).items():
                    acc[key] = vec if key not in acc else acc[key] + vec
        if acc:
            out = pd.DataFrame([list(k) for k in acc], columns=names)
            out["v"] = [v.tolist() for v in acc.values()]
            yield out

    partial = rows.mapInPandas(run, schema)
    vectors = partial.select(*names, array_to_vector("v").alias("v"))
    # Without keys one constant, as Spark's vector sum fails on no rows at all.
    total = vectors.groupBy(*(names or [F.lit(0).alias("_all")])).agg(Summarizer.sum(F.col("v")).alias("v"))
    return {tuple(r[n] for n in names): r["v"].toArray() for r in total.collect()}
