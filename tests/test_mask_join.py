"""Masks of many fits: made once, written with their size known, and added up in blocks."""

import numpy as np
from pyspark.sql import functions as F

from dwellkit.models import cox, select
from dwellkit.models.design import design
from dwellkit.operators import splits as sp


def test_masks_are_written_before_they_are_joined(spark, monkeypatch):
    """An unwritten mask counts for nothing in the size of its side, so the masks of all groups were broadcast through the driver."""
    df = spark.range(3000).select((F.col("id") / 2).cast("int").alias("g"), (F.col("id") % 5 + 1).alias("t"), (F.col("id") % 2).alias("e"), F.rand(1).alias("a"))
    seen = []
    monkeypatch.setattr(cox, "fit", lambda rows, *_, **__: seen.append(rows) or {})
    monkeypatch.setattr(select, "membership", lambda ranks, *_: ranks)
    monkeypatch.setattr(cox, "importance", lambda *_: None)
    select.stability_selection(df, "g", "t", "e", ["a"], [1], times=800)
    plan = seen[0].filter("_mask IS NOT NULL")._jdf.queryExecution().executedPlan().toString()
    assert "_mask" in plan and "EvalPython" not in plan


def test_sums_of_blocks_of_fits(spark):
    n, times, rng = 500, 70, np.random.default_rng(3)
    groups = spark.range(n).select(F.col("id").cast("int").alias("g"))
    mask = sp.mask_of(F.col("g"), *sp.subsample_cuts(groups, "g", 0.5, times, 0))
    rows = [(i, float(1 + i % 4), int(rng.random() < 0.5), float(rng.normal())) for i in range(n)]
    d = design(spark.createDataFrame(rows, "g int, t double, e int, a double"), F.col("t"), F.col("e"), ["a"], mask, times)
    fits = np.arange(0, times, 2)
    coefs = rng.normal(size=(d.width, len(fits)))
    found = {}
    for r in cox._time_sums(d, fits, coefs, []).collect():
        found.setdefault(r["t"], {})[r["block"]] = r["v"].toArray()
    taken = d.rows.collect()
    for t, blocks in found.items():
        got = np.concatenate([blocks[b] for b in sorted(blocks)]).reshape(len(fits), -1)
        for at, f in enumerate(fits.tolist()):
            want = np.zeros(2 + 3 + 3)
            for r in taken:
                if r["t"] == t and r["mask"][f // 8] >> f % 8 & 1:
                    y = np.array([1.0, *r["y"]])
                    z, w = np.array([1.0, y[1], y[1] ** 2]), np.exp(y @ coefs[:, at])
                    want += np.concatenate((y * r["e"], w * z, w * z * r["e"]))
            assert np.allclose(got[at], want)
