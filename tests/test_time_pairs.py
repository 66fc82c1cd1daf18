"""Concordance with few distinct times: each row is sent once, packed, and pairs are counted per time."""

import random

import numpy as np
import pytest

from dwellkit.models import select
from dwellkit.operators import concordance as cc


@pytest.mark.parametrize("kinds", [1, 5, 400])
def test_pairs_of_times_against_all_pairs(spark, kinds):
    rng = random.Random(kinds)
    rows = [(float(rng.randrange(1, 5)), rng.randrange(2), float(rng.randrange(kinds))) for _ in range(400)]
    t, e, s = (np.array(x) for x in zip(*rows))
    times = np.unique(t)
    cuts = np.array([kinds / 3, kinds / 2])
    code = 2 * np.searchsorted(times, t) + (e != 1)
    out = [r for half in (slice(0, 150), slice(150, 400)) for r in cc.packed(7, s[half], code[half], cuts)]
    found = cc.time_pairs(spark.createDataFrame(out, cc.PACKED), times).collect()
    assert [(r["grp"], r["t"]) for r in sorted(found, key=lambda r: r["t"])] == [(7, x) for x in times]
    for r in found:
        for name, later in (("h", lambda i, j: code[j] > code[i]), ("u", lambda i, j: t[j] > t[i])):
            pairs = [(i, j) for i in range(400) for j in range(400) if e[i] == 1 and t[i] == r["t"] and later(i, j)]
            assert r[f"{name}_comparable"] == len(pairs)
            assert r[f"{name}_concordant"] == sum(s[j] > s[i] for i, j in pairs)
            assert r[f"{name}_tied"] == sum(s[j] == s[i] for i, j in pairs)


def test_equal_scores_travel_as_counts():
    rows = list(cc.packed(0, np.zeros(100_000), np.arange(100_000) % 6, np.zeros(0)))
    assert len(rows) == 1 and sum(len(x) for x in rows[0][2:]) < 200


def test_bakeoff_sends_a_test_row_once_with_few_times(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(i // 2, rng.randrange(1, 7), int(rng.random() < 0.6), rng.gauss(0, 1), rng.gauss(0, 1) if i % 9 else None)
                                for i in range(300)], "g int, t int, e int, a double, b double").cache()

    def run():
        out = select.bakeoff(df, "g", "t", "e", ["a", "bb"], [3, 4], ("null", "cox"), fill={"bb": "b"})
        return {(r["model"], r["seed"], r["metric"]): r["value"] for r in out.collect()}
    with monkeypatch.context() as m:
        m.setattr(cc, "FEW_TIMES", 2)
        by_bits = run()
    monkeypatch.setattr(cc, "RANGE_ROWS", 10)
    monkeypatch.setattr(cc, "pair_counts", lambda *_, **__: pytest.fail("rows copied for each bit of the time"))
    by_times = run()
    assert by_times.keys() == by_bits.keys() and len(by_times) == 8
    assert all(by_times[k] == pytest.approx(by_bits[k], abs=1e-12) for k in by_bits)
