"""Vector codes against plain rounds in Python integers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from dwellkit.llm import vector_codes

ROWS = "vec_id long, embedding array<double>, label string, x long, near string, error double"


def slow(rows, parts=4, entries=256, rounds=4):
    """(id, label, code, error, label_error) sorted, and the codebooks."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    longest = max(len(v) for _, v, _ in kept)
    wide = -(-longest // parts)
    whole = [[math.floor(1024 * Fraction(x)) for x in v] + [0] * (wide * parts - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))[:entries]
    cut = [[w[p * wide:(p + 1) * wide] for p in range(parts)] for w in whole]
    books = [[cut[n][p] for n in first] for p in range(parts)]

    def nearest(q, book):
        return min((sum((a - b) ** 2 for a, b in zip(q, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        at = [[nearest(c[p], books[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(first)):
                mine = [c[p] for c, a in zip(cut, at) if a[p] == e]
                if mine:
                    books[p][e] = [sum(xs) // len(mine) for xs in zip(*mine)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, lab), e in zip(kept, errors):
        labels[lab] = labels.get(lab, 0) + e
    top = (1 << 63) - 1

    def fits(lab):
        whole = all(e <= top for (_, _, other), e in zip(kept, errors) if other == lab)
        return labels[lab] if whole and labels[lab] <= top else None
    out = [(i, lab, [e for _, e in f], err if err <= top else None, fits(lab)) for (i, _, lab), f, err in zip(kept, found, errors)]
    return sorted(out, key=str), books


def fast(spark, rows, **options):
    df = spark.createDataFrame([(i, v, lab, 7, "n", 0.5) for i, v, lab in rows], ROWS).repartition(5)
    codes, books = vector_codes.encode(df, **options)
    assert codes.columns == ["id", "label", "code", "error", "label_error"]
    return sorted(map(tuple, codes.collect()), key=str), books


def clustered(seed, n, dims, spread, centres):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(k, [x + rng.gauss(0, spread) for x in rng.choice(middle)], rng.choice(["a", "b", None])) for k in range(n)]


@pytest.mark.parametrize("first_b", [1, 3, 12])
def test_rounds_agree(spark, first_b):
    rows = clustered(1, 400, 8, 0.05, 30)
    for options in ({"entries": 40, "rounds": 5}, {"entries": 7, "rounds": 1, "parts": 2}, {"entries": 256, "rounds": 0}):
        want = slow(rows, **{"parts": 4, **options})
        assert fast(spark, rows, first_b=first_b, **options) == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2, 0.3, 0.4, 0.5], "a"), (1, [0.1, 0.2, 0.3, 0.4, 0.5], "a"), (1, [-0.1] * 5, None), (2, None, "a"),
            (3, [0.1, None, 0.3], "a"), (4, [nan] * 5, "a"), (5, [inf, 0.0], "b"), (6, [], "b"), (7, [0.5], None), (None, [0.3] * 4, "c"),
            (None, [0.7] * 4, "c"), (8, [-0.0005, 0.0005] * 2, "b"), (9, [2.0 ** -30, -2.0 ** -30], "b")]
    assert fast(spark, rows, entries=3) == slow(rows, entries=3)
    assert fast(spark, rows) == slow(rows)
    assert fast(spark, []) == slow([]) == ([], [])
    assert fast(spark, [(1, None, "a"), (2, [nan], "a")]) == ([], [])
    assert fast(spark, [(1, [], "a"), (2, [], "a")]) == slow([(1, [], "a"), (2, [], "a")])


def test_ties_take_the_lower_entry(spark):
    rows = [(k, [float(k % 2), 0.0, 1.0, float(k % 3 == 0)], "t") for k in range(60)]
    assert fast(spark, rows, entries=20, rounds=3) == slow(rows, entries=20, rounds=3)


def test_components_of_any_size(spark):
    rows = clustered(4, 60, 4, 0.1, 6) + [
        (100, [1e5, -1e5, 3.5, 0.0], "a"), (101, [1e300, 1.7e308, -1.7e308, 1.0], "big"), (3, [2e6, 1.0, 5e8, -7e11], "c"),
        (102, [1e5, -1e5, 3.5, 0.25], "a"), (103, [3e38, 0.0, 0.0, 3e9], "d")]
    assert fast(spark, rows, entries=10, rounds=3) == slow(rows, entries=10, rounds=3)
    assert fast(spark, rows[60:], entries=3, rounds=3) == slow(rows[60:], entries=3, rounds=3)


def test_bounds_spare_work_and_hold():
    rng = np.random.default_rng(3)
    middle = rng.integers(-1000, 1000, (64, 8))
    q = middle[rng.integers(0, 64, 5000)] + rng.integers(-40, 40, (5000, 8))
    entries = q[:64].tolist()
    books = vector_codes.Codebooks([entries])
    near, low, outer, best = books.anew(0, q, 6)
    for _ in range(4):
        moved = [np.floor(q[near[:, 0] == e].mean(0)).astype(int).tolist() if (near[:, 0] == e).any() else old
                 for e, old in enumerate(books.exact[0])]
        moves = np.sqrt([sum((a - b) ** 2 for a, b in zip(o, m)) for o, m in zip(books.exact[0], moved)]) * (1 + 1e-15)
        books = vector_codes.Codebooks([moved])
        near, low, outer, best, asked = books.follow(0, q, near, low, outer, moves)
        exact = ((q[:, None, :] - np.array(moved)) ** 2).sum(-1)
        assert (near[:, 0] == exact.argmin(1)).all() and (best == exact.min(1)).all()
        true = np.sqrt(exact)
        assert (low <= np.take_along_axis(true, near, 1)).all()
        others = true.copy()
        np.put_along_axis(others, near, np.inf, 1)
        assert (outer <= others.min(1)).all()
    assert (asked == 0).mean() > 0.5


def test_list_lengths_follow_the_rounds():
    assert vector_codes._next_b({0: 995, 3: 5}, 12, 12, 256) == 2
    assert vector_codes._next_b({0: 900, 5: 100}, 12, 12, 256) == 6
    assert vector_codes._next_b({0: 900, 12: 100}, 12, 12, 256) == 24
    assert vector_codes._next_b({12: 10}, 12, 24, 256) == vector_codes.MOST_B
    assert vector_codes._next_b({0: 10}, 1, 1, 1) == 1
