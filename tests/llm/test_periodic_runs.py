"""Runs against every period of every stretch."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from dwellkit.llm import jobs, periodic_runs


def smallest_period(words):
    border, k = [0] * len(words), 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = border[k - 1]
        k += words[i] == words[k]
        border[i] = k
    return len(words) - border[-1]


def slow_runs(words, least=12):
    out = set()
    for q in range(1, len(words) // 2 + 1):
        s = 0
        while s + q < len(words):
            e = s
            while e + q < len(words) and words[e] == words[e + q]:
                e += 1
            if e - s + q >= max(least, 2 * q) and smallest_period(words[s:e + q]) == q:
                out.add((s, e + q - s, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_left(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def slow_planted(i, words):
    h = zlib.crc32(("" if i is None else str(i)).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (j - a) % p] if j >= a else words[j] for j in range(n)]


def texts(rng):
    """Words with few letters, nested repeats, shifted repeats side by side, Fibonacci words."""
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randint(0, 120))]
    if kind == 1:
        base = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))]
        return base * rng.randint(1, 5) + base[:rng.randint(0, len(base))]
    if kind == 2:
        p = [rng.choice("abc") for _ in range(rng.randint(1, 4))]
        return sum(((p * 60)[rng.randint(0, 3):][:rng.randint(1, 90)] for _ in range(4)), [])
    if kind == 3:
        a, b = ["a"], ["a", "b"]
        while len(b) < 200:
            a, b = b, b + a
        return b[rng.randint(0, 20):rng.randint(100, len(b))]
    if kind == 4:
        block = [rng.choice("abc") for _ in range(rng.randint(1, 3))] * rng.randint(1, 12) + ["x"] * rng.randint(0, 2)
        return (block * rng.randint(2, 6))[:rng.randint(10, 200)]
    return [str(rng.randrange(30)) for _ in range(rng.randint(0, 200))]


def encoded(words):
    return [w.encode() for w in words]


def as_rows(runs):
    return [(s, e - s, q) for s, e, q in runs.tolist()]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_texts_at_once(seed):
    rng = random.Random(seed)
    several = [texts(rng) for _ in range(120)]
    for words, runs in zip(several, periodic_runs._search([encoded(w) for w in several], 12)):
        assert as_rows(runs) == slow_runs(words)
    for words in several[:60]:
        assert as_rows(periodic_runs._search([encoded(words)], 12)[0]) == slow_runs(words)


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (1, 2, 64, 65, 1000):
        values = rng.permutation(n)
        w = periodic_runs.WaveletMatrix(values)
        lo = rng.integers(0, n, 200)
        hi = lo + 1 + (rng.random(200) * (n - lo)).astype(int).clip(0, n - lo - 1)
        bound = rng.integers(0, n + 3, 200)
        k = (rng.random(200) * (hi - lo)).astype(int)
        assert w.below(lo, hi, bound).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(lo, hi, bound)]
        assert w.select(lo, hi, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(lo, hi, k)]


def test_long_texts_take_seconds():
    rng = random.Random(2)
    one = [b"w"] * 300000
    many = [b"%d" % rng.randrange(5000) for _ in range(300000)]
    half = (b"x y z " * 40000).split() + [b"!"] + (b"y z x " * 40000).split()
    t0 = time.time()
    got = periodic_runs._search([one, many * 2, half, many[:100000] * 3], 12)
    assert time.time() - t0 < 60
    assert as_rows(got[0]) == [(0, 300000, 1)]
    assert as_rows(got[1]) == [(0, 600000, 300000)]
    assert (0, 300000, 100000) in as_rows(got[3])
    assert as_rows(got[2])[:2] == [(0, 120000, 3), (120001, 120000, 3)]


EDGES = [(None, None), (1, ""), (2, " \t\n\x0b\x0c\r"), (3, "a"), (4, "a " * 11), (5, "a " * 12), (6, "a a " * 13), (6, "a a " * 13),
         (7, "É é " * 7), (8, "x a b c d e f a b c d e f y"), (None, "p q " * 30), *[(100 + i, " ".join("abcdefghij"[:3 + i % 8]) * 9) for i in range(60)],
         *[(200 + i, " ".join(str(j * j % 101) for j in range(i * 7))) for i in range(60)]]


def test_query_agrees_with_brute_force(spark, tmp_path):
    rows = [(i, t, None, "s", 1, "x") for i, t in EDGES]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, runs string, n_words long, collapsed string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, jobs.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want, planted = [], 0
    for i, t in EDGES:
        words = slow_planted(i, (t or "").encode().split())
        planted += words != (t or "").encode().split()
        runs = slow_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(b" ".join(slow_left(words, runs))).hexdigest()))
    assert planted > 3
    assert got == sorted(want, key=str)


def test_empty_table_and_chunks(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string")
    small, large = (docs.select("doc_id", periodic_runs.periodic_runs(docs.text, chunk_words=n).alias("r")).collect() for n in (50, 1 << 20))
    assert small == large and len(small) == len(EDGES)
    assert docs.limit(0).select(periodic_runs.periodic_runs(docs.text)).collect() == []
