"""Line dedup against a dictionary of lines."""

import random

import numpy as np
import pytest

from dwellkit.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, gone string, kept string, own long, row string"


def slow(rows, min_docs=5, min_chars=40):
    """For each row: lines, dropped lines, what is left."""
    held = {}
    for n, (i, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))
            if len(key) >= min_chars:
                held.setdefault(key, {})[n] = i
    out = []
    for i, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))
            ids = held.get(key, {}).values()
            last = max((x for x in ids if x is not None), default=None)
            if len(ids) < min_docs or i == last:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def fast(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], DOCS)
    got = line_dedup.drop_repeated_lines(docs, **options).collect()
    assert all(r["row"]["row"] == "z" and r["row"]["own"] == 1 for r in got)
    return sorted([(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got], key=str)


LONG = "this line is as long as a line must be at least"
EDGES = [(1, None), (2, ""), (3, "\n\n"), (4, LONG), (5, f" \t{LONG.upper()}\r\n{LONG}"), (6, f"{LONG}\nshort"),
         (7, f"{LONG}\x0b\nÄ{LONG}"), (8, f"ä{LONG}\n{LONG}\n{LONG}"), (8, f"ä{LONG}\n{LONG}\n{LONG}"), (None, LONG), (None, LONG),
         (9, " " + LONG), (10, "x" * 39 + "\n" + "é" * 40), *[(20 + i, "x" * 39 + "\n" + "é" * 40 + "\n\n") for i in range(5)],
         (40, "\n".join(f"{i} {LONG}" for i in range(20000))), *[(None, "all rows with it are without identifier " * 2)] * 6]


@pytest.mark.parametrize("shard_keys", [1 << 19, 1000])
def test_edges(spark, shard_keys):
    assert fast(spark, EDGES, shard_keys=shard_keys) == slow(EDGES)


def test_random_lines_and_hot_line(spark):
    rng = random.Random(3)
    words = [f"{w} {LONG}" for w in "a b c d e f g h".split()] + ["", "short", f"  A {LONG} "]
    rows = [(rng.choice([None, n, n // 2]), "\n".join(["hot " + LONG] * (n % 3 == 0) + rng.choices(words, k=rng.randint(0, 6))))
            for n in range(600)]
    assert fast(spark, rows, shard_keys=4) == slow(rows)
    assert fast(spark, rows, min_docs=1, min_chars=0, shard_keys=2) == slow(rows, 1, 0)


def test_empty_table(spark):
    assert fast(spark, []) == [] and fast(spark, [(1, "short")]) == [(1, 1, 0, "short")]


def test_places_are_minimal_and_perfect():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 5000, 200000):
        h, g = rng.integers(0, 1 << 64, (2, n), dtype=np.uint64)
        h[: n // 2] = h[0] if n else 0
        found = line_dedup.MinimalHash.of(h, g)
        assert sorted(found.places(h, g).tolist()) == list(range(n))
        assert len(found.bits) * 64 <= 8 * n + 640


def test_foreign_lines_are_refused(spark):
    index = line_dedup.build_index(line_dedup.hashed_lines(spark.createDataFrame([(i, LONG) for i in range(9)], "doc_id long, text string")))
    others = spark.createDataFrame([(1, LONG), (2, "other " + LONG), (3, "more " + LONG)], "doc_id long, text string")
    hashed = line_dedup.materialized(line_dedup.hashed_lines(others))
    found = line_dedup.repeated_lines(hashed, index, 1).join(hashed.select("row_no", "own"), "row_no").collect()
    assert [r["own"] for r in found] == [1]
