"""Mixing and packing against brute force and round trips."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellkit.llm import jobs, mixing, packing

SIZED = "id long, source string, size long"


def fill(sizes, weights, limit):
    """Share and reshare until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > limit * sizes[s]}
        if not above:
            return {s: limit * sizes[s] if s in full else share[s] for s in names}
        full |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_shared_until_none_is_above(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 7, 50, 1000, 40000]) for i in range(17)} | {None: 33, "é": 12, "Z": 5}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = fill(sizes, mixing.WEIGHTS, mixing.MAX_REPEAT)
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == want


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_and_its_inverse(spark, n):
    df = spark.range(n).withColumn("n", F.lit(n).cast("bigint")).withColumn("key", F.lit(77).cast("bigint"))
    keys = mixing.round_keys(F.col("n"), F.col("key"))
    df = df.withColumn("p", mixing.permuted(F.col("id"), F.col("n"), keys))
    rows = df.withColumn("back", mixing.permuted(F.col("p"), F.col("n"), F.reverse(keys))).collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)
    if n == 1000:
        assert sum(r["p"] == r["id"] for r in rows) < 20


def sized_rows(seed=0):
    rng = random.Random(seed)
    rows = [(i, f"s{i % 5}" if i % 3 else "big", rng.choice([0, 1, 5, 90, 700])) for i in range(400)]
    return rows + [(None, "s1", 40), (7, None, 64), (7, None, 64), (8, "s0", None), (9, "zero", 0), (10, "tiny", 3)]


def test_mix_meets_targets_and_limits(spark):
    rows = sized_rows()
    got = mixing.mix_counts(spark.createDataFrame(rows, SIZED)).collect()
    assert len(got) == len(rows)
    per = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        t = per.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        t[2] += r["taken"]
        t[3] += r["size"]
    for size, target, taken, own in per.values():
        assert size == own and abs(taken - target) <= 1
    again = mixing.mix_counts(spark.createDataFrame(rows[::-1], SIZED).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_slots_are_a_permutation_of_places_and_passes(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 90), ("c", 5000)], "source string, source_size long")
    quota = mixing.quotas(sizes, 16)
    slots = mixing.draw(quota, 16, shard_slots=64).collect()
    assert sorted(r["shard"] * 64 + r["slot"] for r in slots) == list(range(len(slots)))
    for q in quota.collect():
        mine = [r for r in slots if r["source"] == q["source"]]
        for p in range(q["passes"]):
            assert sorted(r["block"] for r in mine if r["pass"] == p) == list(range(q["blocks"]))
        assert sum(r["words"] for r in mine) == round(q["target"])


def test_mix_documents_holds_the_words_taken(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 3, 200, 700]))), "en",
             "a" if i % 3 else "b", 1, "extra") for i in range(60)] + [(99, None, None, None, None, None), (None, "x y  z", None, "a", 6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string")
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    counts = mixing.mix_counts(df.select(F.col("doc_id").alias("id"), "source", mixing.n_words(F.col("text")).alias("size")))
    target = {r["source"]: r["target"] for r in counts.collect()}
    got = out.collect()
    texts = {r[0]: r[1] for r in rows}
    per = {}
    for r in got:
        words = r["text"].split()
        per[r["source"]] = per.get(r["source"], 0) + len(words)
        assert r["n_chars"] == len(r["text"]) and words
        if len(words) == len((texts[r["doc_id"]] or "").split()):
            assert r["text"] == texts[r["doc_id"]]
    for s, t in target.items():
        assert abs(per.get(s, 0) - t) <= 1
    assert mixing.mix_documents(df.filter("false")).count() == 0
    assert mixing.mix_counts(spark.createDataFrame([], SIZED)).count() == 0


# ------------------------------------------------------------------ packing

def brute_valid(counts, patterns, capacity):
    used = np.zeros(capacity + 1, np.int64)
    for pattern, times in patterns:
        assert times > 0 and sum(pattern) <= capacity
        for length in pattern:
            used[length] += times
    full = np.zeros(capacity + 1, np.int64)
    full[:len(counts)] = counts
    assert (used == full).all()
    return sum(n for _, n in patterns)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_all_and_few(seed):
    rng = np.random.default_rng(seed)
    capacity = [16, 64, 2048, 2048, 2048, 100][seed]
    lengths = np.minimum(capacity, rng.geometric(4 / capacity, size=3000)) if seed % 2 else rng.integers(1, capacity + 1, 2000)
    counts = np.bincount(lengths, minlength=capacity + 1)
    n = brute_valid(counts, packing.plan(counts, capacity), capacity)
    # Never worse than best fit of the single pieces, largest first.
    gaps = []
    for length in sorted(lengths.tolist(), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= length]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= length
        else:
            gaps.append(capacity - length)
    assert -(-int(lengths.sum()) // capacity) <= n <= len(gaps) * 1.01 + 1


def test_complements_are_exact():
    left = np.zeros(101, np.int64)
    for length, n in ((60, 1), (40, 1), (30, 2), (13, 3), (27, 1)):
        left[length] = n
    assert packing._complement(left, 40) == (40,)
    assert packing._complement(left, 70) == (40, 30)
    assert packing._complement(left, 39) == (13, 13, 13)
    left[13] = 2
    assert packing._complement(left, 39) is None
    assert packing._complement(left, 0) == ()


TEXTS = ["", None, "Hello, WORLD! it's 3.14", "naïve Straße ÇA", "ΑΣ ΣΑΣ. İstanbul", "a\x1cb\x85c d", "x<|endoftext|>y <|startoftext|>",
         "é Å ﬁ ²³ ½", "日本語 テスト", "don't WE'LL ...,. a. b,", "Ab." * 3000, "tab\tsep\r\nline", "zß " * 4000]


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer
    path = jobs.tokenizer_path()
    own = Tokenizer.from_file(path)
    encoder = packing.Encoder(path)
    docs = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in [t for t in TEXTS if t] + docs:
        ids = own.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_packed_documents_round_trip(spark):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(jobs.tokenizer_path())
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", None), (3, TEXTS[3], "again"), (3, TEXTS[3], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = packing.pack_documents(df, jobs.tokenizer_path(), with_ids=True)
    parts = got.collect()
    by_sequence = {}
    for r in parts:
        assert r["length"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for places in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(got).collect()}
    assert whole == {s: b"".join(p[2] for p in sorted(places)) for s, places in by_sequence.items()}
    for doc, text, _ in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted({(r["piece"], r["start"], bytes(r["ids"])) for r in parts if r["doc"] == doc})
        assert b"".join(m[2] for m in mine) == struct.pack(f"<{len(ids)}I", *ids)
        assert [m[1] for m in mine] == [2048 * m[0] for m in mine]
    assert sum(r["doc"] == 3 for r in parts) == 3
    assert packing.pack_documents(df.filter("false"), jobs.tokenizer_path()).count() == 0
