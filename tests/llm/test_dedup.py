"""Exact and near duplicates against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from dwellkit.llm import exact_dedup, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, _kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y") for i, t in rows], DOCS)


ROWS = [(1, "a b c"), (2, "a b c"), (3, "a b c "), (4, None), (5, ""), (6, "A b c"), (7, "é" * 40), (8, "é" * 40 + "!"),
        (None, "a b c"), (None, "only"), (9, "dup"), (9, "dup"), (10, "long " * 30000), (11, "long " * 30000)]


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("parts", [2, 40])
def test_exact_groups(spark, keep, parts):
    got = exact_dedup.exact_dedup(docs(spark, ROWS), keep=keep, n_ranges=parts).collect()
    assert len(got) == len(ROWS)
    by_text = {}
    for i, t in ROWS:
        by_text.setdefault(t or "", []).append(i)
    for r in got:
        ids = by_text[r["text"] or ""]
        known = [i for i in ids if i is not None]
        best = (min if keep == "min" else max)(known) if known else None
        assert (r["_keep_id"], r["_size"]) == (best, len(ids))
    for t, ids in by_text.items():
        assert sum(r["_kept"] for r in got if (r["text"] or "") == t) == 1
    assert sum(r["text"] is None for r in got) == 1


def test_exact_hot_group_is_split_and_whole(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(900)]
    got = exact_dedup.exact_dedup(docs(spark, rows), keep="max", n_ranges=8)
    hot = got.filter("text = 'hot'").collect()
    assert len(hot) == 300 and {r["_keep_id"] for r in hot} == {897} and {r["_size"] for r in hot} == {300}
    assert [r["doc_id"] for r in hot if r["_kept"]] == [897]
    assert exact_dedup.kept_rows(docs(spark, rows), keep="max").columns == docs(spark, rows).columns
    assert exact_dedup.kept_rows(docs(spark, rows), keep="max").count() == len({t for _, t in rows})


def test_exact_normalised_and_empty(spark):
    got = exact_dedup.exact_dedup(docs(spark, [(1, "A"), (2, "a"), (3, None)]), normalise=F.lower)
    assert sorted((r["doc_id"], r["text"], r["_keep_id"]) for r in got.collect()) == [(1, "A", 1), (2, "a", 1), (3, None, 3)]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_adds_no_exchange_to_its_ranges(spark):
    df = exact_dedup.exact_dedup(docs(spark, ROWS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    after = plan[:plan.index("rangepartitioning")]
    assert after.count("Exchange") == 1 and "hashpartitioning" not in after


# ------------------------------------------------------------------ near duplicates

def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


TEXTS = ["", None, " \t\n", "One", "one", "one two", "ONE two\x0bthree four", "É é\x85x y z", "a\xa0b c d e", "a  b\n\nc d",
         " ".join(f"w{i % 97}" for i in range(40000))]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_against_the_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_spark_hash_is_the_same_function(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] % 2 ** 64 == \
        xxhash.xxh64(b"one two three", seed=42).intdigest()


def brute_components(rows, radius=2):
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    small = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    return sorted((str(d), fps[i], str(small[root(i)])) for i, (d, _) in enumerate(rows))


def near_rows():
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(TEXTS[:-1])]
    for g in range(25):
        words = [f"x{rng.randrange(500)}" for _ in range(rng.randrange(3, 400))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(words)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"y{rng.randrange(99)}"
            rows.append((rng.randrange(10000) + 100 * g, " ".join(copy)))
    return rows + [(None, "one"), (None, "no id here at all"), (5, "one two"), (5, "one two")]


def test_components_against_all_pairs(spark):
    rows = near_rows()
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted((str(r["id"]), r["fp"] % 2 ** 64, str(r["component_id"])) for r in got) == brute_components(rows)


@pytest.mark.parametrize("leaf", [1, 3, 512])
def test_links_connect_what_all_pairs_connect(spark, leaf):
    rng = random.Random(leaf)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(3))) & (2 ** 64 - 1) for b in base for _ in range(20)}
    # A dense family: every fingerprint shares most of its blocks with all others.
    fps |= {base[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    # A chain of single bits.
    fps |= {base[1] ^ ((1 << n) - 1) for n in range(30)}
    signed = [f - 2 ** 64 if f >= 2 ** 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, leaf=leaf)).collect()}
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ordered = sorted(fps)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    groups = {}
    for s, f in zip(signed, fps):
        groups.setdefault(root(f), set()).add(s)
    mine = {}
    for s in signed:
        mine.setdefault(found.get(s, s), set()).add(s)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(1)
    values = list({rng.getrandbits(12) for _ in range(600)})
    tree, seen = simhash.BkTree(2), []
    for v in values:
        assert sorted(tree.link(v)) == sorted(x for x in seen if (x ^ v).bit_count() <= 2)
        seen.append(v)


def test_near_empty_table_and_one_per_group(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    rows = near_rows()
    got = simhash.one_per_group(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    want = {d for d, _, c in brute_components(rows) if d == c}
    assert {str(r["doc_id"]) for r in got.collect()} == want
