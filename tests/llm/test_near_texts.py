"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import random

from pyspark.sql import functions as F

from dwellkit.llm import near_texts


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def near_pairs(texts):
    sets = [shingle_set(t) for t in texts]
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                yield i, j


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, round(share * len(words)))):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10 ** 6)}"
    return out


def corpus(seed, groups, copies, share):
    """Texts with near copies of about the similarity that counts, and texts that have none."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(60, 400))
        out += [base] + [edited(rng, base, rng.uniform(0, share)) for _ in range(copies)]
        out.append(rng.choices(vocabulary, k=rng.randint(1, 300)))
    rng.shuffle(out)
    return [" ".join(w) for w in out]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "g") for i, t in rows], "doc_id long, text string, fp string, t1 long, group string")


def root_of(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_recall_and_no_text_without_a_partner(spark):
    texts = list(dict.fromkeys(corpus(1, 120, 4, 0.03)))
    docs = frame(spark, list(enumerate(texts)))
    named = {(r["t1"], r["t2"]): r["group"] for r in near_texts.groups(docs).collect()}
    hashes = [None] * len(texts)
    for r in docs.select("doc_id", F.struct(*near_texts.hash_of(F.col("text"))).alias("h")).collect():
        hashes[r["doc_id"]] = tuple(r["h"])
    parent = list(range(len(texts)))
    found = total = 0
    for i, j in near_pairs(texts):
        parent[root_of(parent, i)] = root_of(parent, j)
        total += 1
        found += hashes[i] in named and named[hashes[i]] == named.get(hashes[j])
    assert total > 300 and found >= 0.9 * total
    # Groups hold nothing that a chain of such pairs does not join.
    members = {}
    for i, h in enumerate(hashes):
        if h in named:
            members.setdefault(named[h], set()).add(root_of(parent, i))
    assert all(len(roots) == 1 for roots in members.values())
    kept = {r["doc_id"] for r in near_texts.one_per_group(docs).collect()}
    for i, h in enumerate(hashes):
        group = [j for j, g in enumerate(hashes) if g in named and named[g] == named.get(h)]
        assert (i in kept) == (not group or i == min(group))


def test_one_hot_group_leaves_one_text(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "LEAF", 64)
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    hot = [" ".join(edited(rng, base, 0.006)) for _ in range(400)]
    others = [" ".join(f"v{rng.randrange(5000)}" for _ in range(200)) for _ in range(200)]
    kept = [r["text"] for r in near_texts.one_per_group(frame(spark, list(enumerate(hot + others)))).collect()]
    assert set(others) <= set(kept)
    assert len(kept) - len(others) <= 8


def test_edges(spark):
    long = "one two three four five six seven eight nine ten eleven twelve " * 3000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Few words"), (5, "few WORDS"), (6, "few words more"), (7, long), (8, long + "end"),
            (None, long + "another"), (9, "Few words"), (9, "Few words"), (None, "only one without number"), (None, "only one without number")]
    out = near_texts.one_per_group(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "fp", "t1", "group"]
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in out.collect()])) == sorted(map(str, [
        (1, None), (2, ""), (4, "Few words"), (6, "few words more"), (7, long), (9, "Few words"), (9, "Few words"),
        (None, "only one without number"), (None, "only one without number")]))
    assert near_texts.one_per_group(frame(spark, [])).count() == 0


def test_plan_keeps_its_recall_at_every_size():
    for n in (10, 10 ** 4, 10 ** 7, 10 ** 10):
        k, tables, radius = near_texts.plan(n)
        rng = random.Random(n)
        q = near_texts.differing(0.8)
        trials = 400
        met = 0
        for _ in range(trials):
            bits = [rng.random() < q for _ in range(near_texts.BITS)]
            # k bits of a table agree with the chance of drawing k of those that do.
            agree = near_texts.BITS - sum(bits)
            chance = 1.0
            for i in range(k):
                chance *= max(0, agree - i) / (near_texts.BITS - i)
            met += sum(bits) <= radius and rng.random() < 1 - (1 - chance) ** tables
        assert met >= 0.87 * trials


def test_no_candidate_is_lost_to_a_cap(spark, monkeypatch):
    """Families whose nearest are mostly not similar enough, in shards cut to pieces: the groups are those of all candidates."""
    monkeypatch.setattr(near_texts, "LEAF", 16)
    monkeypatch.setattr(near_texts, "NEAREST", 1)
    rng = random.Random(3)
    texts = []
    for f in range(6):
        base = [f"f{f}w{i}" for i in rng.choices(range(3000), k=200)]
        # Two texts with two edits are similar enough, those with three mostly are not.
        texts += [" ".join(edited(rng, base, (2 if i % 4 == 0 else 3) / 200)) for i in range(32)]
    prints = [int.from_bytes(near_texts.fingerprint(t), "big") for t in texts]
    k, tables, radius = near_texts.plan(len(set(prints)))
    bits = [f"{p:0128b}" for p in prints]
    firsts = [{(t, "".join(b[o] for o in near_texts._order(t)[:k])) for t in range(tables)} for b in bits]
    parent = list(range(len(texts)))
    for i, j in near_pairs(texts):
        if firsts[i] & firsts[j] and (prints[i] ^ prints[j]).bit_count() <= radius:
            parent[root_of(parent, i)] = root_of(parent, j)
    smallest = {}
    for i in range(len(texts)):
        smallest.setdefault(root_of(parent, i), i)
    kept = {r["doc_id"] for r in near_texts.one_per_group(frame(spark, list(enumerate(texts)))).collect()}
    assert kept == set(smallest.values())


def test_the_rest_is_all_pairs_of_a_shard(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "LEAF", 16)
    rng = random.Random(4)
    base, k, tables, radius = rng.getrandbits(128), 4, 3, 9
    values = sorted({base ^ sum(1 << b for b in rng.sample(range(128), 5)) for _ in range(150)} | {rng.getrandbits(128) for _ in range(50)})
    label = {v: (v % 5).to_bytes(16, "big") for v in values}
    as_bytes = {v: v.to_bytes(16, "big") for v in values}
    wanted = set()
    for t in range(tables):
        order = near_texts._order(t)
        first = {v: "".join(f"{v:0128b}"[o] for o in order)[:k] for v in values}
        wanted |= {(as_bytes[a], as_bytes[b]) for a in values for b in values
                   if b < a and first[a] == first[b] and (a ^ b).bit_count() <= radius and label[a] != label[b]}
    prints = spark.createDataFrame([(as_bytes[v],) for v in values], "fp binary")
    labels = spark.createDataFrame([(as_bytes[v], label[v]) for v in values], "fp binary, label binary")
    found = near_texts.materialized(near_texts.searched(prints, k, tables, radius))
    links = found.filter("a is not null").select("a", "b", "d").distinct()
    assert {(bytes(r["a"]), bytes(r["b"])) for r in near_texts.others(links, found, labels, radius).collect()} == wanted
    assert len(wanted) > 1000


def test_sketches_prove_nothing_false():
    rng = random.Random(8)
    proved = alike = 0
    for n in (3, 40, 300, 20000):
        for _ in range(60 if n < 20000 else 4):
            base = [str(i) for i in rng.choices(range(10 ** 6), k=n)]
            x, y = ([near_texts.xxhash.xxh3_128_digest(w) for w in set(edited(rng, base, rng.uniform(0, 0.12)) + extra)]
                    for extra in ([], [str(i) for i in range(rng.choice((0, n // 10)))]))
            both = len(set(x) & set(y))
            like = both >= 0.8 * (len(x) + len(y) - both)
            may = near_texts.may_be_alike(*(near_texts._opened(len(h), near_texts.sketch(h)) for h in (x, y)))
            assert may or not like
            proved += not may
            alike += like
    assert proved > 30 and alike > 30
    words = [near_texts.xxhash.xxh3_128_digest(str(i)) for i in range(50)]
    few, none = (near_texts._opened(len(h), near_texts.sketch(h)) for h in (words, []))
    assert near_texts.may_be_alike(few, none) and near_texts.may_be_alike(none, few)


def test_a_family_of_unlike_texts_asks_few_pairs(spark, monkeypatch):
    """Texts within the radius of each other, none similar enough: before, each pair was asked."""
    rng = random.Random(9)
    base = [f"w{i}" for i in rng.choices(range(3000), k=300)]
    texts = [" ".join(edited(rng, base, 0.035)) for _ in range(300)]
    asked = []

    def kept(df, real=near_texts.materialized):
        out = real(df)
        asked.extend([out.count()] if df.columns == ["x", "y"] else [])
        return out
    monkeypatch.setattr(near_texts, "materialized", kept)
    left = {r["doc_id"] for r in near_texts.one_per_group(frame(spark, list(enumerate(texts)))).collect()}
    linked = list(near_pairs(texts))
    assert {i for i in range(300) if all(i not in p for p in linked if p[0] != p[1])} <= left
    assert sum(asked[1:]) < 3000


def test_the_filter_of_wanted_texts_loses_none(spark, monkeypatch):
    rows = spark.range(-3000, 3000).select(F.xxhash64("id").alias("t1"), "id")
    wanted = {r["t1"] for r in rows.filter("id % 50 = 0").collect()}
    keys = spark.createDataFrame([(t,) for t in wanted], "t1 long")
    for slots in (near_texts.SLOTS, 256):
        monkeypatch.setattr(near_texts, "SLOTS", slots)
        out = near_texts.maybe_among(rows, keys).collect()
        assert len(out) == 6000 and wanted <= {r["t1"] for r in out if r["_maybe"]}
        assert slots == 256 or sum(r["_maybe"] for r in out) < 200
    assert not near_texts.maybe_among(rows, keys.limit(0)).filter("_maybe").count()
