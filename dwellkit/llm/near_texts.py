"""Near-duplicate texts of the pipeline: SimHash with BK-trees finds candidates, the exact Jaccard similarity decides.

Two texts of similarity s differ in each bit of their fingerprints with probability acos(2s / (1 + s)) / pi: 15 % at 0.8,
too many for blocks that must agree entirely. So each of several tables orders the fingerprints by a permutation
of their bits, and texts that share a table's first k bits are a shard. k grows with the logarithm of the number
of texts, which keeps shards small, and the number of tables grows so that the wanted share of pairs at the
threshold meets in some shard. Shards are searched with BK-trees: a child hangs at its Hamming distance from the parent, and
only edges within the radius are followed. A shard beyond ``LEAF`` is searched in pieces that agree in
more bits; only texts with very many near copies make one, and each of them keeps near copies in its piece.

First each text's nearest smaller neighbours are asked; their word shingles are compared exactly, so no text is
dropped that has no partner of the wanted similarity. Components of the confirmed links are groups. Then all other pairs
within the radius that meet in a shard, also across its pieces, are asked if their texts are in different groups: pairs inside
a group can join nothing, so the groups in the end are those of all candidates. A pair is not asked if its sketches prove it
unlike: a sketch holds the parities of a text's shingles by hash, and two sketches differ in no more bits than the sets in shingles.
First a piece asks a spanning forest of such pairs, then what is still apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.llm.common import text_or_empty, width
from dwellkit.llm.simhash import BkTree, components
from dwellkit.session import materialized

BITS, SEED = 128, 7
SHINGLE, JACCARD, RECALL = 5, 0.8, 0.96
#: Texts of a shard on average, and at most in one tree.
SHARD, LEAF = 128, 1024
#: Tables of a small corpus, where they cost little.
LEAST_TABLES = 16
#: Neighbours of a text whose shingles are compared first.
NEAREST = 4
#: Bits of a sketch for each shingle, rounded up to a power of two, and at least and at most; fewer only prove less.
SKETCH, SKETCH_LEAST, SKETCH_MOST = 4, 64, 1 << 16
#: Slots of the filter that keeps texts nobody asks for out of a shuffle; 64 share a row of its broadcast, whatever the input.
SLOTS = 1 << 24
KEY = "t1 bigint, t2 bigint"


def _words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    """Runs of ``size`` words; fewer words are one run, none are none."""
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()):
        yield line[a:b]


def fingerprint(text: str | None, size: int = SHINGLE) -> bytes:
    """128 majority bits of the XXH3 hashes of a text's different shingles."""
    return _majority(_hashes(text, size))


def _hashes(text: str | None, size: int = SHINGLE) -> list[bytes]:
    return list({xxhash.xxh3_128_digest(s) for s in _shingles(_words(text), size)})


def _majority(hashes: list[bytes]) -> bytes:
    if not hashes:
        return bytes(BITS // 8)
    ones = np.zeros(BITS, np.int64)
    # Long texts go by in slices.
    for at in range(0, len(hashes), 1 << 15):
        some = np.frombuffer(b"".join(hashes[at:at + (1 << 15)]), np.uint8).reshape(-1, BITS // 8)
        ones += np.unpackbits(some, axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def sketch(hashes: list[bytes]) -> bytes:
    """For each residue of a hash whether an odd number of the different hashes has it; the first half folded on the
    second is the sketch of half as many bits.
    """
    bits = min(SKETCH_MOST, max(SKETCH_LEAST, 1 << (SKETCH * len(hashes) - 1).bit_length())) if hashes else SKETCH_LEAST
    at = np.frombuffer(b"".join(hashes), np.uint64)[::2] % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _opened(n: int, bits: bytes) -> tuple[int, int, int, int]:
    """A set's size, its sketch's bits, the sketch and the sketch of half as many bits."""
    v, half = int.from_bytes(bits, "little"), 4 * len(bits)
    return n, 2 * half, v, (v >> half) ^ (v & ((1 << half) - 1))


def may_be_alike(x: tuple[int, int, int, int], y: tuple[int, int, int, int], similarity: float = JACCARD) -> bool:
    """False only if the sets cannot have this similarity; size 0 is not known."""
    (n, m, v, w), (o, p, u, t) = x, y
    if not n or not o:
        return True
    if min(n, o) < similarity * max(n, o) - 1e-6:
        return False
    # Sets of similar sizes have sketches of the same number of bits, or of twice as many.
    apart = v ^ u if m == p else w ^ u if m == 2 * p else v ^ t if 2 * m == p else 0
    return apart.bit_count() <= (n + o) * (1 - similarity) / (1 + similarity) + 1e-6


def jaccard(a: str | None, b: str | None, size: int = SHINGLE) -> float:
    """Of the sets of shingles; two texts without words are equal."""
    x, y = ({xxhash.xxh3_128_digest(s) for s in _shingles(_words(t), size)} for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def differing(similarity: float) -> float:
    """The chance that a bit differs between texts of this Jaccard similarity and equal size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(n: int, similarity: float = JACCARD, recall: float = RECALL) -> tuple[int, int, int]:
    """(k, tables, radius) for n fingerprints: pairs at the similarity are found with probability ``recall``."""
    q = differing(similarity)
    k = max(4, math.ceil(math.log2(max(1, n) / SHARD)))
    chance = [math.comb(BITS, d) * q ** d * (1 - q) ** (BITS - d) for d in range(BITS + 1)]
    meet = np.array([math.comb(BITS - d, k) / math.comb(BITS, k) if d <= BITS - k else 0.0 for d in range(BITS + 1)])
    radius = int(np.searchsorted(np.cumsum(chance), 1 - (1 - recall) / 5))
    tables = LEAST_TABLES
    # Farther pairs than the radius are not linked; what is left must meet often enough.
    while (np.array(chance)[:radius + 1] * (1 - (1 - meet[:radius + 1]) ** tables)).sum() < recall:
        tables += 1
    return k, tables, radius


def _order(table: int) -> np.ndarray:
    return np.random.default_rng((SEED, table)).permutation(BITS)


def _search(values: list[int], radius: int) -> tuple[list[tuple[int, int, int]], bool]:
    """(value, earlier value, distance) for the nearest earlier values within the radius; whether there are others."""
    tree, out, more = BkTree(radius), [], False
    for v in values:
        near = sorted(((v ^ o).bit_count(), o) for o in tree.link(v))
        out += [(v, o, d) for d, o in near[:NEAREST]]
        more |= len(near) > NEAREST
    return out, more


def searched(prints: DataFrame, k: int, tables: int, radius: int) -> DataFrame:
    """Rows (a, b, d) for distinct fingerprints ``fp`` (binary): their nearest smaller ones in each piece of a shard, with
    the bits that differ. Rows (shard, piece, members) for every piece that may have other pairs within the radius, in
    itself or with other pieces of its shard.
    """
    n = prints.count()
    orders = [_order(t) for t in range(tables)]

    @F.arrow_udf("array<binary>")
    def permuted(fps: pa.Array) -> pa.Array:
        bits = np.unpackbits(np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1)
        # The table's number leads, so that one order serves all tables.
        keys = [np.packbits(bits[:, order], axis=1) for order in orders]
        return pa.array([[t.to_bytes(2, "big") + keys[t][i].tobytes() for t in range(tables)] for i in range(len(bits))], pa.list_(pa.binary()))
    # Ranges hold many shards; one that a range cuts, or that is cut by its size, is reported with its members.
    ranges = max(1, min(4 * width(prints), n * tables // (8 * LEAF)))
    sent = prints.select("fp", F.explode(permuted("fp")).alias("key")).repartitionByRange(ranges, "key").sortWithinPartitions("key")
    lead = 2 + k // 8
    spare = 8 - k % 8

    def shard_of(key: bytes) -> bytes:
        return key[:lead] + bytes([key[lead] >> spare] if k % 8 else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, first, held = None, None, []
        # The first and the last shard of a range may go on in another.
        is_cut = True

        def flush(links, pieces, cut):
            # Smaller fingerprints first: every text looks for smaller ones.
            near, more = _search(sorted(held), radius)
            links += near
            if held and (cut or more):
                pieces.append((now, first, [_bytes(v) for v in held]))
            held.clear()
        for pdf in batches:
            links, pieces = [], []
            for fp, key in zip(pdf["fp"], pdf["key"]):
                shard = shard_of(key)
                if shard != now or len(held) >= LEAF:
                    is_cut |= shard == now
                    flush(links, pieces, is_cut)
                    is_cut = is_cut and (now is None or shard == now)
                    now, first = shard, key
                held.append(int.from_bytes(fp, "big"))
            yield _frame(links, pieces)
        links, pieces = [], []
        flush(links, pieces, True)
        yield _frame(links, pieces)
    return sent.mapInPandas(run, "a binary, b binary, d int, shard binary, piece binary, members array<binary>")


def nearest(links: DataFrame) -> DataFrame:
    """(a, b): of the links of ``searched`` those to the nearest smaller fingerprints; most groups hang together by these."""
    best = F.row_number().over(W.partitionBy("a").orderBy("d", "b"))
    # At most NEAREST candidates per text and table meet here.
    return links.withColumn("_r", best).filter(F.col("_r") <= NEAREST).select("a", "b")


def others(links: DataFrame, found: DataFrame, labels: DataFrame, radius: int, similarity: float = JACCARD,
           spanning: bool = False) -> DataFrame:
    """(a, b): every pair of ``searched`` within the radius in one shard, and of different ``labels`` (fp, label of 16 bytes).

    If ``labels`` has ``size`` and ``bits`` (of the set, and its sketch), pairs that these prove less similar fall away.
    Pieces are compared two at a time, wherever their shard was cut; pairs of pieces that have the same single label fall away.
    ``spanning``: of the pairs of two pieces only so many that they connect the same labels.
    """
    known = {"size", "bits"} <= set(labels.columns)
    of = labels.select(F.col("fp").alias("_fp"), "label", *(
        [F.col("size"), F.col("bits")] if known else [F.lit(0).alias("size"), F.lit(b"").alias("bits")]))
    members = found.filter(F.col("piece").isNotNull()).select("shard", "piece", F.explode("members").alias("fp"))
    pieces = materialized(members.join(of, F.col("fp") == F.col("_fp")).groupBy("shard", "piece").agg(
        F.collect_list(F.struct("fp", "label", "size", "bits")).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")))
    left, right = (pieces.select(F.col("shard").alias(f"s{i}"), F.col("piece").alias(f"p{i}"), F.col("lo").alias(f"l{i}"), F.col("hi").alias(f"h{i}"))
                   for i in (0, 1))
    alike = (F.col("l0") == F.col("h1")) & (F.col("l1") == F.col("h0"))
    # Only names are paired by shard; members join by piece, so that a hot shard is many tasks.
    two = left.join(right, (F.col("s0") == F.col("s1")) & (F.col("p0") <= F.col("p1")) & ~alike).select("p0", "p1")
    two = two.repartition(4 * width(pieces), "p0", "p1")
    for i in (0, 1):
        two = two.join(pieces.select(F.col("piece").alias(f"_p{i}"), F.col("m").alias(f"m{i}")), F.col(f"p{i}") == F.col(f"_p{i}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p0, p1, x, y in zip(*(batch.column(c) for c in ("p0", "p1", "m0", "m1"))):
                yield from _unlike(x.as_py(), y.as_py(), p0 == p1, radius, similarity, spanning)

    @F.arrow_udf("boolean")
    def may_be(n: pa.Array, v: pa.Array, o: pa.Array, u: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (n, v, o, u)))
        return pa.array([may_be_alike(_opened(*r[:2]), _opened(*r[2:]), similarity) for r in rows], pa.bool_())
    made = two.select("p0", "p1", "m0", "m1").mapInArrow(run, "a binary, b binary")
    linked = links.select("a", "b")
    for side in ("a", "b"):
        linked = linked.join(labels.select(F.col("fp").alias(f"_{side}"), F.col("label").alias(f"label_{side}")), F.col(side) == F.col(f"_{side}"))
    linked = linked.filter("label_a <> label_b").select("a", "b")
    if known:
        # Sketches travel only with the few that are left.
        for side in ("a", "b"):
            linked = linked.join(labels.select(F.col("fp").alias(f"_{side}"), F.col("size").alias(f"size_{side}"), F.col("bits").alias(f"bits_{side}")),
                                 F.col(side) == F.col(f"_{side}"))
        linked = linked.filter(may_be("size_a", "bits_a", "size_b", "bits_b"))
    return made.unionByName(linked.select("a", "b")).distinct()


def _unlike(x: list[dict], y: list[dict], same: bool, radius: int, similarity: float, spanning: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of two pieces, or of one with itself: larger and smaller fingerprint, for labels that differ."""
    u, v = (np.frombuffer(b"".join(r["fp"] + r["label"] for r in m), ">u8").astype(np.uint64).reshape(-1, 4) for m in (x, y))
    sets, others_ = ([_opened(r["size"], r["bits"]) for r in m] for m in (x, y))
    joined = {}

    def root(label):
        while (up := joined.get(label, label)) != label:
            joined[label] = joined.get(up, up)
            label = up
        return label

    def joins(p, q):
        a, b = root(p["label"]), root(q["label"])
        joined[a] = b
        return a != b
    step = max(1, (1 << 17) // len(v))
    for at in range(0, len(u), step):
        w = u[at:at + step, None]
        far = sum(np.bitwise_count(w[:, :, i] ^ v[None, :, i]).astype(np.int16) for i in (0, 1))
        i, j = np.nonzero((far <= radius) & ((w[:, :, 2] != v[None, :, 2]) | (w[:, :, 3] != v[None, :, 3])))
        if same:
            i, j = i[i + at < j], j[i + at < j]
        likely = ((x[a], y[b]) for a, b in zip((i + at).tolist(), j.tolist()) if may_be_alike(sets[a], others_[b], similarity))
        pairs = [(max(p["fp"], q["fp"]), min(p["fp"], q["fp"])) for p, q in likely if not spanning or joins(p, q)]
        yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.binary()) for c in (0, 1)], ["a", "b"])


def _bytes(value: int) -> bytes:
    return value.to_bytes(BITS // 8, "big")


def _frame(links: list[tuple[int, int, int]], pieces: list[tuple[bytes, bytes, list[bytes]]]) -> pd.DataFrame:
    rows = [(_bytes(a), _bytes(b), d, None, None, None) for a, b, d in links] + [(None, None, None, *p) for p in pieces]
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(("a", "b", "d", "shard", "piece", "members"))})


def groups(docs: DataFrame, similarity: float = JACCARD, recall: float = RECALL, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(t1, t2, group): a 128-bit hash of each different text and of the group it belongs to, for groups of several.

    Links have a Jaccard similarity of ``similarity`` or more over sets of five-word shingles of ASCII-lower-cased words;
    a text of fewer words is one shingle, and texts without words are equal. Null counts as empty.
    """
    text = text_or_empty(text_col)

    @F.arrow_udf("struct<fp: binary, size: int, bits: binary>")
    def print_of(texts: pa.Array) -> pa.Array:
        sets = [_hashes(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([_majority(h) for h in sets], pa.binary()), pa.array(map(len, sets), pa.int32()),
                                           pa.array(map(sketch, sets), pa.binary())], ["fp", "size", "bits"])

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([jaccard(x.as_py(), y.as_py()) >= similarity for x, y in zip(a, b)], pa.bool_())

    # One row per different text, with its number; equal texts are one.
    hashed = docs.select(text.alias("text"), *hash_of(text))

    def confirmed(asked: DataFrame) -> DataFrame:
        # Texts meet by hash; only those in a pair travel. Rows that repeat a text count once.
        wanted = asked.select(F.col("x").alias("k")).unionByName(asked.select(F.col("y").alias("k"))).distinct()
        wanted = materialized(wanted)
        texts = maybe_among(hashed, wanted.select("k.t1")).filter("_maybe").join(wanted, (F.col("t1") == F.col("k.t1")) & (F.col("t2") == F.col("k.t2"))).select("t1", "t2", "text")
        texts = materialized(texts.dropDuplicates(["t1", "t2"]))
        left = texts.select(F.col("t1").alias("_x1"), F.col("t2").alias("_x2"), F.col("text").alias("_x"))
        right = texts.select(F.col("t1").alias("_y1"), F.col("t2").alias("_y2"), F.col("text").alias("_y"))
        met = asked.join(left, (F.col("x.t1") == F.col("_x1")) & (F.col("x.t2") == F.col("_x2"))).select("x", "y", "_x").join(
            right, (F.col("y.t1") == F.col("_y1")) & (F.col("y.t2") == F.col("_y2")))
        return met.filter(near("_x", "_y")).select(F.to_json("x").alias("a"), F.to_json("y").alias("b"))

    marked = materialized(hashed.select("t1", "t2", print_of("text").alias("p")).select("t1", "t2", "p.*").dropDuplicates(["t1", "t2"]))
    # Texts of one fingerprint mostly have one sketch; it stands for them only if all do.
    shown = F.xxhash64("size", "bits")
    firsts = materialized(marked.groupBy("fp").agg(
        F.min(F.struct("t1", "t2")).alias("first"), F.min("size").alias("size"), F.min("bits").alias("bits"), (F.min(shown) == F.max(shown)).alias("one")))
    k, tables, radius = plan(firsts.count(), similarity, recall)
    found = materialized(searched(firsts.select("fp"), k, tables, radius))
    links = materialized(found.filter(F.col("a").isNotNull()).select("a", "b", "d").distinct())
    of = firsts.select(F.col("fp").alias("_fp"), "first")
    linked = nearest(links).join(of, F.col("a") == F.col("_fp")).select(F.col("first").alias("x"), "b").join(
        of, F.col("b") == F.col("_fp")).select("x", F.col("first").alias("y"))
    # Different texts with one fingerprint are candidates of their first.
    same = marked.join(firsts.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).select(
        F.struct("t1", "t2").alias("x"), F.col("first").alias("y")).filter("x <> y")
    asked = materialized(linked.unionByName(same).select("x", "y"))
    named = components(confirmed(asked))

    # The rest: all candidates that the nearest have not joined, of all texts of a fingerprint; what a spanning forest joins first.
    known = asked.select(F.col("x").alias("_x"), F.col("y").alias("_y"))
    drawn = firsts.select(F.col("fp").alias("_fp"), F.when(F.col("one"), F.col("size")).otherwise(0).alias("size"), "bits")
    for spanning in (True, False):
        group = named.select(F.from_json("node", KEY).alias("n"), F.from_json("root", KEY).alias("root"))
        rooted = materialized(marked.select("t1", "t2", "fp").join(group, (F.col("t1") == F.col("n.t1")) & (F.col("t2") == F.col("n.t2")), "left").select(
            "fp", F.struct("t1", "t2").alias("x"), F.coalesce("root", F.struct("t1", "t2")).alias("root")))
        # A fingerprint of one group is named by it; one of several is like no other.
        roots = materialized(rooted.groupBy("fp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")))
        name = F.concat(*[F.unhex(F.lpad(F.hex(f"lo.{t}"), 16, "0")) for t in ("t1", "t2")])
        labels = roots.select("fp", F.when(F.col("lo") == F.col("hi"), name).otherwise(F.col("fp")).alias("label"))
        labels = labels.join(drawn, F.col("fp") == F.col("_fp")).drop("_fp")
        several = roots.filter("lo <> hi").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
        pairs = others(links, found, labels, radius, similarity, spanning).unionByName(several)
        one, two = (rooted.select(F.col("fp").alias(f"_{c}"), F.col("x").alias(c), F.col("root").alias(f"root_{c}")) for c in ("x", "y"))
        apart = pairs.join(one, F.col("a") == F.col("_x")).select("a", "b", "x", "root_x").join(two, F.col("b") == F.col("_y")).filter(
            (F.col("root_x") != F.col("root_y")) & ((F.col("a") != F.col("b")) | (F.col("x") > F.col("y"))))
        rest = materialized(apart.select("x", "y").join(known, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left_anti"))
        if rest.isEmpty():
            continue
        named = components(confirmed(rest).unionByName(named.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        known = known.unionByName(rest.select(F.col("x").alias("_x"), F.col("y").alias("_y")))
    return named.unionByName(named.select(F.col("root").alias("node"), "root").distinct()).select(
        F.from_json("node", KEY).alias("n"), F.col("root").alias("group")).select("n.t1", "n.t2", "group")


def maybe_among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: false only if no row of ``keys`` has its ``t1``.

    Each key marks one of ``SLOTS`` slots. The broadcast has a row for 64 of them, so its size is bounded; with very many keys more
    rows are let through, none is lost.
    """
    slot = F.col("t1").bitwiseAND(F.lit(SLOTS - 1).cast("bigint"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    words = keys.select(F.shiftright(slot, 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_marks"))
    met = rows.join(F.broadcast(words), F.shiftright(slot, 6) == F.col("_word"), "left")
    return met.withColumn("_maybe", F.coalesce(F.col("_marks").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_marks")


def hash_of(text) -> list:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def one_per_group(docs: DataFrame, similarity: float = JACCARD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that are not a near copy of another: of each group the text with
    the smallest doc_id stays, with all its rows and columns.

    Groups are those of ``groups``. Null ids are larger than any other; among texts without any id the smaller hash
    stays. Repeated rows and equal texts stay or go together. An empty table gives an empty table.
    """
    text = text_or_empty("text")
    grouped = materialized(groups(docs.select("doc_id", "text"), similarity, recall).withColumnsRenamed({"t1": "_t1", "t2": "_t2"}))
    ids = docs.select("doc_id", *hash_of(text)).join(grouped, (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), "t1", "t2"))
    kept = ids.groupBy("group").agg(best.alias("k")).select(F.col("group").alias("_group"), "k")
    gone = materialized(grouped.join(kept, F.col("group") == F.col("_group")).filter(
        (F.col("_t1") != F.col("k.t1")) | (F.col("_t2") != F.col("k.t2"))).select("_t1", "_t2"))
    rows = docs.select(F.struct("*").alias("_row"), *hash_of(text))
    # Most rows are no copies and take no part in the shuffle.
    rows = maybe_among(rows, gone.select(F.col("_t1").alias("t1")))
    left = rows.filter("_maybe").join(gone, (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left_anti")
    return rows.filter("NOT _maybe").unionByName(left).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
