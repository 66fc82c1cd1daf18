"""SimHash near-duplicates with BK-trees.

A fingerprint holds the majority bit of the XXH64 hashes of a text's word shingles.
Documents with one fingerprint are one node. Two nodes link when at most ``radius`` bits differ.

With 64 bits in four blocks of 16, a link of radius 2 leaves two blocks untouched, so nodes
are dealt to shards by each pair of blocks, and every link lies inside a shard. A shard's
nodes form a BK-tree: a child hangs at the integer Hamming distance to its parent, and a
search follows only the edges within the radius. A shard beyond ``leaf`` nodes is dealt again by
pairs of quarters of its remaining bits (16 more, then 8 more), after which at most 256
different fingerprints can be left, so no task ever holds a large shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellkit.llm.common import text_or_empty, width
from dwellkit.session import materialized

BITS = 64
LEAF = 512
SEED = 42
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash: ASCII-lower-cased words between ASCII white space, in runs of ``shingle``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    ones = np.zeros(BITS, np.int64)
    # Long texts go by in slices, so memory follows a slice.
    for at in range(0, n, 1 << 15):
        upto = min(n, at + (1 << 15))
        hashes = np.array([digest(line[a:b], SEED) for a, b in
                           zip(starts[at:upto].tolist(), ends[at + k - 1:upto + k - 1].tolist())], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp): a hash of the text and the fingerprint of every row, as a signed long with the same bits."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("h"),
                       of(F.col(text_col).cast("string")).alias("fp"))


class BkTree:
    """Integers under Hamming distance; ``link`` inserts one and reports what lies within the radius."""

    def __init__(self, radius: int):
        self.radius, self.root, self.children = radius, None, {}

    def link(self, value: int) -> list[int]:
        if self.root is None:
            self.root, self.children[value] = value, {}
            return []
        near, todo, radius = [], [self.root], self.radius
        while todo:
            node = todo.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                near.append(node)
            edges = self.children[node]
            if len(edges) <= 2 * radius + 1:
                todo.extend(child for e, child in edges.items() if d - radius <= e <= d + radius)
            else:
                todo.extend(edges[e] for e in range(d - radius, d + radius + 1) if e in edges)
        at = self.root
        while True:
            edges = self.children[at]
            d = (at ^ value).bit_count()
            if d not in edges:
                edges[d] = value
                self.children[value] = {}
                return near
            at = edges[d]


def _shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the shard's links: fewer edges than nodes, whatever their number."""
    parent = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    tree = BkTree(radius)
    edges = []
    for v in values:
        parent[v] = v
        for other in tree.link(v):
            a, b = root(v), root(other)
            if a != b:
                parent[a] = b
                edges.append((v, other))
    return edges


def _deal(nodes: DataFrame, order: str, block_bits: int) -> DataFrame:
    """One row per node and pair of blocks: the pair, both block values, and the bits that are left.

    ``order`` names a column with the free bits, four blocks of ``block_bits``.
    """
    mask = (1 << block_bits) - 1

    def block(i):
        return F.shiftrightunsigned(F.col(order), i * block_bits).bitwiseAND(F.lit(mask))
    rows = []
    for n, (i, j) in enumerate(PAIRS):
        others = [x for x in range(4) if x not in (i, j)]
        rows.append(F.struct(
            F.lit(n).alias("pair"),
            F.shiftleft(block(i), block_bits).bitwiseOR(block(j)).alias("key"),
            F.shiftleft(block(others[0]), block_bits).bitwiseOR(block(others[1])).alias("free")))
    return nodes.withColumn("_d", F.explode(F.array(*rows)))


def links(nodes: DataFrame, radius: int = 2, leaf: int = LEAF) -> DataFrame:
    """(a, b): links that connect all fingerprints ``fp`` of ``nodes`` (distinct) within ``radius`` bits.

    Not every link is listed, but the same fingerprints are connected: each shard gives a
    spanning forest. Exact for radius 0 to 2.
    """
    if not 0 <= radius <= 2:
        raise ValueError("four blocks are exact up to radius 2")
    parts = width(nodes)
    level = _deal(nodes.select("fp"), "fp", 16).select(
        "fp", F.concat_ws("/", "_d.pair", "_d.key").alias("shard"), F.col("_d.free").alias("free"))
    ready = []
    for bits in (8, 4, None):
        level = materialized(level)
        sizes = level.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        if bits is None:
            ready.append(level.join(sizes.select("shard"), "shard").select("shard", "fp"))
            break
        # Of the shards with company, the large ones are dealt again by what is left of their bits.
        marked = materialized(level.join(sizes, "shard").withColumn("_large", F.col("_n") > leaf))
        ready.append(marked.filter(~F.col("_large")).select("shard", "fp"))
        level = _deal(marked.filter("_large").select("fp", "shard", "free"), "free", bits).select(
            "fp", F.concat_ws("/", "shard", "_d.pair", "_d.key").alias("shard"), F.col("_d.free").alias("free"))
    shards = ready[0]
    for more in ready[1:]:
        shards = shards.unionByName(more)
    dealt = shards.repartition(parts, "shard").sortWithinPartitions("shard", "fp")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[int] = []
        at = None
        for pdf in batches:
            edges = []
            keys, fps = pdf["shard"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
            if len(keys) == 0:
                continue
            cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
                if keys[lo] != at:
                    edges += _shard_links(rest, radius)
                    rest, at = [], keys[lo]
                rest += fps[lo:hi].tolist()
            yield _edge_frame(edges)
        yield _edge_frame(_shard_links(rest, radius))
    return dealt.mapInPandas(search, "a long, b long").distinct()


def _edge_frame(edges: list[tuple[int, int]]) -> pd.DataFrame:
    pairs = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes that have an edge.

    Alternates two steps, each a grouping with map-side minimum and a join on the node:
    larger neighbours move to the smallest neighbour, then smaller ones do. Stars are left
    after a logarithmic number of rounds; each round is written to the shared folder.
    """
    now = materialized(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        # Larger neighbours point at the smallest of the neighbourhood ...
        large = (both.join(low, F.col("u") == F.col("_u")).filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # ... then every node's smaller neighbours do.
        large = materialized(large)
        small = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        now = materialized(large.join(small, F.col("u") == F.col("_u"))
                           .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                           .unionByName(small.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct())
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (state["n"], state["h"])
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, h, fp, component_id) for every row; ``component_id`` is the smallest id that links reach.

    Null and empty texts, and texts of white space, have fingerprint 0 and link like any
    other; a text of fewer words than a shingle is one shingle. Rows that repeat an id each
    give a row. Null ids are never smallest; a component without any id has a null id. An
    empty table gives an empty table.
    """
    marked = materialized(fingerprints(docs, shingle, id_col, text_col))
    nodes = materialized(marked.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = materialized(components(links(nodes, radius)))
    grouped = nodes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "_root")
    named = materialized(grouped.join(smallest, F.col("root") == F.col("_root")).select(
        F.col("fp").alias("_fp"), "component_id"))
    return marked.join(named, F.col("fp") == F.col("_fp")).select("id", "h", "fp", "component_id")


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their group, with their columns.

    Rows that share that doc_id all stay, as do those without one in a group that has none.
    """
    decided = near_duplicates(docs.select("doc_id", "text"), **options)
    dropped = decided.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select(
        F.col("id").alias("_id"), F.col("h").alias("_h")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(text_or_empty()).alias("_text_hash"))
    kept = rows.join(dropped, (F.col("_text_hash") == F.col("_h")) & F.col("_row.doc_id").eqNullSafe(F.col("_id")), "left_anti")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
