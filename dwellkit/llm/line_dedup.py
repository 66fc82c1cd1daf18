"""Line dedup with a sharded minimal perfect hash.

Every distinct line key is hashed to 128 bits and belongs to one shard. A shard's hashes form a
minimal perfect hash: levels of bit arrays, in which a key that meets no other key owns its bit and
the rest go one level down; the number of set bits before it is the key's place. At that
place stand a compact fingerprint, the number of documents with the line and the largest
of their identifiers. Documents send their hashes to the shards and probe these arrays in a stream;
lines and texts never meet lines of other documents in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellkit.llm.common import hot_keys, text_or_empty, width
from dwellkit.session import materialized

#: White space that is stripped from the ends of a line.
BLANK = " \t\n\x0b\x0c\r"
#: Distinct lines in a shard, about 20 bytes each.
SHARD_KEYS = 1 << 19
#: Bits of a level for each key that is left.
ROOM = 2
#: Counts stand in 32 bits; a larger one stays at the largest.
MOST = (1 << 32) - 1
INDEX = "shard int, shards int, sizes array<int>, bits binary, prints binary, counts binary, last binary, named binary"


def line_key(line: str, min_chars: int) -> bytes | None:
    """The line without white space at its ends and with A-Z lower-cased; None below ``min_chars`` code points."""
    line = line.strip(BLANK)
    return line.encode("utf-8", "surrogatepass").lower() if len(line) >= min_chars else None


def _hashes(keys) -> np.ndarray:
    """Two unsigned longs for each key, 128 bits in all."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(k) for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)


def _mix(h: np.ndarray, g: np.ndarray, level: int) -> np.ndarray:
    """One long from both halves, another one for every level."""
    x = h ^ (g * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xD6E8FEB86659FD93)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


class MinimalHash:
    """Distinct pairs of longs to 0 .. n - 1 without gaps; other pairs go to any place or to -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    @classmethod
    def of(cls, h: np.ndarray, g: np.ndarray) -> MinimalHash:
        sizes, arrays = [], []
        while len(h):
            size = 64 * math.ceil(ROOM * len(h) / 64)
            at = (_mix(h, g, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            arrays.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = ~alone[at]
            h, g = h[left], g[left]
        return cls(sizes, np.concatenate(arrays) if arrays else np.zeros(0, np.uint64))

    def places(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        left, base = np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = (_mix(h[left], g[left], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            owned = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[owned]] = (self.before[at >> 6] + np.bitwise_count(below))[owned]
            left, base = left[~owned], base + size
            if not len(left):
                break
        return out


def _print(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    return (_mix(g, h, 63) >> np.uint64(32)).astype(np.uint32)


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """(row_no, own, t1, t2, h, g) for each row with a long line: identifier, hash of the text, hashes of its keys.

    Each key counts once. ``row_no`` only spreads rows; write the table before it is used.
    """
    @F.arrow_udf("struct<h: array<bigint>, g: array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        ends, parts = [0], []
        for text in texts:
            keys = {line_key(line, min_chars) for line in (text.as_py() or "").split("\n")} - {None}
            parts.append(_hashes(keys))
            ends.append(ends[-1] + len(keys))
        both = np.concatenate(parts).view(np.int64) if parts else np.zeros((0, 2), np.int64)
        ends = pa.array(ends, pa.int32())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(both[:, i]))) for i in (0, 1)], names=["h", "g"])
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("own"), *_text_hash(text), of(text).alias("_k"))
    return rows.select(F.monotonically_increasing_id().alias("row_no"), "own", "t1", "t2", "_k.h", "_k.g").filter(
        F.size("h") > 0)


def _text_hash(text) -> list:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _one_by_one(hashed: DataFrame, *more: str) -> DataFrame:
    return hashed.select(*more, F.explode(F.arrays_zip("h", "g")).alias("_k")).select(*more, "_k.h", "_k.g")


def build_index(hashed: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per shard of the distinct hashes of ``hashed``, with the columns of INDEX. No hashes, no rows."""
    n = hashed.agg(F.sum(F.size("h")).alias("n")).first()["n"] or 0
    # Several shards a part, or most of them would be copied to more parts than one.
    shards = max(1, -(-n // shard_keys), min(n, 4 * width(hashed)))
    counted = _one_by_one(hashed, "own").groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("last"))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        h, g = (table[c].to_numpy().view(np.uint64) for c in ("h", "g"))
        found = MinimalHash.of(h, g)
        order = np.argsort(found.places(h, g))
        last = table["last"].combine_chunks()
        named = last.is_valid().to_numpy(zero_copy_only=False)[order]
        row = (key[0].as_py(), shards, found.sizes, found.bits.tobytes(), _print(h, g)[order].tobytes(),
               np.minimum(table["n"].to_numpy(), MOST).astype(np.uint32)[order].tobytes(),
               last.fill_null(0).to_numpy(zero_copy_only=False)[order].tobytes(), named.tobytes())
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), *[pa.binary()] * 5]
        return pa.table([pa.array([value], kind) for value, kind in zip(row, kinds)],
                        names=["shard", "shards", "sizes", "bits", "prints", "counts", "last", "named"])
    return counted.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, INDEX)


def _shard(shards: int):
    return F.pmod("h", F.lit(shards)).cast("int")


def repeated_lines(hashed: DataFrame, index: DataFrame, min_docs: int = 5) -> DataFrame:
    """(row_no, h, g) of the lines that at least ``min_docs`` documents of the index hold and that
    do not stay in this document: another identifier is the largest.

    Shards come first in their part and stay in memory, hashes stream past. A shard that a hot
    line makes large is copied to several parts.
    """
    spark, empty = hashed.sparkSession, {"row_no": "bigint", "own": "bigint", "h": "bigint", "g": "bigint"}
    shards = index.agg(F.max("shards").alias("n")).first()["n"]
    if shards is None:
        return spark.createDataFrame([], "row_no bigint, h bigint, g bigint")
    parts = width(hashed)
    sent = _one_by_one(hashed, "row_no", "own").withColumn("shard", _shard(shards))
    asked = materialized(sent.groupBy("shard").agg(F.count(F.lit(1)).alias("n")))
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # Fewer than HOT_SHARE * parts shards are hot, so they fit a broadcast.
    hot = F.broadcast(hot_keys(asked, "n", parts, F.lit(total)).select(
        F.col("shard").alias("_s"), F.ceil(F.col("n") / F.col("limit")).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    arrays = [c for c in index.columns if c not in ("shard", "shards")]
    tables = index.join(hot, F.col("shard") == F.col("_s"), "left").select(
        "shard", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()],
        *arrays)
    probes = sent.join(hot, F.col("shard") == F.col("_s"), "left").select(
        "shard", F.pmod("row_no", copies).cast("int").alias("copy"), *empty,
        *[F.lit(None).cast(index.schema[c].dataType).alias(c) for c in arrays])
    met = tables.unionByName(probes).repartition(parts, "shard", "copy").sortWithinPartitions(
        "shard", "copy", F.col("bits").isNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, arrays_at = None, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            shard = rows["shard"].to_numpy()
            starts = rows["bits"].is_valid().to_numpy()
            # A shard begins with its arrays, if it has any, and its other rows probe them.
            cuts = [0, *(np.flatnonzero(starts[1:] | (shard[1:] != shard[:-1])) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi and starts[lo]:
                    one = rows.slice(lo, 1).to_pylist()[0]
                    at, arrays_at = one["shard"], _Arrays(one)
                    lo += 1
                if lo < hi and shard[lo] == at:
                    yield from _staying(arrays_at, rows.slice(lo, hi - lo), min_docs)
    return met.mapInArrow(probe, "row_no bigint, h bigint, g bigint")


class _Arrays:
    """A shard's arrays."""

    def __init__(self, row: dict):
        self.hash = MinimalHash(row["sizes"], np.frombuffer(row["bits"], np.uint64))
        self.prints = np.frombuffer(row["prints"], np.uint32)
        self.counts = np.frombuffer(row["counts"], np.uint32)
        self.last = np.frombuffer(row["last"], np.int64)
        self.named = np.frombuffer(row["named"], np.bool_)


def _staying(arrays: _Arrays, rows: pa.Table, min_docs: int) -> list[pa.RecordBatch]:
    h, g = (rows[c].to_numpy().view(np.uint64) for c in ("h", "g"))
    place = arrays.hash.places(h, g)
    known = (place >= 0) & (arrays.prints[place] == _print(h, g)) & (arrays.counts[place] >= min(min_docs, MOST))
    own = rows["own"].combine_chunks()
    has = own.is_valid().to_numpy(zero_copy_only=False)
    named = arrays.named[place]
    largest = np.where(named, has & (own.fill_null(0).to_numpy(zero_copy_only=False) == arrays.last[place]), ~has)
    return rows.filter(pa.array(known & ~largest)).select(["row_no", "h", "g"]).to_batches()


def drop_repeated_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id",
                        text_col: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The columns of ``docs`` as one struct ``row``, and n_lines, n_dropped and the text that is left, ``kept``.

    Lines end at \\n alone. A line's key is the line without ASCII white space at its ends and with
    A-Z lower-cased. Keys of ``min_chars`` code points or more that stand in ``min_docs`` rows or more lose
    all their lines, but for the lines of the row with the largest identifier among them. Rows
    that repeat this identifier all keep the line. A null identifier is smaller than any other; where all
    rows with a line have none, all keep it. Null and empty texts are one empty line and give an empty
    text. A row that repeats identifier and text of another counts as one more document and
    gets the same result. An empty table gives an empty table. Other columns, whatever their
    names, pass in ``row``.
    """
    hashed = materialized(hashed_lines(docs, id_col, text_col, min_chars))
    index = materialized(build_index(hashed, shard_keys))
    lists = repeated_lines(hashed, index, min_docs).groupBy("row_no").agg(
        F.collect_list(F.struct("h", "g")).alias("gone")).withColumnRenamed("row_no", "_row_no")
    # Rows that repeat identifier and text have the same list.
    gone = hashed.join(lists, F.col("row_no") == F.col("_row_no")).groupBy("own", "t1", "t2").agg(
        F.first("gone").alias("gone")).select(F.col("own").alias("_own"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "gone")

    @F.arrow_udf("struct<n: bigint, kept: string>")
    def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for text, pairs in zip(texts, gone):
            if not pairs.is_valid:
                out.append(None)
                continue
            drop = {(p["h"], p["g"]) for p in pairs.as_py()}
            lines = (text.as_py() or "").split("\n")
            keys = [line_key(line, min_chars) for line in lines]
            long = [i for i, k in enumerate(keys) if k is not None]
            hit = {i for i, pair in zip(long, _hashes([keys[i] for i in long]).view(np.int64).tolist()) if tuple(pair) in drop}
            out.append({"n": len(hit), "kept": "\n".join(line for i, line in enumerate(lines) if i not in hit)})
        return pa.array(out, pa.struct([("n", pa.int64()), ("kept", pa.string())]))
    text = text_or_empty(text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("own"), *_text_hash(text))
    met = rows.join(gone, F.col("own").eqNullSafe(F.col("_own")) & (F.col("t1") == F.col("_t1"))
                    & (F.col("t2") == F.col("_t2")), "left").withColumn(
                        "text", F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")))
    # Texts that lose nothing stay in the JVM.
    cut = met.withColumn("_cut", without(F.when(F.col("gone").isNotNull(), F.col("text")), F.col("gone")))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return cut.select("row", n_lines.cast("bigint").alias("n_lines"), F.coalesce("_cut.n", F.lit(0)).alias("n_dropped"),
                      F.coalesce("_cut.kept", "text").alias("kept"))
