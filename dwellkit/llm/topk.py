"""Exact top-k inner products with a bit-sliced index.

Rows stand in blocks. Of each component the block keeps one bitmap per bit. A query adds the
bitmaps of all components, weighted by its own bits, into bitmaps of the score: full adders
take three bitmaps of one weight to one of that weight and one of the next. The best rows are
selected from the most significant score bitmap downward; rows on the boundary, and the
order of the selected ones, are resolved by exact integer products.
"""

from __future__ import annotations

import math
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.llm.common import width
from dwellkit.session import materialized

#: Components in a block, and queries that meet a block at once: these bound a task's memory.
BLOCK_VALUES = 1 << 22
QUERY_ROWS = 4096
#: Quantised components within this are sliced in longs: products of up to 2,048 of them fit one. Larger ones take Python integers.
LIMIT, LONG_DIMS = 1 << 26, 1 << 11


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, big): floor(scale * x) of each component as longs; of ``big`` rows, with a component beyond
    2 ** 26, as decimal numerals of any length.

    Left out are null vectors and ids, empty vectors, and vectors with a component that is null or not finite.
    """
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).select(
        F.col(id_col).cast("bigint").alias("id"), vector.alias("x"),
        F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))).alias("fine"),
        (~F.forall(vector, lambda x: F.abs(F.lit(scale) * x) < LIMIT)).alias("big"))
    small = F.transform("x", lambda x: F.floor(F.lit(scale) * x)).cast("array<bigint>")
    # Null for all but the big rows, so that no other vector goes to Python here.
    return rows.filter("fine").select("id", "big", F.when(~F.col("big"), small).alias("v"),
                                      floors(scale)(F.when(F.col("big"), F.col("x"))).alias("numerals"), F.size("x").alias("dim"))


def floors(scale: int):
    """floor(scale * x) of each double as decimal numerals, exact for every finite x."""
    @F.pandas_udf("array<string>")
    def of(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else [str(math.floor(Fraction(float(x)) * scale)) for x in v] for v in vectors], dtype=object)
    return of


def integers(v, numerals) -> np.ndarray:
    """A row's components, as longs or as Python integers where they are big."""
    return np.asarray(v, np.int64) if numerals is None else np.array([int(x) for x in numerals], object)


class SlicedBlock:
    """Bitmaps of a block's components: row r is bit r % 64 of word r // 64."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.rows, self.dims = self.values.shape
        self.words = -(-self.rows // 64)
        self.low = self.values.min(0)
        spread = self.values - self.low
        self.bits = [int(x).bit_length() for x in spread.max(0)]
        self.slices = [[self._bitmap((spread[:, d] >> b) & 1) for b in range(self.bits[d])]
                       for d in range(self.dims)]
        self.inverse = [[~bitmap for bitmap in of] for of in self.slices]
        self.there = self._bitmap(np.ones(self.rows, np.uint64))

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        return np.pad(packed, (0, self.words * 8 - len(packed))).view(np.uint64)

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the score plus a constant, least significant first.

        A negative factor takes the complement of a component's bitmaps, which changes the score by a constant.
        """
        levels: dict[int, list[np.ndarray]] = {}
        for d, factor in enumerate(query.tolist()):
            size, shift = abs(factor), 0
            while size:
                if size & 1:
                    for b, bitmap in enumerate(self.slices[d] if factor > 0 else self.inverse[d]):
                        levels.setdefault(shift + b, []).append(bitmap)
                size >>= 1
                shift += 1
        out, level = [], 0
        while levels:
            column = levels.pop(level, [])
            carry = levels.setdefault(level + 1, []) if len(column) > 1 else None
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.append(half ^ c)
                carry.append((half & c) | (a & b))
            if len(column) == 2:
                a, b = column
                carry.append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            level += 1
        return out

    def top(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but ``own``: larger scores first, ties to smaller ids."""
        open_ = self.there.copy()
        for at in range(int(np.searchsorted(self.ids, own)), int(np.searchsorted(self.ids, own, side="right"))):
            open_[at // 64] &= ~np.uint64(1 << (at % 64))
        sure, n_sure = np.zeros(self.words, np.uint64), 0
        for bitmap in reversed(self.scores(query)):
            upper = open_ & bitmap
            n = int(np.bitwise_count(upper).sum())
            if n_sure + n > k:
                open_ = upper
            else:
                sure |= upper
                n_sure += n
                open_ &= ~bitmap
                if n_sure == k:
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if n_sure < k:
            # The open rows tie; they stand in the order of their ids.
            ties = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))[:k - n_sure]
            rows = np.concatenate((rows, ties))
        long = self.dims <= LONG_DIMS and query.dtype != object and self.values.dtype != object
        exact = self.values[rows] @ query if long else self.values[rows].astype(object) @ query.astype(object)
        best = [(int(self.ids[r]), int(score)) for r, score in zip(rows, exact)]
        return sorted(best, key=lambda row: (-row[1], row[0]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vector_col: str = "embedding", block_values: int = BLOCK_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k best rows of ``vectors``.

    The score is the inner product of the quantised vectors; ties go to the smaller id. Rows
    with the query's own id are no candidates, nor are vectors of another length. A query with
    fewer candidates gets all of them. Repeated candidates each take a rank, a repeated query
    (same id and vector) counts once. See ``quantised`` for the rows that take no part; an empty table
    gives an empty result, other columns are not read. A returned score beyond a long is an error.
    """
    rows = materialized(quantised(vectors, id_col, vector_col, scale))
    asked = materialized(quantised(queries, id_col, vector_col, scale).distinct())
    # One entry per vector length.
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {d: -(-n * d // block_values) for d, n in sizes.items()}
    if not blocks:
        blocks = {0: 1}
    parts = max(-(-width(vectors) // sum(blocks.values())), -(-asked.count() // QUERY_ROWS), 1)
    of_dim = F.create_map(*[F.lit(x) for d, n in blocks.items() for x in (d, n)])
    n_blocks = F.coalesce(of_dim[F.col("dim")], F.lit(1))
    # Big rows have blocks of their own. Rows are dealt one by one, so that an id on many rows fills no block.
    dealt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), n_blocks).cast("int")
    left = rows.select(
        "dim", "big", dealt.alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", F.col("v").cast("array<int>").alias("v"), "numerals")
    kinds = F.array(*[F.lit(r["big"]) for r in rows.select("big").distinct().collect()]).cast("array<boolean>")
    right = asked.select(
        "dim", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"),
        F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int").alias("part"), "id", F.col("v").cast("array<int>").alias("v"), "numerals")
    right = right.withColumn("big", F.explode(kinds))

    def search(block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(some):
            index = SlicedBlock(block["id"].to_numpy(np.int64), np.stack([integers(*r) for r in zip(block["v"], block["numerals"])]))
            for own, v, numerals in zip(some["id"].tolist(), some["v"], some["numerals"]):
                query = integers(v, numerals)
                key = zlib.crc32(query.tobytes() if numerals is None else ",".join(numerals).encode())
                out += [(own, key, vec, score) for vec, score in index.top(own, query, k)]
        return pd.DataFrame(out, columns=["query_id", "key", "vec_id", "score"])
    keys = ("dim", "big", "block", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        search, "query_id long, key long, vec_id long, score long")
    best = W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
