"""Packing documents into sequences of fixed length by exact complements, then best fit.

The plan needs the number of pieces of each length only, at most ``capacity`` numbers. It is a
list of patterns (lengths that share a sequence) with how often each is used; each step uses
up a length or a gap, so the list is bounded by the capacity, whatever the number of documents.
Pieces are numbered within their length by Spark and find their pattern by that number.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.llm.common import width
from dwellkit.session import materialized

CAPACITY = 2048
CACHE_WORDS = 400_000


# ------------------------------------------------------------------ tokens

class Encoder:
    """Ids of a text as packed little-endian numbers, by the tokenizer file at ``path``.

    The tokenizer never joins characters across white space, so texts are split at spaces and
    line ends and the ids of each piece are kept; the memory of kept pieces is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kept = _Kept(self)

    def fresh(self, piece: str) -> bytes:
        """Ids of a piece without white space that is not kept yet."""
        # One trailing stop or comma after letters is a token of its own, and letters are
        # lower-cased one by one up to U+024F; other pieces go through the tokenizer as they are.
        if piece.isalpha():
            if max(piece) < "ɐ" and unicodedata.is_normalized("NFC", piece):
                low = piece.lower()
                if low != piece:
                    return self.kept[low]
                if low.isascii() or low.isalpha():
                    word = low if low.isascii() else self.bytes_of.pre_tokenize_str(low)[0][0]
                    return _packed([t.id for t in self.tokenizer.model.tokenize(word)])
        elif piece[-1:] in (".", ",") and piece[:-1].isalpha():
            return self.kept[piece[:-1]] + self.kept[piece[-1]]
        return _packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        if len(self.kept) > CACHE_WORDS:
            self.kept.clear()
        return b"".join(map(self.kept.__getitem__, text.replace("\n", " ").split(" ")))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Kept(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.encoder.fresh(piece) if piece else b""
        return ids


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc, piece, start, length, ids_crc32[, ids]) of every row; null text is empty.

    A document is its ids and ``end_id``; only longer ones than ``capacity`` are cut, into pieces of that
    length, of which the last may be shorter. An empty text is one piece with the end id.
    """
    schema = "doc string, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    step = 4 * capacity
    tail = struct.pack("<I", end_id)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc"], pdf["text"]):
                packed = encoder.ids(text) + tail
                for n, at in enumerate(range(0, len(packed), step)):
                    part = packed[at:at + step]
                    out.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part), part)[:6 if with_ids else 5])
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            yield frame
    rows = docs.select(F.col(id_col).cast("string").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Ids pass as text, which keeps nulls and large numbers whole.
    return rows.mapInPandas(cut, schema).withColumn("doc", F.col("doc").cast("bigint"))


# ------------------------------------------------------------------ plan

def _complement(left: np.ndarray, gap: int, most: int = 3) -> tuple[int, ...] | None:
    """Up to ``most`` (three) available lengths that add up to ``gap``, larger ones first; None if there are none."""
    if gap <= 0:
        return ()
    if left[gap]:
        return (gap,)
    if most < 2:
        return None
    there = np.flatnonzero(left[:gap] > 0)

    def pair(total: int, spare: int = 0) -> tuple[int, int] | None:
        # The whole index of pair sums at once: a and total - a, with one ``spare`` spoken for.
        a = there[(there * 2 >= total) & (there < total)]
        b = total - a
        good = (left[a] > (a == b) * 1 + (a == spare)) & (left[b] > (a == b) * 1 + (b == spare))
        hit = np.flatnonzero(good)
        return (int(a[hit[-1]]), int(b[hit[-1]])) if len(hit) else None
    two = pair(gap)
    if two or most < 3:
        return two
    for c in there[(there * 3 >= gap) & (there < gap - 1)][::-1].tolist():
        two = pair(gap - c, spare=c)
        if two:
            return (c, *two)
    return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences use each; ``counts[l]`` pieces of length l are all placed.

    Complements of more lengths use up small pieces that best fit may need later, so plans with
    up to three, two, one and no lengths in a complement are made, and the shortest is taken.
    """
    plans = [_plan(counts, capacity, most) for most in (3, 2, 1, 0)]
    return min(plans, key=lambda p: sum(n for _, n in p))


def _plan(counts: np.ndarray, capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan with complements of up to ``most`` lengths.

    First single lengths, then pairs, then triples: each length, largest first, is the
    anchor of its sequences, and a combination that fills its gap exactly is used as often as it
    lasts. What is left goes by best fit, large lengths first.
    """
    left = np.zeros(capacity + 1, np.int64)
    left[:len(counts)] = counts
    out: list[tuple[tuple[int, ...], int]] = []
    for size in range(1, most + 1):
        for anchor in range(capacity, 0, -1):
            while left[anchor]:
                left[anchor] -= 1
                mates = _complement(left, capacity - anchor, size)
                left[anchor] += 1
                if mates is None:
                    break
                pattern = (anchor, *mates)
                lengths, uses = np.unique(pattern, return_counts=True)
                times = int((left[lengths] // uses).min())
                left[lengths] -= times * uses
                out.append((pattern, times))
    rest = left
    # Best fit over classes of equal sequences: gap -> {pattern: number}.
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for length in range(capacity, 0, -1):
        n = int(rest[length])
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                # New sequences hold the length as often as it fits.
                each = min(capacity // length, n)
                pattern, times = (length,) * each, n // each
            else:
                base, there = next(iter(open_[gap].items()))
                each = min(gap // length, n)
                pattern, times = base + (length,) * each, min(there, n // each)
                open_[gap][base] -= times
                if not open_[gap][base]:
                    del open_[gap][base]
                if not open_[gap]:
                    del open_[gap]
            n -= times * each
            still = capacity - sum(pattern)
            if still:
                group = open_.setdefault(still, {})
                group[pattern] = group.get(pattern, 0) + times
            else:
                out.append((pattern, times))
    return out + [(p, n) for group in open_.values() for p, n in group.items()]


def _index(patterns: list[tuple[tuple[int, ...], int]], counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Arrays that map the k-th piece of a length to (sequence, offset), sorted by (length, first k)."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in patterns:
        at = 0
        for length in pattern:
            k = used.get(length, 0)
            rows.append((length, k, base, at))
            used[length] = k + times
            at += length
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    starts = np.searchsorted(table[:, 0], np.arange(len(counts) + 1))
    return table[:, 1], table[:, 2], table[:, 3], starts


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc, piece, start, length, ...).

    Every piece gets a place, repeated rows each their own; in a sequence places follow each other without a
    gap from 0. A length that a third of all pieces share is numbered in slices by hash.
    """
    slices = 4 * width(cut)
    rows = cut.withColumn("_slice", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    cells = rows.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    cells = materialized(cells)
    sizes = cells.groupBy("length").agg(F.sum("_n").alias("n")).toPandas()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    counts[sizes["length"].to_numpy(np.int64)] = sizes["n"].to_numpy(np.int64)
    first, base, place, starts = _index(plan(counts, capacity), counts)
    earlier = W.partitionBy("length").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = cells.select(F.col("length").alias("_l"), F.col("_slice").alias("_s"),
                          F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("length", "_slice").orderBy("doc", "piece", "ids_crc32")
    ranked = (rows.withColumn("_in", F.row_number().over(inside) - 1)
              .join(before, (F.col("length") == F.col("_l")) & (F.col("_slice") == F.col("_s")))
              .withColumn("_k", F.col("_before") + F.col("_in")))

    @F.pandas_udf("sequence_id long, offset long")
    def locate(length: pd.Series, k: pd.Series) -> pd.DataFrame:
        ls, ks = length.to_numpy(np.int64), k.to_numpy(np.int64)
        seq, off = np.empty(len(ls), np.int64), np.empty(len(ls), np.int64)
        for one in np.unique(ls).tolist():
            at = np.flatnonzero(ls == one)
            lo, hi = starts[one], starts[one + 1]
            row = lo + np.searchsorted(first[lo:hi], ks[at], side="right") - 1
            seq[at], off[at] = base[row] + ks[at] - first[row], place[row]
        return pd.DataFrame({"sequence_id": seq, "offset": off})
    return ranked.select(*cut.columns, locate("length", "_k").alias("_at")).select(*cut.columns, "_at.*")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """Cut and pack; the cut pieces (numbers, not texts) are written once, as counting and placing read them."""
    return pack(materialized(pieces(docs, path, capacity, **options)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed ids of each sequence, from pieces made ``with_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` ids
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
