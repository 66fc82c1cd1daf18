"""Grouped splits and subsamples in a reproducible hash order.

A group is ordered by md5(seed:group). The leading hash digits cut that order into even ranges,
so quotas and fold positions come from running sums and never from one sorted task.

Where many draws take the first groups in orders of their own, no group is copied per draw: counts in narrow
ranges around the expected place give each draw the hash at which it ends (``hash_cuts``), and a group is in a
draw when its hash is not beyond it (``draws_of``, ``mask_of``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.functions.hashing import TOGETHER, hash_hex, leading_words, md5_pairs
from dwellkit.operators.running import mark_first, running, with_hash_ranges
from dwellkit.operators.stints import mode_per_group
from dwellkit.session import materialized, shuffle_partitions


def _running_hash(df: DataFrame, group: str, sums, by=None) -> DataFrame:
    return running(with_hash_ranges(df, "_h"), "_h", sums, by, ranged=True, tie=group)


def split_stratified(df: DataFrame, group: str, label: str, fraction: float, seed: int) -> DataFrame:
    """(group, stratum, n_rows, side): per modal class, groups in hash order go to the test
    side until its row quota floor(rows of the class x fraction) is reached."""
    modes = materialized(mode_per_group(df, [group], label, "stratum").select(group, "stratum", "n_rows"))
    quota = df.groupBy(F.col(label).alias("stratum")).agg(
        F.floor(F.count(F.lit(1)) * F.lit(fraction)).alias("_quota"))
    ordered = _running_hash(modes.withColumn("_h", hash_hex(seed, F.col(group))), group, {"r": F.col("n_rows")}, ["stratum"])
    side = F.when(F.col("r_before") < F.col("_quota"), "test").otherwise("train")
    return ordered.join(quota, "stratum", "left").select(group, "stratum", "n_rows", side.alias("side"))


def split_random(df: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """(group, side): the first floor(groups x fraction) groups in hash order are the test side."""
    groups = materialized(df.select(group).distinct()).withColumn("_h", hash_hex(seed, F.col(group)))
    marked = mark_first(groups, "_h", group, lambda n: F.floor(n * F.lit(fraction)))
    return marked.select(group, F.when(F.col("picked"), "test").otherwise("train").alias("side"))


def kfold(df: DataFrame, group: str, k: int, seed: int, label: str | None = None) -> DataFrame:
    """(group, fold): contiguous blocks of the hash order, per modal class when ``label``.

    Block size is n // k (at least 1 when stratified); the last fold takes the rest.
    """
    if label is None:
        groups, by = df.select(group).distinct(), None
        size = F.floor(F.col("g_total") / k)
    else:
        groups, by = mode_per_group(df, [group], label, "stratum").select(group, "stratum"), ["stratum"]
        size = F.greatest(F.lit(1), F.floor(F.col("g_total") / k))
    groups = materialized(groups).withColumn("_h", hash_hex(seed, F.col(group)))
    ordered = _running_hash(groups, group, {"g": F.lit(1)}, by)
    fold = F.when(size > 0, F.least(F.floor(F.col("g_before") / size), F.lit(k - 1))).otherwise(k - 1)
    return ordered.select(group, *(by or []), fold.cast("int").alias("fold"))


#: A draw's end is sought within so many standard deviations of where it should be, in so many ranges.
CUT_WIDTH, CUT_BINS = 3.0, 16
#: Draws whose counts travel in one row, hashes held at a time, and keys hashed together.
DRAW_BLOCK, HASHES, KEYS = 64, 1 << 18, TOGETHER


def prefixes(seed: int, times: int) -> list[str]:
    """What stands before the group in the hash of each of ``times`` draws."""
    return [f"{seed}:{b}:" for b in range(times)]


def _chunks(batches):
    """(keys, values) of up to KEYS rows whose keys are equally long, so that they are hashed together."""
    held: dict[int, list] = {}
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            some = held.setdefault(len(key), [])
            some.append((key, value))
            if len(some) == KEYS:
                yield [k for k, _ in some], np.array([v for _, v in some])
                some.clear()
    for some in held.values():
        if some:
            yield [k for k, _ in some], np.array([v for _, v in some])


def _cut(rows: DataFrame, before: list[str], take: Callable[[int], int], weighted: bool,
         width: float | None = None) -> tuple[DataFrame | None, np.ndarray]:
    """(b, h, l, v, last): of each draw the first rows of the hash range in which it ends, up to its end; and the
    sums of the values in the ranges before. ``rows`` are (key, value), dealt to all tasks, as few small rows are much work.

    All hashes are made once. Tasks add up what lies below a window around the expected end of each draw and in the ranges of
    the window, and write the window's hashes, a few times the square root of n for each draw. A draw that ends
    outside is sought again in a wider window.
    """
    spark, draws = rows.sparkSession, len(before)
    n = rows.count()
    m = min(take(n), n)
    if m <= 0:
        return None, np.zeros(draws)
    width = CUT_WIDTH if width is None else width
    share, spread = m / n, width * math.sqrt(max(m / n * (1 - m / n), 1.0 / n) / n)
    low, high = (min(max(x, 0.0), 1.0) for x in (share - spread, share + spread))
    edges = np.array([min(int((low + (high - low) * i / CUT_BINS) * 2 ** 64), 2 ** 64 - 1) for i in range(CUT_BINS + 1)], np.uint64)
    starts, blocks = [p.encode() for p in before], range(0, draws, DRAW_BLOCK)
    bins = CUT_BINS + 1
    kinds = [pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def batch(*columns):
        names = ["block", "v", "b", "h", "l", "x"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def count(batches):
        # Below the window, then its ranges: counts and sums. The leading 32 bits decide all hashes but those near the window.
        total = np.zeros((draws, 1 + weighted, bins))
        lowest, beyond = np.uint32(edges[0] >> np.uint64(32)), np.uint32((edges[-1] >> np.uint64(32)) - (edges[0] >> np.uint64(32)))

        def near(keys, values, b, at):
            found = md5_pairs(starts, keys, b, at)
            under = found[:, 0] < edges[0]
            place = np.where(under, 0, _bin(edges, found[:, 0]))
            keep = found[:, 0] <= edges[-1]
            np.add.at(total, (b[keep], 0, place[keep]), 1)
            if weighted:
                np.add.at(total, (b[keep], 1, place[keep]), values[at[keep]])
            keep &= ~under
            found = found[keep].view(np.int64)
            return batch([None], [None], [b[keep].astype(np.int32)], [found[:, 0]], [found[:, 1]], [values[at[keep]]])
        for texts, values in _chunks(batches):
            keys, held, n_held = [k.encode() for k in texts], [], 0
            for some, at, tops in leading_words(starts, keys):
                under = tops < lowest
                total[some, 0, 0] += under.sum(1)
                if weighted:
                    total[some, 1, 0] += under @ values[at]
                j, i = np.divmod(np.flatnonzero((tops - lowest) <= beyond), len(at))
                held.append((some[j], at[i]))
                n_held += len(j)
                if n_held >= HASHES // 8:
                    yield near(keys, values, *(np.concatenate(x) for x in zip(*held)))
                    held, n_held = [], 0
            if n_held:
                yield near(keys, values, *(np.concatenate(x) for x in zip(*held)))
        none = [None] * len(blocks)
        yield batch([b // DRAW_BLOCK for b in blocks], [total[b:b + DRAW_BLOCK].ravel() for b in blocks], none, none, none, none)
    schema = "block int, v array<double>, b array<int>, h array<long>, l array<long>, x array<double>"
    written = materialized(rows.mapInArrow(count, schema))
    counted = written.filter("block IS NOT NULL").select("block", array_to_vector("v").alias("v"))
    sums = counted.groupBy("block").agg(Summarizer.sum(F.col("v")).alias("v")).collect()
    table = np.concatenate([r["v"].toArray() for r in sorted(sums, key=lambda r: r["block"])]).reshape(draws, 1 + weighted, bins)
    # Spark keeps vector sums as means, so counts come back a rounding error away from whole numbers.
    upto = np.cumsum(np.rint(table[:, 0]).astype(np.int64), axis=1)
    # The range of the end: 0 and beyond the last one are outside the window.
    at = (upto < m).sum(1)
    rank = m - upto[np.arange(draws), np.maximum(at - 1, 0)]
    wholes = np.where(np.arange(bins) < at[:, None], table[:, 1], 0.0).sum(1) if weighted else np.zeros(draws)

    def at_end(batches):
        for got in batches:
            b, h, lo, v = (got[c].flatten().to_numpy(zero_copy_only=False) for c in ("b", "h", "l", "x"))
            keep = _bin(edges, h.view(np.uint64)) == at[b]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (b, h, lo, v)], names=["b", "h", "l", "v"])
    # Signed longs in the order of the unsigned ones.
    ordered = [F.col(c).bitwiseXOR(F.lit(-(1 << 63))) for c in ("h", "l")]
    row = F.row_number().over(W.partitionBy("b").orderBy(*ordered))
    wanted = spark.createDataFrame([(b, int(r)) for b, r in enumerate(rank)], "b int, wanted int")
    found = written.filter("block IS NULL").select("b", "h", "l", "x").mapInArrow(at_end, "b int, h long, l long, v double")
    found = found.withColumn("_r", row).join(wanted, "b").filter("_r <= wanted").select(
        "b", "h", "l", "v", (F.col("_r") == F.col("wanted")).alias("last"))
    missed = np.flatnonzero((at == 0) | (at == bins))
    if len(missed):
        more, own = _cut(rows, [before[b] for b in missed], take, weighted, max(8 * width, 1.0))
        wholes[missed] = own
        numbers = F.array(*[F.lit(int(b)) for b in missed])
        found = found.filter(~F.array_contains(numbers, F.col("b"))).unionByName(
            more.withColumn("b", F.element_at(numbers, F.col("b") + 1)))
    return found, wholes


def _bin(edges: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Ranges of the window from 1 on; its upper end belongs to the last one."""
    return np.minimum(np.searchsorted(edges, hashes, side="right"), len(edges) - 1)


def _dealt(keys: DataFrame) -> DataFrame:
    return keys.filter("key IS NOT NULL").repartition(shuffle_partitions(keys.sparkSession))


def hash_cuts(groups: DataFrame, group: str, before: list[str], take: Callable[[int], int]) -> list[tuple[int, int]]:
    """For each draw the hash, as two longs, of the last of its first ``take(n)`` of the n distinct groups.

    Draw b orders the groups by md5 of ``before[b]`` and the group, see ``_cut``. Only the
    counts and the cuts come to the driver, numbers per draw whatever n is.
    """
    keys = _dealt(groups.select(F.col(group).cast("string").alias("key"), F.lit(0.0).alias("value")))
    found, _ = _cut(keys, before, take, False)
    if found is None:
        return [(-1, -1)] * len(before)
    cuts = {r["b"]: (r["h"] % 2 ** 64, r["l"] % 2 ** 64) for r in found.filter("last").select("b", "h", "l").collect()}
    return [cuts[b] for b in range(len(before))]


def hash_sums(rows: DataFrame, key: str, value: str, before: list[str], take: Callable[[int], int]) -> DataFrame:
    """(b, picked): the sum of ``value`` over the first ``take(n)`` of the n rows in the order of draw b, as in ``hash_cuts``.

    ``key`` is unique and neither column null. No row is copied per draw: tasks add up counts and sums in hash
    ranges, and only hashes around the end of a draw are written, a few times the square root of n for each.
    """
    spark = rows.sparkSession
    keys = materialized(_dealt(rows.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))))
    found, sums = _cut(keys, before, take, True)
    whole = spark.createDataFrame([(b, float(s)) for b, s in enumerate(sums)], "b int, _whole double")
    if found is None:
        return whole.select("b", F.col("_whole").alias("picked"))
    part = found.groupBy("b").agg(F.sum("v").alias("_part"))
    return whole.join(part, "b", "left").select("b", (F.col("_whole") + F.coalesce("_part", F.lit(0.0))).alias("picked"))


def _within(before: list[str], cuts: list[tuple[int, int]]) -> Callable[[list], np.ndarray]:
    starts, none = [p.encode() for p in before], np.array([c[0] < 0 for c in cuts])
    high, low = (np.array([max(c[i], 0) for c in cuts], np.uint64) for i in (0, 1))
    first = (high >> np.uint64(32)).astype(np.uint32)[:, None]

    def of(keys: list) -> np.ndarray:
        known = np.array([k is not None for k in keys])
        inside = np.empty((len(starts), len(keys)), bool)
        texts = [b"" if k is None else k.encode() for k in keys]
        for some, at, tops in leading_words(starts, texts):
            ends, (j, i) = tops < first[some], np.divmod(np.flatnonzero(tops == first[some]), len(at))
            if len(j):
                found, b = md5_pairs(starts, texts, some[j], at[i]), some[j]
                ends[j, i] = (found[:, 0] < high[b]) | ((found[:, 0] == high[b]) & (found[:, 1] <= low[b]))
            inside[np.ix_(some, at)] = ends
        inside[none] = False
        inside[:, ~known] = False
        return inside.T
    return of


def _by_chunk(keys: pa.Array, draws: int):
    # Many keys at once, whose truth values are a byte for each draw.
    size = max(1, min(KEYS, 128 * HASHES // draws))
    for at in range(0, len(keys), size):
        yield keys[at:at + size].to_pylist()


def draws_of(key: Column, before: list[str], cuts: list[tuple[int, int]]) -> Column:
    """The draws that take a group, as an array of their numbers; none for a null group."""
    within = _within(before, cuts)

    @F.arrow_udf("array<int>")
    def of(keys: pa.Array) -> pa.Array:
        ends, found = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
        for some in _by_chunk(keys, len(before)):
            inside = within(some)
            ends.append(ends[-1][-1] + np.cumsum(inside.sum(1)))
            found.append(np.nonzero(inside)[1].astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(found)))
    return of(key.cast("string"))


def mask_of(key: Column, before: list[str], cuts: list[tuple[int, int]], rest: bool = False) -> Column:
    """The same as one bit per draw, lowest bit first; with ``rest`` the draws that do not take the group."""
    within = _within(before, cuts)

    @F.arrow_udf("binary")
    def of(keys: pa.Array) -> pa.Array:
        out = []
        for some in _by_chunk(keys, len(before)):
            out += [bits.tobytes() for bits in np.packbits(within(some) ^ rest, axis=1, bitorder="little")]
        return pa.array(out, pa.binary())
    return of(key.cast("string"))


def subsample_cuts(groups: DataFrame, group: str, fraction: float, times: int, seed: int) -> tuple[list[str], list[tuple[int, int]]]:
    """What ``draws_of`` and ``mask_of`` need for ``subsample`` of distinct groups."""
    before = prefixes(seed, times)
    return before, hash_cuts(groups, group, before, lambda n: max(1, math.floor(n * fraction)))


def subsample(df: DataFrame, group: str, fraction: float, times: int, seed: int) -> DataFrame:
    """(b, group): max(1, floor(groups x fraction)) groups without replacement, B times. Null groups take no part."""
    groups = materialized(df.select(group).distinct())
    before, cuts = subsample_cuts(groups, group, fraction, times, seed)
    return groups.repartition(shuffle_partitions(df.sparkSession)).select(F.explode(draws_of(F.col(group), before, cuts)).alias("b"), group)
