"""Runs: maximal periodic stretches of words, by internal pattern matching.

A run of period q and length >= 2q holds, before its last q words, an aligned block of 2^k words with
2 * 2^k - 1 <= q <= 4 * 2^k - 2, and the block stands again q words later. So each dyadic block asks for
its own occurrences in the windows that far behind it. The block is an interval of the suffix
array; a wavelet matrix over the suffix array gives the occurrences in a window (range successor: count
the smaller positions, select the next). As the window is no longer than the block, its occurrences
are one progression, told by the first two and their number. Its members are the candidate
periods; common extension in both directions, by the ranks of prefix doubling, confirms them.

The blocks of 4 words stand at every second word and ask for periods 1 to 14, because short runs have
at least MIN_WORDS words.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_WORDS = 12
BASE = 4
#: Texts are searched together up to so many words, longer ones alone.
CHUNK_WORDS = 1 << 16


class WaveletMatrix:
    """Positions in suffix order, bit by bit from the top, as packed bits with running counts."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.depth = max(1, int(self.n - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        for level in reversed(range(self.depth)):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(self.n - int(bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def _ones_before(self, row: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[row][word] + np.bitwise_count(self.bits[row][word] & mask)

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each interval [lo, hi) are smaller than its bound."""
        out = np.where(bound >= self.n, hi - lo, 0)
        bound = np.where(bound >= self.n, 0, bound)
        for row in range(self.depth):
            a, b = self._ones_before(row, lo), self._ones_before(row, hi)
            one = (bound >> (self.depth - 1 - row)) & 1 == 1
            out = out + np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, self.zeros[row] + a, lo - a), np.where(one, self.zeros[row] + b, hi - b)
        return out

    def select(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each interval."""
        out = np.zeros(len(lo), np.int64)
        for row in range(self.depth):
            a, b = self._ones_before(row, lo), self._ones_before(row, hi)
            zeros = (hi - b) - (lo - a)
            one = k >= zeros
            out |= one.astype(np.int64) << (self.depth - 1 - row)
            k = np.where(one, k - zeros, k)
            lo, hi = np.where(one, self.zeros[row] + a, lo - a), np.where(one, self.zeros[row] + b, hi - b)
        return out


class Suffixes:
    """Suffix order of ``symbols`` by prefix doubling, as deep as ``longest`` or as repeats go.

    ``ranks[k][i]`` is the first place among the suffixes that share 2^k symbols with suffix i: equal ranks are
    equal stretches, and all of them stand from that place on.
    """

    def __init__(self, symbols: np.ndarray, longest: int):
        n = len(symbols)
        self.order = np.argsort(symbols, kind="stable")
        places = np.arange(n)
        rank = np.zeros(n, np.int32)
        self._regroup(rank, symbols[self.order], self.order, places)
        self.ranks = [rank]
        while (length := 1 << (len(self.ranks) - 1)) < longest:
            # Only suffixes with company go on.
            starts = rank[self.order[places]]
            places = places[np.bincount(starts, minlength=n)[starts] > 1]
            if not len(places):
                break
            here = self.order[places]
            after = here + length
            key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0) + rank[here].astype(np.int64) * (n + 1)
            by = np.argsort(key, kind="stable")
            self.order[places] = here[by]
            rank = rank.copy()
            self._regroup(rank, key[by], here[by], places)
            self.ranks.append(rank)

    @staticmethod
    def _regroup(rank: np.ndarray, keys: np.ndarray, suffixes: np.ndarray, places: np.ndarray) -> None:
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        rank[suffixes] = places[np.flatnonzero(new)][np.cumsum(new) - 1]

    def common(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols agree from a and b on, or before them; a is smaller than b."""
        n, deepest = len(self.order), len(self.ranks) - 1
        done = np.zeros(len(a), np.int64)
        level = deepest
        while level >= 0:
            length, rank = 1 << level, self.ranks[level]
            x, y = (a - done - length, b - done - length) if back else (a + done, b + done)
            same = (x >= 0) & (y + length <= n) & (rank[np.maximum(x, 0)] == rank[np.minimum(y, n - 1)])
            done += np.where(same, length, 0)
            # The deepest stretch may fit many times, each of the others once more.
            if level < deepest or not same.any():
                level -= 1
        return done


def _windows(length: int) -> list[tuple[int, int]]:
    """Distances at which blocks of this length look for themselves, in windows no longer than the block."""
    if length == BASE:
        return [(1, 4), (5, 8), (9, 12), (13, 14)]
    return [(2 * length - 1, 3 * length - 2), (3 * length - 1, 4 * length - 2)]


def _candidates(suffixes: Suffixes, wavelet: WaveletMatrix, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of 2^level symbols and the distances to their next occurrences."""
    n, length, rank = wavelet.n, 1 << level, suffixes.ranks[level]
    at = np.arange(0, n - length + 1, 2 if length == BASE else length)
    many = np.bincount(rank, minlength=n)
    at = at[many[rank[at]] > 1]
    lo = rank[at].astype(np.int64)
    hi = lo + many[lo]
    blocks, periods = [], []
    for near, far in _windows(length):
        first_k = wavelet.below(lo, hi, at + near)
        m = wavelet.below(lo, hi, at + far + 1) - first_k
        some = np.flatnonzero(m)
        block, m, first_k, a, b = at[some], m[some], first_k[some], lo[some], hi[some]
        first = wavelet.select(a, b, first_k)
        step = np.ones(len(some), np.int64)
        two = m > 1
        step[two] = wavelet.select(a[two], b[two], first_k[two] + 1) - first[two]
        skip = np.zeros(len(some), np.int64)
        three = np.flatnonzero(m > 2)
        if length > BASE and len(three):
            # The block has the period ``step``. Occurrences inside the same stretch of that period are no new
            # period: stretch and distance would share a smaller one.
            end = block[three] + step[three] + suffixes.common(block[three], block[three] + step[three])
            skip[three] = np.clip((end - length - first[three]) // step[three] + 1, 0, m[three])
        left = m - skip
        nth = np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left) + np.repeat(skip, left)
        blocks.append(np.repeat(block, left))
        periods.append(np.repeat(first - block, left) + nth * np.repeat(step, left))
    return np.concatenate(blocks), np.concatenate(periods)


def find_runs(symbols: np.ndarray, longest: int, min_words: int = MIN_WORDS) -> np.ndarray:
    """(start, end, period) of all runs of at least max(``min_words``, 2 * period), by start and period.

    ``min_words`` is 12 or more. ``longest`` bounds the texts of which ``symbols`` consists; no two texts
    share a symbol.
    """
    if min_words < MIN_WORDS:
        raise ValueError(f"blocks of {BASE} words find runs of {MIN_WORDS} words or more")
    found = [np.zeros((0, 3), np.int64)]
    if longest >= min_words:
        deepest = max(BASE, 1 << max(0, ((longest // 2 + 1) // 2).bit_length() - 1))
        suffixes = Suffixes(symbols, deepest)
        wavelet = WaveletMatrix(suffixes.order)
        for level in range(BASE.bit_length() - 1, len(suffixes.ranks)):
            block, period = _candidates(suffixes, wavelet, level)
            end = block + period + suffixes.common(block, block + period)
            start = block - suffixes.common(block, block + period, back=True)
            ok = end - start >= np.maximum(min_words, 2 * period)
            found.append(np.stack((start[ok], end[ok], period[ok]), axis=1))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # A stretch is found with its smallest period and, perhaps, multiples of it.
    first = np.concatenate((np.ones(min(1, len(runs)), bool), (runs[1:, :2] != runs[:-1, :2]).any(1)))
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _search(texts: list[list[bytes]], min_words: int) -> list[np.ndarray]:
    """The runs of each text."""
    sizes = [len(words) for words in texts]
    ends = np.cumsum([0, *sizes])
    symbols = np.empty(ends[-1], np.int64)
    for words, at in zip(texts, ends.tolist()):
        # The number of a word is where the text has it first, so texts share no numbers.
        table: dict[bytes, int] = {}
        symbols[at:at + len(words)] = np.fromiter(map(table.setdefault, words, count(at)), np.int64, len(words))
    runs = find_runs(symbols, max(sizes, default=0), min_words)
    cuts = np.searchsorted(runs[:, 0], ends)
    return [runs[a:b] - [at, at, 0] for a, b, at in zip(cuts, cuts[1:], ends.tolist())]


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


RUNS = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


def periodic_runs(text: Column, key: Column | None = None, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None,
                  min_words: int = MIN_WORDS, chunk_words: int = CHUNK_WORDS) -> Column:
    """A struct: the number of words, all runs by start and period, and the text without repeats.

    Words are what stands between ASCII white space, compared byte by byte, and are numbered from 0. A run is
    a stretch of at least max(``min_words``, 2 * period) words with that smallest period which no neighbouring word
    extends. The text without repeats has the words, joined by one space, that no run holds after
    its first ``period`` words. Runs may overlap. Null and empty texts and texts of white space have no words, no runs
    and the empty text. Repeated rows get equal results, and no other column is read. ``prepare`` may
    change the words first; it gets the value of ``key`` (may be null) with them.
    """
    @F.arrow_udf(RUNS)
    def of(texts: pa.Array, keys: pa.Array) -> pa.Array:
        sizes, found, kept = [], [], []
        waiting: list[list[bytes]] = []

        def flush():
            for words, runs in zip(waiting, _search(waiting, min_words)):
                found.append(runs)
                kept.append(_collapsed(words, runs))
            waiting.clear()
        n = 0
        for one, key in zip(texts.cast(pa.large_binary()), keys):
            words = (one.as_py() or b"").split()
            if prepare is not None:
                words = prepare(key.as_py(), words)
            if n and n + len(words) > chunk_words:
                flush()
                n = 0
            waiting.append(words)
            sizes.append(len(words))
            n += len(words)
        flush()
        runs = np.concatenate([np.zeros((0, 3), np.int64), *found])
        items = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0], runs[:, 1] - runs[:, 0], np.array(runs[:, 2]))],
                                           names=["start", "length", "period"])
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, items), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["n_words", "runs", "collapsed"])
    return of(text.cast("string"), F.lit(None).cast("string") if key is None else key)
