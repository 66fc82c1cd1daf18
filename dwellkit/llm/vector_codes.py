"""Vector code compression: product quantisation with adaptive lower bounds.

Vectors are cut into parts, and each part gets the index of the nearest entry of its codebook. Rounds of
reassignment do not compare every part with every entry: each part keeps its b closest
entries with lower bounds of their distances, in order, and one outer bound for all others. When
entries move, the bounds shrink by how far they moved. If the exact distance to the present
entry is below all bounds, nothing is computed; if it is below all bounds from a place on, only the
entries before that place are; else all are, and the list starts anew. Every distance that decides
is an exact integer, ties included. b follows what the rounds need.

The bounds are kept in tables of the shared folder, one a round; only sums per entry come to the
driver: entries x components numbers, however many vectors there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellkit.session import materialized

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Entries that a part follows: at first, at least and at most.
FIRST_B, LEAST_B, MOST_B = 12, 2, 32
#: Of the parts that the list could decide, so many may fall out of it when b shrinks.
SPARE = 0.01
#: Sums of large numbers travel in pieces of so many bits.
LIMB = 48
#: Stands for a distance that cannot be the least.
FAR = 1 << 53
LARGEST = (1 << 63) - 1

SUMS = "part int, entry int, place int, amount bigint"
#: Places of SUMS that are no component: rows of an entry, and how far lists had to be read.
COUNT, READ = -1, -2


def _down(x: np.ndarray) -> np.ndarray:
    """The next 32-bit number that is not larger."""
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def _up_root(d) -> np.ndarray:
    return np.nextafter(np.sqrt(d), np.inf)


def _whole(x: float) -> int:
    """floor(SCALE * x) for any finite double."""
    return int(x) * SCALE if abs(x) > 1e300 else math.floor(x * SCALE)


class Codebooks:
    """Integer entries, [part][entry][component].

    Narrow vectors have components below ``limit``, near entries not far beyond it: their distances are exact in 64-bit
    arithmetic. A far entry is farther from a narrow vector than any near one, so it is left out. Vectors that are not
    narrow are compared in integers of any size.
    """

    def __init__(self, exact: list[list[list[int]]]):
        self.exact = exact
        self.size, self.wide = len(exact[0]), len(exact[0][0])
        self.limit = (1 << 24) // max(1, self.wide)
        reach = math.ceil(self.limit * (1 + 2 * math.sqrt(self.wide)))
        self.far = np.array([[any(abs(c) > reach for c in e) for e in part] for part in exact])
        self.near = np.array([[[0] * self.wide if f else e for e, f in zip(part, far)] for part, far in zip(exact, self.far)],
                             np.int64).reshape(len(exact), self.size, self.wide)

    def distances(self, p: int, q: np.ndarray, entry: np.ndarray) -> np.ndarray:
        diff = q - self.near[p][entry]
        return np.where(self.far[p][entry], FAR, (diff * diff).sum(-1))

    def anew(self, p: int, q: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
        """near, low, outer and the least distance from all entries."""
        out = []
        c = self.near[p].astype(np.float64)
        for lo in range(0, max(1, len(q)), 4096):
            some = q[lo:lo + 4096].astype(np.float64)
            # All terms are integers below 2 ** 53.
            d = ((some * some).sum(1)[:, None] + (c * c).sum(1) - 2 * (some @ c.T)).astype(np.int64)
            d[:, self.far[p]] = FAR
            key = d * self.size + np.arange(self.size)
            if b < self.size:
                key = np.partition(key, b, axis=1)[:, :b + 1]
            out.append(np.sort(key, axis=1))
        key = np.concatenate(out)
        d = key // self.size
        low = _down(np.sqrt(d))
        outer = low[:, b] if b < self.size else np.full(len(q), np.inf, np.float32)
        return key[:, :b] % self.size, low[:, :b], outer, d[:, 0]

    def slowly(self, p: int, q: list[int], b: int) -> tuple[list[int], np.ndarray, float, int]:
        """The same of one vector of any size."""
        d = sorted((sum((x - y) ** 2 for x, y in zip(q, e)), i) for i, e in enumerate(self.exact[p]))
        low = _down(np.nextafter([float(min(math.isqrt(x), 1 << 100)) for x, _ in d], -np.inf))
        return [i for _, i in d[:b]], low[:b], low[b] if b < self.size else np.inf, d[0][0]

    def follow(self, p: int, q: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray,
               moves: np.ndarray) -> tuple[np.ndarray, ...]:
        """near, low, outer, the least distance and how many entries of the list were asked, after entries moved."""
        b = near.shape[1]
        outer = _down(outer - moves.max())
        best = self.distances(p, q, near[:, 0])
        reach = _up_root(best)
        # Ordered: no bound is larger than those behind it.
        rest = np.concatenate((_down(low - moves[near])[:, 1:], outer[:, None]), axis=1)
        rest = np.minimum.accumulate(rest[:, ::-1], axis=1)[:, ::-1]
        asked = (rest <= reach[:, None]).sum(1)
        near, low = near.copy(), np.concatenate((_down(np.sqrt(best))[:, None], rest[:, :-1]), axis=1)
        some = np.flatnonzero((asked > 0) & (asked < b))
        for lo in range(0, len(some), 4096):
            rows = some[lo:lo + 4096]
            upto = int(asked[rows].max()) + 1
            entry, bound = near[rows, :upto], low[rows, :upto]
            d = self.distances(p, q[rows][:, None, :], entry)
            unread = np.arange(upto) > asked[rows][:, None]
            by = np.argsort(np.where(unread, (FAR + 1) * self.size + np.arange(upto), d * self.size + entry), axis=1)
            near[rows, :upto] = np.take_along_axis(entry, by, 1)
            low[rows, :upto] = np.take_along_axis(np.where(unread, bound, _down(np.sqrt(d))), by, 1)
            best[rows] = np.take_along_axis(d, by[:, :1], 1)[:, 0]
        lost = np.flatnonzero(asked == b)
        if len(lost):
            near[lost], low[lost], outer[lost], best[lost] = self.anew(p, q[lost], b)
        return near, low, outer, best, asked


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` doubles; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _split(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """The integers of narrow vectors, by part, and the numbers of the others."""
    big = (np.abs(x) >= books.limit / SCALE).any(1)
    q = np.floor(np.where(big[:, None], 0, x) * SCALE).astype(np.int64)
    return q.reshape(len(x), len(books.exact), books.wide), np.flatnonzero(big)


def _parts_of(row: np.ndarray, books: Codebooks) -> list[list[int]]:
    whole = [_whole(v) for v in row.tolist()]
    return [whole[p * books.wide:(p + 1) * books.wide] for p in range(len(books.exact))]


def _packed(a: np.ndarray) -> pa.Array:
    """One binary value per row."""
    a = np.ascontiguousarray(a)
    step = a.nbytes // max(1, len(a))
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(len(a) + 1, dtype=np.int32) * np.int32(step)),
                                                       pa.py_buffer(a.tobytes())])


def _unpacked(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _assign(books: Codebooks, moves: np.ndarray | None, had: list[int], has: list[int], final: bool):
    """One round of assignment as a function for mapInArrow; without ``moves`` there are no lists yet."""
    ends, n_parts = np.cumsum([0, *had]), len(books.exact)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _vectors(batch["x"], books.wide * n_parts)
            q, big = _split(x, books)
            nears, lows, outers, needs, errors = [], [], [], [], np.zeros(len(x), np.int64)
            if moves is not None:
                old_near, old_low = _unpacked(batch["near"], np.uint8), _unpacked(batch["low"], np.float32)
                old_outer = _unpacked(batch["outer"], np.float32)
            for p in range(n_parts):
                asked = np.zeros(len(x), np.int64)
                if moves is None or books.far[p].all():
                    near, low, outer, best = books.anew(p, q[:, p], has[p])
                else:
                    mine = slice(ends[p], ends[p + 1])
                    near, low, outer, best, asked = books.follow(
                        p, q[:, p], old_near[:, mine].astype(np.int64), old_low[:, mine], old_outer[:, p], moves[p])
                if near.shape[1] > has[p]:
                    outer = np.minimum(outer, low[:, has[p]:].min(1))
                    near, low = near[:, :has[p]], low[:, :has[p]]
                elif near.shape[1] < has[p]:
                    # Places without an entry; the outer bound speaks for them.
                    more = ((0, 0), (0, has[p] - near.shape[1]))
                    near, low = np.pad(near, more), np.pad(low, more, constant_values=np.inf)
                errors += best
                nears.append(near.astype(np.uint8))
                lows.append(low.astype(np.float32))
                outers.append(outer)
                needs.append(asked)
            errors = errors.tolist()
            for r in (range(len(x)) if books.far.all(1).any() else big.tolist()):
                errors[r] = 0
                for p, whole in enumerate(_parts_of(x[r], books)):
                    nears[p][r], lows[p][r], outers[p][r], least = books.slowly(p, whole, has[p])
                    errors[r] += least
            kept = [batch[c] for c in ("id", "label")]
            if final:
                code = np.stack([near[:, 0] for near in nears], axis=1).astype(np.int32)
                code = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n_parts, pa.int32()), pa.array(code.ravel()))
                errors = pa.array([e if e <= LARGEST else None for e in errors], pa.int64())
                yield pa.RecordBatch.from_arrays([*kept, code, errors], names=["id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [*kept, batch["x"], _packed(np.concatenate(nears, 1)), _packed(np.concatenate(lows, 1)),
                     _packed(np.stack(outers, 1)), _packed(np.stack(needs, 1).astype(np.uint8))],
                    names=["id", "label", "x", "near", "low", "outer", "need"])
    return of


def _sums(books: Codebooks, has: list[int]):
    """For mapInArrow: the sums of each entry's vectors, their number, and how far the lists were read."""
    starts = np.cumsum([0, *has])[:-1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(books.exact), books.size)
        total, number = np.zeros((*shape, books.wide), np.int64), np.zeros(shape, np.int64)
        read = np.zeros((shape[0], 257), np.int64)
        large: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = _vectors(batch["x"], books.wide * shape[0])
            q, big = _split(x, books)
            code = _unpacked(batch["near"], np.uint8)[:, starts].astype(np.int64)
            need = _unpacked(batch["need"], np.uint8)
            for p in range(shape[0]):
                np.add.at(total[p], code[:, p], q[:, p])
                number[p] += np.bincount(code[:, p], minlength=shape[1])
                read[p] += np.bincount(need[:, p], minlength=read.shape[1])
            for r in big.tolist():
                for p, whole in enumerate(_parts_of(x[r], books)):
                    have = large.setdefault((p, int(code[r, p])), [0] * books.wide)
                    large[p, int(code[r, p])] = [a + b for a, b in zip(have, whole)]
        rows = [(p, e, i * 64, int(total[p, e, i])) for p, e, i in np.argwhere(total).tolist()]
        rows += [(p, e, COUNT, int(number[p, e])) for p, e in np.argwhere(number).tolist()]
        rows += [(p, z, READ, int(read[p, z])) for p, z in np.argwhere(read).tolist()]
        for (p, e), values in large.items():
            for i, v in enumerate(values):
                # Of a negative number the last piece keeps the sign.
                limb = 0
                while not -(1 << LIMB) < v < 1 << LIMB:
                    rows.append((p, e, i * 64 + limb, v & (1 << LIMB) - 1))
                    v >>= LIMB
                    limb += 1
                rows.append((p, e, i * 64 + limb, v))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                                         names=["part", "entry", "place", "amount"])
    return of


def _next_b(read: dict[int, int], had: int, has: int, entries: int) -> int:
    """As many entries as nearly all parts asked; twice as many where too many lists of ``had`` entries were of no use."""
    total, seen = sum(read.values()), 0
    if read.get(had, 0) > SPARE * total:
        return min(2 * has, MOST_B, entries)
    for z in range(had):
        seen += read.get(z, 0)
        if seen >= (1 - SPARE) * total:
            return min(max(z + 1, LEAST_B), entries)
    return has


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is not null and has finite components only; an empty vector is usable."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.coalesce(fine, F.lit(False)))


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
           first_b: int = FIRST_B) -> tuple[DataFrame, list[list[list[int]]]]:
    """(id, label, code, error, label_error) of every usable row, and the codebooks [part][entry][component].

    Components become floor(1024 * x). Codebooks start as the parts of the rows with the ``entries`` smallest ids (null ids
    last, ties by vector; fewer rows give fewer entries). A round assigns all parts to the nearest entry, ties to the lower index, and
    moves each entry that has parts to their mean, rounded down. ``code`` is the assignment after the last round,
    ``error`` its squared distance over all parts, ``label_error`` the sum of the errors of equal labels (null labels
    are equal).

    Left out are null vectors and those with a component that is null or not finite. Vectors shorter than the longest, or
    than a multiple of ``parts``, count as ending in zeros. Components of any size are exact; an error or sum of
    errors that no long can hold is null. Repeated rows each get a row. An empty table gives no rows and no
    codebooks. No other column is read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index takes one byte")
    # Whole multiples of 1 / 1024 have few values and pack well.
    fine = F.transform(vector_col, lambda x: F.when(F.abs(x.cast("double")) < 2.0 ** 40, F.floor(x.cast("double") * SCALE) / SCALE)
                       .otherwise(x.cast("double")))
    state = usable(vectors, vector_col).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), fine.alias("x"))
    kind = state.schema["label"].dataType.simpleString()
    coded = f"id bigint, label {kind}, code array<int>, error bigint"
    state = materialized(state)
    longest = state.agg(F.max(F.size("x")).alias("n")).first()["n"]
    if longest is None:
        return state.sparkSession.createDataFrame([], coded + ", label_error bigint"), []
    wide = -(-longest // parts)
    # At most ``entries`` vectors.
    seeds = state.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    whole = [[_whole(v) for v in r["x"]] + [0] * (wide * parts - len(r["x"])) for r in seeds]
    books = Codebooks([[v[p * wide:(p + 1) * wide] for v in whole] for p in range(parts)])
    had = has = [min(first_b, books.size)] * parts
    moves = None
    lists = f"id bigint, label {kind}, x array<double>, near binary, low binary, outer binary, need binary"
    for _ in range(rounds):
        state = materialized(state.mapInArrow(_assign(books, moves, had, has, False), lists))
        # Entries x components numbers and a few counts, whatever the number of vectors.
        sums = state.select("x", "near", "need").mapInArrow(_sums(books, has), SUMS).groupBy("part", "entry", "place").agg(
            F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect()
        total, number, read = {}, {}, [{} for _ in range(parts)]
        for r in sums:
            p, e, place, amount = r["part"], r["entry"], r["place"], int(r["amount"])
            if place == COUNT:
                number[p, e] = amount
            elif place == READ:
                read[p][e] = amount
            else:
                total[p, e, place // 64] = total.get((p, e, place // 64), 0) + (amount << LIMB * (place % 64))
        moved = [[[total.get((p, e, i), 0) // number[p, e] for i in range(wide)] if (p, e) in number else entry
                  for e, entry in enumerate(part)] for p, part in enumerate(books.exact)]
        steps = [[sum((a - b) ** 2 for a, b in zip(old, new)) for old, new in zip(*pair)] for pair in zip(books.exact, moved)]
        had, has = has, has if moves is None else [_next_b(r, a, b, books.size) for r, a, b in zip(read, had, has)]
        moves = _up_root(np.array([[float(min(math.isqrt(d) + 1, 1 << 500)) ** 2 if d >= FAR else float(d) for d in part]
                                   for part in steps]))
        books = Codebooks(moved)
    found = materialized(state.mapInArrow(_assign(books, moves, had, has, True), coded))
    fits = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")))
    labels = found.groupBy("label").agg(fits.alias("sum")).select(
        F.col("label").alias("_label"), F.when(F.col("sum") <= LARGEST, F.col("sum")).cast("bigint").alias("label_error"))
    return found.join(labels, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books.exact


def digest(codebooks: list[list[list[int]]]) -> str:
    """SHA-256 of the components in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(c) for part in codebooks for e in part for c in e).encode()).hexdigest()
