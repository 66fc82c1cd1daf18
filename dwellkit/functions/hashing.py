"""Reproducible pseudo-randomness from md5, the same in any SQL engine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed, *keys: Column) -> Column:
    """md5 of ``seed:key[:key...]`` as 32 hex digits."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed.cast("string"), *[k.cast("string") for k in keys]))


def hash_int(seed, *keys: Column) -> Column:
    """First 32 bits of the hash as a non-negative long."""
    return F.conv(F.substring(hash_hex(seed, *keys), 1, 8), 16, 10).cast("bigint")


def hash_wide(seed, *keys: Column) -> Column:
    """First 60 bits of the hash as a non-negative long; orders rows like the hash itself."""
    return F.conv(F.substring(hash_hex(seed, *keys), 1, 15), 16, 10).cast("bigint")


def hash_below(n, seed, *keys: Column) -> Column:
    """Uniform long in [0, n); 60 hash bits keep the modulo unbiased for any table size."""
    return hash_wide(seed, *keys) % (n if isinstance(n, Column) else F.lit(n))


_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
_MASK = 2 ** 32 - 1
#: Texts hashed together: the state words stay in the cache.
TOGETHER = 1 << 13


def _words(texts: list[bytes], at: int, total: int | None = None) -> np.ndarray:
    """The 16 words of one-block messages that hold equally long texts at byte ``at``, [16, n]; with ``total`` also the padding."""
    block = np.zeros((len(texts), 64), np.uint8)
    size = len(texts[0])
    block[:, at:at + size] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), size)
    if total is not None:
        block[:, total], block[:, 56], block[:, 57] = 0x80, total * 8 & 255, total * 8 >> 8
    return np.ascontiguousarray(block.view("<u4").T).astype(np.uint32)


def _md5_each(many: np.ndarray, single: np.ndarray, out: np.ndarray) -> None:
    """md5 of the messages many[:, i] | single[:, j] as two longs in the order of the digests, into out[:, j, i].

    Words that are equal for all of ``many`` cost nothing: they are added to the constants of their steps.
    """
    n = many.shape[1]
    order = [(i if t == 0 else 5 * i + 1 if t == 1 else 3 * i + 5 if t == 2 else 7 * i) % 16 for i in range(64) for t in (i // 16,)]
    common = [int(w[0]) if (w == w[0]).all() else None for w in many]
    steps = [None if common[g] is not None else many[g] + np.uint32(_SINES[i]) for i, g in enumerate(order)]
    # As arrays without dimensions: numbers would be converted in each step.
    def scalar(x):
        return np.array(x & _MASK, np.uint32)
    turns = [(scalar(left), scalar(32 - left)) for i in range(64) for left in (_TURNS[i // 16][i % 4],)]
    plain = [None if common[g] is None else scalar(common[g] + _SINES[i]) for i, g in enumerate(order)]
    a, b, c, d, f, high = (np.empty(n, np.uint32) for _ in range(6))
    xor, conj, add, left_shift, right_shift = np.bitwise_xor, np.bitwise_and, np.add, np.left_shift, np.right_shift
    for j in range(single.shape[1]):
        own = single[:, j].tolist()
        for x, v in zip((a, b, c, d), _START):
            x.fill(v)
        for i, (g, (left, right)) in enumerate(zip(order, turns)):
            if i < 16:
                xor(c, d, f)
                conj(f, b, f)
                xor(f, d, f)
            elif i < 32:
                xor(b, c, f)
                conj(f, d, f)
                xor(f, c, f)
            elif i < 48:
                xor(b, c, f)
                xor(f, d, f)
            else:
                np.invert(d, f)
                np.bitwise_or(f, b, f)
                xor(f, c, f)
            add(f, a, f)
            if steps[i] is not None:
                add(f, steps[i], f)
                if own[g]:
                    add(f, scalar(own[g]), f)
            else:
                add(f, scalar((common[g] | own[g]) + _SINES[i]) if own[g] else plain[i], f)
            left_shift(f, left, high)
            right_shift(f, right, f)
            np.bitwise_or(f, high, f)
            add(f, b, f)
            a, d, c, b, f = d, c, b, f, a
        # The digest is the little-endian words; its order is that of the bytes.
        for x, v in zip((a, b, c, d), _START):
            x += np.uint32(v)
            x.byteswap(inplace=True)
        for h, (x, y) in zip(out, ((a, b), (c, d))):
            h[j] = x
            h[j] <<= np.uint64(32)
            h[j] |= y


def md5_table(before: list[bytes], keys: list[bytes]) -> np.ndarray:
    """md5 of each of ``before`` followed by each key, as two unsigned longs in the order of the digests:
    [key, before, 2]. Many short texts are hashed at once, along the longer of the two lists; long ones one by one."""
    wide = len(keys) >= len(before)
    out = np.empty((2, len(before), len(keys)) if wide else (2, len(keys), len(before)), np.uint64)
    for size_p in {len(p) for p in before}:
        ps = [i for i, p in enumerate(before) if len(p) == size_p]
        for size_k in {len(k) for k in keys}:
            ks = [i for i, k in enumerate(keys) if len(k) == size_k]
            size = size_p + size_k
            if size > 55:
                for i in ks:
                    for j in ps:
                        digest = np.frombuffer(md5(before[j] + keys[i]).digest(), ">u8")
                        out[(slice(None), j, i) if wide else (slice(None), i, j)] = digest
                continue
            front, back = _words([before[i] for i in ps], 0), _words([keys[i] for i in ks], size_p, size)
            (many, cols), (single, rows) = ((back, ks), (front, ps)) if wide else ((front, ps), (back, ks))
            for at in range(0, len(cols), TOGETHER):
                some = cols[at:at + TOGETHER]
                found = np.empty((2, len(rows), len(some)), np.uint64)
                _md5_each(np.ascontiguousarray(many[:, at:at + TOGETHER]), single, found)
                if len(rows) == out.shape[1] and len(some) == out.shape[2]:
                    out = found
                else:
                    out[np.ix_((0, 1), rows, some)] = found
    return out.transpose(2, 1, 0) if wide else out.transpose(1, 2, 0)


#: Hashes whose leading words are made together, and their most keys.
TILE, TILE_KEYS = 1 << 15, 1 << 11


def _leading_steps(keys: np.ndarray, shared: list, p: int) -> tuple[list, dict[int, np.ndarray], np.ndarray]:
    """(steps, words, result): what makes the first digest word of p beginnings times the keys, [p, keys], into ``result``.

    ``keys`` are the words of the keys, ``shared`` the words that all beginnings have in common (None: others, to be filled into
    ``words``). The word is ready after 61 of the 64 steps; steps before the first word of a key cost one value for each beginning.
    """
    n, program = keys.shape[1], []
    words = {g: np.empty((p, 1), np.uint32) for g, w in enumerate(shared) if w is None}
    pool: list[np.ndarray] = []

    def free(x):
        if x.shape == (p, n):
            pool.append(x)

    def step(f, left, right, into=None):
        """f(left, right) into ``into`` where that is wide enough; it is not read again otherwise."""
        shape = np.broadcast_shapes(left.shape, right.shape)
        out = into
        if into is None or into.shape != shape:
            out = pool.pop() if shape == (p, n) and pool else np.empty(shape, np.uint32)
        program.append((f, left, right, out))
        return out

    def scalar(x):
        return np.full((1, 1), x & _MASK, np.uint32)
    same = [int(w[0]) if (w == w[0]).all() else None for w in keys]
    a, b, c, d = (scalar(x) for x in _START)
    xor, conj, disj, add, held, ones = np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.add, None, scalar(_MASK)
    for i in range(61):
        t = i // 16
        g = (i if t == 0 else 5 * i + 1 if t == 1 else 3 * i + 5 if t == 2 else 7 * i) % 16
        if t < 2:
            x, y, z = (c, b, d) if t == 0 else (b, d, c)
            f = step(xor, x, z if t == 0 else c)
            f = step(conj, f, y, f)
            f = step(xor, f, z, f)
        elif t == 2:
            # b ^ c of one step is c ^ d of the next.
            if held is None:
                held = step(xor, b, c)
                f = step(xor, held, d)
            else:
                f, held = step(xor, held, b, held), None
        else:
            f = step(xor, d, ones)
            f = step(disj, f, b, f)
            f = step(xor, f, c, f)
        f = step(add, f, a, f)
        if same[g] is None:
            f = step(add, f, (keys[g] + np.uint32((_SINES[i] + (shared[g] or 0)) & _MASK))[None], f)
            if shared[g] is None:
                f = step(add, f, words[g], f)
        elif shared[g] is None:
            f = step(add, f, words[g], f)
            f = step(add, f, scalar(same[g] + _SINES[i]), f)
        else:
            f = step(add, f, scalar((same[g] | shared[g]) + _SINES[i]), f)
        turn = _TURNS[t][i % 4]
        high = step(np.left_shift, f, scalar(turn))
        f = step(np.right_shift, f, scalar(32 - turn), f)
        f = step(disj, f, high, f)
        free(high)
        f = step(add, f, b, f)
        free(a)
        a, d, c, b = d, c, b, f
    return program, words, step(add, b, scalar(_START[0]), b)


def leading_words(before: list[bytes], keys: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of ``before``, numbers of keys, first 32 bits of their md5 as [before, key]), in tiles."""
    for size_k in sorted({len(k) for k in keys}):
        all_k = np.array([i for i, k in enumerate(keys) if len(k) == size_k])
        for size_p in sorted({len(p) for p in before}):
            ps, size = np.array([i for i, p in enumerate(before) if len(p) == size_p]), size_p + size_k
            for at in range(0, len(all_k), TILE_KEYS):
                ks = all_k[at:at + TILE_KEYS]
                wide = max(1, TILE // len(ks))
                if size > 55:
                    for i in ps.tolist():
                        tops = [int.from_bytes(md5(before[i] + keys[k]).digest()[:4], "big") for k in ks.tolist()]
                        yield np.array([i]), ks, np.array([tops], np.uint32)
                    continue
                front, back = _words([before[i] for i in ps], 0), _words([keys[k] for k in ks], size_p, size)
                shared = [int(w[0]) if (w == w[0]).all() else None for w in front]
                made = None
                for j in range(0, len(ps), wide):
                    some = ps[j:j + wide]
                    if made is None or len(made[2]) != len(some):
                        made = _leading_steps(back, shared, len(some))
                    program, words, found = made
                    for g, w in words.items():
                        w[:, 0] = front[g, j:j + wide]
                    for f, left, right, out in program:
                        f(left, right, out)
                    yield some, ks, np.broadcast_to(found.byteswap(), (len(some), len(ks)))


def md5_pairs(before: list[bytes], keys: list[bytes], b: np.ndarray, k: np.ndarray) -> np.ndarray:
    """md5 of before[b[i]] + keys[k[i]] as two unsigned longs in the order of the digests, [i, 2]."""
    out = np.empty((len(b), 2), np.uint64)
    sizes_p, sizes_k = (np.array([len(x) for x in texts]) for texts in (before, keys))
    for size_p in np.unique(sizes_p[b]).tolist():
        for size_k in np.unique(sizes_k[k]).tolist():
            at = np.flatnonzero((sizes_p[b] == size_p) & (sizes_k[k] == size_k))
            if size_p + size_k > 55:
                for i in at.tolist():
                    out[i] = np.frombuffer(md5(before[b[i]] + keys[k[i]]).digest(), ">u8")
            elif len(at):
                ps, ks = np.flatnonzero(sizes_p == size_p), np.flatnonzero(sizes_k == size_k)
                front, back = _words([before[i] for i in ps], 0), _words([keys[i] for i in ks], size_p, size_p + size_k)
                for j in range(0, len(at), TOGETHER):
                    some = at[j:j + TOGETHER]
                    words = front[:, np.searchsorted(ps, b[some])] | back[:, np.searchsorted(ks, k[some])]
                    found = np.empty((2, 1, len(some)), np.uint64)
                    _md5_each(words, np.zeros((16, 1), np.uint32), found)
                    out[some] = found[:, 0].T
    return out
