"""The first word of many hashes, made in tiles, decides all but those near a cut."""

import random
from hashlib import md5

import numpy as np
import pytest

from dwellkit.functions import hashing
from dwellkit.operators import splits as sp


def _texts():
    rng = random.Random(1)
    before = [b"", b"42:7:", b"42:8:", b"x" * 30, b"y" * 70, *[f"42:{b}:".encode() for b in range(995, 1010)]]
    return rng, before, [bytes(rng.randrange(256) for _ in range(n % 61)) for n in range(300)] + [b"same", b"same"]


@pytest.mark.parametrize("tile, keys", [(1 << 15, 1 << 11), (16, 3)])
def test_leading_words_are_those_of_md5(monkeypatch, tile, keys):
    monkeypatch.setattr(hashing, "TILE", tile)
    monkeypatch.setattr(hashing, "TILE_KEYS", keys)
    _, before, texts = _texts()
    seen = np.zeros((len(before), len(texts)), int)
    for some, at, tops in hashing.leading_words(before, texts):
        seen[np.ix_(some, at)] += 1
        want = [[int.from_bytes(md5(before[i] + texts[k]).digest()[:4], "big") for k in at] for i in some]
        assert tops.tolist() == want
    assert (seen == 1).all()


def test_pairs_are_those_of_md5():
    rng, before, texts = _texts()
    b, k = (np.array([rng.randrange(len(x)) for _ in range(400)]) for x in (before, texts))
    got = hashing.md5_pairs(before, texts, b, k)
    assert got.tolist() == [[int.from_bytes(md5(before[i] + texts[j]).digest()[h:h + 8], "big") for h in (0, 8)] for i, j in zip(b, k)]


def test_a_cut_is_exact_to_the_last_bit():
    before, keys = ["5:0:", "5:1:", "5:2:"], [str(i) for i in range(50)] + [None]
    digests = [md5(f"{p}17".encode()).digest() for p in before]
    whole = [(int.from_bytes(d[:8], "big"), int.from_bytes(d[8:], "big")) for d in digests]
    at = sp._within(before, [whole[0], (whole[1][0], whole[1][1] - 1), (-1, -1)])(keys)
    assert at[17].tolist() == [True, False, False] and not at[50].any()
    for b in (0, 1):
        assert at[:50, b].tolist() == [md5(f"{before[b]}{k}".encode()).digest() <= digests[b] and (b == 0 or k != "17") for k in keys[:50]]


def test_few_hashes_are_made_in_full(monkeypatch):
    """Full digests only near the end of a draw: before, every hash was made in full."""
    made = []
    whole = hashing._md5_each
    monkeypatch.setattr(hashing, "_md5_each", lambda many, single, out: made.append(many.shape[1] * single.shape[1]) or whole(many, single, out))
    sp._within([f"1:{b}:" for b in range(50)], [(1 << 63, 0)] * 50)([str(i) for i in range(2000)])
    assert sum(made) < 100
