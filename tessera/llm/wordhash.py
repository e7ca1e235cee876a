"""Hashes of words, over many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of text whose words are hashed at once.
PIECE = 2 << 20
#: Words of more bytes are hashed one by one.
LONG = 256

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SPACES = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: The bits of a lane of eight bytes that a word of so many bytes has.
FRONT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def stir(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after another, where each word starts and ends, and the number of words of each text. Words
    are what lies between ASCII white space."""
    space = SPACES[data]
    n = len(data)
    opens, closes = ~space, ~space
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    opens[1:] &= space[:-1] | edge[1:n]
    closes[:-1] &= space[1:] | edge[1:n]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return first, last, np.searchsorted(first, off[1:]) - np.searchsorted(first, off[:-1])


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
    """The 64-bit hash of each word, A-Z in lower case, under a secret seed: eight bytes at a time are mixed into a state
    that is stirred before the next eight, so no sum or power of the bytes decides it."""
    low = np.concatenate((LOWER[data], np.zeros(8, np.uint8)))
    lanes = np.ndarray(len(data) + 1, "<u8", low, strides=(1,))
    size = last - first
    start = stir(np.array([seed], np.uint64) + MIX)[0]
    h = np.full(len(first), start, np.uint64)
    left = np.flatnonzero(size <= LONG)
    at = 0
    while len(left):
        some = lanes[first[left] + at] & FRONT[np.minimum(size[left] - at, 8)]
        h[left] = stir(h[left] ^ some) + MIX
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(low[first[k] : last[k]], digest_size=8, key=int(start).to_bytes(8, "little")).digest()
        h[k] = int.from_bytes(digest, "little")
    return stir(h + size.astype(np.uint64) * MIX)
