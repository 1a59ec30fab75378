"""Vectorised word hashing of many texts at once.

A word is a run of ASCII letters and digits and of bytes beyond ASCII; A-Z count as a-z. Equal words have equal
64-bit hashes wherever they stand: the hash is a polynomial modulo 2**64, taken from prefix sums and then mixed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MULTIPLIER = 0x5851F42D4C957F2F
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are hashed at a time.
SEGMENT = 2 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    word = ((lower >= 97) & (lower <= 122)) | ((byte >= 48) & (byte <= 57)) | (byte >= 128)
    values = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64)[lower]
    return word, np.where(word, values, np.uint64(0))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for k, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def segments(outside: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Cut a buffer into parts of about ``size`` that end with a place that is ``outside`` all words; a longer word lies
    whole in one part. The last place must be outside."""
    cuts, at = [0], 0
    while len(outside) - at > size:
        back = np.flatnonzero(outside[at : at + size])
        if len(back):
            at += int(back[-1]) + 1
        else:
            at += size + int(np.argmax(outside[at + size :])) + 1
        cuts.append(at)
    return list(zip(cuts, [*cuts[1:], len(outside)], strict=True))


def _hash_part(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of a part that ends outside all words."""
    word, values = _tables()
    inside = word[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    power, inverse = powers(len(buf))
    total = np.cumsum(values[buf] * power)
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    return mix((total[end - 1] - before) * inverse[start]), start


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text). Long texts are gone through SEGMENT bytes at a
    time."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)  # each text ends with a separator
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    parts = [(0, len(buf))] if len(buf) <= SEGMENT else segments(~_tables()[0][buf], SEGMENT)
    found = [(a, *_hash_part(buf[a:b])) for a, b in parts if b > a]
    hashes, start = np.concatenate([h for _, h, _ in found]), np.concatenate([s + a for a, _, s in found])
    last = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(start, last)
    return hashes, np.diff(upto, prepend=0)
