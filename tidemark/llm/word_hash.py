"""64-bit hashes of the words of many texts at once.

A stretch of bytes is taken in blocks of eight; each block is mixed with a key of its place, and the blocks' sum with the
length: no two stretches are alike because their bytes follow a rule that a polynomial would cancel.  Stretches of more than
``LONG`` bytes are hashed by BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

_U = np.uint64
#: Bytes beyond which a stretch is hashed by itself.
LONG = 64
_ODD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_OF_PLACE = mix(np.arange(1, LONG // 8 + 1, dtype=_U) * _ODD)
#: What keeps the first n bytes of a little-endian block.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], _U)


def blocks(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The size (at most 8) bytes from at on as little-endian numbers. raw: bytes, with eight more after the last one used."""
    every = np.ndarray(len(raw) - 7, "<u8", raw.data, strides=(1,))
    return every[at] & _FIRST[size]


def padded(data: bytes) -> np.ndarray:
    """The bytes for ``blocks`` and ``of_stretches``."""
    return np.frombuffer(data + bytes(8), np.uint8)


def of_stretches(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the bytes first:last of raw, which ends in eight more bytes."""
    size = last - first
    out = mix(blocks(raw, first, np.minimum(size, 8)) ^ _OF_PLACE[0])
    for k in range(1, LONG // 8):
        more = np.flatnonzero(size > 8 * k)
        if not len(more):
            break
        out[more] += mix(blocks(raw, first[more] + 8 * k, np.minimum(size[more] - 8 * k, 8)) ^ _OF_PLACE[k])
    out = mix(out + size.astype(_U) * _ODD)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : last[i]].data, digest_size=8).digest(), "little")
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left + _ODD) + right)


def windows(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n values in a row, in order; fewer than n have none."""
    out, done = None, 0
    power, size = values, 1
    while True:
        if n & size:
            part = power[done:]
            out = part if out is None else _joined(out[: len(part)], part[: len(out)])
            done += size
        if 2 * size > n:
            return out[: max(0, len(values) - n + 1)]
        power = _joined(power[:-size], power[size:])
        size *= 2


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of anything but ASCII white space, A-Z lower-cased) of all texts, and each text's count."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    at = np.cumsum([0, *(len(d) + 1 for d in data)])
    raw = padded(b" ".join([b"", *data, b""]))
    white = _WHITE[raw[:-8]]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    first, last = edges[0::2], edges[1::2]
    return of_stretches(raw, first, last), np.diff(np.searchsorted(first, at + 1))


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text; one for a text of fewer words, none for one of no words."""
    out, at = [], 0
    every = windows(hashes, n)
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(every[at : at + c - n + 1]))
        else:
            # a whole sequence is never a window's hash by its words alone
            out.append(mix(windows(hashes[at : at + c], c) + _U(c)) if c else hashes[:0])
        at += c
    return out
