"""Token ids of whole texts by a public tokenizer with word ends, its words being looked up in a bounded table.

The tokenizer cuts a text into runs of letters, single digits and runs of other signs, and never joins ids across them:
the ids of a text are those of its pieces in order.  Pieces are found and hashed for many texts at once; the tokenizer is
asked for pieces that the table lacks.  (An apostrophe before letters may belong to them, so the two stay one piece.)
That holds for texts in the characters of ``_OTHER``'s complement, whose normal form and lower case are settled; any other
text goes to the tokenizer whole.  Pieces of up to 16 bytes are told apart by their bytes, longer ones by 128 bits of BLAKE2b, and
all by their length.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm._common import chunks
from tidemark.llm.word_hash import blocks, mix, padded

#: The tasks already fill the cores.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ɏ]|<\\|")
CHUNK = 1_000_000
#: Slots of the table, and ids that it may hold.
SLOTS, IDS_KEPT = 1 << 20, 4_000_000
_U = np.uint64
_SPACE, _DIGIT, _LETTER, _SIGN = range(4)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[[*range(97, 123), *range(128, 256)]] = _LETTER


def pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last bytes of the pieces of lower-case bytes that start and end with a space."""
    kind = _CLASS[raw]
    edge = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) + 1
    of = kind[edge]
    apostrophe = (of == _SIGN) & (raw[edge] == 39)
    if len(edge) > 1:
        alone = np.zeros(len(edge), bool)
        alone[:-1] = apostrophe[:-1] & (np.diff(edge) == 1) & (of[1:] == _LETTER)
        joined = np.zeros(len(edge), bool)
        joined[1:] = alone[:-1]
        edge, of = edge[~joined], of[~joined]
    some = of != _SPACE
    return edge[some], np.append(edge[1:], len(raw))[some]


def identities(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two numbers and the length, which together tell the bytes first:last from any others."""
    size = last - first
    one = blocks(raw, first, np.minimum(size, 8))
    two = np.zeros(len(size), _U)
    more = np.flatnonzero(size > 8)
    two[more] = blocks(raw, first[more] + 8, np.minimum(size[more] - 8, 8))
    for i in np.flatnonzero(size > 16).tolist():
        one[i], two[i] = np.frombuffer(hashlib.blake2b(raw[first[i] : last[i]].data, digest_size=16).digest(), "<u8")
    return one, two, size


class WordIds:
    def __init__(self, path: str, slots: int = SLOTS, ids_kept: int = IDS_KEPT) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._mask, self._kept = _U(slots - 1), ids_kept
        self._clear()

    def _clear(self) -> None:
        slots = int(self._mask) + 1
        self._one, self._two = np.zeros(slots, _U), np.zeros(slots, _U)
        self._size, self._start, self._length = np.zeros(slots, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self._ids, self._used = np.zeros(1 << 16, np.uint32), 0

    def _whole(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each word's ids."""
        found = [e.ids for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int32, len(found))
        new = np.fromiter((i for x in found for i in x), np.uint32, int(length.sum()))
        end = self._used + len(new)
        if end > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(max(len(self._ids), len(new)), np.uint32)])
        self._ids[self._used : end] = new
        start = self._used + np.cumsum(length) - length
        self._used = end
        return start.astype(np.int32), length

    def _plain(self, texts: list[str]) -> list[bytes]:
        data = [t.lower().encode() for t in texts]
        at = np.cumsum([0, *(len(d) + 1 for d in data)])
        joined = b" ".join([b"", *data, b""])
        raw = padded(joined)
        first, last = pieces(raw[:-8])
        one, two, size = identities(raw, first, last)
        if self._used > self._kept:
            self._clear()
        slot = (mix(one ^ mix(two + size.astype(_U))) & self._mask).astype(np.int64)
        start, length = self._start[slot], self._length[slot]
        missing = np.flatnonzero((self._one[slot] != one) | (self._two[slot] != two) | (self._size[slot] != size) | (length == 0))
        if len(missing):
            seen: dict[bytes, int] = {}
            inverse = [seen.setdefault(joined[a:b], len(seen)) for a, b in zip(first[missing].tolist(), last[missing].tolist(), strict=True)]
            s, n = self._learn([x.decode() for x in seen])
            start[missing], length[missing] = s[inverse], n[inverse]
            slot = slot[missing]
            order = np.unique(slot, return_index=True)[1]  # of pieces that share a slot, one has it
            slot, own = slot[order], missing[order]
            self._one[slot], self._two[slot], self._size[slot], self._start[slot], self._length[slot] = one[own], two[own], size[own], start[own], length[own]
        ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        ids = self._ids[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])].astype("<u4", copy=False)
        bounds = ends[np.searchsorted(first, at)]
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        for lo, hi in chunks(texts, CHUNK):
            part = texts[lo:hi]
            odd = [_OTHER.search(t) is not None for t in part]
            plain = iter(self._plain([t for t, o in zip(part, odd, strict=True) if not o]))
            for t, o in zip(part, odd, strict=True):
                yield self._whole(t) if o else next(plain)


@cache
def word_ids(path: str) -> WordIds:
    """One table a worker."""
    return WordIds(path)
