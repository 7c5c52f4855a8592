"""Words and shingles of many texts at once, as flat numpy arrays.

Used inside Arrow tasks: Spark deals out and shuffles the rows, these helpers only replace a loop over characters.
A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, dtype=bool)
WHITE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

PIECE_BYTES = 1 << 21  # text handled in one numpy pass
_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_PLACES = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_POWERS = _powers(_BASE, _SEGMENT + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), _SEGMENT + 1)


@dataclass
class Words:
    """Words of several texts: byte range of each word and the text it is from."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # first word of each text, one entry more than texts
    offset: np.ndarray  # first byte of each text, one entry more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def find_words(texts: list[bytes], lower: bool = False) -> Words:
    """Words of the texts; `lower` maps A-Z to a-z first."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        buf = LOWER[buf]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    offset = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    white = WHITE[buf]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    first = np.searchsorted(starts, offset).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(buf, starts, ends, doc, first, offset)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans must be ordered and must not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        stop = max(int(np.searchsorted(ends, begin + _SEGMENT, side="right")), at + 1)
        size = int(ends[stop - 1] - begin)
        if size <= _SEGMENT:
            power, inverse = _POWERS[:size], _INVERSE
        else:  # one very long span
            power, inverse = _powers(_BASE, size), _INVERSE
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_VALUES[buf[begin : begin + size]] * power, out=total[1:])
        low, high = starts[at:stop] - begin, ends[at:stop] - begin
        out[at:stop] = (total[high] - total[low]) * inverse[low]
        at = stop
    return mix(out)


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(words.buf, words.starts, words.ends)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every k-word shingle.

    A text with fewer words has its whole sequence as one shingle, a text without words has none.
    """
    n = len(hashes)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, n)):
        total[: n - j] += hashes[j:] * _PLACES[j]
    whole = np.arange(n) + k <= first[1:][doc] if n else np.zeros(0, dtype=bool)
    short = np.flatnonzero((counts > 0) & (counts < k))
    value = np.zeros(len(short), dtype=np.uint64)
    for j in range(k - 1):
        has = counts[short] > j
        value[has] += hashes[first[:-1][short[has]] + j] * _PLACES[j]
    value += counts[short].astype(np.uint64) * _PLACES[k]
    return mix(np.concatenate([total[whole], value])), np.concatenate([doc[whole], short])


def unique_per_doc(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, ordered by text and value."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[keep], doc[keep]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a text column; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def pieces(sizes: Iterable[int], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `limit` bytes together; a larger text is alone."""
    start = total = 0
    count = -1
    for count, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, count
            start, total = count, 0
        total += size + 1
    if count >= start:
        yield start, count + 1
