"""Keys under which all lines that are similar enough in edits meet.

A line is a sequence of symbols: its words, or its code points where it has fewer than three words. Two lines link if the
edits between them are at most floor(0.2 N), with N the symbols of the longer one. Two kinds of keys hold every such pair:

* N below a bound (10 words, 20 code points): the shorter line is cut into one segment more than the edits allowed, so
  that one stays as it is; the longer one is asked for it at the few places that the other segments leave it.
* longer lines: of g grams of q symbols, d edits leave all but q d. In any order of all grams, the first few of both
  lines then have one in common; they are ordered by how common their symbols are, rare ones first, and last those grams
  that are common themselves, as those of a passage of rare words that many lines quote. The order decides how many lines
  meet by chance, not which similar ones do.

Lines also carry a parity signature: a symbol flips one of 1024 bits, so an edit changes two at most. With fewer bits than
twice the edits allowed it would tell nothing: 128 let any two lines of 320 words through, and most of 200.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from loglathe.llm import words

LEAST_SIMILARITY = 0.8  # below it the grams left may be none
BOUND = {0: 10, 1: 20}  # symbols from which grams are used: of words, of code points
GRAM = {0: 2, 1: 3}
SKETCH = 1 << 16
GRAM_BITS = 22  # upper bits of a gram's hash by which common grams are counted
_COMMON_GRAM = 1 << 12  # above the weight of the symbols of any gram
MARKS = 16  # 64-bit numbers of a signature
_BLOCK = 4096  # lines whose signatures are made in one go


def allowed(n: int, similarity: float) -> int:
    return int((1 - similarity + 1e-9) * n)


def _segments(n: int, edits: int) -> list[tuple[int, int]]:
    """Begin and size of edits + 1 segments of n symbols."""
    ends = [n * i // (edits + 1) for i in range(edits + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=None)
def _places(n: int, similarity: float, bound: int) -> list[tuple[tuple[int, int, int], int, int]]:
    """(tag, begin, size) of the parts of a line of n symbols under which it is held or asked for."""
    found = set()
    for longer in range(n, bound):  # as the shorter line
        d = allowed(longer, similarity)
        if d and longer - n <= d:
            found |= {((n, d, i), a, size) for i, (a, size) in enumerate(_segments(n, d))}
    d = allowed(n, similarity)
    for shorter in range(n - d, n + 1) if d and n < bound else ():
        apart = n - shorter
        for i, (a, size) in enumerate(_segments(shorter, d)):
            low = max(a - i, a + apart - (d - i), 0)
            high = min(a + i, a + apart + (d - i), n - size)
            found |= {((shorter, d, i), p, size) for p in range(low, high + 1)}
    return sorted(found)


@lru_cache(maxsize=None)
def _prefix(n: int, similarity: float, bound: int, q: int) -> int:
    """Grams of a line of n symbols that must be keys; 0 if no pair of it is as long as the bound."""
    # with more symbols in the other line the number falls: five more allow one edit more, of q < 5 grams
    sizes = [m for m in range(max(n, bound), max(n, bound) + 11) if m - n <= allowed(m, similarity)]
    return max([n - m + q * allowed(m, similarity) + 1 for m in sizes], default=0)


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _hashes(symbols: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(begin), dtype=np.uint64)
    for j in range(size):
        total += symbols[begin + j] * words._PLACES[j]
    return words.mix(total)


def _order(line: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """Order by ascending line, then small whole numbers, last 64-bit hashes: one sort of as many bits as fit, if these decide."""
    *small, last = then
    used, top = 0, np.zeros(len(line), dtype=np.uint64)
    for values in (line, *small):
        bits = int(values.max(initial=0)).bit_length()
        top = top << np.uint64(bits) | values.astype(np.uint64)
        used += bits
    if 0 < used < 48:
        packed = top << np.uint64(64 - used) | last >> np.uint64(used)
        order = np.argsort(packed)
        packed, ordered = packed[order], last[order]
        if not np.any((packed[1:] == packed[:-1]) & (ordered[1:] != ordered[:-1])):
            return order
    return np.lexsort((last, *reversed(small), line))


def ranks(counts: np.ndarray) -> np.ndarray:
    """How common symbols are, in whole steps, from their counts by upper 16 bits."""
    return np.rint(16 * np.log2(1.0 + counts)).astype(np.int32)


def grams(symbols: np.ndarray, sizes: np.ndarray, kind: int) -> np.ndarray:
    """Upper bits of the hashes of all grams of the lines."""
    q = GRAM[kind]
    rows = np.flatnonzero(sizes >= q)
    count = sizes[rows] - q + 1
    begin = np.repeat((np.cumsum(sizes) - sizes)[rows], count) + _spread(count)
    return (_hashes(symbols, begin, q) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def keys(
    symbols: np.ndarray, sizes: np.ndarray, kind: int, similarity: float, common: np.ndarray, common_grams: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) for lines of the given sizes, whose symbols follow one another.

    `common` and `common_grams` are ranks by the upper bits of a symbol or a gram; a gram of rank 0 is not common.
    """
    bound, q = BOUND[kind], GRAM[kind]
    first = np.cumsum(sizes) - sizes
    out_line, out_key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in np.unique(sizes[sizes < bound]).tolist():
        rows = np.flatnonzero(sizes == n)
        for tag, begin, size in _places(n, similarity, bound):
            number = np.uint64((((tag[0] << 5) + tag[1] << 5) + tag[2] << 2) + 2 * kind + 1)
            out_line.append(rows)
            out_key.append(words.mix(_hashes(symbols, first[rows] + begin, size) ^ words.mix(np.array([number]))))
    distinct = np.unique(sizes)
    wanted = np.array([_prefix(n, similarity, bound, q) for n in distinct.tolist()], dtype=np.int64)
    limit = wanted[np.searchsorted(distinct, sizes)] if len(sizes) else sizes
    rows = np.flatnonzero(limit > 0)
    count = sizes[rows] - q + 1
    line = np.repeat(rows, count)
    begin = np.repeat(first[rows], count) + _spread(count)
    gram = _hashes(symbols, begin, q)
    weight = sum((common[(symbols[begin + j] >> np.uint64(48)).astype(np.int64)] for j in range(q)), np.zeros(len(begin), np.int32))
    if common_grams is not None:
        held = common_grams[(gram >> np.uint64(64 - GRAM_BITS)).astype(np.int64)]
        weight = np.where(held > 0, _COMMON_GRAM + held.astype(np.int32), weight)
    # the second time a gram stands in a line it is another one
    order = _order(line, gram)
    line, gram, weight = line[order], gram[order], weight[order]
    new = np.ones(len(line), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (gram[1:] != gram[:-1])
    starts = np.flatnonzero(new)
    again = _spread(np.diff(np.append(starts, len(line))))
    gram = words.mix(gram + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * kind))
    order = _order(line, weight, gram)
    line, gram = line[order], gram[order]
    keep = _spread(count) < np.repeat(limit[rows], count)  # still ordered by line
    out_line.append(line[keep])
    out_key.append(gram[keep])
    return np.concatenate(out_line), np.concatenate(out_key)


def signatures(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity signature of each line (none is empty), as MARKS 64-bit numbers."""
    bits = 64 * MARKS
    bit = ((symbols >> np.uint64(3)) & np.uint64(bits - 1)).astype(np.int64)
    ends, out = np.concatenate([[0], np.cumsum(sizes)]), np.zeros((len(sizes), MARKS), dtype=np.int64)
    for start in range(0, len(sizes), _BLOCK):
        some = sizes[start : start + _BLOCK]
        times = np.zeros(len(some) * bits, dtype=np.uint8)  # what they are beyond 255 does not change their last bit
        np.add.at(times, np.repeat(np.arange(len(some)) * bits, some) + bit[ends[start] : ends[start + len(some)]], np.uint8(1))
        out[start : start + _BLOCK] = np.packbits(times & 1, bitorder="little").view(np.int64).reshape(-1, MARKS)
    return np.ascontiguousarray(out.T)
