"""Language-model scoring with Katz backoff.

A gram of level L is a context of L - 1 words and the word after it; before a text stand L - 1 START words, after it one END.
Counts are discounted after Good and Turing up to MAX_DISCOUNTED, at every level; no gram is left out. A context's backoff
weight is what its discounted grams leave, divided by what the words that do not follow it have one level below, so all
probabilities after a context add up to 1; the words' own discounts leave the mass of the one unknown word.

    P(w | h) = d r / C(h)        if the gram h w has r counts
             = a(h) P(w | h')    else, with h' the context without its first word, and a(h) = 1 for an unseen context;
                                 without context the discounted word, or the unknown word

Tables: one per level, a packed row per bucket, with contexts, their weights, the words after them and their counts. A bucket
has whole contexts; contexts that are frequent (known from the table below, at most 64 for each bucket) have their grams
spread over all buckets, and their few sums are added up. A table asks the one below for the probabilities that its weights
need, once per bucket and gram. The recursion is unfolded per level: a seen gram adds log P(w | h) - log P(w | h'), an unseen
one log a(h), so a text asks every level once per distinct gram and adds up. Counts and questions are gathered for many
texts in one task and sent as packed arrays; a frequent gram is one entry per task. The number of buckets follows the size of
the texts, and texts are scored in ROUNDS parts, one after the other, which bounds what is shuffled at a time.

Words and grams are told apart by 64-bit hashes.

Cases: a null text is empty and has the end token only. A null id counts as the empty text where it is hashed. Rows equal
in id and text get equal scores. Without training texts every token is the unknown word, with probability 1. Discounts
that the counts of counts do not support (zero or out of order) are 1; a context or table whose discounts then leave
nothing is scaled down by n / (n + 1). Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm import words
from loglathe.llm.linking import discard, stored

MAX_DISCOUNTED = 5
ORDER = 2  # levels, unless told otherwise
ROUNDS = 2  # parts of the texts scored one after the other
TASK_BYTES = 2 << 20  # text whose counts are gathered in one go
BUCKET_BYTES = 8 << 20  # text per bucket of a table
LEAST_BUCKETS = 16
START, END = (int(v) for v in words.mix(np.array([20_001, 20_002], dtype=np.uint64)).view(np.int64))

_BLOBS = "bucket int, blob binary"
# rows of megabytes: a page each, so that no buffer holds a whole file's rows
_LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}
_SENT = "bucket int, source int, blob binary"
_NONE = np.zeros(0, np.int64)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def gram_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit key of a context and the word after it; it is also the key of the two as a longer context."""
    w = w.view(np.uint64)
    return (words.mix(h.view(np.uint64)) ^ (w << np.uint64(1) | w >> np.uint64(63))).view(np.int64)


@contextmanager
def _row_by_row(spark: SparkSession) -> Iterator[None]:
    """Read rows of megabytes one at a time, or a task holds all of its files' rows at once."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _starts(length: int) -> int:
    """Key of a context of START words only."""
    key = np.array([START])
    for _ in range(length - 1):
        key = gram_key(key, np.array([START]))
    return int(key[0])


def token_arrays(texts: list[bytes], level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token, context of level - 1 words, the context without its first word (0 if it has one or none), and text number."""
    found = words.find_words(texts, lower=True)
    n_texts = len(texts)
    hashes = words.word_hashes(found).view(np.int64)
    token = np.empty(len(hashes) + n_texts, dtype=np.int64)
    token[np.arange(len(hashes)) + found.doc] = hashes
    token[found.first[1:] + np.arange(n_texts)] = END
    first = found.first[:-1] + np.arange(n_texts)

    def before(keys: np.ndarray, at_start: int) -> np.ndarray:
        out = np.empty_like(keys)
        out[1:] = keys[:-1]
        out[first] = at_start
        return out

    context, shorter = np.zeros_like(token), np.zeros_like(token)
    for length in range(1, level):
        last = before(token, START)
        shorter, context = context, last if length == 1 else gram_key(before(context, _starts(length - 1)), last)
    return token, context, shorter, np.repeat(np.arange(n_texts), found.counts + 1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary, each in its smallest unsigned type (64-bit keys as they are)."""
    parts = []
    for a in arrays:
        if a.dtype != np.int64 or len(a) and (a.min() < 0 or a.max() >= 1 << 32):
            small = a
        else:
            small = a.astype(np.min_scalar_type(int(a.max(initial=0))))
        parts.append(small.dtype.str.encode() + len(small).to_bytes(8, "little") + small.tobytes())
    return b"".join(parts)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind = np.dtype(blob[at : at + 3].decode())
        n = int.from_bytes(blob[at + 3 : at + 11], "little")
        out.append(np.frombuffer(blob, dtype=kind, count=n, offset=at + 11))
        at += 11 + n * kind.itemsize
    return out


def _planes(values: np.ndarray, steps: bool = True) -> np.ndarray:
    """Steps between ascending keys (or the values), byte by byte: the upper bytes are zeros, which the shuffle compresses."""
    v = values.view(np.uint64)
    v = np.diff(v, prepend=np.uint64(0)) if steps else v
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).ravel()


def _from_planes(planes: np.ndarray, steps: bool = True) -> np.ndarray:
    v = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()
    return (np.cumsum(v, dtype=np.uint64) if steps else v).view(np.int64)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows change."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _runs(edge: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(edge, n))


def _near_order(level: int, h: np.ndarray, w: np.ndarray, doc: np.ndarray | int = 0) -> np.ndarray:
    """Order by the upper bits of context and word, and by text: one fast sort. Where upper bits clash, a gram or context may
    come in several runs; a bucket adds runs up, so this only costs a few bytes."""
    one, two = h.view(np.uint64), w.view(np.uint64)
    if level == 1:
        upper = two >> np.uint64(18) << np.uint64(18)
    else:
        upper = one >> np.uint64(40) << np.uint64(40) | two >> np.uint64(42) << np.uint64(18)
    return np.argsort(upper | np.asarray(doc).astype(np.uint64) % np.uint64(1 << 18))


def _inside(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each asked key among the ascending keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _bucket(h: np.ndarray, w: np.ndarray, level: int, hot: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a gram: of the word, of the context, or of both where the context is frequent."""
    if level == 1:
        spread = w.view(np.uint64)
    else:
        spread = np.where(_inside(hot, h)[1], words.mix(gram_key(h, w).view(np.uint64)), words.mix(h.view(np.uint64)))
    return (spread % np.uint64(n)).astype(np.int64)


def _dealt(buckets: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each bucket that has any, in order."""
    order = np.argsort(buckets, kind="stable")
    ends = np.searchsorted(buckets[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), order[ends[b] : ends[b + 1]]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = words.as_bytes(batch.column("text"))
    for start, stop in words.pieces(map(len, texts), TASK_BYTES):
        yield start, stop, texts[start:stop]


def _rows(numbers: list, blobs: list) -> pa.Table:
    columns = [pa.array(numbers, type=pa.int32()), pa.array(blobs, type=pa.binary())]
    return pa.Table.from_arrays(columns, names=["bucket", "blob"])


def _sent(rows: list[tuple]) -> pa.Table:
    """Rows of bucket, source and blob."""
    columns = list(zip(*rows)) or [(), (), ()]
    types = (pa.int32(), pa.int32(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=["bucket", "source", "blob"])


def _blobs(table: pa.Table) -> list[list[np.ndarray]]:
    return [_unpack(blob) for blob in table.column("blob").to_pylist()]


def _count(level: int, hot: np.ndarray, n: int):
    """Distinct grams of a task's texts with their counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in _texts(batch):
                w, h, s, _ = token_arrays(texts, level)
                order = _near_order(level, h, w)
                w, h, s = w[order], h[order], s[order]
                edge = _edges(w, h)
                counts = _runs(edge, len(w))
                w, h, s = w[edge], h[edge], s[edge]
                numbers, blobs = [], []
                for b, rows in _dealt(_bucket(h, w, level, hot, n), n):
                    at = rows[_edges(h[rows])]
                    runs = _runs(_edges(h[rows]), len(rows))
                    blobs.append(_pack(_planes(h[at]), s[at], runs, w[rows], counts[rows]))
                    numbers.append(b)
                yield from _rows(numbers, blobs).to_batches()

    return run


def _merge(level: int, large: int):
    """One bucket's grams. A row with source 0 has the bucket of the table, one with source 1 has its numbers: how many grams
    have r counts, all counts, all grams, and the grams of `large` counts and more."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = _blobs(table)
        h = np.concatenate([np.repeat(_from_planes(f[0]), f[2]) for f in found])
        s = np.concatenate([np.repeat(f[1], f[2]) for f in found]).astype(np.int64)
        w = np.concatenate([f[3] for f in found]).astype(np.int64)
        c = np.concatenate([f[4].astype(np.int64) for f in found])
        del found
        order = np.lexsort((w, h))
        h, s, w, c = h[order], s[order], w[order], c[order]
        one = _edges(h, w)
        r = np.add.reduceat(c, one)
        h, s, w = h[one], s[one], w[one]
        edge = _edges(h)
        own, place = np.unique(w, return_inverse=True)
        blob = _pack(_planes(h[edge]), s[edge], _runs(edge, len(h)), _planes(own), _planes(place, steps=False), r)
        rare, types = np.unique(r[r <= MAX_DISCOUNTED + 1], return_counts=True)
        frequent = r >= large
        keys = (w if level == 1 else gram_key(h, w))[frequent]
        b = key[0].as_py()
        return _sent([(b, 0, blob), (b, 1, _pack(rare, types, np.array([r.sum(), len(r)]), keys))])

    return run


def discounts(types: dict[int, int]) -> list[float]:
    """Good-Turing factor of the counts 0..MAX_DISCOUNTED, from the number of types per count."""
    k = MAX_DISCOUNTED
    out = [1.0] * (k + 1)
    n = [types.get(r, 0) for r in range(k + 2)]
    if n[1] == 0:
        return out
    tail = (k + 1) * n[k + 1] / n[1]
    for r in range(1, k + 1):
        if n[r] and tail < 1:
            d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail)
            if 0 < d <= 1:
                out[r] = d
    return out


@dataclass
class Level:
    """A stored table and its few numbers."""

    level: int
    buckets: int
    factors: np.ndarray  # discounts of the counts 0..MAX_DISCOUNTED
    hot: np.ndarray  # ascending keys of the frequent contexts
    weights: np.ndarray  # for each of them: counts, discounted counts and lower probability of what follows it
    scale: float = 1.0  # 1 / tokens, for words
    table: DataFrame | None = None  # bucket, source 0, blob

    def discounted(self, r: np.ndarray) -> np.ndarray:
        r = r.astype(np.int64)
        return np.where(r <= MAX_DISCOUNTED, r * self.factors[np.minimum(r, MAX_DISCOUNTED)], r)

    def numbers(self) -> Level:
        """Without the table, as tasks get it."""
        return Level(self.level, self.buckets, self.factors, self.hot, self.weights, self.scale)


@dataclass
class Grams:
    """An unpacked bucket: contexts in ascending order, and words in ascending order after each."""

    h: np.ndarray  # per context
    s: np.ndarray
    runs: np.ndarray
    w: np.ndarray  # per gram
    r: np.ndarray
    rest: list[np.ndarray]  # log probability one level below by gram, if it has been asked for

    @staticmethod
    def read(found: list[np.ndarray]) -> Grams:
        h, s, runs, own, place, r = found[:6]
        w = _from_planes(own)[_from_planes(place, steps=False)]
        return Grams(_from_planes(h), s.astype(np.int64), runs.astype(np.int64), w, r.astype(np.int64), found[6:])

    def context(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.h)), self.runs)


def _lower_keys(grams: Grams, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of the level below in a bucket: context, word, and the place of each gram among them."""
    s = grams.s[grams.context()]
    order = np.lexsort((grams.w, s))
    edge = _edges(s[order], grams.w[order])
    place = np.empty(len(s), np.int64)
    place[order] = np.repeat(np.arange(len(edge)), _runs(edge, len(s)))
    return s[order][edge], grams.w[order][edge], place


def _ask_below(level: int, below: Level):
    """A bucket's questions to the table below, by bucket of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                s, w, _ = _lower_keys(Grams.read(_unpack(blob)), level)
                to = _bucket(s, w, below.level, below.hot, below.buckets)
                yield from _sent(
                    [(b, source, _pack(_planes(s[rows]), _planes(w[rows]))) for b, rows in _dealt(to, below.buckets)]
                ).to_batches()

    return run


class _Reader:
    """Answers of one bucket of a table."""

    def __init__(self, right: pa.Table, level: Level):
        found = _blobs(right)
        empty = [np.zeros(0, np.uint8), _NONE, _NONE, np.zeros(0, np.uint8), np.zeros(0, np.uint8), _NONE, np.zeros(0, np.uint8), np.zeros(0)]
        self.level, self.grams = level, Grams.read(found[0] if found else empty)
        g = self.grams
        keys = g.w if level.level == 1 else gram_key(np.repeat(g.h, g.runs), g.w)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        m = level.discounted(g.r)
        if level.level == 1:
            self.log_p = np.log10(m * level.scale)
            return
        by = g.context()
        place, below = _from_planes(g.rest[0], steps=False), g.rest[1]
        self.below = below[place]
        sums = np.stack([np.bincount(by, v, len(g.h)) for v in (g.r, m, 10**self.below)], axis=1)
        at, hot = _inside(level.hot, g.h)
        if hot.any():
            sums[hot] = level.weights[at[hot]]
        per, self.log_a = _weights(sums)
        self.log_p = np.log10(m * per[by])

    def find(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, there = _inside(self.keys, w if self.level.level == 1 else gram_key(h, w))
        return self.order[at] if len(self.order) else at, there

    def backoff(self, h: np.ndarray) -> np.ndarray:
        """Log weight of contexts; 0 for those that were never seen."""
        out = np.zeros(len(h))
        at, there = _inside(self.grams.h, h)
        out[there] = self.log_a[at[there]]
        at, hot = _inside(self.level.hot, h)
        if hot.any():
            sums = self.level.weights[at[hot]]
            out[hot] = np.where(sums[:, 0] > 0, _weights(np.where(sums[:, :1] > 0, sums, [1, 0, 0]))[1], 0)
        return out


def _weights(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor of a context's discounted counts, and log of its backoff weight."""
    seen, m, below = sums.T
    g = np.where(1 - m / seen < 1e-12, seen / (seen + 1), 1.0)
    return g / seen, np.log10((1 - g * m / seen) / np.maximum(1 - below, 1e-15))


def _answer_below(below: Level):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        reader, out = _Reader(right, below), []
        for source, (s, w) in zip(left.column("source").to_pylist(), _blobs(left)):
            at, _ = reader.find(_from_planes(s), _from_planes(w))
            out.append((source, key[0].as_py(), _pack(reader.log_p[at])))
        return _sent(out)

    return run


def _with_answers(level: int, below: Level):
    """The bucket with the log probability of each distinct lower gram, and the place of each gram among them."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        blob = left.column("blob")[0].as_py()
        s, w, place = _lower_keys(Grams.read(_unpack(blob)), level)
        log_p = np.zeros(len(w))
        answers = dict(zip(right.column("source").to_pylist(), right.column("blob").to_pylist()))
        for b, rows in _dealt(_bucket(s, w, below.level, below.hot, below.buckets), below.buckets):
            log_p[rows] = _unpack(answers[b])[0]
        return _sent([(key[0].as_py(), 0, blob + _pack(_planes(place, steps=False), log_p))])

    return run


def _hot_sums(level: Level):
    """A bucket's share of the sums of frequent contexts: number of the context, counts, discounted counts, lower probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                g = Grams.read(_unpack(blob))
                at, hot = _inside(level.hot, g.h)
                rows = hot[g.context()]
                by = at[g.context()][rows]
                low = 10 ** g.rest[1][_from_planes(g.rest[0], steps=False)[rows]]
                sums = [np.bincount(by, v, len(level.hot)) for v in (g.r[rows], level.discounted(g.r[rows]), low)]
                has = np.flatnonzero(sums[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(has), *[pa.array(v[has]) for v in sums]], names=["at", "seen", "m", "below"]
                )

    return run


@dataclass
class Model:
    levels: list[Level]
    tokens: int
    types: int
    unknown: float  # log10 probability of the unknown word


def _counted(docs: DataFrame, level: int, hot: np.ndarray, n: int, large: int) -> tuple[DataFrame, dict, int, int, np.ndarray]:
    """Stored counts of a level, the number of grams by count, all counts, all grams, and the keys of frequent grams."""
    blobs = docs.select("text").mapInArrow(_count(level, hot, n), _BLOBS)
    table = stored(blobs.groupBy("bucket").applyInArrow(_merge(level, large), _SENT), f"counts-{level}", **_LARGE_ROWS)
    types, total, grams, frequent = {}, 0, 0, [_NONE]
    for row in table.where("source = 1").select("blob").collect():  # a few numbers per bucket, at most 64 keys on average
        rare, number, sums, keys = _unpack(row.blob)
        for r, k in zip(rare.tolist(), number.tolist()):
            types[r] = types.get(r, 0) + k
        total, grams = total + int(sums[0]), grams + int(sums[1])
        frequent.append(keys.astype(np.int64))
    return table.where("source = 0"), types, total, grams, np.concatenate(frequent)


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count the texts and store the tables."""
    size, texts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    large = max(1, (size + texts) // (64 * n))  # a text has no more tokens than bytes, and its end

    table, types, tokens, distinct, frequent = _counted(docs, 1, _NONE, n, large)
    factors = np.array(discounts(types))
    left = sum((1 - factors[r]) * r * types.get(r, 0) for r in range(1, MAX_DISCOUNTED + 1)) / tokens if tokens else 1.0
    scale = 1.0 / max(tokens, 1)
    if tokens and left < 1e-12:
        left = scale = 1 / (tokens + 1)
    levels = [Level(1, n, factors, _NONE, np.zeros((0, 3)), scale, table)]

    for level in range(2, order + 1):
        hot = np.unique(np.append(frequent, _starts(level - 1)))
        table, types, _, _, frequent = _counted(docs, level, hot, n, large)
        below = levels[-1].numbers()
        asked = table.mapInArrow(_ask_below(level, below), _SENT)
        answered = (
            asked.groupBy("bucket").cogroup(levels[-1].table.groupBy("bucket")).applyInArrow(_answer_below(below), _SENT)
        )
        with _row_by_row(docs.sparkSession):
            answers = stored(answered, "answers", **_LARGE_ROWS)
            full = stored(
                table.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_with_answers(level, below), _SENT),
                f"grams-{level}",
                **_LARGE_ROWS,
            )
            discard(table, answers)
            made = Level(level, n, np.array(discounts(types)), hot, np.zeros((len(hot), 3)), table=full)
            sums = full.mapInArrow(_hot_sums(made.numbers()), "at long, seen double, m double, below double")
            for row in sums.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("seen", "m", "below")]).collect():
                made.weights[row.at] = row.seen, row.m, row.below
        levels.append(made)
    return Model(levels, tokens, distinct, float(np.log10(left)))


def _ask(level: Level):
    """Distinct grams of a task's texts, with the texts that have them and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("key").to_numpy()
            for start, stop, texts in _texts(batch):
                w, h, _, doc = token_arrays(texts, level.level)
                order = _near_order(level.level, h, w, doc)
                w, h, doc = w[order], h[order], doc[order]
                one = _edges(w, h, doc)
                count = _runs(one, len(w))
                w, h, doc = w[one], h[one], doc[one]
                numbers, blobs = [], []
                for b, rows in _dealt(_bucket(h, w, level.level, level.hot, level.buckets), level.buckets):
                    at = rows[_edges(h[rows], w[rows])]
                    grams = _runs(_edges(h[rows], w[rows]), len(rows))
                    edge = _edges(h[at])
                    asking, place = np.unique(doc[rows], return_inverse=True)
                    parts = (_planes(h[at][edge]), _runs(edge, len(at)), _planes(w[at]), grams, place, count[rows])
                    numbers.append(b)
                    blobs.append(_pack(own[start:stop][asking], *parts))
                yield from _rows(numbers, blobs).to_batches()

    return run


def _score(level: Level, tokens: int, types: int, unknown: float):
    """Sums of the texts over one bucket, packed by part of the texts' keys: a row for each part, not for each text."""
    n = level.buckets

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        reader = _Reader(right, level)
        keys, sums = [np.zeros(0, np.int64)], [[np.zeros(0)] for _ in range(4)]
        for texts, h, contexts, w, grams, place, count in _blobs(left):
            h, w = np.repeat(_from_planes(h), contexts), _from_planes(w)
            at, there = reader.find(h, w)
            at = at[there]
            values = [np.zeros(len(w)) for _ in range(4)]
            if level.level == 1:
                c = np.zeros(len(w))
                c[there] = reader.grams.r[at]
                values[0][:] = unknown
                values[0][there] = reader.log_p[at]
                values[1] = np.log10((c + 0.1) / (tokens + 0.1 * (types + 1)))
                values[2] = there.astype(float)
                values[3] = np.ones(len(w))
            else:
                values[0] = reader.backoff(h)
                values[0][there] = reader.log_p[at] - reader.below[at]
            keys.append(texts.astype(np.int64))
            for out, v in zip(sums, values):
                out.append(np.bincount(place, np.repeat(v, grams) * count, len(texts)))
        keys, sums = np.concatenate(keys), [np.concatenate(s) for s in sums]
        keys, place = np.unique(keys, return_inverse=True)
        sums = [np.bincount(place, s, len(keys)) for s in sums]
        whole = [sums[2].astype(np.int64), sums[3].astype(np.int64)]
        base = sums[1] if level.level == 1 else np.zeros(len(keys), np.int64)
        blobs = [(p, _pack(keys[i], sums[0][i], base[i], whole[0][i], whole[1][i])) for p, i in _dealt(np.mod(keys, n), n)]
        return _rows([p for p, _ in blobs], [b for _, b in blobs])

    return run


def _add(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of the texts of one part over all buckets and levels."""
    found = _blobs(table)
    keys, place = np.unique(np.concatenate([f[0] for f in found]).astype(np.int64), return_inverse=True)
    sums = [np.bincount(place, np.concatenate([f[i] for f in found]), len(keys)) for i in (1, 2, 3, 4)]
    columns = [pa.array(keys), pa.array(sums[0]), pa.array(sums[1]), *[pa.array(s.astype(np.int64)) for s in sums[2:]]]
    return pa.Table.from_arrays(columns, names=["key", "score", "base", "known", "n"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: tokens, known tokens, and log10 probability of the text by the smoothed words alone and by the model."""
    key = F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))
    rows = docs.select(key.alias("key"), "text")
    sums = None
    for turn in range(ROUNDS):  # one after the other: the questions of one round are gone before the next one's are written
        part = rows.where(F.pmod("key", F.lit(ROUNDS)) == turn)
        for level in model.levels:
            run = _score(level.numbers(), model.tokens, model.types, model.unknown)
            asked = part.mapInArrow(_ask(level.numbers()), _BLOBS).groupBy("bucket")
            found = asked.cogroup(level.table.select("bucket", "blob").groupBy("bucket")).applyInArrow(run, _BLOBS)
            added = stored(
                found.groupBy("bucket").applyInArrow(_add, "key long, score double, base double, known long, n long"), "sums"
            )
            sums = added if sums is None else sums.union(added)
    sums = sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("score", "base", "known", "n")])
    # equal rows share a key: their sums are shared out again
    ids = docs.select(F.col("doc_id"), key.alias("key"))
    copies = ids.groupBy("key").agg(F.count("*").alias("copies"), F.first("doc_id").alias("doc_id"))
    joined = copies.join(sums, "key")

    def each(c: str) -> Column:
        return F.col(c) / F.col("copies")

    return joined.select(
        "doc_id",
        each("n").cast("long").alias("n_tokens"),
        each("known").cast("long").alias("n_known"),
        each("base").alias("base_score"),
        each("score").alias("score"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Learn from the texts that are not held out, and score all."""
    docs = docs.select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))), order)
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
