"""Fuzzy line deduplication: one occurrence of every group of equal and similar lines stays.

Lines are normalised (case, white space and ASCII punctuation do not count) and equal ones become one class. Classes meet
under the pigeonhole keys of `line_keys`, which hold every pair of the promised edit similarity (one minus edits over the
longer length, in words; in code points where a line has fewer than three words). Pairs whose sizes and signatures leave it
possible are verified, and of each connected group the first occurrence (by document id, then line) is kept.

SimHash blocks are not used: they cannot promise the pair, as one changed word of ten leaves no block of 32 bits as it
was in nine lines of ten.

A key that only one line has cannot link. Each task deals its keys out to buckets, packed, with the size and a signature
of 64 bits of each line, and the number of buckets follows the size of the texts. A bucket compares all lines of a key
that up to ALL_PAIRS lines have, and writes the pairs that sizes and signatures leave possible, and no other row. Keys of
more lines are written as rows and compared with leaders first. Of a key that a piece of text has more than PIECE_ROWS
times, the bucket gets one line from that piece, and the rest stays spread: no bucket gets all of a very common key.

Cases: a null text has no lines and stays null. Blank lines, and those of punctuation only, are left alone.
Rows with one id and text count as one document. Null ids come last in the order. A document of which every line with
words was dropped keeps its blank lines only. Extra columns pass unchanged. Empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.llm import line_keys, linking, words
from loglathe.llm.linking import stored

MIN_WORDS = 3  # lines with fewer are compared by code points
SIMILARITY = 0.8  # least edit similarity of linked lines
BUCKET_BYTES = 8 << 20  # text whose keys one bucket holds, about 12 MB of keys, ids, sizes and signatures
PIECE_ROWS = 8  # lines of a key that one piece of text sends to its bucket; of a key with more it sends one
ALL_PAIRS = 64  # lines of a key up to which all of them are compared in its bucket
KEY_BITS = 40  # of a key inside its bucket; two keys that clash only bring lines together that are then compared
TASK_BYTES = 8 << 20  # text whose keys are dealt out in one go
MARKS = [f"m{i}" for i in range(line_keys.MARKS)]  # columns of a line's signature

_NORMAL = words.LOWER.copy()
_NORMAL[[c for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123)]] = 32


def normalised(line: bytes) -> bytes:
    return b" ".join(_NORMAL[np.frombuffer(line, dtype=np.uint8)].tobytes().split())


class Lines:
    """Lines of several texts, with hash and word count."""

    def __init__(self, texts: list[bytes]):
        split = [t.split(b"\n") for t in texts]
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        lines = [line for text in split for line in text]
        clean = _NORMAL[np.frombuffer(b"\n".join(lines), dtype=np.uint8)]
        ends = np.cumsum([len(line) + 1 for line in lines]) - 1
        raw = clean.tobytes()
        self.lines = [raw[a:b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist())]
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.number = np.arange(len(lines)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found = words.find_words(self.lines)
        hashes = words.word_hashes(found)
        self.counts, self.first, self.hashes = found.counts, found.first, hashes
        self.ids = self._ids(hashes, found)

    @staticmethod
    def _ids(hashes: np.ndarray, found: words.Words) -> np.ndarray:
        """64-bit hash of the sequence of words of each line."""
        counts = found.counts
        place = np.arange(len(hashes)) - found.first[:-1][found.doc]
        power = words._powers(0xD6E8FEB86659FD93, int(counts.max(initial=0)) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power[place])])
        sums = total[found.first[1:]] - total[found.first[:-1]]
        return words.mix(sums + counts.astype(np.uint64)).view(np.int64)


def _mark(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity signature of 64 bits of each line: that of `line_keys`, folded."""
    ones = np.uint64(1) << (symbols >> np.uint64(3) & np.uint64(63))
    return np.bitwise_xor.reduceat(ones, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, np.uint64)


def _hash_of_text(column: str = "text"):
    return F.xxhash64(F.col(column))


def _place():
    """Order of occurrences: document id (null last), text, line."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "line")


def _symbols(hashes: np.ndarray) -> np.ndarray:
    """One code point for each word or code point, from 20 bits of its hash, so that an edit of a word is an edit of one symbol."""
    return (np.uint64(0x10000) + (hashes & np.uint64(0xFFFFF))).astype("<u4")


def _code_points(line: bytes) -> str:
    return b" ".join(line.split()).decode()


def _sequences(found: Lines) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, ids, symbols, sizes) of the distinct lines, of words and of code points."""
    once = np.unique(found.ids, return_index=True)[1]
    rows = np.sort(once[found.counts[once] >= MIN_WORDS])
    sizes = found.counts[rows]
    take = np.repeat(found.first[rows], sizes) + line_keys._spread(sizes)
    yield 0, found.ids[rows], found.hashes[take], sizes
    rows = np.sort(once[(found.counts[once] > 0) & (found.counts[once] < MIN_WORDS)])
    points = [np.frombuffer(_code_points(found.lines[i]).encode("utf-32-le"), dtype="<u4") for i in rows.tolist()]
    symbols = words.mix(np.concatenate([np.zeros(0, np.uint32), *points]).astype(np.uint64) + np.uint64(1 << 40))
    yield 1, found.ids[rows], symbols, np.fromiter(map(len, points), dtype=np.int64, count=len(points))


GRAM_TIMES = 6  # times from which a task tells how often it has a gram, at least, and in terms of the mean of all
GRAM_MEANS = 4


def _read_lines(docs: DataFrame) -> DataFrame:
    """Every line with a word: where it is, and the hash of its normalised form (id); and how common symbols and grams are.

    Rows with `at` are counts `n`: of symbols by the upper bits of their hashes, and beyond SKETCH of grams by those of
    theirs, as far as a task has them often. Equal lines of one piece of text count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "line", "id", "at", "n"]
        symbols = np.zeros(line_keys.SKETCH, dtype=np.int64)
        grams = np.zeros(1 << line_keys.GRAM_BITS, dtype=np.int64)
        for batch in batches:
            texts = words.as_bytes(batch.column("text"))
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            seen = [np.zeros(0, np.int64)]
            for start, stop in words.pieces(map(len, texts)):
                found = Lines(texts[start:stop])
                for kind, _, own, sizes in _sequences(found):
                    symbols += np.bincount((own >> np.uint64(48)).astype(np.int64), minlength=line_keys.SKETCH)
                    seen.append(line_keys.grams(own, sizes, kind))
                used = np.flatnonzero(found.counts > 0)
                doc, nothing = pa.array(found.doc[used] + start), pa.nulls(len(used), pa.int64())
                columns = [ids.take(doc), hashes.take(doc), pa.array(found.number[used].astype(np.int32)), pa.array(found.ids[used])]
                yield pa.RecordBatch.from_arrays([*columns, nothing, nothing], names=names)
            grams += np.bincount(np.concatenate(seen), minlength=len(grams))
        often = max(GRAM_TIMES, GRAM_MEANS * int(grams.sum()) / len(grams))
        at, held = np.flatnonzero(symbols), np.flatnonzero(grams >= often)
        both = [pa.array(np.concatenate([at, held + line_keys.SKETCH])), pa.array(np.concatenate([symbols[at], grams[held]]))]
        nothing = [pa.nulls(len(both[0]), kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*nothing, *both], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _hash_of_text().alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, line int, id long, at long, n long")


def _common(lines: DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Ranks of all symbols, and (at, rank) of the common grams, from the counts of `_read_lines`."""
    counted = lines.where("at is not null").groupBy("at").agg(F.sum("n").alias("n"))
    counted = counted.where((F.col("at") < line_keys.SKETCH) | (F.col("n") >= ALL_PAIRS)).toArrow()  # a row per place of two fixed tables
    at, n = (counted.column(c).to_numpy() for c in ("at", "n"))
    few = at < line_keys.SKETCH
    counts = np.zeros(line_keys.SKETCH, dtype=np.int64)
    counts[at[few]] = n[few]
    return line_keys.ranks(counts), ((at[~few] - line_keys.SKETCH).astype(np.int32), line_keys.ranks(n[~few]).astype(np.uint16))


def _once_per_key(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Distinct (key, id), ordered, as positions."""
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, dtype=bool)
    same[1:-1] = k[1:] == k[:-1]
    tied = np.flatnonzero(same[1:] | same[:-1])  # most keys are there once, so only the others are ordered by id
    rows = order[tied]
    order[tied] = rows[np.lexsort((ids[rows], key[rows]))]
    i = ids[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = ~same[1:-1] | (i[1:] != i[:-1])
    return order[new]


def _runs(key: np.ndarray) -> np.ndarray:
    """Rows of each of the ordered keys."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return np.diff(np.append(np.flatnonzero(new), len(key)))


def _packed(rest: np.ndarray, ids: np.ndarray, sizes: np.ndarray, marks: np.ndarray, many: np.ndarray) -> bytes:
    """Rows in order of their keys: steps between keys byte by byte, as the upper bytes are zeros that the shuffle compresses."""
    steps = np.diff(rest, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
    low = np.minimum(sizes, 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2)
    return b"".join([steps.T.tobytes(), many.astype(np.uint8).tobytes(), low.T.tobytes(), ids.tobytes(), marks.tobytes()])


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    raw, width = np.frombuffer(blob, dtype=np.uint8), KEY_BITS // 8
    m = len(raw) // (width + 19)
    steps = np.zeros((m, 8), dtype=np.uint8)
    steps[:, :width] = raw[: width * m].reshape(width, m).T
    many, low, high = raw[width * m : (width + 3) * m].reshape(3, m)
    ids, marks = raw[(width + 3) * m :].reshape(2, 8 * m)
    rest = np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)
    return rest, ids.view(np.int64), low + (high.astype(np.int64) << 8), marks.view(np.uint64), many.astype(bool)


def _all_pairs(last: np.ndarray, sizes: np.ndarray, marks: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) with i < j <= last[i] whose sizes and signatures leave the similarity possible."""
    i, apart = np.arange(len(last)), 0
    while len(i):
        apart += 1
        i = i[i + apart <= last[i]]
        j = i + apart
        edits = ((1 - similarity + 1e-9) * np.maximum(sizes[i], sizes[j])).astype(np.int64)
        longer = np.abs(sizes[i] - sizes[j])
        near = (longer <= edits) & (np.bitwise_count(marks[i] ^ marks[j]) + longer <= 2 * edits)
        yield i[near], j[near]


_FOUND = "key long, id long, other long"  # a line of a key with many, or (no key) two lines that may be similar


def _rows(key: np.ndarray | None, ids: np.ndarray, other: np.ndarray | None = None) -> pa.Table:
    nothing = pa.nulls(len(ids), pa.int64())
    columns = [nothing if key is None else pa.array(key), pa.array(ids), nothing if other is None else pa.array(other)]
    return pa.Table.from_arrays(columns, names=["key", "id", "other"])


def _met(similarity: float, n: int):
    """What meets in one bucket; buckets below 0 hold lines of keys with many, and no other."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, blobs = key[0].as_py(), table.column("blob").to_pylist()
        if bucket < 0:
            k, i = np.concatenate([np.frombuffer(blob, dtype=np.int64).reshape(2, -1) for blob in blobs], axis=1)
            rows = _once_per_key(k, i)
            return _rows(k[rows], i[rows])
        rest, ids, sizes, marks, many = (np.concatenate(c) for c in zip(*map(_unpacked, blobs)))
        common = np.unique(rest[many])
        rows = _once_per_key(rest, ids)
        rest, ids, sizes, marks = rest[rows], ids[rows], sizes[rows], marks[rows]
        runs = _runs(rest)
        held = np.repeat(runs, runs)
        many = (held > ALL_PAIRS) | np.isin(rest, common)
        written = _rows((rest[many] * np.uint64(n) + np.uint64(bucket)).view(np.int64), ids[many])
        last = np.repeat(np.cumsum(runs) - 1, runs)
        few = np.flatnonzero(~many & (held > 1))
        last, ids = np.searchsorted(few, last[few]), ids[few]  # keys are there whole
        pairs = list(_all_pairs(last, sizes[few], marks[few], similarity))
        i, j = (np.concatenate([ids[p[side]] for p in pairs] or [np.zeros(0, np.int64)]) for side in (0, 1))
        low, high = np.minimum(i, j), np.maximum(i, j)
        rows = _once_per_key(low, high)
        return pa.concat_tables([written, _rows(None, low[rows], high[rows])])

    return run


def _similar_keys(docs: DataFrame, similarity: float, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, id) of the keys that many classes share, and (a, b) of the other classes that share a key and may be similar.

    `lines`, those of `docs` as `_read_lines` gives them, should be stored.
    """
    if similarity < line_keys.LEAST_SIMILARITY:
        raise ValueError(f"similarity below {line_keys.LEAST_SIMILARITY}")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    common, (places, ranks) = _common(_read_lines(docs.select(F.lit(None).alias("doc_id"), "text")) if lines is None else lines)
    n = 1 + size // BUCKET_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_grams = np.zeros(1 << line_keys.GRAM_BITS, dtype=np.uint16)
        common_grams[places] = ranks
        for batch in batches:
            texts = words.as_bytes(batch.column("text"))
            for start, stop in words.pieces(map(len, texts), TASK_BYTES):
                parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
                for low, high in words.pieces(map(len, texts[start:stop])):
                    for kind, ids, symbols, sizes in _sequences(Lines(texts[start + low : start + high])):
                        line, found = line_keys.keys(symbols, sizes, kind, similarity, common, common_grams)
                        mark = _mark(symbols, sizes)
                        parts.append((found, ids[line], sizes[line], mark[line]))
                key, own, sizes, marks = (np.concatenate(c) for c in zip(*parts))
                rows = _once_per_key(key, own)
                key, own, sizes, marks = key[rows], own[rows], sizes[rows], marks[rows]
                bucket, rest = (key % np.uint64(n)).astype(np.int64), key >> np.uint64(64 - KEY_BITS)
                runs = _runs(key)
                many = np.repeat(runs > PIECE_ROWS, runs)
                numbers, blobs = [], []
                if many.any():
                    whole = (rest[many] * np.uint64(n) + bucket[many].astype(np.uint64)).view(np.int64)
                    numbers.append(-1 - int(words.mix(key[many][:1])[0] % np.uint64(n)))
                    blobs.append(whole.tobytes() + own[many].tobytes())
                sent = np.flatnonzero(~many | (line_keys._spread(runs) == 0))
                sent = sent[np.argsort(bucket[sent], kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(bucket[sent], minlength=1))])
                for b in np.flatnonzero(np.diff(ends)).tolist():
                    at = sent[ends[b] : ends[b + 1]]
                    numbers.append(b)
                    blobs.append(_packed(rest[at], own[at], sizes[at], marks[at], many[at]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers, type=pa.int64()), pa.array(blobs, type=pa.binary())], names=["bucket", "blob"]
                )

    dealt = docs.select("text").mapInArrow(run, "bucket long, blob binary")
    met = stored(dealt.groupBy("bucket").applyInArrow(_met(similarity, n), _FOUND), "met")
    shared = stored(met.where("key is not null").select("key", "id").distinct(), "shared")
    pairs = stored(met.where("key is null").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct(), "met-pairs")
    linking.discard(met)
    return shared, pairs


def _lines(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Size, signature and symbols of each of the given classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.as_bytes(batch.column("text"))
            for start, stop in words.pieces(map(len, texts)):
                for kind, own, symbols, sizes in _sequences(Lines(texts[start:stop])):
                    marks = line_keys.signatures(symbols, sizes)
                    ends = np.cumsum(sizes).tolist()
                    raw = _symbols(symbols).tobytes()
                    line = [raw[4 * a : 4 * b].decode("utf-32-le") for a, b in zip([0, *ends[:-1]], ends)]
                    columns = [pa.array(c) for c in (own, sizes.astype(np.int32), *marks)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(line, type=pa.string())], names=["id", "n", *MARKS, "line"])

    found = docs.select("text").mapInArrow(run, f"id long, n int, {', '.join(f'{c} long' for c in MARKS)}, line string")
    # the ids grow with the table, so they are never broadcast, however few they are now
    return stored(found.join(ids.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "lines")


def _possible(similarity: float):
    """Whether sizes and signatures of x and y leave the promised similarity possible, and the bits that differ."""
    edits = F.floor(F.lit(1 - similarity + 1e-9) * F.greatest("x.n", "y.n"))
    flipped = sum(F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in MARKS)
    longer = F.abs(F.col("x.n") - F.col("y.n"))
    # each edit takes, adds or changes a symbol: those on one side only and those on the other are half of both and what differs
    return (longer <= edits) & (flipped + longer <= 2 * edits), flipped


LEADERS = 8  # of a key, with which the rows outside its largest group are compared before all others


def _largest(marked: DataFrame) -> DataFrame:
    """(key, main): the largest group of the keys whose rows are in several."""
    counts = marked.groupBy("key", "group").agg(F.count("*").alias("n"))
    # the pair of a key of two rows is one of the first round, if it may link at all
    return (
        counts.groupBy("key")
        .agg(F.max(F.struct("n", "group")).alias("most"), F.count("*").alias("groups"), F.sum("n").alias("rows"))
        .where("groups > 1 and rows > 2")
        .select("key", F.col("most.group").alias("main"))
    )


def _links(keys: DataFrame, met: DataFrame, infos: DataFrame, verify, similarity: float) -> DataFrame:
    """Links (a, b) whose groups are those of all links between rows that share a key or are a pair of `met`.

    First a row is compared only with one leader of each of its keys, any row that differs from key to key, then those
    outside the largest group of a key with LEADERS rows of that group. At the end, of keys whose rows are still in
    different groups, the rows outside the largest group are compared with all others that may be similar.
    """
    possible, flipped = _possible(similarity)
    x = infos.select(F.col("id").alias("a"), F.col("info").alias("x"))
    y = infos.select(F.col("id").alias("b"), F.col("info").alias("y"))
    links, groups = None, None
    marked = keys.withColumn("group", F.col("id"))
    for turn in range(2):
        leader = F.min(F.struct(F.xxhash64("key", "id", F.lit(turn)), "id"))["id"].alias("b")
        if groups is None:
            top = marked.groupBy("key").agg(leader)
            pairs = marked.join(top, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct().union(met)
        else:
            sided = marked.join(_largest(marked), "key")
            top = sided.where("group = main").groupBy("key", F.pmod(F.xxhash64("id", "key"), F.lit(LEADERS)).alias("slot")).agg(leader)
            pairs = sided.where("group <> main").join(top, "key").select(F.col("id").alias("a"), "b").distinct()
        near = stored(pairs.join(x, "a").join(y, "b").where(possible).select("a", "b", flipped.alias("apart")), "near")
        best = near.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best"))
        pairs = stored(best.select("a", F.col("best.b").alias("b")), "pairs")
        found = verify(pairs)
        extended = stored(found if links is None else links.union(found), "links")
        group = linking.components(extended).withColumnRenamed("component", "group")
        again = keys.join(group, "id", "left").select("key", "id", F.coalesce("group", "id").alias("group"))
        again = stored(again, "marked")
        linking.discard(pairs, found, *([] if links is None else [links, marked, groups, near]))
        possible_first = near if links is None else possible_first
        links, marked, groups = extended, again, group
    mixed = marked.join(_largest(marked), "key").distinct().join(infos, "id")
    mixed = stored(mixed.select("key", "id", "group", "main", "info"), "mixed")
    rest = mixed.where("group <> main").select("key", F.col("id").alias("a"), F.col("info").alias("x"), "group", "main")
    others = mixed.select("key", F.col("id").alias("b"), F.col("info").alias("y"), F.col("group").alias("other"))
    pairs = rest.join(others, "key").where("group <> other and (other = main or a < b)").where(possible)
    apart = possible_first
    for c in ("a", "b"):
        own = groups.select(F.col("id").alias(c), F.col("group").alias(f"_{c}"))
        apart = apart.join(own, c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    pairs = pairs.select("a", "b").union(apart.where("_a <> _b").select("a", "b"))
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    linking.discard(marked, groups, mixed, possible_first)
    found = verify(pairs)
    everything = stored(links.union(found), "links")
    linking.discard(links, found, pairs)
    return everything


def _verify(lines: DataFrame, similarity: float):
    a = lines.select(F.col("id").alias("a"), F.col("line").alias("p"))
    b = lines.select(F.col("id").alias("b"), F.col("line").alias("q"))

    def run(pairs: DataFrame) -> DataFrame:
        longest = F.greatest(F.length("p"), F.length("q"))
        allowed = F.floor(F.lit(1 - similarity + 1e-9) * longest).cast("int")
        # most true pairs differ in little: a narrow band first, the full one only where that fails
        near = F.expr("levenshtein(p, q, allowed div 16) >= 0 or levenshtein(p, q, allowed) >= 0")
        both = pairs.join(a, "a").join(b, "b").withColumn("allowed", allowed)
        return stored(both.where(near).select("a", "b"), "found")

    return run


def dropped_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, dropped): the numbers, from 0, of the lines that go."""
    found = stored(_read_lines(docs), "read-lines")
    shared, met = _similar_keys(docs, similarity, found)
    ids = shared.select("id").union(met.select("a")).union(met.select("b"))
    lines = _lines(docs, ids.distinct())
    infos = lines.select("id", F.struct("n", *MARKS).alias("info"))
    links = _links(shared, met, infos, _verify(lines, similarity), similarity)
    groups = linking.components(links)
    linking.discard(shared, met, lines, links)
    places = found.where("at is null")
    marked = places.join(groups, "id", "left").withColumn("group", F.coalesce("component", "id"))
    marked = stored(marked.select("doc_id", "text_hash", "line", "group"), "marked")
    linking.discard(groups, found)
    first = marked.groupBy("group").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1")
    rest = marked.join(first, "group").where(~_place().eqNullSafe(F.col("first")))
    gone = stored(rest.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("dropped")), "dropped")
    linking.discard(marked)
    return gone


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the dropped lines, with `n_lines` and `dropped` (line numbers)."""
    own = [c for c in docs.columns if c not in ("n_lines", "dropped")]
    gone = dropped_lines(docs, similarity).select(F.col("doc_id").alias("id"), "text_hash", "dropped")
    # columns of the caller are kept inside one, so that none can clash
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id").cast("long").alias("own_id"), _hash_of_text().alias("hash"))
    joined = rows.join(gone, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left")
    none = F.array().cast("array<int>")
    schema = T.StructType(
        [docs.schema[c] for c in own]
        + [T.StructField("n_lines", T.LongType()), T.StructField("dropped", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            gone = batch.column("dropped").to_pylist()
            for text, numbers in zip(batch.column("text").to_pylist(), gone):
                lines = None if text is None else text.split("\n")
                counts.append(len(lines or []))
                if lines and numbers:
                    out = set(numbers)
                    text = "\n".join(line for i, line in enumerate(lines) if i not in out)
                texts.append(text)
            columns = [pa.array(texts, type=pa.string()) if c == "text" else batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, type=pa.int64()), batch.column("dropped")], names=[*own, "n_lines", "dropped"]
            )

    return joined.select("row.*", F.sort_array(F.coalesce("dropped", none)).alias("dropped")).mapInArrow(run, schema)


def cleaned(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the dropped lines; those of which no word is left go, unless they had none before."""
    had = F.coalesce(F.size("dropped"), F.lit(0)) == 0
    return deduplicated(docs, similarity).where(had | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
