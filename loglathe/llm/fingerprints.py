"""Document fingerprints: a threshold-scaled sketch of the word shingles.

Every shingle hash below a fixed fraction of the hash range is kept, so sketches of any two documents are samples of the
same range: they merge by union, and the share of one sketch found in the other estimates containment, however unequal
the documents are. A document whose shingles all lie above the threshold keeps its smallest hash alone, so that short
texts are still told apart; that hash is used only against another such sketch.

Cases: a null text is empty and has an empty fingerprint. Two empty fingerprints have likeness 1, an empty and another
one 0. Repeated rows each get their own result. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm import words

SHINGLE_WORDS = 5
SCALE = 8  # one hash in so many is kept
HEX = 12  # leading hex digits stored of a hash


class Sketches:
    """Sketches of several texts as flat arrays."""

    def __init__(self, texts: list[bytes], k: int = SHINGLE_WORDS, scale: int = SCALE):
        found = words.find_words(texts, lower=True)
        hashes, doc = words.shingle_hashes(words.word_hashes(found), found.first, k)
        limit = np.uint64((1 << 64) // scale)
        hit = hashes < limit
        self.small = np.bincount(doc[hit], minlength=len(texts)) == 0  # only the least hash, above the threshold
        lone = self.small[doc]
        least = np.full(len(texts), np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(least, doc[lone], hashes[lone])
        held = np.flatnonzero(self.small & (found.counts > 0))
        values, owner = np.concatenate([hashes[hit], least[held]]), np.concatenate([doc[hit], held])
        self.values, self.doc = words.unique_per_doc(values >> np.uint64(64 - 4 * HEX), owner)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def strings(self) -> list[str]:
        digits = self.values.astype(">u8").tobytes().hex()
        whole = np.frombuffer(digits.encode(), dtype="S16") if digits else np.zeros(0, dtype="S16")
        text = b"".join(v[16 - HEX :] for v in whole.tolist()).decode()
        return [text[a * HEX : b * HEX] for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist())]

    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def shared(a: Sketches, b: Sketches) -> np.ndarray:
    """Number of hashes that row i of both have in common."""
    values, doc = np.concatenate([a.values, b.values]), np.concatenate([a.doc, b.doc])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    twice = np.flatnonzero((values[1:] == values[:-1]) & (doc[1:] == doc[:-1]))
    return np.bincount(doc[twice], minlength=len(a.first) - 1)


def likeness(common, size_a, size_b):
    """Jaccard estimate and the containment estimates of both sides in the other; both empty: 1, one empty: 0."""
    union = size_a + size_b - common
    both = union == 0
    jaccard = np.where(both, 1.0, common / np.maximum(union, 1))
    return (
        jaccard,
        np.where(both, 1.0, common / np.maximum(size_a, 1)),
        np.where(both, 1.0, common / np.maximum(size_b, 1)),
    )


def merged(fingerprints: list[str], scale: int = SCALE) -> str:
    """Fingerprint of the union of the documents' shingles."""
    values = sorted({f[i : i + HEX] for f in fingerprints for i in range(0, len(f), HEX)})
    below = [v for v in values if int(v, 16) < 16**HEX // scale]
    return "".join(below or values[:1])


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("containment_edited", pa.float64()),
        ("containment_next", pa.float64()),
    ]
)
OUT_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double,"
    " near_next double, containment_edited double, containment_next double"
)


def _compared(ids: list, texts: list[str]) -> pa.RecordBatch:
    """One row for each text but the last, against the one that follows it."""
    count = len(texts) - 1
    changed = [edited(texts[i], texts[i + 1]) for i in range(count)]
    own = Sketches([t.encode() for t in texts])
    raw = [t.encode() for t in changed]
    new = Sketches(raw)
    head = _rows(own, 0, count)
    near_edited, contained, _ = likeness(shared(head, new), head.sizes(), new.sizes())
    following = _rows(own, 1, count + 1)
    near_next, contained_next, _ = likeness(shared(head, following), head.sizes(), following.sizes())
    columns = [
        ids[:count],
        [len(t) for t in texts[:count]],
        [hashlib.sha256(t).hexdigest() for t in raw],
        head.strings(),
        new.strings(),
        near_edited,
        near_next,
        contained,
        contained_next,
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _OUT)], schema=_OUT)


def _rows(s: Sketches, start: int, stop: int) -> Sketches:
    part = object.__new__(Sketches)
    low, high = s.first[start], s.first[stop]
    part.values, part.doc = s.values[low:high], s.doc[low:high] - start
    part.first = s.first[start : stop + 1] - low
    part.small = s.small[start:stop]
    return part


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by bucket; the row after a bucket's own rows (kind 1) only serves as the next one."""
    held: tuple | None = None  # bucket, id, text of the last row, still without its next
    for batch in batches:
        bucket = batch.column("bucket").to_pylist()
        kind = batch.column("kind").to_pylist()
        ids = batch.column("id").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        sizes = [len(t) for t in texts]
        for start, stop in words.pieces(sizes):
            run_ids, run_texts = ([held[1]], [held[2]]) if held else ([], [])
            last = held[0] if held else None
            for i in range(start, stop):
                if bucket[i] != last and run_ids:
                    if len(run_ids) > 1:
                        yield _compared(run_ids, run_texts)
                    run_ids, run_texts = [], []
                if kind[i] and not run_ids:  # a second look-ahead row, or one of another bucket
                    last = bucket[i]
                    continue
                last = bucket[i]
                run_ids.append(ids[i])
                run_texts.append(texts[i])
                if kind[i]:
                    yield _compared(run_ids, run_texts)
                    run_ids, run_texts = [], []
            held = (last, run_ids[-1], run_texts[-1]) if run_ids else None
            if len(run_ids) > 1:
                yield _compared(run_ids, run_texts)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edited form, and their likeness to the text and to the next one.

    The next one is the row with the next smaller id, after the last the first; rows with one id follow each other by
    text, null ids come last. Rows are cut into ranges of ids (at most `buckets`, by quantiles of the ids alone), and the
    first row of a range is also sent to the range before it, so the texts are shuffled once and no order over all rows
    is built in one task.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = _bounds(rows, buckets)
    bucket = _bucket(F.col("id"), bounds)
    heads = rows.groupBy(bucket.alias("bucket")).agg(F.max("id").alias("id")).orderBy("bucket").collect()  # <= buckets rows
    order = [h.bucket for h in heads]
    ahead = [(h.id, order[k - 1]) for k, h in enumerate(heads)] or [(None, 0)]
    ahead_df = spark.createDataFrame(ahead, "head long, before int")
    sent = rows.join(F.broadcast(ahead_df), F.col("id").eqNullSafe(F.col("head")), "left").select(
        "id",
        "text",
        F.explode(
            F.filter(
                F.array(
                    F.struct(bucket.alias("bucket"), F.lit(0).alias("kind")),
                    F.struct(F.col("before").alias("bucket"), F.lit(1).alias("kind")),
                ),
                lambda x: x["bucket"].isNotNull(),
            )
        ).alias("at"),
    )
    sent = sent.select(F.col("at.bucket").alias("bucket"), F.col("at.kind").alias("kind"), "id", "text")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket", "kind", F.col("id").desc_nulls_last(), "text")
    return dealt.mapInArrow(_walk, OUT_DDL)


def _bounds(rows: DataFrame, buckets: int) -> list[int]:
    """At most `buckets` ascending ids that cut the ids into even ranges."""
    steps = [k / buckets for k in range(1, buckets)] or [0.5]
    got = rows.agg(F.percentile_approx("id", steps, 20 * buckets).alias("at")).first()["at"]
    return sorted(set(got or [0]))


def _bucket(id_column, bounds: list[int]):
    """Number of the range of an id, by descending id; null ids come last. Two steps of about sqrt(n) comparisons."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    firsts = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    parts = F.array(*[F.array(*[F.lit(v).cast("long") for v in g]) for g in groups])
    group = F.size(F.filter(firsts, lambda b: b <= id_column))  # groups that begin at or below the id
    inside = F.size(F.filter(F.element_at(parts, F.greatest(group, F.lit(1))), lambda b: b <= id_column))
    place = F.when(group == 0, 0).otherwise((group - 1) * step + inside)
    return F.when(id_column.isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - place).cast("int")
