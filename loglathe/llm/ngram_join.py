"""N-gram Jaccard join over prefix trees.

The word 4-grams of a text are hashed and put into one global order: those that are frequent come last, others by hash.
Two sets that are similar enough share an element among the first few of either (its prefix), so sets meet under the
elements of their prefixes only; positions and sizes rule out most of these meetings. The sets that are left are compared
in a prefix tree: the candidates of one probe, sorted, are the tree in depth-first order, where the overlap with the probe
at each depth is kept for the next set to share, and a branch is left as soon as its overlap and what can still follow
cannot reach the threshold.

The frequent elements are only a matter of speed: any fixed order gives the same links.

Cases: a null text is empty; a text without words has the empty set and links with nothing. Rows with one id are one node.
A null id has a null component and no links. Equal sets are one class, compared once. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.llm import linking, words
from loglathe.llm.linking import stored

SHINGLE_WORDS = 4
PERCENT = 85  # 100 * intersection >= PERCENT * union
HOT_DOCUMENTS = 16  # an element at the head of so many texts counts as frequent
HOT_ELEMENTS = 1 << 19  # most frequent elements sent to all tasks: 4 MB
TREE_SETS = 1024  # sets in one tree, about
TREE_PROBES = 256  # probes that go through one tree, about
FAMILY_PART = 512  # sets of a family that are probes, or candidates, of one block, about


def element_sets(texts: list[bytes], k: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of all texts in the global order, and where each text begins."""
    found = words.find_words(texts, lower=True)
    hashes, doc = words.shingle_hashes(words.word_hashes(found), found.first, k)
    hashes >>= np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
        hashes |= (hot[at] == hashes).astype(np.uint64) << np.uint64(63)
    values, doc = words.unique_per_doc(hashes, doc)
    return values, np.searchsorted(doc, np.arange(len(texts) + 1))


def prefix_sizes(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Elements of a set that must hold one of every set similar to it."""
    least = -(-sizes * percent // 100)  # overlap that a set of this size needs at least
    return np.where(sizes > 0, sizes - least + 1, 0)


def needed_overlap(n_a, n_b, percent: int = PERCENT):
    """Least intersection of two sets of these sizes that are similar."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def _digest(data: bytes) -> bytes:
    return hashlib.md5(data).digest()


_PREFIXED = "doc_id long, n_shingles long, digest binary, prefix binary"


def whole_sets(rows: DataFrame, hot: np.ndarray, k: int) -> DataFrame:
    """The rows with the packed set (`data`) in place of `text`."""
    kept = [c for c in rows.columns if c != "text"]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.as_bytes(batch.column("text"))
            for start, stop in words.pieces(map(len, texts)):
                values, first = element_sets(texts[start:stop], k, hot)
                data, at = values.astype(">u8").tobytes(), (first * 8).tolist()
                part = batch.slice(start, stop - start).select(kept)
                sets = pa.array([data[a:b] for a, b in zip(at[:-1], at[1:])], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, sets], names=[*kept, "data"])

    return rows.mapInArrow(run, schema)


def prefixed(docs: DataFrame, hot: np.ndarray, k: int, percent: int) -> DataFrame:
    """Per text: size and digest of its set, and its prefix packed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.as_bytes(batch.column("text"))
            for start, stop in words.pieces(map(len, texts)):
                values, first = element_sets(texts[start:stop], k, hot)
                data = values.astype(">u8").tobytes()
                sizes = np.diff(first)
                take = prefix_sizes(sizes, percent)
                rows = list(zip((first[:-1] * 8).tolist(), (first[1:] * 8).tolist(), (take * 8).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, stop - start).cast(pa.int64()),
                        pa.array(sizes, type=pa.int64()),
                        pa.array([_digest(data[a:b]) for a, b, _ in rows], type=pa.binary()),
                        pa.array([data[a : a + t] for a, _, t in rows], type=pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _PREFIXED)


def frequent_elements(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """Elements at the head (twice the prefix) of many texts, sorted; at most HOT_ELEMENTS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list({t for t in words.as_bytes(batch.column("text"))})
            for start, stop in words.pieces(map(len, texts), 4 * words.PIECE_BYTES):
                values, first = element_sets(texts[start:stop], k, np.zeros(0, dtype=np.uint64))
                sizes = np.diff(first)
                place = np.arange(len(values)) - np.repeat(first[:-1], sizes)
                value, n = np.unique(values[place < np.repeat(2 * prefix_sizes(sizes, percent), sizes)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(n, type=pa.int64())], names=["element", "n"]
                )

    counts = docs.select("text").mapInArrow(run, "element long, n long").groupBy("element").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= HOT_DOCUMENTS).orderBy(F.desc("n"), "element").limit(HOT_ELEMENTS)
    return np.sort(top.select("element").toPandas()["element"].to_numpy(dtype=np.int64).view(np.uint64))


def _exploded(sets: DataFrame) -> DataFrame:
    """(key, id, info) of every element of the prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("prefix").to_pylist()
            for start, stop in words.pieces(map(len, raw)):
                sizes = np.array([len(r) // 8 for r in raw[start:stop]], dtype=np.int64)
                keys = np.frombuffer(b"".join(raw[start:stop]), dtype=">u8").astype(np.uint64).view(np.int64)
                begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                spread = lambda c: np.repeat(batch.column(c).to_numpy()[start:stop], sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys),
                        pa.array(spread("id")),
                        pa.array(spread("n").astype(np.int32)),
                        pa.array((np.arange(len(keys)) - np.repeat(begin, sizes)).astype(np.int32)),
                    ],
                    names=["key", "id", "n", "pos"],
                )

    return sets.select("id", "n", "prefix").mapInArrow(run, "key long, id long, n int, pos int")


def shared_keys(sets: DataFrame) -> DataFrame:
    """The prefix elements that two sets or more have, with (key, id, info)."""
    keys = _exploded(sets)
    twice = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    kept = keys.join(twice, "key", "left_semi")
    return stored(kept.select("key", "id", F.struct("n", "pos").alias("info")), "keys")


def refine(percent: int):
    """Pairs that can be similar, by their sizes and by the positions of what their prefixes share."""

    def run(pairs: DataFrame) -> DataFrame:
        fits = pairs.where(
            (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent) & (F.col("a") != F.col("b"))
        )
        met = fits.groupBy("a", "b").agg(
            F.count("*").alias("score"),
            F.max("x").alias("x"),  # the largest position, as the size is one per set
            F.max("y").alias("y"),
        )
        total = F.col("x.n") + F.col("y.n")
        need = F.ceil(F.lit(percent) * total / F.lit(100 + percent))
        rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) - 1
        return met.where(F.col("score") + rest >= need).select("a", "b", "score")

    return run


class PrefixTree:
    """Sorted candidate sets are a prefix tree in depth-first order; all probes of a block walk it together.

    Along the path to the present set the overlaps with all probes are kept at each element that some probe has. The next
    set goes on from where it leaves that path. A branch is left as soon as no probe's overlap, with all that can still
    follow, reaches what a set of this size needs.
    """

    CHECK = 16  # elements between two looks at the bound

    def __init__(self, probes: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(p) for p in probes], dtype=np.int64)
        values = np.concatenate(probes)
        owner = np.repeat(np.arange(len(probes)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.elements, first = np.unique(values[order], return_index=True)
        self.owners, self.first = owner[order], np.append(first, len(values))
        self.path = np.zeros(0, dtype=np.uint64)
        self.depths, self.overlaps = [0], [np.zeros(len(probes), dtype=np.int32)]
        self.steps = 0  # elements looked at, to see what sharing and leaving early save

    def similar(self, values: np.ndarray) -> np.ndarray:
        """Probes similar to the set, which is the next in the order."""
        n = len(values)
        need = needed_overlap(n, self.sizes, self.percent)
        depth = self._shared(values)
        while self.depths[-1] > depth:
            self.depths.pop()
            self.overlaps.pop()
        overlap = self.overlaps[-1]
        at = np.minimum(np.searchsorted(self.elements, values[depth:]), len(self.elements) - 1)
        hits = np.flatnonzero(self.elements[at] == values[depth:])
        reached = n
        for k, hit in enumerate(hits.tolist()):
            if k % self.CHECK == 0 and not (overlap + (len(hits) - k) >= need).any():
                reached = depth + hit
                break
            element = at[hit]
            overlap = overlap.copy()
            overlap[self.owners[self.first[element] : self.first[element + 1]]] += 1
            self.depths.append(depth + hit + 1)
            self.overlaps.append(overlap)
            self.steps += 1
        self.path = values[:reached]
        return np.flatnonzero(overlap >= need) if reached == n else np.zeros(0, dtype=np.int64)

    def _shared(self, values: np.ndarray) -> int:
        size = min(len(values), len(self.path))
        apart = np.flatnonzero(values[:size] != self.path[:size])
        return int(apart[0]) if len(apart) else size


def _compare(percent: int):
    """Rows come ordered by block; the probes (role 0) of a block stand before its candidates, which are in set order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sets, tree = None, [], [], None
        for batch in batches:
            hits: list[tuple[int, int]] = []
            columns = (batch.column(c).to_pylist() for c in ("deal", "b_part", "a_part", "role", "id", "data"))
            for deal, b_part, a_part, role, own, data in zip(*columns):
                values = np.frombuffer(data, dtype=">u8").astype(np.uint64)
                if (deal, b_part, a_part) != block:
                    block, ids, sets, tree = (deal, b_part, a_part), [], [], None
                if role == 0:
                    ids.append(own)
                    sets.append(values)
                elif sets:
                    tree = tree or PrefixTree(sets, percent)
                    hits += [(own, ids[i]) for i in tree.similar(values).tolist() if ids[i] != own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in hits], type=pa.int64()), pa.array([h[1] for h in hits], type=pa.int64())],
                names=["a", "b"],
            )

    return run


BLOCK = ["deal", "b_part", "a_part"]


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """Links found in blocks of (deal, b_part, a_part, role, id, data)."""
    dealt = rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "role", "data")
    return stored(dealt.mapInArrow(_compare(percent), "a long, b long").distinct(), "found")


def verify_families(docs: DataFrame, hot: np.ndarray, k: int, percent: int):
    """Compares all sets of a family (id, family), in blocks of two parts of bounded size; no pair becomes a row."""

    def run(members: DataFrame) -> DataFrame:
        sizes = members.groupBy("family").agg(F.ceil(F.count("*") / FAMILY_PART).cast("int").alias("parts"))
        parted = stored(
            members.join(sizes, "family").select("id", "family", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")),
            "members",
        )
        asked = docs.join(parted.hint("merge"), F.col("doc_id") == F.col("id")).select("id", "family", "parts", "part", "text")
        sets = whole_sets(asked, hot, k)
        part = F.col("part").cast("int")
        others = F.transform(
            F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != part),
            lambda o: F.struct(
                F.least(part, o).alias("b_part"), F.greatest(part, o).alias("a_part"), F.when(part < o, 0).otherwise(1).alias("role")
            ),
        )
        own = F.array(*[F.struct(part.alias("b_part"), part.alias("a_part"), F.lit(role).alias("role")) for role in (0, 1)])
        rows = sets.select(F.col("family").alias("deal"), "id", "data", F.explode(F.concat(own, others)).alias("at"))
        found = _compared(rows.select("deal", "at.b_part", "at.a_part", "at.role", "id", "data"), percent)
        linking.discard(parted)
        return found

    return run


def verify(docs: DataFrame, hot: np.ndarray, k: int, percent: int):
    """Compares pairs in prefix trees: blocks of bounded size, of probes (b) and of the candidates (a) of their deal."""

    def run(pairs: DataFrame) -> DataFrame:
        def parts(c: str, most: int) -> DataFrame:
            distinct = pairs.select("deal", c).distinct().groupBy("deal").agg(F.count("*").alias("n"))
            return distinct.select("deal", F.ceil(F.col("n") / most).alias(f"{c}_parts"))

        cut = parts("a", TREE_SETS).join(parts("b", TREE_PROBES), "deal")
        dealt = stored(
            pairs.join(cut, "deal").select(
                "deal",
                "a",
                "b",
                F.pmod(F.xxhash64("b"), F.col("b_parts")).alias("b_part"),
                F.pmod(F.xxhash64("a"), F.col("a_parts")).alias("a_part"),
            ),
            "dealt",
        )
        roles = [
            dealt.select("deal", "b_part", "a_part", F.lit(role).alias("role"), F.col(c).alias("id")).distinct()
            for role, c in ((0, "b"), (1, "a"))
        ]
        # the side of the ids grows with the table, so it is never broadcast, however small it is now
        asked = docs.join(roles[0].union(roles[1]).hint("merge"), F.col("doc_id") == F.col("id"))
        rows = whole_sets(asked.select("deal", "b_part", "a_part", "role", "id", "text"), hot, k)
        found = _compared(rows, percent)
        linking.discard(dealt)
        return found

    return run


def joined(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The classes of equal sets (doc_id, n_shingles, class_id) and the links between class ids that make the groups."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hot = frequent_elements(docs, k, percent)
    rows = stored(prefixed(docs, hot, k, percent), "prefixes")
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    sets = filled.groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.first("prefix").alias("prefix")
    )
    sets = stored(sets, "classes")
    classes = stored(
        rows.join(sets.select("digest", "id"), "digest", "left").select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.least("id", "doc_id")).alias("class_id"),
        ),
        "members",
    )
    keys = shared_keys(sets)
    linking.discard(rows, sets)
    links = linking.link_groups(
        keys, refine(percent), verify(docs, hot, k, percent), verify_families(docs, hot, k, percent), rounds=1
    )
    linking.discard(keys)
    return classes, links


def similar_groups(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: the size of its set, its class of equal sets and its component, the smallest id that it reaches."""
    classes, links = joined(docs, k, percent)
    # a document id with several texts is one node: its classes are joined
    own = classes.where("class_id <> doc_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    twice = classes.where("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("class_id").alias("n")).where("n > 1")
    extra = own.join(twice.select(F.col("doc_id").alias("a")), "a", "left_semi")
    groups = linking.components(links.select("a", "b").union(extra))
    return classes.join(groups, classes["class_id"] == groups["id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id"
    )


def one_per_group(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents with the smallest id of their group; of rows that share this id one is kept. Null ids are all kept."""
    groups = similar_groups(docs, k, percent).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(groups, "doc_id", "left_semi")
    once = kept.dropDuplicates(["doc_id"])
    return once.select(*docs.columns).union(docs.where("doc_id is null"))
