"""Alignment of two tokenizers over the same bytes, and how often their tokens stand for each other.

A text is encoded by a byte-level BPE (A) as space + text, and by a piece BPE (B), which puts the space itself. The byte
offsets at which a token of A and a token of B both end cut the tokens into groups; a token of A and one of B are linked
where their byte ranges overlap. `token_groups` gives groups and links of every text, `with_link_counts` adds what the whole
corpus says about the links: the number of documents that hold the same pair of ids linked.

Inside a task all is Arrow: words are flattened out of lists with their parents, each distinct word is encoded once, ends are
cumulative sums over the token lengths, an Acero join of the (document, end) keys of A and B gives cuts and links at
once, and Table.group_by counts pairs per piece (some MB of text). Spark sums the counts of the pieces, and every piece gets
the answers for its own distinct pairs: what is shuffled for a frequent pair is a row per piece, not per document.

Cases: a text that is null or empty, or whose tokens of A or B do not spell space + text (say because B's model rewrites
it), has no tokens: zeros, an empty `groups`. A text of any length is one row of one piece. Equal texts and repeated rows are documents of their
own in every count. Ties for the best count are all best. Columns of the caller stay; one named like an output column is
replaced. Empty in, empty out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.llm import linking
from loglathe.llm import words as text_words

PIECE_BYTES = 1 << 20  # text aligned at once
KNOWN_WORDS = 1 << 18  # words of at most KNOWN_BYTES that a worker remembers with their ids
KNOWN_BYTES = 64
ID_BITS = 32  # a linked pair is (id of A) << 32 | (id of B)

LINKS = "struct<piece:string,index:array<int>,times:array<int>,pairs:array<bigint>,docs:array<bigint>>"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")

# A space between two characters that are no white space starts a word in both tokenizers. Characters that only one
# of the libraries may take for white space are left inside the words as well.
_ODD = "\\s\u180e\u200b\u2060\ufeff\x1c-\x1f\x85"
_CUT = re.compile(f"(?<=[^{_ODD}]) (?=[^{_ODD}])")
_UNSAFE = re.compile(f" [{_ODD}]|[{_ODD}] |^[{_ODD}]| $")


def default_paths() -> tuple[str, str]:
    """Places of the two models among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def read_models(byte_path: str, piece_path: str) -> tuple[str, bytes]:
    """Both model files (some MB), read once on the driver and sent along with the tasks."""
    with open(byte_path, encoding="utf-8") as a, open(piece_path, "rb") as b:
        return a.read(), b.read()


def _byte_of_sign() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others in order for the characters from U+0100 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Side:
    """One tokenizer: ids of words, and the bytes and the decimal form of every id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]):
        self.encode = encode
        self.bytes = pa.array(tokens, type=pa.binary())
        self.sizes = pc.cast(pc.binary_length(self.bytes), pa.int64())
        self.digits = pa.array([str(i) for i in range(len(tokens))])


_IDS = pa.list_(pa.int32())


class Pair:
    """Both tokenizers, and the words that they have met with their ids."""

    def __init__(self, a: _Side, b: _Side, closed: bool):
        self.sides = a, b
        self.closed = closed  # no token goes on after a later space
        self._forget()

    def _forget(self) -> None:
        self.known, self.lists = pa.array([], pa.string()), [pa.array([], _IDS)] * 2

    def ids(self, units: pa.Array) -> list[pa.ListArray]:
        """Ids of each unit by A and by B; a unit that is known or there twice is encoded once."""
        coded = units.dictionary_encode()
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        at = pc.index_in(coded.dictionary, self.known)
        new = coded.dictionary.filter(pc.is_null(at))
        plain = new.to_pylist()
        known = pa.concat_arrays([self.known, new])
        lists = [pa.concat_arrays([x, pa.array(s.encode(plain), type=_IDS)]) for x, s in zip(self.lists, self.sides)]
        at = pc.take(pc.index_in(coded.dictionary, known), coded.indices)
        found = [x.take(at) for x in lists]
        short = pc.less_equal(pc.binary_length(known), KNOWN_BYTES)
        self.known, self.lists = known.filter(short), [x.filter(short) for x in lists]
        return found


_PAIRS: dict[int, Pair] = {}


def pair_of(byte_json: str, piece_proto: bytes) -> Pair:
    """The tokenizers of this worker."""
    key = hash((byte_json, piece_proto))
    if key not in _PAIRS:
        import sentencepiece
        from tokenizers import Tokenizer

        pa.set_cpu_count(1)  # Spark gives every task one core
        tokenizer = Tokenizer.from_str(byte_json)
        tokenizer.encode_special_tokens = True
        tokenizer.no_truncation()
        tokenizer.no_padding()
        sign = _byte_of_sign()
        names = tokenizer.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            entries[i] = bytes(sign[c] for c in name) if all(c in sign for c in name) else name.encode()
        pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_proto)
        spelled = [
            bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i)
            else pieces.id_to_piece(i).replace("\u2581", " ").encode()
            for i in range(pieces.get_piece_size())
        ]
        # a piece that goes on after a later space would make words depend on each other
        closed = not any("\u2581" in pieces.id_to_piece(i).lstrip("\u2581") for i in range(pieces.get_piece_size()))

        def byte_ids(units: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]

        def piece_ids(units: list[str]) -> list[list[int]]:
            return pieces.encode(units, num_threads=1)

        _PAIRS.clear()
        _PAIRS[key] = Pair(_Side(byte_ids, entries), _Side(piece_ids, spelled), closed)
    return _PAIRS[key]


def _units(texts: list[str], closed: bool) -> pa.ListArray:
    """Each text as words that both tokenizers take one by one, or as one unit."""
    if not closed:
        return pa.array([[t] for t in texts], type=pa.list_(pa.string()))
    if not any(_UNSAFE.search(t) for t in texts):
        return pc.split_pattern(pa.array(texts, type=pa.string()), " ")
    return pa.array([_CUT.split(t) for t in texts], type=pa.list_(pa.string()))


def _spells(side: _Side, ids: np.ndarray, doc: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether the tokens of each text spell it."""
    joined = pc.take(side.bytes, pa.array(ids))
    size = np.bincount(doc, weights=pc.take(side.sizes, pa.array(ids)).to_numpy(), minlength=len(texts)).astype(np.int64)
    want = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = bytes(joined.buffers()[2] or b"")[: int(size.sum())] if len(ids) else b""
    if (size == want).all() and data == b"".join(texts):
        return np.ones(len(texts), dtype=bool)
    end = np.cumsum(size)
    return np.array([s == w and data[e - s : e] == t for s, w, e, t in zip(size, want, end, texts)], dtype=bool)


def _counted(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), type=pa.int32())


def _joined(strings: pa.Array, counts: np.ndarray, sign: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(_offsets(counts), strings), sign)


def align(texts: list[str | None], pair: Pair) -> dict[str, pa.Array]:
    """Counts, groups and links of each text of one piece, and the distinct pairs of the piece.

    `index` are the places of a text's linked pairs among `pairs`, `times` how often it holds each.
    """
    n = len(texts)
    full = [t or "" for t in texts]
    units = _units(full, pair.closed)
    if not all(full):  # nothing is encoded for them
        units = pa.array([u if t else [] for u, t in zip(units.to_pylist(), full)], type=pa.list_(pa.string()))
    spelled = [(" " + t).encode() if t else b"" for t in full]
    parents = pc.list_parent_indices(units)
    sides, good = [], np.array([bool(t) for t in full], dtype=bool)
    for side, lists in zip(pair.sides, pair.ids(units.flatten())):
        doc = pc.take(parents, pc.list_parent_indices(lists)).to_numpy()
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        good &= _spells(side, ids, doc, spelled)
        sides.append((ids, doc))
    tables, kept = [], []
    for name, side, (ids, doc) in zip("ab", pair.sides, sides):
        stays = good[doc]
        ids, doc = ids[stays], doc[stays]
        # the good texts stand one after the other, so an end is the end of a document's token in both tokenizers
        end = np.cumsum(pc.take(side.sizes, pa.array(ids)).to_numpy())
        kept.append((ids, doc, end))
        tables.append(pa.table({"end": end, name: pa.array(ids, type=pa.int64())}))
    ends = tables[0].join(tables[1], "end", join_type="full outer")
    at = ends["end"].to_numpy()
    ends = ends.take(pa.array(np.argsort(at, kind="stable")))
    at = ends["end"].to_numpy()
    size = np.fromiter(map(len, spelled), dtype=np.int64, count=n) * good
    doc = np.searchsorted(np.cumsum(size), at, side="left")
    both = pc.and_(pc.is_valid(ends["a"]), pc.is_valid(ends["b"])).to_numpy()
    cuts, cut_doc = at[both], doc[both]
    linked = pc.bit_wise_or(
        pc.shift_left(pc.fill_null_backward(ends["a"]), pa.scalar(ID_BITS, pa.int64())), pc.fill_null_backward(ends["b"])
    )
    n_groups = _counted(cut_doc, n)
    parts = []
    for side, (ids, _, end) in zip(pair.sides, kept):
        last = np.searchsorted(end, cuts, side="left") + 1
        parts.append(_joined(pc.take(side.digits, pa.array(ids)), np.diff(last, prepend=0), ","))
    groups = _joined(pc.binary_join_element_wise(*parts, "|"), n_groups, ";")

    coded = _whole(linked).dictionary_encode()
    held = pa.table({"doc": pa.array(doc, type=pa.int64()), "index": coded.indices.cast(pa.int32())})
    held = held.group_by(["doc", "index"]).aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("index", "ascending")])
    docs = held.group_by("index").aggregate([([], "count_all")]).sort_by("index")
    per_doc = _offsets(_counted(held["doc"].to_numpy(), n))
    return {
        "n_a": pa.array(_counted(kept[0][1], n)),
        "n_b": pa.array(_counted(kept[1][1], n)),
        "n_groups": pa.array(n_groups),
        "n_links": pa.array(_counted(doc, n)),
        "groups": groups,
        "index": pa.ListArray.from_arrays(per_doc, _whole(held["index"])),
        "times": pa.ListArray.from_arrays(per_doc, _whole(held["count_all"]).cast(pa.int32())),
        "pairs": coded.dictionary,
        "docs": _whole(docs["count_all"]),
    }


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def token_groups(docs: DataFrame, byte_json: str, piece_proto: bytes, text_col: str = "text") -> DataFrame:
    """The rows with n_a, n_b, n_groups, n_links, `groups` (`a1,a2|b1;a3|b2,b3`) and `links`.

    `links` has the linked pairs of the text as places in the list of its piece; the first row of a piece has the list.
    """
    out = [*COUNTS, "groups", "links"]
    kept = [c for c in docs.columns if c not in out]
    schema = T.StructType([docs.schema[c] for c in kept])
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("groups", "string").add("links", T.DataType.fromDDL(LINKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(byte_json, piece_proto)
        piece = 0
        for batch in batches:
            texts = batch.column(text_col)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for start, stop in text_words.pieces(sizes, PIECE_BYTES):
                found = align(texts.slice(start, stop - start).to_pylist(), pair)
                rest = stop - start - 1
                links = pa.StructArray.from_arrays(
                    [
                        pa.array([f"{TaskContext.get().partitionId()}-{piece}"] * (rest + 1)),
                        found["index"],
                        found["times"],
                        pa.array([found["pairs"].to_numpy(), *[None] * rest], type=pa.list_(pa.int64())),
                        pa.array([found["docs"].to_numpy(), *[None] * rest], type=pa.list_(pa.int64())),
                    ],
                    names=["piece", "index", "times", "pairs", "docs"],
                )
                piece += 1
                rows = batch.slice(start, stop - start).select(kept)
                yield pa.RecordBatch.from_arrays([*rows.columns, *[found[c] for c in out[:-1]], links], names=[*kept, *out])
                del found, links
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def link_counts(grouped: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold the pair linked, and whether no pair of its A id is in more."""
    counts = (
        grouped.where("links.pairs is not null")
        .select(F.explode(F.arrays_zip("links.pairs", "links.docs")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair"))
        .agg(F.sum("x.docs").alias("count"))
        .withColumn("a", F.shiftright("pair", ID_BITS))
    )
    # pairs of one id of A are at most as many as B has ids, so this join is not skewed
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_link_counts(grouped: DataFrame) -> DataFrame:
    """The rows of `token_groups`, with n_best (links of a best pair) and count_sum (counts summed over links).

    The rows are written first: pieces are then named once and for all, whatever executor is lost later.
    """
    kept = [c for c in grouped.columns if c not in ("links", "n_best", "count_sum")]
    rows = linking.stored(grouped.select(*kept, "links"), "aligned")
    counts = linking.stored(link_counts(rows), "link-counts")
    asked = rows.where("links.pairs is not null").select("links.piece", F.posexplode("links.pairs").alias("index", "pair"))
    answers = asked.join(counts, "pair").select("piece", "index", "count", "best")
    schema = T.StructType([rows.schema[c] for c in kept]).add("n_best", "long").add("count_sum", "long")

    def add(part: pa.Table, answer: pa.Table) -> pa.Table:
        count = np.zeros(answer.num_rows, dtype=np.int64)
        best = np.zeros(answer.num_rows, dtype=np.int64)
        at = answer["index"].to_numpy()
        count[at] = answer["count"].to_numpy()
        best[at] = answer["best"].cast(pa.int64()).to_numpy()
        links = pa.concat_arrays(part["links"].chunks) if part.num_rows else pa.array([], part["links"].type)
        lists, times = links.field("index"), links.field("times")
        held, times = lists.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        owner = pc.list_parent_indices(lists).to_numpy()
        sums = []
        for values in (best, count):
            total = np.zeros(part.num_rows, dtype=np.int64)
            np.add.at(total, owner, values[held] * times)
            sums.append(pa.array(total))
        part = part.select(kept).append_column("n_best", sums[0])
        return part.append_column("count_sum", sums[1])

    by = rows.withColumn("_piece", F.col("links.piece")).groupBy("_piece")
    return by.cogroup(answers.groupBy("piece")).applyInArrow(add, schema)
