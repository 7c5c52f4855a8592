"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Many words are merged at once in flat numpy arrays: a symbol array, the rank of each symbol's pair with the symbol to its
right, and where each word begins. A round takes the least rank of every word, merges all its leftmost places up to the
first one whose new pairs would come before the rest, drops merged symbols, and sets finished words aside, until no pair
remains. A text is cut where no piece of the vocabulary can reach over, and each distinct part is merged once per task.

Ids are kept packed, as little-endian unsigned 32-bit integers in a binary column.

Cases: a null text is empty; the empty text has only the begin and end ids and decodes to itself. Null ids decode to the
empty text. Repeated rows and ties need no care, rows are independent. Other columns of the caller pass unchanged; a
column of the caller named like an output is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.llm import words as text_words

SPACE = "▁"
PLAIN = "\x00"  # marks a part that is given in full
CACHE_WORDS = 120_000  # distinct parts remembered by a task
SLOT_BITS = 18  # size of the pair tables
FAR = np.int64(1 << 40)  # rank of a pair that cannot merge


class PieceModel:
    """Vocabulary of a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        kind = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "" for i in range(size)]
        self.normal = {p: i for i, p in enumerate(pieces) if not kind[i]}
        probe = " a  éﬁ\n"
        if "byte" not in kind or sp.decode(sp.encode(probe)) != probe or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.normal):
            raise ValueError("only BPE models with byte fallback and without text normalisation are supported")
        if any(sp.is_unused(i) for i in range(size)):
            raise ValueError("models with unused pieces are not supported")
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.byte_ids = np.zeros(256, dtype=np.int64)
        self.decoded: list[bytes] = []
        self.is_byte = np.zeros(size, dtype=bool)
        self.is_control = np.zeros(size, dtype=bool)
        for i, p in enumerate(pieces):
            if kind[i] == "byte":
                self.byte_ids[int(p[3:5], 16)] = i
                self.decoded.append(bytes([int(p[3:5], 16)]))
                self.is_byte[i] = True
            elif kind[i] == "control":
                self.decoded.append(b"")
                self.is_control[i] = True
            elif kind[i] == "unknown":
                self.decoded.append(" ⁇ ".encode())
            else:
                self.decoded.append(p.replace(SPACE, " ").encode())
        self.starts_with_space = np.array([not kind[i] and p.startswith(SPACE) for i, p in enumerate(pieces)])
        self._merges(sp)
        alone = [c for c in "\n\t\r" if not any(c in p for p in self.normal)]
        cut = "".join(alone)
        self.parts = re.compile(f"{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+" + (f"|[{cut}]" if cut else ""))
        self.cuts_lines = "\n" in alone
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merges(self, sp) -> None:
        """All pairs of symbols that join to a piece, with rank and joined symbol.

        Symbols are piece ids; a character outside the vocabulary is the symbol `self.unknown`.
        """
        self.unknown = sp.get_piece_size()
        self.width = np.int64(self.unknown + 1)
        scores = {i: sp.get_score(i) for i in self.normal.values()}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        keys, ranks, joined = [], [], []
        for piece, i in self.normal.items():
            for cut in range(1, len(piece)):
                a, b = self.normal.get(piece[:cut]), self.normal.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * int(self.width) + b)
                    ranks.append(rank_of[scores[i]])
                    joined.append(i)
        # pieces of spaces only that all rank the same, behind every other piece: runs of spaces then merge last and alone
        blank = {i: len(p) for p, i in self.normal.items() if not p.strip(SPACE)}
        last = max(ranks, default=0)
        mixed = any(SPACE * 2 in p and p.strip(SPACE) for p in self.normal)
        self.runs_last = not mixed and all((r == last) == (i in blank) for i, r in zip(joined, ranks))
        self.blank_sizes = set(blank.values())
        self.longest_blank = max(self.blank_sizes, default=0)
        self._tables(np.array(keys, dtype=np.int64), np.array(ranks, dtype=np.int64), np.array(joined, dtype=np.int64))
        self.of_char = np.full(0x110000, self.unknown, dtype=np.int32)
        for piece, i in self.normal.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i

    def _tables(self, keys: np.ndarray, ranks: np.ndarray, joined: np.ndarray) -> None:
        """Open tables of the pairs: a key that finds its slot taken goes to the next, smaller table."""
        self.tables = []
        while len(keys):
            slot = self._slot(keys, len(self.tables))
            _, first = np.unique(slot, return_index=True)
            held = np.full(1 << SLOT_BITS, -1, dtype=np.int64)
            rank = np.full(1 << SLOT_BITS, FAR, dtype=np.int64)
            symbol = np.zeros(1 << SLOT_BITS, dtype=np.int64)
            held[slot[first]], rank[slot[first]], symbol[slot[first]] = keys[first], ranks[first], joined[first]
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            full = np.zeros(1 << SLOT_BITS, dtype=bool)
            full[slot[rest]] = True
            self.tables.append((held, rank, symbol, full))
            keys, ranks, joined = keys[rest], ranks[rest], joined[rest]

    @staticmethod
    def _slot(keys: np.ndarray, table: int) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * table & (1 << 64) - 1)
        return (spread >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray, table: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rank (FAR without one) and joined symbol of pairs."""
        key = a * self.width + b
        held, ranks, symbols, full = self.tables[table]
        slot = self._slot(key, table)
        found = held[slot] == key
        rank, symbol = np.where(found, ranks[slot], FAR), symbols[slot]
        if table + 1 < len(self.tables):
            on = np.flatnonzero(full[slot] & ~found)
            if len(on):
                rank[on], symbol[on] = self._pair(a[on], b[on], table + 1)
        return rank, symbol

    def merge_words(self, parts: list[str]) -> list[bytes]:
        """Packed ids of each part."""
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbol = self.of_char[points].astype(np.int64)
        char = np.arange(len(points))  # first character of a symbol, to find it again for byte fallback
        word = np.repeat(np.arange(len(parts)), lengths)
        rank = np.full(len(symbol), FAR)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self._pair(symbol[inside], symbol[inside + 1])[0]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            open_word = least < FAR
            if not open_word.all():  # compaction: finished words leave the arrays
                keep = np.repeat(open_word, size)
                done.append((symbol[~keep], char[~keep]))
                symbol, char, word, rank = symbol[keep], char[keep], word[keep], rank[keep]
                continue
            hit = np.flatnonzero(rank == np.repeat(least, size))
            hit = self._leftmost(hit, symbol, word, rank)
            self._apply(hit, symbol, rank, word)
            stays = np.ones(len(symbol), dtype=bool)
            stays[hit + 1] = False
            symbol, char, word, rank = symbol[stays], char[stays], word[stays], rank[stays]
        symbols = np.concatenate([s for s, _ in done]) if done else np.zeros(0, dtype=np.int64)
        chars = np.concatenate([c for _, c in done]) if done else np.zeros(0, dtype=np.int64)
        order = np.argsort(chars, kind="stable")
        return self._packed(symbols[order], chars[order], points, lengths)

    def _run_sizes(self, n: int) -> list[int]:
        """Sizes of the pieces of n spaces: of pairs that rank the same the leftmost is merged first."""
        held: list[int] = []
        for _ in range(n):
            held.append(1)
            while len(held) > 1 and held[-2] + held[-1] in self.blank_sizes:
                held[-2:] = [held[-2] + held[-1]]
        return held

    def _run(self, n: int) -> bytes:
        """Packed ids of n spaces. A piece of the greatest size is never merged again, so what follows it merges alone."""
        most = self.longest_blank
        whole = self._run_sizes(most) == [most]
        sizes = [most] * (n // most) + self._run_sizes(n % most) if whole else self._run_sizes(n)
        return np.array([self.normal[SPACE * k] for k in sizes], dtype="<u4").tobytes()

    def merge_parts(self, parts: list[str]) -> list[bytes]:
        """Packed ids of each part; of a run of spaces in front only the last merges with the word."""
        if not self.runs_last:
            return self.merge_words(parts)
        spaces = [len(p) - len(p.lstrip(SPACE)) for p in parts]
        ids = self.merge_words([p[max(k - 1, 0) :] for p, k in zip(parts, spaces)])
        one = np.array([self.normal.get(SPACE, 0)], dtype="<u4").tobytes()
        return [
            x if k < 2 else self._run(k) + x[4:] if x[:4] == one else self._run(k - 1) + x for x, k in zip(ids, spaces)
        ]

    def _leftmost(self, hit: np.ndarray, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Places merged in this round: not overlapping, from the left, up to the first whose new pair would go next."""
        run = np.cumsum(np.concatenate([[True], hit[1:] != hit[:-1] + 1])) - 1
        start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        hit = hit[(np.arange(len(hit)) - start[run]) % 2 == 0]
        w = word[hit]
        again = np.concatenate([[False], w[1:] == w[:-1]])
        if not again.any():
            return hit
        now = rank[hit]
        joined = self._pair(symbol[hit], symbol[hit + 1])[1]
        beside = again & np.concatenate([[False], hit[1:] == hit[:-1] + 2])
        left = np.where(beside, np.concatenate([[0], joined[:-1]]), symbol[np.maximum(hit - 1, 0)])
        has_left = (hit > 0) & (word[np.maximum(hit - 1, 0)] == w)
        after = np.minimum(hit + 2, len(symbol) - 1)
        has_right = (hit + 2 < len(symbol)) & (word[after] == w)
        soon = (has_left & (self._pair(left, joined)[0] <= now)) | (has_right & (self._pair(joined, symbol[after])[0] <= now))
        total = np.cumsum(soon) - soon  # such places before this one
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(hit))))
        return hit[total == total[head]]

    def _apply(self, hit: np.ndarray, symbol: np.ndarray, rank: np.ndarray, word: np.ndarray) -> None:
        symbol[hit] = self._pair(symbol[hit], symbol[hit + 1])[1]
        n = len(symbol)
        merged = np.zeros(n + 1, dtype=bool)
        merged[hit] = True
        after = np.minimum(hit + 2, n - 1)
        has_right = (hit + 2 < n) & (word[after] == word[hit])
        rank[hit] = np.where(has_right, self._pair(symbol[hit], symbol[after])[0], FAR)
        before = np.maximum(hit - 1, 0)
        before = np.where((hit > 1) & merged[np.maximum(hit - 2, 0)], hit - 2, before)  # the left one was merged too
        has_left = (hit > 0) & (word[before] == word[hit])
        at = before[has_left]
        rank[at] = self._pair(symbol[at], symbol[hit[has_left]])[0]

    def _packed(self, symbols: np.ndarray, chars: np.ndarray, points: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        word_end = np.searchsorted(chars, np.cumsum(lengths))
        lost = symbols == self.unknown
        if lost.any():
            raw = [chr(p).encode() for p in points[chars[lost]].tolist()]
            count = np.ones(len(symbols), dtype=np.int64)
            count[lost] = [len(r) for r in raw]
            ids = np.repeat(symbols, count)
            ids[np.repeat(lost, count)] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            word_end = np.concatenate([[0], np.cumsum(count)])[word_end]
        else:
            ids = symbols
        data = ids.astype("<u4").tobytes()
        ends = (word_end * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def encode(self, texts: list[str], begin: bool = True, end: bool = True) -> list[bytes]:
        """Packed ids of each text, as the library gives them."""
        split = [self._split(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:  # keep what was used since the last time
            self.older, self.cache = self.cache, {}
        new = []
        for part in set().union(*split) - self.cache.keys():
            ids = self.older.get(part)
            if ids is None:
                new.append(part)
            else:
                self.cache[part] = ids
        for start, stop in text_words.pieces(map(len, new), 1 << 17):
            run = new[start:stop]
            self.cache.update(zip(run, self.merge_parts([p[1:] if p.startswith(PLAIN) else SPACE + p for p in run])))
        head = np.array([self.begin], dtype="<u4").tobytes() if begin else b""
        tail = np.array([self.end], dtype="<u4").tobytes() if end else b""
        get = self.cache.__getitem__
        return [head + b"".join(map(get, parts)) + tail for parts in split]

    def _split(self, text: str) -> list[str]:
        """Parts that merge on their own.

        Where single spaces and line ends part the words, a part is a word without its space mark; all other parts are
        given in full behind PLAIN.
        """
        if not text:
            return []
        if "  " in text or SPACE in text or PLAIN in text or not self.cuts_lines or text[0] == " " or text[-1] == " ":
            return [PLAIN + p for p in self.parts.findall(SPACE + text.replace(" ", SPACE))]
        return text.replace("\n", " " + PLAIN + "\n").split(" ")

    def decode(self, packed: bytes) -> str:
        """Text of packed ids, as the library gives it: invalid bytes become U+FFFD, one dummy space goes."""
        ids = np.frombuffer(packed, dtype="<u4")
        raw = b"".join(map(self.decoded.__getitem__, ids.tolist()))
        shown = np.flatnonzero(~self.is_control[ids])
        skip = int(len(shown) > 0 and self.starts_with_space[ids[shown[0]]])
        try:
            if not self.is_control[ids[1:-1]].any():  # a control piece ends a run of bytes
                return raw.decode()[skip:]
        except UnicodeDecodeError:
            pass
        return self._decode_runs(ids)[skip:]

    def _decode_runs(self, ids: np.ndarray) -> str:
        """Byte pieces are read run by run; each byte that starts no valid character becomes one U+FFFD."""
        out: list[str] = []
        run = b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.decoded[i]
                continue
            if run:
                out.append(_characters(run))
                run = b""
            if i >= 0:
                out.append(self.decoded[i].decode())
        return "".join(out)


def _characters(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_MODELS: dict[int, PieceModel] = {}


def _model(proto: bytes) -> PieceModel:
    """One model, with its memory of words, per Python worker."""
    key = hash(proto)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(proto)
    return _MODELS[key]


def default_path() -> str:
    """Place of the model among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str) -> bytes:
    """The model file (some hundred kB), read once on the driver and sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, proto: bytes, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The rows with the packed ids of their text, begin and end ids included, in `ids_col`."""
    kept = [c for c in docs.columns if c != ids_col]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(proto)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for start, stop in text_words.pieces(len(t or "") for t in texts):
                ids = model.encode([t or "" for t in texts[start:stop]])
                part = batch.slice(start, stop - start).select(kept)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, type=pa.binary())], names=[*kept, ids_col])

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, proto: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the text of their packed ids in `out_col`."""
    kept = [c for c in df.columns if c != out_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(proto)
        for batch in batches:
            ids = batch.column(ids_col).to_pylist()
            for start, stop in text_words.pieces(len(v or b"") for v in ids):
                text = [model.decode(v or b"") for v in ids[start:stop]]
                part = batch.slice(start, stop - start).select(kept)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, type=pa.string())], names=[*kept, out_col])

    return df.mapInArrow(run, schema)


def coded(docs: DataFrame, proto: bytes, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the packed ids of their text and the text that these decode to, as `encode` and then `decode` give them.

    One pass: in a row of two, each task would hold two Python workers, and the model and its memory of words twice.
    """
    kept = [c for c in docs.columns if c not in (ids_col, out_col)]
    more = [T.StructField(ids_col, T.BinaryType()), T.StructField(out_col, T.StringType())]
    schema = T.StructType([docs.schema[c] for c in kept] + more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(proto)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for start, stop in text_words.pieces(len(t or "") for t in texts):
                ids = model.encode([t or "" for t in texts[start:stop]])
                text = [model.decode(v) for v in ids]
                part = batch.slice(start, stop - start).select(kept)
                columns = [*part.columns, pa.array(ids, type=pa.binary()), pa.array(text, type=pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids_col, out_col])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, proto: bytes) -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text, per document."""
    return coded(docs.select("doc_id", "text"), proto).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
