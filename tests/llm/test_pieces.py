import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from loglathe.llm import pieces

PATH = pieces.default_path()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.read_model(PATH))


def _samples():
    r = random.Random(3)
    parts = ["a", "b", "aa", "ab", "the", "in", " ", "  ", "▁", "\n", "\t", "\r", "é", "中", "😀", "\x00", "ing", "==", "<s>", "<0x0A>", "ⁿ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(r.choice("aeinrst") for _ in range(r.randint(0, 2000))) for _ in range(60)]
    return texts + ["", " ", "a" * 1000, " " * 999, "ab" * 3000, "x" * 40000, " \n ", "\n", "word " * 4000]


def test_same_ids_as_the_library(model, library):
    texts = _samples()
    for text, got in zip(texts, model.encode(texts)):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text[:80])
        assert model.decode(got) == library.decode(want)


def test_decodes_any_ids_like_the_library(model, library):
    r = random.Random(4)
    pool = [0, 1, 2, *range(3, 259), 259, 260, 261, 300, 29871]
    for _ in range(4000):
        ids = [r.choice([*pool, r.randrange(32000)]) for _ in range(r.randint(0, 8))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_memory_of_words_may_overflow(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 5)
    for text in ("one two three four five six seven", "two one nine", "ten two six"):
        assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_rows(spark, library):
    rows = [(1, "Hello world", "a"), (1, "Hello world", "a"), (None, None, None), (3, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = pieces.encode(df, pieces.read_model(PATH))
    assert coded.columns == ["doc_id", "text", "ids"]
    back = pieces.decode(coded, pieces.read_model(PATH)).collect()
    assert [(r.doc_id, r.decoded) for r in back] == [(1, "Hello world"), (1, "Hello world"), (None, ""), (3, "")]
    got = pieces.digests(df, pieces.read_model(PATH)).collect()
    ids = np.array(library.encode("Hello world", add_bos=True, add_eos=True), "<u4").tobytes()
    assert got[0].ids_sha256 == hashlib.sha256(ids).hexdigest() and got[0].n_tokens == len(ids) // 4
    assert got[3].n_tokens == 2 and got[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert pieces.digests(df.limit(0), pieces.read_model(PATH)).collect() == []


def test_long_runs_of_any_symbol(model, library):
    """Time grows with the run, not with its square."""
    import time

    assert model.runs_last
    r = random.Random(5)
    runs = [" " * n for n in range(1, 120)] + [" " * n + w for n in (2, 3, 15, 16, 17, 31, 33) for w in ("x", "the", "日", "😀", "\n", "-")]
    runs += ["".join(r.choice([" " * r.randint(1, 40), " ", "a", "foo", "\n", "é", "日", "▁", "-"]) for _ in range(8)) for _ in range(500)]
    runs += [c * n for c in "a-=_.0#*~é日😀\n\t\x00" for n in (7, 1000)]
    for text in runs:
        assert np.frombuffer(model.encode([text], False, False)[0], "<u4").tolist() == library.encode(text), repr(text[:60])
    for c in " a-=_.0é\n\t":
        text = c * 100_000
        started = time.process_time()
        got = model.encode([text], False, False)[0]
        assert time.process_time() - started < 2 and np.frombuffer(got, "<u4").tolist() == library.encode(text), repr(c)


def test_runs_that_do_not_merge_last(model, library, monkeypatch):
    monkeypatch.setattr(model, "runs_last", False)
    monkeypatch.setattr(model, "cache", {})
    monkeypatch.setattr(model, "older", {})
    for text in (" " * 50, "a" + " " * 33 + "b", "  the"):
        assert np.frombuffer(model.encode([text], False, False)[0], "<u4").tolist() == library.encode(text)


def test_one_worker_encodes_and_decodes(spark):
    """A task of the query and of the pipeline holds one Python worker, and gets what two in a row give."""
    import corpus_pipeline

    proto = pieces.read_model(pieces.default_path())
    rows = [(1, "Some  words \n and ñ\t日本"), (2, ""), (3, None), (4, " \u2581 x ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = pieces.decode(pieces.encode(docs, proto), proto).orderBy("doc_id").collect()
    assert pieces.coded(docs, proto).orderBy("doc_id").collect() == want
    for got in (pieces.digests(docs, proto), corpus_pipeline.encode_pieces(spark, docs, "")):
        assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
