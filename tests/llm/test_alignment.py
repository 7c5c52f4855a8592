import collections
import hashlib
import itertools
import random

import pytest

from loglathe.llm import alignment

SIGNS = ["a", "b", " ", "  ", "\n", "\t", "é", "ﬁ", "日本", " ", "▁", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "'s", "12", "\x00",
         "\x85", "​", "😀", "the", "ing", "!", "\r", "é", "Ⅷ", " and", " the"]


@pytest.fixture(scope="module")
def models():
    return alignment.read_models(*alignment.default_paths())


def _plain(models, text):
    """Both token lists with their bytes, groups and links, from the libraries and the definition alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(models[0])
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_proto=models[1])
    sign = alignment._byte_of_sign()

    def one(text):
        if not text:
            return 0, 0, "", []
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids
        b = pieces.encode(text)
        a_bytes = [bytes(sign[c] for c in tokenizer.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]
        if {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
            return 0, 0, "", []
        a_end, b_end = (list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes))
        groups, low = [], 0
        for cut in sorted(set(a_end) & set(b_end)):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if low < e <= cut) for ids, ends in ((a, a_end), (b, b_end))))
            low = cut
        links = [
            (i, j)
            for i, e, x in zip(a, a_end, a_bytes)
            for j, f, y in zip(b, b_end, b_bytes)
            if f - len(y) < e and e - len(x) < f
        ]
        return len(a), len(b), ";".join(groups), links

    return [one(t) for t in text]


def _rows():
    r = random.Random(3)
    texts = [None, "", " ", "  ", "a", " a", "a ", "the  end", "<|endoftext|>", "x" * 3000, "a b " * 2000, " " * 500]
    texts += ["".join(r.choice(SIGNS) for _ in range(r.randint(1, 20))) for _ in range(300)]
    texts += ["the and the ing"] * 40
    return [(i, t, "of the caller") for i, t in enumerate(texts)]


def _check(spark, models, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, links string").repartition(4)
    got = alignment.with_link_counts(alignment.token_groups(df, *models)).collect()
    plain = dict(zip([i for i, *_ in rows], _plain(models, [t for _, t, _ in rows])))
    docs = collections.Counter(pair for *_, links in plain.values() for pair in set(links))
    most = collections.defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    assert len(got) == len(rows)
    for row in got:
        n_a, n_b, groups, links = plain[row.doc_id]
        want = (n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), groups)
        assert (row.n_a, row.n_b, row.n_groups, row.n_links, row.groups) == want, row.text
        assert row.count_sum == sum(docs[x] for x in links)
        assert row.n_best == sum(docs[x] == most[x[0]] for x in links)


def test_against_the_definition(spark, models):
    _check(spark, models, _rows())


def test_many_pieces(spark, models, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN_WORDS", 50)  # words are forgotten and met again
    rows = _rows()
    pair = alignment.pair_of(*models)
    texts = [t for _, t, _ in rows]
    whole = alignment.align(texts, pair)
    parts = [alignment.align([t], pair) for t in texts]  # a piece of its own for every text
    for c in (*alignment.COUNTS, "groups"):
        assert whole[c].to_pylist() == [p[c][0].as_py() for p in parts]
    for i, p in enumerate(parts):
        one = dict(zip((p["pairs"][k].as_py() for k in p["index"][0].as_py()), p["times"][0].as_py()))
        assert one == dict(zip((whole["pairs"][k].as_py() for k in whole["index"][i].as_py()), whole["times"][i].as_py()))


def test_empty_and_words_without_ties(spark, models):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.with_link_counts(alignment.token_groups(empty, *models)).collect() == []
    _check(spark, models, [(1, None, ""), (2, "", ""), (3, "same text", ""), (4, "same text", "")])


def test_query(spark, models, tmp_path):
    from loglathe.llm import queries

    rows = [(i, t) for i, t, _ in _rows()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op11_alignment"](spark, str(tmp_path)).collect()}
    for (i, _), (n_a, _, groups, _) in zip(rows, _plain(models, [t for _, t in rows])):
        assert got[i].groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if n_a else "")
