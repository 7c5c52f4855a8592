import math
import random
import zlib
from collections import Counter

import pytest

from brute import WORD, lower
from loglathe.llm import katz

SCHEMA = "doc_id long, text string, key long, score double"


def _docs(n=260, seed=1):
    r = random.Random(seed)
    common = [f"c{i}" for i in range(25)]
    rows = []
    for i in range(n):
        words = [r.choice(common) if r.random() < 0.8 else f"r{r.randrange(3000)}" for _ in range(r.choice([0, 1, 5, 30, 60]))]
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else " \n".join(words), 1, 0.5))
    return rows + [(n, None, 0, 0.0), (n + 1, "", 0, 0.0), (n + 2, "never seen zzz", 0, 0.0)]


def _tokens(text):
    return [*WORD.findall(lower(text or "")), "</s>"]


class Plain:
    def __init__(self, texts, order=2):
        self.order, self.grams = order, [Counter() for _ in range(order + 1)]
        for t in texts:
            seq = ["<s>"] * (order - 1) + _tokens(t)
            for i in range(order - 1, len(seq)):
                for level in range(1, order + 1):
                    self.grams[level][tuple(seq[i - level + 1 : i + 1])] += 1
        self.c = Counter({g[0]: r for g, r in self.grams[1].items()})
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d = [None, *[katz.discounts(Counter(g.values())) for g in self.grams[1:]]]
        self.p = {w: (self.d[1][c] if c <= 5 else 1) * c / self.n for w, c in self.c.items()}
        self.unknown = 1 - sum(self.p.values())
        self.after = {}
        for level in range(2, order + 1):
            for g, r in self.grams[level].items():
                self.after.setdefault(g[:-1], {})[g[-1]] = r
        self.memo = {}

    def seen(self, h):
        if h in self.memo:
            return self.memo[h]
        after = self.after.get(h, {})
        n, d = sum(after.values()), self.d[len(h) + 1]
        found = {w: (d[r] if r <= 5 else 1) * r / n for w, r in after.items()}
        if found and 1 - sum(found.values()) < 1e-12:  # nothing left for the backoff
            found = {w: p * n / (n + 1) for w, p in found.items()}
        a = (1 - sum(found.values())) / (1 - sum(self.prob(h[1:], x) for x in found)) if found else 1
        self.memo[h] = found, a
        return found, a

    def prob(self, h, w):
        if not h:
            return self.p.get(w, self.unknown)
        found, a = self.seen(h)
        return found[w] if w in found else a * self.prob(h[1:], w)

    def score(self, text):
        seq, before = _tokens(text), self.order - 1
        padded = ["<s>"] * before + seq
        return sum(math.log10(self.prob(tuple(padded[i : i + before]), w)) for i, w in enumerate(seq))


def _held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_plain_model(spark, order):
    rows = _docs()
    plain = Plain([t for i, t, *_ in rows if not _held(i)], order)
    got = {r.doc_id: r for r in katz.scored(spark.createDataFrame(rows, SCHEMA), order).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        seq = _tokens(text)
        row = got[i]
        assert row.held_out == _held(i) and row.train_tokens == plain.n and row.n_tokens == len(seq)
        assert row.n_known == sum(plain.c[w] > 0 for w in seq)
        base = sum(math.log10((plain.c[w] + 0.1) / (plain.n + 0.1 * (plain.v + 1))) for w in seq)
        assert row.base_score == pytest.approx(base, abs=1e-9)
        assert row.score == pytest.approx(plain.score(text), abs=1e-7)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_add_up_to_one(order):
    plain = Plain([t for _, t, *_ in _docs()], order)
    pairs = [h for h in plain.after if len(h) == order - 1][:20]
    for h in [("<s>",) * (order - 1), ("never",) * (order - 1), *pairs]:
        total = sum(plain.prob(h, w) for w in plain.c) + plain.prob(h, "zzzz")
        assert total == pytest.approx(1)


def test_model_beats_the_base_on_text_with_order(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        at, words = r.randrange(50), []
        for _ in range(60):
            at = (at * 3 + r.choice([1, 2])) % 50
            words.append(f"w{at}")
        rows.append((i, " ".join(words), 0, 0.0))
    got = [x for x in katz.scored(spark.createDataFrame(rows, SCHEMA)).collect() if x.held_out]
    assert got and all(x.score > x.base_score + 10 for x in got)


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "a b a b", 0, 0.0)] * 3 + [(None, "a b", 0, 0.0), (1, "other text", 0, 0.0), (2, None, 0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = katz.scored(df).collect()
    assert sorted((x.doc_id or 0, x.n_tokens) for x in got) == [(0, 3), (1, 3), (1, 5), (1, 5), (1, 5), (2, 1)]
    assert all(math.isfinite(x.score) and x.score <= 1e-12 for x in got)
    assert katz.scored(df.limit(0)).collect() == []
    lone = katz.scored(spark.createDataFrame([(i, "x y", 0, 0.0) for i in range(200) if _held(i)], SCHEMA)).collect()
    assert {(x.train_tokens, x.n_known, x.score, x.base_score) for x in lone} == {(0, 0, 0.0, 0.0)}


def test_discounts():
    d = katz.discounts({1: 1000, 2: 300, 3: 140, 4: 80, 5: 50, 6: 35})
    assert all(0 < x < 1 for x in d[1:]) and d[1] < d[5]
    assert katz.discounts({}) == [1.0] * 6 and katz.discounts({1: 5}) == [1.0] * 6


@pytest.mark.parametrize("order", [2, 3])
def test_discounted_single_counts_and_frequent_contexts(spark, order):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.9))}" for _ in range(20)), 0, 0.0) for i in range(200)]
    plain = Plain([t for i, t, *_ in rows if not _held(i)], order)
    assert 0 < plain.d[2][1] < 1 and sum(r == 1 for r in plain.grams[2].values()) > 100
    frame = spark.createDataFrame(rows, SCHEMA)
    model = katz.train(frame.where("doc_id % 2 = 0"), order)
    assert len(model.levels[1].hot) > 1  # w1 is frequent, and spread over the buckets
    assert model.levels[1].weights[:, 0].max() > 100
    for row in katz.scored(frame, order).collect():
        assert row.score == pytest.approx(plain.score(rows[row.doc_id][1]), abs=1e-7)


def test_grams_differ_by_order_of_words():
    words = [b"a b c", b"a c b", b"b a c"]
    token, context, shorter, _ = katz.token_arrays(words, 3)
    keys = katz.gram_key(context, token).reshape(3, 4)
    assert len({int(k) for k in keys[:, 2]}) == 3
    at_two = katz.token_arrays(words, 2)
    assert (shorter == at_two[1]).all()
    assert (katz.gram_key(at_two[1], token)[:-1][token[:-1] != katz.END] == context[1:][token[:-1] != katz.END]).all()
