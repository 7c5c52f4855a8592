import random

import numpy as np
import pytest

from brute import components, shingles
from loglathe.llm import linking, ngram_join

SCHEMA = "doc_id long, text string, n_shingles string, key long"


def _corpus(n=150, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    while len(rows) < n:
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 20, 60, 150]))]
        for _ in range(r.choice([1, 1, 2, 6, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((r.choice(["", " ", "The same passage in many of these documents here. "]) + " ".join(copy)).upper() if r.random() < 0.3 else " ".join(copy))
    rows += [None, "", " \n", "a b", "A  b", "a b c d", "x y z", "passage " * 40]
    return [(i * 2 + 1, t, "clash", 0) for i, t in enumerate(rows)]


def _want(rows, k=4, percent=85):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[n + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), c) for i, c in components(ids, links).items()}


@pytest.mark.parametrize("seed", [3, 4])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_DOCUMENTS", 6)
    monkeypatch.setattr(linking, "BIG_KEY", 3)
    monkeypatch.setattr(ngram_join, "FAMILY_PART", 4)
    rows = _corpus(seed=seed)
    got = ngram_join.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _want(rows)
    assert len(got) == len(rows)


def test_chain_of_near_copies_is_one_group(spark):
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(40):  # each near the next only
        base = [*base[:i], f"new{i}", *base[i + 1 :]]
        rows.append((100 - i, " ".join(base), "", 0))
    got = ngram_join.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in got} == {61}
    kept = ngram_join.one_per_group(spark.createDataFrame(rows, SCHEMA))
    assert [r.doc_id for r in kept.collect()] == [61] and kept.columns == ["doc_id", "text", "n_shingles", "key"]


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e", "", 0), (None, None, "", 0), (4, "a b c d e", "", 0), (4, "a b c d e", "", 0), (4, "other words of this row", "", 0), (9, "Other words of this row", "", 0), (2, None, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.similar_groups(df).collect())
    assert got == [(0, 0, 0), (0, 2, 0), (2, 0, 2), (4, 2, 4), (4, 2, 4), (4, 2, 4), (9, 2, 4)]
    kept = ngram_join.one_per_group(df).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 2, 4]
    assert ngram_join.similar_groups(df.limit(0)).collect() == []


def test_prefix_tree_shares_and_prunes():
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 10**6, 400).astype(np.uint64))

    def near(most):
        own = base.copy()
        own[r.integers(0, len(own), r.integers(0, most))] = r.integers(0, 10**6)
        return np.unique(own)

    probes = [near(60) for _ in range(30)] + [np.unique(r.integers(0, 10**6, 90).astype(np.uint64))]
    sets = [near(60) for _ in range(60)] + [np.unique(r.integers(0, 10**6, 380).astype(np.uint64)) for _ in range(40)]
    sets += [probes[0], base[:300], base[:340]]
    sets.sort(key=lambda s: s.astype(">u8").tobytes())
    tree = ngram_join.PrefixTree(probes, 85)
    for s in sets:
        both = [len(np.intersect1d(s, p)) for p in probes]
        want = [i for i, p in enumerate(probes) if 100 * both[i] >= 85 * (len(s) + len(p) - both[i])]
        assert tree.similar(s).tolist() == want
    assert tree.steps < 0.95 * sum(len(np.intersect1d(s, np.concatenate(probes))) for s in sets)


def test_needed_overlap_is_exact():
    for a in range(1, 60):
        for b in range(1, 60):
            least = next(o for o in range(0, 200) if 100 * o >= 85 * (a + b - o))
            assert ngram_join.needed_overlap(a, b) == least


def test_components_of_any_shape(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(1000, 1200)] + [(5, i) for i in range(6, 300)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in linking.components(df).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: c for n, c in components(nodes | {n for l in links for n in l}, links).items() if n in nodes}
    assert linking.components(df.limit(0)).collect() == []


def test_components_by_rounds_and_by_one_task(spark, monkeypatch):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(r.randrange(1000, 1060), r.randrange(1000, 1060)) for _ in range(30)]
    df = spark.createDataFrame(links, "a long, b long")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    want = {n: c for n, c in components(nodes | {n for l in links for n in l}, links).items() if n in nodes}
    for most in (0, 20):
        monkeypatch.setattr(linking, "LAST_LINKS", most)
        assert {r.id: r.component for r in linking.components(df).collect()} == want
    named = df.selectExpr("'n' || lpad(a, 4, '0') AS a", "'n' || lpad(b, 4, '0') AS b")
    assert {r.id: r.component for r in linking.components(named).collect()} == {f"n{i:04}": f"n{c:04}" for i, c in want.items()}


def test_components_of_few_links_take_few_steps(spark, monkeypatch):
    steps, kept = [], linking.stored
    monkeypatch.setattr(linking, "stored", lambda df, name="step", **options: steps.append(name) or kept(df, name, **options))
    got = linking.components(spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long"))
    assert {r.component for r in got.collect()} == {0} and len(steps) == 2
