"""The stages of the pipeline on the smallest tables, each against a plain version of its decision."""

import os

import pytest

import corpus_pipeline
from brute import components, shingles
from loglathe.llm import linking, pieces, rules

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(linking.stored(stage(spark, out[-1], SF_DIR)))
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_and_subsets(stages):
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.columns == before.columns
    sizes = [s.count() for s in stages]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    for before, after in zip(stages[:-1], stages[1:]):
        assert set(_texts(after)) <= set(_texts(before))


def test_quality_stage_keeps_labelled_good_and_rejects_bad(spark, stages):
    kept = set(_texts(stages[1]))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) > 0.9 * len(good)
    judged = {r.doc_id: r.kept for r in rules.judged(stages[0], rules.learn_from(stages[0], spark.read.parquet(f"{SF_DIR}/labels.parquet"))).collect()}
    assert kept == {i for i, k in judged.items() if k}


def test_line_stage_leaves_no_equal_line_twice(stages):
    seen = set()
    for text in _texts(stages[2]).values():
        for line in (text or "").split("\n"):
            if len(line.split()) > 4:
                assert line not in seen
                seen.add(line)


def test_join_stage_keeps_one_document_of_each_group(stages):
    texts = _texts(stages[2])
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert set(_texts(stages[3])) == {c for c in components(ids, links).values()}


def test_mixing_stage_rejects_toxic_and_keeps_clean(spark, stages):
    kept, before = set(_texts(stages[4])), set(_texts(stages[3]))
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    clean = [i for i in before if i in labels and labels[i].quality == 1 and not labels[i].toxic]
    toxic = [i for i in before if i in labels and labels[i].toxic]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i in kept for i in toxic) <= 0.2 * len(toxic)


def test_last_stage_round_trips(stages):
    model = pieces.PieceModel(pieces.read_model(pieces.default_path()))
    for r in stages[5].collect():
        assert r.round_trip and model.decode(bytes(r.ids)) == (r.text or "") and r.n_tokens == len(r.ids) // 4


def test_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string"
    odd = spark.createDataFrame([(None, None, None, None, None, None), (1, "", "", "", 0, "x"), (1, "w " * 50, "", "", 0, "x")], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            assert out.count() <= docs.count()
