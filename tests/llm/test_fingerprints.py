import hashlib
import random

from brute import shingles
from loglathe.llm import fingerprints

SCHEMA = "doc_id long, text string, bucket int, kind int, id string"


def _texts(n, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 40, 400]))) for _ in range(n)]


def test_against_plain_version(spark):
    texts = _texts(120)
    texts[3] = None
    texts[7] = texts[8] = texts[9]
    rows = [(i * 3, t, 5, 6, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.with_next(spark.createDataFrame(rows, SCHEMA), buckets=7).collect()}
    assert len(got) == len(rows)
    ids = sorted(got, reverse=True)
    text = {i: t or "" for i, t, *_ in rows}
    errors = []
    for k, i in enumerate(ids):
        following = text[ids[(k + 1) % len(ids)]]
        cut = len(text[i]) // 3
        edited = text[i][: len(text[i]) - cut] + following[:cut]
        row = got[i]
        assert row.n_chars == len(text[i])
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        a, b = shingles(text[i], 5), shingles(edited, 5)
        if len(a) > 300:
            errors.append(row.near_edited - len(a & b) / len(a | b))
    assert abs(sum(errors) / len(errors)) < 0.05
    by_text = {}
    for i in ids:
        assert by_text.setdefault(text[i], got[i].fingerprint) == got[i].fingerprint
    assert len({got[i].fingerprint for i in ids if text[i]}) > 0.9 * len({t for t in text.values() if t})


def test_result_does_not_depend_on_the_cut(spark):
    rows = [(i, t, 0, 0, "") for i, t in enumerate(_texts(60, 2))]
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = (sorted(map(tuple, fingerprints.with_next(df, buckets=b).collect())) for b in (1, 40))
    assert one == many


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fingerprints.with_next(empty).collect() == []
    one = fingerprints.with_next(spark.createDataFrame([(4, "a b c", 0, 0, "")], SCHEMA)).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in one] == [(4, 5, 1.0)]
    odd = spark.createDataFrame([(None, "x", 0, 0, ""), (None, None, 0, 0, ""), (1, "same", 0, 0, ""), (1, "same", 0, 0, "")], SCHEMA)
    assert sorted((r.doc_id or 0, r.n_chars) for r in fingerprints.with_next(odd).collect()) == [(0, 0), (0, 1), (1, 4), (1, 4)]


def test_containment_of_unequal_documents_and_merging():
    r = random.Random(5)
    long = " ".join(f"w{r.random()}" for _ in range(20000))
    part = " ".join(long.split()[3000:5000])
    a, b = (fingerprints.Sketches([t.encode()]) for t in (part, long))
    _, inside, _ = fingerprints.likeness(fingerprints.shared(a, b), a.sizes(), b.sizes())
    assert inside[0] > 0.95
    other = " ".join(f"v{i}" for i in range(3000))
    c = fingerprints.Sketches([other.encode()])
    union = {*shingles(part, 5), *shingles(other, 5)}
    merged = fingerprints.merged([a.strings()[0], c.strings()[0]])
    assert abs(len(merged) / fingerprints.HEX * fingerprints.SCALE / len(union) - 1) < 0.2
