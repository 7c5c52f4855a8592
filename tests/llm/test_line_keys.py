"""Recall of the line keys against all pairs, without any block filter."""

import random

import numpy as np
import pytest

from loglathe.llm import line_dedup, line_keys
from test_line_dedup import SCHEMA, _edit

COMMON = np.zeros(line_keys.SKETCH, np.int32)


def _keys(lines):
    out = [set() for _ in lines]
    for kind, ids, symbols, sizes in line_dedup._sequences(line_dedup.Lines(["\n".join(lines).encode()])):
        line, key = line_keys.keys(symbols, sizes, kind, 0.8, COMMON)
        number = {i: n for n, i in enumerate(line_dedup.Lines(["\n".join(lines).encode()]).ids.tolist())}
        for n, k in zip(line.tolist(), key.tolist()):
            out[number[ids[n]]].add(k)
    return out


def _changed(r, symbols, edits, new):
    symbols = list(symbols)
    for _ in range(edits):
        at, what = r.randrange(len(symbols)), r.randrange(3)
        symbols[at : at + (what != 1)] = [] if what == 0 and len(symbols) > 3 else [new()]
    return symbols


@pytest.mark.parametrize("n", [3, 5, 8, 9, 10, 11, 14, 20, 30, 61])
@pytest.mark.parametrize("sep", [" ", ""])
def test_all_similar_lines_meet(n, sep):
    r = random.Random(n)
    word = (lambda: "".join(r.choices("abcdefgh", k=5))) if sep else (lambda: chr(r.randrange(0x4E00, 0x5E00)))
    pairs = []
    for _ in range(250):
        a = [word() for _ in range(n)]
        b = _changed(r, a, r.randint(1, max(1, n // 4)), word)
        if _edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) and a != b:
            pairs.append((sep.join(a), sep.join(b)))
    assert pairs or n < 5
    keys = _keys([x for pair in pairs for x in pair]) if pairs else []
    assert all(keys[2 * i] & keys[2 * i + 1] for i in range(len(pairs)))


def test_short_similar_lines_are_dropped(spark):
    r = random.Random(7)
    base = {n: ["".join(r.choices("abcdefgh", k=6)) for _ in range(n)] for n in (5, 10, 20, 30)}
    other = {n: " ".join([*w[:2], "changed", *w[3:]]) for n, w in base.items()}
    rows = [(n, " ".join(w), "", "") for n, w in base.items()] + [(100 + n, t, "", "") for n, t in other.items()]
    got = {x.doc_id: x.dropped for x in line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {n: [] for n in base} | {100 + n: [0] for n in base}


def test_one_and_two_words_and_unspaced_text(spark):
    r = random.Random(8)
    text = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(1000))
    near = text[:300] + "あ" + text[301:700] + text[702:]
    other = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(1000))
    rows = [(1, f"Read more\nok\n{text}\n\n...", "", ""), (2, f"read  MORE!\nno\n{near}\n\n...", "", ""), (3, f"OK\n{other}\n{text}", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x.dropped for x in line_dedup.deduplicated(df).collect()}
    assert got == {1: [], 2: [0, 2], 3: [0, 2]}


def test_signatures_tell_long_lines_apart():
    """An edit changes two bits at most, and lines of hundreds of words with other words differ in more than edits allow."""
    r = np.random.default_rng(5)
    for n in (12, 100, 320, 640):
        base, other = (r.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        edits = line_keys.allowed(n, 0.8)
        near = base.copy()
        near[r.choice(n, edits, replace=False)] = r.integers(0, 1 << 63, edits).astype(np.uint64)
        marks = line_keys.signatures(np.concatenate([base, near, other, other[:1]]), np.array([n, n, n, 1])).view(np.uint64)
        apart = np.bitwise_count(marks[:, :1] ^ marks).sum(axis=0)
        assert apart[0] == 0 and apart[1] <= 2 * edits < apart[2]
        assert np.bitwise_count(marks[:, 3]).sum() == 1
    many = line_keys.signatures(np.repeat(np.arange(5000, dtype=np.uint64) << np.uint64(3), 3), np.full(5000, 3))
    assert (np.bitwise_count(many.view(np.uint64)).sum(axis=0) == 1).all()  # three times one symbol
