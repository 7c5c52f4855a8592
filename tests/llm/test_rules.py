import random

import numpy as np

from brute import WORD
from loglathe.llm import rules

DOCS = "doc_id long, text string, n_words string, lang string"
LABELS = "doc_id long, quality int, toxic int, text string"


def _plain(text):
    text = text or ""
    found = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return {
        "n_words": len(found),
        "word_chars": sum(map(len, found)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": lines,
        "n_repeat_words": len(covered),
    }


def _texts():
    r = random.Random(2)
    vocabulary = ["a", "b", "é", "word", "#", "x|y", "日本", " "]
    texts = ["".join(r.choice(vocabulary) + r.choice([" ", "\n", "\t", " \n", "\x0b"]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    return [*texts, None, "", " \n ", "a " * 40, "one two three four five six seven eight nine\n" * 3, "x" * 5000]


def test_statistics_against_plain_version(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, "clash", "en") for i, t in enumerate(texts)], DOCS)
    for row in rules.judged(df, []).collect():
        want = _plain(texts[row.doc_id])
        assert {c: row[c] for c in want} == want, texts[row.doc_id]
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert row.base_failed == failed and row.kept == (not failed)


def test_covering_finds_the_planted_rules():
    r = np.random.default_rng(1)
    values = {"a": r.random(4000), "b": r.random(4000), "c": r.random(4000)}
    bad = (values["a"] > 0.8) & (values["b"] < 0.5) | (values["c"] > 0.95)
    found = rules.learn(values, bad, r.random(4000) < 0.67)
    fresh = {k: r.random(4000) for k in values}
    truth = (fresh["a"] > 0.8) & (fresh["b"] < 0.5) | (fresh["c"] > 0.95)
    hit = np.zeros(4000, dtype=bool)
    for rule in found:
        hit |= rules.covers(rule, fresh)
    assert (hit == truth).mean() > 0.97


def test_no_rules_without_both_kinds():
    values = {"a": np.arange(5.0)}
    assert rules.learn(values, np.zeros(5, dtype=bool), np.ones(5, dtype=bool)) == []
    assert rules.learn(values, np.ones(5, dtype=bool), np.ones(5, dtype=bool)) == []


def _labelled(spark, n=600):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        good = i % 4
        words = [r.choice(["tree", "house", "walk", "sky"]) + str(r.randrange(999)) for _ in range(60)]
        docs.append((i, " ".join(words if good else [w + "!!" for w in words]), "x", "en"))
        labels.append((i, int(bool(good)), 0, "t"))
    labels += [(None, 1, 0, ""), (99999, 0, 0, ""), (5, None, 0, "")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_learned_list_rejects_the_bad_and_keeps_the_good(spark):
    docs, labels = _labelled(spark)
    learned = rules.learn_from(docs, labels)
    assert learned and learned == rules.learn_from(docs.repartition(5), labels)
    kept = {r.doc_id for r in rules.filtered(docs, learned).collect()}
    assert kept == {i for i in range(600) if i % 4}
    assert rules.filtered(docs, learned).columns == docs.columns


def test_column_form_equals_array_form(spark):
    docs, labels = _labelled(spark, 200)
    learned = rules.learn_from(docs, labels)
    rows = rules.judged(docs, learned).select("rule", *[c.alias("f_" + k) for k, c in rules.features().items()]).collect()
    values = {k: np.array([r["f_" + k] for r in rows]) for k in rules.features()}
    assert [r.rule > 0 for r in rows] == list(np.any([rules.covers(x, values) for x in learned], axis=0))


def test_small_tables(spark):
    docs, labels = _labelled(spark, 8)
    assert rules.learn_from(docs, labels.limit(0)) == []
    assert rules.judged(docs.limit(0), []).collect() == []
    assert rules.learn_from(docs.limit(0), labels) == []


def test_no_labelled_row_is_left_out(spark, monkeypatch):
    """Of 41,000 labelled documents a few hundred decide a rule; a sample of 20,000 sees half of them."""
    docs = spark.range(41_000).selectExpr("id as doc_id", "array_join(transform(sequence(1, 25), i -> concat('w', i, if(id % 100 = 0, '!', ''))), ' ') as text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 100 > 0) as quality")
    seen = []
    covering = rules._covering
    monkeypatch.setattr(rules, "_covering", lambda candidates, count: seen.append(count([], [])) or covering(candidates, count))
    learned = rules.learn_from(docs, labels)
    assert seen[0][:, :, 0].sum() == 41_000 and seen[0][:, 1, 0].sum() == 410
    assert rules.judged(docs, learned).where("kept").count() == 41_000 - 410


def test_spark_counts_give_the_rules_of_the_plain_form(spark, monkeypatch):
    monkeypatch.setattr(rules, "TASK_ROWS", 100)
    r = random.Random(4)
    docs, labels = [], []
    for i in range(700):
        kind = r.choice(["plain", "plain", "plain", "marks", "upper"])
        ends = {"plain": ["", "", "!", "Q"], "marks": ["", "!", "!", "?"], "upper": ["QQ", "QXZ", "", "!"]}[kind]
        lines = [" ".join(r.choice(["tree", "Sky", "walk"]) + str(r.randrange(99)) + r.choice(ends) for _ in range(9)) for _ in range(9)]
        docs.append((i, "\n".join(lines), "x", "en"))
        labels.append((i, int(kind == "plain"), 0, ""))
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    table = rules.labelled(docs, labels).toPandas()
    want = rules.learn({n: table[n].to_numpy() for n in rules.features()}, table["_bad"].to_numpy(), table["_grow"].to_numpy())
    assert want and rules.learn_from(docs, labels) == want
