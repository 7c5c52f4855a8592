import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglathe.llm import linking, mixing

SCHEMA = "doc_id long, text string, rate string, source string"


def _docs(spark, n=400, seed=1):
    r = random.Random(seed)
    own = {"a": ["sun", "moon", "star"], "b": ["salt", "pepper"], "c": ["!!", "##"]}
    rows, labels = [], []
    for i in range(n):
        domain = r.choice(["a", "a", "b", "c"])
        words = [r.choice(own[domain]) if r.random() < 0.2 else r.choice(["the", "of", "and", "it"]) for _ in range(r.randint(10, 80))]
        rows.append((i, " ".join(words), "clash", "s"))
        if i % 2:
            labels.append((i, domain))
    rows += [(n, None, "", ""), (n + 1, "", "", ""), (3, rows[3][1], "", "")]
    labels += [(None, "a"), (5, None), (10**9, "b")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, domain string"), own


def test_posteriors_and_targets(spark):
    docs, labels, own = _docs(spark)
    domains = mixing.Domains(docs, labels)
    assert domains.names == ["a", "b", "c"]
    rows = mixing.mixed(docs, domains, weights={"a": 0.2, "b": 0.5, "c": 0.3}).collect()
    assert len(rows) == docs.count() and min(r.rate for r in rows) >= 0
    right = seen = 0
    for r in rows:
        if r.doc_id % 2 == 0 and r.text:
            truth = [d for d, w in own.items() if any(x in r.text.split() for x in w)]
            seen += 1
            right += truth[:1] == [domains.names[int(np.argmax(r.posteriors))]]
    assert right / seen > 0.95  # documents that were not fitted on
    n = np.array([r.n_tokens for r in rows])
    p = np.array([r.posteriors for r in rows])
    x = np.array([r.rate for r in rows])
    share = (n * x) @ p / n.sum()
    assert np.allclose(share, [0.2, 0.5, 0.3], atol=3e-3)
    drawn = (n * np.array([r.copies for r in rows])) @ p / n.sum()
    assert np.allclose(drawn, share, atol=0.06)


def test_rates_equal_a_plain_solver(spark):
    r = np.random.default_rng(3)
    p = r.dirichlet([0.3, 0.3, 0.3], 200)
    n = r.integers(1, 100, 200)
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(n, p)], "n_tokens long, posteriors array<double>")
    natural = n @ p
    targets = {"a": natural[0] * 0.1, "b": natural[1], "c": natural[2] * 1.5}
    rate, reached = mixing.fitted_rates(df, targets, ["a", "b", "c"])
    want = np.array(list(targets.values()))
    x = np.ones(200)
    for _ in range(mixing.RATE_ROUNDS):
        if np.abs((n * x) @ p - want).max() <= mixing.TOLERANCE * n.sum():
            break
        x = np.maximum(0, x - p @ (((n * x) @ p - want) / natural))
    got = np.array([v[0] for v in df.select(rate).collect()])
    assert np.abs(got - x).max() < 1e-9
    assert np.allclose(list(reached.values()), (n * x) @ p)
    assert np.abs((n * x) @ p - want).max() < 0.01 * n.sum()


def test_scale_removes_one_domain_and_leaves_the_rest(spark):
    docs, labels, _ = _docs(spark)
    rows = mixing.mixed(docs, mixing.Domains(docs, labels), scale={"c": 0.0}).collect()
    for r in rows:
        if r.text and r.n_tokens > 30:
            assert (r.rate < 0.5) == ("!!" in r.text or "##" in r.text)


def test_without_labels_and_empty(spark):
    docs, labels, _ = _docs(spark, 40)
    one = mixing.Domains(docs, labels.where("domain = 'a'"))
    assert one.model is None and one.names == ["a"]
    assert {r.rate for r in mixing.mixed(docs, one, weights={"a": 1.0}).collect()} == {1.0}
    none = mixing.Domains(docs, labels.limit(0))
    assert {r.rate for r in mixing.mixed(docs, none, weights={"a": 1.0}).collect()} == {1.0}
    assert mixing.mixed(docs.limit(0), mixing.Domains(docs, labels), weights={"a": 1, "b": 1}).collect() == []
    with pytest.raises(ValueError):
        many = spark.range(100).select("id", F.col("id").cast("string").alias("domain")).withColumnRenamed("id", "doc_id")
        mixing.Domains(docs, many)


def test_columns_of_any_name_stay(spark):
    docs, labels, _ = _docs(spark, 60)
    names = ["_text", "_tokens", "_vector", "_probability", "_raw", "row", "posteriors", "n_tokens", "copies"]
    clashing = docs.drop("rate").withColumns({c: F.lit(f"of the caller: {c}") for c in names})
    domains = mixing.Domains(clashing, labels)
    got = mixing.mixed(clashing, domains, scale={"a": 1.0}).collect()
    assert len(got) == docs.count()
    assert all(r[c] == f"of the caller: {c}" for r in got for c in names[:6])
    want = {(r.doc_id, r.text): (r.n_tokens, r.rate) for r in mixing.mixed(docs, mixing.Domains(docs, labels), scale={"a": 1.0}).collect()}
    assert {(r.doc_id, r.text): (r.n_tokens, r.rate) for r in got} == want


def test_all_labelled_rows_are_fitted(spark, monkeypatch):
    sizes = []
    fit = mixing.LogisticRegression.fit
    monkeypatch.setattr(mixing.LogisticRegression, "fit", lambda self, rows: sizes.append(rows.count()) or fit(self, rows))
    docs = spark.range(41_000).selectExpr("id as doc_id", "if(id % 2 = 0, 'sun moon', 'salt') as text")
    mixing.Domains(docs, docs.selectExpr("doc_id", "if(doc_id % 2 = 0, 'a', 'b') as domain"))
    assert sizes == [41_000]


def test_tokens_are_a_plain_column(spark):
    """The tokens of pyspark's RegexTokenizer, without its function on every text."""
    from pyspark.ml.feature import RegexTokenizer

    texts = ["Some words, and--signs!", " \n\t", "", None, "日本語 ñandú x9 ١٢ …", "A" * 50 + " 3.14"]
    rows = mixing.Domains._vectors(spark.createDataFrame([(t or "", t) for t in texts], "whole string, text string"))
    plain = RegexTokenizer(inputCol="whole", outputCol="want", gaps=False, pattern=r"\p{L}+|[^\p{L}\s]+", toLowercase=False)
    got = plain.transform(rows).select("_tokens", "want").collect()
    assert len(got) == len(texts) and all(r["_tokens"] == r["want"] for r in got)
    assert rows.select("_tokens")._jdf.queryExecution().optimizedPlan().toString().count("UDF") == 0


def test_texts_are_cut_once_for_fit_and_rates(spark, monkeypatch):
    """Vectors that are there already give what the texts give, and no text is read for them."""
    docs, labels, _ = _docs(spark, 80)
    vectors = linking.stored(mixing.Domains.vectorised(docs, ["doc_id"]), "vectors")
    want = mixing.mixed(docs, mixing.Domains(docs, labels), scale={"a": 0.5}).select("doc_id", "n_tokens", "rate", "posteriors").collect()
    monkeypatch.setattr(mixing.Domains, "_vectors", None)
    no_text = docs.select("doc_id")
    rows = mixing.mixed(no_text, mixing.Domains(no_text, labels, vectors), scale={"a": 0.5}, vectors=vectors)
    assert "text" not in rows.columns
    got = rows.select("doc_id", "n_tokens", "rate", "posteriors").collect()
    key = lambda r: (r.doc_id, r.n_tokens)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert key(g) == key(w) and g.rate == pytest.approx(w.rate, abs=1e-3) and g.posteriors == pytest.approx(w.posteriors, abs=1e-3)


def test_vectors_of_a_task_equal_those_of_spark(spark):
    """Tokens cut and hashed over arrays, without a function of Spark on every text, are those of HashingTF and of the pattern."""
    r = random.Random(5)
    texts = ["Some words, and--signs!", " \n\t", "", None, "日本語 ñandú x9 ١٢ … 😀a\u00a0b\u0085c\u2028", "A" * 50 + " 3.14", "x\v\fy\x1c\x00z"]
    texts += ["".join(r.choice("ab9.é日ß𝒜 \n") for _ in range(r.randint(1, 90))) for _ in range(200)] + ["e\u0301" * 700, "ab" * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = mixing.Domains._vectors(docs).selectExpr("doc_id", "size(_tokens) as n", "_vector").collect()
    made = mixing.Domains.vectorised(docs, ["doc_id"])
    got = {v.row.doc_id: (v.n_tokens, v._vector) for v in made.collect()}
    assert got == {w.doc_id: (w.n, w._vector) for w in want} and len(got) == len(texts)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "UDF" not in plan
