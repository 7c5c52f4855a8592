import hashlib
import random
import re

import pytest

from loglathe.llm import decontamination, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, items string, spans int, text_key string", "item_id long, text string, size int, window string"


def _words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def _plain(docs, items):
    """Every window compared with every place of every document."""
    windows = {}
    for item, text in items:
        w = _words(text)
        n = min(len(w), 10)
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = _words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def _case(seed, lengths):
    r = random.Random(seed)
    vocabulary = ["a", "B", "ñandú", "x9", "日本", "the", "of", "é", "١٢", " "]
    signs = [" ", ", ", "\n", "--", "\t\x00", "."]

    def text(n):
        return "".join(r.choice(vocabulary) + r.choice(signs) for _ in range(n))

    items = [(i, text(n)) for i, n in enumerate(lengths)]
    items += [(500, items[0][1]), (501, items[0][1]), (500, text(12)), (None, text(11)), (502, None), (503, " .- ")]
    docs = [(i, text(r.randint(0, 60))) for i in range(150)]
    for i in range(150, 260):  # passages of the items, some changed, between other words
        w = _words(r.choice(items)[1])
        a = r.randint(0, max(len(w) - 1, 0))
        part = w[a : a + r.randint(1, 30)]
        if r.random() < 0.2 and part:
            part[r.randrange(len(part))] = "other"
        docs.append((i, text(r.randint(0, 9)) + " " + "; ".join(part).upper() + "! " + text(r.randint(0, 9))))
    docs += [(900, None), (901, ""), (902, "..."), (903, "a " * 4000), (None, items[0][1]), (904, docs[200][1]), (904, docs[200][1])]
    return docs, items


@pytest.mark.parametrize("lengths", [[30, 12, 10, 25, 40], [30, 10, 9, 7, 4], [1, 2, 3, 5, 6, 8, 20], [2]])
def test_against_all_windows(spark, tmp_path, lengths):
    docs, items = _case(len(lengths), lengths)
    items += [(600, "a " * 300)] if len(lengths) == 5 else []
    spark.createDataFrame([(*d, "x", 1, "y") for d in docs], DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*i, 1, "y") for i in items], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.QUERIES["op12_decontamination"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == _plain(docs, items)
    assert any(row.contaminated for row in got)


def test_many_fingerprints_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    docs, items = _case(9, [30, 12, 9])
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found.collect()), key=repr) == [x[:4] for x in _plain(docs, items)]


def test_every_run_has_the_fingerprint_of_its_window(spark):
    """Winnowing's promise, on runs of many equal words too."""
    from pyspark.sql import functions as F

    r = random.Random(1)
    rows = [(" ".join(r.choice("abc") for _ in range(r.randint(1, 40))),) for _ in range(60)]
    df = spark.createDataFrame(rows, "text string").withColumn("w", decontamination.words(F.col("text")))
    for n in (1, 2, 3, 9, 10):
        got = df.select("w", decontamination.fingerprints(F.col("w"), n).alias("p"), decontamination._grams(F.col("w"), n).alias("g")).collect()
        span = n - decontamination.gram_size(n) + 1
        for row in got:
            places = {x["place"] for x in row.p}
            for s in range(len(row.w) - n + 1):
                run = row.g[s : s + span]
                assert all(s + i in places for i, h in enumerate(run) if h == min(run))


def test_grams_are_looked_up_before_the_choice(spark):
    """With all grams of the texts as prints, what is found is the choice of `fingerprints`; grams are no nested function."""
    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 30)))) for i in range(40)]
    df = spark.createDataFrame(rows, "text_key int, text string").select("text_key", decontamination.words(F.col("text")).alias("w"))
    for sizes in ([10], [1, 2, 9]):
        grams = F.concat(*[decontamination._grams(F.col("w"), n) for n in sizes])
        found = decontamination._shared_grams(df, df.select(F.explode(grams).alias("gram")), sizes)
        want = df.select("text_key", F.explode(F.concat(*[decontamination.fingerprints(F.col("w"), n) for n in sizes])).alias("p"))
        want = sorted((x.text_key, x.p["size"], x.p["place"]) for x in want.collect())
        assert sorted((x.text_key, x["size"], x.place) for x in found.collect()) == want != []
        assert "lambda" not in found.drop("w")._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.contaminated(docs.limit(0), items).collect() == []
    assert [tuple(r) for r in decontamination.contaminated(docs, items.limit(0)).collect()] == [(1, 3, 0, [], [])]
    assert [tuple(r) for r in decontamination.contaminated(docs, items).collect()] == [(1, 3, 3, ["1"], [(0, 3)])]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c " * 9)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c " * 5)], "item_id long, text string")
    plan = decontamination.contaminated(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
