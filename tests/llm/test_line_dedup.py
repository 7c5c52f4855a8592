import random

from brute import components
from loglathe.llm import line_dedup

SCHEMA = "doc_id long, text string, line string, dropped string"


def _norm(line):
    return line_dedup.normalised(line.encode()).decode()


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _symbols(line):
    """Words, or code points of lines with fewer than three words."""
    found = line.split()
    return (0, found) if len(found) >= line_dedup.MIN_WORDS else (1, list(" ".join(found)))


def _want(rows):
    """Dropped lines of each row by all pairs of distinct lines, whatever keys they have."""
    places, first = {}, {}
    for doc_id, text, *_ in rows:
        for n, line in enumerate((text or "").split("\n")):
            if _norm(line):
                places.setdefault(_norm(line), []).append((doc_id, n))
    lines = sorted(places)
    links = []
    for i, (kind, p) in enumerate(map(_symbols, lines)):
        for j in range(i):
            other, q = _symbols(lines[j])
            allowed = int(0.2 * max(len(p), len(q)) + 1e-9)
            if kind == other and abs(len(p) - len(q)) <= allowed and _edit(p, q) <= allowed:
                links.append((i, j))
    groups = {}
    for i, c in components(range(len(lines)), links).items():
        groups.setdefault(c, []).extend(places[lines[i]])
    return {p for g in groups.values() for p in sorted(g)[1:]}, links


def _rows(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(200)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 8, 25, 60]))] for _ in range(40)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(r.randint(0, 6)):
            words = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 2])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            line = " ".join(words)
            lines.append(r.choice([line, line.upper(), line + "!", "12 " + line, ""]))
        rows.append((i * 5, "\n".join(lines), "clash", "x"))
    return rows


def test_against_brute_force(spark):
    rows = _rows(1)
    want, links = _want(rows)
    assert links and want
    got = line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, n) for r in got for n in r.dropped} == want
    text = {i: t for i, t, *_ in rows}
    for r in got:
        lines = text[r.doc_id].split("\n")
        assert r.n_lines == len(lines)
        assert r.text == "\n".join(x for n, x in enumerate(lines) if n not in set(r.dropped))


def test_all_pairs_of_all_lengths(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefgh", k=6)) for _ in range(300)]
    lines = []
    for n in [3, 5, 10, 20, 30] * 8:
        base = [r.choice(vocabulary) for _ in range(n)]
        for _ in range(5):
            words = list(base)
            for _ in range(r.randint(0, max(1, n // 4))):
                at, what = r.randrange(len(words)), r.randrange(3)
                words[at : at + (what != 1)] = [] if what == 0 else [r.choice(vocabulary)]
            lines.append(" ".join(words))
    rows = [(i, t, "", "") for i, t in enumerate(lines)]
    want, links = _want(rows)
    assert len(links) > 50
    got = line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(x.doc_id, i) for x in got for i in x.dropped} == want


def test_key_of_very_many_lines(spark, monkeypatch):
    """A key in every piece goes through a bucket once per piece, and every line of it is held."""
    monkeypatch.setattr(line_dedup, "TASK_BYTES", 1 << 10)
    monkeypatch.setattr(line_dedup, "BUCKET_BYTES", 1 << 11)
    rows = [(i, f"one two three four five six seven eight a{i} b{i // 2}", "", "") for i in range(600)]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.doc_id for x in got if x.dropped} == set(range(1, 600))


def test_cases(spark):
    same = "one two three four five six"
    rows = [(None, same, "", ""), (3, None, "", ""), (4, "", "", ""), (5, f"{same}\n\nshort\n--\n{same}", "", ""), (6, same.upper() + " !", "", ""), (7, "tiny\n--\ntiny", "", ""), (6, same.upper() + " !", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.text, tuple(r.dropped)) for r in line_dedup.deduplicated(df).collect() if r.doc_id != 3)
    gone = (6, "", (0,))
    assert got == [(0, "", (0,)), (4, "", ()), (5, f"{same}\n\nshort\n--", (4,)), gone, gone, (7, "tiny\n--", (2,))]
    left = line_dedup.cleaned(df)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [3, 4, 5, 7] and left.columns == df.columns
    assert line_dedup.deduplicated(df.limit(0)).collect() == []


def test_very_long_line(spark):
    words = [f"w{i % 977}x{i % 31}" for i in range(20000)]
    other = list(words)
    other[777] = "changed"
    rows = [(1, " ".join(words), "", ""), (2, " ".join(other) + "\nand one more line", "", "")]
    got = {r.doc_id: r.dropped for r in line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: [], 2: [0]}


def test_columns_of_any_name_stay(spark):
    from pyspark.sql import functions as F

    names = ["_hash", "_d", "_h", "_dropped", "hash", "row", "id", "own_id", "text_hash", "line", "group"]
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five\nnew")], "doc_id long, text string")
    got = line_dedup.cleaned(docs.withColumns({c: F.lit(f"of the caller: {c}") for c in names})).collect()
    assert [(r.doc_id, r.text) for r in sorted(got)] == [(1, "one two three four five"), (2, "new")]
    assert all(r[c] == f"of the caller: {c}" for r in got for c in names)


def test_lines_that_only_share_a_key_write_nothing(spark, monkeypatch):
    """Keys of a few lines leave possible pairs only, once each; those of many lines leave all their lines."""
    monkeypatch.setattr(line_dedup, "TASK_BYTES", 1 << 10)
    monkeypatch.setattr(line_dedup, "BUCKET_BYTES", 1 << 11)
    r = random.Random(3)

    def word():
        return "".join(r.choices("abcdefgh", k=9))

    def docs(n, words):
        texts = [" ".join(["same", "start", *(word() for _ in range(words))]) for _ in range(n)]
        return spark.createDataFrame([(t,) for t in texts], "text string")

    shared, met = line_dedup._similar_keys(docs(30, 30), 0.8)
    assert shared.count() == met.count() == 0
    base = [word() for _ in range(30)]
    near = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in range(5)]
    shared, met = line_dedup._similar_keys(spark.createDataFrame([(t,) for t in near * 3], "text string"), 0.8)
    assert shared.count() == 0 and met.count() == 10
    shared, met = line_dedup._similar_keys(docs(line_dedup.ALL_PAIRS + 1, 3), 0.8)
    assert shared.select("id").distinct().count() == line_dedup.ALL_PAIRS + 1


def test_passage_that_many_lines_quote_is_no_key(spark):
    """Grams that are common themselves come last, however rare their words are."""
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefgh", k=9)) for _ in range(60)]
    passage = [f"passage{i}" for i in range(15)]
    lines = [" ".join([*r.choices(vocabulary, k=25), *(passage if i % 5 == 0 else [])]) for i in range(500)]
    shared, _ = line_dedup._similar_keys(spark.createDataFrame([(t,) for t in lines], "text string"), 0.8)
    assert shared.groupBy("key").count().where("count > 64").count() == 0


def test_counts_of_all_documents(spark):
    """How common symbols are is counted over every row, however many there are."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('one two word', id) AS text")
    lines = line_dedup._read_lines(docs).cache()
    assert lines.where("at is null").select("doc_id", "line", "id").distinct().count() == 30_000
    assert lines.where("at < 65536").groupBy().sum("n").first()[0] == 90_000
    lines.unpersist()


def test_family_around_a_line(spark, monkeypatch):
    """Near copies of one line, few of which are similar to one another, are one group with it."""
    monkeypatch.setattr(line_dedup, "ALL_PAIRS", 4)
    monkeypatch.setattr(line_dedup, "PIECE_ROWS", 2)
    r = random.Random(8)
    base = ["".join(r.choices("abcdefgh", k=6)) for _ in range(40)]
    lines = [" ".join(base)]
    for _ in range(60):
        words = list(base)
        for at in r.sample(range(40), r.choice([4, 8, 9, 10])):
            words[at] = "".join(r.choices("abcdefgh", k=6))
        lines.append(" ".join(words))
    rows = [(i, t, "", "") for i, t in enumerate(lines)]
    want, _ = _want(rows)
    got = line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(x.doc_id, i) for x in got for i in x.dropped} == want
