"""Word index, roll-ups and topic partitions."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loglathe import session
from loglathe.operators import rollups, storage, textindex
from loglathe.sinks import outputs

LOG = "timestamp timestamp, tenant_id string, service string, level string, message string, event_date date"


def _logs(spark, rows):
    made = spark.createDataFrame(rows, "at string, tenant_id string, message string")
    return made.select(
        F.col("at").cast("timestamp").alias("timestamp"), "tenant_id", F.lit("s").alias("service"), F.lit("INFO").alias("level"),
        "message", F.to_date(F.col("at").cast("timestamp")).alias("event_date"),
    )


def _land(spark, path, rows):
    _logs(spark, rows).coalesce(1).write.mode("append").partitionBy("event_date").parquet(path)


def test_words(spark):
    df = spark.createDataFrame([("GET /a-b?x=1 a",), ("",), (None,), ("日本 é",), ("x" * 5000,)], "m string")
    got = [r[0] for r in df.select(textindex.tokens(F.col("m"))).collect()]
    assert got == [["get", "a", "b", "x", "1"], [], [], [], ["x" * 5000]]


def test_search_opens_few_files(spark, tmp_path):
    table, index = str(tmp_path / "table"), str(tmp_path / "index")
    r = random.Random(1)
    rows = []
    for n in range(24):  # files of one day, and of another
        day = "2024-01-02" if n % 2 else "2024-01-03"
        part = [(f"{day} {n % 24:02d}:00:{i:02d}", "t", f"Common word{n}, id-{n * 100 + i}" + (" rare Thing" if n in (5, 6) and i == 3 else "")) for i in range(40)]
        part += [(f"{day} 00:00:00", None, None), (f"{day} 00:00:01", "t", "")]
        rows += part
        _land(spark, table, part)
    assert textindex.refresh(spark, table, index) == 24
    assert textindex.refresh(spark, table, index) == 0
    files = lambda words, **days: textindex.matching_files(spark, table, index, words, **days)
    assert len(files(["common"])) == 24 and len(files([])) == 24
    assert len(files(["RARE", "thing"])) == 2
    assert len(files(["rare"], start="2024-01-03 00:00:00")) == 1
    assert files(["rare", "word7"]) == [] and files(["absent"]) == []
    assert len(files([str(7 * 100 + 11)])) == 1
    with pytest.raises(ValueError):
        files(["two words"])

    def want(words, newest):
        found = [x for x in rows if x[2] and set(words) <= set(re.findall("[0-9a-z]+", x[2].lower()))]
        return sorted(((at, m) for at, _, m in found), key=lambda x: x[0], reverse=True)[:newest]

    for words in (["rare"], ["common", "word3"], ["id", str(r.randrange(2400))], ["absent"], ["thing", "rare", "rare"]):
        found = textindex.search(spark, table, index, words, newest=1000)
        assert sorted((str(x.timestamp), x.message) for x in found.collect()) == sorted(want(words, 1000))
        assert len({f for f in found.inputFiles()}) <= max(1, len(files(words))) or not files(words)
    # a file that the index does not know yet is read, one that is gone is not asked for
    _land(spark, table, [("2024-01-03 23:00:00", "t", "rare too")])
    assert len(files(["rare"])) == 3
    assert textindex.refresh(spark, table, index) == 1 and len(files(["rare"])) == 3
    outputs.compact(spark, table, str(tmp_path / "compacted"), ["event_date"])
    assert len(textindex.matching_files(spark, str(tmp_path / "compacted"), index, ["rare"])) == 2


def test_buckets_hold_their_values(spark):
    r = random.Random(2)
    values = [2.0**e for e in range(-30, 31)] + [math.nextafter(2.0**e, 0) for e in range(-30, 31)]
    values += [r.uniform(0, 10 ** r.randint(-6, 9)) for _ in range(500)] + [5e-324, 1e308, 0.0, -1.0, None, math.nan, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "d double").withColumn("b", rollups.bucket(F.col("d")))
    for row in df.select("*", rollups.bucket_low(F.col("b")).alias("low"), rollups.bucket_high(F.col("b")).alias("high")).collect():
        if row.d is None or not math.isfinite(row.d):
            assert row.b is None
        elif row.d <= 0:
            assert row.b == rollups.NOT_POSITIVE and row.low is None and row.high == 0
        elif 1e-300 < row.d < 1e300:
            assert row.low <= row.d < row.high and row.high <= row.low * (1 + 1 / rollups.PARTS)


def _raw(spark, rows):
    made = spark.createDataFrame(rows, "at string, tenant_id string, d double, bad boolean")
    return made.select(F.col("at").cast("timestamp").alias("timestamp"), "tenant_id", "d", "bad", F.to_date(F.col("at").cast("timestamp")).alias("event_date"))


def test_late_minutes_are_counted_again_alone(spark, tmp_path):
    raw, minutes = str(tmp_path / "raw"), str(tmp_path / "minutes")
    r = random.Random(3)

    def some(n, days):
        return [
            (f"2024-01-{r.choice(days):02d} {r.randrange(3):02d}:{r.randrange(4):02d}:{r.randrange(60):02d}", r.choice(["a", "b", None]),
             r.choice([None, 0.0, r.uniform(0, 50), r.uniform(0, 5000)]), r.random() < 0.2) for _ in range(n)
        ]

    def land(rows):
        _raw(spark, rows).write.mode("append").partitionBy("event_date").parquet(raw)

    def count(df, number):
        outputs.write_rollup(rollups.per_minute(df, F.col("d"), F.col("bad")), minutes, number)

    rows = some(800, [1, 2, 3])
    land(rows)
    count(spark.read.parquet(raw), 0)
    for number in (1, 2):
        late = some(7, [2])
        rows += late
        land(late)
        again = rollups.of_minutes(spark.read.parquet(raw), _raw(spark, late))
        touched = {x[0][:16] for x in late}
        assert {str(x.timestamp)[:16] for x in again.collect()} == touched
        count(again, number)
        count(again, number)  # a count that runs again replaces itself
    for every, cut in (("1 hour", 13), ("1 day", 10)):
        got = rollups.summary(rollups.merged(rollups.newest(spark.read.parquet(minutes)), every)).collect()
        groups = collections.defaultdict(list)
        for at, tenant, d, bad in rows:
            groups[at[:cut], tenant].append((d, bad))
        assert len(got) == len(groups)
        for x in got:
            held = groups[str(x.window_start)[:cut], x.tenant_id]
            ds = sorted(d for d, _ in held if d is not None)
            assert (x.logs, x.errors, x.measured) == (len(held), sum(b for _, b in held), len(ds))
            if not ds:
                assert x["mean"] is None and x.p50_below is None
                continue
            assert math.isclose(x["mean"], sum(ds) / len(ds)) and x.longest == ds[-1]
            for q, low, high in ((0.5, x.p50_from, x.p50_below), (0.95, x.p95_from, x.p95_below)):
                exact = ds[max(math.ceil(q * len(ds)) - 1, 0)]
                assert (exact == 0 and low is None and high == 0) or low <= exact < high


def test_empty_rollup(spark):
    none = rollups.per_minute(_raw(spark, []), F.col("d"), F.col("bad"))
    assert rollups.summary(rollups.merged(none)).collect() == []


# hashes that the producers' own tests state
KNOWN = {
    "21": -973932308, "foobar": -790332482, "a-little-bit-long-string": -985981536, "a-little-bit-longer-string": -1486304829,
    "lkjh234lh9fiuh90y23oiuhsafujhadof229phr9h19h89h8": -58897971, "abc": 479470107,
}


def _murmur2(data):
    h = 0x9747B28C ^ len(data)
    m, cut = 0x5BD1E995, 0xFFFFFFFF
    for i in range(0, len(data) // 4 * 4, 4):
        k = int.from_bytes(data[i : i + 4], "little") * m & cut
        h = h * m & cut ^ ((k ^ k >> 24) * m & cut)
    rest = data[len(data) // 4 * 4 :]
    if rest:
        h = (h ^ int.from_bytes(rest, "little")) * m & cut
    h = (h ^ h >> 13) * m & cut
    return h ^ h >> 15


def test_partition_of_a_key(spark):
    r = random.Random(4)
    keys = [*KNOWN, "", "unknown:unknown", "apple:ingestion"] + ["".join(r.choice("abé日:\x00😀") for _ in range(r.randint(1, 30))) for _ in range(200)]
    df = spark.createDataFrame([(k,) for k in [*keys, None]], "k string")
    for row in df.select("k", storage.key_hash(F.col("k")).alias("h"), storage.topic_partition(F.col("k"), 7).alias("p")).collect():
        if row.k is None:
            assert row.h is None and row.p is None
            continue
        assert row.h == _murmur2(row.k.encode()) and row.p == (row.h & 0x7FFFFFFF) % 7
        if row.k in KNOWN:
            assert row.h == KNOWN[row.k] & 0xFFFFFFFF


def test_messages_keep_the_order_of_their_partition(spark, tmp_path):
    rows = [(i, ["a", "b", "c", None][i % 4] if i % 3 else "hot", "svc", f"m{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, tenant_id string, service string, topic string").repartition(7)
    sent = outputs.ordered_messages(df, 5, ["event_id"])
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__partition" in plan and "Sort [__partition" in plan
    outputs.write_messages(sent, str(tmp_path))
    got = spark.read.parquet(str(tmp_path)).select("partition", F.col("key").cast("string").alias("k"), F.get_json_object(F.col("value").cast("string"), "$.event_id").cast("int").alias("i"), "_metadata.file_name", "_metadata.row_index")
    files = collections.defaultdict(list)
    for x in sorted(got.collect(), key=lambda x: x.row_index):
        assert x.k == f"{rows[x.i][1] or 'unknown'}:svc" and x.partition == (_murmur2(x.k.encode()) & 0x7FFFFFFF) % 5
        files[x.partition, x.file_name].append(x.i)
    assert sum(map(len, files.values())) == 3000 and len(files) == len({p for p, _ in files})
    assert all(v == sorted(v) for v in files.values())
    assert session.run_folder(spark, "x")
