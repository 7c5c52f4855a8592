"""Schema versions, and keys passed on once."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.operators import versions
from loglathe.operators.versions import Incompatible, Versions
from loglathe.streaming import jobs


def _schema(ddl):
    return T.StructType.fromDDL(ddl)


BASE = "a string not null, n int not null, o string"


@pytest.mark.parametrize(
    ("ddl", "backward", "forward"),
    [
        ("a string not null, n int not null, o string, extra string", True, True),
        ("a string not null, n int not null, o string, extra string not null", False, True),
        ("a string not null, n int not null", True, True),  # o was optional
        ("a string not null, o string", True, False),  # n was required
        ("a string not null, n bigint not null, o string", True, False),
        ("a string not null, n double not null, o string", True, False),
        ("a string not null, n string not null, o string", False, False),
        ("a string, n int not null, o string", True, False),
        ("a string not null, n int not null, o string not null", False, True),
        ("o string, n int not null, a string not null", True, True),
    ],
)
def test_rules(spark, ddl, backward, forward):
    base, new = _schema(BASE), _schema(ddl)
    held = Versions().declare("t", base)
    for rule, allowed in (("backward", backward), ("forward", forward), ("full", backward and forward), ("none", True)):
        if allowed:
            assert held.declare("t", new, rule).topics["t"] == (base, new)
        else:
            with pytest.raises(Incompatible):
                held.declare("t", new, rule)


def test_nested_types_and_repeats(spark):
    old = _schema("x array<int>, m map<string,int>, s struct<k: int>")
    assert not versions.unreadable(_schema("x array<bigint>, m map<string,double>, s struct<k: bigint, more: string>"), old)
    assert len(versions.unreadable(_schema("x array<string>, m map<string,string>, s struct<k: string>"), old)) == 3
    held = Versions().declare("t", old)
    assert held.declare("t", old) is held
    with pytest.raises(ValueError):
        held.declare("t", old, "sideways")


def test_saved_and_validated(spark, tmp_path):
    held = Versions().declare("t", _schema("a string not null")).declare("t", _schema("a string not null, n bigint")).declare("u", _schema(BASE))
    held.save(spark, str(tmp_path))
    assert Versions.load(spark, str(tmp_path)) == held
    cases = [
        ('{"a":"x"}', 2, None),
        ('{"a":"x","n":"1"}', 2, "n: expected bigint"),
        ('{"a":"x","n":"1","schema_version":1}', 1, None),
        ('{"a":1,"schema_version":1}', 1, "a: expected string"),
        ('{"a":"x","n":null,"schema_version":null}', 2, None),
        ('{"a":"x","schema_version":3}', 3, "schema version 3 is not declared"),
        ('{"a":"x","schema_version":0}', 0, "schema version 0 is not declared"),
        ('{"a":"x","schema_version":"1"}', None, "schema_version: whole number expected"),
        ('{"a":"x","schema_version":1.5}', None, "schema_version: whole number expected"),
        ("[1]", None, "not a JSON object"),
        ("", None, "not a JSON object"),
        (None, None, "not a JSON object"),
    ]
    df = spark.createDataFrame([(c[0], i) for i, c in enumerate(cases)], "value string, i int")
    got = versions.validate(df, held, "t").orderBy("i").collect()
    assert [(r.value, r.schema_version, r.schema_error) for r in got] == cases
    with pytest.raises(ValueError):
        versions.validate(df, held, "none")


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_keys_are_passed_on_once(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(jobs, "SMALL_BATCH", small)
    src, table = str(tmp_path / "src"), str(tmp_path / "table")
    sink = jobs.first_time_only(jobs.table_sink(table), str(tmp_path / "seen"))

    def go(ids, sink=sink):
        if ids:
            rows = spark.createDataFrame([(i,) for i in ids], "event_id string").withColumn("n", F.lit(len(ids)))
            rows.write.mode("append").parquet(src)
        flow = spark.readStream.schema("event_id string, n int").parquet(src)
        jobs.run(flow, sink, str(tmp_path / "checkpoint")).awaitTermination()

    go(["a", "b", "a", None])
    go(["b", "c", None, None])

    def stop(batch, batch_id):
        sink(batch, batch_id)
        raise RuntimeError("lost after its keys were noted")

    with pytest.raises(StreamingQueryException):
        go(["d", "a", "e"], stop)
    go([])
    go(["e", "f"])
    rows = [r.event_id for r in spark.read.parquet(table).collect()]
    assert sorted(x for x in rows if x) == list("abcdef") and rows.count(None) == 3
