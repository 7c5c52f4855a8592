"""Micro-batches bounded in records, measured depth, and tables that show whole micro-batches only."""

import collections

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loglathe.operators import storage
from loglathe.sinks import outputs
from loglathe.sources import records
from loglathe.streaming import jobs

SCHEMA = "i long, t timestamp, m map<string,string>, s string"


def _land(spark, path, low, high, files=1):
    rows = spark.range(low, high, 1, files).select(
        F.col("id").alias("i"), F.timestamp_seconds("id").alias("t"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("m"),
        F.when(F.col("id") % 3 > 0, F.lit("x")).alias("s"), F.lit(1).alias("unused"),
    )
    rows.write.mode("append").option("parquet.block.size", 4096).parquet(path)


def _run(spark, tmp_path, sink, most=100):
    flow = records.bounded(spark, str(tmp_path / "in"), str(tmp_path / "log"), SCHEMA, most)
    jobs.drain(jobs.run(flow, sink, str(tmp_path / "checkpoint"), every="0 seconds"))


def test_every_record_once_in_bounded_batches(spark, tmp_path):
    table = str(tmp_path / "table")
    _land(spark, str(tmp_path / "in"), 0, 7)
    _land(spark, str(tmp_path / "in"), 7, 700, files=3)
    _run(spark, tmp_path, jobs.table_sink(table))
    _land(spark, str(tmp_path / "in"), 700, 703)
    _land(spark, str(tmp_path / "in"), 703, 1003, files=2)
    _run(spark, tmp_path, jobs.table_sink(table), most=150)  # a restarted job, with another bound
    rows = spark.read.parquet(table).collect()
    assert sorted(r.i for r in rows) == list(range(1003))
    assert all(r.m == {"k": str(r.i)} and int(r.t.timestamp()) == r.i and (r.s is None) == (r.i % 3 == 0) for r in rows)
    sizes = collections.Counter(r.batch_id for r in rows)
    assert [sizes[b] for b in range(10)] == [100] * 7 + [150, 150, 3]
    assert records.consumed(spark, str(tmp_path / "checkpoint")) == 1003
    _land(spark, str(tmp_path / "in"), 1003, 1010)
    assert records.depth(spark, str(tmp_path / "in"), str(tmp_path / "checkpoint")) == 7
    assert records.depth(spark, str(tmp_path / "in"), str(tmp_path / "checkpoint"), 2) == 710


def test_a_failed_batch_runs_again_with_its_records(spark, tmp_path):
    seen, table = [], str(tmp_path / "table")
    _land(spark, str(tmp_path / "in"), 0, 350, files=2)

    def sink(batch, batch_id):
        seen.append((batch_id, sorted(r.i for r in batch.collect())))
        if len(seen) == 2:
            raise RuntimeError("lost")
        jobs.table_sink(table)(batch, batch_id)

    with pytest.raises(StreamingQueryException):
        _run(spark, tmp_path, sink)
    _land(spark, str(tmp_path / "in"), 350, 360)
    _run(spark, tmp_path, sink)
    assert [b for b, _ in seen] == [0, 1, 1, 2, 3] and seen[1] == seen[2]
    assert all(len(i) <= 100 for _, i in seen)
    assert sorted(r.i for r in spark.read.parquet(table).collect()) == list(range(360))


def test_nothing_landed(spark, tmp_path):
    _run(spark, tmp_path, jobs.table_sink(str(tmp_path / "table")))
    assert not list((tmp_path / "table").rglob("*.parquet"))  # one micro-batch of nothing


def test_readers_see_whole_batches_only(spark, tmp_path, monkeypatch):
    src, hot, cold, manifest = (str(tmp_path / x) for x in ("src", "hot", "cold", "manifest"))

    def land(low, high):
        rows = spark.range(low, high).select(
            F.timestamp_seconds("id").alias("timestamp"), F.lit("t").alias("tenant_id"), F.lit("s").alias("service"), F.col("id").cast("string").alias("message")
        )
        storage.hot_rows(rows, "2026-04-04 10:00:00").coalesce(1).write.mode("append").parquet(src)

    def go():
        flow = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.run(flow, jobs.hot_and_cold(hot, cold, "2026-04-04 10:00:00", manifest), str(tmp_path / "checkpoint")).awaitTermination()

    def seen():
        return [sorted(int(r.message) for r in outputs.committed(spark, p, manifest).collect()) for p in (hot, cold)]

    land(0, 10)
    go()
    land(10, 30)
    write = outputs.write_archive

    def stop(*args, **more):
        raise RuntimeError("lost between the writes")

    monkeypatch.setattr(outputs, "write_archive", stop)
    with pytest.raises(StreamingQueryException):
        go()
    assert spark.read.parquet(hot).count() == 30  # the first write is there
    assert seen() == [list(range(10))] * 2  # and does not show
    monkeypatch.setattr(outputs, "write_archive", write)
    go()
    assert seen() == [list(range(30))] * 2
    assert outputs.last_committed(spark, str(tmp_path / "none")) is None
    assert outputs.committed(spark, hot, str(tmp_path / "none")).count() == 0
