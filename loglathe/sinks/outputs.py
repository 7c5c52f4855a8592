"""Batch sinks; each is also usable inside ``foreachBatch``.

Tables written with a ``batch_id`` keep it as their last partition column and
overwrite only the partitions of that batch, so writing a batch twice leaves
one copy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe import fixed
from loglathe.operators import storage

MAX_RECORDS_PER_FILE = 5_000_000


def _write(
    df: DataFrame,
    path: str,
    partitions: Sequence[str],
    mode: str,
    batch_id: int | None,
    compression: str | None = None,
) -> None:
    columns = list(partitions)
    if batch_id is not None:
        df = df.withColumns({"batch_id": F.lit(batch_id).cast("bigint")})
        columns.append("batch_id")
        mode = "overwrite"
    writer = df.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    if batch_id is not None:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if compression:
        writer = writer.option("compression", compression)
    if columns:
        writer = writer.partitionBy(*columns)
    writer.parquet(path)


def write_hot(df: DataFrame, path: str, mode: str = "append", batch_id: int | None = None) -> None:
    """Log table: one folder per day, files sorted by tenant, service and time.

    The rebalance step sizes the files and splits a day or tenant that holds
    most of the rows; it costs the one shuffle that the file layout needs.
    """
    rows = df.hint("rebalance", "event_date", "tenant_id").sortWithinPartitions(
        "event_date", "tenant_id", "service", "timestamp"
    )
    _write(rows, path, ["event_date"], mode, batch_id)


def compact(spark, path: str, into: str, partitions: Sequence[str] = (), sort: Sequence[str] = ()) -> None:
    """Write a table of many micro-batches anew with few, evenly sized files per partition.

    The batch numbers go: run it on partitions, or a table, that no micro-batch
    can write any more, and let readers go on with the new folder.
    """
    rows = spark.read.parquet(path)
    rows = rows.drop("batch_id")
    if partitions:
        rows = rows.hint("rebalance", *partitions)
    if sort:
        rows = rows.sortWithinPartitions(*partitions, *sort)
    _write(rows, into, partitions, "overwrite", None)


def write_archive(
    df: DataFrame,
    path: str,
    mode: str = "append",
    batch_id: int | None = None,
    by: str = "event",
) -> None:
    """Cold archive: snappy Parquet under year, month and day.

    ``by`` is ``event`` for the log's own day or ``ingest`` for the day it came in.
    """
    if by not in ("event", "ingest"):
        raise ValueError(f"unknown archive day: {by!r}")
    day = F.col("timestamp") if by == "event" else F.col("ingested_at")
    rows = df.drop("event_date").withColumns(
        {
            "year": F.date_format(day, "yyyy"),
            "month": F.date_format(day, "MM"),
            "day": F.date_format(day, "dd"),
        }
    )
    rows = rows.hint("rebalance", "year", "month", "day").sortWithinPartitions(
        "year", "month", "day"
    )
    _write(rows, path, ["year", "month", "day"], mode, batch_id, "snappy")


def write_index(df: DataFrame, path: str, mode: str = "append", batch_id: int | None = None) -> None:
    """Processed logs that passed every stage."""
    _write(df, path, [], mode, batch_id)


def write_dead_letters(
    df: DataFrame, path: str, mode: str = "append", batch_id: int | None = None
) -> None:
    """Rows that failed, with their text, the reason and the time."""
    _write(df, path, [], mode, batch_id)


def write_landing(df: DataFrame, path: str, mode: str = "append", batch_id: int | None = None) -> None:
    """Envelopes as JSON lines, the buffer between intake and transform."""
    if batch_id is None:
        df.write.mode(mode).json(path)
    else:
        rows = df.withColumns({"batch_id": F.lit(batch_id).cast("bigint")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "batch_id"
        ).json(path)


def commit(spark: SparkSession, manifest: str, batch_id: int) -> None:
    """Note that a micro-batch is in all its tables."""
    _write(spark.range(1).select(F.current_timestamp().alias("committed_at")).coalesce(1), manifest, [], "append", batch_id)


def last_committed(spark: SparkSession, manifest: str) -> int | None:
    """Number of the last micro-batch that is whole; micro-batches are written one after the other, so all before are."""
    try:
        return spark.read.parquet(manifest).agg(F.max("batch_id")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def committed(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """Rows of the table that belong to whole micro-batches; the number is a partition, so the rest is not opened."""
    last = last_committed(spark, manifest)
    return spark.read.parquet(path).where(F.col("batch_id") <= F.lit(-1 if last is None else last))


def producer_options(servers: str, **extra: str) -> dict[str, str]:
    """Options of the Kafka writer: full acknowledgement, snappy, short linger."""
    return {"kafka.bootstrap.servers": servers, **fixed.PRODUCER_OPTIONS, **extra}


def publish_topic(messages: DataFrame, servers: str, **extra: str) -> None:
    """Send messages to Kafka; needs Spark's Kafka connector on the class path."""
    messages.write.format("kafka").options(**producer_options(servers, **extra)).save()


def ordered_messages(
    df: DataFrame,
    partitions: int,
    order: Sequence[str],
    topic: str = fixed.TOPIC_INGESTED,
    key: Column | None = None,
) -> DataFrame:
    """Messages with the topic partition of their key, each partition as one run of rows in the given order.

    A partition of a topic is a sequence by definition, so one task sends it, whatever share of the rows it has; the
    sort spills. Send the result with ``publish_topic`` (the sink takes the ``partition`` column) or write it as files.
    """
    named = df.withColumns({"__key": storage.message_key(df) if key is None else key})
    named = named.withColumns({"__partition": storage.topic_partition(F.col("__key"), partitions)})
    named = named.repartition(partitions, "__partition").sortWithinPartitions("__partition", *order)
    inner = named.select(F.col("__key"), F.col("__partition"), F.struct(*df.columns).alias("__row"))
    return inner.select(
        F.col("__key").cast("binary").alias("key"),
        storage.message_value(F.col("__row")).cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.col("__partition").alias("partition"),
    )


def write_messages(messages: DataFrame, path: str, mode: str = "append", batch_id: int | None = None) -> None:
    """Messages of ``ordered_messages`` as files, one folder per topic partition, in their order."""
    _write(messages, path, ["partition"], mode, batch_id)


def write_rollup(df: DataFrame, path: str, batch_id: int) -> None:
    """Counts per minute by day; the number says which count of a minute is the last."""
    _write(df.hint("rebalance", "event_date"), path, ["event_date"], "append", batch_id)


def publish_files(
    df: DataFrame,
    path: str,
    topic: str = fixed.TOPIC_INGESTED,
    order: Sequence[str] = (),
    mode: str = "append",
    batch_id: int | None = None,
    key: Column | None = None,
) -> None:
    """Keyed messages as Parquet, the offline stand-in for a topic.

    With ``order`` the rows are range partitioned by key and those columns, so
    a key keeps its order over the sequence of files, and a key with most of
    the rows is spread over many of them.  Without it nothing is shuffled.
    """
    if order:
        by = [storage.message_key(df), *[F.col(c) for c in order]]
        df = df.repartitionByRange(*by).sortWithinPartitions(*by)
    _write(storage.keyed_messages(df, topic, key), path, [], mode, batch_id)


_SINKS: dict[str, Callable[..., None]] = {
    "hot": write_hot,
    "cold": write_archive,
    "index": write_index,
    "dlq": write_dead_letters,
    "landing": write_landing,
    "kafka": publish_topic,
    "files": publish_files,
}


def sink(kind: str) -> Callable[..., None]:
    if kind not in _SINKS:
        raise ValueError(f"unknown sink: {kind!r}")
    return _SINKS[kind]
