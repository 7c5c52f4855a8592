"""Streaming jobs: the batch functions on ``readStream``, with idempotent sinks.

A job's position is its checkpoint.  A micro-batch that is run again after a
failure overwrites its own partitions, so delivery is at least once and the
tables hold one copy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loglathe.operators import analytics, processing, storage
from loglathe.operators.routing import V2, Registry
from loglathe.operators.transform import transform_logs
from loglathe.sinks import outputs
from loglathe.sources import records

BatchSink = Callable[[DataFrame, int], None]


def run(
    df: DataFrame,
    write: BatchSink,
    checkpoint: str,
    every: str | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Start a job.  Without ``every`` it handles what is there and stops."""
    writer = df.writeStream.foreachBatch(write).outputMode(mode)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def transform_stream(envelopes: DataFrame, registry: Registry = V2) -> DataFrame:
    """Envelope stream to parsed stream; the same plan as the batch."""
    return transform_logs(envelopes, registry)


def hot_and_cold(hot_path: str, cold_path: str, now=None, manifest: str | None = None) -> BatchSink:
    """Write each micro-batch to the log table and to the archive.

    With a manifest, a micro-batch that is in one table only, after a failure between the writes, shows in neither:
    readers go through ``outputs.committed``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        outputs.write_hot(storage.hot_rows(batch, now), hot_path, batch_id=batch_id)
        # the archive is made of the rows just written, so nothing is parsed twice or cached
        written = batch.sparkSession.read.parquet(hot_path).where(F.col("batch_id") == batch_id)
        outputs.write_archive(written.drop("batch_id"), cold_path, batch_id=batch_id)
        if manifest is not None:
            outputs.commit(batch.sparkSession, manifest, batch_id)

    return write


def index_or_dead_letter(
    index_path: str, dlq_path: str, key: str = "event_id", now=None, schema=None
) -> BatchSink:
    """Process raw messages; passed rows to the index, failed ones to the dead letters."""

    def write(batch: DataFrame, batch_id: int) -> None:
        done = processing.process_logs(batch, schema=schema).persist()
        try:
            outputs.write_index(processing.indexed_rows(done), index_path, batch_id=batch_id)
            outputs.write_dead_letters(
                processing.dead_letters(done, key, now=now), dlq_path, batch_id=batch_id
            )
        finally:
            done.unpersist()

    return write


def table_sink(path: str) -> BatchSink:
    """Plain table of whatever the stream yields."""

    def write(batch: DataFrame, batch_id: int) -> None:
        outputs.write_index(batch, path, batch_id=batch_id)

    return write


def ordered_topic(servers: str, topic: str, partitions: int, order: Sequence[str], **extra: str) -> BatchSink:
    """Keyed messages of each micro-batch to a Kafka topic, in order inside each of its partitions."""

    def write(batch: DataFrame, batch_id: int) -> None:
        outputs.publish_topic(outputs.ordered_messages(batch, partitions, order, topic), servers, **extra)

    return write


def drain(query: StreamingQuery) -> None:
    """Let a job with a processing-time trigger take all that has landed, and stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def with_depth_samples(write: BatchSink, landing: str, checkpoint: str, samples: str) -> BatchSink:
    """After each micro-batch, note how many landed records are still to come (`second`, `depth`, `consumed`)."""

    def both(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        spark = batch.sparkSession
        taken = records.consumed(spark, checkpoint, batch_id)
        left = records.depth(spark, landing, checkpoint, batch_id)
        row = spark.range(1).select(
            F.date_trunc("second", F.current_timestamp()).alias("second"),
            F.lit(left).cast("bigint").alias("depth"),
            F.lit(taken).cast("bigint").alias("consumed"),
        )
        outputs.write_index(row, samples, batch_id=batch_id)

    return both


def deduplicated(df: DataFrame, key: str = "event_id", within: str = "1 hour") -> DataFrame:
    """Drop repeats of an event that are received within the given time of each other.

    The watermark follows the time a row is received, which never runs
    backwards: an old event is not late, and none is lost.
    """
    received = df.withColumns({"__received": F.current_timestamp()}).withWatermark("__received", within)
    return received.dropDuplicatesWithinWatermark([key]).drop("__received")


SEEN_BUCKETS = 64
SMALL_BATCH = 1_000_000  # ids of a micro-batch that are sent to all executors


def first_time_only(write: BatchSink, seen: str, key: str = "event_id") -> BatchSink:
    """Pass on only rows whose key no earlier micro-batch had, however long ago, and of equal keys one row.

    Keys are kept as a narrow table in buckets of their hash. Against a micro-batch of few keys the table is only read, in
    the buckets that it touches; against a large one both are shuffled by key. The keys of a micro-batch are noted
    after its rows are written, and one that runs again overwrites its own: rows are then passed on again, to a sink
    that replaces them. Rows without a key are all passed on.
    """

    def once(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(SEEN_BUCKETS)).cast("int").alias("bucket")
        table = T.StructType([batch.schema[key], T.StructField("bucket", T.IntegerType()), T.StructField("batch_id", T.LongType())])
        spark.createDataFrame([], table).write.mode("ignore").partitionBy("bucket", "batch_id").parquet(seen)
        held = spark.read.schema(table).parquet(seen).where(F.col("batch_id") < batch_id)
        batch = batch.persist()
        try:
            keys = batch.select(key, bucket).where(F.col(key).isNotNull()).distinct()
            asked = F.broadcast(keys) if keys.count() <= SMALL_BATCH else keys
            known = held.join(asked, ["bucket", key], "left_semi").select(key).distinct()
            fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).join(known, key, "left_anti")
            write(fresh.unionByName(batch.where(F.col(key).isNull())), batch_id)
            noted = keys.withColumns({"batch_id": F.lit(batch_id).cast("bigint")})
            writer = noted.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("bucket", "batch_id").parquet(seen)
        finally:
            batch.unpersist()

    return once


def counted_into(path: str, count: Callable[[DataFrame], DataFrame]) -> BatchSink:
    """Counts of each micro-batch as rows of their own; ``summed`` adds them up.

    No state and no watermark: a row that comes late, however late, adds to its
    window like any other, and a micro-batch that runs again replaces its counts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        outputs.write_index(count(batch), path, batch_id=batch_id)

    return write


def rate_counts(by=("tenant_id", "service"), every: str = "1 minute") -> Callable[[DataFrame], DataFrame]:
    return lambda df: analytics.ingestion_rate(df, by, every)


def error_counts(
    is_error: Column, by=("family",), every: str = "1 hour"
) -> Callable[[DataFrame], DataFrame]:
    return lambda df: analytics.error_frequency(df, is_error, by, every).drop("error_rate")


def summed(df: DataFrame, counts: list[str]) -> DataFrame:
    """Totals of the counts of all micro-batches."""
    keys = [c for c in df.columns if c not in counts and c != "batch_id"]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
