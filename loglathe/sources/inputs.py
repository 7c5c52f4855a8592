"""Batch and streaming sources.

``source(kind)`` gives a reader for one of the known kinds.  Bounded fetches
are trigger options of the stream, and consumed positions live in its
checkpoint; connection retries belong to Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe import fixed, schemas
from loglathe.operators import intake

MAX_FILES = 256  # new files that a stream takes in one micro-batch; None lifts the bound


def request_files(
    spark: SparkSession, path: str, stream: bool = False, max_files: int | None = MAX_FILES
) -> DataFrame:
    """Request batches from JSON lines, decoded to request columns.

    ``client_ip`` and ``arrival`` are facts of the receiving side, so they are
    taken from the line only when the landing job wrote them there.
    """
    reader = spark.readStream if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(path)
    extra = F.from_json("value", "request_id string, client_ip string, arrival timestamp")
    return intake.decode_requests(lines.withColumns({"__extra": extra})).select(
        F.coalesce(F.col("__extra.request_id"), F.sha2("value", 256)).alias("request_id"),
        "tenant_id",
        "service",
        "source",
        F.col("__extra.client_ip").alias("client_ip"),
        F.col("__extra.arrival").alias("arrival"),
        "logs",
        "value",
    )


def envelope_files(
    spark: SparkSession, path: str, stream: bool = False, max_files: int | None = MAX_FILES
) -> DataFrame:
    """Landed envelopes (the buffer between intake and transform)."""
    reader = spark.readStream if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.schema(schemas.ENVELOPE).json(path)


def table_files(
    spark: SparkSession,
    path: str,
    name: str | None = None,
    stream: bool = False,
    max_files: int | None = MAX_FILES,
) -> DataFrame:
    """Parquet table; ``name`` picks one file of a folder, also for a stream."""
    if not stream:
        return spark.read.parquet(f"{path}/{name}" if name else path)
    schema = spark.read.parquet(f"{path}/{name}" if name else path).schema
    reader = spark.readStream.schema(schema)
    if name:
        reader = reader.option("pathGlobFilter", name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def message_files(
    spark: SparkSession, path: str, stream: bool = False, max_files: int | None = MAX_FILES
) -> DataFrame:
    """Messages (``key``, ``value``, ``topic``) written by the offline message sink."""
    reader = spark.readStream.schema(schemas.MESSAGE) if stream else spark.read.schema(schemas.MESSAGE)
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def topic_options(
    servers: str,
    topic: str = fixed.TOPIC_RAW,
    starting: str = "earliest",
    max_records: int | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """Options of the Kafka reader: earliest when there is no position yet."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": "true",
    }
    if max_records:
        options["maxOffsetsPerTrigger"] = str(max_records)
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    return options


def topic(spark: SparkSession, servers: str, stream: bool = True, **options) -> DataFrame:
    """Messages of a Kafka topic; needs Spark's Kafka connector on the class path."""
    reader = spark.readStream if stream else spark.read
    return reader.format("kafka").options(**topic_options(servers, **options)).load()


def message_text(messages: DataFrame) -> DataFrame:
    """UTF-8 text of key and value."""
    return messages.withColumns(
        {"key": F.col("key").cast("string"), "value": F.col("value").cast("string")}
    )


_SOURCES: dict[str, Callable[..., DataFrame]] = {
    "requests": request_files,
    "envelopes": envelope_files,
    "files": message_files,
    "table": table_files,
    "kafka": topic,
}


def source(kind: str) -> Callable[..., DataFrame]:
    if kind not in _SOURCES:
        raise ValueError(f"unknown source: {kind!r}")
    return _SOURCES[kind]
