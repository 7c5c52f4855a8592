"""Declared schemas of the records that enter, move through and leave the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

_METADATA = T.MapType(T.StringType(), T.StringType())

LOG_ENTRY = T.StructType(
    [
        T.StructField("message", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("level", T.StringType()),
        T.StructField("metadata", _METADATA),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("arrival", T.TimestampType()),
        T.StructField("logs", T.ArrayType(LOG_ENTRY)),
    ]
)

ENVELOPE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("ingestion_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("origin_ip", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("client_time", T.LongType()),
        T.StructField("client_time_problem", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("metadata", _METADATA),
    ]
)

# messages on the topics of the processing side; nullable=False means required
RAW_LOG = T.StructType(
    [
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("metadata", _METADATA, True),
    ]
)

LOGS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("metadata", _METADATA),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
    ]
)
