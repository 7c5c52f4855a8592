"""Projections of parsed rows into what the sinks store."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe import fixed
from loglathe.functions import ids, maps


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _merged_metadata(df: DataFrame) -> Column:
    """Metadata together with the parsed attributes, which win."""
    empty = F.expr("map()").cast("map<string,string>")
    metadata = F.coalesce(_col(df, "metadata", "map<string,string>"), empty)
    if "attributes" not in df.columns:
        return metadata
    attributes = F.coalesce(F.col("attributes"), empty)
    return F.when(F.size(attributes) == 0, metadata).otherwise(maps.merge(metadata, attributes))


def storage_rows(df: DataFrame) -> DataFrame:
    """The seven stored columns with their defaults."""
    named = {
        name: F.coalesce(_col(df, name).cast("string"), F.lit(default))
        for name, default in fixed.STORAGE_DEFAULTS.items()
    }
    return df.select(
        _col(df, "timestamp", "timestamp").alias("timestamp"),
        *[column.alias(name) for name, column in named.items()],
        _merged_metadata(df).alias("metadata"),
    )


def hot_rows(df: DataFrame, now: dt.datetime | str | Column | None = None) -> DataFrame:
    """Rows of the day-partitioned log table.

    Takes envelopes (``raw_payload``, ``service_name``) as well as storage rows
    (``message``, ``service``); the time is cut to milliseconds.
    """
    message = _col(df, "message") if "message" in df.columns else _col(df, "raw_payload")
    service = _col(df, "service") if "service" in df.columns else _col(df, "service_name")
    stamp = F.date_trunc("millisecond", F.col("timestamp"))
    default = fixed.HOT_DEFAULTS
    return df.select(
        stamp.alias("timestamp"),
        _col(df, "tenant_id").alias("tenant_id"),
        F.coalesce(service, F.lit(default["service"])).alias("service"),
        F.coalesce(_col(df, "source"), F.lit("generic")).alias("source"),
        F.coalesce(_col(df, "level"), F.lit(default["level"])).alias("level"),
        F.coalesce(message, F.lit(default["message"])).alias("message"),
        _merged_metadata(df).alias("metadata"),
        ids.now_or(now).alias("ingested_at"),
        F.to_date(stamp).alias("event_date"),
    )


def message_key(df: DataFrame) -> Column:
    """Partition key ``tenant:service``; a missing part is ``unknown``."""
    service = "service_name" if "service_name" in df.columns else "service"
    unknown = F.lit("unknown")
    return F.concat_ws(
        ":",
        F.coalesce(_col(df, "tenant_id").cast("string"), unknown),
        F.coalesce(_col(df, service).cast("string"), unknown),
    )


_SEED, _FACTOR, _32 = 0x9747B28C, 0x5BD1E995, 0xFFFFFFFF  # fixed values of the producers' hash


def _times(x: Column) -> Column:
    """Product with the factor in 32 bits; it fits 63 bits before it is cut."""
    return (x * F.lit(_FACTOR)).bitwiseAND(F.lit(_32))


def _fold(x: Column, bits: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, bits))


def key_hash(key: Column) -> Column:
    """MurmurHash2 (32 bits) of the bytes of a key, as Kafka producers take it; NULL for NULL."""

    def of(data: Column) -> Column:  # the bytes as hex digits
        size = F.length(data) / 2
        whole = F.floor(size / 4).cast("int")

        def byte(at: Column) -> Column:
            return F.coalesce(F.conv(F.nullif(F.substring(data, at * 2 + 1, F.lit(2)), F.lit("")), 16, 10).cast("bigint"), F.lit(0))

        def mixed(done: Column, block: Column) -> Column:
            k = byte(block * 4)
            for i in (1, 2, 3):
                k = k + F.shiftleft(byte(block * 4 + i), 8 * i)
            return _times(done).bitwiseXOR(_times(_fold(_times(k), 24)))

        blocks = F.when(whole > 0, F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        start = F.lit(_SEED).bitwiseXOR(size.cast("bigint"))
        rest = byte(whole * 4) + F.shiftleft(byte(whole * 4 + 1), 8) + F.shiftleft(byte(whole * 4 + 2), 16)

        def ended(done: Column) -> Column:
            tail = F.when(size % 4 > 0, _times(done.bitwiseXOR(rest))).otherwise(done)
            return _fold(_times(_fold(tail, 13)), 15)

        return F.aggregate(blocks, start, mixed, ended)

    return F.transform(F.array(F.hex(key.cast("binary"))), of)[0]


def topic_partition(key: Column, partitions: int) -> Column:
    """Partition of a topic that producers choose for a key."""
    return (key_hash(key).bitwiseAND(F.lit(0x7FFFFFFF)) % partitions).cast("int")


def message_value(row: Column) -> Column:
    """JSON of a row as the message sink takes it."""
    return F.to_json(row, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"})


def keyed_messages(
    df: DataFrame, topic: str = fixed.TOPIC_INGESTED, key: Column | None = None
) -> DataFrame:
    """Key, JSON value and topic of each row, as the message sink takes them."""
    value = message_value(F.struct(*[F.col(c) for c in df.columns]))
    return df.select(
        (message_key(df) if key is None else key).cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
    )
