"""Routed transforms over mixed lines, and the batch template of both dialects."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions import ids, maps, text
from loglathe.operators.parsers_v1 import parse_lines
from loglathe.operators.parsing import parse_mixed
from loglathe.operators.routing import V1, V2, Registry, route, v1_source

Now = dt.datetime | str | Column | None


def transform_logs(
    df: DataFrame,
    registry: Registry = V2,
    payload: str = "raw_payload",
    source: str = "source",
    on_error: str = "keep",
) -> DataFrame:
    """Route each envelope, parse its payload and attach the ``attributes`` map.

    One pass over the input with one broadcast lookup; no shuffle.  A missing
    (NULL) source counts as ``generic``, an empty one goes to the default family.
    ``on_error``: ``keep`` leaves ``parse_error`` for a dead-letter split,
    ``drop`` removes those rows.
    """
    if on_error not in ("keep", "drop"):
        raise ValueError(f"unknown on_error: {on_error!r}")
    key = F.coalesce(F.col(source), F.lit("generic"))
    routed = route(df, key, registry)
    # a missing payload is the empty text, as in the envelope
    parsed = parse_mixed(
        routed, registry.parsers, "parser_key", text=F.coalesce(F.col(payload), F.lit(""))
    ).drop("parser_key")
    if on_error == "drop":
        parsed = parsed.where(F.col("parse_error").isNull()).drop("parse_error")
    return parsed


def transform_logs_v1(
    df: DataFrame,
    registry: Registry = V1,
    message: str = "message",
    source: str = "source",
    service: str = "service",
    now: Now = None,
) -> DataFrame:
    """Route, parse and re-attach tenant, service, source and ingest time."""
    key = v1_source(df, source, service)
    line = F.coalesce(F.col(message), F.lit(""))
    # the parsed columns take over these names
    routed = route(
        df.withColumns({"__line": line, "__source": key, "__service": F.col(service)}).drop(
            *[c for c in ("message", "level", "metadata", "attributes", "timestamp") if c in df.columns]
        ),
        F.col("__source"),
        registry,
    )
    kept = routed.withColumnsRenamed({"__line": "line_text"}).withColumns(
        {"source": F.col("__source"), "service": F.coalesce(F.col("__service"), F.lit("unknown"))}
    ).drop("__source", "__service")
    parsed = parse_lines(kept, registry.parsers, F.col("parser_key"), F.col("line_text"), now)
    return parsed.withColumns({"ingested_at": ids.now_or(now)}).drop("line_text", "parser_key")


def _entries(df: DataFrame, logs: str) -> DataFrame:
    return df.select("*", F.posexplode(logs).alias("pos", "entry")).drop(logs)


def _entry_time(now: Column) -> Column:
    """The entry's own epoch seconds, or now when it is missing, zero or no time in seconds."""
    own = F.nullif(F.col("entry.timestamp"), F.lit(0))
    return F.coalesce(ids.client_time(own), now)


def process_batch(
    df: DataFrame,
    registry: Registry = V2,
    batch_id: str = "batch_id",
    now: Now = None,
    id_mode: str = "stable",
) -> DataFrame:
    """v2 batch template: one row per log of ``(tenant_id, source, logs)``.

    Blank logs and logs whose parser fails become fallback rows: no source and
    no ingest time, attributes ``error`` and ``raw_captured``.
    """
    ingest = ids.now_or(now)
    rows = _entries(df, "logs").withColumns(
        {
            "tenant_id": F.coalesce(F.col("tenant_id"), F.lit("system")),
            "source": F.coalesce(F.col("source"), F.lit("generic")),
            "message": F.coalesce(F.col("entry.message"), F.lit("")),
        }
    )
    parsed = parse_mixed(route(rows, F.col("source"), registry), registry.parsers, "parser_key", text="message")
    reason = F.when(~text.not_blank(F.col("message")), "Empty log").otherwise(F.col("parse_error"))
    failed = F.col("reason").isNotNull()
    return parsed.withColumns({"reason": reason}).select(
        ids.event_id(id_mode, F.col(batch_id), F.col("pos")).alias("log_id"),
        "tenant_id",
        F.when(~failed, F.col("source")).alias("source"),
        F.when(failed, ingest).otherwise(_entry_time(ingest)).alias("timestamp"),
        "message",
        F.when(
            failed, maps.text_map({"error": F.col("reason"), "raw_captured": F.lit("true")})
        ).otherwise(F.col("attributes")).alias("attributes"),
        F.when(~failed, ids.iso_utc(ingest)).alias("ingested_at"),
    )


def process_batch_v1(
    df: DataFrame,
    registry: Registry = V2,
    batch_id: str = "batch_id",
    now: Now = None,
    id_mode: str = "stable",
) -> DataFrame:
    """v1 batch template: keeps level and metadata of the entry; v1 defaults and reasons.

    The hook it calls is the same message parser as in v2, so it takes any
    registry of such parsers.
    """
    ingest = ids.now_or(now)
    rows = _entries(df, "logs").withColumns(
        {
            "tenant_id": F.coalesce(F.col("tenant_id"), F.lit("unknown")),
            "service": F.coalesce(F.col("service"), F.lit("generic")),
            "source": F.coalesce(F.col("source"), F.lit("raw")),
            "message": F.coalesce(F.col("entry.message"), F.lit("")),
        }
    )
    parsed = parse_mixed(route(rows, F.col("source"), registry), registry.parsers, "parser_key", text="message")
    reason = F.when(~text.not_blank(F.col("message")), "Empty or Null input").otherwise(
        F.concat(F.lit("Parsing Error: "), F.col("parse_error"))
    )
    failed = F.col("reason").isNotNull()
    no_text = F.lit(None).cast("string")
    return parsed.withColumns({"reason": reason}).select(
        ids.event_id(id_mode, F.col(batch_id), F.col("pos")).alias("log_id"),
        F.when(~failed, F.col("tenant_id")).otherwise(no_text).alias("tenant_id"),
        F.when(~failed, F.col("service")).otherwise(no_text).alias("service"),
        F.when(~failed, F.col("source")).otherwise(no_text).alias("source"),
        F.when(failed, ingest).otherwise(_entry_time(ingest)).alias("timestamp"),
        F.when(failed, "ERROR").otherwise(F.coalesce(F.col("entry.level"), F.lit("INFO"))).alias("level"),
        "message",
        F.when(
            failed, maps.text_map({"error": F.col("reason"), "raw_captured": F.lit("true")})
        ).otherwise(F.col("attributes")).alias("attributes"),
        F.when(~failed, F.coalesce(F.col("entry.metadata"), F.expr("map()").cast("map<string,string>"))).alias("metadata"),
    )


def merge_container_metadata(df: DataFrame, message: str = "message") -> DataFrame:
    """Parse the message as a container line and update ``metadata`` (parsed wins)."""
    parsed = parse_mixed(
        df.withColumns({"family": F.lit("containers")}),
        {"containers": V2.parsers["containers"]},
        text=message,
        into="parsed",
    )
    merged = F.when(
        F.col("parse_error").isNull(), maps.merge(F.col("metadata"), F.col("parsed"))
    ).otherwise(F.col("metadata"))
    return parsed.withColumns({"metadata": merged}).drop("parsed", "family")
