"""Intake of request batches: decoding, validation and enveloping.

All of it is map-side.  A request is judged as a whole by looking into its own
``logs`` array before the explode, so no shuffle brings its logs together again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions import ids, json

Now = dt.datetime | str | Column | None


def decode_requests(df: DataFrame, value: str = "value") -> DataFrame:
    """Request columns from JSON text.

    A log entry that cannot be enveloped carries its ``problem``: an explicit
    null or a value of the wrong type counts as one, an absent key takes its
    default.
    """
    keys = ["tenant_id", "service", "source", "logs"]
    parsed = df.withColumns({"__json": json.read_object(F.col(value), keys)})
    parsed = parsed.withColumns({"__doc": json.whole_object(F.col("__json"))})
    doc = F.col("__doc")

    def entry(log: Column) -> Column:
        message, source = json.child(log, "$.message"), json.child(log, "$.source")
        metadata = json.child(log, "$.metadata")
        problem = (
            F.when(message.isNotNull() & ~json.is_text(message), "message is not text")
            .when(source.isNotNull() & ~json.is_text(source), "source is not text")
            .when(metadata.isNotNull() & ~json.is_object(metadata), "metadata is not an object")
        )
        return F.struct(
            json.text_of(message).alias("message"),
            json.text_of(source).alias("source"),
            F.try_variant_get(log, "$.timestamp", "bigint").alias("timestamp"),
            json.text_of(json.child(log, "$.level")).alias("level"),
            F.try_variant_get(log, "$.metadata", "map<string,string>").alias("metadata"),
            problem.alias("problem"),
        )

    def text_key(name: str) -> Column:
        return F.when(json.is_text(doc[name]), doc[name].cast("string"))

    entries = F.try_variant_get(doc["logs"], "$", "array<variant>")
    all_objects = F.forall(entries, lambda log: json.is_object(log))
    return parsed.withColumns(
        {
            "tenant_id": text_key("tenant_id"),
            "service": text_key("service"),
            "source": text_key("source"),
            "logs": F.when(all_objects, F.transform(entries, entry)),
        }
    ).drop("__json", "__doc")


def reject_reason(strict: bool = False) -> Column:
    """Why a request is not valid, NULL when it is.

    The live contract wants tenant, service and a list of logs, which may be
    empty.  The strict one also wants non-empty names, at least one log, and a
    message and an epoch second in each.
    """
    reason = (
        F.when(F.col("tenant_id").isNull(), "tenant_id missing")
        .when(F.col("service").isNull(), "service missing")
        .when(F.col("logs").isNull(), "logs missing")
    )
    if strict:
        reason = (
            reason.when(F.col("tenant_id") == "", "tenant_id empty")
            .when(F.col("service") == "", "service empty")
            .when(F.size("logs") == 0, "logs empty")
            .when(F.exists("logs", lambda e: e["message"].isNull()), "message missing")
            .when(F.exists("logs", lambda e: e["timestamp"].isNull()), "timestamp missing")
        )
    return reason


def split_valid(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid requests, refused requests with ``reject_reason``)."""
    judged = df.withColumns({"reject_reason": reject_reason(strict)})
    good = judged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, judged.where(F.col("reject_reason").isNotNull())


def has_problem(df: DataFrame, null_is_problem: bool = False) -> Column:
    """True when any log of the request cannot be enveloped (all-or-nothing).

    Typed input cannot tell an absent key from a null one; ``null_is_problem``
    says how to read a null message, source or metadata.
    """
    entry = df.schema["logs"].dataType.elementType
    checks = []
    if "problem" in entry.names:
        checks.append(F.exists("logs", lambda e: e["problem"].isNotNull()))
    if null_is_problem:
        checks.append(
            F.exists(
                "logs",
                lambda e: e["message"].isNull() | e["source"].isNull() | e["metadata"].isNull(),
            )
        )
    result = F.lit(False)
    for check in checks:
        result = result | F.coalesce(check, F.lit(False))
    return result


def envelope(
    df: DataFrame,
    now: Now = None,
    id_mode: str = "stable",
    null_is_problem: bool = False,
) -> DataFrame:
    """One envelope per log of the valid requests; a bad log drops its whole request.

    The client's own time is kept as ``event_ts`` beside the ingest ``timestamp``; a
    number that is no time in seconds gives a NULL ``event_ts`` and a problem, and
    is kept as given in ``client_time``.  Stable ids need a ``request_id``, since
    nothing else tells two requests of a tenant and service apart.
    """
    if id_mode == "stable" and "request_id" not in df.columns:
        raise ValueError("stable ids need a request_id column")
    ingest = ids.now_or(now)
    request_id = F.col("request_id") if "request_id" in df.columns else F.lit(None).cast("string")
    request_source = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    ingestion = (
        ids.stable_id(F.col("tenant_id"), F.col("service"), request_id)
        if id_mode == "stable"
        else F.uuid()
    )
    client_ip = F.col("client_ip") if "client_ip" in df.columns else F.lit(None).cast("string")
    accepted = df.where(F.col("logs").isNotNull() & ~has_problem(df, null_is_problem))
    rows = accepted.select(
        ingestion.alias("ingestion_id"),
        F.col("tenant_id").cast("string").alias("tenant_id"),
        F.col("service").alias("service_name"),
        client_ip.alias("origin_ip"),
        request_source.alias("__default_source"),
        F.posexplode("logs").alias("pos", "log"),
    )
    return rows.select(
        ids.event_id(id_mode, F.col("ingestion_id"), F.col("pos")).alias("event_id"),
        "ingestion_id",
        "tenant_id",
        "service_name",
        F.lower(
            F.coalesce(F.col("log.source"), F.col("__default_source"), F.lit("generic"))
        ).alias("source"),
        "origin_ip",
        ingest.alias("timestamp"),
        ids.client_time(F.col("log.timestamp")).alias("event_ts"),
        F.col("log.timestamp").alias("client_time"),
        ids.client_time_problem(F.col("log.timestamp")).alias("client_time_problem"),
        F.coalesce(F.col("log.message"), F.lit("")).alias("raw_payload"),
        F.coalesce(F.col("log.metadata"), F.expr("map()").cast("map<string,string>")).alias(
            "metadata"
        ),
    )


def envelope_single(
    df: DataFrame, now: Now = None, id_mode: str = "stable", tenant_id: str = "0"
) -> DataFrame:
    """Envelope of single log entries: columns of one log plus ``service``."""
    log = F.struct("message", "source", "timestamp", "level", "metadata")
    tenant = F.col("tenant_id") if "tenant_id" in df.columns else F.lit(None).cast("string")
    requests = df.withColumns(
        {
            "tenant_id": F.coalesce(tenant, F.lit(tenant_id)),
            "service": F.coalesce(F.col("service"), F.lit("default")),
            "logs": F.array(log),
        }
    ).drop("source")
    return envelope(requests, now, id_mode)
