"""Identifiers and time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """Identifier that a retry or a replay computes again unchanged.

    Each part is written with its length in front, NULL without one, so that
    no two different lists of parts read the same.
    """
    texts = [p.cast("string") for p in parts]
    written = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat_ws("|", *written), 256)


def event_id(mode: str, *parts: Column) -> Column:
    """``stable`` (default everywhere) or ``random``, which changes on task retry."""
    if mode == "stable":
        return stable_id(*parts)
    if mode == "random":
        return F.uuid()
    raise ValueError(f"unknown id mode: {mode!r}")


def now_or(now: dt.datetime | str | Column | None) -> Column:
    """Ingest time: the given one, else the time of the query."""
    if now is None:
        return F.current_timestamp()
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def event_time(value: Column) -> Column:
    """Timestamp from epoch seconds or ISO text held as text; NULL if neither."""
    seconds = value.try_cast("double")
    return F.coalesce(
        F.when(seconds.isNotNull(), F.timestamp_micros((seconds * 1_000_000).try_cast("bigint"))),
        F.try_to_timestamp(value),
    )


LAST_SECOND = 253_402_300_799  # end of the year 9999


def client_time(seconds: Column) -> Column:
    """Timestamp of a client's epoch seconds; NULL beyond the year 9999, as for milli-, micro- and nanoseconds."""
    return F.timestamp_seconds(F.when(seconds.between(-LAST_SECOND, LAST_SECOND), seconds))


def client_time_problem(seconds: Column) -> Column:
    return F.when(seconds.isNotNull() & client_time(seconds).isNull(), F.lit("timestamp is not in seconds"))


def iso_utc(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
