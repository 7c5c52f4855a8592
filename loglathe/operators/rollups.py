"""Roll-ups per minute that are stored once and merged to hours, days or any longer time.

A row counts the logs of a minute, a group and a bucket of durations. Buckets are the powers of two in 16 equal parts, so
a bucket's ends differ by 1/16 at most, and the bucket of a quantile is found exactly from the counts. All measures of a row
add up, so any rows of one group can be merged in any order.

A minute that gets late rows is counted again from its own raw rows and stored under a higher number; readers take the
highest of each minute. Nothing else is read or written again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 16
NOT_POSITIVE = -(1 << 20)  # bucket of durations of zero or less
_SUMS = ("logs", "errors", "measured", "total")


def _finite(value: Column) -> Column:
    return F.abs(value) < float("inf")  # NaN is above all numbers


def bucket(duration: Column) -> Column:
    """Number of the bucket; NULL for what is no finite number."""
    value = F.when(_finite(duration) & (duration > 0), duration)
    near = F.floor(F.log2(value)).cast("int")
    power = F.when(value < F.pow(F.lit(2.0), near), near - 1).when(value >= F.pow(F.lit(2.0), near + 1), near + 1).otherwise(near)
    part = F.floor((value / F.pow(F.lit(2.0), power) - 1) * PARTS)
    return F.when(_finite(duration) & (duration <= 0), NOT_POSITIVE).otherwise((power * PARTS + part).cast("int"))


def bucket_low(number: Column) -> Column:
    """Least duration of a bucket."""
    low = F.pow(F.lit(2.0), F.floor(number / PARTS)) * (1 + F.pmod(number, F.lit(PARTS)) / PARTS)
    return F.when(number != NOT_POSITIVE, low)


def bucket_high(number: Column) -> Column:
    """Durations of a bucket are less than this."""
    return F.when(number == NOT_POSITIVE, 0.0).otherwise(bucket_low(number + 1))


def per_minute(
    df: DataFrame, duration: Column, is_error: Column, by: Sequence[str] = ("tenant_id",), time: str = "timestamp"
) -> DataFrame:
    """Counts per minute, group and bucket. `total` is the sum of the durations, `longest` their maximum."""
    rows = df.select(
        F.date_trunc("minute", F.col(time)).alias("minute"), *by, duration.cast("double").alias("_d"), is_error.alias("_e")
    ).withColumns({"_d": F.when(_finite(F.col("_d")), F.col("_d"))})
    counted = rows.groupBy("minute", *by, bucket(F.col("_d")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("logs"),
        F.count_if("_e").alias("errors"),
        F.count("_d").alias("measured"),
        F.sum("_d").alias("total"),
        F.max("_d").alias("longest"),
    )
    return counted.withColumns({"event_date": F.to_date("minute")})


def newest(stored: DataFrame) -> DataFrame:
    """Of every minute the rows of its last count."""
    last = stored.groupBy(F.col("event_date").alias("_day"), F.col("minute").alias("_minute")).agg(F.max("batch_id").alias("_last"))
    same = (F.col("event_date").eqNullSafe(F.col("_day"))) & (F.col("minute").eqNullSafe(F.col("_minute")))
    return stored.join(last, same & (F.col("batch_id") == F.col("_last"))).drop("_day", "_minute", "_last", "batch_id")


def of_minutes(raw: DataFrame, late: DataFrame, time: str = "timestamp") -> DataFrame:
    """All raw rows of the minutes that have late rows; days without any are not read."""
    minutes = late.select(F.to_date(time).alias("_day"), F.date_trunc("minute", F.col(time)).alias("_minute")).distinct()
    same = (F.col("event_date") == F.col("_day")) & (F.date_trunc("minute", F.col(time)) == F.col("_minute"))
    return raw.join(minutes, same, "left_semi")


def merged(counts: DataFrame, every: str = "1 hour", by: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Counts per longer time, group and bucket."""
    sums = [F.sum(c).alias(c) for c in _SUMS]
    found = counts.groupBy(F.window("minute", every).alias("w"), *by, "bucket").agg(*sums, F.max("longest").alias("longest"))
    return found.select(F.col("w.start").alias("window_start"), *by, "bucket", *_SUMS, "longest")


def summary(counts: DataFrame, quantiles: Sequence[float] = (0.5, 0.95), by: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """One row per window and group: sums, mean, longest, and between which bounds each quantile lies.

    A group has as many rows here as it has buckets, which the range of doubles bounds.
    """
    keys = ["window_start", *by]
    upto = Window.partitionBy(*keys).orderBy(F.col("bucket").asc_nulls_first())
    rows = counts.withColumns(
        {"_upto": F.sum("measured").over(upto), "_all": F.sum("measured").over(Window.partitionBy(*keys))}
    )
    found = [
        F.min(F.when((F.col("measured") > 0) & (F.col("_upto") >= F.col("_all") * F.lit(q)), F.col("bucket"))).alias(f"_{i}")
        for i, q in enumerate(quantiles)
    ]
    sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS], F.max("longest").alias("longest"), *found)
    bounds = []
    for i, q in enumerate(quantiles):
        name = f"p{round(q * 100)}"
        bounds += [bucket_low(F.col(f"_{i}")).alias(f"{name}_from"), bucket_high(F.col(f"_{i}")).alias(f"{name}_below")]
    mean = F.when(F.col("measured") > 0, F.col("total") / F.col("measured"))
    return sums.select(*keys, "logs", "errors", "measured", mean.alias("mean"), "longest", *bounds)
