"""Reports over stored and parsed logs.

Every aggregate runs partially before its shuffle, so a tenant or service that
holds most of the rows arrives as a few partial rows.  Top-k and search end in
a bounded sort (take ordered), not in a full one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglathe import fixed
from loglathe.session import checkpointed

_ERROR_FLAGS = ["is_error", "is_system_error", "is_failure"]


def is_error_row(attributes: Column) -> Column:
    """A parsed row that reports a failure, by the flags of its family."""
    flags = [F.coalesce(attributes[f] == "true", F.lit(False)) for f in _ERROR_FLAGS]
    result = F.coalesce(attributes["status"] == "CRITICAL", F.lit(False))
    for flag in flags:
        result = result | flag
    return result


def search(
    df: DataFrame,
    tenant_id: str | None = None,
    start: str | None = None,
    end: str | None = None,
    level: str | None = None,
    contains: str | None = None,
    newest: int = 100,
) -> DataFrame:
    """Newest matching logs.  The day partition is filtered along with the time."""
    found = df
    if tenant_id is not None:
        found = found.where(F.col("tenant_id") == tenant_id)
    if start is not None:
        at = F.lit(start).cast("timestamp")
        found = found.where((F.col("timestamp") >= at) & (F.col("event_date") >= F.to_date(at)))
    if end is not None:
        at = F.lit(end).cast("timestamp")
        found = found.where((F.col("timestamp") < at) & (F.col("event_date") <= F.to_date(at)))
    if level is not None:
        found = found.where(F.col("level") == level)
    if contains is not None:
        found = found.where(F.col("message").contains(contains))
    return found.orderBy(F.desc("timestamp"), "tenant_id", "service", "message").limit(newest)


def ingestion_rate(
    df: DataFrame,
    by: Sequence[str] = ("tenant_id", "service"),
    every: str = "1 minute",
    time: str = "timestamp",
) -> DataFrame:
    """Logs per time window and group."""
    return (
        df.groupBy(F.window(time, every).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("logs"))
        .select(F.col("w.start").alias("window_start"), *by, "logs")
    )


def error_frequency(
    df: DataFrame,
    is_error: Column,
    by: Sequence[str] = ("family",),
    every: str = "1 hour",
    time: str = "timestamp",
) -> DataFrame:
    """Errors, rows and error rate per time window and group."""
    flag = F.when(is_error, 1).otherwise(0)
    return (
        df.groupBy(F.window(time, every).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("logs"), F.sum(flag).alias("errors"))
        .select(
            F.col("w.start").alias("window_start"),
            *by,
            "logs",
            "errors",
            (F.col("errors") / F.col("logs")).alias("error_rate"),
        )
    )


def top_k_errors(df: DataFrame, is_error: Column, by: Sequence[str], k: int = 10) -> DataFrame:
    """The k groups with the most errors; ties go by the group's own order.

    Errors are counted, not filtered first: a filter on parsed columns is pushed below the projections that make them, and
    every match in it runs again for each column that reads it.
    """
    return (
        df.groupBy(*by)
        .agg(F.count(F.when(is_error, 1)).alias("errors"))
        .where(F.col("errors") > 0)
        .orderBy(F.desc("errors"), *by)
        .limit(k)
    )


def level_rollup(
    df: DataFrame, by: Sequence[str] = ("tenant_id", "service", "level")
) -> DataFrame:
    """Counts at every level of the hierarchy; ``depth`` tells totals from NULL groups."""
    return df.rollup(*by).agg(
        F.count(F.lit(1)).alias("logs"), F.grouping_id().cast("bigint").alias("depth")
    )


def duration_summary(df: DataFrame, duration: Column, by: Sequence[str]) -> DataFrame:
    """Count, mean, maximum, and exact median and 95th percentile (the least value that so many do not exceed).

    Equal durations are counted before anything is ordered, and what is left is range partitioned by group and duration:
    a group with very many durations spreads over tasks, each sums its own part, and a lift per part and group (at most
    two reach beyond a part) connects them. The parts are written to the checkpoint, as both branches must see the same.
    """
    counts = df.select(*by, duration.alias("__d")).where(F.col("__d").isNotNull())
    counts = counts.groupBy(*by, "__d").agg(F.count(F.lit(1)).alias("__n"))
    ranged = counts.repartitionByRange(*[F.col(c) for c in by], F.col("__d"))
    parts = checkpointed(ranged.withColumns({"__part": F.spark_partition_id()}))
    group = Window.partitionBy(*by)
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    lifts = (
        parts.groupBy("__part", *by)
        .agg(F.sum("__n").alias("__sum"))
        .withColumns({"__before": F.coalesce(F.sum("__sum").over(before), F.lit(0)), "__all": F.sum("__sum").over(group)})
    )
    local = parts.withColumns({"__upto": F.sum("__n").over(Window.partitionBy("__part", *by).orderBy("__d"))})
    same = F.lit(True)
    for c in ("__part", *by):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}"))
    rows = local.alias("r").join(lifts.alias("l"), same).select(
        *[F.col(f"r.{c}") for c in by], "__d", "__n", (F.col("__before") + F.col("__upto")).alias("__upto"), "__all"
    )

    def quantile(share: float) -> Column:
        return F.min(F.when(F.col("__upto") >= F.col("__all") * F.lit(share), F.col("__d")))

    return rows.groupBy(*by).agg(
        F.sum("__n").alias("n"),
        (F.sum(F.col("__d") * F.col("__n")) / F.sum("__n")).alias("mean"),
        F.max("__d").alias("longest"),
        quantile(0.5).alias("p50"),
        quantile(0.95).alias("p95"),
    )


def latency_histogram(
    df: DataFrame,
    seconds: Column,
    by: Sequence[str] = (),
    buckets: Sequence[float] = tuple(fixed.LATENCY_BUCKETS),
) -> DataFrame:
    """Cumulative bucket counts with their bound, one row per group and bucket."""
    measured = df.select(*by, seconds.alias("__s")).where(F.col("__s").isNotNull())
    sums = [F.sum(F.when(F.col("__s") <= b, 1).otherwise(0)).alias(f"__b{i}") for i, b in enumerate(buckets)]
    counted = measured.groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("__all"))
    bounds = [F.struct(F.lit(str(b)).alias("le"), F.col(f"__b{i}").alias("n")) for i, b in enumerate(buckets)]
    bounds.append(F.struct(F.lit("+Inf").alias("le"), F.col("__all").alias("n")))
    return counted.select(*by, F.explode(F.array(*bounds)).alias("b")).select(
        *by, F.col("b.le").alias("le"), F.col("b.n").alias("logs")
    )


def domain_report(df: DataFrame, source: str = "source", level: str = "level") -> DataFrame:
    """How many rows carry a source and a level of the declared domains."""
    known_source = F.coalesce(F.col(source).isin(fixed.LOG_SOURCES), F.lit(False))
    known_level = F.coalesce(F.col(level).isin(fixed.LOG_LEVELS), F.lit(False))
    return df.groupBy(
        known_source.alias("known_source"), known_level.alias("known_level")
    ).agg(F.count(F.lit(1)).alias("logs"))
