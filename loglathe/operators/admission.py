"""Admission of request batches: rate limit per tenant-second and backpressure.

The limiter adds up the log counts of a tenant within one epoch second,
refused batches included, and lets a batch in while the total is within the
limit.  The order inside a second is (arrival, request id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglathe import fixed
from loglathe.session import checkpointed

SALTS = 64


def second_of(arrival: Column) -> Column:
    return F.date_trunc("second", arrival)


def window_counts(
    df: DataFrame, tenant: str = "tenant_id", arrival: str = "arrival", count: str = "n_logs"
) -> DataFrame:
    """Logs and batches per tenant and second; partial sums run before the shuffle."""
    return df.groupBy(F.col(tenant), second_of(F.col(arrival)).alias("second")).agg(
        F.sum(count).alias("logs"), F.count(F.lit(1)).alias("batches")
    )


def _same(left: str, right: str, names: tuple[str, ...] = ("__tenant", "__second")) -> Column:
    """Join condition under which a NULL tenant is a tenant like any other."""
    same = F.lit(True)
    for name in names:
        same = same & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return same


def _cutoffs(keyed: DataFrame, limit: int, carried: DataFrame | None = None) -> DataFrame:
    """For each tenant-second over the limit: the key of its first refused batch, NULL when all are refused.

    Only those groups are ordered at all.  The running total is taken inside
    salts first, which splits a group that holds a large part of all rows: what
    comes after a salt's own total has passed the limit cannot be the first
    refused batch.  What is left per group is at most ``SALTS * (limit + 1)``
    narrow rows, and far fewer when batches hold many logs.
    """
    group = ["__tenant", "__second"]
    sums = keyed.groupBy(*group).agg(F.sum("__n").alias("__added"))
    if carried is None:
        sums = sums.withColumns({"__start": F.lit(0).cast("bigint")})
    else:
        before = carried.select(
            F.col("tenant_id").alias("__tenant"), F.col("second").alias("__second"), F.col("logs").alias("__logs")
        )
        sums = sums.alias("s").join(before.alias("c"), _same("s", "c"), "left").select(
            "s.*", F.coalesce("c.__logs", F.lit(0)).alias("__start")
        )
    over = sums.where(F.col("__start") + F.col("__added") > limit).select(*group, "__start")
    counted = keyed.where(F.col("__n") > 0).alias("k").join(over.alias("o"), _same("k", "o")).select("k.*", "o.__start")
    salted = counted.withColumns({"__salt": F.pmod(F.xxhash64("__id"), F.lit(SALTS))})
    in_salt = Window.partitionBy(*group, "__salt").orderBy("__arrival", "__id")
    earlier = F.sum("__n").over(in_salt.rowsBetween(Window.unboundedPreceding, -1))
    first_rows = salted.withColumns({"__earlier": F.coalesce(earlier, F.lit(0))}).where(
        F.col("__start") + F.col("__earlier") <= limit
    )
    in_group = (
        Window.partitionBy(*group)
        .orderBy("__arrival", "__id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = first_rows.withColumns({"__running": F.col("__start") + F.sum("__n").over(in_group)})
    first = (
        totals.where(F.col("__running") > limit)
        .groupBy(*group)
        .agg(F.min(F.struct("__arrival", "__id")).alias("__first_refused"))
    )
    found = over.alias("o").join(first.alias("f"), _same("o", "f"), "left")
    # over before its first batch: nothing is let in, whatever its order
    refused = F.when(F.col("o.__start") <= limit, F.col("f.__first_refused"))
    return found.select("o.__tenant", "o.__second", refused.alias("__first_refused"), F.lit(True).alias("__over"))


def rate_limit(
    df: DataFrame,
    limit: int = fixed.RATE_LIMIT_PER_SECOND,
    tenant: str = "tenant_id",
    arrival: str = "arrival",
    request_id: str = "request_id",
    count: str | Column = "n_logs",
    carried: DataFrame | None = None,
) -> DataFrame:
    """Add ``allowed``.

    The rows themselves are only joined with the small table of tenant-seconds
    that went over the limit; adaptive execution broadcasts it when it fits and
    splits a skewed tenant-second otherwise.  ``carried`` (tenant_id, second,
    logs) holds what earlier rows of a tenant-second have used already.
    """
    amount = F.col(count) if isinstance(count, str) else count
    named = df.withColumns({"__tenant": F.col(tenant), "__second": second_of(F.col(arrival))})
    keyed = named.select(
        "__tenant",
        "__second",
        F.col(arrival).alias("__arrival"),
        F.col(request_id).alias("__id"),
        amount.alias("__n"),
    )
    joined = named.alias("r").join(_cutoffs(keyed, limit, carried).alias("c"), _same("r", "c"), "left")
    key = F.struct(F.col(f"r.{arrival}").alias("__arrival"), F.col(f"r.{request_id}").alias("__id"))
    allowed = F.col("c.__over").isNull() | F.coalesce(key < F.col("c.__first_refused"), F.lit(False))
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], allowed.alias("allowed"))


def running_totals(
    df: DataFrame,
    limit: int = fixed.RATE_LIMIT_PER_SECOND,
    tenant: str = "tenant_id",
    arrival: str = "arrival",
    request_id: str = "request_id",
    count: str = "n_logs",
) -> DataFrame:
    """Narrow rows with ``running_total`` (the total a batch sees on arrival) and ``allowed``.

    Only tenant, arrival, request id and count are moved; join by request id
    for the rest.  Rows are range partitioned by (tenant, second, arrival, id),
    so even one tenant-second with most of the rows spreads over many tasks.
    Each part is summed on its own and then lifted by the parts of its group
    before it.  The part numbers are written to the checkpoint first: both
    branches must see the same ones.  A part has at most two groups that reach
    beyond it, so the table of lifts has at most two rows per partition.
    """
    keys = ("__tenant", "__second")
    named = df.select(tenant, arrival, request_id, count).withColumns(
        {"__tenant": F.col(tenant), "__second": second_of(F.col(arrival))}
    )
    ranged = named.repartitionByRange(*[F.col(k) for k in keys], F.col(arrival), F.col(request_id))
    parts = checkpointed(ranged.withColumns({"__part": F.spark_partition_id()}))
    in_part = (
        Window.partitionBy("__part", *keys)
        .orderBy(arrival, request_id)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = parts.withColumns({"__local": F.sum(count).over(in_part)})
    sums = parts.groupBy("__part", *keys).agg(F.sum(count).alias("__sum"))
    in_group = Window.partitionBy(*keys)
    before = in_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    lifts = (
        sums.withColumns(
            {"__parts": F.count(F.lit(1)).over(in_group), "__before": F.sum("__sum").over(before)}
        )
        .where(F.col("__parts") > 1)
        .select("__part", *keys, "__before")
    )
    lifted = local.alias("r").join(lifts.alias("l"), _same("r", "l", ("__part", *keys)), "left")
    total = F.col("r.__local") + F.coalesce(F.col("l.__before"), F.lit(0))
    return lifted.select(*[F.col(f"r.{c}") for c in (tenant, arrival, request_id, count)], total.alias("running_total")).withColumns(
        {"allowed": F.col("running_total") <= limit}
    )


def admission_status(
    df: DataFrame,
    valid: Column,
    envelopable: Column,
    depth: Column,
    limit: int = fixed.RATE_LIMIT_PER_SECOND,
    max_depth: int = fixed.MAX_BUFFER_DEPTH,
    tenant: str = "tenant_id",
    arrival: str = "arrival",
    request_id: str = "request_id",
    count: str = "n_logs",
) -> DataFrame:
    """Add ``status`` (422, 429, 503, 500 or 202) and, for 202, the ``buffer_depth`` after the request.

    Order of the checks: validity, rate limit, backpressure, enveloping.
    ``depth`` is the measured depth of the buffer that the request met, given
    with the row or joined from samples (``with_depth``); unknown counts as 0.
    """
    known = F.coalesce(depth, F.lit(0))
    judged = df.withColumns({"__valid": valid, "__fits": envelopable, "__depth": known})
    counted = F.when(F.col("__valid"), F.col(count)).otherwise(F.lit(0))
    limited = rate_limit(judged, limit, tenant, arrival, request_id, counted)
    status = (
        F.when(~F.col("__valid"), 422)
        .when(~F.col("allowed"), 429)
        .when(F.col("__depth") > max_depth, 503)
        .when(~F.col("__fits"), 500)
        .otherwise(202)
    )
    after = F.when(F.col("status") == 202, F.col("__depth") + F.col(count))
    return limited.withColumns({"status": status}).withColumns({"buffer_depth": after}).drop(
        "__valid", "__fits", "__depth", "allowed"
    )


def with_depth(df: DataFrame, samples: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Add ``depth`` from samples (``second``, ``depth``), one per second; seconds without one get NULL."""
    at = samples.select(F.col("second").alias("__second"), F.col("depth"))
    return df.join(at, second_of(F.col(arrival)) == F.col("__second"), "left").drop("__second")
