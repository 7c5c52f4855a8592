"""Streaming rate limiter: the batch limiter per micro-batch, with the totals of earlier micro-batches carried over.

Each micro-batch is judged by ``admission.rate_limit``, so a hot second is split
like in a batch job and all columns of the requests stay.  What a tenant-second
has used is kept as a small table, one partition per micro-batch; running a
micro-batch again overwrites its own partition and sees only earlier ones.

Totals are read for the seconds of the micro-batch only.  They are never
forgotten by themselves: ``compact`` folds the partitions into one and may drop
seconds that no request can belong to any more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe import fixed
from loglathe.operators import admission
from loglathe.sinks import outputs

TOTALS = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("second", T.TimestampType()),
        T.StructField("logs", T.LongType()),
        T.StructField("batches", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
FOLDED = -1  # the partition of compacted totals


def totals(spark: SparkSession, path: str) -> DataFrame:
    """The table of totals; an empty one is laid down first."""
    empty = spark.createDataFrame([], TOTALS)
    empty.write.mode("ignore").partitionBy("batch_id").parquet(path)
    return spark.read.schema(TOTALS).parquet(path)


def limit_batches(
    totals_path: str, table_path: str, limit: int = fixed.RATE_LIMIT_PER_SECOND
) -> Callable[[DataFrame, int], None]:
    """Sink for ``jobs.run``: requests with ``allowed`` go to the table, what they used to the totals."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the counts are stored first: the span of seconds is read from them, not from the requests once more
        held = totals(spark, totals_path)
        outputs.write_index(admission.window_counts(batch), totals_path, batch_id=batch_id)
        held = spark.read.schema(held.schema).parquet(totals_path)
        own = held.where(F.col("batch_id") == batch_id)
        span = own.agg(F.min("second").alias("low"), F.max("second").alias("high")).first()
        earlier = held.where(F.col("batch_id") < batch_id)
        if span.low is not None:
            earlier = earlier.where(F.col("second").between(F.lit(span.low), F.lit(span.high)))
        carried = earlier.groupBy("tenant_id", "second").agg(F.sum("logs").alias("logs"))
        judged = admission.rate_limit(batch, limit, carried=carried)
        outputs.write_index(judged, table_path, batch_id=batch_id)

    return write


def compact(spark: SparkSession, path: str, into: str, keep_from=None) -> None:
    """Write the totals as one partition into a new folder; seconds before ``keep_from`` are dropped.

    Run it between two runs of the job and go on with the new folder.
    """
    rows = totals(spark, path)
    if keep_from is not None:
        rows = rows.where(F.col("second") >= F.lit(keep_from).cast("timestamp"))
    folded = rows.groupBy("tenant_id", "second").agg(F.sum("logs").alias("logs"), F.sum("batches").alias("batches"))
    outputs.write_index(folded, into, batch_id=FOLDED)
