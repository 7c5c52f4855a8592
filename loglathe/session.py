"""Session helper and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # of duplicate keys in a stored JSON payload the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    # parser projections above the JIT limit run as split methods instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# fixed at session start: no call-site capture for every column a job builds
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the jobs are designed for."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# results depend on these: a job that finds them otherwise must not go on
NEEDED = ("spark.sql.session.timeZone", "spark.sql.variant.allowDuplicateKeys")


def require(spark: SparkSession) -> None:
    """Raise if a setting that decides results is not as the jobs need it."""
    for key in NEEDED:
        if spark.conf.get(key, None) != SETTINGS[key]:
            raise ValueError(f"{key} must be {SETTINGS[key]}: call session.configure(spark) first")


def build(name: str = "loglathe", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STATIC_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a folder of its own machine.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    local = _LOCAL_FOLDER.get(spark.sparkContext.applicationId)
    if local is None:
        local = tempfile.mkdtemp(prefix="loglathe-")
        _LOCAL_FOLDER[spark.sparkContext.applicationId] = local
    return local


_LOCAL_FOLDER: dict[str, str] = {}


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run of a job."""
    return f"{shared_folder(spark)}/loglathe/{name}-{uuid.uuid4().hex}"


TASK_ROWS = 100_000  # rows that one task should parse


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out evenly: about `TASK_ROWS` to a task, and at least one task per core.

    Parsing is bound by CPU. A row group is read by one task, however many splits its file has, so the rows of each split
    are counted (from the footers, without a column). Splits that are even enough pass unchanged, without a shuffle.
    """
    counted = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    rows, largest = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(tasks) if largest * tasks > 2 * rows else df


ARROW_BYTES = 8 << 20  # of rows that go to a Python worker at once; no piece of text of an operator is larger


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound what goes to a Python worker at once by its size.

    Spark's own bound is 10,000 rows or 64 MB, which a task holds several times: as rows, as buffers outside the heap that
    double while they grow, and as objects of the worker, whose memory stays with it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not (now.isdigit() and 0 < int(now) <= ARROW_BYTES):
        spark.conf.set(key, str(ARROW_BYTES))
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/loglathe/checkpoints")
    return df.checkpoint()
