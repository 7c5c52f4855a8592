"""Word index of the log table, so that a search opens only the files that can match.

Every file of the table has a row for each word in its messages (the 64-bit hash of the word, by day, in order of hash, so
that the statistics of the index files cut a lookup down to a few row groups). Files are indexed once; a search also reads
files that the index does not know yet, and leaves out indexed files that are gone, so the index may lag behind or run ahead
of the table. What the driver holds is a list of files, as for any listing of a table.

A word is a run of ASCII letters and digits, in lower case.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.operators import analytics

_FILES = "file string"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # folder of rows without a day


def tokens(text: Column) -> Column:
    """Words of a text, each once; NULL has none."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z]+")
    return F.array_distinct(F.filter(found, lambda w: w != ""))


def _known(spark: SparkSession, index: str) -> DataFrame:
    try:
        return spark.read.schema(_FILES).parquet(f"{index}/files")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _FILES)


def _listed(spark: SparkSession, table: str) -> dict[str, str]:
    """Place of every file of the table by its day and name: one task gives its files of all days the same name."""
    places = [unquote(p) for p in spark.read.parquet(table).inputFiles()]
    return {_name(p): p for p in places}


def _day(place: str) -> str:
    return place.rpartition("event_date=")[2].partition("/")[0]


def _name(place: str) -> str:
    return f"{_day(place)}/{place.rpartition('/')[2]}"


def refresh(spark: SparkSession, table: str, index: str) -> int:
    """Index the files that are new since the last time; their number.

    Words are written before the files are called known: after a failure in between they are indexed again, which
    adds rows that say the same.
    """
    known = {r.file for r in _known(spark, index).select("file").collect()}
    new = [place for name, place in _listed(spark, table).items() if name not in known]
    if not new:
        return 0
    rows = spark.read.option("basePath", table).parquet(*new).select(
        "event_date", F.concat_ws("/", F.coalesce(F.col("event_date").cast("string"), F.lit(_NO_DAY)), "_metadata.file_name").alias("file"), "message"
    )
    words = rows.select("event_date", "file", F.explode(tokens(F.col("message"))).alias("word"))
    words = words.select("event_date", F.xxhash64("word").alias("token"), "file").distinct()
    by = ["event_date", "token", "file"]
    words = words.repartitionByRange(*by).sortWithinPartitions(*by)
    words.write.mode("append").partitionBy("event_date").parquet(f"{index}/tokens")
    spark.createDataFrame([(_name(p),) for p in new], _FILES).coalesce(1).write.mode("append").parquet(f"{index}/files")
    return len(new)


def matching_files(
    spark: SparkSession, table: str, index: str, words: Sequence[str], start: str | None = None, end: str | None = None
) -> list[str]:
    """Places of the files that may hold a message with all the words, in the days from `start` to `end`."""
    asked = sorted({w.lower() for w in words})
    if any(not w or not w.isascii() or not w.isalnum() for w in asked):
        raise ValueError(f"words of ASCII letters and digits: {words!r}")
    days = [d and str(d)[:10] for d in (start, end)]
    places = {
        name: p
        for name, p in _listed(spark, table).items()
        if (not days[0] or _day(p) >= days[0]) and (not days[1] or _day(p) <= days[1])
    }
    known = {r.file for r in _known(spark, index).select("file").collect()}
    found = set(places) - known
    if asked and known:
        rows = spark.read.parquet(f"{index}/tokens")
        for day, keep in zip(days, (F.col("event_date").__ge__, F.col("event_date").__le__)):
            rows = rows.where(keep(F.lit(day).cast("date"))) if day else rows
        hashes = [r[0] for r in spark.createDataFrame([(w,) for w in asked], "w string").select(F.xxhash64("w")).collect()]
        hits = rows.where(F.col("token").isin(hashes)).groupBy("file").agg(F.count_distinct("token").alias("n"))
        found |= {r.file for r in hits.where(F.col("n") == len(set(hashes))).select("file").collect()} & set(places)
    elif not asked:
        found = set(places)
    return sorted(places[name] for name in found)


def search(
    spark: SparkSession,
    table: str,
    index: str,
    words: Sequence[str],
    start: str | None = None,
    end: str | None = None,
    newest: int = 100,
    **filters: str,
) -> DataFrame:
    """Newest logs whose message has all the words; `filters` as of `analytics.search`."""
    files = matching_files(spark, table, index, words, start, end)
    rows = spark.read.option("basePath", table).parquet(*files) if files else spark.read.parquet(table).limit(0)
    held = tokens(F.col("message"))
    rows = rows.where(reduce(lambda a, b: a & b, [F.array_contains(held, w.lower()) for w in words], F.lit(True)))
    return analytics.search(rows, start=start, end=end, newest=newest, **filters)
