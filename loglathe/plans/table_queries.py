"""Registered queries over kept tables: word index, roll-ups, topic partitions, bounded streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe import fixed, session
from loglathe.operators import rollups, storage, textindex, versions
from loglathe.plans import corpus
from loglathe.plans.flow_queries import (
    _RAW_MESSAGE,
    _REQUEST_SERVICE,
    _REQUEST_TENANT,
    _SQL_ENVELOPES,
    envelopes,
    raw_messages,
    sql_time,
    text_time,
)
from loglathe.plans.parser_queries import NOW
from loglathe.sinks import outputs
from loglathe.sources import records
from loglathe.streaming import jobs

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str):
    def keep(run):
        QUERIES[name] = run
        ORACLES[name] = sql
        return run

    return keep


# --- search ---------------------------------------------------------------------------------

_WORDS = ("get", "purchase", "301")
_HAS_WORDS = " AND ".join(f"list_contains(regexp_split_to_array(lower(raw_payload), '[^0-9a-z]+'), '{w}')" for w in _WORDS)


@query(
    "log_search_indexed",
    f"SELECT {sql_time('ts')} AS timestamp, tenant_id, service_name AS service, raw_payload AS message FROM ({_SQL_ENVELOPES})"
    f" WHERE ts >= TIMESTAMP '2024-01-03 06:00:00' AND ts < TIMESTAMP '2024-01-28 12:00:00' AND {_HAS_WORDS}"
    " ORDER BY ts DESC, tenant_id, service_name, raw_payload LIMIT 200",
)
def log_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.run_folder(spark, "indexed")
    outputs.write_hot(storage.hot_rows(envelopes(spark, sf_dir), NOW), f"{path}/table")
    textindex.refresh(spark, f"{path}/table", f"{path}/index")
    found = textindex.search(
        spark,
        f"{path}/table",
        f"{path}/index",
        _WORDS,
        start="2024-01-03 06:00:00",
        end="2024-01-28 12:00:00",
        newest=200,
    )
    return found.select(text_time(F.col("timestamp")).alias("timestamp"), "tenant_id", "service", "message")


# --- roll-ups -------------------------------------------------------------------------------


def _low_sql(value: str) -> str:
    """Lower end of the sixteenth of a power of two that holds a value."""
    near = f"floor(log2({value}))"
    power = f"({near} + CASE WHEN {value} < pow(2.0, {near}) THEN -1 WHEN {value} >= pow(2.0, {near} + 1) THEN 1 ELSE 0 END)"
    return f"(pow(2.0, {power}) * (1 + floor(({value} / pow(2.0, {power}) - 1) * 16) / 16))"


def _next_sql(value: str) -> str:
    near = f"floor(log2({value}))"
    return f"({_low_sql(value)} + pow(2.0, {near} + CASE WHEN {value} < pow(2.0, {near}) THEN -1 WHEN {value} >= pow(2.0, {near} + 1) THEN 1 ELSE 0 END) / 16)"


_MEASURED = "CASE WHEN event_id % 7 > 0 THEN value END"


@query(
    "rollup_hours",
    f"WITH r AS (SELECT date_trunc('hour', ts) AS h, {corpus.TENANT} AS tenant_id, event_type, {_MEASURED} AS d FROM events),"
    " g AS (SELECT h, tenant_id, count(*) AS logs, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors,"
    " count(d) AS measured, avg(d) AS mean, max(d) AS longest, quantile_disc(d, 0.5) AS p50, quantile_disc(d, 0.95) AS p95"
    f" FROM r GROUP BY h, tenant_id) SELECT {sql_time('h')} AS window_start, tenant_id, logs, errors, measured,"
    f" round(mean, 4) AS mean, longest, {_low_sql('p50')} AS p50_from, {_next_sql('p50')} AS p50_below,"
    f" {_low_sql('p95')} AS p95_from, {_next_sql('p95')} AS p95_below FROM g",
)
def rollup_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes are counted from what is there, some days get late rows, and only their minutes are counted again."""
    path = session.run_folder(spark, "rollup")
    events = corpus.read(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.expr(corpus.TENANT).alias("tenant_id"),
        "event_type",
        F.expr(_MEASURED).alias("duration"),
        F.to_date("ts").alias("event_date"),
        ((F.col("event_id") % 3 == 0) & F.dayofmonth("ts").between(9, 12)).alias("late"),
    )

    def land(rows: DataFrame) -> None:
        rows.drop("late").write.mode("append").partitionBy("event_date").parquet(f"{path}/raw")

    def count(rows: DataFrame, number: int) -> None:
        counted = rollups.per_minute(rows, F.col("duration"), F.col("event_type") == "error")
        outputs.write_rollup(counted, f"{path}/minutes", number)

    land(events.where("not late"))
    count(spark.read.parquet(f"{path}/raw"), 0)
    late = events.where("late")
    land(late)
    count(rollups.of_minutes(spark.read.parquet(f"{path}/raw"), late), 1)
    hours = rollups.merged(rollups.newest(spark.read.parquet(f"{path}/minutes")), "1 hour")
    found = rollups.summary(hours)
    return found.withColumns({"window_start": text_time(F.col("window_start")), "mean": F.round("mean", 4)})


# --- topic partitions -----------------------------------------------------------------------

_PARTITIONS = 3
_KEY = f"coalesce({_REQUEST_TENANT}, 'unknown') || ':' || coalesce({_REQUEST_SERVICE}, 'unknown')"
_M = 1540483477  # of the producers' hash, as are the shifts and the seed
_CUT = "% 4294967296"


def _byte_sql(at: str) -> str:
    return f"ascii(substr(key, CAST({at} AS BIGINT), 1))"


def _mix_sql(k: str) -> str:
    once = f"(({k}) * {_M}) {_CUT}"
    return f"(xor({once}, ({once}) >> 24) * {_M}) {_CUT}"


_BLOCK = " + ".join(f"({_byte_sql(f'4 * i + {j + 1}')} << {8 * j})" for j in range(4))
_REST = " + ".join(f"(CASE WHEN length(key) % 4 > {j} THEN {_byte_sql(f'length(key) // 4 * 4 + {j + 1}')} ELSE 0 END << {8 * j})" for j in range(3))
_SQL_HASHES = (
    f"k AS (SELECT event_id, event_type, {_KEY} AS key FROM events), keys AS (SELECT DISTINCT key FROM k),"
    f" b AS (SELECT key, list_transform(range(0, length(key) // 4), lambda i: CAST({_BLOCK} AS BIGINT)) AS blocks,"
    f" CAST({_REST} AS BIGINT) AS rest FROM keys),"
    f" m AS (SELECT key, rest, list_reduce(list_prepend(CAST(xor(2538058380, length(key)) AS BIGINT), list_transform(blocks,"
    f" lambda k: CAST({_mix_sql('k')} AS BIGINT))), lambda h, k: xor((h * {_M}) {_CUT}, k)) AS h FROM b),"
    f" t AS (SELECT key, CASE WHEN length(key) % 4 > 0 THEN (xor(h, rest) * {_M}) {_CUT} ELSE h END AS h FROM m),"
    f" f AS (SELECT key, (xor(h, h >> 13) * {_M}) {_CUT} AS h FROM t),"
    f" p AS (SELECT key, CAST((xor(h, h >> 15) & 2147483647) % {_PARTITIONS} AS INTEGER) AS partition FROM f)"
)


@query(
    "topic_partitions",
    f"WITH {_SQL_HASHES} SELECT key, event_id, event_type AS payload, partition, row_number() OVER (PARTITION BY partition"
    " ORDER BY event_id) - 1 AS place FROM k JOIN p USING (key)",
)
def topic_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in the partitions that producers choose by key, each in order of event_id: `place` is the row in the file."""
    path = session.run_folder(spark, "partitions")
    rows = corpus.read(spark, sf_dir, "events").select(
        "event_id",
        F.expr(_REQUEST_TENANT).alias("tenant_id"),
        F.expr(_REQUEST_SERVICE).alias("service_name"),
        F.col("event_type").alias("raw_payload"),
    )
    outputs.write_messages(outputs.ordered_messages(rows, _PARTITIONS, ["event_id"]), path)
    value = F.from_json(F.col("value").cast("string"), "event_id bigint, raw_payload string")
    stored = spark.read.parquet(path).select(
        F.col("key").cast("string").alias("key"), value.alias("v"), "partition", F.col("_metadata.row_index").alias("place")
    )
    return stored.select("key", "v.event_id", F.col("v.raw_payload").alias("payload"), "partition", "place")


# --- schema versions --------------------------------------------------------------------------

_NUMBER = "event_id % 5"  # 0 and 4 are no version, 3 names none
_VERSIONED = f"CASE WHEN {_NUMBER} = 3 THEN line ELSE replace(line, '{{\"tenant_id\"', '{{\"schema_version\":' || CAST({_NUMBER} AS STRING) || ',\"tenant_id\"') END"
_VERSION_SQL = "CASE WHEN json_type(d, '$.schema_version') IS NULL THEN 3 ELSE CAST(json_extract(d, '$.schema_version') AS BIGINT) END"


def _versions() -> versions.Versions:
    """Three versions; a fourth that would refuse messages of the third is not taken."""
    text, optional = T.StringType(), T.MapType(T.StringType(), T.StringType())
    first = T.StructType([T.StructField("tenant_id", text, False), T.StructField("message", text, False)])
    second = T.StructType([*first.fields, T.StructField("metadata", optional, True)])
    third = T.StructType([T.StructField("tenant_id", text, True), T.StructField("message", text, True), T.StructField("extra", T.LongType(), True)])
    found = versions.Versions().declare("logs", first).declare("logs", second).declare("logs", third)
    try:
        return found.declare("logs", T.StructType([T.StructField("tenant_id", text, False)]))
    except versions.Incompatible:
        return found


def _texts_sql(required: bool) -> str:
    return " ".join(
        f"WHEN coalesce(json_type(d, '$.{c}') {"<> 'VARCHAR', true)" if required else "NOT IN ('VARCHAR', 'NULL'), false)"} THEN '{c}: expected string'"
        for c in ("tenant_id", "message")
    )


@query(
    "schema_versions",
    f"WITH m AS (SELECT event_id, {_VERSIONED} AS line FROM (SELECT event_id, {_RAW_MESSAGE} AS line FROM events)),"
    " raw AS (SELECT event_id, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS d FROM (SELECT event_id, TRY_CAST(line AS JSON) AS j FROM m)),"
    f" v AS (SELECT *, CASE WHEN d IS NOT NULL THEN {_VERSION_SQL} END AS version FROM raw),"
    " e AS (SELECT version, CASE WHEN d IS NULL THEN 'not a JSON object' WHEN version NOT IN (1, 2, 3) THEN 'schema version ' ||"
    f" CAST(version AS VARCHAR) || ' is not declared' WHEN version < 3 THEN CASE {_texts_sql(True)} WHEN version = 2 AND"
    " coalesce(json_type(d, '$.metadata') NOT IN ('OBJECT', 'NULL'), false) THEN 'metadata: expected map<string,string>' END"
    f" ELSE CASE {_texts_sql(False)} WHEN coalesce(json_type(d, '$.extra') NOT IN ('UBIGINT', 'BIGINT', 'NULL'), false)"
    " THEN 'extra: expected bigint' END END AS schema_error FROM v) SELECT version, schema_error, count(*) AS messages FROM e GROUP BY ALL",
)
def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages against the version that each names, or the latest one."""
    messages = raw_messages(spark, sf_dir).withColumnRenamed("value", "line").select(F.expr(_VERSIONED).alias("value"))
    judged = versions.validate(messages, _versions(), "logs")
    return judged.groupBy(F.col("schema_version").alias("version"), "schema_error").agg(F.count(F.lit(1)).alias("messages"))


# --- repeats days apart -----------------------------------------------------------------------


@query("stream_first_time_only", "SELECT event_id, event_type FROM events")
def stream_first_time_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is delivered one to three times, in runs of the job that know of each other only what is stored."""
    path = session.run_folder(spark, "first-time")
    events = corpus.read(spark, sf_dir, "events").select("event_id", "event_type")
    sink = jobs.first_time_only(jobs.table_sink(f"{path}/table"), f"{path}/seen")
    for copy in range(3):
        repeats = events.where(F.col("event_id") % 3 >= copy)
        late = repeats.unionByName(repeats.where(F.col("event_id") % 5 == 0))
        late.repartition(4).write.mode("append").parquet(f"{path}/in")
        flow = spark.readStream.schema(late.schema).parquet(f"{path}/in")
        jobs.run(flow, sink, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/table").select("event_id", "event_type")


# --- streams of bounded micro-batches -------------------------------------------------------

_SQL_DEPTH = (
    "WITH s AS (SELECT coalesce(sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END), 0) AS half, count(*) AS total FROM events),"
    " b AS (SELECT half, total, (half + {n} - 1) // {n} AS first FROM s),"
    " i AS (SELECT b.*, i FROM b, unnest(range(0, CAST(first + (total - half + {n} - 1) // {n} AS BIGINT))) t(i))"
    " SELECT CAST(i AS BIGINT) AS batch_id, CAST(CASE WHEN i < first THEN half - least(half, (i + 1) * {n})"
    " ELSE total - least(total, half + (i - first + 1) * {n}) END AS BIGINT) AS depth,"
    " CAST(CASE WHEN i < first THEN least(half, (i + 1) * {n}) ELSE least(total, half + (i - first + 1) * {n}) END AS BIGINT)"
    " AS consumed FROM i"
)


def _landed_twice(spark: SparkSession, sf_dir: str, path: str, sink: jobs.BatchSink, most: int) -> None:
    """Events land in two goes, and a job takes them after each in micro-batches of at most `most` records."""
    events = corpus.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    for odd in (0, 1):
        events.where(F.col("event_id") % 2 == odd).write.mode("append").parquet(f"{path}/landing")
        flow = records.bounded(spark, f"{path}/landing", f"{path}/log", events.schema, most)
        sink_ = jobs.with_depth_samples(sink, f"{path}/landing", f"{path}/checkpoint", f"{path}/samples")
        jobs.drain(jobs.run(flow, sink_, f"{path}/checkpoint", every="0 seconds"))


def _most(spark: SparkSession, sf_dir: str) -> int:
    """A worker's 500 records, or a tenth of a large table: the bound is what is shown, not the number of micro-batches."""
    return max(fixed.WORKER_BATCH, corpus.read(spark, sf_dir, "events").count() // 10)


_MOST_SQL = "(SELECT greatest(500, count(*) // 10) FROM events)"


@query("buffer_depth_measured", _SQL_DEPTH.format(n=_MOST_SQL))
def buffer_depth_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.run_folder(spark, "depth")
    _landed_twice(spark, sf_dir, path, jobs.table_sink(f"{path}/table"), _most(spark, sf_dir))
    return spark.read.parquet(f"{path}/samples").select("batch_id", "depth", "consumed")


@query(
    "bounded_fetch",
    f"SELECT event_id, user_id, event_type, value, {_MOST_SQL} AS most, true AS within FROM events",
)
def bounded_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records once, each with the word whether its micro-batch kept to the bound."""
    path, most = session.run_folder(spark, "fetch"), _most(spark, sf_dir)
    _landed_twice(spark, sf_dir, path, jobs.table_sink(f"{path}/table"), most)
    rows = spark.read.parquet(f"{path}/table")
    sizes = rows.groupBy("batch_id").agg((F.count(F.lit(1)) <= most).alias("within"))
    return rows.join(sizes, "batch_id").withColumns({"most": F.lit(most).cast("bigint")}).drop("batch_id")
