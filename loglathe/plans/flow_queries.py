"""Registered queries over intake, admission, processing, sinks, streams and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe import schemas, session
from loglathe.functions import maps
from loglathe.operators import (
    admission,
    analytics,
    intake,
    processing,
    storage,
    transform,
)
from loglathe.plans import corpus, oracle_parsers
from loglathe.plans.corpus import E, K, U, V, pick, q
from loglathe.plans.parser_queries import _V2_TABLE, NOW, _family_case, _mixed_v2_oracle, _v2_oracle, map_text
from loglathe.sinks import outputs
from loglathe.sources import inputs
from loglathe.streaming import jobs, limiter

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def text_time(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSS")


def sql_time(expression: str) -> str:
    return f"strftime(CAST({expression} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%g')"


def sql_id(*parts: str) -> str:
    """Identifier of the parts, each with its length in front."""
    texts = [f"coalesce(CAST(length(CAST({p} AS VARCHAR)) AS VARCHAR) || ':' || CAST({p} AS VARCHAR), '-')" for p in parts]
    return f"sha256({' || chr(124) || '.join(texts)})"


# --- requests ---------------------------------------------------------------
# One request per event with one to four logs; some requests are not valid and
# some hold a log that cannot be enveloped.

_LOG_COUNT = "(1 + event_id % 4)"
_REQUEST_TENANT = (
    "CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN '' WHEN event_id % 31 = 0 THEN 'a|b'"
    f" WHEN event_id % 37 = 0 THEN 'a' ELSE {corpus.TENANT} END"
)
_REQUEST_SERVICE = (
    "CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'c' WHEN event_id % 37 = 0 THEN 'b|c'"
    f" ELSE {corpus.SERVICE} END"
)


def _log_message(i: int) -> str:
    return pick(
        f"(event_id + {i})", "event_type || ' ' || " + V, "'   '", "''",
        f"'GET /' || {K} || ' from 10.0.0.' || {U}", "CAST(NULL AS STRING)",
    )


def _log_source(i: int) -> str:
    return pick(f"(event_id + {i})", "'NGINX'", "''", "CAST(NULL AS STRING)", "'Okta'")


def _log_seconds(i: int) -> str:
    # some clients send milli-, micro- or nanoseconds
    return (
        f"CASE WHEN (event_id + {i}) % 6 = 0 THEN NULL WHEN (event_id + {i}) % 6 = 1 THEN 0 WHEN (event_id + {i}) % 41 = 2"
        f" THEN 1712314200000 WHEN (event_id + {i}) % 41 = 3 THEN 1712314200000000 WHEN (event_id + {i}) % 41 = 4 THEN"
        f" 1712314200000000000 ELSE 1712314200 + event_id + {i} END"
    )


def requests(spark: SparkSession, sf_dir: str, **more: str) -> DataFrame:
    logs = [
        F.struct(
            F.expr(_log_message(i)).alias("message"),
            F.expr(_log_source(i)).alias("source"),
            F.expr(_log_seconds(i)).cast("bigint").alias("timestamp"),
            F.expr(pick("event_id", "'WARN'", "CAST(NULL AS STRING)")).alias("level"),
            F.create_map(F.lit("k"), F.expr(K)).alias("metadata"),
        )
        for i in range(4)
    ]
    events = corpus.read_for_parsing(spark, sf_dir)
    return events.select(
        "event_id",
        *[F.expr(v).alias(k) for k, v in more.items()],
        F.expr(E).alias("request_id"),
        F.expr(_REQUEST_TENANT).alias("tenant_id"),
        F.expr(_REQUEST_SERVICE).alias("service"),
        F.lit("10.1.1.1").alias("client_ip"),
        F.slice(F.array(*logs), F.lit(1), F.expr(f"CAST({_LOG_COUNT} AS INT)")).alias("logs"),
    )


_SQL_LOGS = (
    "logs AS ("
    + " UNION ALL ".join(
        f"SELECT event_id, {i} AS pos, {_log_message(i)} AS message, {_log_source(i)} AS source,"
        f" {_log_seconds(i)} AS secs, {pick('event_id', q('WARN'), 'NULL')} AS level, {K} AS k,"
        f" {_REQUEST_TENANT} AS tenant_id, {_REQUEST_SERVICE} AS service, user_id"
        f" FROM events WHERE {i} < {_LOG_COUNT}"
        for i in range(4)
    )
    + ")"
)

_STRICT_REASON = (
    "CASE WHEN tenant_id IS NULL THEN 'tenant_id missing' WHEN service IS NULL THEN 'service missing'"
    " WHEN tenant_id = '' THEN 'tenant_id empty'"
    " WHEN no_message THEN 'message missing' WHEN no_time THEN 'timestamp missing' END"
)


@query(
    "intake_split_valid",
    f"WITH {_SQL_LOGS} SELECT event_id, {_STRICT_REASON} AS reject_reason, n_logs FROM (SELECT"
    " event_id, any_value(tenant_id) AS tenant_id, any_value(service) AS service,"
    " bool_or(message IS NULL) AS no_message, bool_or(secs IS NULL) AS no_time,"
    " count(*) AS n_logs FROM logs GROUP BY event_id)",
)
def intake_split_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = intake.split_valid(requests(spark, sf_dir), strict=True)
    kept = good.withColumns({"reject_reason": F.lit(None).cast("string")})
    return kept.unionByName(bad).select(
        "event_id", "reject_reason", F.size("logs").cast("bigint").alias("n_logs")
    )


_SQL_ENVELOPE = (
    f"SELECT {sql_id('ingestion_id', 'pos')} AS event_id, ingestion_id,"
    " tenant_id, service AS service_name, lower(coalesce(source, 'generic')) AS source,"
    " '10.1.1.1' AS origin_ip, CASE WHEN secs < 253402300800 THEN secs END AS event_seconds, secs AS client_time,"
    " coalesce(message, '') AS raw_payload, k"
    f" FROM (SELECT *, {sql_id('tenant_id', 'service', 'event_id')}"
    " AS ingestion_id FROM logs WHERE tenant_id IS NOT NULL AND service IS NOT NULL)"
)


def _flat_envelopes(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id",
        "ingestion_id",
        "tenant_id",
        "service_name",
        "source",
        "origin_ip",
        F.unix_seconds("event_ts").alias("event_seconds"),
        "client_time",
        "raw_payload",
        F.col("metadata")["k"].alias("k"),
    )


@query("intake_envelope", f"WITH {_SQL_LOGS} {_SQL_ENVELOPE}")
def intake_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = intake.split_valid(requests(spark, sf_dir))
    return _flat_envelopes(intake.envelope(good, now=NOW))


@query(
    "intake_all_or_nothing",
    f"WITH {_SQL_LOGS} SELECT tenant_id, count(*) AS envelopes FROM (SELECT *, bool_or(message IS"
    " NULL OR source IS NULL) OVER (PARTITION BY event_id) AS broken FROM logs WHERE tenant_id IS"
    " NOT NULL AND service IS NOT NULL) WHERE NOT broken GROUP BY tenant_id",
)
def intake_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = intake.split_valid(requests(spark, sf_dir))
    rows = intake.envelope(good, now=NOW, null_is_problem=True)
    return rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("envelopes"))


@query(
    "intake_single",
    f"SELECT event_id AS source_event, {sql_id('ingestion_id', '0')} AS event_id, '0' AS tenant_id, service_name,"
    f" source, raw_payload FROM (SELECT event_id, {sql_id(q('0'), f'coalesce({_REQUEST_SERVICE}, {q('default')})', 'event_id')}"
    f" AS ingestion_id, coalesce({_REQUEST_SERVICE}, 'default') AS service_name, lower(coalesce({_log_source(0)},"
    f" 'generic')) AS source, coalesce({_log_message(0)}, '') AS raw_payload FROM events)",
)
def intake_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.col("logs")[0]
    single = requests(spark, sf_dir).select(
        "request_id",
        "service",
        entry["message"].alias("message"),
        entry["source"].alias("source"),
        entry["timestamp"].alias("timestamp"),
        entry["level"].alias("level"),
        # the number of the source row travels in the metadata
        F.create_map(F.lit("n"), F.col("request_id")).alias("metadata"),
    )
    rows = intake.envelope_single(single, now=NOW)
    return rows.select(
        F.col("metadata")["n"].cast("bigint").alias("source_event"),
        "event_id",
        "tenant_id",
        "service_name",
        "source",
        "raw_payload",
    )


_REQUEST_JSON = (
    f"'{{\"request_id\":\"' || {E} || '\",\"tenant_id\":' || "
    + pick("event_id", f"'\"t' || {U} || '\"'", f"'\"t' || {U} || '\"'", "'5'", f"'\"t' || {U} || '\"'")
    + " || ',\"service\":\"api\"' || "
    + pick("user_id", "''", "',\"source\":\"Okta\"'")
    + " || ',\"logs\":[{\"message\":\"' || event_type || '\"}' || "
    + pick("event_id", "',{\"message\":null}'", "',{\"source\":\"NGINX\",\"metadata\":{\"a\":1}}'",
           "',7'", "''", "',{\"message\":\"m\",\"timestamp\":17,\"metadata\":[]}'")
    + " || ']}'"
)


@query(
    "intake_decode_json",
    "WITH r AS (SELECT event_id, CAST(doc AS JSON) AS d FROM (SELECT event_id, "
    + _REQUEST_JSON
    + " AS doc FROM events)) SELECT event_id, CASE WHEN json_type(d, '$.tenant_id') <> 'VARCHAR'"
    " THEN 'tenant_id missing' WHEN json_type(d, '$.logs[1]') = 'UBIGINT' THEN 'logs missing' END AS"
    " reject_reason, CASE WHEN json_type(d, '$.logs[1]') = 'UBIGINT' THEN NULL ELSE"
    " CAST(json_array_length(d, '$.logs') AS VARCHAR) END AS n_logs, CASE WHEN"
    " json_type(d, '$.logs[1]') = 'UBIGINT' THEN NULL WHEN json_type(d, '$.logs[1].message') ="
    " 'NULL' THEN 'message is not text' WHEN json_type(d, '$.logs[1].metadata') = 'ARRAY' THEN"
    " 'metadata is not an object' END AS problem FROM r",
)
def intake_decode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus.read(spark, sf_dir, "events").select(
        "event_id", F.expr(_REQUEST_JSON).alias("value")
    )
    decoded = intake.decode_requests(texts)
    return decoded.select(
        "event_id",
        intake.reject_reason().alias("reject_reason"),
        F.size("logs").cast("string").alias("n_logs"),
        F.get(F.array_compact(F.col("logs.problem")), F.lit(0)).alias("problem"),
    )


# --- batch template ------------------------------------------------------------

_BATCH_SOURCE = corpus.SOURCE


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir, source=_BATCH_SOURCE)
    return rows.withColumnRenamed("request_id", "batch_id")


def _batch_oracle(v1: bool) -> str:
    tenant = "unknown" if v1 else "system"
    source = "raw" if v1 else "generic"
    blank = "Empty or Null input" if v1 else "Empty log"
    prefix = "'Parsing Error: ' || " if v1 else ""
    base = (
        f"base AS (SELECT event_id * 10 + pos AS event_id, event_id AS batch, pos,"
        f" coalesce(tenant_id, '{tenant}') AS tenant_id, coalesce(service, 'generic') AS service,"
        f" coalesce(src, '{source}') AS source, secs, level, k, coalesce(message, '') AS line,"
        f" {_family_case(f'lower(coalesce(src, {q(source)}))', _V2_TABLE)} AS family"
        f" FROM (SELECT l.*, s.src FROM logs l JOIN (SELECT event_id, {_BATCH_SOURCE} AS src FROM"
        " events) s USING (event_id)))"
    )
    parts = " UNION ALL ".join(
        f"SELECT * FROM (WITH lines AS (SELECT event_id, line FROM base WHERE family = '{family}')"
        f" {oracle_parsers.v2_attributes(family)})"
        for family in corpus.V2_LINES
    )
    failed = "reason IS NOT NULL"
    extra = (
        f", CASE WHEN {failed} THEN NULL ELSE service END AS service, CASE WHEN {failed} THEN"
        f" 'ERROR' ELSE coalesce(level, 'INFO') END AS level, CASE WHEN {failed} THEN NULL ELSE"
        " 'k=' || k END AS metadata"
        if v1
        else ""
    )
    tenant_out = f"CASE WHEN {failed} THEN NULL ELSE tenant_id END" if v1 else "tenant_id"
    return (
        f"WITH {_SQL_LOGS}, {base}, parsed AS ({parts}) SELECT {sql_id('batch', 'pos')} AS log_id,"
        f" {tenant_out} AS tenant_id, CASE WHEN {failed} THEN"
        f" NULL ELSE source END AS source, CASE WHEN {failed} OR coalesce(secs, 0) = 0 OR secs >= 253402300800 THEN"
        " 1775347200 ELSE secs END AS seconds, line AS message, CASE WHEN"
        f" {failed} THEN 'error=' || reason || '|raw_captured=true' ELSE attributes END AS"
        f" attributes{extra} FROM (SELECT *, CASE WHEN trim(line) = '' THEN '{blank}' WHEN"
        f" parse_error IS NOT NULL THEN {prefix}parse_error END AS reason FROM base JOIN parsed"
        " USING (event_id))"
    )


def _flat_batch(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "log_id",
        "tenant_id",
        "source",
        F.unix_seconds("timestamp").alias("seconds"),
        "message",
        map_text(F.col("attributes")).alias("attributes"),
        *more,
    )


@query("batch_template_v2", _batch_oracle(False))
def batch_template_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_batch(transform.process_batch(_batches(spark, sf_dir), now=NOW))


@query("batch_template_v1", _batch_oracle(True))
def batch_template_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform.process_batch_v1(_batches(spark, sf_dir), now=NOW)
    return _flat_batch(done, "service", "level", map_text(F.col("metadata")).alias("metadata"))


@query(
    "container_metadata_merge",
    f"WITH lines AS (SELECT event_id, {corpus.CONTAINER} AS line FROM events), parsed AS"
    f" ({oracle_parsers.V2_SQL['containers']}) SELECT event_id, CASE WHEN parse_error IS NOT NULL"
    " THEN 'kept=yes|namespace=old' WHEN is_json THEN array_to_string(list_sort(['kept=yes',"
    " 'container_id=' || coalesce(container_id, '<null>'), 'namespace=' || coalesce(namespace,"
    " '<null>'), 'stream=' || coalesce(stream, '<null>'), 'raw_content=' || raw_content]), '|')"
    " ELSE array_to_string(list_sort(['kept=yes', 'namespace=old', 'raw_content=' ||"
    " raw_content]), '|') END AS metadata FROM parsed",
)
def container_metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.lines(spark, sf_dir, corpus.CONTAINER).withColumns(
        {"metadata": maps.text_map({"kept": F.lit("yes"), "namespace": F.lit("old")})}
    )
    merged = transform.merge_container_metadata(lines, "raw_payload")
    return merged.select("event_id", map_text(F.col("metadata")).alias("metadata"))


# --- admission --------------------------------------------------------------------
# Each line item is a request; one ship day is one second, so groups are dense.

_LIMIT = 90
_DEPTH = 600
_DAY = "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))"
_SQL_ARRIVALS = (
    "arrivals AS (SELECT CASE WHEN l_suppkey % 5 > 0 THEN 't' || CAST(l_suppkey % 5 AS VARCHAR) END AS tenant_id,"
    f" 694224000 + {_DAY} AS sec, l_linenumber AS ms, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-'"
    " || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS request_id,"
    " CAST(l_quantity AS BIGINT) - 1 AS n_logs, l_partkey FROM lineitem)"
)
_SQL_RUNNING = (
    "running AS (SELECT *, sum(n_logs) OVER (PARTITION BY tenant_id, sec ORDER BY ms, request_id"
    " ROWS UNBOUNDED PRECEDING) AS running_total FROM arrivals)"
)


# order and line number repeat in the table; with part and supplier they do not
_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = corpus.read(spark, sf_dir, "lineitem").select(*_LINE_KEY, "l_quantity", "l_shipdate")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    micros = (F.lit(694224000) + day).cast("bigint") * 1_000_000 + F.col("l_linenumber") * 1000
    tenant = F.concat(F.lit("t"), (F.col("l_suppkey") % 5).cast("string"))
    return items.select(
        F.when(F.col("l_suppkey") % 5 > 0, tenant).alias("tenant_id"),  # a fifth names no tenant
        F.timestamp_micros(micros).alias("arrival"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in _LINE_KEY]).alias("request_id"),
        (F.col("l_quantity").cast("bigint") - 1).alias("n_logs"),
        "l_linenumber",
        "l_partkey",
    )


@query(
    "rate_limit",
    f"WITH {_SQL_ARRIVALS}, {_SQL_RUNNING} SELECT request_id, running_total <= {_LIMIT} AS allowed FROM running",
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.rate_limit(arrivals(spark, sf_dir), limit=_LIMIT).select("request_id", "allowed")


@query(
    "rate_limit_running",
    f"WITH {_SQL_ARRIVALS}, {_SQL_RUNNING} SELECT request_id, running_total, running_total <= {_LIMIT} AS allowed FROM running",
)
def rate_limit_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = admission.running_totals(arrivals(spark, sf_dir), limit=_LIMIT)
    return totals.select("request_id", "running_total", "allowed")


@query(
    "rate_limit_counts",
    f"WITH {_SQL_ARRIVALS} SELECT tenant_id, sec AS second, sum(n_logs) AS logs, count(*) AS batches FROM arrivals GROUP BY tenant_id, sec",
)
def rate_limit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = admission.window_counts(arrivals(spark, sf_dir))
    return counts.select("tenant_id", F.unix_seconds("second").alias("second"), "logs", "batches")


# measured depth of the buffer, sampled for most seconds
_SQL_DEPTH = "CASE WHEN sec % 7 > 0 THEN (sec * 37) % 900 END"


@query(
    "admission_status",
    f"WITH {_SQL_ARRIVALS}, judged AS (SELECT *, l_partkey % 17 <> 0 AS valid, l_partkey % 13 <> 0"
    f" AS fits, coalesce({_SQL_DEPTH}, 0) AS depth FROM arrivals), running AS (SELECT *, sum(CASE WHEN valid THEN"
    " n_logs ELSE 0 END) OVER (PARTITION BY tenant_id, sec ORDER BY ms, request_id ROWS UNBOUNDED PRECEDING) <="
    f" {_LIMIT} AS allowed FROM judged) SELECT request_id, status, CASE WHEN status = 202 THEN depth + n_logs END AS"
    " buffer_depth FROM (SELECT *, CASE WHEN NOT valid THEN 422 WHEN NOT allowed THEN 429 WHEN depth >"
    f" {_DEPTH} THEN 503 WHEN NOT fits THEN 500 ELSE 202 END AS status FROM running)",
)
def admission_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = arrivals(spark, sf_dir)
    second = F.col("second")
    seconds = flow.select(admission.second_of(F.col("arrival")).alias("second")).distinct()
    samples = seconds.where(F.unix_seconds(second) % 7 > 0).select(
        "second", (F.unix_seconds(second) * 37 % 900).alias("depth")
    )
    judged = admission.admission_status(
        admission.with_depth(flow, samples),
        valid=F.col("l_partkey") % 17 != 0,
        envelopable=F.col("l_partkey") % 13 != 0,
        depth=F.col("depth"),
        limit=_LIMIT,
        max_depth=_DEPTH,
    )
    return judged.select("request_id", "status", "buffer_depth")


# --- processing ---------------------------------------------------------------------

_RAW_MESSAGE = (
    f"CASE WHEN event_id % 11 = 0 THEN '{{broken ' || {E} WHEN event_id % 37 = 0 THEN '[1]' ELSE "
    "'{\"tenant_id\":' || "
    + pick("event_id", f"'\"t' || {U} || '\"'", f"'\"t' || {U} || '\"'", "'null'", f"'\"t' || {U} || '\"'", "'7'")
    + " || ',\"service\":' || "
    + pick("user_id", "'\"Billing\"'", "'\"AUTH-api\"'", "'\"x\"'")
    + " || ',\"timestamp\":' || "
    + pick("event_id", f"'17000' || {K}", "'\"42\"'", "'12.0'", "'1.5'", "'\"x\"'", "'true'", f"'17000' || {K}")
    + " || "
    + pick("user_id", f"',\"message\":\"' || event_type || ' ' || {V} || '\"'", "',\"message\":5'",
           "',\"message\":\"\"'", f"',\"message\":\"m' || {K} || '\"'")
    + " || "
    + pick("event_id", "''", "',\"metadata\":{\"a\":\"b\"}'", "',\"metadata\":null'",
           "',\"metadata\":[1]'", "',\"extra\":1'", "''")
    + " || '}' END"
)

_SQL_RAW = (
    "raw AS (SELECT event_id, line, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS d FROM (SELECT"
    f" event_id, line, TRY_CAST(line AS JSON) AS j FROM (SELECT event_id, {_RAW_MESSAGE} AS line"
    " FROM events)))"
)
_STAMP = (
    "CASE json_type(d, '$.timestamp') WHEN 'BOOLEAN' THEN CAST(CAST(json_extract(d, '$.timestamp')"
    " AS BOOLEAN) AS BIGINT) WHEN 'NULL' THEN NULL ELSE CASE WHEN"
    " regexp_full_match(json_extract_string(d, '$.timestamp'), '[+-]?[0-9]+(\\.0+)?') THEN"
    " CAST(CAST(json_extract_string(d, '$.timestamp') AS DOUBLE) AS BIGINT) END END"
)
_SQL_CONTRACT = (
    f"contract AS (SELECT *, {_STAMP} AS stamp, CASE WHEN d IS NULL THEN 'not a JSON object' WHEN"
    " coalesce(json_type(d, '$.tenant_id') <> 'VARCHAR', true) THEN 'tenant_id: text required'"
    " WHEN coalesce(json_type(d, '$.service') <> 'VARCHAR', true) THEN 'service: text required'"
    f" WHEN {_STAMP} IS NULL THEN 'timestamp: whole number required' WHEN coalesce(json_type(d,"
    " '$.message') <> 'VARCHAR', true) THEN 'message: text required' WHEN json_type(d,"
    " '$.metadata') <> 'OBJECT' THEN 'metadata: object required' END AS error FROM raw)"
)
_SQL_INDEXED = (
    "SELECT event_id, json_extract_string(d, '$.tenant_id') AS tenant,"
    " lower(json_extract_string(d, '$.service')) AS service, stamp AS ts,"
    " json_extract_string(d, '$.message') AS msg, coalesce('a=' || json_extract_string(d,"
    " '$.metadata.a'), '') AS metadata, length(json_extract_string(d, '$.message')) AS msg_length,"
    " lower(json_extract_string(d, '$.service')) || ',log' AS tags FROM contract WHERE error IS NULL"
)


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.read_for_parsing(spark, sf_dir).select(
        "event_id", F.expr(_RAW_MESSAGE).alias("value")
    )


def _flat_indexed(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id",
        "tenant",
        "service",
        "ts",
        "msg",
        map_text(F.col("metadata")).alias("metadata"),
        "msg_length",
        F.array_join("tags", ",").alias("tags"),
    )


@query(
    "contract_parse",
    f"WITH {_SQL_RAW}, {_SQL_CONTRACT} SELECT event_id, error, CASE WHEN error IS NULL THEN"
    " json_extract_string(d, '$.tenant_id') END AS tenant_id, CASE WHEN error IS NULL THEN"
    " json_extract_string(d, '$.message') END AS message, CASE WHEN error IS NULL THEN CAST(stamp"
    " AS VARCHAR) END AS stamp FROM contract",
)
def contract_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = processing.parse_contract(raw_messages(spark, sf_dir))
    return parsed.select(
        "event_id", "error", "tenant_id", "message", F.col("timestamp").cast("string").alias("stamp")
    )


@query(
    "schema_gate",
    f"WITH {_SQL_RAW} SELECT schema_error, count(*) AS messages FROM (SELECT CASE WHEN d IS NULL"
    " THEN 'not a JSON object' WHEN coalesce(json_type(d, '$.tenant_id') <> 'VARCHAR', true) THEN"
    " 'tenant_id: expected string' WHEN coalesce(json_type(d, '$.service') <> 'VARCHAR', true)"
    " THEN 'service: expected string' WHEN coalesce(json_type(d, '$.timestamp') NOT IN ('UBIGINT',"
    " 'BIGINT'), true) THEN CASE WHEN json_extract_string(d, '$.timestamp') = '12.0' THEN"
    " 'timestamp: expected bigint' ELSE 'timestamp: expected bigint' END WHEN coalesce(json_type(d,"
    " '$.message') <> 'VARCHAR', true) THEN 'message: expected string' WHEN json_type(d,"
    " '$.metadata') NOT IN ('OBJECT', 'NULL') THEN 'metadata: expected map<string,string>' END AS"
    " schema_error FROM raw) GROUP BY schema_error",
)
def schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = processing.validate_schema(raw_messages(spark, sf_dir), schemas.RAW_LOG)
    return gated.groupBy("schema_error").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "normalize_enrich",
    f"SELECT event_id, {corpus.TENANT} AS tenant, lower({corpus.SERVICE}) AS service, user_id AS ts,"
    " event_type AS msg, length(event_type) AS msg_length, 'k=' || " + K + " AS metadata,"
    f" lower({corpus.SERVICE}) || ',log' AS tags FROM events",
)
def normalize_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = corpus.read(spark, sf_dir, "events").select(
        "event_id",
        F.expr(corpus.TENANT).alias("tenant_id"),
        F.expr(corpus.SERVICE).alias("service"),
        F.col("user_id").alias("timestamp"),
        F.col("event_type").alias("message"),
        F.create_map(F.lit("k"), F.expr(K)).alias("metadata"),
    )
    return _flat_indexed(processing.enrich(processing.normalize(logs)))


@query("process_logs_indexed", f"WITH {_SQL_RAW}, {_SQL_CONTRACT} {_SQL_INDEXED}")
def process_logs_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = processing.process_logs(raw_messages(spark, sf_dir))
    return _flat_indexed(processing.indexed_rows(done))


@query(
    "process_logs_dlq",
    f"WITH {_SQL_RAW}, {_SQL_CONTRACT} SELECT event_id, line AS raw, error FROM contract WHERE error IS NOT NULL",
)
def process_logs_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = processing.process_logs(raw_messages(spark, sf_dir))
    return processing.dead_letters(done, now=NOW).select("event_id", "raw", "error")


# the repair sets a text tenant; messages that broke only there pass on replay,
# and events of every 7th user are taken as indexed by an earlier replay
@query(
    "dlq_replay",
    f"WITH {_SQL_RAW}, {_SQL_CONTRACT} SELECT event_id, 'fixed' AS tenant, lower(json_extract_string(d,"
    " '$.service')) AS service, stamp AS ts FROM contract JOIN events USING (event_id) WHERE error ="
    " 'tenant_id: text required' AND stamp IS NOT NULL AND json_type(d, '$.message') = 'VARCHAR' AND"
    " coalesce(json_type(d, '$.metadata') = 'OBJECT', true) AND user_id % 7 <> 0",
)
def dlq_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_messages(spark, sf_dir)
    dead = processing.dead_letters(processing.process_logs(raw), now=NOW)
    dead = dead.unionByName(dead.where("event_id % 2 = 0"))  # a retry has stored some twice
    replayed_before = corpus.read(spark, sf_dir, "events").where("user_id % 7 = 0")

    def repair(text: Column) -> Column:
        return F.regexp_replace(text, '"tenant_id":(null|7)', '"tenant_id":"fixed"')

    return processing.replay(dead, replayed_before, repair).select(
        "event_id", "tenant", "service", "ts"
    )


@query(
    "processing_counters",
    f"WITH {_SQL_RAW}, {_SQL_CONTRACT} SELECT coalesce(error, 'processed') AS outcome, count(*) AS"
    " messages FROM contract GROUP BY ALL",
)
def processing_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = processing.process_logs(raw_messages(spark, sf_dir))
    return done.groupBy(F.coalesce("error", F.lit("processed")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("messages")
    )


# --- storage and sinks ------------------------------------------------------------------

_SQL_ENVELOPES = (
    f"SELECT event_id, ts, {corpus.MIXED} AS raw_payload, {corpus.SOURCE} AS source,"
    f" {corpus.TENANT} AS tenant_id, {corpus.SERVICE} AS service_name, {K} AS k FROM events"
)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.read_for_parsing(spark, sf_dir).select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.expr(corpus.MIXED).alias("raw_payload"),
        F.expr(corpus.SOURCE).alias("source"),
        F.expr(corpus.TENANT).alias("tenant_id"),
        F.expr(corpus.SERVICE).alias("service_name"),
        F.create_map(F.lit("k"), F.expr(K)).alias("metadata"),
    )


def _stored_oracle(select: str) -> str:
    return (
        f"WITH env AS ({_SQL_ENVELOPES}), parsed AS ({_mixed_v2_oracle()}) SELECT {select} FROM env"
        " JOIN parsed USING (event_id)"
    )


@query(
    "storage_rows",
    "SELECT event_id, coalesce(t, '0') AS tenant_id, coalesce(s, 'default') AS service,"
    " coalesce(src, 'generic') AS source, 'INFO' AS level, coalesce(m, '') AS message, 'k=' || k AS"
    f" metadata FROM (SELECT event_id, {_REQUEST_TENANT} AS t, {_REQUEST_SERVICE} AS s,"
    f" {corpus.SOURCE} AS src, {_log_message(0)} AS m, {K} AS k FROM events)",
)
def storage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = corpus.read(spark, sf_dir, "events").select(
        F.timestamp_seconds("event_id").alias("timestamp"),
        F.expr(_REQUEST_TENANT).alias("tenant_id"),
        F.expr(_REQUEST_SERVICE).alias("service"),
        F.expr(corpus.SOURCE).alias("source"),
        F.lit(None).cast("string").alias("level"),
        F.expr(_log_message(0)).alias("message"),
        F.create_map(F.lit("k"), F.expr(K)).alias("metadata"),
    )
    return storage.storage_rows(events).select(
        F.unix_seconds("timestamp").alias("event_id"),
        "tenant_id",
        "service",
        "source",
        "level",
        "message",
        map_text(F.col("metadata")).alias("metadata"),
    )


def _hot_columns(df: DataFrame) -> DataFrame:
    return df.select(
        text_time(F.col("timestamp")).alias("timestamp"),
        "tenant_id",
        "service",
        "source",
        "level",
        "message",
        F.col("metadata")["k"].alias("k"),
        F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
    )


_HOT_SELECT = (
    f"{sql_time('ts')} AS timestamp, tenant_id, service_name AS service, coalesce(source, 'generic')"
    " AS source, 'INFO' AS level, raw_payload AS message, k, strftime(CAST(ts AS DATE), '%Y-%m-%d')"
    " AS event_date"
)


@query("hot_table", _stored_oracle(_HOT_SELECT))
def hot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.run_folder(spark, "hot")
    parsed = transform.transform_logs(envelopes(spark, sf_dir))
    outputs.write_hot(storage.hot_rows(parsed, NOW), path)
    return _hot_columns(spark.read.parquet(path))


@query(
    "cold_archive",
    "SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day,"
    f" {corpus.TENANT} AS tenant_id, count(*) AS logs, sum(length({corpus.MIXED})) AS characters"
    " FROM events GROUP BY ALL",
)
def cold_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.run_folder(spark, "cold")
    parsed = transform.transform_logs(envelopes(spark, sf_dir))
    outputs.write_archive(storage.hot_rows(parsed, NOW), path)
    stored = spark.read.parquet(path)
    padded = {
        "year": F.col("year").cast("string"),
        "month": F.lpad(F.col("month").cast("string"), 2, "0"),
        "day": F.lpad(F.col("day").cast("string"), 2, "0"),
    }
    return (
        stored.withColumns(padded)
        .groupBy("year", "month", "day", "tenant_id")
        .agg(F.count(F.lit(1)).alias("logs"), F.sum(F.length("message")).alias("characters"))
    )


@query(
    "keyed_publish",
    f"SELECT coalesce({_REQUEST_TENANT}, 'unknown') || ':' || coalesce({_REQUEST_SERVICE},"
    " 'unknown') AS key, 'ingested_logs' AS topic, event_id, event_type AS payload FROM events",
)
def keyed_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.run_folder(spark, "messages")
    rows = corpus.read(spark, sf_dir, "events").select(
        "event_id",
        F.expr(_REQUEST_TENANT).alias("tenant_id"),
        F.expr(_REQUEST_SERVICE).alias("service_name"),
        F.col("event_type").alias("raw_payload"),
    )
    outputs.publish_files(rows, path, order=["event_id"])
    messages = inputs.message_text(inputs.message_files(spark, path))
    value = F.from_json("value", "event_id bigint, raw_payload string")
    return messages.select("key", "topic", value.alias("v")).select(
        "key", "topic", "v.event_id", F.col("v.raw_payload").alias("payload")
    )


@query(
    "landing_round_trip",
    f"WITH {_SQL_LOGS} {_SQL_ENVELOPE}",
)
def landing_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.run_folder(spark, "landing")
    good, _ = intake.split_valid(requests(spark, sf_dir))
    outputs.write_landing(intake.envelope(good, now=NOW), path)
    return _flat_envelopes(inputs.envelope_files(spark, path))


_PATH_JSON = (
    f"'{{\"arrival\":\"2026-04-04 10:00:0' || CAST(event_id % 7 AS STRING) || '\",\"client_ip\":\"10.1.1.1\",' ||"
    f" substr({_REQUEST_JSON}, 2)"
)
_PATH_LIMIT = 40


@query(
    "request_to_message",
    "WITH r AS (SELECT event_id, CAST(doc AS JSON) AS d FROM (SELECT event_id, " + _REQUEST_JSON + " AS doc FROM events)),"
    " v AS (SELECT event_id, d, json_extract_string(d, '$.tenant_id') AS tenant, json_array_length(d, '$.logs') AS n"
    " FROM r WHERE json_type(d, '$.tenant_id') = 'VARCHAR' AND coalesce(json_type(d, '$.logs[1]'), '') <> 'UBIGINT'),"
    " l AS (SELECT *, sum(n) OVER (PARTITION BY tenant, event_id % 7 ORDER BY CAST(event_id AS VARCHAR) ROWS UNBOUNDED"
    f" PRECEDING) <= {_PATH_LIMIT} AS allowed FROM v) SELECT tenant || ':api' AS key, CAST(sum(n) AS BIGINT) AS messages"
    " FROM l WHERE allowed AND coalesce(json_type(d, '$.logs[1].message'), '') <> 'NULL' AND"
    " coalesce(json_type(d, '$.logs[1].metadata'), '') <> 'ARRAY' GROUP BY tenant",
)
def request_to_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: request lines, validation, rate limit, envelopes, landing, parsing, keyed messages."""
    path = session.run_folder(spark, "path")
    lines = corpus.read_for_parsing(spark, sf_dir).select(F.expr(_PATH_JSON).alias("value"))
    lines.write.text(f"{path}/requests")
    # the limiter reads its rows three times, and what judges a request is a filter: the lines are decoded once, before both
    inputs.request_files(spark, f"{path}/requests").drop("value").write.parquet(f"{path}/decoded")
    good, _ = intake.split_valid(spark.read.parquet(f"{path}/decoded"))
    counted = good.withColumns({"n_logs": F.size("logs").cast("bigint")})
    let_in = admission.rate_limit(counted, limit=_PATH_LIMIT).where("allowed")
    outputs.write_landing(intake.envelope(let_in, now=NOW), f"{path}/landing")
    parsed = transform.transform_logs(inputs.envelope_files(spark, f"{path}/landing"))
    outputs.publish_files(parsed, f"{path}/messages", order=["event_id"])
    messages = inputs.message_text(inputs.message_files(spark, f"{path}/messages"))
    return messages.groupBy("key").agg(F.count(F.lit(1)).alias("messages"))


# --- streams ---------------------------------------------------------------------------


def _finish(stream_query) -> None:
    stream_query.awaitTermination()


BATCH_FILES = 4


def in_batches(df: DataFrame, path: str, part: Column, parts: int = 3, files: int = BATCH_FILES) -> DataFrame:
    """The rows as a stream of one micro-batch per part, in the order of the parts.

    The rows are made once, and each part is read from there: into as many files as one micro-batch takes, `files` at least
    and one for about ``session.TASK_ROWS`` rows. Rows whose part is null or none of these are in the last.
    """
    spark = df.sparkSession
    number = F.when(part.between(0, parts - 1), part).otherwise(parts - 1).cast("int")
    df.withColumns({"__part": number}).write.partitionBy("__part").parquet(f"{path}-parts")
    made = spark.read.schema(T.StructType([*df.schema, T.StructField("__part", T.IntegerType())])).parquet(f"{path}-parts")
    sizes = dict(made.groupBy("__part").count().collect())
    files = max(files, -(-max(sizes.values(), default=0) // session.TASK_ROWS))
    for n in range(parts):
        made.where(F.col("__part") == n).drop("__part").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("stream_transform", _mixed_v2_oracle())
def stream_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.run_folder(spark, "stream-transform")
    flow = in_batches(envelopes(spark, sf_dir), f"{path}/in", F.hour("timestamp") % 3)
    parsed = jobs.transform_stream(flow)
    _finish(jobs.run(parsed, jobs.table_sink(f"{path}/table"), f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/table").select(
        "event_id", "family", map_text(F.col("attributes")).alias("attributes"), "parse_error"
    )


@query(
    "stream_sink",
    _stored_oracle(f"'hot' AS place, {_HOT_SELECT}").replace("WITH env", "WITH stored AS (WITH env", 1)
    + ") SELECT * FROM stored UNION ALL SELECT 'cold', * EXCLUDE (place) FROM stored",
)
def stream_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.run_folder(spark, "stream-sink")
    flow = in_batches(envelopes(spark, sf_dir), f"{path}/in", F.hour("timestamp") % 3)
    write = jobs.hot_and_cold(f"{path}/hot", f"{path}/cold", NOW, f"{path}/manifest")
    _finish(jobs.run(jobs.transform_stream(flow), write, f"{path}/checkpoint"))
    tables = {name: outputs.committed(spark, f"{path}/{name}", f"{path}/manifest") for name in ("hot", "cold")}
    tables["cold"] = tables["cold"].withColumns({"event_date": F.to_date("timestamp")})
    hot, cold = (_hot_columns(t).withColumns({"place": F.lit(name)}) for name, t in tables.items())
    return hot.unionByName(cold)


@query(
    "stream_dead_letters",
    f"WITH {_SQL_RAW}, {_SQL_CONTRACT} SELECT coalesce(error, 'indexed') AS outcome, count(*) AS"
    " messages FROM contract GROUP BY ALL",
)
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.run_folder(spark, "stream-dlq")
    raw = in_batches(raw_messages(spark, sf_dir).select("event_id", "value"), f"{path}/in", F.col("event_id") % 3)
    write = jobs.index_or_dead_letter(f"{path}/index", f"{path}/dlq", now=NOW)
    _finish(jobs.run(raw, write, f"{path}/checkpoint"))
    indexed = spark.read.parquet(f"{path}/index").select(F.lit("indexed").alias("outcome"))
    dead = spark.read.parquet(f"{path}/dlq").select(F.col("error").alias("outcome"))
    return indexed.unionByName(dead).groupBy("outcome").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "stream_rate_limit",
    f"WITH {_SQL_ARRIVALS}, {_SQL_RUNNING} SELECT request_id, l_partkey, running_total <= {_LIMIT} AS allowed FROM running",
)
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests come in three micro-batches, by line number, so every second is spread over all of them."""
    path = session.run_folder(spark, "stream-limit")
    number = F.col("l_linenumber")
    part = F.when(number <= 2, 0).when(number <= 4, 1).otherwise(2)
    flow = in_batches(arrivals(spark, sf_dir), f"{path}/in", part)
    write = limiter.limit_batches(f"{path}/totals", f"{path}/table", limit=_LIMIT)
    _finish(jobs.run(flow, write, f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/table").select("request_id", "l_partkey", "allowed")


@query("stream_dedup", "SELECT event_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is delivered one to three times, and the older ones come last."""
    path = session.run_folder(spark, "stream-dedup")
    events = corpus.read(spark, sf_dir, "events")
    copies = F.sequence(F.lit(1), (F.col("event_id") % 3 + 1).cast("int"))
    delivered = events.select(
        "event_id",
        "event_type",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.explode(copies).alias("copy"),
    )
    late = F.when(F.dayofmonth("timestamp") > 20, 0).when(F.dayofmonth("timestamp") > 10, 1).otherwise(2)
    flow = in_batches(delivered, f"{path}/in", F.pmod(late + F.col("copy") - 1, F.lit(3)))
    unique = jobs.deduplicated(flow)
    _finish(jobs.run(unique, jobs.table_sink(f"{path}/table"), f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/table").select("event_id", "event_type")


_SQL_RATES = (
    "SELECT strftime(time_bucket(INTERVAL '{every}', ts), '%Y-%m-%d %H:%M:%S.%g') AS window_start,"
    f" {corpus.TENANT} AS tenant_id, {corpus.SERVICE} AS service, count(*) AS logs FROM events"
    " GROUP BY ALL"
)


def _late_days(time: str) -> Column:
    """Newest days first, so that most rows of the later micro-batches are old."""
    return F.when(F.dayofmonth(time) > 20, 0).when(F.dayofmonth(time) % 3 > 0, 1).otherwise(2)


@query("stream_rates", _SQL_RATES.format(every="1 hour"))
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.run_folder(spark, "stream-rates")
    rows = envelopes(spark, sf_dir).withColumnRenamed("service_name", "service")
    flow = in_batches(rows, f"{path}/in", _late_days("timestamp"))
    sink = jobs.counted_into(f"{path}/table", jobs.rate_counts(every="1 hour"))
    _finish(jobs.run(flow, sink, f"{path}/checkpoint"))
    rates = jobs.summed(spark.read.parquet(f"{path}/table"), ["logs"])
    return rates.withColumns({"window_start": text_time(F.col("window_start"))})


# --- reports -------------------------------------------------------------------------------


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.transform_logs(envelopes(spark, sf_dir))


_IS_ERROR = (
    "(coalesce(regexp_matches(attributes, '(^|\\|)(is_error|is_system_error|is_failure)=true(\\||$)'),"
    " false) OR coalesce(regexp_matches(attributes, '(^|\\|)status=CRITICAL(\\||$)'), false))"
)


@query(
    "error_frequency",
    "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, family, logs, errors, round(errors /"
    f" logs, 6) AS error_rate FROM (SELECT date_trunc('day', ts) AS ts, family, count(*) AS logs,"
    f" sum(CASE WHEN {_IS_ERROR} THEN 1 ELSE 0 END) AS errors FROM ("
    + _stored_oracle("ts, family, attributes")
    + ") GROUP BY ALL)",
)
def error_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    frequency = analytics.error_frequency(
        _parsed(spark, sf_dir), analytics.is_error_row(F.col("attributes")), every="1 day"
    )
    return frequency.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"),
        "family",
        "logs",
        "errors",
        F.round("error_rate", 6).alias("error_rate"),
    )


@query(
    "stream_errors",
    "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, family, count(*) AS logs, sum(CASE WHEN"
    f" {_IS_ERROR} THEN 1 ELSE 0 END) AS errors FROM (" + _stored_oracle("ts, family, attributes") + ") GROUP BY ALL",
)
def stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.run_folder(spark, "stream-errors")
    flow = in_batches(envelopes(spark, sf_dir), f"{path}/in", _late_days("timestamp"))
    count = jobs.error_counts(analytics.is_error_row(F.col("attributes")), every="1 day")
    sink = jobs.counted_into(f"{path}/table", count)
    _finish(jobs.run(jobs.transform_stream(flow), sink, f"{path}/checkpoint"))
    totals = jobs.summed(spark.read.parquet(f"{path}/table"), ["logs", "errors"])
    return totals.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "family", "logs", "errors")


@query("ingestion_rate", _SQL_RATES.format(every="1 minute"))
def ingestion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = envelopes(spark, sf_dir).withColumnRenamed("service_name", "service")
    rates = analytics.ingestion_rate(flow)
    return rates.withColumns({"window_start": text_time(F.col("window_start"))})


@query(
    "log_search",
    f"SELECT {sql_time('ts')} AS timestamp, tenant_id, service_name AS service, raw_payload AS"
    f" message FROM ({_SQL_ENVELOPES}) WHERE tenant_id = 't3' AND ts >= TIMESTAMP '2024-01-05"
    " 00:00:00' AND ts < TIMESTAMP '2024-01-25 12:00:00' AND contains(raw_payload, 'e') ORDER BY ts"
    " DESC, tenant_id, service_name, raw_payload LIMIT 50",
)
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.run_folder(spark, "search")
    outputs.write_hot(storage.hot_rows(envelopes(spark, sf_dir), NOW), path)
    table = spark.read.parquet(path)
    found = analytics.search(
        table,
        tenant_id="t3",
        start="2024-01-05 00:00:00",
        end="2024-01-25 12:00:00",
        contains="e",
        newest=50,
    )
    return found.select(text_time(F.col("timestamp")).alias("timestamp"), "tenant_id", "service", "message")


@query(
    "top_k_errors",
    f"SELECT tenant_id, family, count(*) AS errors FROM ({_stored_oracle('tenant_id, family, attributes')})"
    f" WHERE {_IS_ERROR} GROUP BY tenant_id, family ORDER BY errors DESC, tenant_id, family LIMIT 10",
)
def top_k_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_k_errors(
        _parsed(spark, sf_dir),
        analytics.is_error_row(F.col("attributes")),
        ["tenant_id", "family"],
        k=10,
    )


@query(
    "level_rollup",
    f"SELECT tenant_id, service, level, count(*) AS logs, GROUPING_ID(tenant_id, service, level) AS"
    f" depth FROM (SELECT {corpus.TENANT} AS tenant_id, {corpus.SERVICE} AS service,"
    " CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level FROM events) GROUP BY"
    " ROLLUP (tenant_id, service, level)",
)
def level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.read(spark, sf_dir, "events").select(
        F.expr(corpus.TENANT).alias("tenant_id"),
        F.expr(corpus.SERVICE).alias("service"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
    )
    return analytics.level_rollup(rows)


_BUCKET_SQL = " UNION ALL ".join(
    f"SELECT event_type, '{b}' AS le, sum(CASE WHEN value / 50.0 <= {b} THEN 1 ELSE 0 END) AS logs FROM events GROUP BY event_type"
    for b in analytics.fixed.LATENCY_BUCKETS
)


@query(
    "latency_histogram",
    f"{_BUCKET_SQL} UNION ALL SELECT event_type, '+Inf', count(*) FROM events GROUP BY event_type",
)
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = corpus.read(spark, sf_dir, "events")
    return analytics.latency_histogram(events, F.col("value") / 50.0, ["event_type"])


@query(
    "domain_report",
    f"SELECT coalesce(source IN ('nginx', 'postgresql', 'kubernetes', 'syslog', 'generic'), false) AS"
    " known_source, coalesce(level IN ('DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL'), false) AS"
    f" known_level, count(*) AS logs FROM (SELECT {corpus.SOURCE} AS source,"
    f" {pick('user_id', q('INFO'), q('warn'), 'NULL', q('CRITICAL'))} AS level FROM events) GROUP BY ALL",
)
def domain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.read(spark, sf_dir, "events").select(
        F.expr(corpus.SOURCE).alias("source"),
        F.expr(pick("user_id", "'INFO'", "'warn'", "NULL", "'CRITICAL'")).alias("level"),
    )
    return analytics.domain_report(rows)


def _duration_oracle() -> str:
    parsed = _v2_oracle("storage")
    measured = f"SELECT operation, TRY_CAST(duration AS DOUBLE) AS d FROM ({parsed}) WHERE duration IS NOT NULL"
    return (
        "SELECT operation, count(d) AS n, round(avg(d), 4) AS mean, max(d) AS longest, quantile_disc(d, 0.5) AS p50,"
        f" quantile_disc(d, 0.95) AS p95 FROM ({measured}) GROUP BY operation"
    )


@query("duration_summary", _duration_oracle())
def duration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loglathe.operators.parsers_v2 import parse_database

    parsed = parse_database(corpus.lines(spark, sf_dir, corpus.DATABASE))
    duration = F.col("attributes.duration")
    summary = analytics.duration_summary(
        parsed.select(F.col("attributes.operation").alias("operation"), duration.alias("duration")),
        F.col("duration"),
        ["operation"],
    )
    return summary.select("operation", "n", F.round("mean", 4).alias("mean"), "longest", "p50", "p95")
