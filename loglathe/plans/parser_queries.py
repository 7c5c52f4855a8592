"""Registered queries over the parser jobs, routing and the routed transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.operators import parsers_v1, parsers_v2, routing, transform
from loglathe.plans import corpus, oracle_parsers

NOW = "2026-04-05 00:00:00"

V2_NAMES = {
    "networking": "parse_network",
    "containers": "parse_container",
    "storage": "parse_database",
    "web": "parse_web",
    "cloud": "parse_cloud",
    "security": "parse_security",
    "system": "parse_syslog",
    "integrations": "parse_integration",
    "iot": "parse_iot",
    "custom": "parse_custom",
}


def map_text(entries: Column) -> Column:
    """Map as one text of sorted key=value parts, the same in every engine."""
    parts = F.transform(
        F.map_entries(entries),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("<null>"))),
    )
    return F.array_join(F.array_sort(parts), "|")


def _v2_query(family: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = getattr(parsers_v2, V2_NAMES[family])(
            corpus.lines(spark, sf_dir, corpus.V2_LINES[family])
        )
        if family == "containers":
            # a JSON value that is not an object has no attributes, only an error
            return parsed.select(
                "event_id",
                *[f"attributes.{c}" for c in ("container_id", "namespace", "stream", "raw_content")],
                "parse_error",
            )
        flat = parsed.select("event_id", F.col("attributes").alias("a"))
        names = flat.schema["a"].dataType.names
        columns = []
        for name in names:
            value = F.col("a")[name]
            if family == "custom" and name == "tags":
                value = map_text(value)
            if (family, name) in {("system", "pid"), ("integrations", "is_live_mode")}:
                value = value.cast("string")
            alias = "vendor_event_id" if (family, name) == ("integrations", "event_id") else name
            columns.append(value.alias(alias))
        return flat.select("event_id", *columns)

    return run


def _v1_query(family: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = corpus.lines(spark, sf_dir, corpus.V1_LINES[family])
        parser = getattr(parsers_v1, V2_NAMES[family] + "_v1")
        return parser(lines, now=NOW).select(
            "event_id",
            "level",
            "message",
            map_text(F.col("metadata")).alias("metadata"),
            F.col("attributes")["error"].alias("error"),
        )

    return run


def _with_lines(line: str, sql: str) -> str:
    return f"WITH lines AS (SELECT event_id, {line} AS line FROM events) {sql}"


def _v2_oracle(family: str) -> str:
    sql = oracle_parsers.V2_SQL[family]
    if family == "containers":
        kept = "container_id, namespace, stream, CASE WHEN parse_error IS NULL THEN raw_content END AS raw_content"
        sql = f"SELECT event_id, {kept}, parse_error FROM ({sql})"
    return _with_lines(corpus.V2_LINES[family], sql)


def route_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = corpus.lines(spark, sf_dir, corpus.MIXED, source=corpus.SOURCE)
    return routing.route_v2(events).select("event_id", "source", "family")


def route_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = corpus.lines(
        spark, sf_dir, corpus.MIXED_V1, source=corpus.SOURCE, service=corpus.SERVICE
    )
    return routing.route_v1(events).select("event_id", "source", "service", "family")


def route_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = corpus.lines(spark, sf_dir, corpus.MIXED, source=corpus.SOURCE)
    return routing.route_v2(events, registry=_registered()).select("event_id", "source", "family")


def _registered() -> routing.Registry:
    return routing.V2.register("Unknown-Thing", parsers_v2.WEB).register("generic", parsers_v2.IOT)


def transform_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources run the parsers registered for them; all others, of the same families too, are parsed as before."""
    events = corpus.lines(spark, sf_dir, corpus.MIXED, source=corpus.SOURCE)
    return transform.transform_logs(events, registry=_registered()).select(
        "event_id", "family", map_text(F.col("attributes")).alias("attributes"), "parse_error"
    )


def transform_logs_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = corpus.lines(spark, sf_dir, corpus.MIXED, source=corpus.SOURCE)
    return transform.transform_logs(events).select(
        "event_id", "family", map_text(F.col("attributes")).alias("attributes"), "parse_error"
    )


def transform_logs_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = corpus.lines(spark, sf_dir, corpus.MIXED, source=corpus.SOURCE)
    parsed = transform.transform_logs(events, on_error="drop")
    return parsed.groupBy("family").agg(F.count(F.lit(1)).alias("parsed_rows"))


def transform_logs_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = corpus.lines(
        spark,
        sf_dir,
        corpus.MIXED_V1,
        source=corpus.SOURCE,
        service=corpus.SERVICE,
        tenant_id=corpus.TENANT,
    )
    parsed = transform.transform_logs_v1(events, message="raw_payload", now=NOW)
    return parsed.select(
        "event_id",
        "tenant_id",
        "service",
        "source",
        "family",
        "level",
        "message",
        map_text(F.col("metadata")).alias("metadata"),
        F.col("attributes")["error"].alias("error"),
    )


# What each source is parsed as, written out here so that a check takes nothing from the code it checks.
_V2_TABLE = """
firewall networking, router networking, cisco networking, fortigate networking, kubernetes containers, docker containers,
openshift containers, k8s containers, postgresql storage, mongodb storage, mysql storage, database storage, redis storage,
nginx web, apache web, web_app web, ingress web, aws cloud, gcp cloud, azure cloud, cloudtrail cloud, auth security,
okta security, active_directory security, siem security, vpn security, syslog system, kernel system, cron system, ssh system,
stripe integrations, twilio integrations, sendgrid integrations, webhook integrations, sensor iot, gateway iot, telemetry iot,
mqtt iot, custom custom, internal custom, app custom, generic custom
"""
_V1_TABLE = """
syslog system, nginx web, apache web, web_app web, aws cloud, gcp cloud, azure cloud, cloudtrail cloud, kubernetes containers,
docker containers, openshift containers, firewall networking, router networking, cisco networking, fortigate networking,
auth security, okta security, active_directory security, siem security, postgresql storage, mongodb storage, database storage,
stripe integrations, twilio integrations, sendgrid integrations, webhook integrations, sensor iot, gateway iot, iot iot,
telemetry iot, custom custom, internal custom, app custom
"""
_REGISTERED_TABLE = _V2_TABLE.replace("generic custom", "generic iot") + ", unknown-thing web"


def _family_case(key: str, table: str) -> str:
    pairs = [x.split() for x in table.replace("\n", " ").split(",")]
    arms = " ".join(f"WHEN '{source}' THEN '{family}'" for source, family in pairs)
    return f"CASE {key} {arms} ELSE 'system' END"


_V2_KEY = f"lower({corpus.SOURCE})"
_V1_KEY = f"lower(coalesce(nullif({corpus.SOURCE}, ''), nullif({corpus.SERVICE}, ''), 'generic'))"


def _mixed_v2_oracle(table: str = _V2_TABLE) -> str:
    key = f"lower(coalesce({corpus.SOURCE}, 'generic'))"
    base = (
        f"base AS (SELECT event_id, {corpus.MIXED} AS line,"
        f" {_family_case(key, table)} AS family FROM events)"
    )
    parts = [
        f"SELECT event_id, '{family}' AS family, attributes, parse_error FROM"
        f" (WITH lines AS (SELECT event_id, line FROM base WHERE family = '{family}')"
        f" {oracle_parsers.v2_attributes(family)})"
        for family in corpus.V2_LINES
    ]
    return f"WITH {base} " + " UNION ALL ".join(parts)


def _mixed_v1_oracle() -> str:
    source = f"coalesce(nullif({corpus.SOURCE}, ''), nullif({corpus.SERVICE}, ''), 'generic')"
    base = (
        f"base AS (SELECT event_id, {corpus.MIXED_V1} AS line, {corpus.TENANT} AS tenant_id,"
        f" {corpus.SERVICE} AS service, {source} AS source,"
        f" {_family_case(_V1_KEY, _V1_TABLE)} AS family FROM events)"
    )
    parts = " UNION ALL ".join(
        f"SELECT * FROM (WITH lines AS (SELECT event_id, line FROM base WHERE family = '{family}')"
        f" {oracle_parsers.V1_SQL[family]})"
        for family in corpus.V1_LINES
    )
    return (
        f"WITH {base}, parsed AS ({parts}) SELECT event_id, tenant_id, service, source, family,"
        " level, message, metadata, error FROM base JOIN parsed USING (event_id)"
    )


QUERIES = {
    **{name: _v2_query(family) for family, name in V2_NAMES.items()},
    **{f"{name}_v1": _v1_query(family) for family, name in V2_NAMES.items()},
    "route_v2": route_v2,
    "route_v1": route_v1,
    "route_registered": route_registered,
    "transform_registered": transform_registered,
    "transform_logs_v2": transform_logs_v2,
    "transform_logs_dropped": transform_logs_dropped,
    "transform_logs_v1": transform_logs_v1,
}

ORACLES = {
    **{name: _v2_oracle(family) for family, name in V2_NAMES.items()},
    **{
        f"{name}_v1": _with_lines(corpus.V1_LINES[family], oracle_parsers.V1_SQL[family])
        for family, name in V2_NAMES.items()
    },
    "route_v2": f"SELECT event_id, {corpus.SOURCE} AS source,"
    f" {_family_case(_V2_KEY, _V2_TABLE)} AS family FROM events",
    "route_v1": f"SELECT event_id, {corpus.SOURCE} AS source, {corpus.SERVICE} AS service,"
    f" {_family_case(_V1_KEY, _V1_TABLE)} AS family FROM events",
    "route_registered": f"SELECT event_id, {corpus.SOURCE} AS source,"
    f" {_family_case(_V2_KEY, _REGISTERED_TABLE)} AS family FROM events",
    "transform_registered": _mixed_v2_oracle(_REGISTERED_TABLE),
    "transform_logs_v2": _mixed_v2_oracle(),
    "transform_logs_dropped": "SELECT family, count(*) AS parsed_rows FROM ("
    + _mixed_v2_oracle()
    + ") WHERE parse_error IS NULL GROUP BY family",
    "transform_logs_v1": _mixed_v1_oracle(),
}
