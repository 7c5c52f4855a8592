"""The ten parser jobs of the v2 dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe import fixed
from loglathe.functions import json, maps, text
from loglathe.operators.parsing import Columns, Found, Line, Parser, parse_one

# --- networking ------------------------------------------------------------


def _network_matches(line: Line, f: Found) -> Columns:
    return {
        "ips": text.every(line.raw, fixed.IPV4),
        "ports": text.every(line.raw, fixed.PORT, 1, icase=True),
    }


def _network(line: Line, f: Found) -> Columns:
    return {
        "nw_src_ip": F.get(f.ips, F.lit(0)),
        "nw_dst_ip": F.get(f.ips, F.lit(1)),
        "nw_src_port": F.get(f.ports, F.lit(0)),
        "nw_dst_port": F.get(f.ports, F.lit(1)),
        "nw_ip_count": F.size(f.ips).cast("string"),
        "action": F.when(text.has_any(line.upper, fixed.DENY_WORDS), "DENY").otherwise("ALLOW"),
        "protocol": F.when(line.upper.contains("TCP"), "TCP")
        .when(line.upper.contains("UDP"), "UDP")
        .otherwise("OTHER"),
        "vendor_type": F.when(text.has_any(line.raw, fixed.FIREWALL_MARKS), "firewall").otherwise(
            "router"
        ),
    }


NETWORK = Parser("networking", (_network_matches,), _network)

# --- containers --------------------------------------------------------------

_CONTAINER_KEYS = ["container_id", "namespace", "stream", "log", "message"]
_CONTAINER_EXTRA_KEYS = ["time", "attrs", "kubernetes"]


def container_parser(
    inner: Callable[[Column], Columns] | None = None, extras: bool = False
) -> Parser:
    """Container parser with an optional rule for the inner message.

    ``inner`` maps the unwrapped message to output columns; the default is one
    column ``raw_content``.  ``extras`` adds the Docker time and attributes and
    the Kubernetes pod id.
    """
    specialize = inner or (lambda content: {"raw_content": content})
    keys = _CONTAINER_KEYS + (_CONTAINER_EXTRA_KEYS if extras else [])

    def read(line: Line, f: Found) -> Columns:
        return {"json": json.read_object(line.raw, keys)}

    def checked(line: Line, f: Found) -> Columns:
        return {"doc": json.whole_object(f.json)}

    def content(line: Line, f: Found) -> Columns:
        return {
            "content": F.coalesce(json.first_truthy(f.doc["log"], f.doc["message"]), line.raw),
            "kind": F.when(f.doc.isNull(), json.non_object_kind(line.raw)),
        }

    def outputs(line: Line, f: Found) -> Columns:
        is_json = f.doc.isNotNull()
        columns = {
            "container_id": json.text_of(f.doc["container_id"]),
            "namespace": F.when(is_json & f.doc["namespace"].isNull(), "default").otherwise(
                json.text_of(f.doc["namespace"])
            ),
            "stream": F.when(is_json & f.doc["stream"].isNull(), "stdout").otherwise(
                json.text_of(f.doc["stream"])
            ),
        }
        if extras:
            columns["time"] = json.text_of(f.doc["time"])
            columns["attrs"] = json.text_of(f.doc["attrs"])
            columns["pod_id"] = F.coalesce(
                json.text_of(json.child(f.doc["kubernetes"], "$.pod_id")),
                F.lit(None).cast("string"),
            )
        columns.update(specialize(f.content))
        columns["is_json"] = is_json
        return columns

    def error(line: Line, f: Found) -> Column:
        return F.when(
            f.kind.isNotNull(),
            F.concat(F.lit("'"), f.kind, F.lit("' object has no attribute 'get'")),
        )

    def attributes(columns: Columns) -> Column:
        # text that is not JSON has only the inner columns
        wrapper = {"container_id", "namespace", "stream", "time", "attrs", "pod_id"}
        shown = {k: v for k, v in columns.items() if k != "is_json"}
        inner_only = {k: v for k, v in shown.items() if k not in wrapper}
        return F.when(columns["is_json"], maps.text_map(shown)).otherwise(maps.text_map(inner_only))

    return Parser("containers", (read, checked, content), outputs, error, attributes)


CONTAINER = container_parser()

# --- storage -------------------------------------------------------------------


def _database_matches(line: Line, f: Found) -> Columns:
    return {
        "action": F.upper(text.first(line.raw, fixed.DB_ACTION, 1, icase=True)),
        "latency": text.first(line.raw, fixed.DB_LATENCY),
    }


def _database_parts(line: Line, f: Found) -> Columns:
    # groups come from the short match, not from a second search of the line
    return {
        "amount": F.coalesce(
            text.first(f.latency, fixed.DB_LATENCY, 1).try_cast("double"), F.lit(0.0)
        ),
        "unit": F.coalesce(text.first(f.latency, fixed.DB_LATENCY, 2), F.lit("ms")),
    }


def _database(line: Line, f: Found) -> Columns:
    return {
        "operation": F.coalesce(f.action, F.lit("UNKNOWN")),
        "duration": f.amount,
        "unit": f.unit,
        "is_slow_query": ((f.unit == "ms") & (f.amount > fixed.SLOW_QUERY_MS))
        | ((f.unit == "s") & (f.amount > fixed.SLOW_QUERY_S)),
        "db_family": F.when(text.has_any(line.lower, fixed.RDBMS_WORDS), "rdbms").otherwise(
            "nosql"
        ),
    }


DATABASE = Parser("storage", (_database_matches, _database_parts), _database)

# --- web -----------------------------------------------------------------------


def _web_matches(line: Line, f: Found) -> Columns:
    return {
        "request": F.when(
            line.raw.contains('"'), text.first(line.raw, fixed.HTTP_REQUEST, icase=True)
        ),
        "status": text.first(line.raw, fixed.HTTP_STATUS, 1),
    }


def _web_parts(line: Line, f: Found) -> Columns:
    return {
        "method": F.upper(text.first(f.request, fixed.HTTP_REQUEST, 1, icase=True)),
        "path": F.coalesce(text.first(f.request, fixed.HTTP_REQUEST, 2, icase=True), F.lit("/")),
        "code": F.coalesce(f.status.try_cast("int"), F.lit(0)),
    }


def _web(line: Line, f: Found) -> Columns:
    return {
        "method": F.coalesce(f.method, F.lit("UNKNOWN")),
        "path": f.path,
        "status_code": f.code,
        "response_category": F.when((f.code >= 400) & (f.code < 500), "CLIENT_ERROR")
        .when(f.code >= 500, "SERVER_ERROR")
        .when(f.code == 0, "MALFORMED")
        .otherwise("SUCCESS"),
        "request_type": F.when(
            text.extension(F.lower(f.path)).isin(fixed.STATIC_EXTENSIONS), "STATIC_ASSET"
        ).otherwise("API_CALL"),
        "is_error": f.code >= 400,
    }


WEB = Parser("web", (_web_matches, _web_parts), _web)

# --- cloud -----------------------------------------------------------------------

_CLOUD_KEYS = [
    "provider", "cloud_provider", "region", "aws_region",
    "account_id", "owner", "resource_id", "arn",
]


def _cloud_json(line: Line, f: Found) -> Columns:
    return {"json": json.read_object(line.raw, _CLOUD_KEYS)}


def _cloud_checked(line: Line, f: Found) -> Columns:
    return {"doc": json.whole_object(f.json)}


def _cloud_region(line: Line, f: Found) -> Columns:
    d = f.doc
    return {
        "region": F.when(d.isNull(), "global").otherwise(
            json.truthy_or_present(d["region"], d["aws_region"], "global")
        )
    }


def _cloud(line: Line, f: Found) -> Columns:
    d = f.doc

    def either(first: str, second: str, default: str, not_json: str) -> Column:
        return F.when(d.isNull(), not_json).otherwise(
            json.truthy_or_present(d[first], d[second], default)
        )

    return {
        "provider": either("provider", "cloud_provider", "unknown", "unknown"),
        "region": f.region,
        "account_id": either("account_id", "owner", "internal", "none"),
        "resource_id": either("resource_id", "arn", "unassigned", "raw_stream"),
        "cloud_service": F.when(text.has_any(line.upper, fixed.SERVERLESS_WORDS), "SERVERLESS")
        .when(text.has_any(line.upper, fixed.STORAGE_WORDS), "STORAGE")
        .when(text.has_any(line.upper, fixed.NETWORKING_WORDS), "NETWORKING")
        .otherwise("COMPUTE"),
        "is_production": ~F.coalesce(f.region.isin(fixed.NON_PRODUCTION_REGIONS), F.lit(False)),
    }


CLOUD = Parser("cloud", (_cloud_json, _cloud_checked, _cloud_region), _cloud)

# --- security ----------------------------------------------------------------------


def _security_matches(line: Line, f: Found) -> Columns:
    # an identity holds one of these, and the search is slow on long dotted tokens
    may_name = line.raw.contains("@") | line.raw.contains("\\")
    return {
        "user": F.when(may_name, text.first(line.raw, fixed.USER_IDENTITY, 1)),
        "outcome": F.upper(text.first(line.raw, fixed.AUTH_OUTCOME, 1, icase=True)),
        "failed": text.has_any(line.upper, fixed.FAILURE_WORDS),
    }


def _security(line: Line, f: Found) -> Columns:
    login = text.has_any(line.upper, fixed.AUTHENTICATION_WORDS)
    credential = text.has_any(line.upper, fixed.CREDENTIAL_WORDS)
    deletion = text.has_any(line.upper, fixed.DELETION_WORDS)
    return {
        "user": F.coalesce(f.user, F.lit("anonymous")),
        "outcome": F.coalesce(f.outcome, F.lit("UNKNOWN")),
        "is_failure": f.failed,
        "event_type": F.when(login, "AUTHENTICATION")
        .when(credential, "CREDENTIAL_MANAGEMENT")
        .when(deletion, "RESOURCE_DELETION")
        .otherwise("GENERAL_AUDIT"),
        "severity": F.when(login, F.when(f.failed, "HIGH").otherwise("INFO"))
        .when(credential, "MEDIUM")
        .when(deletion, "CRITICAL")
        .otherwise("INFO"),
        "vendor": F.when(line.upper.contains("OKTA"), "okta")
        .when(line.upper.contains("AD"), "active_directory")
        .otherwise("generic_security"),
    }


SECURITY = Parser("security", (_security_matches,), _security)

# --- system ------------------------------------------------------------------------


def _syslog_matches(line: Line, f: Found) -> Columns:
    # every header ends like this, and the search is slow on long dotted tokens
    may_have_header = line.raw.rlike(r"(?U)[\w.\[\]-]:\s")
    return {
        "header": F.when(may_have_header, text.first(line.raw, fixed.SYSLOG_HEADER)),
        "category": F.when(text.has_any(line.upper, fixed.MEMORY_WORDS), "MEMORY_CRITICAL")
        .when(
            line.upper.contains("DISK") & text.has_any(line.upper, ["FULL", "ERROR"]),
            "STORAGE_CRITICAL",
        )
        .when(text.has_any(line.upper, fixed.CRASH_WORDS), "APPLICATION_CRASH")
        .otherwise("GENERAL"),
    }


def _syslog_parts(line: Line, f: Found) -> Columns:
    # the header is known to start on a word boundary, so it is cut without one
    header = "^" + fixed.SYSLOG_HEADER.removeprefix(r"\b")
    return {
        "service": text.first(f.header, header, 1),
        "pid": text.first(f.header, header, 2),
    }


def _syslog(line: Line, f: Found) -> Columns:
    return {
        "system_service": F.coalesce(f.service, F.lit("kernel")),
        "pid": F.regexp_replace(f.pid, "^0+([0-9])", "$1"),  # text: it may be longer than any number type
        "is_os_internal": text.has_any(line.lower, fixed.OS_INTERNAL_WORDS),
        "event_category": f.category,
        "is_system_error": (f.category != "GENERAL") | line.upper.contains("ERROR"),
    }


SYSLOG = Parser("system", (_syslog_matches, _syslog_parts), _syslog)

# --- integrations --------------------------------------------------------------------

_INTEGRATION_KEYS = ["id", "event_id", "sid", "api_version", "version", "livemode"]


def _integration_json(line: Line, f: Found) -> Columns:
    return {"json": json.read_object(line.raw, _INTEGRATION_KEYS)}


def _integration_checked(line: Line, f: Found) -> Columns:
    return {"doc": json.whole_object(f.json)}


def _integration(line: Line, f: Found) -> Columns:
    d = f.doc
    stripe = text.has_any(line.lower, ["stripe", "ch_"])
    twilio = text.has_any(line.lower, ["twilio", "sms"])
    sendgrid = text.has_any(line.lower, ["sendgrid", "email"])
    live = (
        F.when(d.isNull(), False)
        .when(d["livemode"].isNull(), True)
        .when(~json.is_json_null(d["livemode"]), json.truthy(d["livemode"]))
    )
    return {
        "event_id": F.when(d.isNull(), "none").otherwise(
            F.coalesce(json.first_truthy(d["id"], d["event_id"]), json.text_of(d["sid"]))
        ),
        "api_version": F.when(d.isNull(), "unknown").otherwise(
            json.truthy_or_present(d["api_version"], d["version"], "v1")
        ),
        "is_live_mode": live,
        "vendor": F.when(stripe, "stripe")
        .when(twilio, "twilio")
        .when(sendgrid, "sendgrid")
        .otherwise("generic_webhook"),
        "business_impact": F.when(
            stripe,
            F.when(text.has_any(line.lower, ["charge.failed", "refund"]), "HIGH").otherwise("LOW"),
        )
        .when(
            twilio,
            F.when(text.has_any(line.lower, ["undelivered", "failed"]), "MEDIUM").otherwise("LOW"),
        )
        .otherwise("LOW"),
        "is_test_event": ~F.coalesce(live, F.lit(False)),
    }


INTEGRATION = Parser("integrations", (_integration_json, _integration_checked), _integration)

# --- iot -------------------------------------------------------------------------------


def _iot_matches(line: Line, f: Found) -> Columns:
    return {
        "device": text.first(line.raw, fixed.DEVICE_ID),
        "metric": text.first(line.raw, fixed.METRIC),
    }


def _iot_parts(line: Line, f: Found) -> Columns:
    return {
        "value": F.coalesce(text.first(f.metric, fixed.METRIC, 1).try_cast("double"), F.lit(0.0)),
        "unit": F.coalesce(text.first(f.metric, fixed.METRIC, 2), F.lit("raw")),
    }


def _iot(line: Line, f: Found) -> Columns:
    temperature = line.lower.contains("temp") | F.lower(f.unit).contains("c")
    humidity = line.lower.contains("hum") | f.unit.contains("%")
    power = line.lower.contains("volt") | F.lower(f.unit).contains("v")
    alert = F.when(temperature, f.value > fixed.OVERHEAT_ABOVE).when(
        ~humidity & power, f.value < fixed.LOW_POWER_BELOW
    )
    return {
        "device_id": F.coalesce(f.device, F.lit("unknown_sensor")),
        "value": f.value,
        "unit": f.unit,
        "sensor_type": F.when(temperature, "temperature")
        .when(humidity, "humidity")
        .when(power, "power")
        .otherwise("generic_sensor"),
        "status": F.when(alert, "CRITICAL").otherwise("OK"),
        "is_telemetry_valid": f.device.isNotNull(),
    }


IOT = Parser("iot", (_iot_matches, _iot_parts), _iot)

# --- custom ------------------------------------------------------------------------------


def _custom_matches(line: Line, f: Found) -> Columns:
    # one search of the line; each hit is then cut at its first '=' or ':'
    hits = text.every(line.raw, fixed.KEY_VALUE)
    return {
        "pairs": maps.sorted_pairs(
            F.transform(hits, lambda hit: F.split(hit, r"(?U)[=:]\s*", 2))
        ),
        "bracket": text.first(line.raw, fixed.BRACKETED, 1),
    }


def _custom_tags(line: Line, f: Found) -> Columns:
    tags = maps.last_wins(f.pairs)
    return {
        "tags": F.when(
            f.bracket.isNotNull(), maps.override(tags, {"context_tag": f.bracket})
        ).otherwise(tags)
    }


def _custom(line: Line, f: Found) -> Columns:
    return {
        "tags": f.tags,
        "is_internal": text.has_any(line.upper, fixed.INTERNAL_APP_WORDS),
        "parsed_via": F.lit("custom_fallback"),
        "quality_score": F.when(F.size(f.tags) > 0, "HIGH").otherwise("LOW"),
    }


def _custom_map(columns: Columns) -> Column:
    named = {k: v for k, v in columns.items() if k != "tags"}
    return maps.override(columns["tags"], named)


CUSTOM = Parser("custom", (_custom_matches, _custom_tags), _custom, attributes=_custom_map)

PARSERS = {
    p.family: p
    for p in (
        NETWORK, CONTAINER, DATABASE, WEB, CLOUD, SECURITY, SYSLOG, INTEGRATION, IOT, CUSTOM,
    )
}


def parse_network(df: DataFrame, col: str = "raw_payload") -> DataFrame:
    return parse_one(df, NETWORK, col)


def parse_container(
    df: DataFrame,
    col: str = "raw_payload",
    inner: Callable[[Column], Columns] | None = None,
    extras: bool = False,
) -> DataFrame:
    return parse_one(df, container_parser(inner, extras), col)


def parse_database(df: DataFrame, col: str = "raw_payload") -> DataFrame:
    return parse_one(df, DATABASE, col)


def parse_web(df: DataFrame, col: str = "raw_payload") -> DataFrame:
    return parse_one(df, WEB, col)


def parse_cloud(df: DataFrame, col: str = "raw_payload") -> DataFrame:
    return parse_one(df, CLOUD, col)


def parse_security(df: DataFrame, col: str = "raw_payload") -> DataFrame:
    return parse_one(df, SECURITY, col)


def parse_syslog(df: DataFrame, col: str = "raw_payload") -> DataFrame:
    return parse_one(df, SYSLOG, col)


def parse_integration(df: DataFrame, col: str = "raw_payload") -> DataFrame:
    return parse_one(df, INTEGRATION, col)


def parse_iot(df: DataFrame, col: str = "raw_payload") -> DataFrame:
    return parse_one(df, IOT, col)


def parse_custom(df: DataFrame, col: str = "raw_payload") -> DataFrame:
    return parse_one(df, CUSTOM, col)
