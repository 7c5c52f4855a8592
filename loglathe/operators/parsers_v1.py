"""The ten parser jobs of the v1 dialect.

Every job yields the same columns, so mixed families share one table:

``level``, ``message``, ``metadata`` (string map), ``attributes`` (string map,
only on a fallback row) and ``event_text`` (the line's own time, as text).
Blank lines and lines that break their parser become fallback rows with the
family's reason.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe import fixed
from loglathe.functions import ids, json, maps, text
from loglathe.operators.parsing import (
    Columns,
    Found,
    Line,
    Parser,
    current_line,
    found_by,
    run_stages,
    without_helpers,
)


def _no_map() -> Column:
    return F.lit(None).cast("map<string,string>")


def _result(
    level: Column,
    message: Column,
    metadata: Column,
    event_text: Column | None = None,
    attributes: Column | None = None,
) -> Columns:
    return {
        "level": level,
        "message": message,
        "metadata": metadata,
        "attributes": _no_map() if attributes is None else attributes,
        "event_text": F.lit(None).cast("string") if event_text is None else event_text,
    }


def _either(condition: Column, yes: Columns, no: Columns) -> Columns:
    return {k: F.when(condition, yes[k]).otherwise(no[k]) for k in yes}


def fallback(raw: Column, reason: Column) -> Columns:
    """Row that keeps the raw line together with the reason it was not parsed."""
    return _result(
        F.lit("ERROR"),
        F.coalesce(raw, F.lit("None")),
        _no_map(),
        attributes=maps.text_map({"error": reason, "raw_captured": F.lit("true")}),
    )


def _plain(line: Line, parser: str) -> Columns:
    return _result(F.lit("INFO"), line.raw, maps.text_map({"parser": F.lit(parser)}))


# --- networking --------------------------------------------------------------


def _network_pairs(line: Line, f: Found) -> Columns:
    hits = text.every(line.raw, fixed.V1_KEY_VALUE)
    kvp = "^" + fixed.V1_KEY_VALUE
    return {
        "pairs": maps.sorted_pairs(
            F.transform(
                hits, lambda hit: F.array(text.found(hit, kvp, 1), text.found(hit, kvp, 3))
            )
        )
    }


def _network_map(line: Line, f: Found) -> Columns:
    return {"kvp": maps.last_wins(f.pairs)}


def _network(line: Line, f: Found) -> Columns:
    def value(key: str) -> Column:
        return F.nullif(F.try_element_at(f.kvp, F.lit(key)), F.lit(""))

    priority = F.coalesce(value("level"), value("pri"), F.lit(fixed.V1_DEFAULT_PRIORITY))
    action = F.coalesce(F.try_element_at(f.kvp, F.lit("action")), F.lit("Unknown"))
    parsed = _result(
        text.priority_level(priority),
        F.coalesce(value("msg"), value("reason"), F.concat(F.lit("Network Event: "), action)),
        maps.override(
            f.kvp,
            {
                "parser": F.lit("network_kvp_v1"),
                "device_type": F.coalesce(
                    F.try_element_at(f.kvp, F.lit("devtype")), F.lit("generic_network")
                ),
            },
        ),
    )
    return _either(F.size(f.kvp) > 0, parsed, _plain(line, "generic_network_log"))


NETWORK = Parser("networking", (_network_pairs, _network_map), _network)

# --- containers ----------------------------------------------------------------


def _container_match(line: Line, f: Found) -> Columns:
    cri = "^" + fixed.V1_CRI_LINE
    return {
        "time": text.first(line.raw, cri, 1),
        "stream": text.first(line.raw, cri, 2),
        "flag": text.first(line.raw, cri, 3),
        "rest": text.found(line.raw, cri, 4),
    }


def _container(line: Line, f: Found) -> Columns:
    parsed = _result(
        F.when(f.stream == "stdout", "INFO").otherwise("ERROR"),
        f.rest,
        maps.text_map(
            {
                "stream": f.stream,
                "runtime_timestamp": f.time,
                "is_partial": f.flag == "P",
                "parser": F.lit("k8s_cri_v1"),
            }
        ),
        event_text=f.time,
    )
    return _either(f.stream.isNotNull(), parsed, _plain(line, "generic_container_log"))


CONTAINER = Parser("containers", (_container_match,), _container)

# --- storage ---------------------------------------------------------------------


def _database_match(line: Line, f: Found) -> Columns:
    return {
        "slow": text.first(line.raw, fixed.V1_SLOW_QUERY),
        "operation": F.upper(text.first(line.raw, fixed.V1_DB_OPERATION, 1, icase=True)),
    }


def _database_parts(line: Line, f: Found) -> Columns:
    return {
        "seconds": text.first(f.slow, fixed.V1_SLOW_QUERY, 1).try_cast("double"),
        "locked": text.first(f.slow, fixed.V1_SLOW_QUERY, 2).try_cast("double"),
    }


def _database(line: Line, f: Found) -> Columns:
    is_slow = f.seconds > fixed.V1_SLOW_QUERY_S
    return _result(
        F.when(text.has_any(line.lower, ["error", "fatal"]), "ERROR")
        .when(is_slow, "WARNING")
        .otherwise("INFO"),
        F.substring(line.raw, 1, fixed.V1_MESSAGE_CHARS),
        maps.present(
            maps.text_map(
                {
                    "parser": F.lit("database_v1"),
                    "query_duration_sec": f.seconds,
                    "lock_time_sec": f.locked,
                    "is_slow_query": is_slow,
                    "db_operation": f.operation,
                }
            )
        ),
    )


DATABASE = Parser("storage", (_database_match, _database_parts), _database)

# --- web -----------------------------------------------------------------------------


def _web_match(line: Line, f: Found) -> Columns:
    return {"access": text.first(line.raw, "^" + fixed.V1_ACCESS_LINE)}


def _web_parts(line: Line, f: Found) -> Columns:
    names = ["client", "time", "method", "path", "protocol", "status", "size"]
    return {
        name: text.found(f.access, "^" + fixed.V1_ACCESS_LINE, group)
        for group, name in enumerate(names, start=1)
    }


def _web(line: Line, f: Found) -> Columns:
    code = f.status.try_cast("bigint")
    parsed = _result(
        F.when(code < 400, "INFO").otherwise("ERROR"),
        F.concat_ws(" ", f.method, f.path),
        maps.text_map(
            {
                "client_ip": f.client,
                "http_status": code,
                "response_size_bytes": F.coalesce(f.size.try_cast("bigint").cast("string"), f.size),
                "protocol": f.protocol,
                "raw_timestamp": f.time,
                "parser": F.lit("web_server_combined"),
            }
        ),
        event_text=F.date_format(
            F.try_to_timestamp(f.time, F.lit(fixed.V1_ACCESS_TIME_FORMAT)),
            "yyyy-MM-dd HH:mm:ssXXX",
        ),
    )
    return _either(f.access.isNotNull(), parsed, _plain(line, "generic_app_log"))


WEB = Parser("web", (_web_match, _web_parts), _web)

# --- cloud ------------------------------------------------------------------------------

_CLOUD_KEYS = [
    "eventTime", "timestamp", "errorCode", "errorMessage", "severity", "eventName",
    "protoPayload", "awsRegion", "location", "sourceIPAddress", "requestMetadata",
    "userAgent", "recipientAccountId", "resource", "eventSource",
]


def _cloud_json(line: Line, f: Found) -> Columns:
    return {"json": json.read_object(line.raw, _CLOUD_KEYS, allow_nan=False)}


def _cloud_checked(line: Line, f: Found) -> Columns:
    return {"doc": json.whole_object(f.json)}


def _cloud_nested(line: Line, f: Found) -> Columns:
    return {"labels": json.child(f.doc["resource"], "$.labels")}


def _not_object(value: Column) -> Column:
    """A nested value that is present but cannot be read by key."""
    return value.isNotNull() & ~json.is_object(value)


def _cloud_error(line: Line, f: Found) -> Column:
    # a nested part is only read when the plain key before it has no value
    d = f.doc
    broken = (
        (~json.truthy(d["eventName"]) & _not_object(d["protoPayload"]))
        | (~json.truthy(d["sourceIPAddress"]) & _not_object(d["requestMetadata"]))
        | (
            ~json.truthy(d["recipientAccountId"])
            & (_not_object(d["resource"]) | _not_object(f.labels))
        )
    )
    return F.when(d.isNull() | broken, fixed.V1_REASONS["cloud"][1])


def _cloud(line: Line, f: Found) -> Columns:
    d = f.doc
    failed = (
        json.truthy(d["errorCode"])
        | json.truthy(d["errorMessage"])
        | (
            json.is_text(d["severity"])
            & F.coalesce(d["severity"].cast("string").isin(fixed.V1_CLOUD_SEVERITIES), F.lit(False))
        )
    )
    return _result(
        F.when(failed, "ERROR").otherwise("INFO"),
        F.coalesce(
            json.first_truthy(d["eventName"], json.child(d["protoPayload"], "$.methodName")),
            F.lit("Cloud Infrastructure Event"),
        ),
        maps.non_empty(
            maps.text_map(
                {
                    "cloud_region": json.first_truthy(d["awsRegion"], d["location"]),
                    "source_ip": json.first_truthy(
                        d["sourceIPAddress"], json.child(d["requestMetadata"], "$.callerIp")
                    ),
                    "user_agent": json.first_truthy(d["userAgent"]),
                    "account_id": json.first_truthy(
                        d["recipientAccountId"], json.child(f.labels, "$.project_id")
                    ),
                    "event_source": json.first_truthy(d["eventSource"]),
                    "parser": F.lit("cloud_v1"),
                }
            )
        ),
        event_text=json.first_truthy(d["eventTime"], d["timestamp"]),
    )


CLOUD = Parser("cloud", (_cloud_json, _cloud_checked, _cloud_nested), _cloud, _cloud_error)

# --- security ----------------------------------------------------------------------------


def _security_matches(line: Line, f: Found) -> Columns:
    return {
        "action": text.first(line.lower, fixed.V1_AUTH_ACTION, 1),
        "user": text.first(line.lower, fixed.V1_AUTH_USER, 1),
        "source_ip": text.first(line.lower, fixed.V1_AUTH_SOURCE_IP, 1),
        "port": text.first(line.lower, fixed.V1_AUTH_PORT, 1),
    }


def _security(line: Line, f: Found) -> Columns:
    return _result(
        F.when(text.has_any(line.lower, fixed.V1_SECURITY_ERROR_WORDS), "ERROR")
        .when(text.has_any(line.lower, fixed.V1_SECURITY_WARNING_WORDS), "WARNING")
        .otherwise("INFO"),
        line.raw,
        maps.present(
            maps.text_map(
                {
                    "parser": F.lit("security_v1"),
                    "action": f.action,
                    "user": f.user,
                    "source_ip": f.source_ip,
                    "port": f.port,
                    "is_security_event": F.lit("true"),
                    "event_type": F.when(f.user.isNotNull(), "authentication").otherwise(
                        "security_audit"
                    ),
                }
            )
        ),
    )


SECURITY = Parser("security", (_security_matches,), _security)

# --- system --------------------------------------------------------------------------------


def syslog_parser(rfc: bool = False) -> Parser:
    """RFC 3164 lines. ``rfc`` reads the severity as PRI mod 8 instead of the raw PRI."""

    def match(line: Line, f: Found) -> Columns:
        return {"header": text.first(line.raw, "^" + fixed.V1_SYSLOG_LINE)}

    def parts(line: Line, f: Found) -> Columns:
        names = {"priority": 1, "time": 2, "host": 3, "tag": 4, "body": 5}
        return {
            name: text.found(f.header, "^" + fixed.V1_SYSLOG_LINE, group)
            for name, group in names.items()
        }

    def outputs(line: Line, f: Found) -> Columns:
        number = f.priority.try_cast("int")
        priority = (number % 8).cast("string") if rfc else f.priority
        parsed = _result(
            text.priority_level(priority),
            f.body,
            maps.text_map(
                {"hostname": f.host, "tag": f.tag, "parser": F.lit("syslog_rfc3164")}
            ),
        )
        missing = F.coalesce(line.raw, F.lit("")) == ""
        unparsed = _result(
            F.lit("UNKNOWN"),
            F.coalesce(line.raw, F.lit("None")),
            maps.text_map(
                {
                    "parsing_error": F.when(missing, "invalid_input_type").otherwise(
                        "regex_mismatch"
                    ),
                    "raw_captured": F.lit("true"),
                }
            ),
        )
        return _either(f.header.isNotNull(), parsed, unparsed)

    return Parser("system", (match, parts), outputs)


SYSLOG = syslog_parser()

# --- integrations ---------------------------------------------------------------------------


def _integration_json(line: Line, f: Found) -> Columns:
    return {"json": json.read_document(line.raw)}


def _integration_checked(line: Line, f: Found) -> Columns:
    return {"doc": json.whole_document(f.json)}


def _integration_values(line: Line, f: Found) -> Columns:
    def key(name: str) -> Column:
        return json.child(f.doc, f"$.{name}")

    return {
        "type": key("type"),
        "event": key("event"),
        "sms": key("SmsStatus"),
        "id": key("id"),
        "data": key("data"),
        "object": json.child(f.doc, "$.data.object"),
        "sid": key("MessageSid"),
    }


def _integration_kind(line: Line, f: Found) -> Columns:
    chosen = F.coalesce(*[F.when(json.truthy(v), v) for v in (f.type, f.event, f.sms)])
    return {
        "name": F.coalesce(chosen.cast("string"), F.lit("external_api_call")),
        "text_name": chosen.isNull() | json.is_text(chosen),
    }


def _integration_error(line: Line, f: Found) -> Column:
    broken = ~json.truthy(f.id) & (_not_object(f.data) | _not_object(f.object))
    return F.when(
        f.doc.isNull() | broken | ~f.text_name, fixed.V1_REASONS["integrations"][1]
    )


def _integration(line: Line, f: Found) -> Columns:
    payload = F.to_json(f.doc)
    return _result(
        F.when(
            text.has_any(F.lower(f.name), fixed.V1_INTEGRATION_FAILURE_WORDS), "ERROR"
        ).otherwise("INFO"),
        F.concat(F.lit("ThirdParty Event: "), f.name),
        maps.text_map(
            {
                "external_id": F.coalesce(
                    json.first_truthy(f.id, json.child(f.object, "$.id"), f.sid), F.lit("unknown")
                ),
                "event_type": f.name,
                "payload_size": F.length(payload),
                "parser": F.lit("third_party_json_v1"),
                "full_payload": payload,
            }
        ),
    )


INTEGRATION = Parser(
    "integrations",
    (_integration_json, _integration_checked, _integration_values, _integration_kind),
    _integration,
    _integration_error,
)

# --- iot ---------------------------------------------------------------------------------------


def _telemetry_value(value: Column) -> Column:
    """Text of a number as Spark writes it. Only what looks like one is cast: a cast that fails raises inside, for every value."""
    whole = F.when(value.rlike("^[0-9]+$"), value.try_cast("bigint"))
    number = F.when(value.contains("."), _reading(value).cast("string")).otherwise(whole.cast("string"))
    return F.coalesce(number, value)


def _iot_pairs(line: Line, f: Found) -> Columns:
    hits = text.every(line.raw, fixed.V1_TELEMETRY)
    return {"pairs": maps.sorted_pairs(F.transform(hits, lambda hit: F.split(hit, "[:=]", 2)))}


def _iot_map(line: Line, f: Found) -> Columns:
    return {
        "telemetry": F.transform_values(maps.last_wins(f.pairs), lambda k, v: _telemetry_value(v))
    }


def _reading(value: Column) -> Column:
    """Number of digits and a dot; a cast alone would also take nan and infinity."""
    return F.when(value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), value.try_cast("double"))


def _iot_health(line: Line, f: Found) -> Columns:
    temp = F.try_element_at(f.telemetry, F.lit("temp"))
    return {
        "bad": F.coalesce(
            F.try_element_at(f.telemetry, F.lit("status")).isin(fixed.V1_BAD_DEVICE_STATUS),
            F.lit(False),
        ),
        "hot": F.coalesce(_reading(temp) > fixed.V1_OVERHEAT_ABOVE, F.lit(False)),
        "unreadable": temp.isNotNull() & _reading(temp).isNull(),
    }


def _iot_error(line: Line, f: Found) -> Column:
    return F.when(~f.bad & f.unreadable, fixed.V1_REASONS["iot"][1])


def _iot(line: Line, f: Found) -> Columns:
    device = F.coalesce(F.try_element_at(f.telemetry, F.lit("device_id")), F.lit("unknown_device"))
    return _result(
        F.when(f.bad | f.hot, "ERROR").otherwise("INFO"),
        F.concat(F.lit("Telemetry from "), device),
        maps.override(
            f.telemetry,
            {"parser": F.lit("iot_telemetry_v1"), "is_telemetry": F.lit("true")},
        ),
    )


IOT = Parser("iot", (_iot_pairs, _iot_map, _iot_health), _iot, _iot_error)

# --- custom ----------------------------------------------------------------------------------------


def _custom_json(line: Line, f: Found) -> Columns:
    return {"json": json.read_document(line.raw), "tags": text.every(line.raw, fixed.V1_APP_TAG, 1)}


def _custom_checked(line: Line, f: Found) -> Columns:
    return {"doc": json.whole_document(f.json)}


def _custom_entries(line: Line, f: Found) -> Columns:
    return {"entries": F.try_variant_get(f.doc, "$", "map<string,string>")}


def _custom(line: Line, f: Found) -> Columns:
    level = json.child(f.doc, "$.level")
    structured = _result(
        F.when(level.isNull(), "INFO")
        .when(json.is_json_null(level), "NONE")
        .otherwise(F.upper(level.cast("string"))),
        F.coalesce(
            json.first_truthy(json.child(f.doc, "$.message"), json.child(f.doc, "$.msg")),
            F.to_json(f.doc),
        ),
        maps.override(f.entries, {"parser": F.lit("custom_smart_v1")}),
        event_text=json.first_truthy(json.child(f.doc, "$.timestamp")),
    )
    plain = _result(
        F.when(text.has_any(line.upper, ["ERROR", "EXCEPTION"]), "ERROR")
        .when(line.upper.contains("WARN"), "WARNING")
        .otherwise("INFO"),
        line.raw,
        F.when(
            F.size(f.tags) > 0,
            maps.text_map({"parser": F.lit("custom_smart_v1"), "app_tags": F.to_json(f.tags)}),
        ).otherwise(maps.text_map({"parser": F.lit("custom_smart_v1")})),
    )
    return _either(f.doc.isNotNull(), structured, plain)


CUSTOM = Parser("custom", (_custom_json, _custom_checked, _custom_entries), _custom)

PARSERS = {
    p.family: p
    for p in (
        NETWORK, CONTAINER, DATABASE, WEB, CLOUD, SECURITY, SYSLOG, INTEGRATION, IOT, CUSTOM,
    )
}


def _guarded(parser: Parser, line: Line, found: Found) -> Columns:
    """Outputs with the blank and exception rows of the family folded in."""
    outputs = parser.outputs(line, found)
    if parser.family not in fixed.V1_REASONS:
        return outputs
    blank_reason, _ = fixed.V1_REASONS[parser.family]
    reason = F.when(~text.not_blank(line.raw), blank_reason)
    if parser.error:
        reason = F.coalesce(reason, parser.error(line, found))
    return _either(reason.isNotNull(), fallback(line.raw, reason), outputs)


def parse_lines(
    df: DataFrame,
    parsers: Mapping[str, Parser],
    family: Column | None,
    line_text: Column,
    now: dt.datetime | str | Column | None,
) -> DataFrame:
    """Add level, message, metadata, attributes, event_time and timestamp.

    ``timestamp`` is the ingest time, except where the line carries the time
    that its parser reports (cloud and structured custom lines).
    """
    staged = run_stages(df, line_text, parsers, family)
    line = current_line()
    chosen = None
    for name, parser in parsers.items():
        outputs = _guarded(parser, line, found_by(name))
        packed = F.struct(*[c.alias(n) for n, c in outputs.items()])
        if family is None:
            chosen = packed
        else:
            mine = family == name
            chosen = F.when(mine, packed) if chosen is None else chosen.when(mine, packed)
    staged = staged.withColumns({"__out": chosen})
    names = ["level", "message", "metadata", "attributes"]
    staged = staged.withColumns(
        {n: F.col(f"__out.{n}") for n in names}
        | {"__event_time": ids.event_time(F.col("__out.event_text"))}
    )
    ingest = ids.now_or(now)
    reports_time = F.col("__out.metadata")["parser"].isin("cloud_v1", "custom_smart_v1")
    staged = staged.withColumns(
        {
            "event_time": F.col("__event_time"),
            "timestamp": F.when(
                reports_time, F.coalesce(F.col("__event_time"), ingest)
            ).otherwise(ingest),
        }
    )
    return without_helpers(staged, df.columns)


def _parse_v1(df: DataFrame, parser: Parser, col: str, now) -> DataFrame:
    return parse_lines(df, {parser.family: parser}, None, F.col(col), now)


def parse_network_v1(df: DataFrame, col: str = "raw_payload", now=None) -> DataFrame:
    return _parse_v1(df, NETWORK, col, now)


def parse_container_v1(df: DataFrame, col: str = "raw_payload", now=None) -> DataFrame:
    return _parse_v1(df, CONTAINER, col, now)


def parse_database_v1(df: DataFrame, col: str = "raw_payload", now=None) -> DataFrame:
    return _parse_v1(df, DATABASE, col, now)


def parse_web_v1(df: DataFrame, col: str = "raw_payload", now=None) -> DataFrame:
    return _parse_v1(df, WEB, col, now)


def parse_cloud_v1(df: DataFrame, col: str = "raw_payload", now=None) -> DataFrame:
    return _parse_v1(df, CLOUD, col, now)


def parse_security_v1(df: DataFrame, col: str = "raw_payload", now=None) -> DataFrame:
    return _parse_v1(df, SECURITY, col, now)


def parse_syslog_v1(
    df: DataFrame, col: str = "raw_payload", now=None, rfc: bool = False
) -> DataFrame:
    return _parse_v1(df, syslog_parser(rfc), col, now)


def parse_integration_v1(df: DataFrame, col: str = "raw_payload", now=None) -> DataFrame:
    return _parse_v1(df, INTEGRATION, col, now)


def parse_iot_v1(df: DataFrame, col: str = "raw_payload", now=None) -> DataFrame:
    return _parse_v1(df, IOT, col, now)


def parse_custom_v1(df: DataFrame, col: str = "raw_payload", now=None) -> DataFrame:
    return _parse_v1(df, CUSTOM, col, now)
