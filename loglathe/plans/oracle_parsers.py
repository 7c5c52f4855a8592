"""Check SQL for the parser queries: one SELECT per family over ``lines(event_id, line)``.

Written in the check engine's own terms (RE2, its JSON functions, UNNEST), not
derived from the Column expressions it checks.
"""

from __future__ import annotations

from loglathe import fixed


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def icontains(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def rx(text: str, group: int = 0, column: str = "line", flags: str = "") -> str:
    tail = f", '{flags}'" if flags else ""
    return f"nullif(regexp_extract({column}, {lit(text)}, {group}{tail}), '')"


def j_text(key: str, doc: str = "d") -> str:
    path = lit(f"$.{key}")
    return f"(CASE WHEN json_type({doc}, {path}) <> 'NULL' THEN json_extract_string({doc}, {path}) END)"


def j_absent(key: str, doc: str = "d") -> str:
    return f"(json_type({doc}, {lit('$.' + key)}) IS NULL)"


def j_true(key: str, doc: str = "d") -> str:
    path = lit(f"$.{key}")
    return (
        f"coalesce(json_type({doc}, {path}) <> 'NULL' AND CAST(json_extract({doc}, {path}) AS VARCHAR)"
        " NOT IN ('\"\"', '0', 'false', '{}', '[]'), false)"
    )


def j_object(key: str, doc: str = "d") -> str:
    return f"coalesce(json_type({doc}, {lit('$.' + key)}) = 'OBJECT', false)"


_DOC = (
    "(SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS d"
    " FROM (SELECT *, TRY_CAST(line AS JSON) AS j FROM lines))"
)

V2_SQL: dict[str, str] = {}
V2_COLUMNS: dict[str, list[str]] = {}


def _v2(family: str, source: str, columns: dict[str, str]) -> None:
    listed = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    V2_SQL[family] = f"SELECT event_id, {listed} FROM {source}"
    V2_COLUMNS[family] = list(columns)


_v2(
    "networking",
    f"(SELECT *, upper(line) AS up, regexp_extract_all(line, {lit(fixed.IPV4)}) AS ips,"
    f" regexp_extract_all(line, {lit('(?i)' + fixed.PORT)}, 1) AS ports FROM lines)",
    {
        "nw_src_ip": "ips[1]",
        "nw_dst_ip": "ips[2]",
        "nw_src_port": "ports[1]",
        "nw_dst_port": "ports[2]",
        "nw_ip_count": "CAST(len(ips) AS VARCHAR)",
        "action": f"CASE WHEN {icontains('up', fixed.DENY_WORDS)} THEN 'DENY' ELSE 'ALLOW' END",
        "protocol": "CASE WHEN contains(up, 'TCP') THEN 'TCP' WHEN contains(up, 'UDP') THEN 'UDP'"
        " ELSE 'OTHER' END",
        "vendor_type": f"CASE WHEN {icontains('line', fixed.FIREWALL_MARKS)} THEN 'firewall'"
        " ELSE 'router' END",
    },
)

_v2(
    "containers",
    _DOC,
    {
        "container_id": j_text("container_id"),
        "namespace": f"CASE WHEN d IS NULL THEN NULL WHEN {j_absent('namespace')} THEN 'default'"
        f" ELSE {j_text('namespace')} END",
        "stream": f"CASE WHEN d IS NULL THEN NULL WHEN {j_absent('stream')} THEN 'stdout'"
        f" ELSE {j_text('stream')} END",
        "raw_content": f"CASE WHEN {j_true('log')} THEN {j_text('log')}"
        f" WHEN {j_true('message')} THEN {j_text('message')} ELSE line END",
        "is_json": "(d IS NOT NULL)",
        "parse_error": "CASE WHEN j IS NOT NULL AND d IS NULL THEN '''' || CASE json_type(j)"
        " WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool'"
        " WHEN 'NULL' THEN 'NoneType' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END"
        " || ''' object has no attribute ''get''' END",
    },
)

_LATENCY = fixed.DB_LATENCY
_v2(
    "storage",
    f"(SELECT *, coalesce(CAST({rx(_LATENCY, 1)} AS DOUBLE), 0.0) AS amount,"
    f" coalesce({rx(_LATENCY, 2)}, 'ms') AS u FROM lines)",
    {
        "operation": f"coalesce(upper({rx(fixed.DB_ACTION, 1, flags='i')}), 'UNKNOWN')",
        "duration": "amount",
        "unit": "u",
        "is_slow_query": "((u = 'ms' AND amount > 100.0) OR (u = 's' AND amount > 0.1))",
        "db_family": f"CASE WHEN {icontains('lower(line)', fixed.RDBMS_WORDS)} THEN 'rdbms'"
        " ELSE 'nosql' END",
    },
)

_v2(
    "web",
    f"(SELECT *, coalesce({rx(fixed.HTTP_REQUEST, 2, flags='i')}, '/') AS p,"
    f" coalesce(CAST({rx(fixed.HTTP_STATUS, 1)} AS INTEGER), 0) AS c FROM lines)",
    {
        "method": f"coalesce(upper({rx(fixed.HTTP_REQUEST, 1, flags='i')}), 'UNKNOWN')",
        "path": "p",
        "status_code": "c",
        "response_category": "CASE WHEN c BETWEEN 400 AND 499 THEN 'CLIENT_ERROR'"
        " WHEN c >= 500 THEN 'SERVER_ERROR' WHEN c = 0 THEN 'MALFORMED' ELSE 'SUCCESS' END",
        "request_type": r"CASE WHEN regexp_matches(lower(p),"
        r" '[^/.][^/]*\.(js|css|png|jpg|ico|svg|woff2)$') THEN 'STATIC_ASSET' ELSE 'API_CALL' END",
        "is_error": "(c >= 400)",
    },
)


def _cloud_value(first: str, second: str, default: str, not_json: str) -> str:
    return (
        f"(CASE WHEN d IS NULL THEN '{not_json}' WHEN {j_true(first)} THEN {j_text(first)}"
        f" WHEN {j_absent(second)} THEN '{default}' ELSE {j_text(second)} END)"
    )


_REGION = _cloud_value("region", "aws_region", "global", "global")
_v2(
    "cloud",
    f"(SELECT *, upper(line) AS up FROM {_DOC})",
    {
        "provider": _cloud_value("provider", "cloud_provider", "unknown", "unknown"),
        "region": _REGION,
        "account_id": _cloud_value("account_id", "owner", "internal", "none"),
        "resource_id": _cloud_value("resource_id", "arn", "unassigned", "raw_stream"),
        "cloud_service": f"CASE WHEN {icontains('up', fixed.SERVERLESS_WORDS)} THEN 'SERVERLESS'"
        f" WHEN {icontains('up', fixed.STORAGE_WORDS)} THEN 'STORAGE'"
        f" WHEN {icontains('up', fixed.NETWORKING_WORDS)} THEN 'NETWORKING' ELSE 'COMPUTE' END",
        "is_production": f"coalesce({_REGION} NOT IN ('us-east-1-test', 'dev-region'), true)",
    },
)

_v2(
    "security",
    f"(SELECT *, upper(line) AS up, {icontains('upper(line)', fixed.FAILURE_WORDS)} AS bad FROM lines)",
    {
        '"user"': f"coalesce({rx(fixed.USER_IDENTITY, 1)}, 'anonymous')",
        "outcome": f"coalesce(upper({rx(fixed.AUTH_OUTCOME, 1, flags='i')}), 'UNKNOWN')",
        "is_failure": "bad",
        "event_type": "CASE WHEN up LIKE '%LOGIN%' OR up LIKE '%AUTH%' THEN 'AUTHENTICATION'"
        " WHEN up LIKE '%PASSWORD%' OR up LIKE '%RESET%' THEN 'CREDENTIAL_MANAGEMENT'"
        " WHEN up LIKE '%DELETE%' OR up LIKE '%REMOVE%' THEN 'RESOURCE_DELETION'"
        " ELSE 'GENERAL_AUDIT' END",
        "severity": "CASE WHEN up LIKE '%LOGIN%' OR up LIKE '%AUTH%'"
        " THEN CASE WHEN bad THEN 'HIGH' ELSE 'INFO' END"
        " WHEN up LIKE '%PASSWORD%' OR up LIKE '%RESET%' THEN 'MEDIUM'"
        " WHEN up LIKE '%DELETE%' OR up LIKE '%REMOVE%' THEN 'CRITICAL' ELSE 'INFO' END",
        "vendor": "CASE WHEN up LIKE '%OKTA%' THEN 'okta' WHEN up LIKE '%AD%'"
        " THEN 'active_directory' ELSE 'generic_security' END",
    },
)

_v2(
    "system",
    "(SELECT *, CASE WHEN up LIKE '%OOM-KILLER%' OR up LIKE '%OUT OF MEMORY%'"
    " THEN 'MEMORY_CRITICAL' WHEN up LIKE '%DISK%' AND (up LIKE '%FULL%' OR up LIKE '%ERROR%')"
    " THEN 'STORAGE_CRITICAL' WHEN up LIKE '%SEGFAULT%' OR up LIKE '%STACK TRACE%'"
    " THEN 'APPLICATION_CRASH' ELSE 'GENERAL' END AS category"
    " FROM (SELECT *, upper(line) AS up FROM lines))",
    {
        "system_service": f"coalesce({rx(fixed.SYSLOG_HEADER, 1)}, 'kernel')",
        "pid": f"nullif(regexp_replace({rx(fixed.SYSLOG_HEADER, 2)}, '^0+([0-9])', '\\1'), '')",
        "is_os_internal": "(lower(line) LIKE '%kernel%' OR lower(line) LIKE '%systemd%')",
        "event_category": "category",
        "is_system_error": "(category <> 'GENERAL' OR up LIKE '%ERROR%')",
    },
)

_LIVE = (
    f"(CASE WHEN d IS NULL THEN false WHEN {j_absent('livemode')} THEN true"
    f" WHEN json_type(d, '$.livemode') = 'NULL' THEN NULL ELSE {j_true('livemode')} END)"
)
_STRIPE = "(lo LIKE '%stripe%' OR contains(lo, 'ch_'))"
_TWILIO = "(lo LIKE '%twilio%' OR lo LIKE '%sms%')"
_v2(
    "integrations",
    f"(SELECT *, lower(line) AS lo FROM {_DOC})",
    {
        "vendor_event_id": f"CASE WHEN d IS NULL THEN 'none' WHEN {j_true('id')} THEN {j_text('id')}"
        f" WHEN {j_true('event_id')} THEN {j_text('event_id')} ELSE {j_text('sid')} END",
        "api_version": f"CASE WHEN d IS NULL THEN 'unknown' WHEN {j_true('api_version')}"
        f" THEN {j_text('api_version')} WHEN {j_absent('version')} THEN 'v1'"
        f" ELSE {j_text('version')} END",
        "is_live_mode": f"CAST({_LIVE} AS VARCHAR)",
        "vendor": f"CASE WHEN {_STRIPE} THEN 'stripe' WHEN {_TWILIO} THEN 'twilio'"
        " WHEN lo LIKE '%sendgrid%' OR lo LIKE '%email%' THEN 'sendgrid'"
        " ELSE 'generic_webhook' END",
        "business_impact": f"CASE WHEN {_STRIPE} THEN CASE WHEN contains(lo, 'charge.failed')"
        " OR contains(lo, 'refund') THEN 'HIGH' ELSE 'LOW' END"
        f" WHEN {_TWILIO} AND (contains(lo, 'undelivered') OR contains(lo, 'failed'))"
        " THEN 'MEDIUM' ELSE 'LOW' END",
        "is_test_event": f"NOT coalesce({_LIVE}, false)",
    },
)

_v2(
    "iot",
    f"(SELECT *, lower(line) AS lo, {rx(fixed.DEVICE_ID)} AS device,"
    f" coalesce(CAST({rx(fixed.METRIC, 1)} AS DOUBLE), 0.0) AS reading,"
    f" coalesce({rx(fixed.METRIC, 2)}, 'raw') AS u FROM lines)",
    {
        "device_id": "coalesce(device, 'unknown_sensor')",
        "value": "reading",
        "unit": "u",
        "sensor_type": "CASE WHEN contains(lo, 'temp') OR contains(lower(u), 'c') THEN 'temperature'"
        " WHEN contains(lo, 'hum') OR contains(u, '%') THEN 'humidity'"
        " WHEN contains(lo, 'volt') OR contains(lower(u), 'v') THEN 'power'"
        " ELSE 'generic_sensor' END",
        "status": "CASE WHEN contains(lo, 'temp') OR contains(lower(u), 'c')"
        " THEN CASE WHEN reading > 50.0 THEN 'CRITICAL' ELSE 'OK' END"
        " WHEN contains(lo, 'hum') OR contains(u, '%') THEN 'OK'"
        " WHEN (contains(lo, 'volt') OR contains(lower(u), 'v')) AND reading < 5.0"
        " THEN 'CRITICAL' ELSE 'OK' END",
        "is_telemetry_valid": "(device IS NOT NULL)",
    },
)

# custom: groups 1..4 of every hit side by side; the last value of a key counts
_KV = lit(fixed.KEY_VALUE)
_CUSTOM_TAGS = (
    "(SELECT event_id, any_value(line) AS line, any_value(bracket) AS bracket,"
    " list(k || '=' || v) FILTER (WHERE k IS NOT NULL) AS tags,"
    " list(k) FILTER (WHERE k IS NOT NULL) AS keys FROM ("
    "SELECT event_id, k, any_value(line) AS line, any_value(bracket) AS bracket,"
    " CASE WHEN k = 'context_tag' AND any_value(bracket) IS NOT NULL THEN any_value(bracket)"
    " ELSE arg_max(v, pos) END AS v FROM ("
    " SELECT event_id, line, bracket, pos, lower(CASE WHEN k1[pos] <> '' THEN k1[pos] ELSE k3[pos] END) AS k,"
    " CASE WHEN k1[pos] <> '' THEN k2[pos] ELSE k4[pos] END AS v FROM ("
    f" SELECT event_id, line, {rx(fixed.BRACKETED, 1)} AS bracket,"
    f" regexp_extract_all(line, {_KV}, 1) AS k1, regexp_extract_all(line, {_KV}, 2) AS k2,"
    f" regexp_extract_all(line, {_KV}, 3) AS k3, regexp_extract_all(line, {_KV}, 4) AS k4,"
    f" unnest(CASE WHEN len(regexp_extract_all(line, {_KV}, 1)) = 0 THEN [1]"
    f" ELSE range(1, len(regexp_extract_all(line, {_KV}, 1)) + 1) END) AS pos FROM lines))"
    " GROUP BY event_id, k) GROUP BY event_id)"
)
_TAG_LIST = (
    "(coalesce(tags, []) || CASE WHEN bracket IS NOT NULL AND NOT"
    " coalesce(list_contains(keys, 'context_tag'), false)"
    " THEN ['context_tag=' || bracket] ELSE [] END)"
)
_v2(
    "custom",
    _CUSTOM_TAGS,
    {
        "tags": f"array_to_string(list_sort({_TAG_LIST}), '|')",
        "is_internal": "(upper(line) LIKE '%APP\\_INTERNAL%' ESCAPE '\\' OR upper(line) LIKE"
        " '%PY\\_LOG%' ESCAPE '\\')",
        "parsed_via": "'custom_fallback'",
        "quality_score": f"CASE WHEN len({_TAG_LIST}) > 0 THEN 'HIGH' ELSE 'LOW' END",
    },
)


def joined(columns: list[str], names: list[str] | None = None) -> str:
    pairs = [
        f"'{n}=' || coalesce(CAST({c} AS VARCHAR), '<null>')"
        for c, n in zip(columns, names or [c.strip('"') for c in columns])
    ]
    return f"array_to_string(list_sort([{', '.join(pairs)}]), '|')"


def v2_attributes(family: str) -> str:
    """SELECT event_id, attributes text and parse error of one family over ``lines``."""
    columns = V2_COLUMNS[family]
    none = "CAST(NULL AS VARCHAR)"
    inner = V2_SQL[family]
    if family == "containers":
        full = joined(["container_id", "namespace", "stream", "raw_content"])
        text = f"CASE WHEN parse_error IS NULL THEN CASE WHEN is_json THEN {full} ELSE {joined(['raw_content'])} END END"
        return f"SELECT event_id, {text} AS attributes, parse_error FROM ({inner})"
    if family == "integrations":
        names = ["event_id" if c == "vendor_event_id" else c for c in columns]
        return f"SELECT event_id, {joined(columns, names)} AS attributes, {none} AS parse_error FROM ({inner})"
    if family == "custom":
        fixed_names = ["is_internal", "parsed_via", "quality_score"]
        kept = (
            f"list_filter({_TAG_LIST}, lambda t: split_part(t, '=', 1) NOT IN"
            " ('is_internal', 'parsed_via', 'quality_score'))"
        )
        own = ", ".join(
            f"'{c}=' || CAST({V2_EXPR_CUSTOM[c]} AS VARCHAR)" for c in fixed_names
        )
        text = f"array_to_string(list_sort({kept} || [{own}]), '|')"
        return f"SELECT event_id, {text} AS attributes, {none} AS parse_error FROM {_CUSTOM_TAGS}"
    return f"SELECT event_id, {joined(columns)} AS attributes, {none} AS parse_error FROM ({inner})"


V2_EXPR_CUSTOM = {
    "is_internal": "(contains(upper(line), 'APP_INTERNAL') OR contains(upper(line), 'PY_LOG'))",
    "parsed_via": "'custom_fallback'",
    "quality_score": f"CASE WHEN len({_TAG_LIST}) > 0 THEN 'HIGH' ELSE 'LOW' END",
}

# --- v1: level, message, metadata text, error -----------------------------------

V1_SQL: dict[str, str] = {}


def _v1(family: str, source: str, level: str, message: str, meta: str, error: str = "NULL") -> None:
    """``meta`` is a list of 'key=value' texts."""
    blank, _ = fixed.V1_REASONS.get(family, (None, None))
    reason = f"CAST({error} AS VARCHAR)"
    if blank:
        reason = f"CASE WHEN trim(line) = '' THEN '{blank}' ELSE {reason} END"
    V1_SQL[family] = (
        f"SELECT event_id, CASE WHEN e IS NOT NULL THEN 'ERROR' ELSE lv END AS level,"
        " CASE WHEN e IS NOT NULL THEN line ELSE ms END AS message,"
        " CASE WHEN e IS NULL THEN array_to_string(list_sort(mt), '|') END AS metadata, e AS error"
        f" FROM (SELECT event_id, line, {reason} AS e, {level} AS lv, {message} AS ms, {meta} AS mt"
        f" FROM {source})"
    )


def pri_level(column: str) -> str:
    number = f"TRY_CAST({column} AS INTEGER)"
    return f"CASE WHEN {number} <= 3 THEN 'ERROR' WHEN {number} = 4 THEN 'WARNING' ELSE 'INFO' END"


# RE2 has no backreference: one alternative per quoting
_KV1 = lit(r"""(\w+)=(?:"(.*?)"(?:,|\s|$)|'(.*?)'(?:,|\s|$)|(.*?)(?:,|\s|$))""")
_KV1_MAP = (
    "(SELECT event_id, any_value(line) AS line, map_from_entries(list((k, v)) FILTER"
    " (WHERE k IS NOT NULL AND k <> '')) AS kv FROM (SELECT event_id, lower(k0) AS k,"
    " any_value(line) AS line, arg_max(v0, pos) AS v FROM (SELECT event_id, line, pos,"
    " kk[pos] AS k0, coalesce(a[pos], '') || coalesce(b[pos], '') || coalesce(c[pos], '') AS v0 FROM (SELECT event_id, line,"
    f" regexp_extract_all(line, {_KV1}, 1) AS kk, regexp_extract_all(line, {_KV1}, 2) AS a,"
    f" regexp_extract_all(line, {_KV1}, 3) AS b, regexp_extract_all(line, {_KV1}, 4) AS c,"
    f" unnest(CASE WHEN len(regexp_extract_all(line, {_KV1}, 1)) = 0 THEN [1]"
    f" ELSE range(1, len(regexp_extract_all(line, {_KV1}, 1)) + 1) END) AS pos FROM lines))"
    " GROUP BY event_id, lower(k0)) GROUP BY event_id)"
)


def _kv(key: str) -> str:
    return f"nullif(kv['{key}'], '')"


_v1(
    "networking",
    _KV1_MAP,
    "CASE WHEN kv IS NULL THEN 'INFO' ELSE "
    + pri_level(f"coalesce({_kv('level')}, {_kv('pri')}, '6')")
    + " END",
    f"CASE WHEN kv IS NULL THEN line ELSE coalesce({_kv('msg')}, {_kv('reason')},"
    " 'Network Event: ' || coalesce(kv['action'], 'Unknown')) END",
    "CASE WHEN kv IS NULL THEN ['parser=generic_network_log'] ELSE"
    " list_transform(list_filter(map_entries(kv), lambda e: e.key NOT IN ('parser', 'device_type')),"
    " lambda e: e.key || '=' || e.value) || ['parser=network_kvp_v1',"
    " 'device_type=' || coalesce(kv['devtype'], 'generic_network')] END",
)

_CRI = r"^(\S+)\s+(stdout|stderr)\s+(\S+)\s+(.*)"
_v1(
    "containers",
    f"(SELECT *, {rx(_CRI, 1)} AS t, {rx(_CRI, 2)} AS st, {rx(_CRI, 3)} AS fl,"
    f" regexp_extract(line, {lit(_CRI)}, 4) AS rest FROM lines)",
    "CASE WHEN st = 'stderr' THEN 'ERROR' ELSE 'INFO' END",
    "CASE WHEN st IS NULL THEN line ELSE rest END",
    "CASE WHEN st IS NULL THEN ['parser=generic_container_log'] ELSE ['stream=' || st,"
    " 'runtime_timestamp=' || t, 'is_partial=' || CAST(fl = 'P' AS VARCHAR),"
    " 'parser=k8s_cri_v1'] END",
)

_SLOW = fixed.V1_SLOW_QUERY
_v1(
    "storage",
    f"(SELECT *, CAST({rx(_SLOW, 1)} AS DOUBLE) AS sec, CAST({rx(_SLOW, 2)} AS DOUBLE) AS lk,"
    f" upper({rx(fixed.V1_DB_OPERATION, 1, flags='i')}) AS op FROM lines)",
    "CASE WHEN lower(line) LIKE '%error%' OR lower(line) LIKE '%fatal%' THEN 'ERROR'"
    " WHEN sec > 1.0 THEN 'WARNING' ELSE 'INFO' END",
    "left(line, 500)",
    "['parser=database_v1'] || CASE WHEN sec IS NULL THEN [] ELSE"
    " ['query_duration_sec=' || CAST(sec AS VARCHAR), 'lock_time_sec=' || CAST(lk AS VARCHAR),"
    " 'is_slow_query=' || CAST(sec > 1.0 AS VARCHAR)] END"
    " || CASE WHEN op IS NULL THEN [] ELSE ['db_operation=' || op] END",
)

_ACC = "^" + fixed.V1_ACCESS_LINE
_v1(
    "web",
    "(SELECT *, "
    + ", ".join(
        f"regexp_extract(line, {lit(_ACC)}, {i}) AS g{i}" for i in range(1, 8)
    )
    + " FROM lines)",
    "CASE WHEN g1 <> '' AND CAST(g6 AS BIGINT) >= 400 THEN 'ERROR' ELSE 'INFO' END",
    "CASE WHEN g1 = '' THEN line ELSE g3 || ' ' || g4 END",
    "CASE WHEN g1 = '' THEN ['parser=generic_app_log'] ELSE ['client_ip=' || g1,"
    " 'http_status=' || CAST(CAST(g6 AS BIGINT) AS VARCHAR),"
    " 'response_size_bytes=' || CAST(CAST(g7 AS BIGINT) AS VARCHAR), 'protocol=' || g5,"
    " 'raw_timestamp=' || g2, 'parser=web_server_combined'] END",
)


def _broken(flag_key: str, *nested: str) -> str:
    bad = " OR ".join(
        f"(NOT {j_absent(n)} AND NOT {j_object(n)})" for n in nested
    )
    return f"(NOT {j_true(flag_key)} AND ({bad}))"


def _opt(name: str, value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN [] ELSE ['{name}=' || {value}] END"


def _first_true(*keys: str) -> str:
    arms = " ".join(f"WHEN {j_true(k)} THEN {j_text(k)}" for k in keys)
    return f"(CASE {arms} END)"


_v1(
    "cloud",
    _DOC,
    f"CASE WHEN {j_true('errorCode')} OR {j_true('errorMessage')} OR"
    " coalesce(json_extract_string(d, '$.severity') IN ('ERROR', 'CRITICAL', 'ALERT'), false)"
    " THEN 'ERROR' ELSE 'INFO' END",
    f"coalesce({_first_true('eventName', 'protoPayload.methodName')}, 'Cloud Infrastructure Event')",
    " || ".join(
        [
            _opt("cloud_region", _first_true("awsRegion", "location")),
            _opt("source_ip", _first_true("sourceIPAddress", "requestMetadata.callerIp")),
            _opt("user_agent", _first_true("userAgent")),
            _opt("account_id", _first_true("recipientAccountId", "resource.labels.project_id")),
            _opt("event_source", _first_true("eventSource")),
            "['parser=cloud_v1']",
        ]
    ),
    f"CASE WHEN d IS NULL OR {_broken('eventName', 'protoPayload')}"
    f" OR {_broken('sourceIPAddress', 'requestMetadata')}"
    f" OR {_broken('recipientAccountId', 'resource', 'resource.labels')}"
    " THEN 'cloud_json_parse_fail' END",
)

_v1(
    "security",
    "(SELECT *, "
    + ", ".join(
        f"{rx(p, 1, 'lower(line)')} AS {n}"
        for n, p in [
            ("ac", fixed.V1_AUTH_ACTION),
            ("us", fixed.V1_AUTH_USER),
            ("ip", fixed.V1_AUTH_SOURCE_IP),
            ("po", fixed.V1_AUTH_PORT),
        ]
    )
    + " FROM lines)",
    f"CASE WHEN {icontains('lower(line)', fixed.V1_SECURITY_ERROR_WORDS)} THEN 'ERROR'"
    f" WHEN {icontains('lower(line)', fixed.V1_SECURITY_WARNING_WORDS)} THEN 'WARNING'"
    " ELSE 'INFO' END",
    "line",
    "['parser=security_v1', 'is_security_event=true', 'event_type=' || CASE WHEN us IS NULL THEN"
    " 'security_audit' ELSE 'authentication' END] || "
    + " || ".join(
        _opt(n, c) for n, c in [("action", "ac"), ("user", "us"), ("source_ip", "ip"), ("port", "po")]
    ),
)

_SYS = "^" + fixed.V1_SYSLOG_LINE
_v1(
    "system",
    "(SELECT *, " + ", ".join(
        f"regexp_extract(line, {lit(_SYS)}, {i}) AS g{i}" for i in range(1, 6)
    ) + " FROM lines)",
    f"CASE WHEN g1 = '' THEN 'UNKNOWN' ELSE {pri_level('g1')} END",
    "CASE WHEN g1 = '' THEN line ELSE g5 END",
    "CASE WHEN g1 = '' THEN ['raw_captured=true', 'parsing_error=' || CASE WHEN line = ''"
    " THEN 'invalid_input_type' ELSE 'regex_mismatch' END] ELSE ['hostname=' || g3,"
    " 'tag=' || g4, 'parser=syslog_rfc3164'] END",
)

_NAME = (
    "(CASE " + " ".join(
        f"WHEN {j_true(k)} THEN {j_text(k)}" for k in ("type", "event", "SmsStatus")
    ) + " ELSE 'external_api_call' END)"
)
_NAME_KIND = (
    "(CASE " + " ".join(
        f"WHEN {j_true(k)} THEN json_type(d, '$.{k}') = 'VARCHAR'" for k in ("type", "event", "SmsStatus")
    ) + " ELSE true END)"
)
# payload members are shown in key order
_SORTED = (
    "('{' || array_to_string(list_transform(list_sort(json_keys(d)), lambda k: '\"' || k || '\":' ||"
    " CAST(json_extract(d, '$.' || k) AS VARCHAR)), ',') || '}')"
)
_v1(
    "integrations",
    _DOC,
    f"CASE WHEN {icontains(f'lower({_NAME})', fixed.V1_INTEGRATION_FAILURE_WORDS)} THEN 'ERROR'"
    " ELSE 'INFO' END",
    f"'ThirdParty Event: ' || {_NAME}",
    "['external_id=' || coalesce(" + _first_true("id", "data.object.id", "MessageSid")
    + f", 'unknown'), 'event_type=' || {_NAME}, 'payload_size=' || CAST(length({_SORTED}) AS VARCHAR),"
    f" 'parser=third_party_json_v1', 'full_payload=' || {_SORTED}]",
    f"CASE WHEN d IS NULL OR {_broken('id', 'data', 'data.object')} OR NOT {_NAME_KIND}"
    " THEN 'webhook_parse_exception' END",
)

_TEL = lit(fixed.V1_TELEMETRY)
_TEL_VALUE = (
    "CASE WHEN contains(v0, '.') THEN coalesce(CAST(TRY_CAST(v0 AS DOUBLE) AS VARCHAR), v0)"
    " ELSE coalesce(CAST(TRY_CAST(v0 AS BIGINT) AS VARCHAR), v0) END"
)
_TEL_MAP = (
    "(SELECT event_id, any_value(line) AS line, map_from_entries(list((k, v)) FILTER"
    " (WHERE k IS NOT NULL AND k <> '')) AS kv FROM (SELECT event_id, lower(k0) AS k,"
    f" any_value(line) AS line, arg_max({_TEL_VALUE}, pos) AS v FROM (SELECT event_id, line, pos,"
    " kk[pos] AS k0, vv[pos] AS v0 FROM (SELECT event_id, line,"
    f" regexp_extract_all(line, {_TEL}, 1) AS kk, regexp_extract_all(line, {_TEL}, 2) AS vv,"
    f" unnest(CASE WHEN len(regexp_extract_all(line, {_TEL}, 1)) = 0 THEN [1]"
    f" ELSE range(1, len(regexp_extract_all(line, {_TEL}, 1)) + 1) END) AS pos FROM lines))"
    " GROUP BY event_id, lower(k0)) GROUP BY event_id)"
)
_BAD = "coalesce(kv['status'] IN ('CRIT', 'ERR', 'LOW_BATT'), false)"
_v1(
    "iot",
    _TEL_MAP,
    f"CASE WHEN {_BAD} OR coalesce(TRY_CAST(kv['temp'] AS DOUBLE) > 80, false) THEN 'ERROR'"
    " ELSE 'INFO' END",
    "'Telemetry from ' || coalesce(kv['device_id'], 'unknown_device')",
    "coalesce(list_transform(list_filter(map_entries(kv), lambda e: e.key NOT IN ('parser',"
    " 'is_telemetry')), lambda e: e.key || '=' || e.value), [])"
    " || ['parser=iot_telemetry_v1', 'is_telemetry=true']",
    f"CASE WHEN NOT {_BAD} AND kv['temp'] IS NOT NULL AND TRY_CAST(kv['temp'] AS DOUBLE) IS NULL"
    " THEN 'iot_parse_exception' END",
)

_v1(
    "custom",
    f"(SELECT *, regexp_extract_all(line, {lit(fixed.V1_APP_TAG)}, 1) AS tg FROM {_DOC})",
    "CASE WHEN d IS NOT NULL THEN CASE"
    f" WHEN {j_absent('level')} THEN 'INFO' WHEN json_type(d, '$.level') = 'NULL' THEN 'NONE'"
    f" ELSE upper({j_text('level')}) END WHEN upper(line) LIKE '%ERROR%' OR upper(line) LIKE"
    " '%EXCEPTION%' THEN 'ERROR' WHEN upper(line) LIKE '%WARN%' THEN 'WARNING' ELSE 'INFO' END",
    f"CASE WHEN d IS NULL THEN line ELSE coalesce({_first_true('message', 'msg')}, {_SORTED}) END",
    "CASE WHEN d IS NOT NULL THEN list_transform(list_filter(json_keys(d), lambda k: k <> 'parser'),"
    " lambda k: k || '=' || coalesce(CASE WHEN json_type(d, '$.' || k) <> 'NULL' THEN"
    " json_extract_string(d, '$.' || k) END, '<null>')) || ['parser=custom_smart_v1']"
    " WHEN len(tg) > 0 THEN ['parser=custom_smart_v1', 'app_tags=' || CAST(to_json(tg) AS VARCHAR)]"
    " ELSE ['parser=custom_smart_v1'] END",
)
