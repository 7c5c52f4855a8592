"""Log lines derived from the columns of the ``events`` table.

Each line is one SQL expression that Spark and a SQL check engine both read the
same way (``||``, CASE, CAST; ASCII only, no backslashes), so a query and its
check start from identical text for every row of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe import session


def s(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


E = s("event_id")
U = s("user_id")
V = s("value")
K = "regexp_extract(props, '([0-9]+)', 1)"


def pick(number: str, *choices: str) -> str:
    """CASE over ``number`` modulo the count of choices."""
    arms = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices))
    return f"(CASE {number} % {len(choices)} {arms} END)"


def q(text: str) -> str:
    return f"'{text}'"


NETWORK = (
    "CASE WHEN event_id % 10 = 0 THEN 'link state change, port ' || "
    + K
    + " ELSE "
    + pick("event_id", "'%ASA-4: '", "'FG100 '", "'edge '", "'core rtr '")
    + " || "
    + pick("event_id", "'drop '", "'permit '", "'Block '")
    + " || "
    + pick("user_id", "'TCP'", "'udp'", "'ICMP'", "'TCP over UDP'")
    + f" || ' from 10.0.' || {s('user_id % 256')} || '.' || {s('event_id % 256')}"
    + f" || ':' || {s('1024 + event_id % 5000')} || ' to 192.168.1.' || {K}"
    + " || "
    + pick("event_id", "' port 443'", "' PORT 8080'", "''", "' host:99999 '", "' port 123456'")
    + " END"
)

NETWORK_V1 = (
    "CASE event_id % 8 WHEN 0 THEN 'link up on eth' || " + K
    + f" ELSE 'devname=FG-' || {U} || ' level=' || {s('event_id % 9')} || "
    + pick("event_id", "' msg=\"' || event_type || ' seen\"'", "' reason=' || event_type",
           "' action=deny'", "' msg=\"\" pri=3'", "', Level=x'")
    + f" || ' srcip=10.0.0.' || {K} || "
    + pick("user_id", "''", "' devtype=\"fire wall\"'", "' srcip=10.9.9.9'")
    + " END"
)

WEB = (
    f"'10.0.0.' || {U} || ' - - [04/Apr/2026:15:14:57 +0000] \"' || "
    + pick("event_id", "'GET'", "'post'", "'PUT'", "'FETCH'")
    + f" || ' /' || event_type || '/' || {K} || "
    + pick("event_id", "''", "'.js'", "'.PNG'", "'/a.b/c'", "'.tar.gz'", "'/.css'", "'.woff2'")
    + " || "
    + pick("user_id", "'?q=1'", "''", "'?a=b&c=d'")
    + " || ' HTTP/1.1\" ' || "
    + pick("event_id", "'200'", "'301'", "'404'", "'500'", "'700'", "'403'")
    + f" || CASE WHEN event_id % 11 = 0 THEN '' ELSE ' ' || {E} END"
)

WEB_V1 = (
    f"CASE WHEN event_id % 12 = 0 THEN 'worker ' || {U} || ' restarted' ELSE ("
    + WEB
    + ") || CASE WHEN event_id % 7 = 0 THEN ' -' ELSE '' END END"
)

DATABASE = (
    pick("event_id", "'mysql '", "'Postgres '", "'mongo '")
    + f" || CASE WHEN event_id % 6 = 0 THEN 'idle ' ELSE 'took ' || {V} || "
    + pick("user_id", "'ms'", "' s'", "' min'", "'  ms'")
    + " END || "
    + pick("event_id", "' SELECT a FROM t'", "' update t'", "' db.find({})'", "' vacuum'",
           "' selected'")
)

DATABASE_V1 = (
    f"'# Query_time: ' || {pick('event_id', V, U, s('event_id % 3') + ' || ' + q('.25'))}"
    f" || '  Lock_time: 0.' || {K} || ' Rows: 1 ' || "
    + pick("event_id", "'SELECT x'", "'insert into t'", "'FATAL: gone'", "'error: no UPDATE'",
           "'commit'")
)

SECURITY = (
    pick("event_id", "'okta '", "'AD '", "'vpnd '", "'loaded '")
    + " || "
    + pick("user_id", "'login by '", "'password change for '", "'removed '", "'access of '",
           "'authorize '")
    + " || "
    + pick("event_id", f"'user' || {U} || '@corp.example.com'",
           f"'CORP' || chr(92) || 'user' || {U}", "'nobody'")
    + " || ' ' || "
    + pick("event_id", "'success'", "'FAILED'", "'denied'", "'unauthorized'", "'allowed'",
           "'locked out'", "'pending'")
)

SECURITY_V1 = (
    pick("event_id", "'sshd: '", "'idp: '", "'scanner critical '", "'ips attack '", "'ssh '")
    + " || "
    + pick("user_id", "'login'", "'Logout'", "'failed'", "'denied'", "'refused'", "'open'")
    + " || "
    + pick("event_id", f"' user=' || {U}", f"' user:u' || {U}", "' root'")
    + f" || ' from ' || '10.1.' || {s('user_id % 256')} || '.' || {K} || "
    + pick("event_id", f"' port ' || {s('1024 + event_id % 60000')}", "''")
)

SYSLOG = (
    pick("event_id", f"event_type || '[' || {E} || ']: '", "event_type || ': '", "'systemd[1]: '",
         "'no header '", "'my-app.v2['  || '99999999999999999999' || ']: '")
    + " || "
    + pick("user_id", "'disk full'", "'Disk error'", "'segfault at 0'", "'ok'",
           "'oom-killer invoked'", "'some ERROR'", "'Out of memory'", "'Stack Trace follows'")
)

SYSLOG_V1 = (
    f"'<' || {s('event_id % 12')} || '>' || "
    + pick("event_id", "' '", "' '", "' '", "''")
    + f" || 'Jan 02 03:04:05 host' || {U} || ' app' || "
    + pick("user_id", "'[12]: '", "': '", "' '")
    + f" || event_type || ' ' || {K}"
)

IOT = (
    pick("event_id", f"'Device dev_' || lpad({E}, 8, '0')", "'Node 0a:1B:2c:3D:4e:5F'",
         "'Probe'", "'Device dev_12'")
    + " || ' ' || "
    + pick("user_id", "'temp'", "'humidity'", "'voltage'", "'level'", "'flow'")
    + f" || ': ' || {V} || "
    + pick("event_id", "'C'", "' %'", "'V'", "''", "' lux'", "'.'")
)

IOT_V1 = (
    f"'device_id=d' || {U} || ' temp=' || {pick('event_id', V, K, q('hot'), q('1.2.3'))}"
    + " || ' status=' || "
    + pick("user_id", "'CRIT'", "'OK'", "'crit'", "'LOW_BATT'")
    + f" || ' hum:0' || {K} || ' Hum=' || {V}"
)

_NOT_JSON = f"WHEN event_id % 9 = 0 THEN 'plain text ' || {E}"
_NUMBER = f"WHEN event_id % 13 = 0 THEN {E}"
_ARRAY = "WHEN event_id % 31 = 0 THEN '[1, 2]'"

CONTAINER = (
    f"CASE {_NOT_JSON} {_NUMBER} {_ARRAY} ELSE '{{\"container_id\":\"c-' || {E} || '\"' || "
    + pick("event_id", "''", "',\"namespace\":\"prod\"'", "',\"namespace\":null'",
           "',\"namespace\":\"\"'", f"',\"namespace\":\"ns' || {K} || '\"'")
    + " || "
    + pick("user_id", "''", "',\"stream\":\"stderr\"'", "',\"stream\":7'")
    + " || "
    + pick("event_id", "',\"log\":\"hello ' || event_type || '\"'",
           "',\"log\":\"\",\"message\":\"m1\"'", "',\"log\":0,\"message\":true'",
           "',\"log\":null'", "',\"log\":{\"a\":[1,2]}'", "',\"log\":false,\"message\":{}'")
    + " || '}' || CASE WHEN event_id % 17 = 0 THEN ' tail' ELSE '' END END"
)

CONTAINER_V1 = (
    "CASE WHEN event_id % 7 = 0 THEN event_type || ' started' ELSE "
    f"'2026-04-04T15:24:' || lpad({s('event_id % 60')}, 2, '0') || '.12345Z ' || "
    + pick("event_id", "'stdout'", "'stderr'", "'stdlog'")
    + " || ' ' || "
    + pick("user_id", "'F'", "'P'")
    + f" || ' ' || event_type || ' ' || {K} END"
)

CLOUD = (
    f"CASE {_NOT_JSON} {_NUMBER} ELSE '{{\"id\":' || {E} || "
    + pick("event_id", "',\"provider\":\"aws\"'", "',\"cloud_provider\":\"gcp\"'",
           "',\"provider\":\"\",\"cloud_provider\":\"azure\"'", "',\"cloud_provider\":null'", "''")
    + " || "
    + pick("user_id", "',\"region\":\"us-east-1-test\"'", "',\"aws_region\":\"dev-region\"'",
           "',\"region\":\"eu-west-1\"'", "''", "',\"region\":0'", "',\"aws_region\":null'")
    + " || "
    + pick("event_id", "',\"account_id\":12345'", "',\"owner\":\"ops\"'", "''")
    + " || "
    + pick("user_id", "',\"arn\":\"arn:aws:lambda\"'", "',\"resource_id\":\"vpc-1\"'",
           "',\"resource_id\":\"s3://b\"'", "',\"arn\":\"subnet\"'", "''")
    + " || '}' END"
)

CLOUD_V1 = (
    f"CASE {_NOT_JSON} {_NUMBER} ELSE '{{\"eventId\":' || {E} || "
    + pick("event_id", "',\"eventName\":\"Run' || event_type || '\"'",
           "',\"protoPayload\":{\"methodName\":\"m.' || event_type || '\"}'",
           "',\"eventName\":\"\"'", "',\"protoPayload\":\"text\"'", "''")
    + " || "
    + pick("user_id", "',\"errorCode\":\"Denied\"'", "',\"severity\":\"ALERT\"'",
           "',\"severity\":\"INFO\"'", "',\"errorMessage\":\"\"'")
    + " || "
    + pick("event_id", "',\"awsRegion\":\"us-east-1\"'", "',\"location\":\"eu\"'", "''")
    + " || "
    + pick("user_id", "',\"sourceIPAddress\":\"10.0.0.1\"'",
           "',\"requestMetadata\":{\"callerIp\":\"10.0.0.2\"}'", "''",
           "',\"requestMetadata\":{}'", "',\"requestMetadata\":null'")
    + " || "
    + pick("event_id", "',\"recipientAccountId\":\"acc1\"'",
           "',\"resource\":{\"labels\":{\"project_id\":\"p1\"}}'", "',\"resource\":{}'",
           "',\"resource\":{\"labels\":5}'")
    + " || ',\"userAgent\":\"\",\"eventTime\":\"2026-04-04T10:00:00Z\"}' END"
)

INTEGRATION = (
    f"CASE {_NOT_JSON} {_NUMBER} ELSE '{{\"kind\":\"' || "
    + pick("event_id", "'stripe'", "'twilio'", "'sendgrid'", "'other'", "'sms'")
    + " || '\"' || "
    + pick("event_id", f"',\"id\":\"ch_' || {E} || '\"'", f"',\"event_id\":' || {E}",
           "',\"id\":\"\",\"sid\":\"SM1\"'", "',\"sid\":null'", "',\"id\":0'")
    + " || "
    + pick("user_id", "',\"api_version\":\"2024-01\"'", "',\"version\":2'",
           "',\"version\":null'", "''")
    + " || "
    + pick("event_id", "',\"livemode\":true'", "',\"livemode\":false'", "',\"livemode\":null'",
           "''")
    + " || "
    + pick("user_id", "',\"type\":\"charge.failed\"'", "',\"type\":\"refund\"'",
           "',\"type\":\"undelivered\"'", "',\"type\":\"ok\"'")
    + " || '}' END"
)

INTEGRATION_V1 = (
    f"CASE {_NOT_JSON} {_NUMBER} ELSE '{{' || "
    + pick("event_id", "'\"SmsStatus\":\"undelivered\"'", "'\"event\":\"bounce.error\"'",
           "'\"a\":1,\"type\":\"charge.ok\"'", "'\"a\":[1,{\"b\":null}]'", "'\"type\":5'")
    + " || "
    + pick("user_id", f"',\"id\":' || {E}",
           f"',\"data\":{{\"object\":{{\"id\":\"obj' || {E} || '\"}}}}'",
           "',\"MessageSid\":\"SM9\"'", "',\"data\":\"text\"'", "',\"data\":{\"object\":{}}'")
    + " || '}' END"
)

CUSTOM = (
    pick("event_id", f"'[MOD-' || {K} || '] '", "'(worker 1) '", "''", "'[] '")
    + f" || 'user=' || {U} || ' path=/a/' || {E} || "
    + pick("event_id", f"' t: ' || {V}", "' USER=last'", "' at 12:30:45'", "' context_tag=x'",
           "' quality_score=9 is_internal=maybe'")
    + " || "
    + pick("user_id", "' app_internal'", "''", "' url=http://h.example/x?y=1'", "' a==b : c'")
)

CUSTOM_V1 = (
    f"CASE WHEN event_id % 4 = 0 THEN '{{\"level\":' || "
    + pick("user_id", "'\"warn\"'", "'null'", "'3'")
    + " || ',\"m\":{\"x\":1}' || "
    + pick("user_id", "',\"message\":\"did ' || event_type || '\"'", "',\"msg\":\"alt\"'",
           "',\"message\":\"\"'", "',\"message\":5'")
    + " || '}' WHEN event_id % 13 = 0 THEN "
    + E
    + " ELSE "
    + pick("event_id", "'[MY-APP] [MOD_1] '", "'[lower] '", "'plain '")
    + " || "
    + pick("user_id", "'all fine'", "'an Exception'", "'warn: low'", "'ERROR x'")
    + " END"
)

V2_LINES = {
    "networking": NETWORK,
    "containers": CONTAINER,
    "storage": DATABASE,
    "web": WEB,
    "cloud": CLOUD,
    "security": SECURITY,
    "system": SYSLOG,
    "integrations": INTEGRATION,
    "iot": IOT,
    "custom": CUSTOM,
}
V1_LINES = {
    "networking": NETWORK_V1,
    "containers": CONTAINER_V1,
    "storage": DATABASE_V1,
    "web": WEB_V1,
    "cloud": CLOUD_V1,
    "security": SECURITY_V1,
    "system": SYSLOG_V1,
    "integrations": INTEGRATION_V1,
    "iot": IOT_V1,
    "custom": CUSTOM_V1,
}

SOURCE_NAMES = [
    "firewall", "router", "cisco", "fortigate", "kubernetes", "docker", "openshift", "k8s",
    "postgresql", "mongodb", "mysql", "database", "redis", "nginx", "apache", "web_app",
    "ingress", "aws", "gcp", "azure", "cloudtrail", "auth", "okta", "active_directory", "siem",
    "vpn", "syslog", "kernel", "cron", "ssh", "stripe", "twilio", "sendgrid", "webhook", "sensor",
    "gateway", "telemetry", "mqtt", "custom", "internal", "app", "generic", "NGINX", "iot",
    "unknown-thing", "",
]

# every 47th source is missing; the others walk through the names
SOURCE = f"CASE WHEN event_id % 47 = 46 THEN NULL ELSE {pick('event_id', *[q(n) for n in SOURCE_NAMES])} END"
MIXED = pick("(event_id + user_id)", *[f"({line})" for line in V2_LINES.values()])
MIXED_V1 = pick("(event_id + user_id)", *[f"({line})" for line in V1_LINES.values()])
TENANT = f"'t' || {s('user_id % 7')}"
SERVICE = pick("user_id", "'Billing'", "'auth-api'", "'nginx'")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_for_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``events`` that lines are made of, spread over the cores."""
    events = read(spark, sf_dir, "events")
    return session.spread(events.select("event_id", "ts", "user_id", "event_type", "value", "props"))


def lines(spark: SparkSession, sf_dir: str, line: str, **more: str) -> DataFrame:
    """``event_id`` and the line of every event, plus more derived columns."""
    columns = [F.expr(v).alias(k) for k, v in more.items()]
    events = read_for_parsing(spark, sf_dir)
    return events.select("event_id", F.expr(line).alias("raw_payload"), *columns)
