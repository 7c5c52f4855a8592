"""Exact results of the v1 parser jobs, read off their rules."""

from pyspark.sql import functions as F

from loglathe.operators import parsers_v1, routing, transform

NOW = "2026-01-01 00:00:00"


def parse(spark, parser, *lines, **options):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(lines)], "i int, raw_payload string")
    return parser(df, now=NOW, **options).orderBy("i").collect()


def test_network(spark):
    a, b, c, d = parse(
        spark,
        parsers_v1.parse_network_v1,
        'devname=FG-1, srcip=10.0.0.1 level=2 msg="User login" a=\'x y\'',
        "level=error action=deny",
        "no pairs",
        " ",
    )
    assert (a.level, a.message) == ("ERROR", "User login")
    assert a.metadata["a"] == "x y" and a.metadata["device_type"] == "generic_network"
    assert (b.level, b.message) == ("INFO", "Network Event: deny")
    assert c.metadata == {"parser": "generic_network_log"} and c.message == "no pairs"
    assert d.level == "ERROR" and d.attributes["error"] == "empty_network_log"


def test_container_and_web(spark):
    a, b = parse(spark, parsers_v1.parse_container_v1, "2026-04-04T15:24:25.1Z stderr P boom", "x")
    assert (a.level, a.message, a.metadata["is_partial"]) == ("ERROR", "boom", "true")
    assert b.metadata == {"parser": "generic_container_log"}
    line = '1.1.1.1 - - [04/Apr/2026:15:14:57 +0000] "GET /a HTTP/1.1" 404 '
    a, b = parse(spark, parsers_v1.parse_web_v1, line + "12", line + "-")
    assert (a.level, a.message, a.metadata["http_status"]) == ("ERROR", "GET /a", "404")
    assert str(a.event_time) == "2026-04-04 15:14:57"
    assert b.metadata == {"parser": "generic_app_log"}


def test_database(spark):
    a, b, c = parse(
        spark,
        parsers_v1.parse_database_v1,
        "# Query_time: 2.5  Lock_time: 0.1 xselect ",
        "FATAL crash",
        "y" * 600,
    )
    assert a.level == "WARNING" and a.metadata["db_operation"] == "SELECT"
    assert a.metadata["query_duration_sec"] == "2.5" and a.metadata["is_slow_query"] == "true"
    assert b.level == "ERROR" and "is_slow_query" not in b.metadata
    assert len(c.message) == 500


def test_cloud(spark):
    a, b, c, d = parse(
        spark,
        parsers_v1.parse_cloud_v1,
        '{"eventName":"Run","severity":"ALERT","eventTime":"2026-04-04T10:00:00Z","awsRegion":"r",'
        '"sourceIPAddress":"1.2.3.4","recipientAccountId":9,"userAgent":""}',
        '{"protoPayload":{"methodName":"m"},"resource":{"labels":{"project_id":"p"}}}',
        '{"protoPayload":null}',
        "not json",
    )
    assert (a.level, a.message) == ("ERROR", "Run")
    assert a.metadata == {
        "cloud_region": "r", "source_ip": "1.2.3.4", "account_id": "9", "parser": "cloud_v1",
    }
    assert str(a.timestamp) == "2026-04-04 10:00:00" and str(b.timestamp) == NOW
    assert b.message == "m" and b.metadata["account_id"] == "p"
    assert c.attributes["error"] == d.attributes["error"] == "cloud_json_parse_fail"


def test_security_and_syslog(spark):
    a, b = parse(
        spark,
        parsers_v1.parse_security_v1,
        "Login Denied user=Bob from 1.2.3.4 port 22",
        "critical refused",
    )
    assert a.level == "INFO" and a.metadata["user"] == "bob" and a.metadata["port"] == "22"
    assert a.metadata["event_type"] == "authentication"
    assert b.level == "ERROR" and b.metadata["event_type"] == "security_audit"
    a, b, c = parse(
        spark, parsers_v1.parse_syslog_v1, "<11> Jan 02 03:04:05 h app: hi", "<11>Jan 02", ""
    )
    assert (a.level, a.message, a.metadata["tag"]) == ("INFO", "hi", "app")
    assert b.level == "UNKNOWN" and b.metadata["parsing_error"] == "regex_mismatch"
    assert c.metadata["parsing_error"] == "invalid_input_type"
    (a,) = parse(spark, parsers_v1.parse_syslog_v1, "<11> Jan 02 03:04:05 h app: hi", rfc=True)
    assert a.level == "ERROR"


def test_integration_and_iot(spark):
    a, b, c = parse(
        spark,
        parsers_v1.parse_integration_v1,
        '{"type":"charge.Failed","data":{"object":{"id":"o1"}}}',
        '{"type":5}',
        '{"data":"text"}',
    )
    assert a.level == "ERROR" and a.metadata["external_id"] == "o1"
    assert a.message == "ThirdParty Event: charge.Failed"
    assert b.attributes["error"] == c.attributes["error"] == "webhook_parse_exception"
    a, b, c, d = parse(
        spark,
        parsers_v1.parse_iot_v1,
        "device_id=d1 temp=80.5 hum:007",
        "temp=hot",
        "temp=hot status=CRIT",
        "status=crit v=1.2.3",
    )
    assert a.level == "ERROR" and a.message == "Telemetry from d1" and a.metadata["hum"] == "7"
    assert b.attributes["error"] == "iot_parse_exception"
    assert c.level == "ERROR" and c.metadata["temp"] == "hot"
    assert d.level == "INFO" and d.metadata["v"] == "1.2.3"


def test_custom(spark):
    a, b, c = parse(
        spark,
        parsers_v1.parse_custom_v1,
        '{"level":"warn","msg":"m","n":{"x":1}}',
        "[MY-APP] [lower] an exception",
        "[1]",
    )
    assert (a.level, a.message, a.metadata["n"]) == ("WARN", "m", '{"x":1}')
    assert b.level == "ERROR" and b.metadata["app_tags"] == '["MY-APP"]'
    assert c.level == "INFO" and c.message == "[1]"


def test_routed_v1(spark):
    df = spark.createDataFrame(
        [("<3> Jan 02 03:04:05 h app: hi", None, "NGINX", "t"), (None, "generic", None, "t"),
         ("temp=90", "Iot", "svc", "t")],
        "message string, source string, service string, tenant_id string",
    )
    rows = transform.transform_logs_v1(df, now=NOW).collect()
    by_source = {r.source: r for r in rows}
    assert by_source["NGINX"].family == "web"
    assert by_source["generic"].family == "system" and by_source["generic"].service == "unknown"
    assert by_source["generic"].level == "UNKNOWN"
    assert by_source["Iot"].level == "ERROR"
    routed = routing.route_v1(df).where(F.col("source") == "generic").first()
    assert routed.family == "system"
