"""Exact results of the v2 parser jobs, read off their rules."""

import pytest
from pyspark.sql import functions as F

from loglathe.operators import parsers_v2, transform

M1 = "Device dev_A1B2C3D4 reporting 65.5 C"
M2 = "Sensor hum_99 reported 42% humidity"
M3 = "Gateway dev_power_01 voltage at 4.2V"
M4 = "Accepted password for root from 192.168.1.1 port 22 ssh2"


def parse(spark, parser, lines, **options):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(lines)], "i int, raw_payload string")
    rows = parser(df, **options).orderBy("i").collect()
    return [r["attributes"].asDict() if r["attributes"] else {"error": r["parse_error"]} for r in rows]


def check(spark, parser, cases, **options):
    got = parse(spark, parser, [line for line, _ in cases], **options)
    for (line, want), row in zip(cases, got):
        for key, value in want.items():
            assert row[key] == value, (line, key, row)


def test_iot(spark):
    check(
        spark,
        parsers_v2.parse_iot,
        [
            (M1, dict(device_id="dev_A1B2C3D4", value=1.0, unit="B", sensor_type="generic_sensor", status="OK", is_telemetry_valid=True)),
            (M2, dict(device_id="unknown_sensor", value=99.0, unit="reported", sensor_type="humidity", status="OK", is_telemetry_valid=False)),
            (M3, dict(device_id="unknown_sensor", value=1.0, unit="voltage", sensor_type="power", status="CRITICAL")),
            (M4, dict(value=1.1, unit="port", sensor_type="generic_sensor")),
            ("aa:bb:cc:dd:ee:ff temp 51. C", dict(device_id="aa:bb:cc:dd:ee:ff", value=51.0, status="CRITICAL")),
            ("nothing here", dict(value=0.0, unit="raw")),
        ],
    )


def test_network(spark):
    check(
        spark,
        parsers_v2.parse_network,
        [
            ("firewall: drop packet from 10.0.0.5", dict(action="DENY", nw_src_ip="10.0.0.5", nw_ip_count="1")),
            ("auth: user admin login success from 192.168.1.1", dict(nw_src_ip="192.168.1.1", vendor_type="router", action="ALLOW")),
            ("!!!---NOT-A-LOG---!!!", dict(nw_src_ip=None, nw_ip_count="0", protocol="OTHER")),
            (M4, dict(nw_src_ip="192.168.1.1", nw_src_port="22", nw_dst_ip=None)),
            ("999.999.999.999 host:123456 x:80", dict(nw_src_ip="999.999.999.999", nw_src_port="80")),
            ("asa fg ASA", dict(vendor_type="firewall")),
        ],
    )


def test_database(spark):
    check(
        spark,
        parsers_v2.parse_database,
        [
            (M1, dict(operation="UNKNOWN", duration=0.0, unit="ms", is_slow_query=False, db_family="nosql")),
            (M4, dict(duration=22.0, unit="s", is_slow_query=True)),
            ("Postgres took 100.1ms select 1", dict(operation="SELECT", duration=100.1, is_slow_query=True, db_family="rdbms")),
            ("took 5000 µs find", dict(operation="FIND", duration=5000.0, unit="µs", is_slow_query=False)),
            ("selected 3 min", dict(operation="UNKNOWN", unit="ms")),
        ],
    )


def test_web(spark):
    check(
        spark,
        parsers_v2.parse_web,
        [
            (M1, dict(method="UNKNOWN", path="/", status_code=0, response_category="MALFORMED", request_type="API_CALL", is_error=False)),
            ('x "GET /a.js HTTP/1.1" 200 5', dict(method="GET", path="/a.js", status_code=200, response_category="SUCCESS", request_type="STATIC_ASSET")),
            ('x "get /.js HTTP/1.1" 404', dict(method="GET", status_code=0, request_type="API_CALL")),
            ('x "GET /x.tar.gz?q=1 H" 503 ', dict(path="/x.tar.gz", response_category="SERVER_ERROR", is_error=True, request_type="API_CALL")),
            ('x "GET /a.js/b H" 404 1', dict(response_category="CLIENT_ERROR", request_type="API_CALL")),
            ('"GET /a" 404 "ref"', dict(path='/a"', status_code=404)),
        ],
    )


def test_security(spark):
    check(
        spark,
        parsers_v2.parse_security,
        [
            (M1, dict(user="anonymous", outcome="UNKNOWN", event_type="GENERAL_AUDIT", severity="INFO", vendor="generic_security")),
            (M4, dict(event_type="CREDENTIAL_MANAGEMENT", severity="MEDIUM", vendor="generic_security")),
            ("okta login jo@x.org failed", dict(user="jo@x.org", outcome="FAILED", is_failure=True, severity="HIGH", vendor="okta")),
            ("module loaded by CORP\\jo", dict(user="CORP\\jo", vendor="active_directory")),
            ("remove key", dict(event_type="RESOURCE_DELETION", severity="CRITICAL")),
        ],
    )


def test_syslog(spark):
    check(
        spark,
        parsers_v2.parse_syslog,
        [
            (M1, dict(system_service="kernel", pid=None, event_category="GENERAL", is_system_error=False)),
            ("sshd[42]: ok", dict(system_service="sshd", pid="42")),
            ("my-app: disk is full", dict(system_service="my-app", pid=None, event_category="STORAGE_CRITICAL", is_system_error=True)),
            ("x[99999999999999999999]: error", dict(pid="99999999999999999999", event_category="GENERAL", is_system_error=True)),
            ("systemd: out of memory", dict(is_os_internal=True, event_category="MEMORY_CRITICAL")),
        ],
    )


def test_container(spark):
    check(
        spark,
        parsers_v2.parse_container,
        [
            ('{"container_id":"abc-123","namespace":"prod","log":"Hello World"}', dict(container_id="abc-123", namespace="prod", stream="stdout", raw_content="Hello World", is_json=True)),
            ("Pure text log line", dict(container_id=None, namespace=None, raw_content="Pure text log line", is_json=False)),
            ('{"namespace":null,"log":"","message":"m"}', dict(namespace=None, raw_content="m")),
            ('{"log":0,"message":{}}', dict(namespace="default", raw_content='{"log":0,"message":{}}')),
            ('{"log":{"b":1}}', dict(raw_content='{"b":1}')),
            ('{"log":"a"} tail', dict(raw_content='{"log":"a"} tail', is_json=False)),
            ('{"log":"a"},{"__end":true}', dict(is_json=False)),
            ('{"log":"a"}],[{"b":1}', dict(is_json=False)),
            ('{"log":"a","log":"b"}', dict(raw_content="b")),
            ("{'log':'a'}", dict(is_json=False)),
            ("12", dict(error="'int' object has no attribute 'get'")),
            ("1.5", dict(error="'float' object has no attribute 'get'")),
            ("[1]", dict(error="'list' object has no attribute 'get'")),
            ('"x"', dict(error="'str' object has no attribute 'get'")),
            ("null", dict(error="'NoneType' object has no attribute 'get'")),
            ("true", dict(error="'bool' object has no attribute 'get'")),
            ("12 apples", dict(is_json=False)),
            ("[1] apples", dict(is_json=False)),
        ],
    )


def test_container_hook_and_extras(spark):
    got = parse(
        spark,
        parsers_v2.parse_container,
        ['{"log":"Hello","time":"t1","kubernetes":{"pod_id":"p1"}}'],
        inner=lambda content: {"processed_content": F.upper(content)},
        extras=True,
    )
    assert got[0]["processed_content"] == "HELLO"
    assert got[0]["time"] == "t1" and got[0]["pod_id"] == "p1"


def test_cloud(spark):
    check(
        spark,
        parsers_v2.parse_cloud,
        [
            (M1, dict(provider="unknown", region="global", account_id="none", resource_id="raw_stream", cloud_service="COMPUTE", is_production=True)),
            ('{"provider":"","cloud_provider":"aws","region":"dev-region","owner":null}', dict(provider="aws", region="dev-region", account_id=None, resource_id="unassigned", is_production=False)),
            ('{"provider":"x","arn":"lambda"}', dict(provider="x", resource_id="lambda", cloud_service="SERVERLESS")),
            ("[1]", dict(account_id="none")),
        ],
    )


def test_integration(spark):
    check(
        spark,
        parsers_v2.parse_integration,
        [
            (M1, dict(event_id="none", api_version="unknown", is_live_mode=False, vendor="generic_webhook", business_impact="LOW", is_test_event=True)),
            ('{"id":"ch_1","type":"charge.failed"}', dict(event_id="ch_1", api_version="v1", is_live_mode=True, vendor="stripe", business_impact="HIGH", is_test_event=False)),
            ('{"id":0,"event_id":"","sid":"SMS1","livemode":null,"status":"failed"}', dict(event_id="SMS1", is_live_mode=None, is_test_event=True, vendor="twilio", business_impact="MEDIUM")),
        ],
    )


def test_custom(spark):
    got = parse(
        spark,
        parsers_v2.parse_custom,
        [M1, "[MOD] A=1 a=2 at 12:30:45 url=http://x", "no tags", "quality_score=9 é=5", "(w1) context_tag=x", "py_log"],
    )
    assert got[0]["tags"] == {} and got[0]["quality_score"] == "LOW"
    assert got[1]["tags"] == {"a": "2", "12": "30", "url": "http", "context_tag": "MOD"} or got[1][
        "tags"
    ] == {"a": "2", "12": "30", "url": "http", "http": "//x", "context_tag": "MOD"}
    assert got[1]["quality_score"] == "HIGH"
    assert got[3]["tags"] == {"quality_score": "9", "é": "5"}
    assert got[4]["tags"] == {"context_tag": "w1"}
    assert got[5]["is_internal"] is True


@pytest.mark.parametrize("name", list(parsers_v2.PARSERS))
def test_empty_and_null_input(spark, name):
    from loglathe.operators.parsing import parse_one

    empty = spark.createDataFrame([], "raw_payload string")
    assert parse_one(empty, parsers_v2.PARSERS[name]).count() == 0
    nulls = spark.createDataFrame([(None,), ("",), (" ",)], "raw_payload string")
    assert parse_one(nulls, parsers_v2.PARSERS[name]).count() == 3


def test_process_batch_fallbacks(spark):
    logs = [(M1, 1712490000), (M4, None), ("   ", None), (None, None), ("[1]", 0)]
    df = spark.createDataFrame(
        [("b1", "tenant-123", "kubernetes", logs), ("b2", None, None, [("x", 5)])],
        "batch_id string, tenant_id string, source string,"
        " logs array<struct<message:string,timestamp:bigint>>",
    )
    rows = transform.process_batch(df, now="2026-01-01 00:00:00").collect()
    assert len(rows) == 6 and len({r["log_id"] for r in rows}) == 6
    by_message = {(r["tenant_id"], r["message"]): r for r in rows}
    assert by_message["tenant-123", M1]["attributes"] == {"raw_content": M1}
    assert by_message["tenant-123", M1]["ingested_at"] == "2026-01-01T00:00:00.000000Z"
    blank = by_message["tenant-123", "   "]
    assert blank["attributes"] == {"error": "Empty log", "raw_captured": "true"}
    assert blank["source"] is None and blank["ingested_at"] is None
    assert by_message["tenant-123", ""]["attributes"]["error"] == "Empty log"
    assert "'list' object" in by_message["tenant-123", "[1]"]["attributes"]["error"]
    assert by_message["system", "x"]["source"] == "generic"


def test_long_lines(spark):
    """Whole texts of any length go through every parser of both dialects."""
    from loglathe.operators import parsers_v1
    from loglathe.operators.parsing import parse_one

    n = 5_000
    lines = [
        '"' + "a" * n + '"',
        '"' + "\\n" * n + '"',
        "[" + "1," * n + "1]",
        "k=v " * n,
        "a.b-" * n,
        'msg="' + "x " * n,
        "é" * n + " 10.0.0.1",
        " " * n,
        '{"log":"' + "z" * n + '"}',
    ]
    df = spark.createDataFrame([(m,) for m in lines], "raw_payload string").repartition(9)
    for parser in parsers_v2.PARSERS.values():
        assert len(parse_one(df, parser).collect()) == len(lines)
    for parser in parsers_v1.PARSERS.values():
        rows = parsers_v1.parse_lines(df, {parser.family: parser}, None, df.raw_payload, None)
        assert len(rows.collect()) == len(lines)
    kinds = parse_one(df, parsers_v2.CONTAINER).where("parse_error is not null")
    assert sorted(r.parse_error[1:5] for r in kinds.collect()) == ["list", "str'", "str'"]


def test_own_columns_stay(spark):
    df = spark.createDataFrame([("a=1", 5)], "raw_payload string, __mine int")
    row = parsers_v2.parse_custom(df).first()
    assert row["__mine"] == 5 and set(row.asDict()) == {"raw_payload", "__mine", "attributes", "parse_error"}
