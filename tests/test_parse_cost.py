from pyspark.sql import functions as F

from loglathe import session
from loglathe.operators import analytics, parsers_v1, transform


def _largest(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_rows_of_one_split_are_dealt_out(spark):
    one_full = spark.range(4000).coalesce(1).union(spark.range(0, 100, 1, 20).where("id % 7 > 7"))
    assert one_full.rdd.getNumPartitions() > 8 and _largest(one_full) == 4000
    assert _largest(session.spread(one_full)) <= 1000
    even = spark.range(0, 4000, 1, 16)
    assert session.spread(even) is even
    assert session.spread(spark.range(0)).count() == 0


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    assert _largest(session.spread(spark.range(0, 4000, 1, 8))) <= 200


def test_telemetry_values_keep_their_text(spark):
    given = "a=007 b=1. c=.5 d=1.2.3 e=x1 f=99999999999999999999 g=. h=nan i=1.50 j=5d k=٣ l=1e5 m=0"
    want = dict(a="7", b="1.0", c="0.5", d="1.2.3", e="x1", f="99999999999999999999", g=".", h="nan", i="1.5", j="5", k="٣", l="1", m="0")
    parsed = parsers_v1.parse_iot_v1(spark.createDataFrame([(given,)], "raw_payload string"))
    got = parsed.first().metadata
    assert {k: got[k] for k in want} == want


def test_telemetry_casts_only_what_looks_like_a_number(spark):
    given = str(parsers_v1._telemetry_value(F.col("v")))
    assert given.lower().count("rlike") == 2


def test_top_k_does_not_parse_in_a_filter(spark):
    rows = [(i, f"took {i}ms select", "mysql", "t1") for i in range(50)] + [(i, "login failed", "okta", "t2") for i in range(3)]
    df = spark.createDataFrame(rows, "event_id long, raw_payload string, source string, tenant_id string")
    top = analytics.top_k_errors(
        transform.transform_logs(df), analytics.is_error_row(F.col("attributes")), ["tenant_id", "family"]
    )
    assert [tuple(r) for r in top.collect()] == [("t2", "security", 3)]
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp_extract" in line for line in plan.split("\n") if line.lstrip("+-: ").startswith("Filter"))
