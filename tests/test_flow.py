"""Intake, admission, processing, storage, sinks, streams and plan checks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from loglathe import fixed, schemas, session
from loglathe.operators import (
    admission, analytics, intake, parsers_v2, processing, routing, storage, transform,
)
from loglathe.sinks import outputs
from loglathe.sources import inputs
from loglathe.streaming import jobs, limiter

NOW = "2026-01-01 00:00:00"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- intake --------------------------------------------------------------------


def decoded(spark, *texts):
    return intake.decode_requests(spark.createDataFrame([(t,) for t in texts], "value string"))


def test_request_validation(spark):
    df = decoded(
        spark,
        '{"tenant_id":"t","service":"s","logs":[{"message":"m","timestamp":1}]}',
        '{"tenant_id":"t","logs":[]}',
        '{"tenant_id":"t","service":"s","logs":[]}',
        '{"tenant_id":5,"service":"s","logs":[]}',
        '{"tenant_id":"t","service":"s","logs":[1]}',
        '{"tenant_id":"t","service":"s","logs":[{"m":"x"}]}',
        "nope",
    )
    good, bad = intake.split_valid(df)
    assert good.count() == 3
    reasons = sorted(r.reject_reason for r in bad.collect())
    assert reasons == ["logs missing", "service missing", "tenant_id missing", "tenant_id missing"]
    strict, _ = intake.split_valid(df, strict=True)
    assert strict.count() == 1


def test_envelope_all_or_nothing_and_stable_ids(spark):
    df = decoded(
        spark,
        '{"tenant_id":"t","service":"s","logs":[{"message":"a","source":"NGINX","timestamp":7},{}]}',
        '{"tenant_id":"t","service":"s2","logs":[{"message":"a"},{"message":null}]}',
        '{"tenant_id":"t","service":"s3","source":"","logs":[{"message":"b"}]}',
    ).withColumn("request_id", F.sha2("value", 256))
    rows = intake.envelope(df, now=NOW).collect()
    assert len(rows) == 3 and {r.service_name for r in rows} == {"s", "s3"}
    first = next(r for r in rows if r.raw_payload == "a")
    assert first.source == "nginx" and str(first.event_ts) == "1970-01-01 00:00:07"
    empty = next(r for r in rows if r.raw_payload == "")
    assert empty.source == "generic" and empty.metadata == {}
    assert next(r for r in rows if r.raw_payload == "b").source == ""
    again = {r.event_id for r in intake.envelope(df, now=NOW).collect()}
    assert again == {r.event_id for r in rows} and len(again) == 3
    randomly = {r.event_id for r in intake.envelope(df, now=NOW, id_mode="random").collect()}
    assert not (randomly & again)


# --- admission -----------------------------------------------------------------


def make_arrivals(spark, rows):
    df = spark.createDataFrame(rows, "tenant_id string, micros bigint, request_id string, n_logs bigint")
    return df.select("tenant_id", F.timestamp_micros("micros").alias("arrival"), "request_id", "n_logs")


def brute_force(rows, limit):
    totals, result = defaultdict(int), {}
    for tenant, micros, request, n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        key = (tenant, micros // 1_000_000)
        totals[key] += n
        result[request] = (totals[key], totals[key] <= limit)
    return result


def hot_rows(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(4000):
        # a third of all rows falls into one microsecond of one tenant
        hot = i % 3 == 0
        tenant = "hot" if hot else f"t{rng.randrange(4)}"
        micros = 5_000_000 if hot else rng.randrange(4_000_000)
        rows.append((tenant, micros, f"r{i:05d}", rng.choice([0, 1, 1, 2, 30])))
    return rows


@pytest.mark.parametrize("limit", [0, 1, 50, 1000, 10**9])
def test_rate_limit_against_brute_force(spark, limit):
    rows = hot_rows(limit % 7)
    want = brute_force(rows, limit)
    got = admission.rate_limit(make_arrivals(spark, rows), limit=limit).collect()
    assert len(got) == len(rows)
    assert {r.request_id: r.allowed for r in got} == {k: v[1] for k, v in want.items()}


def test_running_totals_against_brute_force(spark):
    rows = hot_rows(3)
    want = brute_force(rows, 1000)
    got = admission.running_totals(make_arrivals(spark, rows)).collect()
    assert {r.request_id: (r.running_total, r.allowed) for r in got} == want


def test_rate_limit_boundary(spark):
    rows = [("a", 1, "1", 400), ("a", 2, "2", 600), ("a", 3, "3", 1), ("a", 1_000_001, "4", 1000),
            ("b", 1, "5", 1001), ("b", 2, "6", 1)]
    got = admission.rate_limit(make_arrivals(spark, rows))
    assert {r.request_id: r.allowed for r in got.collect()} == {
        "1": True, "2": True, "3": False, "4": True, "5": False, "6": False,
    }


def test_rate_limit_null_tenant_and_carried_totals(spark):
    rows = [(None, i, f"{i:03d}", 30) for i in range(100)] + [("a", 1, "x", 10), ("a", 2, "y", 0), ("b", 1, "z", 0)]
    df = make_arrivals(spark, rows)
    got = {r.request_id: r.allowed for r in admission.rate_limit(df, limit=90).collect()}
    assert [k for k, v in got.items() if v and k.isdigit()] == ["000", "001", "002"] and got["x"] and got["z"]
    totals = {r.request_id: r.running_total for r in admission.running_totals(df).collect()}
    assert max(totals.values()) == 3000
    second = F.timestamp_seconds(F.lit(0))
    carried = spark.createDataFrame([(None, 70), ("a", 81), ("b", 91)], "tenant_id string, logs bigint").withColumn("second", second)
    got = {r.request_id: r.allowed for r in admission.rate_limit(df, limit=90, carried=carried).collect()}
    assert not any(v for k, v in got.items() if k.isdigit())
    assert (got["x"], got["y"], got["z"]) == (False, False, False)


def test_admission_order_of_outcomes(spark):
    rows = [("a", 0, "1", 1001), ("b", 0, "2", 9000), ("c", 1_000_000, "3", 5), ("c", 2_000_000, "4", 5)]
    df = make_arrivals(spark, rows).withColumns(
        {"ok": F.col("request_id") != "4", "depth": F.when(F.col("request_id") == "3", 10_001).when(F.col("request_id") == "2", 10_000)}
    )
    got = admission.admission_status(df, F.col("ok"), F.lit(True), F.col("depth"), limit=10**6, max_depth=10_000)
    status = {r.request_id: (r.status, r.buffer_depth) for r in got.collect()}
    assert status["1"] == (202, 1001) and status["2"] == (202, 19_000)
    assert status["3"] == (503, None) and status["4"] == (422, None)


# --- processing -------------------------------------------------------------------


def test_contract(spark):
    cases = {
        '{"tenant_id":"t","service":"S","timestamp":12,"message":"m"}': None,
        '{"tenant_id":"t","service":"S","timestamp":"12","message":"","metadata":{"a":1}}': None,
        '{"tenant_id":"t","service":"S","timestamp":12.0,"message":"m"}': None,
        '{"tenant_id":"t","service":"S","timestamp":1.5,"message":"m"}': "timestamp",
        '{"tenant_id":"t","service":"S","timestamp":"x","message":"m"}': "timestamp",
        '{"tenant_id":1,"service":"S","timestamp":1,"message":"m"}': "tenant_id",
        '{"tenant_id":"t","timestamp":1,"message":"m"}': "service",
        '{"tenant_id":"t","service":"S","timestamp":1,"message":null}': "message",
        '{"tenant_id":"t","service":"S","timestamp":1,"message":"m","metadata":null}': "metadata",
        "[]": "not a JSON object",
    }
    df = spark.createDataFrame([(t, t) for t in cases], "event_id string, value string")
    metrics = Observation("counts")
    done = processing.process_logs(df, metrics=metrics)
    rows = {r.event_id: r for r in done.collect()}
    for text, want in cases.items():
        error = rows[text].error
        assert (error is None) if want is None else error.startswith(want), (text, error)
    assert metrics.get == {"processed_total": 3, "failed_total": 7}
    good = processing.indexed_rows(done).where("ts = 12 and msg = 'm'").first()
    assert good.service == "s" and good.tags == ["s", "log"] and good.msg_length == 1
    gate = processing.process_logs(df, schema=schemas.RAW_LOG)
    assert gate.where(F.col("error").startswith("timestamp: expected")).count() == 4


def test_replay_skips_indexed(spark):
    df = spark.createDataFrame(
        [("1", '{"tenant_id":null,"service":"s","timestamp":1,"message":"m"}'), ("2", "x"),
         ("3", '{"tenant_id":null,"service":"s","timestamp":1,"message":"m"}')],
        "event_id string, value string",
    )
    dead = processing.dead_letters(processing.process_logs(df), now=NOW)
    indexed = spark.createDataFrame([("3",)], "event_id string")
    again = processing.replay(dead, indexed, lambda c: F.replace(c, F.lit("null"), F.lit('"t"')))
    assert [r.event_id for r in again.collect()] == ["1"]


# --- storage, sinks, sources ---------------------------------------------------------


def test_storage_defaults(spark):
    df = spark.createDataFrame([(None,)], "tenant_id string")
    row = storage.storage_rows(df).first().asDict()
    assert row == {
        "timestamp": None, "tenant_id": "0", "service": "default", "source": "generic",
        "level": "INFO", "message": "", "metadata": {},
    }
    assert storage.storage_rows(df.where("false")).count() == 0


def test_message_key(spark):
    df = spark.createDataFrame([("apple", "ingestion"), (None, None)], "tenant_id string, service string")
    keys = [bytes(r.key) for r in storage.keyed_messages(df).collect()]
    assert keys == [b"apple:ingestion", b"unknown:unknown"]


def test_unknown_kinds_and_kafka_options():
    with pytest.raises(ValueError):
        inputs.source("redis")
    with pytest.raises(ValueError):
        outputs.sink("s3")
    assert inputs.source("kafka") and outputs.sink("hot")
    options = inputs.topic_options("h:9092", "logs", max_records=500)
    assert options["startingOffsets"] == "earliest" and options["maxOffsetsPerTrigger"] == "500"
    assert outputs.producer_options("h:9092")["kafka.acks"] == "all"
    assert fixed.RATE_LIMIT_PER_SECOND == 1000


def envelopes(spark, n=300):
    sources = F.array(*[F.lit(s) for s in ["nginx", "syslog", "sensor", "generic", "docker"]])
    return spark.range(n).select(
        F.col("id").cast("string").alias("event_id"),
        F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"),
        F.element_at(sources, (F.col("id") % 5 + 1).cast("int")).alias("source"),
        F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("tenant_id"),
        F.lit("svc").alias("service_name"),
        F.concat(F.lit("app: a=1 "), F.col("id").cast("string")).alias("raw_payload"),
        F.create_map(F.lit("k"), F.lit("v")).alias("metadata"),
    )


def test_hot_table_layout_replay_and_search(spark, tmp_path):
    path = str(tmp_path / "hot")
    rows = storage.hot_rows(transform.transform_logs(envelopes(spark)), NOW)
    outputs.write_hot(rows, path, batch_id=1)
    outputs.write_hot(rows, path, batch_id=1)
    outputs.write_hot(rows, path, batch_id=2)
    table = spark.read.parquet(path)
    assert table.count() == 600
    one = table.where("message = 'app: a=1 3' and batch_id = 1").first()
    assert one.metadata["app"] == "a" and one.metadata["k"] == "v"
    found = analytics.search(table, "t1", "1970-01-03 00:00:00", "1970-01-04 00:00:00", newest=5)
    plan = plan_of(found)
    assert "PartitionFilters: [isnotnull(event_date" in plan and "TakeOrdered" in plan
    assert found.count() == 5


def test_archive_days(spark, tmp_path):
    path = str(tmp_path / "cold")
    outputs.write_archive(storage.hot_rows(envelopes(spark), NOW), path)
    assert (tmp_path / "cold" / "year=1970" / "month=01" / "day=05").exists()
    assert spark.read.parquet(path).count() == 300
    with pytest.raises(ValueError):
        outputs.write_archive(envelopes(spark), path, by="moon")


# --- streams ---------------------------------------------------------------------------


def test_stream_equals_batch_and_is_repeatable(spark, tmp_path):
    landing = str(tmp_path / "landing")
    outputs.write_landing(envelopes(spark).repartition(4), landing)
    batch = transform.transform_logs(inputs.envelope_files(spark, landing))
    want = sorted((r.event_id, r.family, str(r.attributes)) for r in batch.collect())
    for _ in range(2):  # a second run finds nothing new
        flow = jobs.transform_stream(inputs.envelope_files(spark, landing, stream=True, max_files=1))
        jobs.run(flow, jobs.table_sink(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.event_id, r.family, str(r.attributes)) for r in out.collect()) == want
    assert out.select("batch_id").distinct().count() == 4


def test_stream_limiter_across_batches(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", 1, "1", 600), ("a", 3, "3", 1), ("a", 2, "2", 500), ("b", 1, "4", 5), ("a", 9, "0", 0)]
    make_arrivals(spark, rows[:1]).coalesce(1).write.mode("append").parquet(str(src))
    def go():
        flow = inputs.table_files(spark, str(src), stream=True)
        write = limiter.limit_batches(str(tmp_path / "totals"), str(tmp_path / "out"), limit=1000)
        jobs.run(flow, write, str(tmp_path / "cp")).awaitTermination(120)
    go()
    make_arrivals(spark, rows[1:]).coalesce(1).write.mode("append").parquet(str(src))
    go()
    got = {r.request_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": True, "2": False, "3": False, "4": True, "0": False}
    limiter.compact(spark, str(tmp_path / "totals"), str(tmp_path / "folded"))
    folded = {r.tenant_id: r.logs for r in limiter.totals(spark, str(tmp_path / "folded")).collect()}
    assert folded == {"a": 1101, "b": 5}


# --- routing and plans ----------------------------------------------------------------------


def test_routing_and_registration(spark):
    df = spark.createDataFrame([("NGINX",), ("",), (None,), ("what",), ("generic",)], "source string")
    got = {r.source: r.family for r in routing.route_v2(df).collect()}
    assert got == {"NGINX": "web", "": "system", None: "system", "what": "system", "generic": "custom"}
    mine = routing.V2.register("What", parsers_v2.IOT)
    got = {r.source: r.family for r in routing.route_v2(df, registry=mine).collect()}
    assert got["what"] == "iot"
    own = parsers_v2.WEB._replace(family="containers")
    lines = spark.createDataFrame([("docker", "plain"), ("mydocker", "plain")], "source string, raw_payload string")
    before = transform.transform_logs(lines.where("source = 'docker'")).first()
    after = {r.source: r for r in transform.transform_logs(lines, registry=routing.V2.register("mydocker", own)).collect()}
    assert after["docker"].attributes == before.attributes and after["docker"].family == after["mydocker"].family
    assert after["mydocker"].attributes != before.attributes
    missing = transform.transform_logs(df.withColumn("raw_payload", F.lit("a=1")))
    assert {r.source: r.family for r in missing.collect()}[None] == "custom"


def test_plans_stay_in_the_engine(spark):
    plan = plan_of(transform.transform_logs(envelopes(spark)))
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    for python_node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert python_node not in plan


def test_scratch_folder_is_named_by_the_session(spark):
    assert session.run_folder(spark, "x") != session.run_folder(spark, "x")


def test_client_time_and_ids(spark):
    log = [("m", None, t, None, None) for t in (7, 1712314200000, 1712314200000000, 1712314200000000000, -(2**63))]
    schema = schemas.REQUEST
    rows = [("1", "a|b", "c", None, None, None, log), ("1", "a", "b|c", None, None, None, log[:1]), ("2", "a", "b|c", None, None, None, log[:1])]
    out = intake.envelope(spark.createDataFrame(rows, schema), now=NOW).collect()
    assert len({r.event_id for r in out}) == 7
    assert [r.event_ts is None for r in out[:5]] == [False, True, True, True, True]
    assert [r.client_time_problem for r in out[:2]] == [None, "timestamp is not in seconds"] and out[1].client_time == 1712314200000
    with pytest.raises(ValueError):
        intake.envelope(spark.createDataFrame(rows, schema).drop("request_id"))


def test_settings_that_decide_results_are_required(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    try:
        with pytest.raises(ValueError):
            transform.transform_logs(envelopes(spark))
    finally:
        session.configure(spark)


def test_late_rows_are_counted_and_kept(spark, tmp_path):
    src, times = tmp_path / "in", ["2026-04-03 10:00:00", "2026-04-03 10:00:30", "2026-01-01 00:00:00"]
    for n, t in enumerate(times):
        rows = [(f"{n}-{i}", "t", "s") for i in range(10)] + [(f"{n}-0", "t", "s")]
        df = spark.createDataFrame(rows, "event_id string, tenant_id string, service string")
        df.withColumn("timestamp", F.lit(t).cast("timestamp")).coalesce(1).write.mode("append").parquet(str(src))
    flow = inputs.table_files(spark, str(src), stream=True, max_files=1)
    jobs.run(jobs.deduplicated(flow), jobs.table_sink(str(tmp_path / "once")), str(tmp_path / "cp1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "once")).count() == 30
    sink = jobs.counted_into(str(tmp_path / "rates"), jobs.rate_counts())
    jobs.run(flow, sink, str(tmp_path / "cp2")).awaitTermination(120)
    rates = jobs.summed(spark.read.parquet(str(tmp_path / "rates")), ["logs"])
    assert sorted(r.logs for r in rates.collect()) == [11, 22]
