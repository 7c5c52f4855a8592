from pyspark.sql import functions as F

from loglathe import session
from loglathe.operators import admission
from loglathe.plans import flow_queries

SF = "/root/testdata/sf0.001"


def test_requests_are_decoded_once(spark, monkeypatch):
    plans = []
    limit = admission.rate_limit

    def noted(df, **more):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return limit(df, **more)

    monkeypatch.setattr(admission, "rate_limit", noted)
    session.configure(spark)
    flow_queries.request_to_message(spark, SF).collect()
    assert len(plans) == 1 and "from_json" not in plans[0]


def test_files_of_a_micro_batch_grow_with_its_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "TASK_ROWS", 100, raising=False)
    df = spark.range(3000).withColumn("part", F.col("id") % 4)
    flow = flow_queries.in_batches(df, f"{tmp_path}/in", F.col("part"))
    stored = spark.read.schema(flow.schema).parquet(f"{tmp_path}/in")
    assert sorted(r[0] for r in stored.select("id").collect()) == list(range(3000))
    assert len(stored.inputFiles()) == 45  # 15 in each of three, as the last holds 1,500 rows
