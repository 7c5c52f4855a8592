import pyarrow as pa
import pytest

import corpus_pipeline
from loglathe import session
from loglathe.llm import katz, queries

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
READ = "spark.sql.parquet.columnarReaderBatchSize"


@pytest.fixture
def as_given(spark):
    """Spark's own bound, whatever ran before."""
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, "64MB")
    yield spark
    spark.conf.set(KEY, before)


def test_no_large_batch_goes_to_a_worker(as_given, tmp_path):
    spark = as_given
    spark.range(3000).selectExpr("id as doc_id", "repeat(char(65 + id % 26), 10000) as text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    got = queries._table(spark, str(tmp_path), "documents").mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 3000
    assert max(r.bytes for r in got) <= 1.05 * session.ARROW_BYTES


def test_stages_of_the_pipeline_bound_their_batches(as_given):
    spark = as_given
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert int(spark.conf.get(KEY).rstrip("bB")) <= session.ARROW_BYTES
    spark.conf.set(KEY, "1000")  # a smaller bound of the caller stays
    assert session.small_batches(spark).conf.get(KEY).rstrip("bB") == "1000"


def test_packed_tables_are_read_row_by_row(spark, monkeypatch):
    """The tables of a model have rows of megabytes: their readers hold one at a time."""
    docs = spark.createDataFrame([(i, "a b c") for i in range(40)], "doc_id long, text string")
    seen, stored, before = {}, katz.stored, spark.conf.get(READ)
    monkeypatch.setattr(katz, "stored", lambda df, name="step", **o: seen.update({name: spark.conf.get(READ)}) or stored(df, name, **o))
    katz.train(docs)
    assert seen["answers"] == seen["grams-2"] == "1"
    assert spark.conf.get(READ) == before
