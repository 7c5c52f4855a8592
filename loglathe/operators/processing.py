"""Processing of raw messages: schema gate, contract, normalize, enrich, replay.

Each stage is a set of columns; a row that fails a stage keeps its text and the
reason, and is split off to the dead-letter table at the end.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe import schemas
from loglathe.functions import ids, json

_WHOLE_NUMBER = r"^\s*[+-]?[0-9]+(\.0+)?\s*$"


def _fits(value: Column, kind: T.DataType) -> Column:
    shape = F.schema_of_variant(value)
    if isinstance(kind, T.StringType):
        ok = shape == "STRING"
    elif isinstance(kind, (T.LongType, T.IntegerType)):
        ok = shape == "BIGINT"
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        ok = (shape == "BIGINT") | (shape == "DOUBLE") | shape.startswith("DECIMAL")
    elif isinstance(kind, T.BooleanType):
        ok = shape == "BOOLEAN"
    elif isinstance(kind, T.ArrayType):
        ok = shape.startswith("ARRAY<")
    else:
        ok = shape.startswith("OBJECT<")
    return F.coalesce(ok, F.lit(False))


def validate_schema(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Add ``schema_error``: the first field that does not fit the declared schema.

    Keys that are not declared are ignored.
    """
    read = df.withColumns({"__json": json.read_object(F.col(value), schema.names)})
    read = read.withColumns({"__doc": json.whole_object(F.col("__json"))})
    reason = F.when(F.col("__doc").isNull(), "not a JSON object").otherwise(violation(F.col("__doc"), schema))
    return read.withColumns({"schema_error": reason}).drop("__json", "__doc")


def violation(doc: Column, schema: T.StructType) -> Column:
    """The first field of a struct of VARIANTs that does not fit the schema; NULL if all do."""
    reason = None
    for field in schema.fields:
        member = doc[field.name]
        missing = member.isNull() | (json.is_json_null(member) if field.nullable else F.lit(False))
        wrong = ~_fits(member, field.dataType)
        bad = (~missing & wrong) if field.nullable else wrong
        said = f"{field.name}: expected {field.dataType.simpleString()}"
        reason = F.when(bad, said) if reason is None else reason.when(bad, said)
    return F.lit(None).cast("string") if reason is None else reason


def parse_contract(df: DataFrame, value: str = "value") -> DataFrame:
    """Raw-log columns of a JSON message and ``error``, NULL when the contract holds.

    Texts must be JSON strings.  The timestamp may be any whole number, also
    written as text or with a zero fraction, or a boolean.  Absent metadata is
    empty, null metadata breaks the contract.
    """
    read = df.withColumns({"__json": json.read_object(F.col(value), schemas.RAW_LOG.names)})
    read = read.withColumns({"__doc": json.whole_object(F.col("__json"))})
    doc = F.col("__doc")
    stamp = doc["timestamp"]
    stamp_text = json.text_of(stamp)
    stamp_number = F.when(
        F.schema_of_variant(stamp) == "BOOLEAN", F.when(stamp_text == "true", 1).otherwise(0)
    ).when(
        stamp_text.rlike(_WHOLE_NUMBER),
        F.regexp_extract(stamp_text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"),
    )
    metadata = F.when(
        doc["metadata"].isNull(), F.expr("map()").cast("map<string,string>")
    ).otherwise(F.try_variant_get(doc["metadata"], "$", "map<string,string>"))
    error = F.when(doc.isNull(), "not a JSON object")
    for name in ("tenant_id", "service"):
        error = error.when(~json.is_text(doc[name]), f"{name}: text required")
    error = (
        error.when(stamp_number.isNull(), "timestamp: whole number required")
        .when(~json.is_text(doc["message"]), "message: text required")
        .when(
            doc["metadata"].isNotNull() & ~json.is_object(doc["metadata"]),
            "metadata: object required",
        )
    )
    checked = read.withColumns({"error": error, "__ts": stamp_number})
    ok = F.col("error").isNull()
    texts = {
        name: F.when(ok, doc[name].cast("string")) for name in ("tenant_id", "service", "message")
    }
    return checked.withColumns(
        {**texts, "timestamp": F.when(ok, F.col("__ts")), "metadata": F.when(ok, metadata)}
    ).drop("__json", "__doc", "__ts")


def normalize(df: DataFrame) -> DataFrame:
    """Rename to tenant, service, ts, msg; lower-case the service; add the message length."""
    kept = [c for c in df.columns if c not in schemas.RAW_LOG.names]
    return df.select(
        *kept,
        F.col("tenant_id").alias("tenant"),
        F.lower("service").alias("service"),
        F.col("timestamp").alias("ts"),
        F.col("message").alias("msg"),
        F.coalesce(F.col("metadata"), F.expr("map()").cast("map<string,string>")).alias("metadata"),
        F.length("message").alias("msg_length"),
    )


def enrich(df: DataFrame) -> DataFrame:
    return df.withColumns({"tags": F.array(F.col("service"), F.lit("log"))})


def process_logs(
    df: DataFrame,
    value: str = "value",
    schema: T.StructType | None = None,
    metrics: Observation | None = None,
) -> DataFrame:
    """Gate, parse, normalize and enrich; ``error`` holds the reason of a failed row.

    ``metrics`` collects the processed and failed counts while the rows pass,
    without a second job.
    """
    gated = (
        validate_schema(df, schema, value)
        if schema is not None
        else df.withColumns({"schema_error": F.lit(None).cast("string")})
    )
    parsed = parse_contract(gated, value)
    parsed = parsed.withColumns({"error": F.coalesce(F.col("schema_error"), F.col("error"))})
    done = enrich(normalize(parsed.drop("schema_error")))
    if metrics is not None:
        failed = F.col("error").isNotNull()
        done = done.observe(
            metrics,
            F.sum(F.when(failed, 0).otherwise(1)).alias("processed_total"),
            F.sum(F.when(failed, 1).otherwise(0)).alias("failed_total"),
        )
    return done


def indexed_rows(processed: DataFrame, value: str = "value") -> DataFrame:
    return processed.where(F.col("error").isNull()).drop("error", value)


def dead_letters(
    processed: DataFrame,
    key: str = "event_id",
    value: str = "value",
    now: dt.datetime | str | Column | None = None,
) -> DataFrame:
    return processed.where(F.col("error").isNotNull()).select(
        key, F.col(value).alias("raw"), "error", ids.now_or(now).alias("failed_at")
    )


def replay(
    dead: DataFrame,
    indexed: DataFrame,
    repair: Callable[[Column], Column] | None = None,
    key: str = "event_id",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Run dead letters again and keep what now passes and is not indexed yet.

    A dead letter that is stored several times is replayed once.  Of the index
    only the keys of dead letters are looked at further.
    """
    once = dead.dropDuplicates([key])
    text = F.col("raw")
    again = once.select(key, (repair(text) if repair else text).alias("value"))
    passed = indexed_rows(process_logs(again, schema=schema))
    known = indexed.select(key).join(once.select(key), key, "left_semi")
    return passed.join(known, key, "left_anti")
