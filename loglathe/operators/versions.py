"""Declared schemas of topics in versions, and messages judged by the version that they name.

A new version is taken only if it gets on with the one before it. `backward`: who reads by the new one can read messages of
the old one; `forward`: who reads by the old one can read messages of the new one; `full`: both; `none`: anything goes.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from json import loads

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.functions import json
from loglathe.operators import processing

RULES = ("backward", "forward", "full", "none")
# a value of the first kind can be read as one of these
_WIDER = {
    T.IntegerType: (T.LongType, T.FloatType, T.DoubleType),
    T.LongType: (T.FloatType, T.DoubleType),
    T.FloatType: (T.DoubleType,),
}


class Incompatible(ValueError):
    """A version that does not get on with the one before it; the reasons are its arguments."""


def _reads(reader: T.DataType, writer: T.DataType) -> bool:
    if isinstance(reader, T.StructType) and isinstance(writer, T.StructType):
        return not unreadable(reader, writer)
    if isinstance(reader, T.ArrayType) and isinstance(writer, T.ArrayType):
        return (reader.containsNull or not writer.containsNull) and _reads(reader.elementType, writer.elementType)
    if isinstance(reader, T.MapType) and isinstance(writer, T.MapType):
        return (reader.valueContainsNull or not writer.valueContainsNull) and _reads(reader.valueType, writer.valueType)
    return reader == writer or isinstance(reader, _WIDER.get(type(writer), ()))


def unreadable(reader: T.StructType, writer: T.StructType) -> list[str]:
    """Why messages that fit `writer` may not fit `reader`; empty if they always do.

    A field that only the writer has is ignored; one that only the reader has may not be required.
    """
    written = {f.name: f for f in writer.fields}
    found = []
    for f in reader.fields:
        old = written.get(f.name)
        if old is None:
            if not f.nullable:
                found.append(f"{f.name}: required and not written")
        elif not _reads(f.dataType, old.dataType):
            found.append(f"{f.name}: {old.dataType.simpleString()} is no {f.dataType.simpleString()}")
        elif old.nullable and not f.nullable:
            found.append(f"{f.name}: required and may be missing")
    return found


@dataclass(frozen=True)
class Versions:
    """Schemas of every topic, from version 1 on."""

    topics: Mapping[str, tuple[T.StructType, ...]] = field(default_factory=dict)

    def declare(self, topic: str, schema: T.StructType, rule: str = "backward") -> Versions:
        """With one version more; raises `Incompatible` if the rule forbids it. The same schema again is no new version."""
        if rule not in RULES:
            raise ValueError(f"unknown rule: {rule!r}")
        held = self.topics.get(topic, ())
        if held and held[-1] == schema:
            return self
        wrong = []
        if held and rule in ("backward", "full"):
            wrong += [f"new reader, old message: {x}" for x in unreadable(schema, held[-1])]
        if held and rule in ("forward", "full"):
            wrong += [f"old reader, new message: {x}" for x in unreadable(held[-1], schema)]
        if wrong:
            raise Incompatible(*wrong)
        return Versions({**self.topics, topic: (*held, schema)})

    def save(self, spark: SparkSession, path: str) -> None:
        """As a table (topic, version, schema)."""
        rows = [(t, n, s.json()) for t, held in self.topics.items() for n, s in enumerate(held, 1)]
        df = spark.createDataFrame(rows, "topic string, version int, schema string")
        df.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Versions:
        topics: dict[str, tuple[T.StructType, ...]] = {}
        for row in spark.read.parquet(path).orderBy("topic", "version").collect():
            topics[row.topic] = (*topics.get(row.topic, ()), T.StructType.fromJson(loads(row.schema)))
        return cls(topics)


def validate(
    df: DataFrame, versions: Versions, topic: str, value: str = "value", version_field: str = "schema_version"
) -> DataFrame:
    """Add `schema_version` and `schema_error`: the first field that does not fit the version that the message names.

    A message that names none is judged by the latest; a version that is not a whole number or not declared is an error.
    The message is parsed once, whatever the number of versions; keys that no version declares are ignored.
    """
    held = versions.topics.get(topic)
    if not held:
        raise ValueError(f"no schema of topic {topic!r}")
    names = list(dict.fromkeys([version_field, *[f.name for s in held for f in s.fields]]))
    read = df.withColumns({"__json": json.read_object(F.col(value), names)})
    read = read.withColumns({"__doc": json.whole_object(F.col("__json"))})
    doc = F.col("__doc")
    named = doc[version_field]
    absent = named.isNull() | json.is_json_null(named)
    whole = F.when(F.schema_of_variant(named) == "BIGINT", json.text_of(named).try_cast("bigint"))
    read = read.withColumns({"__version": F.when(doc.isNotNull(), F.when(absent, F.lit(len(held)).cast("bigint")).otherwise(whole))})
    version = F.col("__version")
    reason = F.when(doc.isNull(), "not a JSON object").when(version.isNull(), f"{version_field}: whole number expected")
    for n, schema in enumerate(held, 1):
        reason = reason.when(version == n, processing.violation(doc, schema))
    reason = reason.otherwise(F.concat(F.lit("schema version "), version.cast("string"), F.lit(" is not declared")))
    judged = read.withColumns({"schema_error": reason, "schema_version": version})
    return judged.drop("__json", "__doc", "__version")
