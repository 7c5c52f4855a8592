"""How a parser job is declared and how jobs run over a table.

A parser is a set of Column expressions in successive projections:

* ``stages`` find things in the line (regex matches, parsed JSON).  Each match
  becomes a column of its own projection, so it is computed once however many
  outputs read it.
* ``outputs`` derive the typed result columns from those matches.

The same declaration serves one family over a whole table (``parse_one``) and a
table of mixed families in one pass (``parse_mixed``), where every expression
sits behind its family's condition and a row pays for its own family only.
Everything is map-side: no shuffle and no Python on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe import session
from loglathe.functions import maps

Columns = dict[str, Column]


class Line(NamedTuple):
    """The raw line with its upper- and lower-case forms, each computed once."""

    raw: Column
    upper: Column
    lower: Column


class Found:
    """Columns computed by the earlier stages of one parser."""

    def __init__(self, prefix: str) -> None:
        self._prefix = prefix

    def __getattr__(self, name: str) -> Column:
        return F.col(f"{self._prefix}{name}")


Stage = Callable[[Line, Found], Columns]


class Parser(NamedTuple):
    """One parser job. ``error`` is a reason text, NULL when the line parsed."""

    family: str
    stages: tuple[Stage, ...]
    outputs: Stage
    error: Callable[[Line, Found], Column] | None = None
    attributes: Callable[[Columns], Column] | None = None

    def attribute_map(self, outputs: Columns) -> Column:
        return self.attributes(outputs) if self.attributes else maps.text_map(outputs)


def current_line() -> Line:
    return Line(F.col("__raw"), F.col("__upper"), F.col("__lower"))


def found_by(key: str) -> Found:
    """Columns that the stages of the parser with this key have made."""
    return Found(f"__{key}_")


def run_stages(
    df: DataFrame, text: Column, parsers: Mapping[str, Parser], family: Column | None
) -> DataFrame:
    session.require(df.sparkSession)
    df = df.withColumns({"__raw": text})
    df = df.withColumns({"__upper": F.upper("__raw"), "__lower": F.lower("__raw")})
    line = current_line()
    depth = max(len(p.stages) for p in parsers.values())
    for step in range(depth):
        columns: Columns = {}
        for name, parser in parsers.items():
            if step < len(parser.stages):
                for key, value in parser.stages[step](line, found_by(name)).items():
                    guarded = value if family is None else F.when(family == name, value)
                    columns[f"__{name}_{key}"] = guarded
        df = df.withColumns(columns)
    return df


def without_helpers(df: DataFrame, given: list[str]) -> DataFrame:
    """Drop the columns of the stages; those the caller came with stay."""
    return df.drop(*[c for c in df.columns if c.startswith("__") and c not in given])


def parse_one(
    df: DataFrame, parser: Parser, text: str = "raw_payload", into: str = "attributes"
) -> DataFrame:
    """Typed result of one family as a struct column, plus ``parse_error``."""
    staged = run_stages(df, F.col(text), {parser.family: parser}, None)
    line, found = current_line(), found_by(parser.family)
    outputs = parser.outputs(line, found)
    result = F.struct(*[c.alias(n) for n, c in outputs.items()])
    error = parser.error(line, found) if parser.error else F.lit(None).cast("string")
    staged = staged.withColumns({"parse_error": error})
    if parser.error:
        result = F.when(F.col("parse_error").isNull(), result)
    return without_helpers(staged.withColumns({into: result}), df.columns)


def parse_mixed(
    df: DataFrame,
    parsers: Mapping[str, Parser],
    family: str = "family",
    text: str | Column = "raw_payload",
    into: str = "attributes",
) -> DataFrame:
    """String-map result of each row's own family, plus ``parse_error``."""
    source = F.col(text) if isinstance(text, str) else text
    staged = run_stages(df, source, parsers, F.col(family))
    line = current_line()
    result = F.lit(None).cast("map<string,string>")
    error = F.lit(None).cast("string")
    for name, parser in parsers.items():
        found = found_by(name)
        mine = F.col(family) == name
        result = F.when(mine, parser.attribute_map(parser.outputs(line, found))).otherwise(result)
        if parser.error:
            error = F.when(mine, parser.error(line, found)).otherwise(error)
    staged = staged.withColumns({"parse_error": error, into: result})
    if any(p.error for p in parsers.values()):
        staged = staged.withColumns({into: F.when(F.col("parse_error").isNull(), F.col(into))})
    return without_helpers(staged, df.columns)
