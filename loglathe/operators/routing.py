"""Routing of sources to parser families."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe import fixed
from loglathe.operators import parsers_v1, parsers_v2
from loglathe.operators.parsing import Parser

# a routing table of this many keys is a few hundred kilobytes at most
BROADCAST_KEYS = 10_000


@dataclass(frozen=True)
class Registry:
    """Routing table of one dialect together with its parsers.

    Sources lead to parser keys.  The key of a built-in parser is its family; a
    registered one has a key of its own, so that it serves its source only.
    """

    sources: Mapping[str, str]
    default: str
    parsers: Mapping[str, Parser] = field(repr=False)

    def register(self, source: str, parser: Parser) -> Registry:
        """New registry in which ``source``, and no other, goes to ``parser``; the last one wins.

        A parser may wrap a user's ``pandas_udf``: its stages are only Columns.
        """
        held = [k for k, p in self.parsers.items() if p is parser]
        key = held[0] if held else f"{parser.family}_{len(self.parsers)}"
        return Registry({**self.sources, source.lower(): key}, self.default, {**self.parsers, key: parser})

    def family(self, key: str) -> str:
        return self.parsers[key].family if key in self.parsers else key

    def table(self, df: DataFrame) -> DataFrame:
        """The routing table as a DataFrame (``route_key``, ``parser_key``, ``family``)."""
        rows = [(source, key, self.family(key)) for source, key in self.sources.items()]
        return df.sparkSession.createDataFrame(rows, "route_key string, parser_key string, family string")


def _flat(groups: Mapping[str, list[str]]) -> dict[str, str]:
    return {source: family for family, sources in groups.items() for source in sources}


V2 = Registry(_flat(fixed.V2_SOURCES), fixed.V2_DEFAULT_FAMILY, parsers_v2.PARSERS)
V1 = Registry(_flat(fixed.V1_SOURCES), fixed.V1_DEFAULT_FAMILY, parsers_v1.PARSERS)


def route(df: DataFrame, key: Column, registry: Registry = V2) -> DataFrame:
    """Add ``family`` and ``parser_key`` for the routing key; empty, NULL and unknown keys go to the default."""
    table = registry.table(df)
    if len(registry.sources) <= BROADCAST_KEYS:
        table = F.broadcast(table)
    routed = df.withColumns({"route_key": F.lower(key)}).join(table, "route_key", "left")
    default = F.lit(registry.default)
    return routed.withColumns(
        {
            "family": F.coalesce(F.col("family"), F.lit(registry.family(registry.default))),
            "parser_key": F.coalesce(F.col("parser_key"), default),
        }
    ).drop("route_key")


def route_v2(df: DataFrame, source: str = "source", registry: Registry = V2) -> DataFrame:
    return route(df, F.col(source), registry)


def v1_source(df: DataFrame, source: str = "source", service: str = "service") -> Column:
    """Source if it has text, else the service, else ``generic``."""
    empty = F.lit("")
    return F.coalesce(
        F.nullif(F.col(source), empty), F.nullif(F.col(service), empty), F.lit("generic")
    )


def route_v1(
    df: DataFrame, source: str = "source", service: str = "service", registry: Registry = V1
) -> DataFrame:
    return route(df, v1_source(df, source, service), registry)
