"""Map helpers over MAP<STRING, STRING>."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value: Column) -> Column:
    return value.cast("string")


def text_map(values: Mapping[str, Column]) -> Column:
    """Fixed set of named values as a string map."""
    return F.map_from_arrays(
        F.array(*[F.lit(k) for k in values]), F.array(*[text(v) for v in values.values()])
    )


def present(entries: Column) -> Column:
    """Drop entries without a value."""
    return F.map_filter(entries, lambda k, v: v.isNotNull())


def non_empty(entries: Column) -> Column:
    """Drop entries whose value is missing or the empty string."""
    return F.map_filter(entries, lambda k, v: F.coalesce(v != "", F.lit(False)))


def merge(left: Column, right: Column) -> Column:
    """Both maps in one; on a shared key the right one wins.

    ``right`` is read for every entry of ``left``: pass a column or a literal
    map, not an expensive expression.
    """
    return F.map_concat(
        F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k)), right
    )


def override(left: Column, values: Mapping[str, Column]) -> Column:
    """Map with the named values set, replacing entries of the same name."""
    return F.map_concat(
        F.map_filter(left, lambda k, v: ~k.isin(list(values))), text_map(values)
    )


def sorted_pairs(pairs: Column) -> Column:
    """First step of ``last_wins``: [key, value] arrays ordered by key and position."""
    return F.sort_array(
        F.transform(
            pairs,
            lambda p, i: F.struct(
                F.lower(F.get(p, F.lit(0))).alias("k"), i.alias("i"), F.get(p, F.lit(1)).alias("v")
            ),
        )
    )


def last_wins(ordered: Column) -> Column:
    """Second step: map in which the last value of a repeated key counts.

    With the pairs sorted, a line with n pairs costs n log n and not n squared.
    ``ordered`` must be a column of an earlier projection.
    """
    kept = F.filter(
        ordered, lambda x, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1)["k"] != x["k"])
    )
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"])))
