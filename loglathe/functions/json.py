"""JSON helpers on VARIANT: presence, truthiness and text of untyped values.

``read_object`` and ``whole_object`` parse one JSON object per row into a struct
of VARIANTs in a single pass.  In that struct an absent key is SQL NULL and an
explicit JSON null is a VARIANT null, and of duplicate keys the last one counts.
The two steps belong in two successive projections, so that the parse result
is computed once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = {"allowSingleQuotes": "false"}
_NO_NAN = {"allowNonNumericNumbers": "false"}
_OBJECT_HEAD = r"^[ \t\n\r]*\{"
_FALSY_JSON = ["null", "false", "0", "0.0", "-0.0", '""', "{}", "[]"]
_LIST_OR_TEXT_HEAD = r"^[ \t\n\r]*[\[\"]"
_NUMBER_OR_WORD = (
    r"^[ \t\n\r]*(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?"
    r"|true|false|null|NaN|-?Infinity)[ \t\n\r]*$"
)


def read_object(text: Column, keys: Iterable[str], allow_nan: bool = True) -> Column:
    """First step of reading named keys: parse to a two-element array.

    Spark's JSON parser stops after the first value, so ``{"a":1} tail`` would
    pass.  The object is therefore parsed as the first of exactly two array
    elements, the second being a closing mark that ``whole_object`` looks for.
    """
    members = ", ".join(f"`{k}`: variant" for k in keys)
    schema = f"array<struct<{members}, __end: boolean>>"
    options = _STRICT if allow_nan else {**_STRICT, **_NO_NAN}
    wrapped = F.concat(F.lit("["), text, F.lit(',{"__end":true}]'))
    return F.from_json(F.when(text.rlike(_OBJECT_HEAD), wrapped), schema, options)


def whole_object(parsed: Column) -> Column:
    """Second step: struct of VARIANTs, NULL unless the text was one JSON object."""
    return F.when((F.size(parsed) == 2) & F.get(parsed, F.lit(1))["__end"], F.get(parsed, F.lit(0)))


def read_document(text: Column) -> Column:
    """First step of reading a whole object of unknown keys."""
    wrapped = F.concat(F.lit("["), text, F.lit(",true]"))
    return F.from_json(
        F.when(text.rlike(_OBJECT_HEAD), wrapped), "array<variant>", {**_STRICT, **_NO_NAN}
    )


def whole_document(parsed: Column) -> Column:
    """Second step: the object as one VARIANT, NULL unless the text was one JSON object."""
    return F.when(F.size(parsed) == 2, F.get(parsed, F.lit(0)))


def non_object_kind(text: Column) -> Column:
    """Kind of a valid JSON value that is not an object; NULL for anything else."""
    head = F.regexp_extract(text, r"^[ \t\n\r]*(.)", 1)
    wrapped = F.concat(F.lit("["), text, F.lit(",true]"))
    parsed = F.from_json(
        F.when(text.rlike(_LIST_OR_TEXT_HEAD), wrapped), "array<variant>", _STRICT
    )
    return (
        F.when(F.size(parsed) == 2, F.when(head == "[", "list").otherwise("str"))
        .when(~text.rlike(_NUMBER_OR_WORD), F.lit(None).cast("string"))
        .when(head.isin("t", "f"), "bool")
        .when(head == "n", "NoneType")
        .when(text.rlike(r"[.eENI]"), "float")
        .otherwise("int")
    )


def text_of(value: Column) -> Column:
    """Text of a VARIANT: strings as they are, other values as JSON, null as NULL."""
    return F.when(~is_json_null(value), value.cast("string"))


def is_json_null(value: Column) -> Column:
    return F.coalesce(F.is_variant_null(value), F.lit(False))


def truthy(value: Column) -> Column:
    """False for absent, null, '', 0, false, {} and []; True for everything else."""
    return F.coalesce(~F.to_json(value).isin(_FALSY_JSON), F.lit(False))


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))


def first_truthy(*values: Column) -> Column:
    """Text of the first truthy value, NULL when there is none."""
    return F.coalesce(*[F.when(truthy(v), v.cast("string")) for v in values])


def truthy_or_present(first: Column, second: Column, default: str) -> Column:
    """First value if truthy, else the second as it is, else the default when absent."""
    return (
        F.when(truthy(first), first.cast("string"))
        .when(second.isNull(), F.lit(default))
        .otherwise(text_of(second))
    )


def child(value: Column, path: str) -> Column:
    """Nested member of a VARIANT, NULL when the path does not exist."""
    return F.try_variant_get(value, path, "variant")
