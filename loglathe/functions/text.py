"""Text helpers: plain Column expressions, no Python on the rows.

Regex text follows Unicode classes (``(?U)``), a line break is only ``\\n``
(``(?d)``), and case-insensitive search is Unicode-aware.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE = "(?Ud)"
UNICODE_ICASE = "(?iUd)"


def pattern(text: str, icase: bool = False) -> str:
    return (UNICODE_ICASE if icase else UNICODE) + text


def found(col: Column, text: str, group: int = 0, icase: bool = False) -> Column:
    """First match of a pattern, ``''`` when there is none."""
    return F.regexp_extract(col, pattern(text, icase), group)


def first(col: Column, text: str, group: int = 0, icase: bool = False) -> Column:
    """First match of a pattern, NULL when there is none."""
    return F.nullif(found(col, text, group, icase), F.lit(""))


def every(col: Column, text: str, group: int = 0, icase: bool = False) -> Column:
    """All matches of a pattern as an array."""
    return F.regexp_extract_all(col, F.lit(pattern(text, icase)), F.lit(group))


def has_any(col: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def not_blank(col: Column) -> Column:
    """True when the text has at least one non-space character (NULL -> False)."""
    return F.coalesce(col.rlike(r"(?U)\S"), F.lit(False))


def trimmed(col: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def extension(path: Column) -> Column:
    """File extension with its dot, ``''`` if none; ``/.js`` has none."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]*)$", 1)


def priority_level(priority: Column) -> Column:
    """Syslog-style number to level; text that is not a number is INFO."""
    from loglathe import fixed

    number = priority.try_cast("int")
    return (
        F.when(number <= fixed.V1_PRIORITY_ERROR_MAX, "ERROR")
        .when(number == fixed.V1_PRIORITY_WARNING, "WARNING")
        .otherwise("INFO")
    )
