"""Text functions as Column expressions.

They follow Python string semantics (Unicode whitespace, universal line
breaks) with built-in Spark functions only, so they stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's str.isspace() is true.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java regex character class.
WHITESPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
# Fixed value: the line boundaries of Python's str.splitlines().
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used.

    Shared subexpressions are only found inside projections. Within
    generators, filters and lambdas this keeps a costly value from being
    computed at every mention.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def split_lines(text: Column) -> Column:
    """Array of lines; a final line break does not add an empty line."""
    return let(
        F.split(text, LINE_BREAK),
        lambda parts: F.slice(parts, F.lit(1), _whole_lines(parts)),
    )


def line_count(text: Column) -> Column:
    return let(F.split(text, LINE_BREAK), _whole_lines)


def _whole_lines(parts: Column) -> Column:
    return F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(filename: Column) -> Column:
    """Lower-case extension with its dot; '' if there is none.

    Leading dots belong to the name, so ``.profile`` has no extension.
    """
    return F.lower(F.regexp_extract(filename, r"(?s)[^.].*(\.[^.]*)\z", 1))


def type_name(file_type: Column) -> Column:
    """File type without its leading dot, lower case: ``.CSV`` -> ``csv``."""
    return F.regexp_replace(F.lower(file_type), r"^\.", "")


def size_label(size: Column) -> Column:
    """Size in B, KB or MB at steps of 1024, one decimal above bytes."""
    kib = 1024

    def scaled(unit: int, pattern: str) -> Column:
        # ties to even, which format_string alone would round up
        return F.format_string(pattern, F.bround(size / F.lit(float(unit)), 1))

    return (
        F.when(size < kib, F.format_string("%d B", size.cast("long")))
        .when(size < kib * kib, scaled(kib, "%.1f KB"))
        .otherwise(scaled(kib * kib, "%.1f MB"))
    )


def shorten(text: Column, limit: int, tail: str = "...") -> Column:
    """At most ``limit`` characters, plus a mark when something was cut."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(tail))
    ).otherwise(text)


def table_name(name: Column) -> Column:
    """A name that is safe as an SQL identifier."""
    last = F.regexp_extract(F.regexp_replace(name, r"(?:/+\.?)+\z", ""), r"([^/]*)\z", 1)
    base = F.when(name.contains("/"), last).otherwise(name)
    body = F.btrim(F.regexp_replace(F.lower(base), r"[^a-z0-9]+", "_"), F.lit("_"))
    safe = F.when(body.rlike(r"^[a-z]"), body).otherwise(F.concat(F.lit("t_"), body))
    return F.when(F.length(safe) > 2, safe).otherwise(F.lit("dataset"))


def decode_utf8(content: Column) -> Column:
    """Bytes as text without checking them; see :func:`is_utf8`."""
    return content.cast("string")


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def decode_lossy(content: Column) -> Column:
    """Bytes as text, malformed sequences replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))
