"""Numbers kept as text: recognising, classifying, parsing, printing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cleansheet.functions.text import CSV_NULL_TOKENS, trimmed

INTEGER = r"^\s*[+-]?\d+\s*$"
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
# As NUMBER, with `_` between digits and `nan` also taken as numbers.
LOOSE_NUMBER = (
    r"(?i)^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)$"
)
BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")

# What a cell can be read as. One bit each, so that a single bit_or per
# column tells which kinds occur in it.
MISSING = 1
INT64 = 2
NEGATIVE = 4
UINT64 = 8
HUGE_INT = 16
FLOAT = 32
BOOL = 64
TEXT = 128

_NUMBER_CHARS = " \t\n\x0b\f\r0123456789,.+-einftyEINFTY"
_LINE_ENDS = "\x85\u2028\u2029"  # `$` in a pattern stands before these, too

_INT64_MAX = "9223372036854775807"
_INT64_MIN = "-9223372036854775808"
_UINT64_MAX = "18446744073709551615"


def _has_number_ends(c: Column) -> Column:
    """Whether a text begins and ends as those do that can be numbers, commas taken out; few words do."""
    return F.substring(c, 1, 1).isin(*_NUMBER_CHARS) & F.substring(c, -1, 1).isin(*_NUMBER_CHARS, *_LINE_ENDS)


def is_number(c: Column) -> Column:
    return _has_number_ends(c) & c.rlike(NUMBER)


def number_class(c: Column) -> Column:
    """The kind bit of a cell known to be a number."""
    digits = F.trim(c)
    wide = digits.try_cast("decimal(38,0)")
    low, high, top = (F.lit(v).cast("decimal(38,0)") for v in (_INT64_MIN, _INT64_MAX, _UINT64_MAX))
    integer = (
        F.when(F.length(digits) <= 18, F.when(digits.startswith("-"), INT64 + NEGATIVE).otherwise(INT64))
        .when(wide.isNull() | (wide < low) | (wide > top), HUGE_INT)
        .when(wide > high, UINT64)
        .when(wide < 0, INT64 + NEGATIVE)
        .otherwise(INT64)
    )
    return F.when(c.rlike(INTEGER), integer).otherwise(FLOAT)


def cell_class(c: Column) -> Column:
    """The kind bit of a raw CSV cell."""
    return (
        F.when(c.isNull() | c.isin(*CSV_NULL_TOKENS), MISSING)
        .when(is_number(c), number_class(c))
        .when(c.isin(*BOOLEANS), BOOL)
        .otherwise(TEXT)
    )


def kind_of(bits: Column) -> Column:
    """Column kind from the kinds of its cells (the bit_or over them)."""
    seen = bits.bitwiseAND(~MISSING)
    nulls = bits.bitwiseAND(MISSING) != 0
    integers = INT64 + NEGATIVE + UINT64
    return (
        F.when(F.coalesce(seen, F.lit(0)) == 0, "float64")
        .when(seen.bitwiseAND(TEXT + HUGE_INT) != 0, "text")
        .when(seen == BOOL, F.when(nulls, "mixed_bool").otherwise("bool"))
        .when(seen.bitwiseAND(BOOL) != 0, "text")
        .when(seen.bitwiseAND(FLOAT) != 0, "float64")
        .when(
            seen.bitwiseAND(UINT64) != 0,
            F.when(nulls | (seen.bitwiseAND(NEGATIVE) != 0), "text").otherwise("uint64"),
        )
        .when(seen.bitwiseAND(~integers) == 0, F.when(nulls, "float64").otherwise("int64"))
        .otherwise("text")
    )


KIND_TO_TYPE = {
    "int64": "bigint",
    "uint64": "decimal(20,0)",
    "float64": "double",
    "bool": "boolean",
    "mixed_bool": "boolean",
    "text": "string",
}


def to_double(c: Column) -> Column:
    """Guarded parse: NULL for anything but a plain number."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def commas_dropped(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def without_commas(c: Column) -> Column:
    return trimmed(commas_dropped(c))


def number_text(c: Column) -> Column:
    """The text without separators if it can be a number, else NULL.

    Most words fail at their first or last letter, before a pattern is tried or anything rewritten.
    """
    return F.when(_has_number_ends(c) & c.rlike(r"(?i)^[\s\d,.+\-einfty]+$"), without_commas(c))


def looks_numeric(c: Column) -> Column:
    return trimmed(c).rlike(LOOSE_NUMBER)


def whole_milliseconds(seconds: Column) -> Column:
    return (seconds * 1000).cast("bigint")


def megabytes(n_bytes: Column) -> Column:
    return F.round(n_bytes / F.lit(1024.0 * 1024.0), 2)


def plain_double_text(c: Column) -> Column:
    """A double as text with a decimal point, scientific only when very large or small.

    Between a thousandth and ten million this is how a double is printed anyway; larger whole ones are printed as such.
    The rest stands in a function of its own: all of it in every printed column made code too long to be compiled.
    """
    size, whole = F.abs(c), c.try_cast("bigint")
    return (
        F.when((size >= 1e-3) & (size < 1e7), c.cast("string"))
        .when((size < 1e15) & (whole.cast("double") == c), F.concat(whole.cast("string"), F.lit(".0")))
        .otherwise(F.get(F.transform(F.array(c), _rare_double_text), F.lit(0)))
    )


def _rare_double_text(c: Column) -> Column:
    java, size = c.cast("string"), F.abs(c)
    digits = F.rtrim(c.try_cast("decimal(38,22)").cast("string"), F.lit("0"))
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.regexp_extract(java, "^(.*)E", 1), r"\.0$", "")
    power = F.regexp_extract(java, r"E(-?\d+)$", 1).try_cast("int")
    sign = F.when(power < 0, "e-").otherwise("e+")
    digits_of_power = F.abs(power).cast("string")
    padded = F.when(F.length(digits_of_power) < 2, F.lpad(digits_of_power, 2, "0")).otherwise(digits_of_power)
    return (
        F.when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when((size == 0) | ((size >= 1e-4) & (size < 1e16)), plain)
        .when(java.contains("E"), F.concat(mantissa, sign, padded))
        .otherwise(java)
    )
