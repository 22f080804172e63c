"""Text expressions: trimming, missing tokens, names, canonical categories."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as whitespace, plus the four
# ASCII separators 1C-1F.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WS_CLASS = r"[\s\x1c-\x1f]"

# Cell texts a CSV reader takes as missing, untrimmed.
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Texts that cleaning takes as missing, once trimmed.
MISSING_TOKENS = ("", " ", "NA", "N/A", "NULL", "null", "None", "-")

# Category sets whose letter case is made uniform.
CATEGORY_SETS = (("Male", "Female"), ("Yes", "No"), ("True", "False"))

UNKNOWN = "Unknown"


def trimmed(c: Column) -> Column:
    """Without outer white space. The search for all of it is slow; it is left out where cutting spaces bares visible ASCII."""
    t = F.trim(c)
    bare = (t >= "!") & (t < "\x7f") & F.substring(t, -1, 1).between("!", "~")
    return F.when(bare, t).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def csv_nulls(c: Column) -> Column:
    return F.when(~c.isin(*CSV_NULL_TOKENS), c)


def is_missing_token(c: Column) -> Column:
    return F.coalesce(trimmed(c).isin(*MISSING_TOKENS), F.lit(False))


def without_missing_tokens(c: Column) -> Column:
    return F.when(~trimmed(c).isin(*MISSING_TOKENS), c)


def trimmed_value(c: Column) -> Column:
    """Trimmed, and NULL for a missing token."""
    return known_value(trimmed(c))


def known_value(t: Column) -> Column:
    """A trimmed text, and NULL for a missing token."""
    return F.when(~t.isin(*MISSING_TOKENS), t)


def collapsed(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U){_WS_CLASS}+", " ")


def snake_case(c: Column) -> Column:
    """Names in a table, as snake case."""
    kept = F.regexp_replace(trimmed(c), r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", "")
    joined = F.regexp_replace(trimmed(kept), f"(?U)({_WS_CLASS}|_)+", "_")
    named = F.btrim(F.lower(joined), F.lit("_"))
    return F.when(named == "", "column").otherwise(named)


def snake_case_name(name: str) -> str:
    """One name, on the driver (column names are metadata)."""
    kept = "".join(ch for ch in name if ch.isalnum() or ch == "_" or ch.isspace())
    return "_".join(re.split(r"[\s_]+", kept)).lower().strip("_") or "column"


def canonical_category(c: Column, members: tuple[str, ...]) -> Column:
    """Map every member to its canonical case; other values stay."""
    cases = F.create_map(*[F.lit(text) for member in members for text in (member.lower(), member)])
    return F.coalesce(F.try_element_at(cases, F.lower(trimmed(c))), c)


def in_category_set(c: Column, members: tuple[str, ...]) -> Column:
    return F.lower(trimmed(c)).isin(*[m.lower() for m in members])


def shortened(c: Column, width: int = 100) -> Column:
    """The text up to a width, marked with dots where cut."""
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("..."))).otherwise(c)


def safe_file_name(c: Column) -> Column:
    """Base name without extension, reduced to letters, digits, `_`, `.`, `-`."""
    base = F.regexp_extract(F.regexp_replace(c, "/+$", ""), r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=[^.])\.[^.]+$", "")
    safe = F.btrim(F.regexp_replace(stem, "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.when(safe == "", "upload").otherwise(safe)
