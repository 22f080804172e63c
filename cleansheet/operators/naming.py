"""Uniform column names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cleansheet.functions.text import snake_case_name


def standard_names(names: list[str]) -> list[str]:
    """Snake case, and unique: repeats get the next free `_2`, `_3`, ..."""
    taken: set[str] = set()
    result = []
    for name in names:
        base = snake_case_name(name)
        fresh, n = base, 1
        while fresh in taken:
            n += 1
            fresh = f"{base}_{n}"
        taken.add(fresh)
        result.append(fresh)
    return result


def standardize_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The renamed frame and the names that changed."""
    names = standard_names(df.columns)
    changed = {old: new for old, new in zip(df.columns, names) if old != new}
    return (df.toDF(*names) if changed else df), changed
