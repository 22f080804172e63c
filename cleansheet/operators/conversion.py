"""Text columns that hold numbers, dates or known categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleansheet.functions import dates, numbers
from cleansheet.functions.text import CATEGORY_SETS, canonical_category, collapsed, in_category_set
from cleansheet.operators.columns import named_positions, no_rows, quoted, text_cells, text_columns
from cleansheet.operators.missing import apply_to_text

SUCCESS_SHARE = 0.9


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def parse_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n_values, numeric_ratio, date_ratio) over non-null texts."""
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return no_rows(df, "column_name string, n_values bigint, numeric_ratio double, date_ratio double")
    value, n = F.col("value"), F.col("n_values")
    counted = (
        text_cells(df, columns)
        .groupBy("position")
        .agg(
            F.count(value).alias("n_values"),
            F.count_if(numbers.number_text(value).rlike(numbers.NUMBER)).alias("n_numbers"),
            F.count(dates.parse_any(value)).alias("n_dates"),
        )
    )
    return counted.select(
        named_positions(columns).alias("column_name"), "n_values",
        _share(F.col("n_numbers"), n).alias("numeric_ratio"), _share(F.col("n_dates"), n).alias("date_ratio"),
    )


def number_type(bits: int, failed: int) -> str:
    """Type of a converted column: whole numbers stay whole unless something was lost."""
    if failed or bits & ~(numbers.INT64 + numbers.NEGATIVE + numbers.UINT64):
        return "double"
    if bits & numbers.UINT64:
        return "double" if bits & numbers.NEGATIVE else "decimal(20,0)"
    return "bigint"


def parse_number(c: Column, target: str) -> Column:
    return plain_number(numbers.without_commas(c), target)


def plain_number(plain: Column, target: str) -> Column:
    """As `parse_number`, for a trimmed text without separators."""
    return numbers.to_double(plain) if target == "double" else plain.try_cast(target)


def to_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Convert text columns of which at least 90 % reads as a number."""
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return df
    plain = F.col("plain")
    found = (
        text_cells(df, columns)
        .where(F.col("value").isNotNull())
        .withColumn("plain", numbers.number_text(F.col("value")))
        .withColumn("number", numbers.to_double(plain))
        .groupBy("position")
        .agg(
            F.count("value").alias("n"), F.count("number").alias("ok"),
            F.coalesce(F.bit_or(F.when(F.col("number").isNotNull(), numbers.number_class(plain))), F.lit(0)).alias("bits"),
        )
    )
    targets = {
        columns[r["position"]]: number_type(r["bits"], r["n"] - r["ok"])
        for r in found.collect()
        if r["ok"] / r["n"] >= SUCCESS_SHARE
    }
    return df.select(*[
        parse_number(quoted(c), targets[c]).alias(c) if c in targets else quoted(c) for c in df.columns
    ])


def first_values(df: DataFrame, order: Column, columns: list[str]) -> DataFrame:
    """One row: the first non-null value of each column in the given order."""
    return df.agg(*[
        F.min_by(quoted(c), F.when(quoted(c).isNotNull(), order)).alias(c) for c in columns
    ])


def to_datetime(df: DataFrame, order: Column, columns: list[str] | None = None) -> DataFrame:
    """Convert text columns of which at least 90 % parses in the first value's format.

    When the first value has no known format, each value is tried on its own.
    """
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return df
    firsts = first_values(df, order, columns)
    formats = firsts.select(*[dates.first_format(quoted(c)).alias(f"f{i}") for i, c in enumerate(columns)]).first()
    counted = df.agg(*[
        agg
        for i, c in enumerate(columns)
        for agg in (
            F.count(quoted(c)).alias(f"n{i}"),
            F.count(dates.parse_column(quoted(c), formats[i])).alias(f"ok{i}"),
        )
    ]).first()
    chosen = {
        c: formats[i]
        for i, c in enumerate(columns)
        if counted[f"n{i}"] and counted[f"ok{i}"] / counted[f"n{i}"] >= SUCCESS_SHARE
    }
    return df.select(*[
        dates.parse_column(quoted(c), chosen[c]).alias(c) if c in chosen else quoted(c) for c in df.columns
    ])


def category_columns(df: DataFrame, columns: list[str] | None = None) -> dict[str, tuple[str, ...]]:
    """Columns whose every value belongs to one known category set."""
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return {}
    found = df.agg(*[
        F.bool_and(in_category_set(quoted(c), members)).alias(f"s{i}_{k}")
        for i, c in enumerate(columns)
        for k, members in enumerate(CATEGORY_SETS)
    ]).first()
    return {
        c: members
        for i, c in enumerate(columns)
        for k, members in reversed(list(enumerate(CATEGORY_SETS)))
        if found[f"s{i}_{k}"]
    }


def canonical_categories(df: DataFrame) -> DataFrame:
    chosen = category_columns(df)
    return df.select(*[
        canonical_category(quoted(c), chosen[c]).alias(c) if c in chosen else quoted(c) for c in df.columns
    ])


def collapse_whitespace(df: DataFrame) -> DataFrame:
    return apply_to_text(df, collapsed)


def as_export_text(df: DataFrame) -> DataFrame:
    """Converted dates as YYYY-MM-DD text, missing dates as empty text."""
    stamps = {name for name, kind in df.dtypes if kind in ("timestamp", "timestamp_ntz", "date")}
    return df.select(*[
        dates.as_day_text(quoted(c)).alias(c) if c in stamps else quoted(c) for c in df.columns
    ])
