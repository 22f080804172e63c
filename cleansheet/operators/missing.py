"""Missing-value tokens and filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleansheet.functions.text import UNKNOWN, csv_nulls, is_missing_token, trimmed, without_missing_tokens
from cleansheet.operators.columns import named_positions, numeric_columns, quoted, text_cells, text_columns
from cleansheet.operators.frequency import column_modes
from cleansheet.operators.quantiles import exact_quantiles


def apply_to_text(df: DataFrame, function) -> DataFrame:
    """The same expression over every text column."""
    texts = set(text_columns(df))
    return df.select(*[function(quoted(c)).alias(c) if c in texts else quoted(c) for c in df.columns])


def null_csv_tokens(df: DataFrame) -> DataFrame:
    return apply_to_text(df, csv_nulls)


def trim_strings(df: DataFrame) -> DataFrame:
    return apply_to_text(df, trimmed)


def null_missing_tokens(df: DataFrame) -> DataFrame:
    return apply_to_text(df, without_missing_tokens)


def missing_token_counts(df: DataFrame) -> DataFrame:
    """(column_name, tokens) per text column."""
    columns = text_columns(df)
    return (
        text_cells(df, columns)
        .groupBy("position")
        .agg(F.count_if(is_missing_token(F.col("value"))).alias("tokens"))
        .select(named_positions(columns).alias("column_name"), "tokens")
    )


def fill_with_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric columns: NULL becomes the median; a column without values stays."""
    columns = numeric_columns(df) if columns is None else columns
    medians = {c: q[0] for c, q in exact_quantiles(df, columns, (0.5,)).items() if q[0] is not None}
    return df.select(*[
        F.coalesce(quoted(c).cast("double"), F.lit(medians[c])).alias(c) if c in medians else quoted(c)
        for c in df.columns
    ])


def fill_with_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns: NULL becomes the most frequent value, or a marker if there is none."""
    columns = text_columns(df) if columns is None else columns
    modes = {r["column_name"]: r["mode_value"] for r in column_modes(df, columns).collect()}
    return df.select(*[
        F.coalesce(quoted(c), F.lit(modes.get(c, UNKNOWN))).alias(c) if c in columns else quoted(c)
        for c in df.columns
    ])
