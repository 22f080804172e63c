"""Column groups of a frame, and one-row aggregates turned into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN becomes NULL."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floating:
        return df
    return df.select(*[
        F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floating else quoted(c)
        for c in df.columns
    ])


def rows_from(one_row: DataFrame, records: list[list[Column]], names: list[str]) -> DataFrame:
    """Turn a one-row aggregate into one row per record."""
    structs = [F.struct(*[v.alias(n) for v, n in zip(record, names)]) for record in records]
    return one_row.select(F.inline(F.array(*structs)))


def no_rows(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def text_cells(df: DataFrame, columns: list[str], value: str = "value") -> DataFrame:
    """(position, value): every cell of some columns as a row.

    Aggregates per column then run as one small set of expressions grouped by
    position, whatever the number of columns, and stay small enough to compile.
    """
    return df.select(F.posexplode(F.array(*[quoted(c).cast("string") for c in columns])).alias("position", value))


def number_cells(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """(n, position, value): the same for numeric columns, as doubles; n is how often the row counts."""
    n = F.lit(1).cast("long") if weight is None else quoted(weight)
    return df.select(
        n.alias("n"), F.posexplode(F.array(*[quoted(c).cast("double") for c in columns])).alias("position", "value"))


def tally(condition: Column, weight: str | None = None) -> Column:
    """How many rows a condition holds for; `weight` names a column that tells how often each row counts."""
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, quoted(weight))), F.lit(0))


def named_positions(columns: list[str]) -> Column:
    """The column name for a position."""
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col("position"))
