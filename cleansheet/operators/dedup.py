"""Whole-row duplicates and rows or columns without values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleansheet.operators.columns import quoted, rows_from

COPIES = "\u2063copies"
ROW_ORDER = "\u2063row_order"  # begins with an invisible character, so that no header cell is likely to be the same


def count_copies(df: DataFrame, order: Column | None = None) -> DataFrame:
    """Distinct rows with their number of copies and, if asked, first position.

    The partial aggregate folds the copies of a row inside each map task, so a
    row that makes up a third of the table costs one record per task.
    """
    aggregates = [F.count(F.lit(1)).alias(COPIES)]
    if order is not None:
        aggregates.append(F.min(order).alias(ROW_ORDER))
    keys = [c for c in df.columns if c != ROW_ORDER]
    return df.groupBy(*[quoted(c) for c in keys]).agg(*aggregates)


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def row_digest(df: DataFrame) -> Column:
    """SHA-256 over all cells, each written with its length so none can run together."""

    def cell(field: T.StructField) -> Column:
        c = quoted(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            text = (c + F.lit(0.0)).cast("string")
        elif isinstance(field.dataType, T.BinaryType):
            text = F.base64(c)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        else:
            text = c.cast("string")
        sized = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        return F.coalesce(sized, F.lit("~"))

    return F.unhex(F.sha2(F.concat(*[cell(f) for f in df.schema]), 256))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one.

    Rows with text travel as a 32-byte digest instead of whole.
    """
    wide = any(not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)) for f in df.schema)
    keys = [row_digest(df).alias("digest")] if wide else [quoted(c) for c in df.columns]
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(COPIES))
    return copies.agg(
        F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")
    )


def all_missing(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [quoted(c).isNull() for c in columns])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all")


def column_value_ranges(df: DataFrame) -> DataFrame:
    """Per column: how many values, and whether they are all one value.

    A column is constant when its least and greatest value are equal, so no
    distinct count and no shuffle of values is needed.
    """
    aggregates, records = [], []
    for i, c in enumerate(df.columns):
        aggregates += [
            F.count(quoted(c)).alias(f"n{i}"),
            F.min(quoted(c)).eqNullSafe(F.max(quoted(c))).alias(f"one{i}"),
        ]
        records.append([F.lit(i).cast("bigint"), F.lit(c), F.col(f"n{i}"), F.col(f"one{i}")])
    return rows_from(df.agg(*aggregates), records, ["position", "column_name", "n_values", "is_constant"])


def null_only_columns(df: DataFrame) -> DataFrame:
    aggregates = [F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    records = [[F.lit(c), F.col(f"n{i}")] for i, c in enumerate(df.columns)]
    counted = rows_from(df.agg(*aggregates), records, ["column_name", "n_values"])
    return counted.where("n_values = 0").select("column_name")


def constant_columns(df: DataFrame) -> DataFrame:
    return column_value_ranges(df).where("is_constant").select("column_name", "n_values")
