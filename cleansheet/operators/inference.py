"""Column types of an all-text table, found from the cells themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleansheet.functions.numbers import BOOLEANS, KIND_TO_TYPE, cell_class, kind_of, to_double
from cleansheet.functions.text import csv_nulls
from cleansheet.operators.columns import named_positions, quoted, text_cells


def column_kinds(df: DataFrame) -> DataFrame:
    """(column_name, kind) from one scan: a bit_or of cell kinds per text column."""
    return (
        text_cells(df, df.columns)
        .groupBy("position")
        .agg(F.bit_or(cell_class(F.col("value"))).alias("bits"))
        .select(
            F.col("position").cast("bigint").alias("position"), named_positions(df.columns).alias("column_name"),
            kind_of(F.col("bits")).alias("kind"),
        )
    )


def as_kind(c: Column, kind: str) -> Column:
    """A raw cell in its column's type; missing tokens become NULL."""
    cell = csv_nulls(c)
    if kind == "text":
        return cell
    if kind in ("bool", "mixed_bool"):
        return F.when(cell.isin(*BOOLEANS), F.lower(cell) == "true")
    if kind == "float64":
        return to_double(cell)
    return F.trim(cell).try_cast(KIND_TO_TYPE[kind])


def with_kinds(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.select(*[as_kind(quoted(c), kinds[c]).alias(c) if c in kinds else quoted(c) for c in df.columns])
