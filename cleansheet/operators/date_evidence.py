"""How a column writes its dates, judged on all its values.

A single value often leaves open whether the day or the month comes first, and
which century a year of two digits means. The column as a whole mostly does
not: the order that more values can be read in is taken (month first on a tie),
and two-digit years are the latest ones not beyond the greatest year that the
column writes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleansheet.functions import dates
from cleansheet.operators.columns import named_positions, no_rows, quoted, text_cells, text_columns
from cleansheet.operators.conversion import SUCCESS_SHARE

_SCHEMA = (
    "column_name string, n_values bigint, n_dates bigint, day_first boolean, last_year int, "
    "shapes array<struct<shape: string, n: bigint>>"
)


def date_shapes(cells: DataFrame) -> DataFrame:
    """(position, shape, n, as_month_first, as_day_first, year): a histogram of shapes over (position, value) cells.

    Texts that are no dates share the shape NULL. The counts say how many
    values each reading takes, `year` is the greatest one written out. Equal
    texts are read once, and shapes are named once for texts that differ in
    digits only; no text that travels is longer than a date can be.
    """
    value, skeleton = F.col("value"), F.col("skeleton")
    texts = cells.where(value.isNotNull()).select("position", F.when(dates.is_date_like(value), value).alias("value"))
    texts = texts.groupBy("position", "value").agg(F.count("*").alias("n"))
    read = texts.withColumn("skeleton", dates.skeleton(value)).withColumn("month_first", dates.parse_any(value, F.lit(False)))
    read = read.withColumn("day_first", F.when(
        dates.order_matters(value), dates.parse_any(value, F.lit(True))).otherwise(F.col("month_first")))
    alike = read.groupBy("position", "skeleton").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("month_first").isNotNull(), F.col("n"))).alias("as_month_first"),
        F.sum(F.when(F.col("day_first").isNotNull(), F.col("n"))).alias("as_day_first"),
        F.max(dates.written_year(value)).alias("year"))
    return alike.groupBy("position", dates.shape(skeleton).alias("shape")).agg(
        F.sum("n").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("as_month_first", "as_day_first")],
        F.max("year").alias("year"))


def date_evidence(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n_values, n_dates, day_first, last_year, shapes) per text column that has values."""
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return no_rows(df, _SCHEMA)
    found = date_shapes(text_cells(df, columns)).groupBy("position").agg(
        F.sum("n").alias("n_values"), F.sum("as_month_first").alias("months"), F.sum("as_day_first").alias("days"),
        F.coalesce(F.max("year"), F.lit(dates.LAST_YEAR)).alias("last_year"),
        F.array_sort(F.collect_list(F.when(F.col("shape").isNotNull(), F.struct("shape", "n")))).alias("shapes"))
    return found.select(
        named_positions(columns).alias("column_name"), "n_values", F.greatest("months", "days").alias("n_dates"),
        (F.col("days") > F.col("months")).alias("day_first"), "last_year", "shapes")


def decided(evidence: DataFrame, share: float = SUCCESS_SHARE) -> dict[str, tuple[bool, int]]:
    """Day first and last year of the columns of which enough values are dates."""
    return {
        r["column_name"]: (r["day_first"], r["last_year"])
        for r in evidence.where(F.col("n_dates") >= F.lit(share) * F.col("n_values")).collect()
    }


def read(c: Column, day_first: bool, last_year: int) -> Column:
    return dates.parse_any(c, F.lit(day_first), last_year)


def to_datetime_by_evidence(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Convert text columns of which at least 90 % reads as dates in the order and century that the column shows."""
    chosen = decided(date_evidence(df, columns))
    return df.select(*[read(quoted(c), *chosen[c]).alias(c) if c in chosen else quoted(c) for c in df.columns])
