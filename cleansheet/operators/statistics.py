"""Shape, missing values, footprint, numeric description and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleansheet.functions.numbers import megabytes
from cleansheet.operators.columns import named_positions, no_rows, number_cells, numeric_columns, quoted, rows_from, tally
from cleansheet.operators.quantiles import QUARTILES, SINGLE_PASS_CELLS, exact_quantiles, percentiles, stored_numbers

IQR_FACTOR = 1.5


def dataset_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(", ".join(df.columns)).alias("column_names"),
    )


def missing_counts(df: DataFrame) -> DataFrame:
    """(position, column_name, missing) for every column, from one aggregate."""
    one_row = df.agg(*[F.count_if(quoted(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    records = [[F.lit(i).cast("bigint"), F.lit(c), F.col(f"m{i}")] for i, c in enumerate(df.columns)]
    return rows_from(one_row, records, ["position", "column_name", "missing"])


def missing_by_column(df: DataFrame) -> DataFrame:
    return missing_counts(df).where("missing > 0").select("column_name", "missing")


def _byte_width(field: T.StructField) -> Column:
    c = quoted(field.name)
    fixed = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)).cast("bigint")
    if isinstance(field.dataType, T.DecimalType):
        return F.lit(16).cast("bigint")
    return F.lit(fixed.get(type(field.dataType), 8)).cast("bigint")


def byte_sum(df: DataFrame, weight: str | None = None) -> Column:
    """Total bytes: text by its UTF-8 length, other types by their width; `weight` is how often a row counts."""
    n = F.lit(1) if weight is None else quoted(weight)
    fields = [f for f in df.schema if f.name != weight]
    return F.coalesce(sum([F.sum(_byte_width(f) * n) for f in fields], F.lit(0)), F.lit(0)).cast("bigint")


def byte_footprint(df: DataFrame) -> DataFrame:
    one_row = df.agg(byte_sum(df).alias("memory_bytes"))
    return one_row.select("memory_bytes", megabytes(F.col("memory_bytes")).alias("memory_mb"))


_STATISTICS_SCHEMA = (
    "column_name string, n_values bigint, mean double, std double, min double, p25 double, p50 double, p75 double, "
    "max double"
)


def describe_numeric(
    df: DataFrame, rows: int | None = None, single_pass_cells: int = SINGLE_PASS_CELLS, weight: str | None = None
) -> DataFrame:
    """Count, mean, deviation, least, quartiles and greatest value per numeric column.

    `weight` names a column that tells how often each row counts.
    """
    columns = [c for c in numeric_columns(df) if c != weight]
    if not columns:
        return no_rows(df, _STATISTICS_SCHEMA)
    if rows is None:
        rows = df.count()
    small = rows * len(columns) <= single_pass_cells
    if weight is None:  # weighted rows are stored ones
        df = stored_numbers(df, columns, rows, single_pass_cells)
    v, place = F.col("value"), F.col("position")
    cells = number_cells(df, columns, weight)
    moments = [F.count(v).alias("n_values"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")]
    if weight is not None:
        moments = [tally(v.isNotNull(), "n").alias("n_values"), (F.sum(v * F.col("n")) / tally(v.isNotNull(), "n")).alias("mean")]
    described = cells.groupBy("position").agg(
        *moments, F.min(v).alias("min"), F.max(v).alias("max"), *([percentiles().alias("quartiles")] if small else []),
    )
    if weight is not None:
        described = _with_deviation(described, cells, len(columns))
    if not small:
        found = exact_quantiles(df, columns, QUARTILES, rows, single_pass_cells, weight=weight)
        values = F.array(*[F.array(*[F.lit(q).cast("double") for q in found[c]]) for c in columns])
        described = described.withColumn("quartiles", F.get(values, place))
    quartiles = [F.get("quartiles", F.lit(k)).alias(n) for k, n in enumerate(("p25", "p50", "p75"))]
    return described.select(
        named_positions(columns).alias("column_name"), "n_values", "mean", "std", "min", *quartiles, "max"
    )


def _with_deviation(described: DataFrame, cells: DataFrame, columns: int) -> DataFrame:
    """The sample deviation of weighted cells, from their distances to the mean, which is known by now."""
    means = {r["position"]: r["mean"] for r in described.select("position", "mean").collect()}
    mean = F.get(F.array(*[F.lit(means.get(i)).cast("double") for i in range(columns)]), F.col("position"))
    away = F.col("value") - mean
    spread = cells.groupBy("position").agg(F.sum(away * away * F.col("n")).alias("squares"))
    n = F.col("n_values")
    return described.join(spread, "position").withColumn("std", F.when(n > 1, F.sqrt(F.col("squares") / (n - 1))))


_OUTLIER_SCHEMA = "column_name string, n_outliers bigint, lower_bound double, upper_bound double"


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Values strictly outside the 1.5 IQR fences, for columns that have some."""
    columns = numeric_columns(df) if columns is None else columns
    rows = df.count() if rows is None else rows
    df = stored_numbers(df, columns, rows)
    fences = {}
    for c, (q1, _, q3) in exact_quantiles(df, columns, rows=rows).items():
        if q1 is not None and q3 - q1 > 0 and q3 - q1 != float("inf"):
            reach = IQR_FACTOR * (q3 - q1)
            fences[c] = (q1 - reach, q3 + reach)
    if not fences:
        return no_rows(df, _OUTLIER_SCHEMA)
    one_row = df.agg(*[
        F.count_if((quoted(c) < low) | (quoted(c) > high)).alias(f"o{i}")
        for i, (c, (low, high)) in enumerate(fences.items())
    ])
    records = [
        [F.lit(c), F.col(f"o{i}"), F.lit(low), F.lit(high)] for i, (c, (low, high)) in enumerate(fences.items())
    ]
    counted = rows_from(one_row, records, ["column_name", "n_outliers", "lower_bound", "upper_bound"])
    return counted.where("n_outliers > 0")
