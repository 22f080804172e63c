"""Profiles that merge: sketches per part of a table, stored, and put together for any choice of parts.

A part is a day, a file or whatever column splits the table. Its sketches are
small, so a profile of any range of parts reads them alone and not the table.
Counts, gaps, least and greatest values are exact. Distinct counts, quantiles and
frequent values are estimates within bounds that are stated here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleansheet.operators.columns import named_positions, numeric_columns, quoted, text_columns

# Distinct counts: 2^12 registers. One standard error, and the three of them that hold nearly always.
_REGISTERS = 12
DISTINCT_BOUND = 3 * 1.04 / math.sqrt(2**_REGISTERS)
# Quantiles: how far the rank of an estimate may be from the one that is asked for, as a share of all values.
_QUANTILE_SIZE = 800
RANK_BOUND = 0.01
# Frequent values: counts may be off by this share of all values.
_TRACKED = 1024
COUNT_BOUND = 3.5 / _TRACKED


def _cells(df: DataFrame, part: Column, columns: list[str]) -> DataFrame:
    numbers = set(numeric_columns(df))
    cells = [
        F.struct(quoted(c).cast("string").alias("text"),
                 (quoted(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("number"))
        for c in columns
    ]
    return df.select(part.alias("part"), F.posexplode(F.array(*cells)).alias("position", "cell")).select(
        "part", "position", "cell.text", "cell.number")


def part_sketches(df: DataFrame, part: Column, columns: list[str] | None = None) -> DataFrame:
    """(part, column_name, n_rows, missing, least, greatest, values, quantiles, frequent) per part and column.

    One aggregate over all cells; sketches are built in the map tasks and merged.
    """
    columns = text_columns(df) + numeric_columns(df) if columns is None else columns
    cells = _cells(df, part, columns)
    return cells.groupBy("part", "position").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("text").isNull()).alias("missing"),
        F.min("number").alias("least"), F.max("number").alias("greatest"),
        F.hll_sketch_agg("text", F.lit(_REGISTERS)).alias("values"),
        F.kll_sketch_agg_double("number", F.lit(_QUANTILE_SIZE)).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate(text, {_TRACKED})").alias("frequent"),
    ).select("part", named_positions(columns).alias("column_name"), "n_rows", "missing", "least", "greatest", "values",
             "quantiles", "frequent")


def store_sketches(df: DataFrame, part: Column, path: str, columns: list[str] | None = None) -> None:
    part_sketches(df, part, columns).write.mode("append").parquet(path)


def merged_profile(sketches: DataFrame, k: int = 5) -> DataFrame:
    """One row per column over all given parts.

    (column_name, n_rows, missing, n_unique, least, p25, p50, p75, greatest,
    frequent): the last one has up to k values with their counts.
    """
    merged = sketches.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("missing").alias("missing"), F.min("least").alias("least"),
        F.max("greatest").alias("greatest"), F.hll_union_agg("values").alias("values"),
        F.kll_merge_agg_double("quantiles", F.lit(_QUANTILE_SIZE)).alias("quantiles"),
        F.expr(f"approx_top_k_combine(frequent, {_TRACKED})").alias("frequent"))
    some = F.col("least").isNotNull()
    quartiles = [
        F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(q))).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    frequent = F.transform(
        F.expr(f"approx_top_k_estimate(frequent, {k})"), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n")))
    return merged.select(
        "column_name", "n_rows", "missing", F.hll_sketch_estimate("values").alias("n_unique"), "least", *quartiles, "greatest",
        frequent.alias("frequent"))


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
