"""Value frequencies of text columns and what follows from them.

Long texts do not travel: a value is known by its first characters and, if it
has more, by a digest. Only the texts of the few values that are asked for, and
of those that begin alike, are looked up afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleansheet.functions.numbers import looks_numeric
from cleansheet.operators.columns import (
    named_positions, no_rows, quoted, rows_from, text_cells, text_columns,
)

HEAD_CHARS = 32
_KEYS = ["position", "head", "digest"]


def _head(value: Column) -> Column:
    return F.left(value, F.lit(HEAD_CHARS))


def _digest(value: Column) -> Column:
    """SHA-256 of a text that is longer than its head."""
    return F.when(F.char_length(value) > HEAD_CHARS, F.unhex(F.sha2(value, 256)))


def _cells(df: DataFrame, columns: list[str], weight: str | None) -> DataFrame:
    cells = F.array(*[quoted(c).cast("string") for c in columns])
    n = F.lit(1).cast("long") if weight is None else quoted(weight)
    return df.select(n.alias("n"), F.posexplode(cells).alias("position", "value")).where(F.col("value").isNotNull())


def value_frequencies(df: DataFrame, columns: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(position, head, digest, n, rows, numeric) for every distinct non-null value; digest is NULL if the head is all of it.

    One scan and one shuffle for all columns. Map-side partial counts fold a
    hot value into one record per task; the column travels as a small number.
    `weight` names a column that tells how often each row counts in n; `rows`
    counts rows. `numeric` tells that the value looks like a number.
    """
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return no_rows(df, "position int, head string, digest binary, n bigint, rows bigint, numeric boolean")
    return frequencies_of(counted_cells(df, columns, weight=weight))


def frequencies_of(cells: DataFrame) -> DataFrame:
    """As `value_frequencies`, from (position, value, n, rows) cells."""
    value = F.col("value")
    cells = cells.withColumn("head", _head(value)).withColumn("digest", _digest(value))
    long_number = F.when(F.col("digest").isNotNull(), looks_numeric(value))
    return cells.groupBy(*_KEYS).agg(
        F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.max(long_number).alias("long_number"),
    ).select(*_KEYS, "n", "rows", F.coalesce("long_number", looks_numeric(F.col("head"))).alias("numeric"))


def counted_cells(df: DataFrame, columns: list[str], frequencies: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """(position, value, n, rows): the non-null cells of some columns, equal short ones once if their frequencies are known.

    Checks of values then run once per distinct short value. Long texts, which
    the frequencies do not hold, are taken one by one from the columns that
    have some.
    """
    cells = _cells(df, columns, weight).withColumn("rows", F.lit(1).cast("long")).select("position", "value", "n", "rows")
    if frequencies is None:
        return cells
    known = frequencies.where(F.col("position") < len(columns))
    short = known.where(F.col("digest").isNull()).select("position", F.col("head").alias("value"), "n", "rows")
    held = [r["position"] for r in known.where(F.col("digest").isNotNull()).select("position").distinct().collect()]
    if not held:
        return short
    long = _cells(df, [columns[i] for i in held], weight).where(F.char_length("value") > HEAD_CHARS)
    place = F.get(F.array(*[F.lit(i) for i in held]), F.col("position"))
    return short.unionByName(long.select(place.alias("position"), "value", "n", F.lit(1).cast("long").alias("rows")))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct values per text column; `approx` trades exactness for one scan without shuffle."""
    columns = text_columns(df) if columns is None else columns
    if approx:
        one_row = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(columns)])
        records = [[F.lit(c), F.col(f"d{i}")] for i, c in enumerate(columns)]
        return rows_from(one_row, records, ["column_name", "n_unique"])
    counted = value_frequencies(df, columns).groupBy("position").agg(F.count(F.lit(1)).alias("n_unique"))
    counted = counted.select(named_positions(columns).alias("column_name"), "n_unique")
    return _with_every_column(counted, columns, "n_unique")


def _with_every_column(counted: DataFrame, columns: list[str], measure: str) -> DataFrame:
    """Columns without any value are reported too, with zero."""
    zeros = counted.sparkSession.createDataFrame([(c, 0) for c in columns], f"column_name string, {measure} bigint")
    return counted.unionByName(zeros).groupBy("column_name").agg(F.max(measure).alias(measure))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """The k most frequent values per column, equal counts by value.

    The rank filter is applied inside each task before the shuffle on the
    column, so at most k rows per column and task are exchanged.
    """
    columns = text_columns(df) if columns is None else columns
    return rank_values(df, columns, value_frequencies(df, columns), k)


def rank_values(df: DataFrame, columns: list[str], frequencies: DataFrame, k: int = 5) -> DataFrame:
    """(column_name, value_rank, value, n): the first k values by count, then text, from the frequencies of the frame.

    Values that begin alike are candidates together. There are no more than k
    beginnings per column, so the second look at the frame, which finds the
    texts, keeps the cells that begin so before anything is exchanged.
    """
    if not columns:
        return no_rows(df, "column_name string, value_rank bigint, value string, n bigint")
    by_head = Window.partitionBy("position").orderBy(F.desc("n"), "head", F.col("digest").isNotNull())
    candidates = frequencies.withColumn("place", F.rank().over(by_head)).where(F.col("place") <= k)
    whole = candidates.where(F.col("digest").isNull()).select("position", F.col("head").alias("value"), "n")
    cut = candidates.where(F.col("digest").isNotNull()).select(*_KEYS, "n")
    beginnings = F.broadcast(cut.select("position", "head").distinct())  # at most k for each column
    value = F.col("value")
    cells = text_cells(df, columns).where(F.char_length(value) > HEAD_CHARS).withColumn("head", _head(value))
    cells = cells.join(beginnings, ["position", "head"], "left_semi").withColumn("digest", _digest(value))
    texts = cells.groupBy("position", "digest").agg(F.min("value").alias("value"))
    found = whole.unionByName(cut.join(texts, ["position", "digest"]).select("position", "value", "n"))
    by_count = Window.partitionBy("position").orderBy(F.desc("n"), F.asc("value"))
    return (
        found.withColumn("value_rank", F.row_number().over(by_count)).where(F.col("value_rank") <= k)
        .select(named_positions(columns).alias("column_name"), F.col("value_rank").cast("bigint").alias("value_rank"), "value", "n")
    )


def column_modes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Most frequent value per column, the smallest on a tie."""
    return top_values(df, columns, 1).select("column_name", F.col("value").alias("mode_value"), "n")
