"""Type consistency, quality score and recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleansheet.functions import dates, numbers
from cleansheet.functions.text import trimmed
from cleansheet.operators.columns import named_positions, no_rows, quoted, tally, text_cells, text_columns
from cleansheet.operators.dedup import ROW_ORDER, duplicate_count
from cleansheet.operators.frequency import counted_cells
from cleansheet.operators.statistics import missing_counts
from cleansheet.session import materialize

_DATE_OR_NUMBER_SHARE = 0.9


def inconsistent_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns of which some, but not all, values look like numbers, judged on every value."""
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return no_rows(df, "column_name string, n_values bigint, n_numeric bigint")
    value = F.col("value")
    counted = text_cells(df, columns).groupBy("position").agg(
        F.count(value).alias("n_values"), F.count_if(numbers.looks_numeric(value)).alias("n_numeric"))
    return counted.where("n_numeric > 0 and n_numeric < n_values").select(
        named_positions(columns).alias("column_name"), "n_values", "n_numeric")


def score(rows: Column, columns: Column, missing: Column, duplicates: Column, inconsistent: Column) -> Column:
    """0 to 10: full marks less the shares of missing cells, duplicates and mixed columns."""

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    marks = (
        F.lit(10.0)
        - 4.0 * share(missing, rows * columns)
        - 3.0 * share(duplicates, rows)
        - 3.0 * share(inconsistent, columns)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), marks)), 1)


def quality_metrics(df: DataFrame) -> DataFrame:
    """One row with the score and the counts behind it."""

    def metric(frame: DataFrame, name: str, value: Column) -> DataFrame:
        return frame.select(F.lit(name).alias("metric"), value.cast("bigint").alias("amount"))

    gaps = [F.count_if(quoted(c).isNull()) for c in df.columns]
    basics = df.agg(F.count(F.lit(1)).alias("rows"), reduce(Column.__add__, gaps).alias("missing"))
    parts = [
        basics.select(F.inline(F.array(*[
            F.struct(F.lit(n).alias("metric"), F.col(n).cast("bigint").alias("amount")) for n in ("rows", "missing")]))),
        metric(duplicate_count(df), "duplicates", F.col("duplicate_rows")),
        metric(inconsistent_columns(df).agg(F.count(F.lit(1)).alias("v")), "inconsistent", F.col("v")),
    ]

    def amount(name: str) -> Column:
        picked = F.max(F.when(F.col("metric") == name, F.col("amount")))
        return F.coalesce(picked, F.lit(0)).cast("bigint")

    totals = reduce(DataFrame.unionByName, parts).agg(
        amount("rows").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        amount("missing").alias("missing_values"),
        amount("duplicates").alias("duplicate_rows"),
        amount("inconsistent").alias("inconsistent_columns"),
    )
    return totals.withColumn("quality_score", score(*[F.col(c) for c in totals.columns]))


def recommendations(df: DataFrame, order: Column | None = None) -> DataFrame:
    """(message_order, message): what to clean, in a fixed order.

    The hidden row order of a frame read from CSV serves as order by itself. The frame is stored first, as five passes
    look at it.
    """
    df = materialize(df, "rows")
    data = df.drop(ROW_ORDER)
    parts = [
        duplicate_count(data).where("duplicate_rows > 0").select(
            F.lit(0).cast("bigint").alias("message_order"),
            F.format_string(_REPEATED, "duplicate_rows").alias("message")),
        missing_counts(data).where("missing > 0").select(
            (F.lit(1_000_000) + F.col("position") * 10).cast("bigint").alias("message_order"),
            F.format_string(_MISSING, "missing", "column_name").alias("message")),
        df.sparkSession.createDataFrame(text_recommendations(df, order), "message_order bigint, message string"),
    ]
    return reduce(DataFrame.unionByName, parts)


_REPEATED = "%d repeated row(s) can be dropped"
_MISSING = "%d cell(s) of `%s` have no value"
_DATES, _SPACES, _NUMBERS = "`{}` holds dates as text", "`{}` has values with outer white space", "`{}` holds numbers as text"


def count_recommendations(duplicates: int, missing: dict[str, int]) -> list[str]:
    """The first messages, from counts that are known already."""
    lines = [_REPEATED % duplicates] if duplicates else []
    return lines + [_MISSING % (n, c) for c, n in missing.items()]


def text_recommendations(
    df: DataFrame, order: Column | None = None, weight: str | None = None, frequencies: DataFrame | None = None
) -> list[tuple[int, str]]:
    """(order, message) from checks on every value of the text columns.

    One aggregate over all cells; columns of date-like texts are looked at
    again, in the format of their first value. `weight` names a column that
    tells how often each row counts. With the `frequencies` of the columns
    equal short values are checked once.
    """
    texts = text_columns(df)
    if not texts:
        return []
    if order is None:
        order = F.col(ROW_ORDER) if ROW_ORDER in df.columns else F.monotonically_increasing_id()
    visible = [c for c in df.columns if c not in (ROW_ORDER, weight)]
    value = F.col("value")
    cells = counted_cells(df, texts, frequencies, weight)
    seen = {
        texts[r["position"]]: r
        for r in cells.groupBy("position").agg(
            F.sum("n").alias("n"), tally(numbers.is_number(value), "n").alias("numbers"),
            tally(dates.is_date_like(value), "n").alias("dates"), F.max(value != trimmed(value)).alias("untrimmed"),
        ).collect()
    }
    dated = [c for c, r in seen.items() if r["dates"] / r["n"] >= _DATE_OR_NUMBER_SHARE]
    parsed = _parsed_dates(df, order, dated, texts, cells)
    found = []
    for c, r in seen.items():
        checks = (
            (parsed.get(c, 0) / r["n"] >= _DATE_OR_NUMBER_SHARE, _DATES), (r["untrimmed"], _SPACES),
            (r["numbers"] / r["n"] >= _DATE_OR_NUMBER_SHARE, _NUMBERS),
        )
        found += [(2_000_000 + visible.index(c) * 10 + i, text.format(c)) for i, (hit, text) in enumerate(checks) if hit]
    return sorted(found)


def _parsed_dates(df: DataFrame, order: Column, dated: list[str], texts: list[str], cells: DataFrame) -> dict[str, int]:
    """How many values of each column are dates in the format of its first value, or in any if that has none."""
    if not dated:
        return {}
    ordered = df.select(order.alias("at"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(dated)])
    first = ordered.agg(*[F.min(F.when(F.col(f"c{i}").isNotNull(), F.col("at"))).alias(f"a{i}") for i in range(len(dated))]).first()
    heads = ordered.agg(*[
        F.max(F.when(F.col("at") == F.lit(first[f"a{i}"]), F.col(f"c{i}"))).alias(f"h{i}") for i in range(len(dated))])
    formats = heads.select(*[dates.first_format(F.col(f"h{i}")).alias(f"f{i}") for i in range(len(dated))]).first()
    counts = cells.agg(*[
        tally((F.col("position") == texts.index(c)) & dates.parse_column(F.col("value"), formats[i]).isNotNull(), "n").alias(f"n{i}")
        for i, c in enumerate(dated)]).first()
    return {c: counts[i] for i, c in enumerate(dated)}
