"""Reading CSV datasets as text cells, typing them, and writing them back."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleansheet.functions.dates import as_day_text
from cleansheet.functions.numbers import cell_class, kind_of, plain_double_text
from cleansheet.operators.columns import quoted
from cleansheet.operators.dedup import ROW_ORDER
from cleansheet.operators.frequency import HEAD_CHARS
from cleansheet.operators.inference import as_kind
from cleansheet.session import materialize
from cleansheet.sources.encodings import UTF8, after_read, before_write, decoded, file_facts, spark_charset
from cleansheet.sources.records import assemble, raw_lines

_BAD_LINE = "\u2063bad_line"
_BYTE_ORDER_MARK = "\ufeff"


class CsvError(ValueError):
    """A CSV dataset cannot be used."""


@dataclass(frozen=True)
class CsvTable:
    """A typed dataset: its rows (with a hidden row order), kinds and encoding."""

    rows: DataFrame
    kinds: dict[str, str]
    encoding: str

    @property
    def data(self) -> DataFrame:
        return self.rows.drop(ROW_ORDER)


def header_names(cells: list[str | None]) -> list[str]:
    """Header cells as unique names: repeats get `.1`, empty ones `Unnamed: i`.

    Names that differ in case only count as repeats, as Spark cannot tell them
    apart. The names of hidden columns are taken.
    """
    names: list[str] = []
    taken: set[str] = {ROW_ORDER, _BAD_LINE}
    for i, cell in enumerate(cells):
        base = cell if cell else f"Unnamed: {i}"
        name, n = base, 0
        while name.lower() in taken:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
        taken.add(name.lower())
    return names


def _reader(spark: SparkSession, encoding: str):
    return (
        spark.read.option("quote", '"').option("escape", '"').option("encoding", spark_charset(encoding))
        .option("mode", "PERMISSIVE")
    )


def field_count(line: Column) -> Column:
    """Cells in a raw line: separators outside quotes, plus one."""
    unquoted = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BAD_LINE]])


def _names(cells: list[str | None]) -> list[str]:
    return header_names([c.lstrip(_BYTE_ORDER_MARK) if c else c for c in cells])


def read_cells(spark: SparkSession, path: str | list[str], encoding: str = UTF8) -> tuple[DataFrame, Column]:
    """All-text rows with their order, and a test for rows that are too long; one line is one record.

    Short rows are padded with NULL. The order follows the lines of a file;
    files of one folder follow each other in the order Spark reads them.
    """
    reader = _reader(spark, encoding)
    try:
        first = reader.option("header", False).csv(path).first()
    except AnalysisException as missing:
        raise CsvError(f"CSV file not found: {path!r}") from missing
    if first is None:
        raise CsvError(f"CSV file is empty: {path!r}")
    names = _names(first)
    cells = (
        reader.option("header", True).option("columnNameOfCorruptRecord", _BAD_LINE)
        .schema(_text_schema(names)).csv(path)
    )
    rows = cells.select(
        F.monotonically_increasing_id().alias(ROW_ORDER),
        *[after_read(quoted(n), encoding).alias(n) for n in names],
        _BAD_LINE,
    )
    return rows, field_count(F.col(_BAD_LINE)) > len(names)


_RECORD_OPTIONS = {
    "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "columnNameOfCorruptRecord": "raw",
}
_BROADCAST_FILES = 200_000


def read_record_cells(spark: SparkSession, path: str, facts: DataFrame) -> tuple[DataFrame, Column]:
    """As `read_cells`, for records that span lines and files of several encodings; big files stay split.

    `facts` has the encoding of every file. Lines are decoded by their file's.
    """
    encodings = facts.select("path", "encoding")
    if encodings.count() <= _BROADCAST_FILES:  # some hundred bytes a file
        encodings = F.broadcast(encodings)
    lines = raw_lines(spark, path).join(encodings, "path").withColumn(
        "value", decoded(F.col("value"), F.col("encoding"))).drop("encoding")
    records, unclosed = assemble(lines)
    open_end = unclosed.limit(5).collect()
    if open_end:
        raise CsvError(f"a quoted cell is never closed: {sorted(r['path'] for r in open_end)}")
    records = materialize(records, "records")  # read for the header, for the kinds and for the rows
    heads = materialize(records.groupBy("path").agg(F.min(F.struct("block", "at", "record")).alias("head")).select(
        "path", "head.at", F.regexp_replace("head.record", f"^{_BYTE_ORDER_MARK}", "").alias("record")), "heads")
    headers = heads.groupBy("record").agg(F.min("path").alias("path")).limit(6).collect()
    if not headers:
        raise CsvError(f"CSV file is empty: {path!r}")
    if len(headers) > 1:
        raise CsvError(f"files of one dataset differ in header: {sorted(r['path'] for r in headers)}")
    names = _names(header_cells(headers[0]["record"]))
    data = records.join(heads.select("at"), "at", "left_anti")
    rows = data.select(F.col("at").alias(ROW_ORDER), parsed_cells(F.col("record"), len(names)).alias("cells")).select(
        ROW_ORDER, "cells.*").toDF(ROW_ORDER, *names, _BAD_LINE)
    return rows, field_count(F.col(_BAD_LINE)) > len(names)


def header_cells(record: str) -> list[str]:
    return next(csv.reader(io.StringIO(record, newline="")), [])


def parsed_cells(record: Column, width: int) -> Column:
    """The cells of a record as a struct of `width` texts and, for a record of another length, its raw text."""
    fields = ", ".join([*(f"c{i} string" for i in range(width)), "raw string"])
    return F.from_csv(record, F.lit(fields), _RECORD_OPTIONS)


def infer_table(rows: DataFrame, too_long: Column, encoding: str, label: str) -> CsvTable:
    """Find the column kinds in one pass over the text cells, and type them.

    Equal short cells are folded first and looked at once; long ones are looked at where they are read.
    """
    names = [c for c in rows.columns if c not in (ROW_ORDER, _BAD_LINE)]
    long_mark = F.when(too_long, F.lit("x"))
    cells = rows.select(F.posexplode(F.array(*[quoted(c) for c in names], long_mark)).alias("position", "value"))
    value = F.col("value")
    folded = cells.withColumn("short", F.when(F.char_length(value) <= HEAD_CHARS, value)).groupBy("position", "short").agg(
        F.count(value).alias("n"), F.bit_or(F.when(F.col("short").isNull(), cell_class(value))).alias("others"))
    found = {
        r["position"]: r
        for r in folded.groupBy("position")
        .agg(F.sum("n").alias("n"), kind_of(F.bit_or(F.coalesce("others", cell_class(F.col("short"))))).alias("kind"))
        .collect()
    }
    if not found:
        raise CsvError(f"CSV dataset has no data rows: {label}")
    if found[len(names)]["n"]:
        raise CsvError(f"{found[len(names)]['n']} row(s) have more cells than the header: {label}")
    kinds = {c: found[i]["kind"] for i, c in enumerate(names)}
    typed = rows.select(ROW_ORDER, *[as_kind(quoted(c), kinds[c]).alias(c) for c in names])
    return CsvTable(typed, kinds, encoding)


def _facts(spark: SparkSession, path: str) -> tuple[DataFrame, set[str], bool]:
    """What is known of a dataset's files, their encodings, and whether records span lines.

    Files of one encoding have to share one header.
    """
    try:
        facts = materialize(file_facts(spark, path), "files")
    except AnalysisException as missing:
        raise CsvError(f"CSV file not found: {path!r}") from missing
    found = facts.groupBy("encoding", "header").agg(
        F.bool_or("open_quotes").alias("open"), F.min("path").alias("path")).limit(6).collect()
    if not found:
        raise CsvError(f"CSV file is empty: {path!r}")
    encodings, spans = {r["encoding"] for r in found}, not facts.where("open_quotes").isEmpty()
    if len(encodings) == 1 and len(found) > 1 and not spans:
        raise CsvError(f"files of one dataset differ in header: {sorted(r['path'] for r in found)[:5]}")
    return facts, encodings, spans


def read_for_profile(spark: SparkSession, path: str, multi_line: bool | None = None) -> CsvTable:
    """UTF-8 only. Records that span lines are noticed, unless `multi_line` says what to expect."""
    facts, encodings, spans = _facts(spark, path)
    if encodings != {UTF8}:
        raise CsvError(f"not UTF-8: {path}")
    if spans if multi_line is None else multi_line:
        return infer_table(*read_record_cells(spark, path, facts), UTF8, path)
    return infer_table(*read_cells(spark, path, UTF8), UTF8, path)


def read_for_cleaning(spark: SparkSession, path: str, multi_line: bool | None = None) -> CsvTable:
    """In the encoding found per file; a dataset that mixes encodings is UTF-8 once it is read."""
    facts, encodings, spans = _facts(spark, path)
    encoding = next(iter(encodings)) if len(encodings) == 1 else UTF8
    if len(encodings) > 1 or (spans if multi_line is None else multi_line):
        return infer_table(*read_record_cells(spark, path, facts), encoding, path)
    return infer_table(*read_cells(spark, path, encoding), encoding, path)


def stored(table: CsvTable) -> CsvTable:
    """The typed rows written once as parquet, so that later passes skip the text."""
    return CsvTable(materialize(table.rows, "typed"), table.kinds, table.encoding)


def csv_text(df: DataFrame) -> DataFrame:
    """Cells as they are printed to CSV."""

    def printed(field: T.StructField) -> Column:
        c = quoted(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return as_day_text(c)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return plain_double_text(c.cast("double"))
        if isinstance(field.dataType, T.BooleanType):
            return F.initcap(c.cast("string"))
        return c.cast("string")

    return df.select(*[printed(f).alias(f.name) for f in df.schema])


def write_csv(
    df: DataFrame, path: str, encoding: str = UTF8, order: str | None = None, byte_order_mark: bool | None = None
) -> None:
    """CSV part files with header; sorted only when an order column is named.

    UTF-8 output starts with a byte-order mark unless told otherwise.
    """
    if order is not None:
        df = df.orderBy(order)
    text = csv_text(df.drop(ROW_ORDER))
    text = text.select(*[before_write(quoted(c), encoding).alias(c) for c in text.columns])
    if encoding == UTF8 if byte_order_mark is None else byte_order_mark:
        text = text.withColumnRenamed(text.columns[0], _BYTE_ORDER_MARK + text.columns[0])
    (
        text.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("encoding", spark_charset(encoding)).csv(path)
    )
