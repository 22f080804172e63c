"""Many uploaded datasets in one plan: profiled, cleaned, written and profiled again, all at once.

What `plans.dataset` does for one dataset is keyed here by dataset, or by
dataset and column position. A row is one array of cells, so datasets with
different columns share a table; what is decided for a column is a row of a
decision table, which is joined back as one array per dataset. The number of
Spark jobs does not depend on the number of datasets. Decisions and results are
those of the single run, which tests compare.

The driver sees a few values per dataset: its verdict, its header and its
summary. A dataset is small here (see `streaming.uploads`), since one task
writes it and exact medians are taken per column; a larger one is run by itself.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleansheet.functions import dates, numbers
from cleansheet.functions.text import (
    CATEGORY_SETS, MISSING_TOKENS, UNKNOWN, canonical_category, collapsed, csv_nulls, trimmed, trimmed_value,
)
from cleansheet.operators.conversion import SUCCESS_SHARE
from cleansheet.operators.naming import standard_names
from cleansheet.operators.quality import score
from cleansheet.session import materialize
from cleansheet.sources.csv_files import field_count, header_cells, header_names, parsed_cells
from cleansheet.sources.records import assemble, file_of_line, is_blank, leaves_open, raw_lines, without_ending

_BYTE_ORDER_MARK = "﻿"
_TEXT, _BOOLS = "text", ("bool", "mixed_bool")


@dataclass(frozen=True)
class Outcome:
    """What became of one dataset: a summary, or why it could not be used."""

    path: str
    summary: str
    error: str | None


@dataclass
class _Upload:
    number: int
    path: str
    names: list[str]
    clean_names: list[str]
    header_at: int

    @property
    def renamed(self) -> int:
        return sum(a != b for a, b in zip(self.names, self.clean_names))


def run_uploads(spark: SparkSession, paths: list[str], output: str) -> list[Outcome]:
    """Run all datasets; the cleaned ones are written below `output`, one folder `file=<number>_<name>_cleaned.csv` each.

    Files have to be UTF-8. One text file is one dataset.
    """
    errors: dict[int, str] = {}
    records, uploads = _records(spark, paths, errors)
    summaries: dict[int, str] = {}
    if uploads:
        cells, uploads = _usable(_cells(spark, records, uploads), uploads, errors)
    if uploads:
        before = _measured(cells)
        decided = _decided(before)
        cleaned = _cleaned(before, decided)
        _write(spark, cleaned, decided, uploads, output)
        summaries = {r["upload"]: r["summary"] for r in _summaries(spark, before, decided, _measured(cleaned), uploads).collect()}
    outcomes = []
    for number, path in enumerate(paths):
        error = errors.get(number)
        if error is None and summaries.get(number) is None:
            error = f"no column is left after cleaning: {path}"
        outcomes.append(Outcome(path, "" if error else summaries[number], error))
    return outcomes


# --- reading ----------------------------------------------------------------------------------------------------------

def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _numbered(lines: DataFrame, uploads: DataFrame) -> DataFrame:
    return lines.withColumn("path", _plain(F.col("path"))).join(uploads, "path").drop("path")


def _records(spark: SparkSession, paths: list[str], errors: dict[int, str]) -> tuple[DataFrame, list[_Upload]]:
    """(upload, block, at, record) of all usable files, and their headers."""
    known = spark.createDataFrame(list(enumerate(paths)), "upload int, path string").withColumn("path", _plain(F.col("path")))
    known = F.broadcast(known)  # a row for each file of a bounded batch
    value = F.col("value")
    lines = spark.read.text(paths).select(
        file_of_line().alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    judged = _numbered(lines, known).groupBy("upload").agg(
        F.bool_and(F.is_valid_utf8(value)).alias("is_text"), F.bool_or(leaves_open(value)).alias("spans")).collect()
    errors |= {number: f"CSV file is empty: {path}" for number, path in enumerate(paths)}
    for r in judged:
        errors[r["upload"]] = "not used: not_text" if not r["is_text"] else errors[r["upload"]]
    usable = [r for r in judged if r["is_text"]]
    single, spanning = ([paths[r["upload"]] for r in usable if r["spans"] == s] for s in (False, True))
    parts, unclosed = [], set()
    if single:
        plain = spark.read.text(single).select(
            file_of_line().alias("path"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"), value.alias("record"))
        parts.append(_numbered(plain, known).where(~is_blank(F.col("record"))))
    if spanning:
        joined, open_ends = assemble(raw_lines(spark, spanning))
        unclosed = {r["upload"] for r in _numbered(open_ends, known).collect()}
        errors |= {n: f"a quoted cell is never closed: {paths[n]}" for n in unclosed}
        parts.append(_numbered(joined, known))
    if not parts:
        return known, []
    records = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    records = materialize(records.withColumn("record", without_ending(F.col("record"))), "upload-records")
    heads = records.groupBy("upload").agg(F.min(F.struct("block", "at", "record")).alias("head")).collect()
    uploads = []
    for r in sorted(heads, key=lambda r: r["upload"]):
        if r["upload"] not in unclosed:
            names = header_names(header_cells(r["head"]["record"].lstrip(_BYTE_ORDER_MARK)))
            uploads.append(_Upload(r["upload"], paths[r["upload"]], names, standard_names(names), r["head"]["at"]))
            errors.pop(r["upload"])
    return records, uploads


def _cells(spark: SparkSession, records: DataFrame, uploads: list[_Upload]) -> DataFrame:
    """(upload, at, cells, too_long): rows as arrays as long as their header."""
    heads = spark.createDataFrame(
        [(u.number, u.header_at, len(u.names)) for u in uploads], "upload int, header_at long, width int")
    width = max(len(u.names) for u in uploads)
    rows = records.join(F.broadcast(heads), "upload").where("at <> header_at")
    rows = rows.withColumn("parsed", parsed_cells(F.col("record"), width))
    too_long = F.col("parsed.raw").isNotNull() & (field_count(F.col("record")) > F.col("width"))
    every = F.array(*[F.col(f"parsed.c{i}") for i in range(width)])
    return materialize(rows.select(
        "upload", "at", F.slice(every, F.lit(1), F.col("width")).alias("cells"), too_long.alias("too_long")), "upload-cells")


def _usable(cells: DataFrame, uploads: list[_Upload], errors: dict[int, str]) -> tuple[DataFrame, list[_Upload]]:
    """Without the datasets that have no row, or rows longer than their header."""
    seen = {r["upload"]: r for r in cells.groupBy("upload").agg(F.count_if("too_long").alias("too_long")).collect()}
    for u in uploads:
        if u.number not in seen:
            errors[u.number] = f"CSV dataset has no data rows: {u.path}"
        elif seen[u.number]["too_long"]:
            errors[u.number] = f"{seen[u.number]['too_long']} row(s) have more cells than the header: {u.path}"
    good = [u for u in uploads if u.number not in errors]
    return cells.where(F.col("upload").isin([u.number for u in good])), good


# --- profile ----------------------------------------------------------------------------------------------------------

@dataclass
class _Measured:
    """Typed distinct rows (upload, cells, copies, at, is_empty, kinds), what a scan tells of columns, and of datasets."""

    distinct: DataFrame
    columns: DataFrame
    datasets: DataFrame


def _typed(cell: Column, kind: Column) -> Column:
    """A cell in the one spelling that its value has in a column of this kind."""
    c = csv_nulls(cell)
    return (
        F.when(kind == _TEXT, c)
        .when(kind.isin(*_BOOLS), F.when(c.isin(*numbers.BOOLEANS), F.lower(c)))
        .when(kind == "float64", (numbers.to_double(c) + 0.0).cast("string"))
        .otherwise(F.trim(c).try_cast("decimal(20,0)").cast("string"))
    )


def _measured(cells: DataFrame) -> _Measured:
    kinds = cells.select("upload", F.posexplode("cells").alias("position", "cell")).groupBy("upload", "position").agg(
        numbers.kind_of(F.bit_or(numbers.cell_class(F.col("cell")))).alias("kind"))
    listed = kinds.groupBy("upload").agg(F.sort_array(F.collect_list(F.struct("position", "kind"))).alias("listed"))
    listed = F.broadcast(materialize(listed.select("upload", F.transform("listed", lambda x: x["kind"]).alias("kinds")), "upload-kinds"))
    typed = cells.join(listed, "upload").select("upload", "at", F.zip_with("cells", "kinds", _typed).alias("cells"))
    distinct = typed.groupBy("upload", "cells").agg(F.count("*").alias("copies"), F.min("at").alias("at")).join(listed, "upload")
    distinct = materialize(
        distinct.withColumn("is_empty", F.forall("cells", lambda c: c.isNull())), "upload-rows")
    columns = materialize(_survey(_exploded(distinct)), "upload-columns")
    sizes = distinct.groupBy("upload").agg(
        F.sum("copies").alias("rows"), F.count("*").alias("distinct"), F.count_if("is_empty").alias("empty"))
    mixed = (F.col("kind") == _TEXT) & (F.col("numeric_like") > 0) & (F.col("numeric_like") < F.col("present"))
    totals = columns.groupBy("upload").agg(
        F.sum("missing_cells").alias("missing"), F.count("*").alias("columns"), F.count_if(mixed).alias("mixed"))
    datasets = sizes.join(totals, "upload").withColumn("duplicates", F.col("rows") - F.col("distinct"))
    quality = score(*[F.col(c) for c in ("rows", "columns", "missing", "duplicates", "mixed")])
    return _Measured(distinct, columns, materialize(datasets.withColumn("quality", quality), "upload-sizes"))


def _exploded(distinct: DataFrame) -> DataFrame:
    """(upload, at, copies, position, raw, kind, v): the cells; v is the value that cleaning sees before it fills gaps."""
    cells = distinct.select(
        "upload", "at", "copies", "is_empty", F.posexplode(F.arrays_zip("cells", "kinds")).alias("position", "cell"))
    cells = cells.select("upload", "at", "copies", "is_empty", "position", F.col("cell.cells").alias("raw"),
                         F.col("cell.kinds").alias("kind"))
    return cells.withColumn("v", F.when(F.col("kind") == _TEXT, trimmed_value(F.col("raw"))).otherwise(F.col("raw")))


def _survey(cells: DataFrame) -> DataFrame:
    """Per column, what one scan can tell; rows without any value count as missing cells only."""
    raw, v, plain, number = (F.col(c) for c in ("raw", "v", "plain", "number"))
    is_text = F.col("kind") == _TEXT
    cells = (
        cells.withColumn("plain", F.when(is_text, numbers.number_text(v))).withColumn("number", numbers.to_double(plain))
        .withColumn("lower", F.when(is_text & (F.octet_length(v) <= 6), F.lower(v)))
        .withColumn("hash", F.when(v.isNotNull(), F.xxhash64(v))).withColumn("salted", F.when(v.isNotNull(), F.xxhash64(F.lit(1), v)))
    )
    # A column has one kind; as a key it leaves the buffers number-sized, so that the aggregate stays hashed.
    return cells.groupBy("upload", "position", "kind").agg(
        F.count(raw).alias("present"), F.count(v).alias("values"),
        F.sum(F.when(raw.isNull(), F.col("copies")).otherwise(0)).alias("missing_cells"),
        F.count_if(is_text & numbers.looks_numeric(raw)).alias("numeric_like"),
        F.count_if(is_text & trimmed(raw).isin(*MISSING_TOKENS)).alias("tokens"),
        F.count(number).alias("numbers"), F.min(number).eqNullSafe(F.max(number)).alias("one_number"),
        F.coalesce(F.bit_or(F.when(number.isNotNull(), numbers.number_class(plain))), F.lit(0)).alias("bits"),
        F.count_if(is_text & dates.is_date_like(v)).alias("date_like"),
        (F.min("hash").eqNullSafe(F.max("hash")) & F.min("salted").eqNullSafe(F.max("salted"))).alias("one_value"),
        *[F.count_if(F.col("lower") == m.lower()).alias(f"is_{m}") for members in CATEGORY_SETS for m in members],
    )


# --- decisions --------------------------------------------------------------------------------------------------------

def _decided(before: _Measured) -> DataFrame:
    """What happens to each column: (upload, position, kind, missing, fill, number, is_date, date_format, category, keep...)."""
    keys = ["upload", "position"]
    kept = before.datasets.select("upload", (F.col("distinct") - F.col("empty")).alias("kept"))
    columns = before.columns.join(kept, "upload").withColumn("missing", F.col("kept") - F.col("values"))
    columns = columns.withColumn("gaps", (F.col("missing") > 0) & (F.col("present") > 0))
    cells = _exploded(before.distinct.where(~F.col("is_empty")))
    gaps = cells.join(F.broadcast(columns.where("gaps").select(*keys)), keys)  # a row for each column of a bounded batch
    worded = F.col("kind").isin(_TEXT, *_BOOLS)
    modes = gaps.where(worded & F.col("v").isNotNull()).groupBy(*keys, "v").agg(F.count("*").alias("n"))
    modes = modes.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), "v"))["v"].alias("mode"))
    medians = gaps.where(~worded).groupBy(*keys).agg(
        F.percentile(F.col("v").try_cast("double"), F.lit(0.5)).cast("string").alias("median"))
    columns = columns.join(modes, keys, "left").join(medians, keys, "left")

    is_text, mode = F.col("kind") == _TEXT, F.col("mode")
    columns = columns.withColumn("fill", F.when(F.col("gaps"), F.when(
        is_text, F.coalesce(mode, F.lit(UNKNOWN))).otherwise(F.coalesce(mode, F.col("median")))))
    added = F.when(mode.isNotNull(), F.col("missing")).otherwise(0)
    number_mode = numbers.to_double(numbers.number_text(mode)).isNotNull()
    columns = columns.withColumn("read", F.col("numbers") + F.when(number_mode, added).otherwise(0))
    likely = F.col("date_like") + F.when(dates.is_date_like(mode), added).otherwise(0)

    def enough(n: Column) -> Column:
        return (F.col("kept") > 0) & (n / F.col("kept") >= SUCCESS_SHARE)

    def in_set(members: tuple[str, ...]) -> Column:
        return sum((F.col(f"is_{m}") for m in members), F.lit(0)) == F.col("values")

    number = F.when(is_text & enough(F.col("read")), _number_type(F.col("bits"), F.col("kept") - F.col("read")))
    columns = columns.withColumn("number", number)
    open_text = is_text & F.col("number").isNull() & (F.col("kept") > 0)
    category = F.lit(None).cast("int")
    for i, members in reversed(list(enumerate(CATEGORY_SETS))):
        category = F.when(in_set(members), i).otherwise(category)
    filled_by_word = ~F.col("fill").eqNullSafe(F.lit(UNKNOWN))
    columns = columns.withColumn("category", F.when(open_text & filled_by_word & (F.col("values") > 0), category))
    columns = materialize(columns.withColumn("may_be_date", open_text & enough(likely)), "upload-plan")

    likely = F.broadcast(columns.where("may_be_date").select(*keys, "fill", "kept"))
    written = cells.join(likely, keys).withColumn("v", F.coalesce("v", "fill"))
    formats = materialize(written.groupBy(*keys).agg(F.min_by("v", "at").alias("first")).select(
        *keys, dates.first_format(F.col("first")).alias("date_format")), "upload-formats")
    stamped = written.join(F.broadcast(formats), keys).withColumn(
        "day", dates.parse_among(F.col("v"), F.col("date_format"), _formats(formats)))
    stamped = stamped.groupBy(*keys).agg(
        F.max("kept").alias("kept"), F.count("day").alias("n"),
        F.min("day").eqNullSafe(F.max("day")).alias("one_day")).where(F.col("n") / F.col("kept") >= SUCCESS_SHARE)
    stamped = stamped.join(formats, keys)
    columns = columns.join(stamped.select(*keys, "date_format", "one_day", F.lit(True).alias("dated")), keys, "left")

    is_date = F.coalesce("dated", F.lit(False))
    category = F.when(~is_date, F.col("category"))
    one_member = F.lit(False)
    for i, members in enumerate(CATEGORY_SETS):
        n = sum((F.when(F.col(f"is_{m}") > 0, 1).otherwise(0) for m in members), F.lit(0))
        one_member = F.when(category == i, n <= 1).otherwise(one_member)
    constant = (
        F.when(F.col("kept") == 0, True).when(is_date, F.col("one_day")).when(F.col("number").isNotNull(), F.col("one_number"))
        .when(category.isNotNull(), one_member).otherwise(F.col("one_value"))
    )
    is_empty = F.col("present") == 0
    mixed = (F.col("kind") == "mixed_bool") | ((F.col("kind") == "bool") & (F.col("missing") > 0))
    return materialize(columns.select(
        *keys, "kind", "missing", "fill", "number", "tokens", is_date.alias("is_date"), "date_format",
        category.alias("category"), (~is_empty & ~constant).alias("keep"), is_empty.alias("is_empty"),
        (~is_empty & (F.col("number").isNotNull() | mixed | is_date)).alias("converted")), "upload-decisions")


def _formats(dated: DataFrame) -> list[str]:
    """The date formats that occur; there are no more than the accepted ones."""
    found = dated.where(F.col("date_format").isNotNull()).select("date_format").distinct().collect()
    return sorted(r["date_format"] for r in found)


def _number_type(bits: Column, failed: Column) -> Column:
    """As `conversion.number_type`, for a column of cases."""
    lossless = numbers.INT64 + numbers.NEGATIVE + numbers.UINT64
    return (
        F.when((failed > 0) | (bits.bitwiseAND(~lossless) != 0), "double")
        .when(bits.bitwiseAND(numbers.UINT64) == 0, "bigint")
        .when(bits.bitwiseAND(numbers.NEGATIVE) != 0, "double").otherwise("decimal")
    )


# --- projection -------------------------------------------------------------------------------------------------------

def _value(cell: Column, plan: Column) -> Column:
    """What a cell holds once it is trimmed and filled."""
    return F.coalesce(F.when(plan["kind"] == _TEXT, trimmed_value(cell)).otherwise(cell), plan["fill"])


def _number(v: Column, plan: Column) -> Column:
    """The value of a cell of a column of doubles."""
    return F.when(plan["number"] == "double", numbers.to_double(numbers.without_commas(v))).when(
        plan["number"].isNull() & (plan["kind"] == "float64"), v.try_cast("double"))


def _printed(v: Column, number: Column, plan: Column, formats: list[str]) -> Column:
    """A value cleaned as its column's plan says, as it is written; NULL for no value."""
    members = tuple(m for s in CATEGORY_SETS for m in s)
    return (
        F.when((plan["number"] == "double") | (plan["number"].isNull() & (plan["kind"] == "float64")), numbers.plain_double_text(number))
        .when(plan["number"].isNotNull(), numbers.without_commas(v).try_cast("decimal(20,0)").cast("string"))
        .when(plan["is_date"], F.date_format(dates.parse_among(v, plan["date_format"], formats), "yyyy-MM-dd"))
        .when(plan["category"].isNotNull(), collapsed(canonical_category(v, members))).when(plan["kind"] == _TEXT, collapsed(v))
        .when(plan["kind"].isin(*_BOOLS), F.initcap(v)).otherwise(v)
    )


def _by_upload(decided: DataFrame, *fields: str) -> DataFrame:
    """The decisions as one array per dataset, in the order of its columns."""
    return decided.groupBy("upload").agg(F.sort_array(F.collect_list(F.struct("position", *fields))).alias("plans"))


def _cleaned(before: _Measured, decided: DataFrame) -> DataFrame:
    """(upload, at, cells): cleaned rows as they are written, without the columns that go."""
    plans = _by_upload(decided, "kind", "fill", "number", "is_date", "date_format", "category", "keep")
    plans = plans.where(F.exists("plans", lambda p: p["keep"]))  # a filter on the cells would compute them twice
    rows = before.distinct.where(~F.col("is_empty")).join(F.broadcast(plans), "upload")
    pairs = F.filter(F.arrays_zip("cells", "plans"), lambda x: x["plans"]["keep"])
    # Step by step, so that what a step finds is computed once for a cell, however often the next one asks for it.
    values = F.transform(pairs, lambda x: F.struct(_value(x["cells"], x["plans"]).alias("v"), x["plans"].alias("plan")))
    read = F.transform(values, lambda x: F.struct(x["v"].alias("v"), _number(x["v"], x["plan"]).alias("number"), x["plan"].alias("plan")))
    formats = _formats(decided)
    cells = F.transform(read, lambda x: _printed(x["v"], x["number"], x["plan"], formats))
    return materialize(rows.select("upload", "at", cells.alias("cells")), "upload-cleaned")


def _csv_line(cells: Column) -> Column:
    def quoted(c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(
            F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.array_join(F.transform(cells, quoted), ",")


def file_name(number: int, path: str) -> str:
    return f"{number:06d}_{posixpath.splitext(posixpath.basename(path))[0]}_cleaned.csv"


def _write(spark: SparkSession, cleaned: DataFrame, decided: DataFrame, uploads: list[_Upload], output: str) -> None:
    """One file with header per dataset, in the order of its rows, beginning with a byte-order mark."""
    names = spark.createDataFrame(
        [(u.number, file_name(u.number, u.path), u.clean_names) for u in uploads],
        "upload int, file string, names array<string>")
    named = names.join(_by_upload(decided, "keep"), "upload")
    kept = F.transform(F.filter(F.arrays_zip("names", "plans"), lambda x: x["plans"]["keep"]), lambda x: x["names"])
    heads = named.select("upload", F.lit(-1).cast("long").alias("at"), kept.alias("cells")).where(F.size("cells") > 0)
    heads = heads.select("upload", "at", F.concat(F.lit(_BYTE_ORDER_MARK), _csv_line(F.col("cells"))).alias("value"))
    lines = cleaned.select("upload", "at", _csv_line(F.col("cells")).alias("value")).unionByName(heads)
    lines = lines.join(F.broadcast(names.select("upload", "file")), "upload")
    lines.repartition("file").sortWithinPartitions("file", "at").select("file", "value").write.mode("overwrite").partitionBy(
        "file").text(output)


def _summaries(spark: SparkSession, before: _Measured, decided: DataFrame, after: _Measured, uploads: list[_Upload]) -> DataFrame:
    """(upload, summary) of every dataset of which a column is left."""
    known = spark.createDataFrame([(u.number, u.renamed) for u in uploads], "upload int, renamed int")
    changed = decided.groupBy("upload").agg((F.count_if(~F.col("keep")) + F.count_if("converted")).alias("changed"))
    first = before.datasets.select(
        "upload", "rows", "quality", (F.col("duplicates") + F.col("empty")).alias("removed"))
    last = after.datasets.select("upload", F.col("rows").alias("rows_after"), F.col("quality").alias("quality_after"))
    every = known.join(first, "upload").join(changed, "upload").join(last, "upload")
    return every.select("upload", F.format_string(
        "rows %d -> %d, quality %s -> %s, changes %d", "rows", "rows_after", F.col("quality").cast("string"),
        F.col("quality_after").cast("string"), F.col("removed") + F.col("changed") + F.col("renamed")).alias("summary"))
