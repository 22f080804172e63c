"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleansheet.functions import dates, numbers, text
from cleansheet.operators import conversion, date_evidence as evidence, dedup, frequency, history, history_table, inference
from cleansheet.operators import messages, missing, naming, quality
from cleansheet.operators import query_audit, sketch_profile as sketches, statistics
from cleansheet.operators.columns import quoted
from cleansheet.operators.dedup import COPIES
from cleansheet.plans import cleaning, dataset, profiling
from cleansheet.registry import views
from cleansheet.session import materialize, scratch_path
from cleansheet.sources import csv_files, landing
from cleansheet.streaming import uploads

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    """Register a query under its name; days and times are taken in UTC."""

    @wraps(f)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return f(spark, folder)

    _QUERIES[f.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _labelled(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), "*")


def _over(frames: dict[str, DataFrame], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [_labelled(n, operator(df)) for n, df in frames.items()])


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[
        F.round(quoted(c), digits).alias(c) if kind == "double" else quoted(c) for c, kind in df.dtypes
    ])


def _profiled_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "messy_orders": views.messy_orders(spark, folder),
        "orders": views.table(spark, folder, "orders"),
    }


def _text_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "messy_orders": views.messy_orders(spark, folder),
        "documents": views.shared_table(spark, folder, "documents"),
        "customer": views.table(spark, folder, "customer"),
    }


# --- profile -----------------------------------------------------------------


@_query
def describe_numeric(spark, folder):
    return _rounded(statistics.describe_numeric(views.shared_table(spark, folder, "lineitem")))


@_query
def dataset_shape(spark, folder):
    return _over(_profiled_tables(spark, folder), statistics.dataset_shape)


@_query
def missing_by_column(spark, folder):
    return _over(_profiled_tables(spark, folder), statistics.missing_by_column)


@_query
def duplicate_count(spark, folder):
    tables = _profiled_tables(spark, folder)
    tables["documents"] = views.shared_table(spark, folder, "documents", "text", "lang", "source")
    return _over(tables, dedup.duplicate_count)


@_query
def byte_footprint(spark, folder):
    return _over(_profiled_tables(spark, folder), statistics.byte_footprint)


@_query
def distinct_counts(spark, folder):
    return _over(_text_tables(spark, folder), frequency.distinct_counts)


@_query
def top_values(spark, folder):
    return _over(_text_tables(spark, folder), frequency.top_values)


@_query
def column_mode(spark, folder):
    return _over(_text_tables(spark, folder), frequency.column_modes)


@_query
def inconsistent_columns(spark, folder):
    return _over(
        {**_text_tables(spark, folder), "raw_cells": views.text_cells(spark, folder)}, quality.inconsistent_columns
    )


@_query
def quality_score(spark, folder):
    return _over(_profiled_tables(spark, folder), quality.quality_metrics)


@_query
def recommendations(spark, folder):
    return quality.recommendations(views.messy_orders(spark, folder), F.col("order_id"))


@_query
def profile_summary(spark, folder):
    mo = materialize(views.messy_orders(spark, folder), "view")
    profile = profiling.profile_dataset(mo, "messy_orders", F.col("order_id"))
    return profiling.summary_rows(spark, profile)


@_query
def iqr_outliers(spark, folder):
    tables = {n: views.shared_table(spark, folder, n) for n in ("events", "documents", "lineitem")}
    return _rounded(_over(tables, statistics.iqr_outliers))


@_query
def sketch_profile(spark, folder):
    """A profile merged from stored sketches per day, and whether its estimates hold the bounds that are stated."""
    columns, place = ["event_type", "user_id", "value"], scratch_path(spark, "sketches")
    events = views.shared_table(spark, folder, "events", "ts", *columns)
    sketches.store_sketches(events, F.to_date("ts"), place, columns)
    merged = sketches.merged_profile(sketches.read_sketches(spark, place))
    cells = events.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("text"),
                 F.lit(None).cast("double").alias("number") if c == "event_type" else quoted(c).cast("double").alias("number"))
        for c in columns])))
    named = cells.groupBy("column_name", "text", "number").agg(F.count("*").alias("m")).join(F.broadcast(merged), "column_name")
    hit = F.filter("frequent", lambda x: x["value"] == F.col("text"))
    off = F.abs(F.get(hit, F.lit(0))["n"] - F.col("m"))
    total = F.sum("m")

    def near(q: str, share: float) -> Column:
        upto = F.sum(F.when(F.col("number") <= F.col(q), F.col("m")).otherwise(0)) / total
        below = F.sum(F.when(F.col("number") < F.col(q), F.col("m")).otherwise(0)) / total
        return (below <= share + sketches.RANK_BOUND) & (upto >= share - sketches.RANK_BOUND)

    judged = named.groupBy("column_name", "n_rows", "missing", "least", "greatest", "n_unique").agg(
        F.count("text").alias("exact"), F.coalesce(F.max(off), F.lit(0)).alias("off"),
        (F.max("p50").isNull() | (near("p25", 0.25) & near("p50", 0.5) & near("p75", 0.75))).alias("quartiles_hold"))
    return judged.select(
        "column_name", "n_rows", "missing", "least", "greatest",
        (F.abs(F.col("n_unique") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * sketches.DISTINCT_BOUND)).alias(
            "distinct_holds"), "quartiles_hold",
        (F.col("off") <= F.greatest(F.lit(1.0), F.col("n_rows") * sketches.COUNT_BOUND)).alias("counts_hold"))


# --- clean -------------------------------------------------------------------


@_query
def infer_types(spark, folder):
    return inference.column_kinds(views.text_cells(spark, folder)).select("column_name", "kind")


@_query
def null_tokens(spark, folder):
    cells = views.text_cells(spark, folder)
    return missing.null_csv_tokens(cells)


@_query
def snake_case_names(spark, folder):
    headings = views.column_headings(spark, folder)
    return headings.select("p_partkey", "heading", text.snake_case(F.col("heading")).alias("snake_name"))


@_query
def renamed_columns(spark, folder):
    twice = views.messy_with_headings(spark, folder)
    twice = twice.select(*[quoted(c) for c in twice.columns], quoted("QTY").alias("q-t-y"), quoted("QTY").alias("qty_2"))
    return naming.standardize_columns(twice)[0]


@_query
def trim_strings(spark, folder):
    return missing.trim_strings(views.messy_orders(spark, folder))


@_query
def missing_tokens(spark, folder):
    return missing.missing_token_counts(views.messy_orders(spark, folder))


@_query
def fill_median(spark, folder):
    return missing.fill_with_median(views.messy_orders(spark, folder).select("order_id", "qty"), ["qty"])


@_query
def fill_mode(spark, folder):
    mo = views.messy_orders(spark, folder).select("order_id", "priority", "amount", "empty_col")
    return missing.fill_with_mode(missing.null_missing_tokens(missing.trim_strings(mo)))


@_query
def to_numeric(spark, folder):
    mo = views.messy_orders(spark, folder).select("order_id", "amount", "priority", "order_day")
    return conversion.to_numeric(mo)


@_query
def to_datetime(spark, folder):
    mo = views.messy_orders(spark, folder).select("order_id", "order_day", "priority")
    stamped = conversion.to_datetime(mo, F.col("order_id"))
    return stamped.withColumn("order_day", F.date_format("order_day", "yyyy-MM-dd HH:mm:ss"))


@_query
def date_forms(spark, folder):
    """Every accepted form of a date, read value by value."""
    written = F.col("written")
    return views.dated_orders(spark, folder).select(
        "order_id", "written", F.date_format(dates.parse_any(written), "yyyy-MM-dd HH:mm:ss.SSS").alias("read"),
        dates.first_format(written).isNotNull().alias("known"))


@_query
def date_evidence(spark, folder):
    """What all values of a column say about how it writes dates."""
    found = evidence.date_evidence(views.dated_columns(spark, folder).drop("order_id"))
    shapes = F.transform("shapes", lambda s: F.concat(s["shape"], F.lit("="), s["n"].cast("string")))
    return found.withColumn("shapes", F.array_join(shapes, "; "))


@_query
def to_datetime_evidence(spark, folder):
    read = evidence.to_datetime_by_evidence(views.dated_columns(spark, folder))
    stamps = {n for n, kind in read.dtypes if kind == "timestamp"}
    return read.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if c in stamps else c for c in read.columns])


@_query
def date_export(spark, folder):
    mo = views.messy_orders(spark, folder).select("order_id", "order_day")
    return conversion.as_export_text(conversion.to_datetime(mo, F.col("order_id")))


@_query
def parse_ratio(spark, folder):
    tables = {**_text_tables(spark, folder), "dated_orders": views.dated_orders(spark, folder)}
    return _rounded(_over(tables, conversion.parse_ratios), 6)


@_query
def canonical_categories(spark, folder):
    mo = views.messy_orders(spark, folder).select("order_id", "confirmed", "priority")
    return conversion.canonical_categories(mo)


@_query
def collapse_ws(spark, folder):
    return conversion.collapse_whitespace(views.table(spark, folder, "documents").select("doc_id", "text"))


@_query
def dedup_rows(spark, folder):
    return dedup.dedup_rows(views.messy_orders(spark, folder))


@_query
def drop_empty_rows(spark, folder):
    return dedup.drop_empty_rows(views.messy_orders(spark, folder))


@_query
def drop_null_columns(spark, folder):
    return dedup.null_only_columns(views.messy_orders(spark, folder))


@_query
def drop_constant_columns(spark, folder):
    return dedup.constant_columns(views.messy_orders(spark, folder))


def _cleaned(spark: SparkSession, folder: str) -> cleaning.Cleaned:
    return cleaning.clean_dataset(views.messy_with_headings(spark, folder), "Order ID")


@_query
def clean_rows(spark, folder):
    cleaned = _cleaned(spark, folder).data
    return cleaned.withColumn("order_day", F.date_format("order_day", "yyyy-MM-dd HH:mm:ss"))


@_query
def cleaning_report(spark, folder):
    report = cleaning.report_row(spark, _cleaned(spark, folder).report)

    def joined(name: str) -> Column:
        return F.array_join(name, ", ").alias(name)

    def entries(name: str, entry: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(F.array_sort(F.map_entries(name)), entry), "; ").alias(name)

    return report.select(
        "rows_before", "rows_after", "rows_removed", "columns_before", "columns_after", "duplicates_removed",
        "empty_rows_removed", "empty_columns_removed", "tokens_normalized", "total_changes",
        joined("columns_removed"), joined("columns_converted"), joined("categories_standardized"),
        entries("renamed_columns", lambda e: F.concat(e["key"], F.lit("="), e["value"])),
        entries("missing_values_filled", lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))),
        entries("outlier_summary", lambda e: F.concat(
            e["key"], F.lit("="), e["value"]["count"].cast("string"), F.lit(" outside "),
            F.format_string("%.2f..%.2f", e["value"]["lower_bound"], e["value"]["upper_bound"]),
        )),
        "has_removed_duplicates", "has_removed_empty_rows", "has_removed_columns", "has_converted_columns",
    )


@_query
def cleaning_actions(spark, folder):
    return cleaning.action_rows(spark, _cleaned(spark, folder).report)


@_query
def before_after(spark, folder):
    mo = views.messy_with_headings(spark, folder)
    distinct = cleaning.distinct_rows(mo)
    values = cleaning.distinct_values(distinct)
    before = profiling.profile_dataset(distinct, "before", quoted("Order ID"), copies=COPIES, frequencies=values)
    cleaned = cleaning.clean_dataset(mo, "Order ID", distinct=distinct, frequencies=values)
    printed = materialize(missing.null_csv_tokens(conversion.as_export_text(cleaned.data)), "cleaned")
    after = profiling.profile_dataset(printed, "after", F.col("order_id"))
    return profiling.compare(profiling.metric_rows(spark, before), profiling.metric_rows(spark, after))


@_query
def dataset_report(spark, folder):
    source = scratch_path(spark, "csv") + "/messy_orders.csv"
    csv_files.write_csv(views.messy_with_headings(spark, folder), source)
    return dataset.report_rows(spark, dataset.run_dataset(spark, source, scratch_path(spark, "cleaned")))


# --- files -------------------------------------------------------------------


@_query
def landing_audit(spark, folder):
    verdicts = landing.audit_landing(spark, views.land_documents(spark, folder), max_bytes=30_000)
    return verdicts.withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))


@_query
def safe_names(spark, folder):
    names = views.uploaded_names(spark, folder)
    return landing.safe_names(names, "file_name", F.timestamp_seconds("uploaded_second"), "doc_id")


@_query
def csv_scan(spark, folder):
    target = scratch_path(spark, "csv")
    csv_files.write_csv(views.messy_orders(spark, folder), target)
    return csv_files.read_for_profile(spark, target).data


@_query
def csv_scan_multiline(spark, folder):
    """Documents through CSV: their texts hold line feeds, quotes and commas."""
    target = scratch_path(spark, "csv")
    csv_files.write_csv(views.table(spark, folder, "documents"), target)
    return csv_files.read_for_profile(spark, target).data


@_query
def clean_export(spark, folder):
    source, target = scratch_path(spark, "csv"), scratch_path(spark, "csv")
    csv_files.write_csv(views.messy_with_headings(spark, folder), source)
    table = csv_files.read_for_cleaning(spark, source)
    cleaned = cleaning.clean_dataset(table.data, "Order ID", table.kinds)
    csv_files.write_csv(cleaned.rows, target, table.encoding)
    cells, _ = csv_files.read_cells(spark, target, table.encoding)
    return cells.select(*cleaned.data.columns)


@_query
def upload_stream(spark, folder):
    inbox = scratch_path(spark, "inbox")
    mo = views.messy_orders(spark, folder)
    by_year = mo.withColumn("batch", F.year(F.col("order_day").try_cast("date"))).repartition("batch")
    by_year.write.partitionBy("batch").option("header", True).csv(inbox)
    log = scratch_path(spark, "history")
    uploads.run_available(spark, inbox, log, scratch_path(spark, "offsets"), scratch_path(spark, "cleaned"))

    def total(part: int) -> Column:
        rows = F.regexp_extract("output_text", r"^rows (\d+) -> (\d+),", part)
        return F.coalesce(F.sum(rows.try_cast("bigint")), F.lit(0)).cast("bigint")

    return history.read_history(spark, log).groupBy("command").agg(
        F.count_if(F.col("success") == 0).alias("n_failed"), total(1).alias("rows_before"), total(2).alias("rows_after"),
    )


# --- history -----------------------------------------------------------------


@_query
def history_recent(spark, folder):
    return history.recent(views.history(spark, folder))


@_query
def history_by_user(spark, folder):
    return history.by_user(views.history(spark, folder), 7)


@_query
def history_by_command(spark, folder):
    return history.by_command(views.history(spark, folder), "click")


@_query
def history_failures(spark, folder):
    return history.failures(views.history(spark, folder))


@_query
def history_stats(spark, folder):
    return _rounded(history.totals(views.history(spark, folder)))


@_query
def history_by_type(spark, folder):
    return history.by_type(views.history(spark, folder))


@_query
def history_top_command(spark, folder):
    return history.top_command(views.history(spark, folder))


@_query
def history_exists(spark, folder):
    return history.exists(views.history(spark, folder))


def _logged(spark: SparkSession, folder: str) -> DataFrame:
    return views.history(spark, folder).select(
        "id", F.col("user_id").cast("string").alias("user_id"), "command",
        F.concat(F.lit("input "), F.col("id").cast("string")).alias("input_text"), F.lit("").alias("output_text"),
        F.lit("batch").alias("provider"), F.lit("none").alias("model"), "execution_time", "success",
        F.when(F.col("success") == 0, "failed").alias("error_message"), "duration_ms", "created_at",
    )


_LOG_COLUMNS = [
    "id", "user_id", "command", "input_text", "provider", "execution_time", "success", "error_message", "duration_ms",
]


@_query
def history_append(spark, folder):
    target = scratch_path(spark, "history")
    history.append_history(_logged(spark, folder), target)
    stored = history.read_history(spark, target)
    return stored.select(*_LOG_COLUMNS, F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@_query
def history_delete_user(spark, folder):
    first, second = scratch_path(spark, "history"), scratch_path(spark, "history")
    history.append_history(_logged(spark, folder), first)
    gone = history.delete_history(history.read_history(spark, first), second, "7")
    left = history.read_history(spark, second)
    return left.groupBy("command").agg(F.count(F.lit(1)).alias("n_left")).withColumn("n_deleted", F.lit(gone).cast("bigint"))


def _stored_history(spark: SparkSession, folder: str) -> history_table.HistoryTable:
    """The log in three batches, the second one sent twice."""
    table = history_table.HistoryTable(spark, scratch_path(spark, "history-table"), rows_per_file=2000)
    log = _logged(spark, folder).drop("id")
    number = F.pmod(F.unix_seconds(F.col("created_at").cast("timestamp")), F.lit(3))
    for batch in (0, 1, 1, 2):
        table.append(log.where(number == batch), f"third-{batch}")
    return table


_READ_COLUMNS = ["id", "user_id", "command", "execution_time", "success", "duration_ms"]


@_query
def history_stored_reads(spark, folder):
    """The four reads over the stored table, with the ids that it gave out."""
    table = _stored_history(spark, folder)
    reads = {"recent": table.recent(), "user": table.by_user("7"), "command": table.by_command("click"),
             "failures": table.failures()}
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(n).alias("kind"), *_READ_COLUMNS, F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
        for n, df in reads.items()])


@_query
def history_gapless_ids(spark, folder):
    return _stored_history(spark, folder).read().select("id", "user_id", "command", "duration_ms")


@_query
def history_kept_totals(spark, folder):
    """Totals after appends, a repeated batch and a deletion, without a read of the log; and what the deletion left."""
    table = _stored_history(spark, folder)
    gone = table.delete("7")
    files = len(table.version().files)
    table.compact()
    left = table.read().agg(F.count("*").alias("rows_left"), F.count_if(F.col("user_id") == "7").alias("of_user"))
    totals = _rounded(table.totals().withColumn("n_deleted", F.lit(gone).cast("bigint")))
    return totals.join(left).withColumn("fewer_files", F.lit(len(table.version().files) <= files))


# --- messages and logged SQL -------------------------------------------------


@_query
def parse_commands(spark, folder):
    return messages.parse_commands(views.chat_messages(spark, folder)).drop("text")


@_query
def csv_shares(spark, folder):
    return messages.csv_shares(views.file_messages(spark, folder)).drop("subtype")


@_query
def audit_rules(spark, folder):
    return query_audit.audit_rules(views.query_log(spark, folder))


@_query
def audit_by_rule(spark, folder):
    return query_audit.audit_by_rule(query_audit.audit_rules(views.query_log(spark, folder)))


# --- scalar functions --------------------------------------------------------


@_query
def scalar_functions(spark, folder):
    """Shortened text, whole milliseconds, megabytes, printed numbers."""
    return views.table(spark, folder, "documents").select(
        "doc_id",
        text.shortened(F.col("text")).alias("preview"),
        numbers.whole_milliseconds(F.col("n_chars") / 7.0).alias("duration_ms"),
        numbers.megabytes(F.octet_length("text").cast("bigint") * 1000).alias("megabytes"),
        numbers.plain_double_text(F.col("n_chars") / 8.0).alias("eighth"),
        numbers.looks_numeric(F.col("lang")).alias("numeric_lang"),
        dates.as_day_text(F.timestamp_seconds(F.col("n_chars") * 86400)).alias("day"),
    )
