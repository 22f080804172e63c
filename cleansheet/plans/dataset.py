"""CSV in, profile and cleaned CSV out: the whole run for one dataset."""

from __future__ import annotations

import posixpath
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cleansheet.operators.dedup import COPIES, ROW_ORDER
from cleansheet.plans.cleaning import Cleaned, CleaningReport, clean_dataset, distinct_rows, distinct_values
from cleansheet.plans.profiling import Profile, profile_dataset
from cleansheet.session import path_exists
from cleansheet.sources.csv_files import CsvError, CsvTable, read_for_cleaning, read_for_profile, stored, write_csv

_CLEANED = "_cleaned"


@dataclass
class DatasetRun:
    """A dataset before and after cleaning."""

    before: Profile
    cleaning: CleaningReport
    after: Profile


def profile_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> Profile:
    """Profile a CSV file or folder. It must be UTF-8."""
    table = stored(read_for_profile(spark, _given(path), multi_line))
    return profile_dataset(table.rows, posixpath.basename(path.rstrip("/")), kinds=table.kinds)


def output_path(spark: SparkSession, path: str, output_dir: str) -> str:
    """`<name>_cleaned.csv` in the output folder, stamped with the time if that exists."""
    stem = posixpath.splitext(posixpath.basename(path.rstrip("/")))[0]
    plain = f"{output_dir.rstrip('/')}/{stem}{_CLEANED}.csv"
    if not path_exists(spark, plain):
        return plain
    return f"{output_dir.rstrip('/')}/{stem}{_CLEANED}_{time.strftime('%Y%m%d_%H%M%S')}.csv"


def clean_csv(
    spark: SparkSession, path: str, output_dir: str, multi_line: bool | None = None, keep_order: bool = False
) -> Cleaned:
    """Clean a CSV file or folder and save the result in the encoding it came in.

    Row order costs a sort of the whole result, so it is kept only on request.
    """
    table = read_for_cleaning(spark, _given(path), multi_line)
    return _save(table, output_path(spark, path, output_dir), keep_order)


def run_dataset(spark: SparkSession, path: str, output_dir: str, multi_line: bool | None = None) -> DatasetRun:
    """Profile, clean, save, and profile what was saved. The distinct rows are stored, so later passes skip the text."""
    name = posixpath.basename(path.rstrip("/"))
    table = read_for_cleaning(spark, _given(path), multi_line)
    distinct = distinct_rows(table.rows)
    values = distinct_values(distinct)
    before = profile_dataset(distinct, name, kinds=table.kinds, copies=COPIES, frequencies=values)
    cleaned = _save(table, output_path(spark, path, output_dir), distinct=distinct, frequencies=values)
    saved = cleaned.report.output
    if not cleaned.data.columns:
        raise CsvError(f"no column is left after cleaning: {path}")
    again = stored(read_for_cleaning(spark, saved, multi_line))
    after = profile_dataset(again.rows, posixpath.basename(saved), kinds=again.kinds)
    return DatasetRun(before, cleaned.report, after)


def _given(path: str) -> str:
    if not path.strip():
        raise CsvError("no CSV path was given")
    return path.strip()


def _save(
    table: CsvTable, target: str, keep_order: bool = False, distinct: DataFrame | None = None, frequencies: DataFrame | None = None
) -> Cleaned:
    cleaned = clean_dataset(table.rows, kinds=table.kinds, distinct=distinct, frequencies=frequencies)
    if cleaned.data.columns:
        write_csv(cleaned.rows, target, table.encoding, ROW_ORDER if keep_order else None)
        cleaned.report.output = target
    return cleaned


def report_rows(spark: SparkSession, run: DatasetRun) -> DataFrame:
    """The run as (position, section, field, value) rows, for showing side by side."""
    before, cleaning, after = run.before, run.cleaning, run.after

    def listed(names) -> str:
        return ", ".join(names) or "-"

    def quality(p: Profile) -> dict[str, str]:
        return {
            "quality score": f"{p.quality_score}/10", "repeated rows": str(p.duplicate_rows),
            "missing cells": str(p.total_missing),
        }

    sections = {
        "input": {
            "file": before.name, "rows": str(before.rows), "columns": str(before.columns),
            "megabytes": f"{before.memory_bytes / (1024 * 1024):.2f}",
        },
        "before": quality(before),
        "cleaning": {
            "rows dropped": str(cleaning.rows_removed),
            "repeated rows dropped": str(cleaning.duplicates_removed),
            "empty rows dropped": str(cleaning.empty_rows_removed),
            "columns dropped": listed(cleaning.columns_removed),
            "columns retyped": listed(cleaning.columns_converted),
            "columns renamed": listed(f"{old} to {new}" for old, new in cleaning.renamed.items()),
            "steps": "; ".join(text for _, text in cleaning.actions()),
        },
        "after": quality(after),
        "output": {"file": posixpath.basename(cleaning.output)},
    }
    rows = [(s, f, v) for s, fields in sections.items() for f, v in fields.items()]
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "position bigint, section string, field string, value string"
    )

