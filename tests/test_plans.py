"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from cleansheet.operators import frequency, sketch_profile
from cleansheet.plans import cleaning, profiling

FOLDER = "/root/testdata/sf0.001"
LAZY = [
    "describe_numeric", "missing_by_column", "duplicate_count", "distinct_counts", "top_values", "column_mode",
    "quality_score", "recommendations", "iqr_outliers", "infer_types", "snake_case_names", "to_numeric", "to_datetime",
    "dedup_rows", "collapse_ws", "landing_audit", "safe_names", "history_recent", "history_by_user", "history_stats",
    "history_by_type", "parse_commands", "csv_shares", "audit_rules", "audit_by_rule",
]


def plan(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairing_and_no_python(spark, name):
    text = plan(spark, name)
    for word in ("CartesianProduct", "NestedLoop", "Python", "ArrowEval"):
        assert word not in text


@pytest.mark.parametrize("name", [n for n in LAZY if n.startswith(("dedup", "distinct", "duplicate", "audit_by", "history_by_type"))])
def test_groups_are_folded_before_the_exchange(spark, name):
    text = plan(spark, name)
    assert "Aggregate" in text[text.rindex("Exchange hashpartitioning"):]


def test_newest_rows_need_no_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "history_recent")


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "history_by_user")
    assert "EqualTo(user_id,7)" in text and "props" not in text


@pytest.mark.parametrize("name", ["audit_rules", "parse_commands", "csv_shares", "collapse_ws"])
def test_row_wise_queries_do_not_shuffle(spark, name):
    text = plan(spark, name)
    assert "Exchange hashpartitioning" not in text and "Exchange SinglePartition" not in text


def test_profile_and_cleaning_share_one_shuffle_of_rows(spark, monkeypatch):
    rows, digests = [], []
    count_copies, duplicate_count = cleaning.count_copies, profiling.duplicate_count
    monkeypatch.setattr(cleaning, "count_copies", lambda *a: rows.append(1) or count_copies(*a))
    monkeypatch.setattr(profiling, "duplicate_count", lambda *a: digests.append(1) or duplicate_count(*a))
    for name, after in (("before_after", 1), ("dataset_report", 1)):
        rows.clear(), digests.clear()
        entry.queries()[name](spark, FOLDER).collect()
        assert (len(rows), len(digests)) == (1, after)  # 32-byte digests of what cleaning left


def test_long_texts_do_not_travel(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counted = frequency.value_frequencies(df)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(position#\d+, head#\d+, digest#\d+, ", counted)
    assert "keys=[position" in counted and counted.count("Exchange") == 1
    top = frequency.top_values(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in top and "LeftSemi" in top


def test_merged_profiles_read_sketches_only(spark, tmp_path):
    df = spark.read.parquet(f"{FOLDER}/events.parquet")
    sketch_profile.store_sketches(df, df.event_type, str(tmp_path / "s"), ["user_id", "value"])
    merged = sketch_profile.merged_profile(sketch_profile.read_sketches(spark, str(tmp_path / "s")))
    assert all("/s/" in f for f in merged.inputFiles()) and merged.count() == 2
