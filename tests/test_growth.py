"""What keeps the work of a query in proportion to its input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cleansheet.functions import dates, numbers, text
from cleansheet.operators import dedup, frequency, quality, quantiles, statistics
from cleansheet.plans import cleaning, dataset, profiling, uploads
from cleansheet.registry import queries
from cleansheet.sources import csv_files, encodings, records

WRITTEN = ["2020-01-31", "2020-1-5", "2020-13-01", "31/01/2020", "01/31/2020", "20200131", "2020013", " 2020-01-31", "2020-01-31\n",
           "2020-01-31 10:00", "0000-00-00", "\x012020-01-31", "Jan 5, 2020", "", None]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_day_of_numbers_is_read_as_in_any_format(spark):
    texts = spark.createDataFrame([(t,) for t in WRITTEN], "t string")
    for fmt in [f for f in dates.DAY_FORMATS if "yyyy" in f and "MMM" not in f]:
        assert dates._numbers_of(fmt), fmt
        t, f = F.col("t"), F.lit(fmt)
        rows = texts.select("t", dates.parse_with(t, fmt).alias("a"), dates.parse_as(t, f).alias("b"),
                            dates.parse_among(t, f, [fmt, "MMM d, yyyy"]).alias("c")).collect()
        assert all(r["a"] == r["b"] == r["c"] for r in rows), (fmt, rows)
    assert dates._numbers_of("MMM d, yyyy") is None and dates._numbers_of("MM/dd/yy") is None


def test_columns_of_uploads_are_surveyed_without_a_sort(spark):
    cells = spark.createDataFrame([(0, 0, 1, False, ["a", "1"], ["text", "text"])],
                                  "upload int, at long, copies long, is_empty boolean, cells array<string>, kinds array<string>")
    surveyed = uploads._survey(uploads._exploded(cells))
    assert "SortAggregate" not in _plan(surveyed)
    assert {r["position"]: r["kind"] for r in surveyed.collect()} == {0: "text", 1: "text"}


def test_a_search_for_quantiles_computes_its_input_once(spark, monkeypatch):
    seen = []
    keep = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda df, label: seen.append(label) or keep(df, label))
    monkeypatch.setattr(statistics, "SINGLE_PASS_CELLS", 10)
    monkeypatch.setattr(quantiles, "SINGLE_PASS_CELLS", 10)
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("a"), (-F.col("id")).alias("b"), F.lit("x").alias("t"))
    statistics.describe_numeric(df, single_pass_cells=10).collect()
    assert seen == ["numbers"]


def test_neighbouring_ranks_are_searched_as_one():
    wanted = [quantiles._Wanted("a", r, 0.0, 9.0, 0, 1000) for r in (750, 249, 500, 250, 499, 749)]
    wanted.append(quantiles._Wanted("b", 251, 0.0, 9.0, 0, 1000))
    assert [[w.rank for w in f] for f in quantiles._families(wanted)] == [[249, 250], [499, 500], [749, 750], [251]]


def test_lines_of_records_travel_twice(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,"p\n\nq"\n3,z\n')
    joined, unclosed = records.assemble(records.raw_lines(spark, str(tmp_path)))
    rows = joined.collect()
    assert sorted(r["record"] for r in rows) == ['1,"x\ny"', '2,"p\n\nq"', "3,z", "a,b"] and unclosed.isEmpty()
    # Behind the stored lines one shuffle is left, of the lines to be joined, and no window over them.
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1


def test_advice_computes_its_input_once(spark):
    df = spark.range(20).select(F.col("id"), F.concat(F.lit(" "), F.col("id").cast("string")).alias("t"))
    advice = quality.recommendations(df, F.col("id"))
    assert "Range" not in advice._jdf.queryExecution().optimizedPlan().toString()
    assert [r["message"] for r in advice.orderBy("message_order").collect()] == [
        "`t` has values with outer white space", "`t` holds numbers as text"]


def test_bloom_filters_are_as_small_as_their_files(spark, tmp_path):
    from cleansheet.operators.history_table import HistoryTable

    rows = spark.range(4000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("user_id"), F.lit("c").alias("command"), F.lit("i").alias("input_text"),
        F.lit("o").alias("output_text"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit(1.0).alias("execution_time"),
        F.lit(1).alias("success"), F.col("id").alias("duration_ms"), F.timestamp_seconds("id").alias("created_at"))
    table = HistoryTable(spark, str(tmp_path / "h"), rows_per_file=1000)
    table.append(rows, "a")
    files = list((tmp_path / "h" / "data").rglob("*.parquet"))
    assert len(files) == 4 and all(f.stat().st_size < 200_000 for f in files)


def test_cleaning_computes_a_step_once(spark):
    df = spark.createDataFrame([(" 1,000 ", "x"), ("-", "y")], "a string, b string")
    plan = cleaning.ColumnPlan("a", True, missing=1, fill="7", number="double")
    cleaned = cleaning.in_steps(df, {"a": plan.steps()}, "b")
    assert [tuple(r) for r in cleaned.collect()] == [(1000.0, "x"), (7.0, "y")]
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("replace(") <= 4


def test_lines_of_files_are_folded_without_a_sort(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("\ufeffa,b\n1,2\n")
    (tmp_path / "b+c.csv").write_text("a,b\n3,4\n")
    (tmp_path / "c.csv").write_text('b,a\n3,"4\n"\n')
    facts = encodings.file_facts(spark, str(tmp_path))
    assert "SortAggregate" not in _plan(facts)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in facts.collect()}
    assert set(rows) == {"a b.csv", "b+c.csv", "c.csv"} and [rows[n]["open_quotes"] for n in sorted(rows)] == [False, False, True]
    assert rows["a b.csv"]["header"] == rows["b+c.csv"]["header"] != rows["c.csv"]["header"]


def test_a_cleaned_file_is_not_stored_before_its_distinct_rows(spark, tmp_path, csv, monkeypatch):
    monkeypatch.setattr(dataset, "stored", lambda table: pytest.fail("stored"))
    cleaned = dataset.clean_csv(spark, csv("a,b\n 1,x\n 1,x\n2,y\n"), str(tmp_path / "out"))
    assert cleaned.report.duplicates_removed == 1 and cleaned.data.count() == 2


def test_the_view_of_before_and_after_is_not_stored(spark, monkeypatch):
    seen = []
    keep = queries.materialize
    monkeypatch.setattr(queries, "materialize", lambda df, label: seen.append(label) or keep(df, label))
    queries.queries()["before_after"](spark, "/root/testdata/sf0.001")
    assert seen == ["cleaned"]


def test_quick_looks_change_no_result(spark):
    ends = ["", "a", "1", " ", "\t", "\xa0", "\u2028", "\x85", ",", "+", "-", ".", "e", "F", "\r\n", "é", "\x1c", "١"]
    texts = [a + m + b for a in ends for b in ends for m in ("", "2 3", "12,5", "nf", "1e5")] + WRITTEN
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    cut = F.btrim(t, F.lit(text.WHITESPACE))
    number = F.when(t.rlike(r"(?i)^[\s\d,.+\-einfty]+$"), F.btrim(F.replace(t, F.lit(","), F.lit("")), F.lit(text.WHITESPACE)))
    other = df.where(~(
        text.trimmed(t).eqNullSafe(cut) & numbers.number_text(t).eqNullSafe(number)
        & numbers.is_number(t).eqNullSafe(t.rlike(numbers.NUMBER))
        & F.coalesce(dates.is_date_like(t), F.lit(False)).eqNullSafe(
            F.coalesce(F.octet_length(t).between(6, 64) & t.rlike(dates.DATE_LIKE), F.lit(False)))))
    assert other.collect() == []


def test_an_iso_day_is_read_as_it_stands(spark):
    rows = spark.createDataFrame([(x,) for x in WRITTEN], "t string").select(
        "t", dates.parse_any(F.col("t")).cast("string").alias("d")).collect()
    days = {r["t"]: r["d"] for r in rows}
    assert days["2020-01-31"] == "2020-01-31 00:00:00" and days["2020-1-5"] == "2020-01-05 00:00:00"
    assert days["2020-13-01"] is None and days["2020-01-31\n"] is None and days["20200131"] == "2020-01-31 00:00:00"


def test_doubles_are_printed_with_a_point(spark):
    printed = {0.0: "0.0", -0.0: "0.0", 0.1: "0.1", 0.001: "0.001", 0.00099: "0.00099", 5e-5: "5e-05", 123.0: "123.0", -7.5: "-7.5",
               9999999.0: "9999999.0", 1e7: "10000000.0", 12345678.25: "12345678.25", -54000000.0: "-54000000.0", 1e15: "1000000000000000.0",
               1e16: "1e+16", float("inf"): "inf", float("-inf"): "-inf"}
    rows = spark.createDataFrame([(v, t) for v, t in printed.items()], "v double, t string").select(
        "v", "t", numbers.plain_double_text(F.col("v")).alias("p")).collect()
    assert [r for r in rows if r["p"] != r["t"]] == []
    plan = spark.range(1).select(numbers.plain_double_text(F.col("id").cast("double")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("1.0E7") < plan.index("decimal(38,22)")  # the decimal is the last resort


def test_equal_short_values_are_looked_at_once(spark):
    long = "x" * 40
    df = spark.createDataFrame([(" a ", long, True), (" a ", long + "y", None), (None, "b", True)], "s string, t string, f boolean")
    distinct = cleaning.distinct_rows(df)
    values = cleaning.distinct_values(distinct)
    cells = frequency.counted_cells(distinct, ["s", "t", "f"], values, dedup.COPIES)
    assert sorted(tuple(r) for r in cells.collect()) == [
        (0, " a ", 2, 2), (1, "b", 1, 1), (1, long, 1, 1), (1, long + "y", 1, 1), (2, "true", 2, 2)]
    cleaned = cleaning.clean_dataset(df, distinct=distinct, frequencies=values)
    assert sorted(tuple(r) for r in cleaned.data.collect()) == [("b",), (long,), (long + "y",)]
    assert cleaned.report.filled == {"s": 1, "f": 1} and cleaned.report.constant_columns == ["s", "f"]


def test_a_profile_of_known_values_is_the_same(spark):
    texts = [" 1", "1", "2020-01-31", "x" * 40 + "1", None, "", "12"]
    rows = [(a, b, i) for i, a in enumerate(texts) for b in ("2020-01-31", "2021-02-28", " " * 40)[:i % 3 + 1]] * 2
    df = spark.createDataFrame(rows, "a string, b string, i int")
    distinct = cleaning.distinct_rows(df)
    known = profiling.profile_dataset(distinct, "p", F.col("i"), copies=dedup.COPIES, frequencies=cleaning.distinct_values(distinct))
    plain = profiling.profile_dataset(df, "p", F.col("i"))
    assert (known.texts, known.inconsistent, known.recommendations) == (plain.texts, plain.inconsistent, plain.recommendations)
    told = [message for _, message in quality.text_recommendations(df, F.col("i"))]
    assert told and known.recommendations[-len(told):] == told


def _largest_method(df) -> int:
    """Bytes of the largest method that is generated for a frame; above 8,000 it is not compiled."""
    package = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    parts = package.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max((parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())), default=0)


def test_printing_doubles_stays_small_enough_to_be_compiled(spark):
    df = spark.range(3).select(*[(F.col("id") / (i + 3)).alias(f"c{i}") for i in range(6)])
    assert _largest_method(csv_files.csv_text(df)) < 8000


def test_equal_short_cells_are_folded_before_their_kind_is_told(spark, csv, monkeypatch):
    asked = []
    keep = csv_files.cell_class
    monkeypatch.setattr(csv_files, "cell_class", lambda c: asked.append(str(c)) or keep(c))
    path = csv("a,b,c,d,e\n1,1,true,1,\n1,,true,%s,\n2,2.5,,3,\n" % ("9" * 40))
    kinds = csv_files.read_for_profile(spark, path).kinds
    assert kinds == {"a": "int64", "b": "float64", "c": "mixed_bool", "d": "text", "e": "float64"}
    assert any("short" in c for c in asked)
