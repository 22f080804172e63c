"""Operators on small frames with awkward contents."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleansheet.functions import dates, numbers, text
from cleansheet.operators import dedup, frequency, messages, quality, quantiles, query_audit, statistics
from cleansheet.operators.columns import nan_to_null
from cleansheet.operators.date_evidence import date_evidence, to_datetime_by_evidence
from cleansheet.operators.quantiles import exact_quantiles
from cleansheet.plans.cleaning import distinct_rows
from cleansheet.plans.profiling import profile_dataset
from cleansheet.registry import views


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def test_trim_takes_every_unicode_space(spark):
    assert sorted(text.WHITESPACE) == sorted(SPACES)
    assert one(spark, text.trimmed, "".join(SPACES) + "a b" + "".join(SPACES)) == "a b"
    assert one(spark, text.collapsed, "a" + "".join(SPACES) + "b") == "a b"


@pytest.mark.parametrize("name", [" Größe (cm) ", "a--b", "__x__", "$$$", "A  B", "naïve_Été 2²", "x.y/z", "1 2"])
def test_snake_case_on_driver_and_in_tables(spark, name):
    assert one(spark, text.snake_case, name) == text.snake_case_name(name)


@pytest.mark.parametrize("value", [
    "1", " 1.5 ", "1e5", "-.5", "5.", "inf", "-Infinity", "nan", "1_000", "1__0", "_1", "1d", "1f", "0x1", "", "a", "1e",
    "+1", "1 2", "1_0.0_1e1_0", "infinit", " 7",
])
def test_numeric_look(spark, value):
    try:
        float(value)
        expected = True
    except ValueError:
        expected = False
    assert one(spark, numbers.looks_numeric, value) == expected


def test_guarded_double(spark):
    for value, expected in [("1d", None), ("1f", None), (" 7 ", 7.0), ("inf", math.inf), ("-Infinity", -math.inf), ("nan", None)]:
        assert one(spark, numbers.to_double, value) == expected


@pytest.mark.parametrize(("value", "day"), [
    ("2024-01-02", "2024-01-02"), ("2024/01/02", "2024-01-02"), ("01-02-2024", "2024-01-02"), ("13/01/2024", "2024-01-13"),
    ("Jan 5 2024", "2024-01-05"), ("15 Feb 2024", "2024-02-15"), ("2024-01-02T10:11:12", "2024-01-02"),
    ("2024-01-02 10:11:12", "2024-01-02"), ("2024", None), ("2024-13-01", None), ("2024-02-30", None), ("2024-1-2", "2024-01-02"),
    ("2024-01/02x", None), ("soon", None), ("31-12-2024 23:59:59", "2024-12-31"),
    ("1/5/2024", "2024-01-05"), ("2024-01-05 10:30", "2024-01-05"), ("2024-01-05T10:30:00Z", "2024-01-05"),
    ("Jan 5, 2024", "2024-01-05"), ("5 January 2024", "2024-01-05"), ("2024-01-05 10:30:00.5", "2024-01-05"),
    ("may 5, 2024 1:05 pm", "2024-05-05"), ("2024/1/5 23:30 -02:00", "2024-01-06"), ("2024-01-05 13:00 PM", None),
    ("20240105", "2024-01-05"), ("5-Jan-2024", "2024-01-05"), ("05-Jan-24", "2024-01-05"), ("1/5/24", "2024-01-05"),
    ("5.1.2024", "2024-05-01"), ("13.1.2024", "2024-01-13"), ("Fri, 05 Jan 2024", "2024-01-05"), ("Sept 5, 2024", "2024-09-05"),
    ("January 2024", "2024-01-01"), ("Sept. 5, 2024", "2024-09-05"), ("Fri, 05 Jan 2024 10:00:00 GMT", "2024-01-05"),
    ("friday 5 january 2024", "2024-01-05"), ("1/5/69", "1969-01-05"), ("1/5/68", "2068-01-05"), ("20241305", None),
    ("12345678", None), ("1.5", None), ("1/5/2", None), ("Jan 24", None), ("5-Jan 2024", None), ("1.2.3.4", None),
    ("2024-01-05 23:30:00 +0200", "2024-01-05"), ("2024-01-05\n", None), ("Mon 2024", None),
    ("Jab 5 2024", None), ("2024-01-051", None), ("5 Junes 2024", None), ("2024-01-05 25:00", None),
])
def test_dates(spark, value, day):
    found = one(spark, dates.parse_any, value)
    assert (str(found)[:10] if found else None) == day
    fmt = one(spark, dates.first_format, value)
    assert (fmt is not None) == (day is not None)
    if fmt:
        assert str(one(spark, lambda c: dates.parse_with(c, fmt), value))[:10] == day


def test_order_and_century_follow_the_column(spark):
    rows = [("3/4/24", "1/2/70", "3/4/2024"), ("13/4/24", "3/4/2071", "4/13/2024"), ("5/6/24", "5/6/72", None), ("5/6/24", "5/6/72", "x")]
    df = spark.createDataFrame(rows, "eu string, late string, mixed string")
    found = {r["column_name"]: r for r in date_evidence(df).collect()}
    assert (found["eu"]["day_first"], found["eu"]["n_dates"], found["late"]["day_first"], found["late"]["last_year"]) == (
        True, 4, False, 2071)
    assert [tuple(s) for s in found["late"]["shapes"]] == [("MM/dd/yy", 3), ("MM/dd/yyyy", 1)]
    got = to_datetime_by_evidence(df).collect()
    assert [str(r["eu"])[:10] for r in got] == ["2024-04-03", "2024-04-13", "2024-06-05", "2024-06-05"]
    assert [str(r["late"])[:10] for r in got] == ["2070-01-02", "2071-03-04", "1972-05-06", "1972-05-06"]
    assert [r["mixed"] for r in got] == [r[2] for r in rows]


def test_formats_from_a_column(spark):
    rows = [("03/04/2024", "dd/MM/yyyy", "2024-04-03"), ("03/04/2024", "MM/dd/yyyy", "2024-03-04"), ("13/04/2024", None, "2024-04-13"),
            ("2024-04-03", "dd/MM/yyyy", None), ("x", None, None)]
    df = spark.createDataFrame(rows, "v string, f string, day string")
    for r in df.select("day", dates.as_day_text(dates.parse_as(F.col("v"), F.col("f"))).alias("got")).collect():
        assert r["got"] == (r["day"] or "")


def test_shortened(spark):
    assert one(spark, text.shortened, "x" * 101) == "x" * 100 + "..." and one(spark, text.shortened, "x" * 100) == "x" * 100


def test_digest_keeps_shifted_cells_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("ab", ""), ("a", "b"), ("~", None), ("a", None)], "x string, y string")
    assert dedup.duplicate_count(df).first()[0] == 1


def test_digest_of_doubles(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", -0.0), ("a", None), ("a", float("nan"))], "x string, y double")
    assert dedup.duplicate_count(nan_to_null(df)).first()[0] == 2


@pytest.mark.parametrize("kind", ["uniform", "hot", "few", "ends", "tiny"])
def test_narrowed_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(7)
    data = {
        "uniform": rng.normal(size=20_000),
        "hot": np.where(rng.random(20_000) < 0.34, 3.25, rng.lognormal(size=20_000)),
        "few": rng.integers(0, 4, 20_000).astype(float),
        "ends": np.repeat([1.0, 2.0], 10_000),
        "tiny": np.array([5.0, 1.0]),
    }[kind]
    df = spark.createDataFrame([(float(v), None if i % 5 else float(-v)) for i, v in enumerate(data)], "a double, b double")
    df = df.repartition(4)
    probabilities = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = exact_quantiles(df, ["a", "b"], probabilities, single_pass_cells=0, candidate_rows=50)
    assert got["a"] == pytest.approx(list(np.quantile(data, probabilities)))
    assert got["b"] == pytest.approx(list(np.quantile(-data[::5], probabilities)))


def test_description_is_the_same_on_both_paths(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    one_pass = statistics.describe_numeric(df).orderBy("column_name").collect()
    narrowed = statistics.describe_numeric(df, single_pass_cells=0).orderBy("column_name").collect()
    for a, b in zip(one_pass, narrowed, strict=True):
        assert list(a)[1:] == pytest.approx(list(b)[1:])


def test_column_without_values(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert exact_quantiles(df, ["a"], single_pass_cells=0) == {"a": [None] * 3}
    assert statistics.iqr_outliers(df).count() == 0


def test_top_values_and_modes_break_ties_by_value(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("c", None), ("c", None)], "x string, y string")
    assert [(r["value"], r["n"]) for r in frequency.top_values(df).orderBy("value_rank").collect()] == [
        ("c", 2), ("a", 1), ("b", 1)]
    assert {r[0]: r[1] for r in frequency.distinct_counts(df).collect()} == {"x": 3, "y": 0}
    assert {r[0]: r[1] for r in frequency.distinct_counts(df, approx=True).collect()} == {"x": 3, "y": 0}


def test_top_values_limit_before_the_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = frequency.top_values(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_long_values_are_told_apart(spark):
    long = "x" * 40
    rows = [(long + "b",), (long + "a",), (long + "a",), ("x" * 32,), ("x" * 33,), (long + "c",), ("y",), ("1" * 40,), ("1_" * 20 + "1",)]
    df = spark.createDataFrame(rows, "t string")
    assert [(r["value"], r["n"]) for r in frequency.top_values(df, k=4).orderBy("value_rank").collect()] == [
        (long + "a", 2), ("1" * 40, 1), ("1_" * 20 + "1", 1), ("x" * 32, 1)]
    assert frequency.distinct_counts(df).first()["n_unique"] == 8
    assert frequency.value_frequencies(df).where("numeric").count() == 2
    assert frequency.column_modes(df).first()["mode_value"] == long + "a"
    weighted = df.withColumn("w", F.when(df.t == "y", 9).otherwise(1).cast("long"))
    assert frequency.value_frequencies(weighted, ["t"], "w").agg(F.max("n")).first()[0] == 9


@pytest.mark.parametrize("single_pass", [None, 0])
def test_copies_as_weights(spark, single_pass, monkeypatch):
    if single_pass is not None:
        for module in (statistics, quantiles):
            monkeypatch.setattr(module, "SINGLE_PASS_CELLS", single_pass)
    rows = [(i % 7, float(i % 5) * 1e6, ["a", "b ", None, "2024-01-05", "7"][i % 5], ["x" * 50, "2"][i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:25] + [(None, None, None, None)] * 4, "i long, d double, t string, u string")
    df = df.withColumn("k", F.col("i") * 0 + 3)
    plain = profile_dataset(df, "p")
    weighted = profile_dataset(distinct_rows(df), "p", copies=dedup.COPIES)
    for name in ("rows", "missing", "duplicate_rows", "memory_bytes", "texts", "inconsistent", "quality_score", "recommendations"):
        assert getattr(plain, name) == getattr(weighted, name), name
    assert plain.column_types == weighted.column_types
    for c, facts in plain.numeric.items():
        assert weighted.numeric[c] == pytest.approx(facts)


def test_score_bounds(spark):
    def score(*v):
        return spark.range(1).select(quality.score(*[F.lit(x) for x in v])).first()[0]

    assert score(0, 0, 0, 0, 0) == 10.0 and score(10, 1, 10, 9, 1) == pytest.approx(0.3, abs=0.01)
    assert score(10, 11, 24, 1, 2) == 8.3


def test_commands(spark):
    said = ["<@U1> explain SELECT 1", "<@U1> CLEAN   select\n*", "<@U1> cleanup x", "<@U1> optimize", "hello <@U1>"]
    got = messages.parse_commands(spark.createDataFrame([(s,) for s in said], "text string")).collect()
    assert [(r["command"], r["argument"], r["missing_input"]) for r in got] == [
        ("explain", "SELECT 1", False), ("clean", "select\n*", False), ("clean", "up x", False), ("optimize", "", True),
    ]


def test_file_shares(spark):
    files = [[("a.txt", "u1"), ("B.CSV", "u2"), ("c.csv", "u3")], [("a.txt", "u1")], None]
    data = [(s, f) for s in ("file_share", "other") for f in files]
    df = spark.createDataFrame(data, "subtype string, files array<struct<name string, url_private_download string>>")
    assert [tuple(r) for r in messages.csv_shares(df).collect()] == [("file_share", "B.CSV", "u2")]


RULE_TEXTS = {
    "select_star": "select * from t where a = 1", "select_without_where": "select a from t",
    "delete_without_where": "delete from t", "update_without_where": "update t set a=1", "truncate": "truncate table t",
    "drop": "DROP TABLE t", "eq_null": "select a from t where b = null", "leading_wildcard_like":
    "select a from t where b like '%x'", "order_without_limit": "select a from t where b = 1 order by a",
    "function_on_column": "select a from t where year(d) = 2024", "cartesian_join": "select a from t, u where t.i=u.i",
    "having_without_group": "select a from t where b = 1 having a > 1", "unbalanced_parens": "select (a from t where b = 1",
    "injection_pattern": "select a from t where b = 'x' or 1=1", "select_without_from": "select 1 where 1 = 1",
    "distinct_used": "select distinct a from t where b = 1",
}


@pytest.mark.parametrize("rule", RULE_TEXTS)
def test_audit_rule(spark, rule):
    df = spark.createDataFrame([(1, RULE_TEXTS[rule])], "user_id int, input_text string")
    assert [r["rule"] for r in query_audit.audit_rules(df).collect()] == [rule]


def test_audit_of_clean_text(spark):
    df = spark.createDataFrame([(1, "select a from t where b = '; drop or 1=1 --(' limit 5")], "user_id int, input_text string")
    assert query_audit.audit_rules(df).count() == 0


def test_quantiles_have_the_same_bits_by_both_ways(spark):
    rows = [(float((i * 7919) % 1003) / 7 + (i % 13) * 0.1,) for i in range(1003)]
    df = spark.createDataFrame(rows, "v double")
    probabilities = tuple(p / 32 for p in range(1, 32))
    once = exact_quantiles(df, ["v"], probabilities)
    for parts in (1, 8):
        again = exact_quantiles(df.repartition(parts), ["v"], probabilities, single_pass_cells=0, candidate_rows=40)
        assert again == once


def test_halving_when_sketches_bring_no_progress(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "_SKETCH_SLACK", 1.0)
    df = spark.createDataFrame([(float(i % 50) ** 2 - 7,) for i in range(500)], "v double")
    assert exact_quantiles(df, ["v"], single_pass_cells=0, candidate_rows=5) == exact_quantiles(df, ["v"])


def test_checks_look_at_every_value(spark):
    df = spark.createDataFrame([(i, "x", "7") for i in range(80)] + [(80, " y", "7"), (81, "z", "seven")], "id long, a string, b string")
    assert [r["message"] for r in quality.recommendations(df, F.col("id")).collect()] == [
        "`a` has values with outer white space", "`b` holds numbers as text"]
    assert [tuple(r) for r in quality.inconsistent_columns(df).collect()] == [("b", 82, 81)]


def test_dates_of_a_large_table_are_read_alike_and_in_many_tasks(spark, tmp_path):
    """Each text by the plain rules of its form; a larger file is dealt to more tasks than there are cores."""
    cases = {
        "12/31/69": "1969-12-31 00:00:00", "12/31/68": "2068-12-31 00:00:00", "13/1/2026": "2026-01-13 00:00:00",
        "Mar 2026": "2026-03-01 00:00:00", "Sept. 2026 10:00Z": "2026-09-01 10:00:00", "May. 5 2026 12:30 am": "2026-05-05 00:30:00",
        "20260105T1:05PM": "2026-01-05 13:05:00", "1/5/26 10:00 -0530": "2026-01-05 15:30:00", "2026-2-30": None,
        "5-Jan-2026 13:00 pm": None, "\x012026-01-05": None, "2026": None, "2026-01-05 10:00:00+99:99": None,
    }
    rows = spark.createDataFrame(list(cases.items()), "c string, day string")
    read = rows.select("c", "day", F.date_format(dates.parse_any(F.col("c")), "yyyy-MM-dd HH:mm:ss").alias("read"))
    assert [r for r in read.collect() if r["read"] != r["day"]] == []
    years = rows.select("c", F.when(dates.is_date_like(F.col("c")), dates.written_year(F.col("c"))).alias("y")).collect()
    assert {r["c"]: r["y"] for r in years if r["y"]} == {
        c: 2026 for c in cases if "2026" in c and c not in ("\x012026-01-05", "2026")}

    spark.range(1_500_000, numPartitions=1).select(
        F.col("id").alias("o_orderkey"), F.current_date().alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    assert views.dated_orders(spark, str(tmp_path)).rdd.getNumPartitions() >= 8
    views_bytes, views.BYTES_PER_TASK = views.BYTES_PER_TASK, 1 << 16
    try:
        assert views.dated_orders(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        views.BYTES_PER_TASK = views_bytes
