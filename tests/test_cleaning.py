"""Stage order and edges of the cleaning pipeline."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cleansheet.operators.dedup import ROW_ORDER
from cleansheet.operators.naming import standard_names
from cleansheet.plans.cleaning import clean_dataset
from cleansheet.sources.csv_files import read_for_cleaning


def clean(spark, csv, text):
    table = read_for_cleaning(spark, csv(text))
    return clean_dataset(table.rows, kinds=table.kinds)


def rows(cleaned):
    return [tuple(r) for r in cleaned.rows.orderBy(ROW_ORDER).drop(ROW_ORDER).collect()]


def test_rows_equal_only_after_trimming_stay(spark, csv):
    c = clean(spark, csv, "a,b\nx,1\n x,1\ny,2\n")
    assert c.report.duplicates_removed == 0 and rows(c) == [("x", 1), ("x", 1), ("y", 2)]


def test_duplicates_are_found_on_typed_values(spark, csv):
    c = clean(spark, csv, "a,b\n1,x\n1.0,x\n2,y\n")
    assert c.report.duplicates_removed == 1


def test_dash_column_becomes_unknown_then_constant(spark, csv):
    c = clean(spark, csv, "a,b\n-,1\n -,2\n-,3\n")
    assert c.report.filled == {"a": 3} and c.report.constant_columns == ["a"] and c.report.empty_columns == []


def test_constant_is_judged_on_converted_values(spark, csv):
    c = clean(spark, csv, 'a,b\n"1,000",1\n1000,2\n"1,000",3\n')
    assert c.report.numeric_converted == ["a"] and c.report.constant_columns == ["a"]


def test_nine_in_ten_numbers_convert_and_the_tenth_is_lost(spark, csv):
    c = clean(spark, csv, "a,b\n" + "".join(f"{i},q{i}\n" for i in range(9)) + "x,q9\n")
    assert c.report.numeric_converted == ["a"] and rows(c)[-1] == (None, "q9")
    c = clean(spark, csv, "a,b\n" + "".join(f"{i},q{i}\n" for i in range(8)) + "x,q8\n")
    assert c.report.numeric_converted == []


def test_suffixed_and_underscored_numbers_do_not_convert(spark, csv):
    c = clean(spark, csv, "a,b\n1d,x\n2f,y\n1_000,z\n")
    assert c.report.numeric_converted == []


def test_first_value_fixes_the_date_format(spark, csv):
    month_first = clean(spark, csv, "d,n\n02-01-2024,1\n13-01-2024,2\n14-01-2024,3\n")
    assert month_first.report.dates_converted == []
    day_first = clean(spark, csv, "d,n\n13-01-2024,1\n02-01-2024,2\n")
    assert day_first.report.dates_converted == ["d"]
    assert [str(r[0]) for r in rows(day_first)] == ["2024-01-13 00:00:00", "2024-01-02 00:00:00"]


def test_filled_first_row_decides_the_format(spark, csv):
    # Two of three values are day first; the filled first row makes them the format.
    c = clean(spark, csv, "d,n\n,1\n13-01-2024,2\n13-01-2024,3\n02-01-2024,4\n")
    assert c.report.dates_converted == ["d"]


def test_formats_are_tried_per_value_when_the_first_has_none(spark, csv):
    lines = "".join(f"2024-01-{d:02d},{d}\n" for d in range(1, 10)) + "Jan 5 2024,10\n"
    c = clean(spark, csv, "d,n\nsoon,0\n" + lines)
    assert c.report.dates_converted == ["d"] and rows(c)[0][0] is None and str(rows(c)[-1][0])[:10] == "2024-01-05"


def test_categories_and_whitespace(spark, csv):
    c = clean(spark, csv, "g,t\n MALE,a   b\nfemale,c\t\td\nMale,e\n")
    assert c.report.categories_standardized == ["g"]
    assert rows(c) == [("Male", "a b"), ("Female", "c d"), ("Male", "e")]


def test_bool_with_gaps_takes_the_mode_and_counts_as_converted(spark, csv):
    c = clean(spark, csv, "a,b\nTrue,1\nFalse,2\nTrue,3\n,4\n")
    assert c.report.numeric_converted == ["a"] and rows(c)[-1] == (True, 4)


def test_mode_tie_takes_the_smallest(spark, csv):
    c = clean(spark, csv, "a,b\nz,1\ny,2\n,3\n")
    assert rows(c)[-1] == ("y", 3)


def test_single_row(spark, csv):
    c = clean(spark, csv, "a,b\n1,x\n")
    assert c.report.rows_after == 1 and c.report.columns_after == 0


def test_names_stay_unique():
    assert standard_names(["a", "A", "a_2", "  ", "Größe (cm)", "x-y"]) == ["a", "a_2", "a_2_2", "column", "größe_cm", "xy"]


cell = st.sampled_from(["", "-", "a", "b ", " b", "1", "1.5", "1,000", "2024-01-02", "yes", "NO", "NULL", "nan"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(cell, cell, cell), min_size=1, max_size=12))
def test_row_and_fill_properties(spark, csv, data):
    body = "".join(",".join(f'"{c}"' for c in r) + "\n" for r in data)
    c = clean(spark, csv, "p,q,r\n" + body)
    report = c.report
    assert report.rows_after == report.rows_before - report.duplicates_removed - report.empty_rows_removed
    assert c.data.count() == report.rows_after
    converted = set(report.columns_converted)
    for row in c.data.collect():
        for name, value in row.asDict().items():
            assert value is not None or name in converted


@pytest.mark.parametrize("order", [None, "n"])
def test_frames_without_hidden_order(spark, order):
    df = spark.createDataFrame([(2, "02-01-2024"), (1, "13-01-2024")], "n int, d string")
    c = clean_dataset(df, order)
    assert c.report.dates_converted == (["d"] if order else [])
