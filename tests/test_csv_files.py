"""CSV reading and writing."""

import io

import pandas as pd
import pytest

from cleansheet.operators.dedup import ROW_ORDER
from cleansheet.sources.csv_files import (
    CsvError, csv_text, header_names, read_cells, read_for_cleaning, read_for_profile, write_csv,
)
from cleansheet.sources.encodings import file_encodings

PANDAS_KINDS = {"int64": "int64", "uint64": "uint64", "float64": "float64", "bool": "bool", "object": "text", "str": "text"}


def values(table):
    return [tuple(r) for r in table.rows.orderBy(ROW_ORDER).drop(ROW_ORDER).collect()]


@pytest.mark.parametrize("cells", [
    ["1", "2"], ["1", ""], ["1", "NULL"], ["9223372036854775807", "9223372036854775808"], ["9223372036854775808", "-1"],
    ["99999999999999999999", "1"], ["1.5", "2"], ["1e3", "inf"], ["True", "false"], ["True", "1"], ["", "NA"],
    ["1d", "2"], ["1_000", "2"], [" 1", "2 "], ["a", "1"], ["2024-01-01", "2024-01-02"], ["-0", "+5"], ["True", "yes"],
    ["1,000", "2"], ["n/a", "null"], [".5", "5."], ["0x1A", "1"], ["Infinity", "-inf"], ["9223372036854775808", ""],
])
def test_kinds_agree_with_pandas(spark, csv, cells):
    text = "c,k\n" + "".join(f'"{c}",{i}\n' for i, c in enumerate(cells))
    expected = PANDAS_KINDS[str(pd.read_csv(io.StringIO(text))["c"].dtype)]
    assert read_for_profile(spark, csv(text)).kinds["c"] == expected


def test_mixed_bool(spark, csv):
    table = read_for_profile(spark, csv("a,b\nTrue,1\n,2\nFALSE,3\n"))
    assert table.kinds["a"] == "mixed_bool" and [r[0] for r in values(table)] == [True, None, False]


def test_short_rows_are_padded_and_blank_lines_skipped(spark, csv):
    table = read_for_profile(spark, csv('a,b,c\n1,x\n\n2,"y, ""q""",z\n'))
    assert values(table) == [(1, "x", None), (2, 'y, "q"', "z")]


@pytest.mark.parametrize("text", ["a,b\n1,2\n1,2,3\n", 'a,b\n1,2\n1,"2,x",3\n'])
def test_long_rows_are_an_error(spark, csv, text):
    with pytest.raises(CsvError, match="more cells"):
        read_for_profile(spark, csv(text))


def test_quoted_commas_are_not_cells(spark, csv):
    assert values(read_for_profile(spark, csv('a,b,c\n1,"x,y,z"\n')))[0][1] == "x,y,z"


def test_headers():
    assert header_names(["a", "a", None, "a", "a.1"]) == ["a", "a.1", "Unnamed: 2", "a.2", "a.1.1"]


def test_headers_that_differ_in_case(spark, csv):
    assert header_names(["a", "A", "a"]) == ["a", "A.1", "a.2"]
    assert values(read_for_profile(spark, csv("a,A\n1,x\n"))) == [(1, "x")]


def test_quoted_newlines_are_noticed(spark, csv):
    table = read_for_profile(spark, csv('id,note\n1,"hello\nworld"\n2,ok\n'))
    assert values(table) == [(1, "hello\nworld"), (2, "ok")] and table.kinds["id"] == "int64"


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "b.csv").write_text("name,id\ny,2\n")
    with pytest.raises(CsvError, match="differ in header"):
        read_for_cleaning(spark, str(tmp_path))


@pytest.mark.parametrize("text", ["", "a,b\n"])
def test_without_rows(spark, csv, text):
    with pytest.raises(CsvError):
        read_for_profile(spark, csv(text))


def test_missing_file(spark, tmp_path):
    with pytest.raises(CsvError, match="not found"):
        read_for_cleaning(spark, str(tmp_path / "none.csv"))


@pytest.mark.parametrize(("raw", "encoding", "text"), [
    ("é€".encode(), "utf-8-sig", "é€"), ("﻿é".encode(), "utf-8-sig", None),
    ("é€".encode("cp1252"), "cp1252", "é€"), (b"\xe9\x81", "latin-1", "é\x81"),
])
def test_encodings(spark, csv, tmp_path, raw, encoding, text):
    path = csv(b"name,v\n" + raw + b",1\nx,2\n")
    assert [r["encoding"] for r in file_encodings(spark, path).collect()] == [encoding]
    table = read_for_cleaning(spark, path)
    assert table.encoding == encoding
    if text is not None:
        assert values(table)[0][0] == text
        out = str(tmp_path / "out")
        write_csv(table.rows.coalesce(1), out, encoding, order=ROW_ORDER, byte_order_mark=False)
        written = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
        assert written == b"name,v\n" + raw + b",1\nx,2\n"
    if encoding != "utf-8-sig":
        with pytest.raises(CsvError, match="not UTF-8"):
            read_for_profile(spark, path)


def test_byte_order_mark_is_skipped_on_read(spark, csv):
    assert read_for_profile(spark, csv("﻿a,b\n1,2\n")).kinds == {"a": "int64", "b": "int64"}


def test_printed_cells(spark):
    numbers = [0.0, 5.0, -2.5, 9999999.0, 12345678.9, 1e15, 1e16, 1.5e300, 0.0005, 0.00001, 123456.789, float("inf"), 1 / 3,
               0.0012345678901234567, 0.00012345678901234567, 1234567890123456.7]
    df = spark.createDataFrame([(v, v > 1) for v in numbers], "v double, b boolean")
    expected = pd.DataFrame({"v": numbers, "b": [v > 1 for v in numbers]}).to_csv(index=False).splitlines()[1:]
    assert [",".join(r) for r in csv_text(df).collect()] == expected


def test_row_order_survives_a_large_file(spark, csv):
    path = csv("n,t\n" + "".join(f"{i},x{i}\n" for i in range(200_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        rows, _ = read_cells(spark, path)
        assert rows.rdd.getNumPartitions() > 4
        got = [int(r["n"]) for r in rows.orderBy(ROW_ORDER).select("n").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(200_000))
