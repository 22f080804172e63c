"""Records that span lines, read in parts, against a reader that takes each file whole."""

import random

import pytest
from pyspark.sql import functions as F

from cleansheet.operators.dedup import ROW_ORDER
from cleansheet.sources.csv_files import CsvError, read_for_cleaning, read_for_profile, write_csv
from cleansheet.sources.records import assemble, raw_lines


@pytest.fixture()
def small_parts(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def whole(spark, path, names):
    reader = spark.read.option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"')
    rows = reader.schema(", ".join(f"{n} string" for n in names)).csv(path).collect()
    return [tuple(r) for r in rows][1:]


def cells_of(table):
    return [tuple(r) for r in table.rows.orderBy(ROW_ORDER).drop(ROW_ORDER).collect()]


def random_file(rng, rows):
    def cell():
        kind = rng.random()
        word = "".join(rng.choices("abc xyz", k=rng.randint(0, 12)))
        if kind < 0.25:
            return '"' + word + rng.choice(["\n", "\n\n", ',\n"",', '""', ","]) * rng.randint(1, 4) + word + '"'
        if kind < 0.35:
            return "t" + word + '"' + word  # a stray quote
        if kind < 0.4:
            return '"' + "long\n" * rng.randint(1, 60) + '"'
        return "t" + word

    return "id,a,b\n" + "".join(f"{i}x,{cell()},{cell()}\n" for i in range(rows))


@pytest.mark.parametrize("size", [64, 200, 1000, 100_000])
def test_parts_of_any_size_give_the_same_records(spark, csv, small_parts, size):
    path = csv(random_file(random.Random(size), 150))
    expected = whole(spark, path, ["id", "a", "b"])
    small_parts(size)
    table = read_for_profile(spark, path)
    assert cells_of(table) == expected
    if size < 1000:
        assert raw_lines(spark, path).rdd.getNumPartitions() > 3


def test_one_cell_over_many_parts(spark, csv, small_parts):
    long = "line, with \"\"quotes\"\"\n" * 400
    path = csv(f'id,note\n1,"{long}"\n2,ok\n3,"{long}"\n')
    small_parts(500)
    assert cells_of(read_for_profile(spark, path)) == [(1, long.replace('""', '"')), (2, "ok"), (3, long.replace('""', '"'))]


def test_line_endings_and_blank_lines(spark, csv):
    path = csv('id,note\r\n1,"a\r\nb"\r\n\r\n  \r\n2,x\r\n')
    assert cells_of(read_for_profile(spark, path)) == [(1, "a\r\nb"), (2, "x")]


def test_header_that_spans_lines(spark, csv):
    table = read_for_profile(spark, csv('﻿id,"two\nlines"\n1,"a\nb"\n'))
    assert list(table.kinds) == ["id", "two\nlines"] and cells_of(table) == [(1, "a\nb")]


def test_open_end_is_an_error(spark, csv):
    with pytest.raises(CsvError, match="never closed"):
        read_for_profile(spark, csv('id,note\n1,"a\nb\n2,c\n'))


def test_long_records_are_an_error(spark, csv):
    with pytest.raises(CsvError, match="1 row.s. have more cells"):
        read_for_profile(spark, csv('id,note\n1,"a\nb"\n2,"c\nd",e\n'))


def test_several_files(spark, tmp_path, small_parts):
    for i in range(4):
        (tmp_path / f"{i}.csv").write_text("id,note\n" + "".join(f'{i}{k},"n\n{k}"\n' for k in range(30)))
    small_parts(150)
    table = read_for_cleaning(spark, str(tmp_path))
    assert sorted(cells_of(table)) == sorted((int(f"{i}{k}"), f"n\n{k}") for i in range(4) for k in range(30))
    (tmp_path / "9.csv").write_text('note,id\n"x\ny",1\n')
    with pytest.raises(CsvError, match="differ in header"):
        read_for_cleaning(spark, str(tmp_path))


def test_files_of_several_encodings_are_one_dataset(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("größe,v\né€,1\n".encode())
    (tmp_path / "b.csv").write_bytes('größe,v\n"ü€\n",2\n'.encode("cp1252"))
    (tmp_path / "c.csv").write_bytes("größe,v\nà\x81,3\n".encode("latin-1"))
    table = read_for_cleaning(spark, str(tmp_path))
    assert sorted(cells_of(table)) == [("à\x81", 3), ("é€", 1), ("ü€\n", 2)] and table.encoding == "utf-8-sig"
    with pytest.raises(CsvError, match="not UTF-8"):
        read_for_profile(spark, str(tmp_path))


def test_names_of_hidden_columns(spark, csv):
    for text in ("_bad_line,_row_order,c0,raw\n1,2,3,4\n", '_bad_line,_row_order,c0,raw\n1,2,3,"4\n"\n'):
        table = read_for_profile(spark, csv(text))
        assert list(table.kinds) == ["_bad_line", "_row_order", "c0", "raw"]
        assert cells_of(table)[0][:3] == (1, 2, 3)


def test_texts_survive_a_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(['a "b" c', '"', 'x\n"y",\nz', ",", "é\n\n", '"\n"'])]
    df = spark.createDataFrame(rows, "id long, note string").coalesce(1)
    write_csv(df, str(tmp_path / "out"))
    assert cells_of(read_for_profile(spark, str(tmp_path / "out"))) == rows


def test_plan_groups_no_file(spark, csv, small_parts):
    path = csv('id,note\n1,"a\nb"\n' + "2,x\n" * 200)
    small_parts(200)
    records, _ = assemble(raw_lines(spark, path))
    assert records.count() == 202
    assert records.groupBy("at").count().where(F.col("count") > 1).isEmpty()
