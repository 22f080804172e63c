"""Landing checks, history table and the upload stream."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cleansheet.operators import history
from cleansheet.sources.landing import audit_landing, safe_names
from cleansheet.streaming import uploads


def test_landing(spark, tmp_path):
    files = {
        "ok.csv": b"a\n1\n", "EMPTY.csv": b"", "x.txt": b"a", "latin.csv": b"caf\xe9,1\n", "big.csv": b"a" * 9000,
        "late.csv": b"a\n" * 3000 + b"\xe9", "odd + name é.csv": b"\xe9", "no thing.csv": b"", "UP.CSV": b"x", "plain": b"x", "end.csv": "aé".encode()[:-1],
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    want = {
        "ok.csv": "ok", "EMPTY.csv": "empty", "x.txt": "extension", "latin.csv": "not_text", "big.csv": "ok",
        "late.csv": "not_text", "odd + name é.csv": "not_text", "no thing.csv": "empty", "UP.CSV": "ok", "plain": "extension", "end.csv": "not_text",
    }
    got = audit_landing(spark, str(tmp_path)).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in got} == want
    assert {r["path"].rsplit("/", 1)[1]: r["length"] for r in got} == {n: len(c) for n, c in files.items()}
    limited = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in audit_landing(spark, str(tmp_path), 8000).collect()}
    assert limited == {**want, "big.csv": "too_large"}


def test_whole_files_are_not_loaded(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x")
    plan = audit_landing(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_safe_names(spark):
    names = [(1, "../../etc/sales report.csv"), (2, "sales report.CSV"), (3, "???.csv"), (4, "a.b.csv"), (5, "sales_report.csv")]
    df = spark.createDataFrame(names, "id long, name string")
    got = safe_names(df, "name", F.lit(dt.datetime(2026, 7, 8, 10, 45, 32)), "id")
    assert {r["id"]: r["safe_name"] for r in got.collect()} == {
        1: "20260708_104532_sales_report.csv", 2: "20260708_104532_sales_report~2.csv", 3: "20260708_104532_upload.csv",
        4: "20260708_104532_a.b.csv", 5: "20260708_104532_sales_report~5.csv",
    }


ROWS = [
    ("u1", "explain", 1.5, 1, 0), ("u1", "clean", 0.5, 1, 1), ("u2", "explain", 2.0, 0, 2), ("u3", "clean", 1.0, 1, 3),
]


@pytest.fixture()
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    base = dt.datetime(2026, 1, 1, 23, 59, 58)
    batch = spark.createDataFrame(
        [(u, c, "in", "out", "p", "m", t, s, int(t * 1000), base + dt.timedelta(seconds=k)) for u, c, t, s, k in ROWS],
        "user_id string, command string, input_text string, output_text string, provider string, model string, "
        "execution_time double, success int, duration_ms bigint, created_at timestamp",
    )
    history.append_history(batch, path)
    return path


def test_history_reads(spark, log):
    h = history.read_history(spark, log)
    assert [f for f in h.columns if f != history.DAY] == [f.name for f in history.HISTORY_SCHEMA]
    assert h.select("id").distinct().count() == 4
    assert [r["command"] for r in history.recent(h, 2).collect()] == ["clean", "explain"]
    assert history.by_user(h, "u1").count() == 2 and history.by_command(h, "explain").count() == 2
    assert history.failures(h).count() == 1
    assert tuple(history.totals(h).first()) == (4, 3, 1, 1.25, 1250.0)
    assert [tuple(r) for r in history.by_type(h).collect()] == [("clean", 2), ("explain", 2)]
    assert history.top_command(h).first()[0] == "clean" and history.exists(h).first()[0] is True
    with pytest.raises(history.HistoryError):
        history.recent(h, -1)


def test_history_day_prunes_partitions(spark, log):
    plan = history.read_history(spark, log).where("created_day = date'2026-01-02'")
    assert plan.count() == 2
    assert "PartitionFilters: [isnotnull(created_day" in plan._jdf.queryExecution().executedPlan().toString()


def test_history_deletion(spark, log, tmp_path):
    h = history.read_history(spark, log)
    assert history.delete_history(h, str(tmp_path / "v2"), "u1") == 2
    left = history.read_history(spark, str(tmp_path / "v2"))
    assert {r["user_id"] for r in left.collect()} == {"u2", "u3"}
    assert history.delete_history(left, str(tmp_path / "v3")) == 2


def test_empty_history(spark):
    h = spark.createDataFrame([], history.HISTORY_SCHEMA)
    assert tuple(history.totals(h).first()) == (0, 0, 0, 0.0, 0.0)
    assert history.exists(h).first()[0] is False and history.top_command(h).count() == 0


def test_required_columns(spark, tmp_path):
    bad = spark.createDataFrame(
        [(None, "c", "i", "o", "p", "m", 1.0, 5)],
        "user_id string, command string, input_text string, output_text string, provider string, model string, "
        "execution_time double, duration_ms bigint",
    )
    with pytest.raises(PySparkException, match="user_id must not be missing"):
        history.append_history(bad, str(tmp_path / "log"))


def test_defaults(spark):
    rows = history.history_rows(spark.createDataFrame([("u", "c")], "user_id string, command string"))
    assert rows.select("success").first()[0] == 1 and rows.where("created_at is not null").count() == 1


def test_upload_stream_runs_each_file_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.csv").write_text("n,t\n1,x\n1,x\n2,y\n")
    (inbox / "bad.txt").write_text("n")
    (inbox / "README").write_text("n")
    (inbox / "long.csv").write_text("a,b\n1,2,3\n")
    places = [str(tmp_path / p) for p in ("log", "offsets", "cleaned")]
    uploads.run_available(spark, str(inbox), *places)
    got = {r["input_text"].rsplit("/", 1)[1]: r for r in history.read_history(spark, places[0]).collect()}
    assert {n: (r["success"], r["error_message"]) for n, r in got.items() if n != "long.csv"} == {
        "a.csv": (1, None), "bad.txt": (0, "not used: extension"), "README": (0, "not used: extension"),
    }
    assert "more cells" in got["long.csv"]["error_message"]
    assert got["a.csv"]["output_text"].startswith("rows 3 -> 2, quality 9.0 -> 10.0")
    uploads.run_available(spark, str(inbox), *places)
    assert history.read_history(spark, places[0]).count() == 4
    (inbox / "b.csv").write_text("n,t\n1,x\n2,y\n")
    uploads.run_available(spark, str(inbox), *places)
    assert history.read_history(spark, places[0]).count() == 5


def test_upload_stream_reads_no_file_as_one_cell(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "big.csv").write_text("n,t\n" + "".join(f"{i},x\n" for i in range(500)))
    (inbox / "bytes.csv").write_bytes(b"n,t\n" + b"1,x\n" * 500 + b"\xff\xfe,y\n")
    places = [str(tmp_path / p) for p in ("log", "offsets", "cleaned")]
    limit = "spark.sql.sources.binaryFile.maxLength"  # stands for the 2 GiB of a cell
    spark.conf.set(limit, 1000)
    try:
        uploads.run_available(spark, str(inbox), *places)
    finally:
        spark.conf.unset(limit)
    got = {r["input_text"].rsplit("/", 1)[1]: r for r in history.read_history(spark, places[0]).collect()}
    assert got["big.csv"]["success"] == 1 and got["big.csv"]["output_text"].startswith("rows 500 ->")
    assert got["bytes.csv"]["error_message"] == "not used: not_text"


def test_a_repeated_batch_leaves_nothing_twice(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.csv").write_text("n,t\n1,x\n2,y\n")
    places = [str(tmp_path / p) for p in ("log", "offsets", "cleaned")]
    uploads.run_available(spark, str(inbox), *places)
    for commit in (tmp_path / "offsets" / "commits").glob("*0*"):
        commit.unlink()  # as if the query had died before it could commit
    uploads.run_available(spark, str(inbox), *places)
    assert history.read_history(spark, places[0]).count() == 1
    assert len(list((tmp_path / "cleaned").rglob("*.csv"))) == len({p.parent for p in (tmp_path / "cleaned").rglob("*.csv")})


def test_other_faults_are_raised(spark, tmp_path, monkeypatch):
    def broken(*_):
        raise OSError("executor lost")

    monkeypatch.setattr(uploads, "process_upload", broken)
    with pytest.raises(OSError):
        uploads._outcome(spark, "a.csv", "ok", "out")


def test_history_is_created_once(spark, tmp_path):
    path = str(tmp_path / "log")
    history.create_history(spark, path)
    history.create_history(spark, path)
    assert history.read_history(spark, path).count() == 0
