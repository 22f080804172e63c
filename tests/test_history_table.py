"""The versioned history table: ids, skipping, deletion, concurrent writers, totals."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cleansheet.operators import history
from cleansheet.operators.history_table import HistoryTable, Version

START = dt.datetime(2026, 1, 1)


def batch(spark, n, seed=0, users=40):
    rows = spark.range(n, numPartitions=5).select(
        F.concat(F.lit("u"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(users))).alias("user_id"),
        F.get(F.array(*[F.lit(c) for c in ("explain", "clean", "validate")]), F.pmod(F.xxhash64("id"), F.lit(3)).cast("int")).alias("command"),
        F.concat(F.lit(f"{seed} "), F.col("id").cast("string")).alias("input_text"), F.lit("").alias("output_text"),
        F.lit("p").alias("provider"), F.lit("m").alias("model"), (F.col("id") / 7).alias("execution_time"),
        (F.col("id") % 5 != 0).cast("int").alias("success"), (F.col("id") * 3).alias("duration_ms"),
        F.timestamp_seconds(F.lit(1767225600) + F.col("id") * 60 + seed).alias("created_at"))
    return rows


@pytest.fixture()
def table(spark, tmp_path):
    return HistoryTable(spark, str(tmp_path / "table"), rows_per_file=100)


def ids(table):
    return sorted(r["id"] for r in table.read().select("id").collect())


def same_totals(table):
    kept, scanned = tuple(table.totals().first()), tuple(history.totals(table.read()).first())
    assert kept == pytest.approx(scanned)
    assert [tuple(r) for r in table.by_type().collect()] == [tuple(r) for r in history.by_type(table.read()).collect()]


def test_ids_have_no_gaps_and_follow_time(spark, table):
    assert table.append(batch(spark, 700), "a") == (1, 700)
    assert table.append(batch(spark, 0), "none") == (701, 700)
    assert table.append(batch(spark, 300, 1), "b") == (701, 1000)
    assert table.append(batch(spark, 700), "a") == (0, 0)
    assert ids(table) == list(range(1, 1001))
    ordered = table.read().where("id <= 700").orderBy("id").select("created_at").collect()
    assert ordered == sorted(ordered)
    same_totals(table)


def test_a_batch_that_died_gets_the_same_ids(spark, table, monkeypatch):
    table.append(batch(spark, 100), "a")
    with monkeypatch.context() as m:
        m.setattr(table, "_write", lambda *_: (_ for _ in ()).throw(OSError("executor lost")))
        with pytest.raises(OSError):
            table.append(batch(spark, 50, 1), "b")
    assert table.append(batch(spark, 20, 2), "c") == (151, 170)
    assert table.append(batch(spark, 50, 1).repartition(3), "b") == (101, 150)
    assert ids(table) == list(range(1, 171))
    same_totals(table)


def test_a_version_that_lost_its_marker_is_still_known(spark, table, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(table, "_mark", lambda _: None)
        table.append(batch(spark, 10), "a")
    assert table.append(batch(spark, 10), "a") == (0, 0)
    table.append(batch(spark, 10, 1), "b")
    assert table.append(batch(spark, 10), "a") == (0, 0)
    assert ids(table) == list(range(1, 21))


def test_reads_skip_files(spark, table):
    table.append(batch(spark, 5000), "a")
    files = len(table.version().files)
    plain = history.by_user(table.read(), "u7", 1000)
    read = table.by_user("u7", 1000)
    assert sorted(read.collect()) == sorted(plain.collect()) and read.count() > 50
    assert files >= 50 and len(read.inputFiles()) < files * 0.4
    assert len(table.recent(10).inputFiles()) < files * 0.4
    assert table.recent(10).collect() == history.recent(table.read(), 10).collect()
    assert table.failures(25).collect() == history.failures(table.read(), 25).collect()
    assert table.by_command("clean", 30).collect() == history.by_command(table.read(), "clean", 30).collect()
    assert table.by_user("nobody").count() == 0


def test_deletion_leaves_other_files_alone(spark, table):
    table.append(batch(spark, 3000, users=400), "a")
    before = {f.path: f for f in table.version().files}
    of_user = table.read().where("user_id = 'u9'")
    expected = of_user.count()
    holding = {p.rsplit("/", 1)[1] for p in [r[0] for r in of_user.select(F.input_file_name()).distinct().collect()]}
    assert table.delete("u9") == expected > 0
    after = {f.path for f in table.version().files}
    assert {p.rsplit("/", 1)[1] for p in before if p not in after} == holding
    assert len(holding) < len(before) / 2
    assert table.read().count() == 3000 - expected and table.by_user("u9").count() == 0
    assert table.read(2).count() == 3000  # an earlier version reads as it was
    same_totals(table)
    assert table.delete("u9") == 0
    gone = table.expire()
    assert gone == len(holding) and table.read().count() == 3000 - expected
    assert table.delete() == 3000 - expected and table.read().count() == 0
    same_totals(table)
    assert table.append(batch(spark, 5, 3), "later") == (3001, 3005)


def test_concurrent_writers(spark, tmp_path):
    path = str(tmp_path / "table")
    HistoryTable(spark, path, 100).append(batch(spark, 200), "first")

    def write(i):
        own = HistoryTable(spark, path, 100)
        return own.delete("u3") if i == 4 else own.append(batch(spark, 50 + i, 10 + i), f"b{i}")

    with ThreadPoolExecutor(5) as pool:
        list(pool.map(write, range(5)))
    table = HistoryTable(spark, path, 100)
    everything = [r["id"] for r in table.read().select("id").collect()]
    assert len(set(everything)) == len(everything) and table.version().greatest_id == 200 + 50 + 51 + 52 + 53
    missing = set(range(1, 407)) - set(everything)
    assert len(missing) == 406 - len(everything) > 0
    same_totals(table)


def test_only_one_writer_publishes_a_version(table):
    assert table._publish(Version(1)) and not table._publish(Version(1)) and table._publish(Version(2))
    assert table.version().number == 2


def test_compaction(spark, table):
    for i in range(6):
        table.append(batch(spark, 30, i), f"b{i}")
    rows = sorted(table.read().collect())
    assert table.compact() > 0 and table.compact() == 0
    assert sorted(table.read().collect()) == rows
    same_totals(table)


def test_rules_of_the_log_hold(spark, table):
    with pytest.raises(PySparkException, match="user_id must not be missing"):
        table.append(batch(spark, 5).withColumn("user_id", F.lit(None).cast("string")), "a")
    assert table.read().count() == 0 and table.by_user("x").count() == 0 and table.recent().count() == 0
    assert tuple(table.totals().first()) == (0, 0, 0, 0.0, 0.0)
