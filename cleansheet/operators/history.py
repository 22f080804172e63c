"""The command-history table: schema, append, reads, totals, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleansheet.session import path_exists

RECENT_LIMIT = 10
USER_LIMIT = 20
COMMAND_LIMIT = 20
FAILURE_LIMIT = 10

HISTORY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("command", T.StringType(), False),
    T.StructField("input_text", T.StringType(), False),
    T.StructField("output_text", T.StringType(), False),
    T.StructField("provider", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("execution_time", T.DoubleType(), False),
    T.StructField("success", T.IntegerType(), False),
    T.StructField("error_message", T.StringType()),
    T.StructField("duration_ms", T.LongType(), False),
    T.StructField("created_at", T.TimestampType()),
])
REQUIRED = [f.name for f in HISTORY_SCHEMA if not f.nullable and f.name != "success"]
DAY = "created_day"


class HistoryError(ValueError):
    """A history batch breaks the table's rules."""


def history_rows(batch: DataFrame) -> DataFrame:
    """A batch in the history schema: defaults set, ids derived from the row.

    Ids are a hash of the row and its position here; `history_table` gives
    gapless ones.
    """
    columns = set(batch.columns)

    def value(field: T.StructField) -> F.Column:
        if field.name == "success":
            given = F.col("success").cast("int") if "success" in columns else F.lit(None).cast("int")
            return F.coalesce(given, F.lit(1))
        if field.name == "created_at":
            given = F.col("created_at").cast("timestamp") if "created_at" in columns else F.lit(None).cast("timestamp")
            return F.coalesce(given, F.current_timestamp())
        if field.name not in columns:
            return F.lit(None).cast(field.dataType)
        return F.col(field.name).cast(field.dataType)

    shaped = batch.select(*[value(f).alias(f.name) for f in HISTORY_SCHEMA])
    if "id" in columns:
        return shaped
    derived = F.xxhash64(*[f.name for f in HISTORY_SCHEMA if f.name != "id"], F.monotonically_increasing_id())
    return shaped.withColumn("id", derived)


def create_history(spark: SparkSession, path: str) -> None:
    """An empty table, if there is none yet. Day partitions stand in for indexes."""
    if not path_exists(spark, path):
        empty = spark.createDataFrame([], HISTORY_SCHEMA).withColumn(DAY, F.to_date("created_at"))
        empty.write.partitionBy(DAY).parquet(path)


def checked_rows(batch: DataFrame) -> DataFrame:
    """The batch in the history schema; a NULL in a required column fails whatever writes it."""
    rows = history_rows(batch)
    for name in REQUIRED:
        message = F.lit(f"history column {name} must not be missing")
        checked = F.when(F.col(name).isNull(), F.raise_error(message)).otherwise(F.col(name))
        rows = rows.withColumn(name, checked)
    return rows


def append_history(batch: DataFrame, path: str) -> None:
    """Append a batch; a NULL in a required column fails the write.

    The check runs inside the write, so the batch is read once.
    """
    rows = checked_rows(batch)
    _by_day(rows.withColumn(DAY, F.to_date("created_at"))).write.mode("append").partitionBy(DAY).parquet(path)


def _by_day(rows: DataFrame) -> DataFrame:
    """Few files per day, yet no task with all rows of a busy day: large days are split."""
    return rows.hint("rebalance", DAY)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The table with its day partition column, which prunes date ranges."""
    return spark.read.schema(T.StructType([*HISTORY_SCHEMA, T.StructField(DAY, T.DateType())])).parquet(path)


def _newest(history: DataFrame, limit: int) -> DataFrame:
    if limit < 0:
        raise HistoryError("limit must not be negative")
    return history.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def recent(history: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    return _newest(history, limit)


def by_user(history: DataFrame, user_id: str, limit: int = USER_LIMIT) -> DataFrame:
    return _newest(history.where(F.col("user_id") == user_id), limit)


def by_command(history: DataFrame, command: str, limit: int = COMMAND_LIMIT) -> DataFrame:
    return _newest(history.where(F.col("command") == command), limit)


def failures(history: DataFrame, limit: int = FAILURE_LIMIT) -> DataFrame:
    return _newest(history.where(F.col("success") == 0), limit)


def totals(history: DataFrame) -> DataFrame:
    """Counts and averages of the whole table in one pass."""
    return history.agg(
        F.count(F.lit(1)).alias("total_commands"),
        F.count_if(F.col("success") == 1).alias("successful_commands"),
        F.count_if(F.col("success") == 0).alias("failed_commands"),
        F.coalesce(F.avg("execution_time"), F.lit(0.0)).alias("average_execution_time"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("average_duration_ms"),
    )


def by_type(history: DataFrame) -> DataFrame:
    return history.groupBy("command").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "command")


def top_command(history: DataFrame) -> DataFrame:
    return by_type(history).limit(1).select(F.col("command").alias("most_used_command"))


def exists(history: DataFrame) -> DataFrame:
    """One row, true when there is any history; stops at the first row found."""
    return history.limit(1).agg((F.count(F.lit(1)) > 0).alias("history_exists"))


def delete_history(history: DataFrame, target: str, user_id: str | None = None) -> int:
    """Write what remains to a new folder; return how many rows went.

    Counting happens while the rows are written, so the table is read once.
    """
    dated = history if DAY in history.columns else history.withColumn(DAY, F.to_date("created_at"))
    if user_id is None:
        dated.limit(0).write.partitionBy(DAY).parquet(target)
        return history.count()
    goes = F.col("user_id").eqNullSafe(F.lit(user_id))
    seen = Observation("history_deletion")
    counted = dated.observe(seen, F.count_if(goes).alias("deleted"))
    _by_day(counted.where(~goes)).write.partitionBy(DAY).parquet(target)
    return seen.get["deleted"]
