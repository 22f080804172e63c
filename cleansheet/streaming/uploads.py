"""Each new CSV in a landing folder is vetted, profiled, cleaned and recorded.

The files of a micro-batch are one plan, keyed by file (see `plans.uploads`),
so the number of jobs does not grow with the number of files. Only a file that
is too large to be written by one task is run by itself, split over many.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cleansheet.operators.history import append_history, read_history
from cleansheet.plans.dataset import run_dataset
from cleansheet.plans.uploads import run_uploads
from cleansheet.session import drop_path, path_exists
from cleansheet.sources.csv_files import CsvError
from cleansheet.sources.landing import holds_text, verdict

_BATCH_COLUMNS = (
    "user_id string, command string, input_text string, output_text string, provider string, model string, "
    "execution_time double, success int, error_message string, duration_ms bigint"
)
LARGE_FILE = 256 << 20


def process_upload(spark: SparkSession, path: str, output_dir: str) -> str:
    """One dataset: profile, clean, write, profile again. Returns a summary."""
    run = run_dataset(spark, path, output_dir)
    return (
        f"rows {run.before.rows} -> {run.after.rows}, "
        f"quality {run.before.quality_score} -> {run.after.quality_score}, changes {run.cleaning.total_changes}"
    )


def _outcome(spark: SparkSession, path: str, verdict: str, output: str) -> tuple:
    """What the history keeps of an upload. A fault of the file is an outcome; any other fault is raised."""
    started = time.perf_counter()
    summary, error = "", None
    if verdict != "ok":
        error = f"not used: {verdict}"
    else:
        try:
            summary = process_upload(spark, path, output)
        except CsvError as problem:
            error = str(problem)
    return _logged(path, summary, error, time.perf_counter() - started)


def _logged(path: str, summary: str, error: str | None, seconds: float) -> tuple:
    return ("stream", "dataset", path, summary, "", "", seconds, int(error is None), error, int(seconds * 1000))


def _not_yet_logged(spark: SparkSession, batch: DataFrame, log: str) -> DataFrame:
    """The rows of a batch that an earlier attempt has not appended already."""
    if not path_exists(spark, log):
        return batch
    known = read_history(spark, log).where(F.col("command") == "dataset").select("id")
    return batch.join(known, "id", "left_anti")


def start(
    spark: SparkSession, inbox: str, log: str, offsets: str, outputs: str, max_bytes: int | None = None,
    files_per_batch: int = 1000, available_now: bool = False, large_file: int = LARGE_FILE,
) -> StreamingQuery:
    """Watch a folder; the checkpoint makes every file run once per commit.

    A transient fault stops the query, and its next start repeats the batch:
    outputs are named after batch and file and written over, and history rows
    carry ids made of the two, so nothing is kept twice.

    Only paths and lengths are taken from the stream; contents are read line by
    line, so a file of any size is shared out over many tasks.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(inbox)
        .select("path", "length")
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        listed = batch.select("path", "length", verdict(F.lit(True), max_bytes).alias("verdict")).orderBy("path").collect()
        folder = f"{outputs}/batch={batch_id}"
        drop_path(spark, folder)
        started = time.perf_counter()
        small = [r["path"] for r in listed if r["verdict"] == "ok" and r["length"] <= large_file]
        done = {o.path: (o.summary, o.error) for o in run_uploads(spark, small, f"{folder}/small")} if small else {}
        seconds = (time.perf_counter() - started) / max(len(small), 1)
        outcomes = []
        for number, row in enumerate(listed):
            if row["path"] in done:
                outcomes.append(_logged(row["path"], *done[row["path"]], seconds))
            else:
                fit = row["verdict"] != "ok" or holds_text(spark, row["path"])
                outcomes.append(_outcome(spark, row["path"], row["verdict"] if fit else "not_text", f"{folder}/{number}"))
        if outcomes:
            rows = spark.createDataFrame(outcomes, _BATCH_COLUMNS).withColumn(
                "id", F.xxhash64(F.lit(offsets), F.lit(batch_id), "input_text"))
            append_history(_not_yet_logged(spark, rows, log), log)

    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", offsets)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_available(spark: SparkSession, inbox: str, log: str, offsets: str, outputs: str, **options) -> None:
    start(spark, inbox, log, offsets, outputs, available_now=True, **options).awaitTermination()
