"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "cleansheet") -> SparkSession:
    """A session for tests and benches, with a scratch folder of its own; a cluster brings both."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CLEANSHEET_DRIVER_MEMORY", "8g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="cleansheet-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    It is the checkpoint folder the cluster names, else a folder below the
    warehouse, which executors share too. The session is left as it is.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return warehouse.rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/cleansheet-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the scratch folder once and read it back.

    Later passes then read only the columns they need, and a lost executor
    costs a re-read instead of a repeated shuffle.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(*jobs: Callable[[], object]) -> list:
    """Run independent Spark jobs at the same time; their results in order.

    The tail of one job then leaves no cores idle, and planning overlaps.
    """
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [done.result() for done in [pool.submit(inherit(job)) for job in jobs]]


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """The length of a file, or of all files in a folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def rename_files(spark: SparkSession, source: str, target: str, names: dict[str, str], empty: list[str]) -> None:
    """Move the one file of each named folder below `source` to its new name in `target`; `empty` ones get no content.

    Writers name their files themselves; this is for the few files whose names matter.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(target))
    for folder, name in names.items():
        found = files.globStatus(path(f"{source}/{folder}/part-*")) if name not in empty else None
        for status in found or ():
            files.rename(status.getPath(), path(f"{target}/{name}"))
    for name in empty:
        files.create(path(f"{target}/{name}")).close()
