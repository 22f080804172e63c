"""Checks on files before they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleansheet.functions.text import safe_file_name
from cleansheet.sources.records import file_of_line

# Fixed value: what an acceptable file is called.
EXTENSION = ".csv"


def verdict(is_text: Column, max_bytes: int | None = None) -> Column:
    """The first reason to reject a file by its path and length, or `ok`. Sizes count only if a limit is given."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(name, r"(?<=[^.])(\.[^.]+)$", 1))
    too_large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    return (
        F.when(extension != EXTENSION, "extension").when(F.col("length") == 0, "empty").when(too_large, "too_large")
        .when(~is_text, "not_text").otherwise("ok")
    )


def holds_text(spark: SparkSession, path: str) -> bool:
    """Whether every line of a file is valid text; the file stays split."""
    return spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()


def audit_landing(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Verdicts for every file below a folder.

    Lengths come from the listing. Every byte of an eligible file is checked,
    line by line, so a file of any size is shared out over many tasks; files
    that another reason rejects are not opened. Spark's file sources leave out
    empty files, so those are taken from its own file index.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    known = listed.select("path", "length")
    plain = F.regexp_replace("path", "^file:/+", "/")
    empty = _indexed(listed).withColumn("key", plain).join(known.select(plain.alias("key")), "key", "left_anti").select(
        "path", F.lit(0).cast("bigint").alias("length"))
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        file_of_line().alias("path"), F.col("_metadata.file_size").alias("length"), "value")
    broken = (
        lines.where(verdict(F.lit(False), max_bytes) == "not_text").groupBy(plain.alias("key"))
        .agg(F.bool_and(F.is_valid_utf8("value")).alias("valid")).where("not valid")
    )
    judged = known.unionByName(empty).withColumn("key", plain).join(broken, "key", "left")
    return judged.select("path", "length", verdict(F.col("valid").isNull(), max_bytes).alias("verdict"))


def _indexed(files: DataFrame) -> DataFrame:
    """(path): the names in Spark's file index, which the driver holds for any read; empty files are among them."""
    listed = files.sparkSession.createDataFrame([(p,) for p in files.inputFiles()], "path string")
    return listed.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"))


def safe_names(names: DataFrame, name: str, stamp: Column, row_id: str) -> DataFrame:
    """Storage names: stamp, safe stem, extension; repeats also carry `~` and their row id.

    No plain name holds a `~`, so no two rows get one name.

    Only the least id per name is aggregated (one record per name and task),
    then joined back. A name shared by very many rows is split by the adaptive
    skew join, which a window over equal names could not do.
    """
    base = F.concat(F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit("_"), safe_file_name(F.col(name)))
    named = names.withColumn("_base", base)
    repeated = (
        named.groupBy("_base")
        .agg(F.min(row_id).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    is_repeat = F.col("_first").isNotNull() & (F.col("_first") != F.col(row_id))
    suffix = F.when(is_repeat, F.concat(F.lit("~"), F.col(row_id).cast("string"))).otherwise("")
    return (
        named.join(repeated, "_base", "left")
        .withColumn("safe_name", F.concat("_base", suffix, F.lit(EXTENSION)))
        .drop("_base", "_first")
    )
