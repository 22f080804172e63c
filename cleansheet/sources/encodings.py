"""Which text encoding a CSV file is in, and how its characters map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleansheet.sources.records import leaves_open, readable_path

UTF8 = "utf-8-sig"
WINDOWS = "cp1252"
LATIN = "latin-1"

# Bytes 80-9F differ between the two single-byte encodings; five of them have
# no meaning in the Windows one.
_WINDOWS_BYTES = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
_WINDOWS_UNDEFINED = "".join(chr(b) for b in range(0x80, 0xA0) if b not in _WINDOWS_BYTES)
_AS_LATIN = "".join(chr(b) for b in _WINDOWS_BYTES)
_AS_WINDOWS = bytes(_WINDOWS_BYTES).decode("cp1252")


def file_facts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, encoding, header, open_quotes) per file, judged on every line of it.

    Lines arrive as raw bytes, so files stay splittable and none has to fit
    into one task. `header` is a digest of 128 bits of the first line; `open_quotes` tells that some
    line, taken as a record, ends inside a quoted cell, so the file has records of several lines.
    """
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("uri"), "value",
        F.when(F.col("_metadata.file_block_start") == 0, at).alias("at"))
    raw = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    text = F.when(F.col("value").startswith("\ufeff"), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    marked = lines.select(
        "uri", "at", F.is_valid_utf8("value").alias("utf8"), leaves_open(F.col("value")).alias("open"),
        F.when(~F.is_valid_utf8("value"), raw.rlike(f"[{_WINDOWS_UNDEFINED}]")).alias("undefined"),
        *[F.when(F.col("at").isNotNull(), F.xxhash64(F.lit(salt), text)).alias(f"first{salt}") for salt in (0, 1)],
    )
    # Numbers only, so that lines are folded by hash and not sorted; the path is made readable once per file.
    firsts = marked.groupBy("uri").agg(
        F.bool_and("utf8").alias("utf8"), F.coalesce(F.bool_or("undefined"), F.lit(False)).alias("undefined"),
        F.bool_or("open").alias("open_quotes"), *[F.min_by(f"first{salt}", "at").alias(f"first{salt}") for salt in (0, 1)],
    ).select("*", readable_path(F.col("uri")).alias("path"), F.concat_ws(" ", "first0", "first1").alias("header"))
    encoding = F.when(F.col("utf8"), UTF8).when(~F.col("undefined"), WINDOWS).otherwise(LATIN)
    return firsts.select("path", encoding.alias("encoding"), "header", "open_quotes")


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding) per file."""
    return file_facts(spark, path).select("path", "encoding")


def spark_charset(encoding: str) -> str:
    """Spark reads both single-byte encodings as ISO-8859-1; see the two maps below."""
    return "UTF-8" if encoding == UTF8 else "ISO-8859-1"


def after_read(c: Column, encoding: str) -> Column:
    return F.translate(c, _AS_LATIN, _AS_WINDOWS) if encoding == WINDOWS else c


def before_write(c: Column, encoding: str) -> Column:
    return F.translate(c, _AS_WINDOWS, _AS_LATIN) if encoding == WINDOWS else c


def decoded(value: Column, encoding: Column) -> Column:
    """A raw line, read as UTF-8, in the encoding that its file was found to have."""
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return F.when(encoding == UTF8, value).when(encoding == WINDOWS, F.translate(latin, _AS_LATIN, _AS_WINDOWS)).otherwise(latin)
