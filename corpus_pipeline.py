"""From raw documents to packed training windows, in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and returns the columns of `documents` again, but for the last, which
returns the packed pieces. `run` writes each stage's rows as Parquet into the
shared scratch folder and reads them for the next, so a lost executor costs
one stage at most.

Null and repeated rows, empty texts and empty tables are treated as each
operator's docstring says. A document that loses all its lines stays, with an
empty text; n_chars follows the text.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cleansheet.llm import decontaminate, jaccard_join, line_dedup, packing, quality  # noqa: E402
from cleansheet.llm.common import discard, write_table  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.reject_poor(docs, _table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share go from all of them."""
    lean = line_dedup.drop_lines(docs, min_docs=10, min_chars=1)
    return lean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return jaccard_join.drop_similar(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token windows."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", reject_poor),
    ("line_dedup", drop_common_lines),
    ("near_copies", drop_similar),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# A trained classifier, banded alignment and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, written = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
        if path:
            discard(spark, path)
        path = written
    return docs
