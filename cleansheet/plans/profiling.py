"""The full profile of a dataset, and its before/after comparison."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleansheet.operators.columns import nan_to_null, numeric_columns, quoted, tally, text_columns
from cleansheet.operators.dedup import ROW_ORDER, duplicate_count
from cleansheet.operators.frequency import rank_values, value_frequencies
from cleansheet.operators.quality import count_recommendations, score, text_recommendations
from cleansheet.operators.statistics import byte_sum, describe_numeric
from cleansheet.session import materialize, together


@dataclass
class Profile:
    """What is known about a dataset. Its size follows the number of columns, not of rows."""

    name: str
    rows: int
    column_types: dict[str, str]
    missing: dict[str, int]
    duplicate_rows: int
    memory_bytes: int
    numeric: dict[str, dict[str, float | None]]
    texts: dict[str, dict]
    inconsistent: list[str]
    quality_score: float
    recommendations: list[str] = field(default_factory=list)

    @property
    def columns(self) -> int:
        return len(self.column_types)

    @property
    def total_missing(self) -> int:
        return sum(self.missing.values())

    def summary(self) -> list[tuple[str, str]]:
        """The profile as named lines."""
        return [
            ("dataset", self.name),
            ("rows", str(self.rows)),
            ("columns", str(self.columns)),
            ("column names", ", ".join(self.column_types)),
            ("column types", _listed(self.column_types)),
            ("missing cells", str(self.total_missing)),
            ("missing cells by column", _listed(self.missing)),
            ("repeated rows", str(self.duplicate_rows)),
            ("bytes", str(self.memory_bytes)),
            ("numeric columns", _listed({
                c: " ".join(f"{k}={_number(v)}" for k, v in s.items()) for c, s in self.numeric.items()
            })),
            ("text columns", _listed({
                c: f"unique={s['unique']} top=" + "|".join(f"{v}={n}" for v, n in s["top"])
                for c, s in self.texts.items()
            })),
            ("quality score of 10", str(self.quality_score)),
            ("advice", "; ".join(self.recommendations)),
        ]

    def metrics(self) -> dict[str, float]:
        return {
            "columns": float(self.columns),
            "duplicate_rows": float(self.duplicate_rows),
            "memory_bytes": float(self.memory_bytes),
            "missing_values": float(self.total_missing),
            "quality_score": self.quality_score,
            "rows": float(self.rows),
        }


def _listed(entries: dict) -> str:
    return "; ".join(f"{k}: {v}" for k, v in entries.items())


def _number(v) -> str:
    return "none" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def profile_dataset(
    df: DataFrame, name: str = "dataset", order: Column | None = None, kinds: dict[str, str] | None = None,
    copies: str | None = None, frequencies: DataFrame | None = None,
) -> Profile:
    """Profile a frame.

    Passes over the data: one aggregate for counts and sizes, one for numeric
    statistics, one shuffle of row digests, one shuffle of text values, and one
    aggregate of checks on them.

    `copies` names a column of a frame of distinct rows that tells how often
    each one occurs; the rows themselves are then not shuffled. `frequencies`
    gives the stored frequencies of its text columns, if they are known;
    columns of other types may follow in them.
    """
    df = nan_to_null(df)
    data = df.drop(ROW_ORDER)
    columns, words = [c for c in data.columns if c != copies], text_columns(data)
    if frequencies is not None:
        frequencies = frequencies.where(F.col("position") < len(words))

    def values() -> DataFrame | None:
        return materialize(value_frequencies(data, words, copies), "values") if frequencies is None and words else frequencies

    basics, frequencies = together(
        data.agg(
            tally(F.lit(True), copies).alias("rows"), F.count(F.lit(1)).alias("distinct"), byte_sum(data, copies).alias("bytes"),
            *[tally(quoted(c).isNull(), copies).alias(f"m{i}") for i, c in enumerate(columns)],
        ).first, values)
    rows = basics["rows"]
    missing = {c: basics[f"m{i}"] for i, c in enumerate(columns) if basics[f"m{i}"]}
    measured = [c for c in numeric_columns(data) if c != copies]

    def numbers() -> dict[str, dict]:
        described = describe_numeric(data, rows=rows, weight=copies).collect() if measured else []
        by_column = {r["column_name"]: r.asDict() for r in described}
        return {c: _without_name(by_column[c]) for c in measured if c in by_column}

    def advice() -> list[str]:
        return [message for _, message in text_recommendations(df, order, copies, frequencies)]

    def repeated() -> int:
        return rows - basics["distinct"] if copies else duplicate_count(data).first()["duplicate_rows"]

    duplicates, numeric, (texts, inconsistent), text_advice = together(
        repeated, numbers, lambda: _texts(data, words, frequencies), advice
    )
    lines = count_recommendations(duplicates, missing) + text_advice
    points = score(*[F.lit(v) for v in (rows, len(columns), sum(missing.values()), duplicates, len(inconsistent))])
    types = {c: t for c, t in data.dtypes if c != copies}
    return Profile(
        name=name, rows=rows, column_types=kinds or types, missing=missing, duplicate_rows=duplicates,
        memory_bytes=basics["bytes"], numeric=numeric, texts=texts, inconsistent=inconsistent,
        quality_score=df.sparkSession.range(1).select(points).first()[0],
        recommendations=lines,
    )


def _without_name(entry: dict) -> dict:
    return {k: v for k, v in entry.items() if k != "column_name"}


def _texts(data: DataFrame, columns: list[str], frequencies: DataFrame | None) -> tuple[dict[str, dict], list[str]]:
    """Distinct counts and top values per text column, and the columns that mix numbers with words."""
    texts = {c: {"unique": 0, "top": []} for c in columns}
    if not texts:
        return texts, []
    mixed = set()
    for r in frequencies.groupBy("position").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("numeric").alias("numeric")
    ).collect():
        name = columns[r["position"]]
        texts[name]["unique"] = r["n"]
        if 0 < r["numeric"] < r["n"]:
            mixed.add(name)
    for r in sorted(rank_values(data, columns, frequencies).collect(), key=lambda r: r["value_rank"]):
        texts[r["column_name"]]["top"].append((r["value"], r["n"]))
    return texts, [c for c in texts if c in mixed]


def summary_rows(spark: SparkSession, profile: Profile) -> DataFrame:
    return spark.createDataFrame(profile.summary(), "field string, value string")


def metric_rows(spark: SparkSession, profile: Profile) -> DataFrame:
    return spark.createDataFrame(list(profile.metrics().items()), "metric string, value double")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two (metric, value) tables side by side, with the change."""
    b = before.withColumnRenamed("value", "before")
    a = after.withColumnRenamed("value", "after")
    return b.join(a, "metric", "full_outer").select(
        "metric", "before", "after", (F.col("after") - F.col("before")).alias("change")
    )
