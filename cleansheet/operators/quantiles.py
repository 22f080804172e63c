"""Exact quantiles with bounded memory.

Small inputs use `percentile` in one pass. It keeps every distinct value of a
column in one task, so past a set size the same order statistics, combined by
the same formula, are found by narrowing instead: a sketch proposes an interval around each wanted rank, one
counting pass proves where the rank lies, and only when the interval holds few
enough rows are its values counted and ranked. The sketch only steers; every
answer rests on exact counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleansheet.operators.columns import number_cells, quoted, tally
from cleansheet.session import materialize

QUARTILES = (0.25, 0.5, 0.75)
SINGLE_PASS_CELLS = 5_000_000
CANDIDATE_ROWS = 2_000_000
_SKETCH_SIZE = 2048
_SKETCH_SLACK = 0.004
_SKETCH_GROUPS = 256
_COLUMNS_PER_PASS = 8


@dataclass
class _Wanted:
    """One order statistic: the k-th smallest value (from 0) of a column."""

    column: str
    rank: int
    low: float
    high: float
    below: int
    inside: int
    open_ends: bool = False
    value: float | None = None

    @property
    def interval(self) -> tuple[str, float, float, bool]:
        return self.column, self.low, self.high, self.open_ends

    def holds(self, c: Column) -> Column:
        if self.open_ends:
            return (c > self.low) & (c < self.high)
        return (c >= self.low) & (c <= self.high)


_WEIGHT = "\u2063weight"


def percentiles(probabilities: tuple[float, ...] = QUARTILES) -> Column:
    """Quantiles of `value`, each counted n times, as an array; grouped by position, columns are finished in parallel."""
    return F.percentile("value", F.array(*[F.lit(p) for p in probabilities]), F.col("n"))


def stored_numbers(df: DataFrame, columns: list[str], rows: int, single_pass_cells: int = SINGLE_PASS_CELLS) -> DataFrame:
    """The columns for a search that reads them several times: written once, so that what gives them is computed once."""
    values = df.select(*[quoted(c) for c in columns])
    return materialize(values, "numbers") if rows * len(columns) > single_pass_cells else values


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: tuple[float, ...] = QUARTILES,
    rows: int | None = None,
    single_pass_cells: int = SINGLE_PASS_CELLS,
    candidate_rows: int = CANDIDATE_ROWS,
    weight: str | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles by linear interpolation, per column; None for a column without values.

    `weight` names a column that tells how often each row counts.
    """
    if not columns:
        return {}
    if rows is None:
        rows = df.count()
    if rows * len(columns) <= single_pass_cells:
        found = number_cells(df, columns, weight).groupBy("position").agg(percentiles(probabilities).alias("q")).collect()
        by_column = {columns[r["position"]]: r["q"] for r in found}
        return {c: list(by_column.get(c) or [None] * len(probabilities)) for c in columns}

    n = F.lit(1).cast("long") if weight is None else quoted(weight)
    df = df.select(n.alias(_WEIGHT), *[quoted(c).cast("double").alias(c) for c in columns])
    result: dict[str, list[float | None]] = {}
    for start in range(0, len(columns), _COLUMNS_PER_PASS):
        part = columns[start : start + _COLUMNS_PER_PASS]
        result |= _by_narrowing(df.select(_WEIGHT, *[quoted(c) for c in part]), part, probabilities, candidate_rows)
    return result


def _by_narrowing(
    df: DataFrame, columns: list[str], probabilities: tuple[float, ...], candidate_rows: int
) -> dict[str, list[float | None]]:
    limits = df.agg(*[
        agg
        for i, c in enumerate(columns)
        for agg in (tally(quoted(c).isNotNull(), _WEIGHT).alias(f"count{i}"), F.min(quoted(c)).alias(f"min{i}"),
                    F.max(quoted(c)).alias(f"max{i}"))
    ]).first()
    places, wanted = {}, {}
    for i, c in enumerate(columns):
        n, low, high = limits[f"count{i}"], limits[f"min{i}"], limits[f"max{i}"]
        for p in probabilities if n else ():
            place = (n - 1) * p
            places[c, p] = place
            for rank in {math.floor(place), math.ceil(place)}:
                wanted.setdefault((c, rank), _Wanted(c, rank, low, high, 0, n))
    _resolve(df, list(wanted.values()), candidate_rows)

    def at(c: str, p: float) -> float | None:
        if (c, p) not in places:
            return None
        place = places[c, p]
        low, high = wanted[c, math.floor(place)].value, wanted[c, math.ceil(place)].value
        # The same formula as the single pass, so that both give the same bits.
        return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high

    return {c: [at(c, p) for p in probabilities] for c in columns}


def _resolve(df: DataFrame, wanted: list[_Wanted], candidate_rows: int) -> None:
    slack = _SKETCH_SLACK
    for w in wanted:
        if w.low == w.high:
            w.value = w.low
    while True:
        large = [w for w in wanted if w.value is None and w.inside > candidate_rows]
        if not large:
            break
        before = [(w.inside, w.value) for w in large]
        if slack > 0.25:
            _halve(df, large)
        else:
            _narrow(df, large, slack)
        if before == [(w.inside, w.value) for w in large]:
            slack *= 4
    rest = [w for w in wanted if w.value is None]
    if rest:
        _rank_candidates(df, rest)


def _families(wanted: list[_Wanted]) -> list[list[_Wanted]]:
    """Neighbouring ranks of one interval, as the two around a place are; they are searched as one."""
    families: list[list[_Wanted]] = []
    for w in sorted(wanted, key=lambda w: (*w.interval, w.rank)):
        last = families[-1][-1] if families else None
        if last is not None and last.interval == w.interval and w.rank - last.rank <= 1:
            families[-1].append(w)
        else:
            families.append([w])
    return families


def _narrow(df: DataFrame, wanted: list[_Wanted], slack: float) -> None:
    """Propose a smaller interval for each family of ranks, then keep it where exact counts agree."""
    intervals = {w.interval: w for w in wanted}
    numbers = {interval: i for i, interval in enumerate(intervals)}
    partial = df.groupBy((F.spark_partition_id() % _SKETCH_GROUPS).alias("g")).agg(*[
        F.kll_sketch_agg_double(F.when(w.holds(quoted(w.column)), quoted(w.column)), F.lit(_SKETCH_SIZE)).alias(f"s{i}")
        for i, w in enumerate(intervals.values())
    ])
    merged = partial.agg(*[F.kll_merge_agg_double(f"s{i}", F.lit(_SKETCH_SIZE)).alias(f"s{i}") for i in numbers.values()])
    families = _families(wanted)

    def bounds(family: list[_Wanted]) -> tuple[float, float]:
        low, high = ((w.rank - w.below) / w.inside for w in (family[0], family[-1]))
        return max(low - slack, 0.0), min(high + slack, 1.0)

    guesses = merged.select(*[
        F.kll_sketch_get_quantile_double(f"s{numbers[family[0].interval]}", F.lit(q)).alias(f"b{i}_{side}")
        for i, family in enumerate(families) for side, q in enumerate(bounds(family))
    ]).first()

    counts = df.agg(*[
        tally(condition(quoted(family[0].column), guesses[f"b{i}_0"], guesses[f"b{i}_1"]), _WEIGHT).alias(f"{name}{i}")
        for i, family in enumerate(families)
        for name, condition in (
            ("below", lambda c, lo, hi: c < lo),
            ("inside", lambda c, lo, hi: (c >= lo) & (c <= hi)),
            ("at_low", lambda c, lo, hi: c == lo),
            ("at_high", lambda c, lo, hi: c == hi),
        )
    ]).first()
    for i, w in ((i, w) for i, family in enumerate(families) for w in family):
        low, high = guesses[f"b{i}_0"], guesses[f"b{i}_1"]
        below, inside = counts[f"below{i}"], counts[f"inside{i}"]
        at_low, at_high = counts[f"at_low{i}"], counts[f"at_high{i}"]
        if not below <= w.rank < below + inside:
            continue
        if w.rank < below + at_low:
            w.value = low
        elif w.rank >= below + inside - at_high:
            w.value = high
        else:
            w.low, w.high, w.open_ends = low, high, True
            w.below, w.inside = below + at_low, inside - at_low - at_high


def _halve(df: DataFrame, wanted: list[_Wanted]) -> None:
    """Where sketches bring no progress, cut intervals in their middle; exact counts say which half to keep."""
    middle = [m if m == m else 0.0 for m in (w.low / 2 + w.high / 2 for w in wanted)]
    counts = df.agg(*[
        agg
        for i, w in enumerate(wanted)
        for c in (quoted(w.column),)
        for agg in (
            tally(w.holds(c) & (c < middle[i]), _WEIGHT).alias(f"low{i}"),
            tally(w.holds(c) & (c == middle[i]), _WEIGHT).alias(f"at{i}"),
            F.min(F.when(w.holds(c), c)).alias(f"min{i}"), F.max(F.when(w.holds(c), c)).alias(f"max{i}"),
        )
    ]).first()
    for i, w in enumerate(wanted):
        lower, at = counts[f"low{i}"], counts[f"at{i}"]
        rank = w.rank - w.below
        if counts[f"min{i}"] == counts[f"max{i}"]:
            w.value = counts[f"min{i}"]
        elif rank < lower:
            w.low, w.high, w.inside = (counts[f"min{i}"], middle[i], lower) if not w.open_ends else (w.low, middle[i], lower)
            if not w.open_ends and at:  # the closed upper end must not take in the middle itself
                w.high = math.nextafter(middle[i], -math.inf)
        elif rank < lower + at:
            w.value = middle[i]
        else:
            w.below, w.inside = w.below + lower + at, w.inside - lower - at
            w.low = middle[i] if w.open_ends else math.nextafter(middle[i], math.inf)


def _rank_candidates(df: DataFrame, wanted: list[_Wanted]) -> None:
    """Count the few values left in each interval and walk to the rank."""
    intervals = list({w.interval: w for w in wanted}.values())
    ranks = [[w.rank - w.below for w in wanted if w.interval == i.interval] for i in intervals]
    inside = F.filter(
        F.array(*[
            F.when(w.holds(quoted(w.column)), F.struct(F.lit(i).alias("i"), quoted(w.column).alias("v")))
            for i, w in enumerate(intervals)
        ]),
        lambda entry: entry.isNotNull(),
    )
    counted = df.select(_WEIGHT, F.inline(inside)).groupBy("i", "v").agg(F.sum(_WEIGHT).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
    asked = F.get(F.array(*[F.array(*[F.lit(r).cast("long") for r in of_interval]) for of_interval in ranks]), F.col("i"))
    hits = (
        counted.withColumn("upto", upto)
        .where(F.exists(asked, lambda rank: (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n"))))
        .select("i", "v", "upto", "n")
    )
    for hit in hits.collect():
        for w in wanted:
            if w.interval == intervals[hit["i"]].interval and hit["upto"] - hit["n"] <= w.rank - w.below < hit["upto"]:
                w.value = hit["v"]
