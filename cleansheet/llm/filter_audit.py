"""How text filters interact: what each removes in every order of application.

Five filters judge each document. Four look at its text alone; the fifth fails
a document whose text some smaller id has too. Copies are found in steps:

1. every task folds the 64-bit hashes of its texts into a counting Bloom
   filter with counters 0, 1 and "more"; the partial filters are merged by
   ranges of cells in tasks, and one bit per cell ("more") goes to all tasks;
2. a text with a cell below "more" is the only one of its kind. It is cleared
   where it stands: neither it nor its hash is shuffled;
3. only the texts of possible repeats are shuffled, whole, and grouped by
   themselves for their least id, folded in the map tasks first, so a text that
   a third of the corpus shares costs one row per task;
4. the flag of a row is whether its id is that least one, a join on id and
   hash of narrow rows. Rows become counts per part and bit mask of failed
   filters, and every order is worked out from those at most 32 counts.

The filter has `CELLS_PER_TEXT` cells per document, up to `MAX_CELLS` (64 MB of
bits), so what is broadcast has a fixed bound. A fuller filter clears fewer
texts; the result stays exact at any size.

A null text is empty, a null part too. Rows that repeat count as often as they
occur; rows of one id are not copies of each other unless a smaller id has the
text too. A null id is smaller than nothing and has no smaller one. Several
label rows of an id count as one that has what any of them has. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITESPACE, mix, ship, stored

CELLS_PER_TEXT = 16
MAX_CELLS = 1 << 29
RANGE = 1 << 18
MAX_PROBES = 6
FLUSH = 1 << 20
COPY = "E"


# --- filters on a text alone: what fails ------------------------------------------------------------------------------

def _words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(WHITESPACE)), r"[\x20\x09-\x0D]+", -1)


def _few_words(text: Column) -> Column:
    return F.size(_words(text)) < 200  # a text without words has one empty piece


def _repetitive(text: Column) -> Column:
    words = _words(text)
    return 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)


def _shouting(text: Column) -> Column:
    return 100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.char_length(text)


def _symbols(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


FILTERS: dict[str, Callable[[Column], Column]] = {
    "A": _few_words, "B": _repetitive, "C": _shouting, "D": _symbols}


# --- the counting Bloom filter ----------------------------------------------------------------------------------------

def cells_of(hashes: np.ndarray, cells: int, probes: int) -> np.ndarray:
    """The cells of each hash, one row per probe; `cells` is a power of two."""
    one = mix(hashes.astype(np.int64).view(np.uint64))
    two = mix(one ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    at = one[None, :] + np.arange(probes, dtype=np.uint64)[:, None] * two[None, :]
    return at & np.uint64(cells - 1)


def _partial(cells: int, probes: int):
    """Counters of a task's texts, as the cells that one text has and those that more have, by range."""
    def fold(hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        distinct, times = np.unique(np.concatenate(hashes), return_counts=True)
        cell = cells_of(distinct, cells, probes).ravel()
        order = np.argsort(cell, kind="stable")
        cell, weight = cell[order], np.minimum(np.tile(times, probes)[order], 2)
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        total, cell = np.add.reduceat(weight, first), cell[first]
        width = min(RANGE, cells)
        part, offset = (cell // np.uint64(width)).astype(np.int64), (cell % np.uint64(width)).astype("<u4")
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for a, b in zip(begin, np.append(begin[1:], len(part))):
            once = total[a:b] == 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([part[a]], pa.int64()), pa.array([offset[a:b][once].tobytes()], pa.binary()),
                 pa.array([offset[a:b][~once].tobytes()], pa.binary())], ["part", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False))
                size += batch.num_rows
            if size >= FLUSH:
                yield from fold(held)
                held, size = [], 0
        if held:
            yield from fold(held)
    return run


def _merge(width: int):
    """Add up the partial counters of each range, in a partition sorted by range; the cells that hold "more", as bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, more = None, None, None

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([np.packbits(more).tobytes()], pa.binary())], ["part", "bits"])

        for batch in batches:
            for part, once, many in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    if at is not None:
                        yield done()
                    at, seen, more = part, np.zeros(width, bool), np.zeros(width, bool)
                once, many = np.frombuffer(once, "<u4"), np.frombuffer(many, "<u4")
                more[once] |= seen[once]
                seen[once] = True
                seen[many] = more[many] = True
        if at is not None:
            yield done()
    return run


def possible_repeat(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test of 64-bit hashes, from a frame with one hash per row: false where a hash surely stands there once."""
    spark = hashes.sparkSession
    ship(spark)
    n = hashes.count()
    cells = 1 << min(max(math.ceil(math.log2(CELLS_PER_TEXT * max(n, 1))), 3), int(math.log2(MAX_CELLS)))
    probes = min(max(round(math.log(2) * cells / max(n, 1)), 1), MAX_PROBES)
    width = min(RANGE, cells)
    partial = hashes.mapInArrow(_partial(cells, probes), "part long, once binary, more binary")
    ranges = partial.repartition("part").sortWithinPartitions("part").mapInArrow(_merge(width), "part long, bits binary")
    bits = np.zeros(cells // 8, np.uint8)
    for row in ranges.toLocalIterator():
        bits[row["part"] * width // 8 : (row["part"] + 1) * width // 8] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        cell = cells_of(h.to_numpy(), cells, probes).astype(np.int64)
        hit = (shared.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=0))

    return test


# --- flags and counts -------------------------------------------------------------------------------------------------

def mask_counts(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source",
                filters: dict[str, Callable[[Column], Column]] = FILTERS) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters.

    Bit i of the mask is the filter that comes i-th in `filters`; the one after
    these is that a smaller id has the same text. `good` and `toxic` count
    documents that `labels` (doc_id, quality, toxic) give a 1.
    """
    texts = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                        F.coalesce(F.col(part), F.lit("")).alias("part"))
    failed = sum((F.when(fails(F.col("text")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = stored(texts.select("doc", "part", failed.cast("int").alias("mask"), F.xxhash64("text").alias("hash")), "filter-flags")
    repeat = possible_repeat(rows.select("hash"))
    firsts = texts.where(repeat(F.xxhash64("text"))).groupBy("text").agg(F.min("doc").alias("first")).select(
        F.col("first").alias("doc"), F.xxhash64("text").alias("hash"), F.lit(True).alias("is_first"))
    judged = labels.groupBy(F.col("doc_id").alias("doc")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    named = rows.where("doc is not null").groupBy("doc", "part", "mask", "hash").agg(F.count("*").alias("n"))
    named = named.withColumn("repeat", repeat(F.col("hash"))).join(judged, "doc", "left")
    named = named.join(firsts, ["doc", "hash"], "left")
    copy = F.when(F.col("repeat") & F.col("is_first").isNull(), 1 << len(filters)).otherwise(0)
    zero = F.lit(0).cast("long")
    flagged = named.select("part", (F.col("mask") + copy).alias("mask"), "n", F.coalesce("good", zero).alias("good"),
                           F.coalesce("toxic", zero).alias("toxic"))
    nameless = rows.where("doc is null").select("part", "mask", F.lit(1).cast("long").alias("n"), zero.alias("good"),
                                                zero.alias("toxic"))
    return flagged.unionByName(nameless).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(counts: DataFrame, letters: str = "".join(FILTERS) + COPY) -> DataFrame:
    """Every order of the filters, step by step, from the counts per part and mask.

    (part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley): documents left after the step, removed by
    it, failing its filter but removed before, failing no other filter, removed
    ones that are good or toxic, and what its filter removes over all orders.
    """
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    steps = [F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(bit[f]).alias("bit"),
                      F.lit(sum(bit[g] for g in order[:i])).alias("before"))
             for order in permutations(letters) for i, f in enumerate(order)]
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.select("part", "masks", F.inline(F.array(*steps)))

    def total(field: str, when: Callable[[Column], Column]) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + F.when(when(m["mask"]), m[field]).otherwise(0))

    own, before = F.col("bit"), F.col("before")

    def removed(m: Column) -> Column:
        return (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)

    return rows.select(
        "part", "filter_order", "step", "bit",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
    ).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")
