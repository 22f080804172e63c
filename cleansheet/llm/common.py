"""Helpers shared by the operators here: scratch tables, components, texts as arrays."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleansheet.session import scratch_path

WHITESPACE = " \t\n\x0b\f\r"


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a frame into the shared scratch folder; the stored rows and their path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    return write_table(df, label)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables after their last reader is done."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name that does not clash with the given ones (which Spark compares without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, through Spark's own file distribution, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(package):  # already inside a shipped archive
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="cleansheet-code-"), "cleansheet.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of an undirected graph given as two long columns.

    Alternating star contractions: every round hooks larger neighbours, then
    smaller ones, to the least neighbour, so the number of rounds grows with
    the logarithm of the longest chain. Each round is a written table, so lost
    executors cost one round at most. Only a count and a checksum reach the
    driver. Returns (node, component) for every node that has a link to
    another one; component is the least node reachable.
    """
    spark = edges.sparkSession
    x, y = (F.col(c) for c in edges.columns[:2])
    rows, path = write_table(
        edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), label)
    seen = None
    while True:
        mark = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("sum")).first()
        if mark == seen or not mark["n"]:
            return rows.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                rows.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark
        both = rows.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            rows.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        previous = path
        rows, path = write_table(small.where("a <> b").distinct(), label)
        discard(spark, previous)


# --- texts as arrays ------------------------------------------------------------------------------------------------

CHUNK_BYTES = 2 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in WHITESPACE]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_BYTE_VALUE = np.random.RandomState(7).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64, kept for the process."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2)), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as UTF-8, in lists of about `limit` bytes; a longer text is a list of its own."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


def joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, a line feed after each, and where each begins (with the end as last entry)."""
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    return buf, np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw]))).astype(np.int64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes, from one running sum over the whole array."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * powers(_STEP, len(buf)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_BACK, len(buf))[np.minimum(starts, max(len(buf) - 1, 0))]
               + (ends - starts).astype(np.uint64))


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    space = _IS_SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate(([0], edge))
    return edge[::2], edge[1::2]


def word_hashes(raw: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, in order, and the first word of each text (with the count as last entry)."""
    buf, begin = joined(raw)
    if lower:
        buf = LOWER[buf]
    starts, ends = words(buf)
    return span_hashes(buf, starts, ends), np.searchsorted(starts, begin)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, and the text of each.

    A text with fewer words than that has one shingle made of all of them; a
    text without words has none.
    """
    n = len(hashes)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), np.maximum(count - size + 1, 0))
    value = np.zeros(max(n - size + 1, 0), np.uint64)
    for j, factor in enumerate(_FACTORS[:size]):
        value += hashes[j : j + len(value)] * factor
    offset = np.arange(len(owner)) - np.repeat(
        np.cumsum(np.maximum(count - size + 1, 0)) - np.maximum(count - size + 1, 0), np.maximum(count - size + 1, 0))
    value = mix(value[first[owner] + offset]) if len(owner) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.array([_fold(hashes[first[i] : first[i + 1]]) for i in short], np.uint64)
        value, owner = np.concatenate((value, extra)), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner


_FACTORS = (np.random.RandomState(11).randint(1, 1 << 62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1))


def _fold(part: np.ndarray) -> np.uint64:
    salted = np.append(part, np.uint64(len(part)))
    return mix(np.array([np.sum(salted * _FACTORS[: len(salted)], dtype=np.uint64)], np.uint64))[0]



# --- sorted partitions as whole groups ------------------------------------------------------------------------------

def whole_groups(batches: Iterable, keys: Sequence[str], rows: int = 4096) -> Iterator[tuple]:
    """Arrow tables that hold complete groups only, with the first row of each group (and the count as last entry).

    The partition has to be sorted by the keys. No more than `rows`, the last
    group and one batch are held.
    """
    import pyarrow as pa

    held: list = []

    def starts(table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in keys:
            values = table[k].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(change), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        begin = starts(table)
        last = int(begin[-2])
        if last:
            yield table.slice(0, last), begin[:-1]
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of the pairs (i, j); labels hold the least index of each set."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return
        np.minimum.at(labels, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while True:
            flat = labels[labels]
            if np.array_equal(flat, labels):
                break
            labels[:] = flat


def block_pairs(rows: DataFrame, node: str, blocks: str) -> DataFrame:
    """Deal each group to random blocks and each row to all pairs of blocks that its own is in.

    Adds `own`, `low` and `high`. A row is repeated once per block, so the
    rows of a large group grow with its size times its blocks while each
    (group, low, high) stays bounded; only the pairs of one such part meet in
    a task.
    """
    own = F.pmod(F.xxhash64(node), F.col(blocks))
    return rows.withColumn("own", own).withColumn("peer", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col(blocks) - 1))).withColumns({
            "low": F.least("own", "peer"), "high": F.greatest("own", "peer")}).drop("peer", blocks)
