"""Join of documents whose word n-grams overlap (Jaccard), with Bayesian pruning of candidates.

1. Texts become word hashes in one pass; documents with the same word sequence
   form a class that goes on as one row with a weight.
2. Classes that share a band of MinHash values become candidates. Their values
   are compared a few at a time, and a pair is dropped once the posterior
   probability that its similarity reaches the threshold falls below the
   tolerance (uniform prior; each value is kept as 8 bits, and the chance
   of accidental equality is part of the likelihood).
3. Pairs that remain connect clusters. Within each cluster the real n-gram
   sets are compared, which decides every link exactly, also for pairs that
   the bands or the tolerance missed.
4. Links connect components.

Large buckets and clusters are dealt to blocks, and each task compares two
blocks, so no group has to fit into a task and no pair becomes a row: tasks
return spanning trees and numbers of links.

Words are runs of characters other than ASCII white space. A text with fewer
words than an n-gram has one n-gram made of all of them; a null text or one
without words links with nothing. Rows with equal ids are one document; if their texts
differ, it has the sum of their links. Rows
with a null id link with nothing and come back with a null component, kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (block_pairs, chunks, components, discard, fresh, mix, shingle_hashes, ship, stored, unite,
                     whole_groups, word_hashes, write_table)

WORDS = 5
THRESHOLD = Fraction(4, 5)
HASHES, BAND_ROWS, STEP = 128, 4, 16
TOLERANCE = 1e-6
BLOCK_ROWS, BLOCK_BYTES = 512, 16 << 20

_rng = np.random.RandomState(23)
_XOR = _rng.randint(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_TIMES = (_rng.randint(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_BAND_FACTORS = _rng.randint(1, 1 << 62, BAND_ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def needed_matches(threshold: float, tolerance: float, bits: int = 8) -> np.ndarray:
    """For each number of compared values, the least number of equal ones that keeps a pair.

    With a uniform prior the posterior of the match rate is a Beta, whose tail
    above the threshold's rate is a binomial sum.
    """
    rate = threshold + (1 - threshold) / (1 << bits)
    needed = np.zeros(HASHES + 1, np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        terms = [math.comb(n + 1, k) * rate**k * (1 - rate) ** (n + 1 - k) for k in range(n + 2)]
        reach = np.cumsum(terms)  # reach[m] = P(rate is reached | m of n values equal)
        needed[n] = int(np.argmax(reach >= tolerance))
    return needed


def min_hashes(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash values (one row per text) of n-gram hashes; `begin` has the first n-gram of each text."""
    narrow = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin), HASHES), np.uint32)
    for k in range(HASHES):
        x = (narrow ^ _XOR[k]) * _TIMES[k]
        x ^= x >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(x, begin)
    return out


_SIGNATURE = "doc long, k1 long, k2 long, bands array<long>, sig binary"


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, raw in chunks(texts):
                hashes, first = word_hashes(raw)
                count = np.diff(first)
                place = np.arange(len(hashes)) - np.repeat(first[:-1], count)
                keyed = mix(hashes + mix(place.astype(np.uint64)))
                total = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(keyed, out=total[0, 1:])
                np.cumsum(mix(keyed ^ np.uint64(0x5DEECE66D)), out=total[1, 1:])
                keys = (total[:, first[1:]] - total[:, first[:-1]]).view(np.int64)
                values, owner = shingle_hashes(hashes, first, size)
                full = np.flatnonzero(count > 0)
                begin = np.searchsorted(owner, full)
                sig = min_hashes(values, begin) if len(full) else np.zeros((0, HASHES), np.uint32)
                wide = sig.astype(np.uint64).reshape(len(full), HASHES // BAND_ROWS, BAND_ROWS)
                bands = mix((wide * _BAND_FACTORS).sum(2, dtype=np.uint64)
                            + mix(np.arange(wide.shape[1], dtype=np.uint64) + np.uint64(1)))
                rank = np.full(len(raw), -1)
                rank[full] = np.arange(len(full))
                low = sig.astype(np.uint8)
                empty = count == 0
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(raw)), pa.array(keys[0], mask=empty), pa.array(keys[1], mask=empty),
                    pa.array([bands[r].view(np.int64) if r >= 0 else None for r in rank], pa.list_(pa.int64())),
                    pa.array([low[r].tobytes() if r >= 0 else None for r in rank], pa.binary()),
                ], ["doc", "k1", "k2", "bands", "sig"])
    return run


def _prune(needed: np.ndarray):
    """Spanning trees of the pairs in each bucket part that survive the incremental comparison."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in whole_groups(batches, ["key", "low", "high"], 20_000):
            node, own = table["node"].to_numpy(), table["own"].to_numpy()
            inside = (table["low"].to_numpy() == table["high"].to_numpy())
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
            sizes = np.diff(begin)
            end = np.repeat(begin[1:], sizes)
            labels, found = np.arange(len(node)), []
            at = np.arange(len(node))
            for d in range(1, int(sizes.max())):
                at = at[at + d < end[at]]
                i, j = at, at + d
                use = (labels[i] != labels[j]) & (node[i] != node[j]) & (inside[i] | (own[i] != own[j]))
                i, j = i[use], j[use]
                equal = np.zeros(len(i), np.int64)
                for n in range(STEP, HASHES + 1, STEP):
                    equal += (sig[i, n - STEP : n] == sig[j, n - STEP : n]).sum(1)
                    stay = equal >= needed[n]
                    if not stay.all():
                        i, j, equal = i[stay], j[stay], equal[stay]
                if len(i):
                    unite(labels, i, j)
                    found.append(np.stack((node[i], node[j])))
            if found:
                pairs = np.unique(np.sort(np.concatenate(found, 1), 0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["x", "y"])
    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sorted sets share."""
    if len(sets) == 2:
        a, b = sets
        both = len(a) + len(b) - len(np.unique(np.concatenate(sets)))
        return np.array([[len(a), both], [both, len(b)]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dense = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    owner, column = owner[keep], dense[column[keep]]
    shared = np.zeros((len(sets), len(sets)))
    width = max(1, (8 << 20) // len(sets))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (low, low + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - low] = 1
        shared += part @ part.T
    return np.rint(shared).astype(np.int64)


def _verify(size: int, threshold: Fraction):
    """Links of each document in a cluster part, and the root of its tree there."""
    p, q = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in whole_groups(batches, ["cluster", "low", "high"], 256):
            node, own, weight = (table[c].to_numpy() for c in ("node", "own", "weight"))
            same = table["low"].to_numpy() == table["high"].to_numpy()
            sets: list[np.ndarray] = []
            for _, raw in chunks(table["text"].to_pylist()):
                values, owner = shingle_hashes(*word_hashes(raw), size)
                cut = np.searchsorted(owner, np.arange(len(raw) + 1))
                sets += [np.unique(values[a:b]) for a, b in zip(cut[:-1], cut[1:])]
            out: list[tuple] = []
            for a, b in zip(begin[:-1], begin[1:]):
                if b - a < 2:
                    continue
                size_of = np.array([len(s) for s in sets[a:b]])
                linked = overlaps(sets[a:b]) * (p + q) >= p * (size_of[:, None] + size_of[None, :])
                linked &= node[a:b, None] != node[None, a:b]
                linked &= (size_of[:, None] > 0) & (size_of[None, :] > 0)
                if not same[a]:
                    linked &= own[a:b, None] != own[None, a:b]
                if len(np.unique(node[a:b])) < b - a:  # several texts of one id: a peer counts once
                    linked = _merge_equal(linked, node[a:b])
                labels = np.arange(b - a)
                unite(labels, *np.nonzero(linked))
                least = np.full(b - a, np.iinfo(np.int64).max)
                np.minimum.at(least, labels, node[a:b])
                links = linked @ weight[a:b]
                some = np.flatnonzero(links)
                out.append((node[a:b][some], links[some], least[labels[some]]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], ["node", "links", "root"])
    return run


def _merge_equal(linked: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Move all links of rows with one id to its first row."""
    _, first, inverse = np.unique(node, return_index=True, return_inverse=True)
    to = first[inverse]
    merged = np.zeros_like(linked)
    i, j = np.nonzero(linked)
    merged[to[i], to[j]] = True
    return merged


def similar_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                      threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, n_links, component_id, kept), one row per document.

    n_links is the number of other documents with a similarity of at least
    `threshold`; component_id the least id reachable by links; kept is true
    for that one.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    named = rows.where(F.col("doc").isNotNull())
    signed = stored(named.mapInArrow(_sign(words), _SIGNATURE), "signatures")
    members = signed.select("doc", "k1", "k2").distinct()
    counts = members.where(F.col("k1").isNotNull()).groupBy("k1", "k2").agg(
        F.min("doc").alias("node"), F.count("*").alias("weight"))
    values = signed.where(F.col("k1").isNotNull()).groupBy("k1", "k2").agg(
        F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = stored(counts.join(values, ["k1", "k2"]), "classes")

    bands = classes.select("node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = bands.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS)).drop("n")
    parts = block_pairs(buckets, "node", "blocks").join(classes.select("node", "sig"), "node")
    parts = parts.select("key", "low", "high", "own", "node", "sig").repartition("key", "low", "high")
    candidates = parts.sortWithinPartitions("key", "low", "high").mapInArrow(
        _prune(needed_matches(float(threshold), tolerance)), "x long, y long")
    clusters = components(candidates, "candidates")

    texts, path = write_table(
        clusters.join(classes.groupBy("node").agg(F.max("weight").alias("weight")), "node").join(
            named, F.col("node") == F.col("doc")).select(
                F.col("component").alias("cluster"), "node", "weight", "text"), "clustered")
    sizes = texts.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = sizes.select("cluster", F.greatest(
        F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).alias("blocks"))
    parts = block_pairs(texts.join(sizes, "cluster"), "node", "blocks").repartition("cluster", "low", "high")
    links, links_path = write_table(parts.sortWithinPartitions("cluster", "low", "high").select(
        "cluster", "low", "high", "own", "node", "weight", "text").mapInArrow(
            _verify(words, threshold), "node long, links long, root long"), "links")
    discard(docs.sparkSession, path)

    found = components(links.select("node", "root"), "classes-linked")
    per_class = classes.select("k1", "k2", "node", "weight").join(
        links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(found, "node", "left").select(
        F.col("k1"), F.col("k2"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    result = members.join(per_class, ["k1", "k2"], "left").groupBy(F.col("doc").alias("doc_id")).agg(
        F.coalesce(F.sum("n_links"), F.lit(0)).cast("long").alias("n_links"),
        F.min("component_id").alias("component_id")).withColumn(
        "component_id", F.coalesce("component_id", "doc_id"))
    nameless = rows.where(F.col("doc").isNull()).select(
        F.col("doc").alias("doc_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(None).cast("long").alias("component_id"))
    return result.unionByName(nameless).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_similar(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """One row for each document that stands for its group; all columns stay.

    Rows with a null id all stay, and so does every text of an id that stands for its group.
    """
    keep = fresh(docs.columns, "jj_keep")
    kept = similar_documents(docs, doc_id=doc_id, text=text, **rules).where("kept and doc_id is not null").select(
        F.col("doc_id").alias(keep))
    named = docs.join(kept, F.col(doc_id).cast("long") == F.col(keep), "left_semi").dropDuplicates([doc_id, text])
    return named.unionByName(docs.where(F.col(doc_id).isNull()))
