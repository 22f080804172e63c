"""Benchmark passages in documents, found by q-gram counting in diagonal bands and verified by banded alignment.

An occurrence of an item of m characters with at most k edits shares at least
m - q + 1 - q * k of its q-grams with the text, all on k + 1 neighbouring
diagonals (place in the text minus place in the item). Bands of 2 (k + 1)
diagonals that overlap by half hold every such run whole. Bands with enough
shared q-grams are aligned inside the band, which decides.

Items of over 1,000 characters are looked for by equal parts of at most that
size. Where a whole item is within its edits, one of its parts is within its
own share of them, so every place of a part is tried: the whole item is aligned
around it and its own budget decides, as for any other item.

Case, and the amount of white space, make no difference. The index of the
benchmark goes to the tasks in blocks of a bounded number of characters, one
pass over the documents for each block, so its size does not matter.

A null or empty text contains nothing; a null, empty or blank item is in
nothing; items shorter than a q-gram are searched as they are. Rows with equal
ids and regions are one row of the result. Null ids stay null ids. Very long
texts are worked on whole. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, fresh, mix, ship

Q = 10
EDIT_RATE = 0.08
BLOCK_CHARS = 1_000_000
SEGMENT_CHARS = 1000
CHUNK_CHARS = 1 << 20
REGION = "doc long, item long, start long, end long, edits long"

# Every code point whose lower case is one code point; those with case end before this one.
_CASED = 0x1E944
_FOLD = np.array([ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(_CASED)], np.uint32)
_SPACES = np.array([ord(c) for c in WHITESPACE], np.uint32)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def normal(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with single spaces, and where each came from."""
    low = points.copy()
    cased = low < len(_FOLD)
    low[cased] = _FOLD[low[cased]]
    space = (low == 32) | ((low >= 9) & (low <= 13))
    low[space] = 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return low[keep], np.flatnonzero(keep)


def grams(low: np.ndarray, q: int) -> np.ndarray:
    """A hash of every run of q (8 to 16) code points."""
    one = (low ^ (low >> np.uint32(8)) * np.uint32(37)).astype(np.uint8).astype(np.uint64)
    if len(one) < q:
        return np.zeros(0, np.uint64)
    two = (one[:-1] << np.uint64(8)) | one[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    eight = (four[:-4] << np.uint64(32)) | four[4:]
    n = len(one) - q + 1
    return mix(eight[:n] * np.uint64(0x9E3779B97F4A7C15) + eight[q - 8 : q - 8 + n])


def strip(text: str | None) -> str:
    low, _ = normal(_points(text or ""))
    return low.tobytes().decode("utf-32-le", "surrogatepass").strip(" ")


def segments(text: str) -> list[str]:
    """A text in equal parts of at most SEGMENT_CHARS."""
    count = -(-len(text) // SEGMENT_CHARS)
    cuts = [len(text) * i // count for i in range(count + 1)]
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class Index:
    """The q-grams of a block of items, with their items and places."""

    def __init__(self, items: list[tuple[int, str]], q: int, edit_rate: float):
        self.q = q
        known = [(i, strip(t)) for i, t in items]
        self.short = [(i, t) for i, t in known if 0 < len(t) < q]
        long = [(i, t) for i, t in known if len(t) >= q]
        self.ids = [i for i, _ in long]
        self.items = [(t, _points(t), min(int(len(t) * edit_rate), (len(t) - q) // q)) for _, t in long]
        known = [(n, part) for n, (_, t) in enumerate(long) for part in segments(t)]
        self.whole = [n for n, _ in known]  # of each part
        self.shift = [0] * len(known)  # where a part begins in its item
        for part in range(1, len(known)):
            if self.whole[part] == self.whole[part - 1]:
                self.shift[part] = self.shift[part - 1] + len(known[part - 1][1])
        self.texts = [t for _, t in known]
        self.points = [_points(t) for t in self.texts]
        self.size = np.array([len(p) for p in self.points], np.int64)
        self.budget = np.minimum((self.size * edit_rate).astype(np.int64), (self.size - q) // q)
        self.enough = self.size - q + 1 - q * self.budget
        codes = [grams(p, q) for p in self.points]
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.item = np.repeat(np.arange(len(known)), [len(c) for c in codes])[order]
        self.place = np.concatenate([np.arange(len(c)) for c in codes])[order] if codes else np.zeros(0, np.int64)
        self.codes, self.first = np.unique(code[order], return_index=True)
        self.first = np.append(self.first, len(code))
        self.bits = max(16, math.ceil(math.log2(len(self.codes) * 16 + 1)))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self.codes >> np.uint64(64 - self.bits)] = True

    def bands(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands with enough shared q-grams."""
        code = grams(low, self.q)
        at = np.flatnonzero(self.maybe[code >> np.uint64(64 - self.bits)]) if len(self.codes) else np.zeros(0, np.int64)
        code = code[at]
        rank = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        real = self.codes[rank] == code if len(at) else np.zeros(0, bool)
        at, rank = at[real], rank[real]
        many = self.first[rank + 1] - self.first[rank]
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[rank], many)
        item = self.item[entry]
        width = self.budget[item] + 1
        band = (np.repeat(at, many) - self.place[entry]) // width
        key = (item << 40) + band + (1 << 32)
        key, count = np.unique(np.concatenate((key, key - 1)), return_counts=True)
        key = key[count >= self.enough[key >> 40]]
        item = key >> 40
        return item, ((key & ((1 << 40) - 1)) - (1 << 32)) * (self.budget[item] + 1)


def align(pattern: np.ndarray, text: np.ndarray, first: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """The best occurrence of a pattern that starts on one of `width` diagonals from `first`.

    Returns (edits, start, end) in the text, or None beyond the budget. Only
    the cells of the band, widened by the budget on both sides, are computed.
    """
    low, span = first - budget, width + 2 * budget
    padded = np.full(span + len(pattern), 0xFFFFFFFF, np.uint32)
    a, b = max(low, 0), min(low + len(padded), len(text))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    one = np.int64(1) << 32
    lane = np.arange(span, dtype=np.int64)
    never = np.int64(1) << 60
    inside = (lane + low >= 0) & (lane + low <= len(text))
    cost = np.where(inside, span - lane, never)  # edits in the high half; the later start wins a tie
    for i, want in enumerate(pattern):
        step = cost + np.where(padded[i : i + span] == want, np.int64(0), one)
        step[:-1] = np.minimum(step[:-1], cost[1:] + one)
        cost = np.minimum.accumulate(step - lane * one) + lane * one
    ends = low + lane + len(pattern)
    cost = np.where((ends >= 0) & (ends <= len(text)), cost, never)
    best = int(np.argmin(cost))
    edits, start = int(cost[best] >> 32), int(low + span - (cost[best] & (one - 1)))
    return (edits, start, int(ends[best])) if edits <= budget else None


def regions(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item id, start, end, edits): occurrences in code points of the text as given."""
    begin = np.concatenate(([0], np.cumsum([len(t or "") + 1 for t in texts])))
    low, source = normal(_points("\x00".join([*(t or "" for t in texts), ""])))
    edge = np.searchsorted(source, begin)
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for item, first in zip(*index.bands(low)):
        size, budget = int(index.size[item]), int(index.budget[item])
        middle = min(max(int(first) + budget + size // 2, 0), len(low) - 1)
        for text in {int(np.searchsorted(edge, p, "right")) - 1
                     for p in (max(int(first), 0), middle, min(int(first) + 2 * budget + 2 + size, len(low) - 1))}:
            a, b = int(edge[text]), int(edge[text + 1]) - 1
            lo, hi = max(a, int(first) - budget), min(b, int(first) + 3 * budget + 2 + size)
            place = _find(low[lo:hi], index.texts[item]) if hi - lo >= size else -1
            hit = (0, lo + place, lo + place + size) if place >= 0 else align(
                index.points[item], low[a:b], int(first) - a, 2 * (budget + 1), budget)
            if hit:
                hit = hit if place >= 0 else (hit[0], hit[1] + a, hit[2] + a)
                found.setdefault((text, int(item)), []).append(hit)
    for (text, item), hits in _wholes(index, found, low, edge).items():
        used: list[tuple[int, int]] = []
        for edits, a, b in sorted(set(hits)):
            if b > a and all(b <= x or a >= y for x, y in used):
                used.append((a, b))
                yield (text, index.ids[item], int(source[a] - begin[text]), int(source[b - 1] + 1 - begin[text]), edits)
    for key, short in index.short:
        for text in range(len(texts)):
            piece, at = low[edge[text] : edge[text + 1] - 1], 0
            while (place := _find(piece[at:], short)) >= 0:
                a = int(edge[text]) + at + place
                yield (text, key, int(source[a] - begin[text]), int(source[a + len(short) - 1] + 1 - begin[text]), 0)
                at += place + len(short)


def _wholes(index: Index, found: dict, low: np.ndarray, edge: np.ndarray) -> dict:
    """Occurrences of items by (text, item), given those of their parts."""
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    near: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for (text, part), hits in found.items():
        key = text, index.whole[part]
        if len(index.items[key[1]][0]) == index.size[part]:
            out[key] = hits
        else:
            # The part of a true occurrence lies on the band in which the hit was the best, so not farther than this.
            slack = 4 * (int(index.budget[part]) + 1)
            near.setdefault(key, set()).update((a - index.shift[part], slack) for _, a, _ in hits)
    for (text, item), starts in near.items():
        whole, points, budget = index.items[item]
        a, b = int(edge[text]), int(edge[text + 1]) - 1
        todo = sorted(starts)
        while todo:
            slack = budget + max(s for _, s in todo)
            first, last = todo[0][0] - slack, todo[0][0] + budget + slack
            todo = [(d, s) for d, s in todo if d > todo[0][0] + budget]
            lo, hi = max(a, first - budget), min(b, last + budget + len(points))
            place = _find(low[lo:hi], whole) if hi - lo >= len(points) else -1
            hit = (0, lo + place - a, lo + place - a + len(points)) if place >= 0 else align(
                points, low[a:b], first - a, last - first + 1, budget)
            if hit:
                out.setdefault((text, item), []).append((hit[0], hit[1] + a, hit[2] + a))
    return out


def _find(points: np.ndarray, what: str) -> int:
    return points.tobytes().decode("utf-32-le", "surrogatepass").find(what)


def _scan(items: list[tuple[int, str]], q: int, edit_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, q, edit_rate)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= CHUNK_CHARS):
                    size += len(texts[stop] or "")
                    stop += 1
                rows = [(ids[start + t], *rest) for t, *rest in regions(index, texts[start:stop])]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*rows)], ["doc", "item", "start", "end", "edits"])
                start = stop
    return run


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                         item_id: str = "item_id", item_text: str = "text", q: int = Q,
                         edit_rate: float = EDIT_RATE) -> DataFrame:
    """(doc, item, start, end, edits) for every benchmark passage in a document.

    An item may differ from the passage by `edit_rate` edits a character.
    """
    if not 8 <= q <= 16:
        raise ValueError("q has to be from 8 to 16")
    ship(docs.sparkSession)
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where(
        "text is not null").distinct()
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    found = None
    for block in range(blocks):
        own = [(r["id"], r["text"]) for r in items.where(
            F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).toLocalIterator()]
        part = rows.mapInArrow(_scan(own, q, edit_rate), REGION)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **rules) -> DataFrame:
    """The documents without benchmark passages; all columns stay. Rows of one id go or stay together."""
    key = fresh(docs.columns, "dc_doc")
    hit = contaminated_regions(docs, benchmark, doc_id=doc_id, **rules).select(F.col("doc").alias(key)).distinct()
    return docs.join(hit, F.col(doc_id).cast("long").eqNullSafe(F.col(key)), "left_anti")
