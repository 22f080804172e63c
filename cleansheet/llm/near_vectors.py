"""Near-duplicate vectors by cosine, with hierarchical navigable small-world graphs per shard.

Vectors that are equal become one node with a weight. Nodes are dealt to
shards by hash, and each shard gets a graph (written as a table with a row for
each node, so it is built once and no cell grows with the shard). Every node
then searches every shard: a task reads a shard's graph, then a block of
queries, some at a time. The beam of a shard starts at a width that its
recall audit has passed, and it is doubled further for every query
that finds more than half of its beam above the threshold, so the number of partners
has no limit. A beam wider than an eighth of the shard is the whole shard, and
so is a doubled one where that is less work.
Cosines of candidates are computed again in double precision before they count.

A task holds one shard: its vectors as single-precision units and as they came
(as floats if that loses nothing, else as doubles) and its edges. Shards are as
many as keep that below SHARD_BYTES; all else is done in parts of bounded size.

An audit asks for vectors of the shard, without their match with themselves,
for vectors of other shards, and for altered copies of vectors of the shard at
cosines from the threshold up, which have a partner even where links are rare.
It compares with brute force and doubles the beam until the mean recall of a
query is high enough for each kind, those that widen their beam counted apart.

A task returns numbers of links and spanning trees, not pairs. Components of
the trees are the near-duplicate groups.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; vectors of different lengths do not link. Rows that repeat are
one vector; an id with several vectors has the sum of their links. Rows with a null
id link with nothing and come back with a null component, kept. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, ship, stored, unite, write_table

THRESHOLD = 0.9
DEGREE, BASE_DEGREE, BUILD_BEAM, FIRST_BEAM = 16, 32, 64, 48
DESCENT_BEAM, ENTRIES = 12, 8
MIN_SHARDS, SHARD_ROWS, BLOCK_ROWS = 6, 250_000, 16_384
SHARD_BYTES = 176 << 20  # of vectors and edges in a task
SCAN_ROWS = 2_048  # so many nodes are scanned in the time that the graph takes for one place of a beam
HELD_BYTES, TILE = 8 << 20, 1 << 20  # of gathered vectors, and cosines, that are held at once
AUDITED, AUDIT_RECALL = 500, 0.995
SLACK = 1e-4  # of single-precision cosines, so that none that counts is missed


class Graph:
    """A layered graph over unit vectors. Queries are searched many at a time."""

    def __init__(self, vectors: np.ndarray, seed: int = 3):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        draws = np.random.RandomState(seed).random_sample(n)
        level = np.floor(-np.log(np.maximum(draws, 1e-12)) / np.log(DEGREE)).astype(np.int64)
        layers = int(level.max(initial=0)) + 1
        self.layers = [np.flatnonzero(level >= k) for k in range(layers)]
        self.edges = [np.full((n if k == 0 else len(self.layers[k]), BASE_DEGREE if k == 0 else DEGREE), -1, np.int32)
                      for k in range(layers)]
        self.row = [None] + [_rows_of(self.layers[k], n) for k in range(1, layers)]
        self.beam = n
        for k in reversed(range(layers)):
            self._build(k)

    @classmethod
    def of(cls, vectors: np.ndarray, base: np.ndarray, upper: dict[int, bytes], beam: int) -> Graph:
        """The graph whose edges `cells` has given: those of the lowest layer, and of the layers above it by node."""
        self, n = cls.__new__(cls), len(vectors)
        level = np.zeros(n, np.int64)
        level[list(upper)] = [len(cell) // (4 * DEGREE) for cell in upper.values()]
        self.vectors, self.beam, layers = vectors, beam, int(level.max(initial=0)) + 1
        self.layers = [np.flatnonzero(level >= k) for k in range(layers)]
        self.edges = [base] + [
            np.frombuffer(b"".join(upper[i][4 * DEGREE * (k - 1) : 4 * DEGREE * k] for i in self.layers[k].tolist()),
                          np.int32).reshape(-1, DEGREE) for k in range(1, layers)]
        self.row = [None] + [_rows_of(self.layers[k], n) for k in range(1, layers)]
        return self

    def cells(self, first: int, last: int) -> list[bytes]:
        """The edges of some nodes, from the lowest layer up to the node's own."""
        out = [row.tobytes() for row in self.edges[0][first:last]]
        for nodes, edges in zip(self.layers[1:], self.edges[1:]):
            for i in range(*np.searchsorted(nodes, (first, last))):
                out[nodes[i] - first] += edges[i].tobytes()
        return out

    def _build(self, layer: int) -> None:
        """Insert the nodes of a layer in growing batches, each linked to what its beam finds among the earlier ones."""
        nodes, edges = self.layers[layer], self.edges[layer]
        at = (lambda x: x) if layer == 0 else (lambda x: self.row[layer][x])
        done = min(len(nodes), 2 * edges.shape[1])
        first = nodes[:done]
        near = np.argsort(-(self.vectors[first] @ self.vectors[first].T), axis=1, kind="stable")
        near = near[near != np.arange(done)[:, None]].reshape(done, max(done - 1, 0))[:, : edges.shape[1]]
        edges[at(first), : near.shape[1]] = first[near]
        entry = first[:1]
        while done < len(nodes):
            batch = nodes[done : done + max(64, done // 3)]
            wide = DEGREE if layer else BASE_DEGREE
            chosen = np.full((len(batch), wide // 2), -1, np.int32)
            for part in range(0, len(batch), self._rows()):
                rows = slice(part, part + self._rows())
                q = self.vectors[batch[rows]]
                ids, sims = self._search_layer(q, self._enter(q, layer, entry), layer, BUILD_BEAM)
                mates = self._mates(batch, part, sims[:, wide // 2 - 1], wide // 2)
                ids, sims = np.concatenate((ids, mates[0]), 1), np.concatenate((sims, mates[1]), 1)
                order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
                ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
                chosen[rows] = self._diverse(ids, sims, wide // 2)
            edges[at(batch), : chosen.shape[1]] = chosen
            self._link_back(layer, batch, chosen)
            done += len(batch)

    def _mates(self, batch: np.ndarray, first: int, floor: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """The `wide` nearest nodes of the same batch for its rows from `first` on, as far as they are nearer than a row's `floor`."""
        ids = np.full((len(floor), wide), -1, np.int64)
        sims = np.full((len(floor), wide), -np.inf, np.float32)
        own, step = self.vectors[batch], max(1, min(128, 2 * TILE // len(batch)))
        for part in range(0, len(floor), step):
            near = own[first + part : first + min(part + step, len(floor))] @ own.T
            near[np.arange(len(near)), first + part + np.arange(len(near))] = -np.inf
            hit = near > floor[part : part + step, None]
            many = np.flatnonzero(hit.sum(1) > wide)
            best = np.argpartition(near[many], -wide, axis=1)[:, -wide:] if len(many) else np.zeros((0, wide), np.int64)
            hit[many] = False
            hit[many[:, None], best] = True
            row, mate = np.nonzero(hit)
            place = np.arange(len(row)) - np.searchsorted(row, row)
            ids[part + row, place], sims[part + row, place] = batch[mate], near[row, mate]
        return ids, sims

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, wide: int) -> np.ndarray:
        """Up to `wide` candidates of each row that are closer to the row than to one already chosen; then the nearest."""
        step = max(1, 2 * self._held() // ids.shape[1])
        return np.concatenate([self._diverse_rows(ids[a : a + step], sims[a : a + step], wide) for a in range(0, len(ids), step)])

    def _diverse_rows(self, ids: np.ndarray, sims: np.ndarray, wide: int) -> np.ndarray:
        count, among = len(ids), None
        if ids.shape[1] <= 256:  # cosines among the candidates of a row; too many for a node with very many edges
            among = self.vectors.take(ids, 0)
            among = among @ among.transpose(0, 2, 1)
        chosen = np.full((count, wide), -1, np.int32)
        filled = np.zeros(count, np.int64)
        taken = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            ok = (ids[:, c] >= 0) & (filled < wide)
            rows = np.flatnonzero(ok)
            if not len(rows):
                break
            if among is None:
                other = chosen[rows]
                cross = np.einsum("rwd,rd->rw", self.vectors.take(other, 0), self.vectors.take(ids[rows, c], 0))
                cross[other < 0] = -np.inf
            else:
                cross = np.where(taken[rows], among[rows, c], -np.inf)
            rows = rows[cross.max(1) <= sims[rows, c]]
            chosen[rows, filled[rows]] = ids[rows, c]
            taken[rows, c] = True
            filled[rows] += 1
        for c in range(ids.shape[1]):
            rows = np.flatnonzero(~taken[:, c] & (ids[:, c] >= 0) & (filled < wide))
            chosen[rows, filled[rows]] = ids[rows, c]
            filled[rows] += 1
        return chosen

    def _link_back(self, layer: int, batch: np.ndarray, chosen: np.ndarray) -> None:
        """Add the reverse edges; a node with too many keeps a diverse choice of the nearest."""
        edges = self.edges[layer]
        at = (lambda x: x) if layer == 0 else (lambda x: self.row[layer][x])
        source = np.repeat(batch, chosen.shape[1])[chosen.ravel() >= 0]
        target = chosen.ravel()[chosen.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hit, first, many = np.unique(target, return_index=True, return_counts=True)
        alike = np.argsort(many, kind="stable")  # one node with many edges widens few others
        part = 0
        while part < len(hit):
            size = min(1024, len(hit) - part)
            while size > 1 and size * (edges.shape[1] + many[alike[part + size - 1]]) > self._held():
                size //= 2
            rows = alike[part : part + size]
            part += size
            count = many[rows]
            row = np.repeat(np.arange(size), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            added = np.full((size, int(count.max())), -1, np.int64)
            added[row, place] = source[first[rows][row] + place]
            all_ids = np.sort(np.concatenate((edges[at(hit[rows])].astype(np.int64), added), 1), axis=1)
            all_ids[:, 1:][all_ids[:, 1:] == all_ids[:, :-1]] = -1
            sims = np.einsum("rwd,rd->rw", self.vectors.take(all_ids, 0), self.vectors[hit[rows]])
            sims[all_ids < 0] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")
            all_ids, sims = np.take_along_axis(all_ids, order, 1), np.take_along_axis(sims, order, 1)
            if ((all_ids >= 0).sum(1) > edges.shape[1]).any():
                edges[at(hit[rows])] = self._diverse(all_ids, sims, edges.shape[1])
            else:
                edges[at(hit[rows])] = all_ids[:, : edges.shape[1]]

    def _rows(self) -> int:
        """Queries searched together: bounded by the marks of what they have visited and by the vectors of a step."""
        return int(max(16, min(512, (48 << 20) // max(len(self.vectors), 1), 8 * self._held() // BASE_DEGREE)))

    def _held(self) -> int:
        """Vectors gathered at once."""
        return max(1, HELD_BYTES // (4 * max(self.vectors.shape[1], 1)))

    def _enter(self, q: np.ndarray, layer: int, entry: np.ndarray) -> np.ndarray:
        """Where to enter a layer: the nearest nodes found by descending through the layers above it."""
        top = len(self.layers) - 1
        if layer == top:
            return np.repeat(entry[None, :1], len(q), 0)
        at = np.repeat(self.layers[top][None, :1], len(q), 0)
        for k in range(top, layer, -1):
            at = self._search_layer(q, at, k, DESCENT_BEAM)[0][:, :ENTRIES]
        return at

    def _search_layer(self, q: np.ndarray, entry: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and cosines in each query's beam once all of it is expanded, nearest first."""
        edges, count = self.edges[layer], len(q)
        ids = np.full((count, beam), -1, np.int64)
        sims = np.full((count, beam), -np.inf, np.float32)
        width = min(beam, entry.shape[1])
        ids[:, :width] = entry[:, :width]
        sims[:, :width] = np.einsum("red,rd->re", self.vectors[ids[:, :width]], q)
        sims[ids < 0] = -np.inf
        open_ = ids >= 0
        n = len(self.vectors)
        seen = np.zeros(count * n, bool)
        row, place = np.nonzero(open_)
        seen[row * n + ids[row, place]] = True
        rows = np.arange(count)
        while len(rows):
            best = np.argmax(np.where(open_[rows], sims[rows], -np.inf), 1)
            live = open_[rows, best]
            rows, best = rows[live], best[live]
            if not len(rows):
                break
            open_[rows, best] = False
            node = ids[rows, best]
            near = edges.take(node if layer == 0 else self.row[layer][node], 0).astype(np.int64)
            near = np.where(near < 0, node[:, None], near)
            mark = near + (rows * n)[:, None]
            new = ~seen.take(mark)
            seen[mark[new]] = True
            sim = np.full(near.shape, -np.inf, np.float32)
            sim[new] = np.einsum("pd,pd->p", self.vectors.take(near[new], 0), q.take(rows[np.nonzero(new)[0]], 0))
            some = np.flatnonzero(sim.max(1) > sims[rows].min(1))
            if not len(some):
                continue
            r = rows[some]
            all_sims = np.concatenate((sims[r], sim[some]), 1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[r] = np.take_along_axis(all_sims, keep, 1)
            ids[r] = np.take_along_axis(np.concatenate((ids[r], near[some]), 1), keep, 1)
            open_[r] = np.take_along_axis(np.concatenate((open_[r], new[some]), 1), keep, 1) & (sims[r] > -np.inf)
        ids[sims == -np.inf] = -1
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def within(self, q: np.ndarray, threshold: float, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with a cosine of at least `threshold`, with beams widened until less than half of them is above it."""
        return self._within(q, threshold, beam)[:2]

    def _within(self, q: np.ndarray, threshold: float, beam: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs, and which queries have widened their beam."""
        widened = np.zeros(len(q), bool)
        out = [np.zeros((2, 0), np.int64), *(np.stack(x) for x in self.pairs(q, threshold, beam, widened))]
        return *np.concatenate(out, 1), widened

    def pairs(self, q: np.ndarray, threshold: float, beam: int | None = None,
              widened: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of `within`, some at a time, however many a query has; marks which queries have widened their beam."""
        n, start = len(self.vectors), beam or self.beam
        for part in range(0, len(q), self._rows()):
            left, beam = np.arange(part, min(part + self._rows(), len(q))), start
            while len(left):
                if beam * (8 if beam == start else max(8, SCAN_ROWS)) >= n:
                    yield from self._scan(q, left, threshold)
                    break
                ids, sims = self._search_layer(q[left], self._enter(q[left], 0, self.layers[0][:1]), 0, beam)
                full = (sims >= threshold).sum(1) * 2 > beam
                row, place = np.nonzero((sims >= threshold) & ~full[:, None])
                yield left[row], ids[row, place]
                left, beam = left[full], beam * 2
                if widened is not None:
                    widened[left] = True

    def _scan(self, q: np.ndarray, rows: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of some queries, by the cosines with a run of nodes after the other."""
        asked, step = q[rows], max(1, TILE // max(len(rows), 1))
        for first in range(0, len(self.vectors), step):
            near = asked @ self.vectors[first : first + step].T
            row, node = np.divmod(np.flatnonzero(near >= threshold), near.shape[1])
            if len(row):
                yield rows[row], first + node

    def audit(self, threshold: float, others: np.ndarray | None = None) -> float:
        """Widen the first beam until the audited queries find what brute force finds; the least mean recall then.

        `others` are vectors that are not in the graph.
        """
        n = len(self.vectors)
        self.beam = FIRST_BEAM
        if self.beam * 8 >= n:
            return 1.0
        picked = np.unique(np.linspace(0, n - 1, min(AUDITED, n)).astype(np.int64))
        kinds = [(self.vectors[picked], picked), (_altered(self.vectors[picked], threshold), None)]
        if others is not None and len(others):
            kinds.append((np.ascontiguousarray(others, np.float32), None))
        wanted = [self._count(q, own, threshold) for q, own in kinds]
        while True:
            recall = 1.0
            for (q, own), many in zip(kinds, wanted):
                got, widened = np.zeros(len(q), np.int64), np.zeros(len(q), bool)
                step = max(1, TILE // int(max(1, many.max(initial=0))))  # queries whose pairs are held at once
                for part in range(0, len(q), step):
                    rows = slice(part, part + step)
                    query, node, widened[rows] = self._within(q[rows], threshold, self.beam)
                    if own is not None:
                        query = query[node != own[rows][query]]
                    got[rows] = np.bincount(query, minlength=len(widened[rows]))
                share = np.minimum(got / np.maximum(many, 1), 1)
                for group in (widened, ~widened):
                    if (group & (many > 0)).any():
                        recall = min(recall, float(share[group & (many > 0)].mean()))
            if recall >= AUDIT_RECALL or self.beam * 8 >= n:
                return recall
            self.beam *= 2

    def _count(self, q: np.ndarray, own: np.ndarray | None, threshold: float) -> np.ndarray:
        """How many nodes other than its `own` brute force finds for each query."""
        out = np.zeros(len(q), np.int64)
        for query, node in self._scan(q, np.arange(len(q)), threshold):
            if own is not None:
                query = query[node != own[query]]
            out += np.bincount(query, minlength=len(q))
        return out


def _altered(vectors: np.ndarray, threshold: float, seed: int = 7) -> np.ndarray:
    """A unit vector for each given one, at a cosine drawn between the threshold and one."""
    rng = np.random.RandomState(seed)
    off = rng.randn(*vectors.shape)
    off -= (off * vectors).sum(1, keepdims=True) * vectors
    off /= np.maximum(np.sqrt((off * off).sum(1, keepdims=True)), 1e-12)
    cosine = threshold + (1 - threshold) * rng.uniform(0.001, 1, (len(vectors), 1))
    return (cosine * vectors + np.sqrt(1 - cosine * cosine) * off).astype(np.float32)


def _rows_of(nodes: np.ndarray, n: int) -> np.ndarray:
    rows = np.full(n, -1, np.int64)
    rows[nodes] = np.arange(len(nodes))
    return rows


@dataclass
class Shard:
    """A graph with the ids, weights and vectors of its nodes, as they came."""

    graph: Graph
    node: np.ndarray
    weight: np.ndarray
    raw: np.ndarray


def _unit(exact: np.ndarray) -> np.ndarray:
    exact = exact.astype(np.float64, copy=False)
    scaled = exact / np.abs(exact).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _units(parts: Sequence[np.ndarray]) -> np.ndarray:
    """All vectors as single-precision units."""
    out, done = np.empty((sum(map(len, parts)), parts[0].shape[1]), np.float32), 0
    for part in parts:
        out[done : done + len(part)] = _unit(part)
        done += len(part)
    return out


def _matrix(raw: pa.Array, length: int) -> np.ndarray:
    """Vectors from their bytes: floats if all of them are, else doubles."""
    cells = raw.to_pylist()
    kinds = [np.float32 if len(cell) == 4 * length else np.float64 for cell in cells]
    if len(set(kinds)) == 1:
        return np.frombuffer(b"".join(cells), kinds[0]).reshape(-1, length)
    return np.stack([np.frombuffer(cell, kind).astype(np.float64) for cell, kind in zip(cells, kinds)])


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, of floats if they lose nothing, else of doubles; length 0 for those that link with nothing."""
    for batch in batches:
        raw, length = [], []
        for v in batch.column(1).to_pylist():
            x = np.array([], float) if not v or any(c is None for c in v) else np.array(v, np.float64)
            good = len(x) > 0 and np.isfinite(x).all() and bool(x.any())
            x = x + 0.0
            with np.errstate(over="ignore", under="ignore"):
                small = x.astype(np.float32)
            raw.append((small if (small == x).all() else x).tobytes() if good else None)
            length.append(len(x) if good else 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(length, pa.int32()), pa.array(raw, pa.binary())], ["vec", "length", "raw"])


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """The rows of sorted batches, cut where a key changes; a group can take several cuts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        begin = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(begin[:-1], begin[1:]):
            yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)  # a copy, so that the batch can go


def _build(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, weight, raw, others = None, [], [], [], []
        for (*now, probe), rows in _runs(batches, ("length", "shard", "probe")):
            if now != key:
                yield from _graph_rows(key, node, weight, raw, others, threshold)
                key, node, weight, raw, others = now, [], [], [], []
            (others if probe else raw).append(_matrix(rows.column("raw"), now[0]))
            if not probe:
                node.append(_numbers(rows.column("node")))
                weight.append(_numbers(rows.column("weight")))
        yield from _graph_rows(key, node, weight, raw, others, threshold)
    return run


def _graph_rows(key: list[int] | None, node: list, weight: list, raw: list, others: list,
                threshold: float) -> Iterator[pa.RecordBatch]:
    """The audited graph of a group, a row for each node."""
    if not node:
        return
    graph, place = Graph(_units(raw)), 0
    graph.audit(threshold - SLACK, _units(others) if others else None)
    for ids, weights, vectors in zip(node, weight, raw):
        for first in range(0, len(ids), 4096):
            rows = slice(first, first + 4096)
            count = len(ids[rows])
            yield pa.RecordBatch.from_arrays([
                *(pa.array(np.full(count, x, np.int32)) for x in key),
                pa.array(np.arange(place, place + count, dtype=np.int32)), pa.array(ids[rows]), pa.array(weights[rows]),
                pa.array([v.tobytes() for v in vectors[rows]], pa.binary()),
                pa.array(graph.cells(place, place + count), pa.binary()), pa.array(np.full(count, graph.beam, np.int32))],
                ["length", "shard", "place", "node", "weight", "raw", "edges", "beam"])
            place += count


class _Reader:
    """Puts a shard together from the rows of its graph."""

    def __init__(self):
        self.node, self.weight, self.raw, self.base, self.upper, self.count, self.beam = [], [], [], [], {}, 0, 0

    def add(self, rows: pa.RecordBatch, length: int) -> None:
        self.node.append(_numbers(rows.column("node")))
        self.weight.append(_numbers(rows.column("weight")))
        self.raw.append(_matrix(rows.column("raw"), length))
        cells, low = rows.column("edges").to_pylist(), 4 * BASE_DEGREE
        self.base.append(np.frombuffer(b"".join(cell[:low] for cell in cells), np.int32).reshape(-1, BASE_DEGREE))
        self.upper.update((self.count + i, cell[low:]) for i, cell in enumerate(cells) if len(cell) > low)
        self.count += len(cells)
        self.beam = rows.column("beam")[0].as_py()

    def shard(self) -> Shard:
        graph = Graph.of(_units(self.raw), _whole(self.base), self.upper, self.beam)
        return Shard(graph, _whole(self.node), _whole(self.weight), _whole(self.raw))


def _whole(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; they are given up."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _query(threshold: float):
    """Links of each query in a shard and trees of them; a group begins with its graph."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader, shard, labels = None, None, None, None
        for (*now, asks), rows in _runs(batches, ("length", "shard", "block", "asks")):
            if now != key:
                key, reader, shard, labels = now, _Reader(), None, None
            if not asks:
                reader.add(rows, now[0])
                continue
            if shard is None:
                shard, reader = reader.shard(), None
                labels = np.arange(len(shard.node))
            yield _answers(shard, labels, _numbers(rows.column("node")), _matrix(rows.column("raw"), now[0]), threshold)
    return run


def _answers(shard: Shard, labels: np.ndarray, ids: np.ndarray, raw: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Links of some queries and a tree of what they join: every query, and peers that no earlier ones have put together."""
    exact, links = _unit(raw), np.zeros(len(ids), np.int64)
    own, asking, found = np.arange(len(labels) + len(ids)), np.zeros(len(ids), bool), np.zeros(len(labels), bool)
    for query, peer in shard.graph.pairs(exact.astype(np.float32), threshold - SLACK):
        true = np.zeros(len(query), bool)
        step = max(1, HELD_BYTES // (8 * exact.shape[1]))
        for part in range(0, len(query), step):
            s = slice(part, part + step)
            peers, at = np.unique(peer[s], return_inverse=True)
            true[s] = np.einsum("rd,rd->r", exact[query[s]], _unit(shard.raw[peers])[at]) >= threshold
        true &= ids[query] != shard.node[peer]
        query, peer = query[true], peer[true]
        if not len(query):
            continue
        links += np.bincount(query, shard.weight[peer], len(ids)).astype(np.int64)
        unite(own, len(labels) + query, peer)
        asking[query], found[peer] = True, True
    asking, found = np.flatnonzero(asking), np.flatnonzero(found)
    found = found[labels[found] != labels[own[found]]]
    unite(labels, found, own[found])
    root = np.concatenate((own[len(labels) + asking], own[found]))
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate((ids[some], ids[asking], shard.node[found]))),
        pa.array(np.concatenate((links[some], np.zeros(len(root), np.int64)))),
        pa.array(np.concatenate((ids[some], shard.node[root])))], ["node", "links", "peer"])


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding",
                    threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS,
                    min_shards: int = MIN_SHARDS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector id.

    n_links is the number of other vectors with a cosine of at least
    `threshold`; component_id the least id reachable by links.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec"), F.col(embedding).cast("array<double>").alias("v"))
    named = rows.where("vec is not null").mapInArrow(_prepare, "vec long, length int, raw binary")
    keyed, keyed_path = write_table(named.withColumns({
        "k1": F.xxhash64("length", "raw"), "k2": F.xxhash64("raw", "length", F.lit(1))}).select(
        "vec", "length", "raw", "k1", "k2"), "vectors")
    members = stored(keyed.select("vec", "k1", "k2", "length").distinct(), "vector-members")
    good = keyed.where("length > 0")
    classes = stored(
        members.where("length > 0").groupBy("k1", "k2").agg(F.min("vec").alias("node"), F.count("*").alias("weight")).join(
            good.groupBy("k1", "k2").agg(F.first("length").alias("length"), F.first("raw").alias("raw")), ["k1", "k2"]),
        "vector-classes")
    discard(vectors.sparkSession, keyed_path)
    n, held = classes.agg(F.count("*"), F.coalesce(
        F.sum(F.col("length") * 4 + F.octet_length("raw") + 4 * BASE_DEGREE + 64), F.lit(0))).first()
    shards = max(min_shards, -(-n // shard_rows), -(-held // SHARD_BYTES))
    # A shard is sent once for each block of queries; more blocks than that would send more of graphs than of queries.
    blocks = max(1, min(-(-n // BLOCK_ROWS), 2 * shards // 3))
    dealt = classes.select("node", "weight", "length", "raw").withColumns({
        "shard": F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"),
        "block": F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).cast("int")})
    # Some vectors of every length, as queries of the audits of all other shards.
    step = F.greatest(F.col("n") / AUDITED, F.lit(1)).cast("long")
    probes = dealt.join(classes.groupBy("length").agg(F.count("*").alias("n")), "length").where(
        F.pmod(F.xxhash64("node", F.lit(2)), step) == 0).select(
        "node", "weight", "length", "raw", F.explode(F.filter(
            F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard"))).alias("shard"), F.lit(1).alias("probe"))
    graphs, graphs_path = write_table(
        dealt.select("node", "weight", "length", "raw", "shard", F.lit(0).alias("probe")).unionByName(
            probes).repartitionById(shards, "shard").sortWithinPartitions("length", "shard", "probe").select(
            "length", "shard", "node", "weight", "raw", "probe").mapInArrow(_build(threshold), ", ".join((
                "length int", "shard int", "place int", "node long", "weight long", "raw binary", "edges binary",
                "beam int"))), "graphs")
    asked = dealt.select(
        "length", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "node", "raw").join(
        # A shard without vectors of some length answers nothing.
        graphs.select("length", "shard").distinct(), ["length", "shard"], "left_semi").withColumns({
            "asks": F.lit(1), "place": F.lit(0), "weight": F.lit(None).cast("long"),
            "edges": F.lit(None).cast("binary"), "beam": F.lit(None).cast("int")})
    told = graphs.withColumns({
        "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "asks": F.lit(0)})
    where = ["length", "shard", "block", "asks"]
    met = told.unionByName(asked).repartitionById(shards * blocks, F.col("shard") * blocks + F.col("block")).select(
        *where, "place", "node", "weight", "raw", "edges", "beam").sortWithinPartitions(*where, "place")
    links, links_path = write_table(met.mapInArrow(_query(threshold), "node long, links long, peer long"), "vector-links")
    discard(vectors.sparkSession, graphs_path)

    found = components(links.where("node <> peer").select("node", "peer"), "vector-components")
    per_class = classes.select("k1", "k2", "node", "weight").join(
        links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(found, "node", "left").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    result = members.join(per_class, ["k1", "k2"], "left").groupBy(F.col("vec").alias("vec_id")).agg(
        F.coalesce(F.sum("n_links"), F.lit(0)).cast("long").alias("n_links"),
        F.min("component_id").alias("component_id")).withColumn(
        "component_id", F.coalesce("component_id", "vec_id"))
    nameless = rows.where("vec is null").select(
        F.col("vec").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(None).cast("long").alias("component_id"))
    return result.unionByName(nameless).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
