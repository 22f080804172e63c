"""Packing documents into token windows with their lexical neighbours.

Texts become token ids; whole windows of a long document stand for themselves,
and what is left of each document (its tail) is packed. Tails are dealt to
shards of a bounded number by content: they are sorted by their heaviest BM25
terms, from a common one to a rare one, and cut into ranges, so tails that
share them lie together and a hot term is split by the rarer ones. Neighbours
in another shard are not seen; up to `shard_docs` tails there is one shard and
the search is complete. Each shard holds a BM25 inverted index of its tails
over token ids, with document frequencies and the average length counted over
the whole corpus. A seed opens a window and its neighbours that are still
unused fill it, best first; the last one is cut where the window ends and its
rest is the next seed. So only the last window of a shard can have padding.

A null text has no ids of its own, only the end id. Rows are documents: rows
that repeat are packed as often as they occur, null ids come back as null.
Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, span_hashes, stored, whole_groups, write_table

WINDOW = 1024
END_ID = 0
SHARD_DOCS = 2048
K1, B = 1.2, 0.75
CHUNK_BYTES = 2 << 20
CACHED_PIECES = 800_000
LEARN_PIECES = 2048
BATCH_ROWS = 1024  # whose texts and ids a task holds at once
COMMON_SHARE = 8  # terms that more than one in so many tails hold are scored as whole rows
FIRST_NEIGHBOURS = 24

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SOLID = np.zeros(256, bool)  # bytes that cannot begin a white space character
_SOLID[33:127] = True
_SOLID[128:] = True
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_CLASS = np.zeros(256, np.uint8)  # ASCII letters, digits, signs; the apostrophe, which can begin a piece or not, is none
_CLASS[33:127] = 3
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[39] = 2, 1, 1, 0
_LATIN = bytes(range(0xCC))  # bytes of characters below U+0300, whose classes are the same in every version of Unicode
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids of texts, each distinct piece encoded once.

    A byte-level vocabulary never joins bytes across the last white space
    character before a visible one, so texts are cut there: before a space,
    which belongs to the word that follows, and on both sides of any other; also
    between ASCII letters, digits and signs, which it never joins either.

    New pieces of common scripts are encoded by `fast`, another implementation of
    byte-pair encoding over the same vocabulary. It joins whatever two
    neighbours make a token, not only the two of a merge; that is the same if
    every token is what the merges make of its own text, which is checked.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # one letter of a token stands for a byte
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.fast = _fast(path, self.tokenizer)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, self.kind)
        self.first = np.zeros(1 << 14, np.int64)  # of each piece in `flat`; one more entry than pieces

    def _learn(self, codes: list[int], pieces: list[bytes]) -> None:
        """Encode new pieces and remember their ids."""
        plain = [self.fast is not None and not p.translate(None, _LATIN) and p not in self.special for p in pieces]
        for fast in (True, False):
            own = [i for i, p in enumerate(plain) if p == fast]
            self._learn_alike([codes[i] for i in own], [pieces[i] for i in own], fast)

    def _ids(self, texts: list[str], fast: bool) -> list[list[int]]:
        if fast:
            return [self.fast.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_alike(self, codes: list[int], pieces: list[bytes], fast: bool) -> None:
        """Many at once where that cannot change them."""
        for part in range(0, len(codes), LEARN_PIECES):
            own = pieces[part : part + LEARN_PIECES]
            # A space with a visible character behind it begins a piece wherever it stands.
            joins = [len(p) > 1 and p[0] == 32 and bool(_SOLID[p[1]]) for p in own]
            order = [i for i, j in enumerate(joins) if j] + [i for i, j in enumerate(joins) if not j]
            n = sum(joins)
            texts = [b"".join(own[i] for i in order[:n])] + [own[i] for i in order[n:]]
            encoded = self._ids([t.decode("utf-8", "surrogatepass") for t in texts], fast)
            flat = np.array(encoded[0], np.int64)
            ends = np.searchsorted(np.cumsum(self.bytes_of[flat]), np.cumsum([len(own[i]) for i in order[:n]]), "left") + 1
            if n and (self.bytes_of[flat].sum() != len(texts[0]) or ends[-1] != len(flat)):
                raise ValueError("the vocabulary is not one of bytes")
            rest = encoded[1:]
            flat = np.concatenate((flat, np.fromiter(chain.from_iterable(rest), np.int64)))
            ends = np.concatenate((ends[:n], (ends[n - 1] if n else 0) + np.cumsum([len(r) for r in rest], dtype=np.int64)))
            row, used = len(self.known), int(self.first[len(self.known)])
            if row + len(ends) >= len(self.first):
                self.first = np.concatenate((self.first, np.zeros(len(self.first) + len(ends), np.int64)))
            if used + len(flat) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), len(flat)), self.kind)))
            self.first[row + 1 : row + 1 + len(ends)] = used + ends
            self.flat[used : used + len(flat)] = flat
            self.known.update(zip([codes[part + i] for i in order], range(row, row + len(ends))))

    def _set_apart(self, whole: bytes, begin: np.ndarray, mark: np.ndarray) -> None:
        """Make pieces of the vocabulary's own strings; white space before one ends the piece that it follows."""
        for token in self.special:
            at = whole.find(token)
            while at >= 0:
                start, blank = int(begin[np.searchsorted(begin, at, "right") - 1]), at
                while blank > start and _BLANK[whole[blank - 1]]:
                    blank -= 1
                mark[max(blank, start + 1) : at + len(token)] = False
                mark[at] = mark[at + len(token)] = True
                at = whole.find(token, at + len(token))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, without an end id."""
        held, size = [], 0
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            if held and size + len(raw) > CHUNK_BYTES:
                yield from self._encode(held)
                held, size = [], 0
            held.append(raw)
            size += len(raw)
        if held:
            yield from self._encode(held)

    def _encode(self, raw: list[bytes]) -> Iterator[np.ndarray]:
        if len(self.known) > CACHED_PIECES:
            self._forget()
        whole = b"".join(raw)
        begin = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        buf = np.frombuffer(whole, np.uint8)
        if not len(buf):
            yield from (np.zeros(0, self.kind) for _ in raw)
            return
        mark = np.zeros(len(buf) + 1, bool)
        mark[begin] = True
        last = np.flatnonzero(_BLANK[buf[:-1]] & _SOLID[buf[1:]] & ~mark[1:-1])  # not across texts
        mark[last] = mark[last[buf[last] != 32] + 1] = True
        kind = _CLASS[buf]
        mark[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] != 0) & (kind[:-1] != 0)
        self._set_apart(whole, begin, mark)
        cut = np.flatnonzero(mark[:-1])
        end = np.append(cut[1:], len(buf))
        coded = pa.array(span_hashes(buf, cut, end)).dictionary_encode()
        keys, piece = coded.dictionary.to_numpy().tolist(), coded.indices.to_numpy()
        where = np.zeros(len(keys), np.int64)
        where[piece] = np.arange(len(piece))
        new = [i for i, c in enumerate(keys) if c not in self.known]
        if new:
            self._learn([keys[i] for i in new], [
                whole[cut[where[i]] : end[where[i]]] for i in new])
        row = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        start, length = self.first[row][piece], (self.first[row + 1] - self.first[row])[piece]
        total = np.concatenate(([0], np.cumsum(length)))
        place = np.repeat(start - total[:-1], length)
        place += np.arange(len(place))
        ids = self.flat[place]
        of = total[np.searchsorted(cut, begin)]
        for a, b in zip(of[:-1], of[1:]):
            yield ids[a:b]


def _fast(path: str, tokenizer):
    """The same encoding by another library, or None if it may differ."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids: dict[str, int] = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [ids[a + b] for a, b in merges]
    if model.get("end_of_word_suffix") or any(a >= b for a, b in zip(made, made[1:])) or len(set(made)) < len(made):
        return None
    visible = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    letters = {chr(b): b for b in visible} | {
        chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    used = {*letters, *(a + b for a, b in merges)}
    if any([t.id for t in tokenizer.model.tokenize(token)] != [ids[token]] for token in used):
        return None
    ranks = {bytes(letters[c] for c in token): ids[token] for token in used}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenize(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in (whole.slice(i, BATCH_ROWS) for whole in batches for i in range(0, whole.num_rows, BATCH_ROWS)):
            tokens, sums, tails = [], [], []
            for ids in code.encode(batch.column(1).to_pylist()):
                ids = np.append(ids, code.kind(end_id))
                full = len(ids) // window
                tokens.append(len(ids))
                sums.append([checksum(ids[i * window : (i + 1) * window]) for i in range(full)])
                tails.append(ids[full * window :].astype("<u4").tobytes() if code.kind is np.uint32
                             else ids[full * window :].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(sums, pa.list_(pa.int64())),
                 pa.array(tails, pa.binary()), pa.array([code.kind().itemsize] * len(tokens), pa.int32())],
                ["doc_id", "tokens", "full", "tail", "width"])
    return run


def _raw_ids(tail: bytes, width: int) -> np.ndarray:
    return np.frombuffer(tail, "<u2" if width == 2 else "<u4")


def _ids(tail: bytes, width: int) -> np.ndarray:
    return _raw_ids(tail, width).astype(np.int64)


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, ascending, and how often each does."""
    ids = np.sort(ids)
    first = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    first = np.concatenate(([0], first)) if len(ids) else first
    return ids[first].astype(np.int64), np.diff(first, append=len(ids))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each token, and their number and ids as token -1."""
    total = np.zeros(1 << 16, np.int64)
    docs = ids_seen = 0
    for batch in batches:
        for tail, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = _raw_ids(tail, width)
            docs, ids_seen = docs + 1, ids_seen + len(ids)
            if len(ids):
                terms, _ = distinct(ids)
                if terms[-1] >= len(total):
                    total = np.concatenate((total, np.zeros(int(terms[-1]) + 1, np.int64)))
                total[terms] += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(([-1, -2], some))), pa.array(np.concatenate(([docs, ids_seen], total[some])))],
        ["token", "n"])


class Shard:
    """A BM25 inverted index over the tails of a shard."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, average: float):
        self.idf = idf
        self.tails = tails
        owner = np.repeat(np.arange(len(tails)), [len(t) for t in tails])
        flat = np.concatenate(tails) if tails else np.zeros(0, np.int64)
        key, count = np.unique(flat * len(tails) + owner, return_counts=True)
        self.term, self.doc = key // max(len(tails), 1), key % max(len(tails), 1)
        length = np.array([len(t) for t in tails], np.float64)
        norm = K1 * (1 - B + B * length / max(average, 1e-9))
        self.weight = idf[self.term] * count * (K1 + 1) / (count + norm[self.doc])
        self.bounds = np.arange(int(flat.max()) + 2 if len(flat) else 1)
        often = np.diff(np.searchsorted(self.term, self.bounds)) * COMMON_SHARE > len(tails)
        self.row = np.where(often, np.cumsum(often) - 1, -1)  # of each common term in `common`
        self.common = np.zeros((int(often.sum()), len(tails)))
        dense = often[self.term]
        self.common[self.row[self.term[dense]], self.doc[dense]] = self.weight[dense]
        self._keep(~dense)
        self.held = len(tails)

    def _keep(self, keep: np.ndarray) -> None:
        self.term, self.doc, self.weight = self.term[keep], self.doc[keep], self.weight[keep]
        self.first = np.searchsorted(self.term, self.bounds)

    def scores(self, seed: int, used: np.ndarray) -> np.ndarray:
        """What every unused tail scores for all terms of the seed."""
        unused = len(used) - np.count_nonzero(used)
        if unused * 2 < self.held:  # used tails leave the index from time to time
            self._keep(~used[self.doc])
            self.held = unused
        terms, _ = distinct(self.tails[seed])
        row = self.row[terms]
        rare = terms[row < 0]
        count = self.first[rare + 1] - self.first[rare]
        at = np.arange(count.sum()) + np.repeat(self.first[rare] - np.cumsum(count) + count, count)
        score = np.bincount(self.doc[at], self.weight[at], len(self.tails)).astype(np.float64)
        score += self.common[row[row >= 0]].sum(axis=0)
        score[used] = 0
        return score

    def ranking(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused tails that share a term with the seed, best first, equal ones in their order."""
        score = self.scores(seed, used)
        least = 0.0
        if len(score) > 2 * FIRST_NEIGHBOURS:
            least = np.partition(score, -FIRST_NEIGHBOURS)[-FIRST_NEIGHBOURS]
            if least > 0:
                best = np.flatnonzero(score >= least)
                yield from best[np.argsort(-score[best], kind="stable")].tolist()
                score[best] = 0
        yield from np.argsort(-score, kind="stable")[: np.count_nonzero(score)].tolist()


def fill(shard: Shard, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(tail, start in it, length, window number, offset) for every piece of every tail."""
    used = np.array([len(t) == 0 for t in shard.tails], bool)
    number, seed, at, follow = 0, -1, 0, 0
    while True:
        if seed < 0:
            while follow < len(used) and used[follow]:
                follow += 1
            if follow == len(used):
                return
            seed, at = follow, 0
            used[seed] = True
        room = window - (len(shard.tails[seed]) - at)
        yield seed, at, window - room, number, 0
        neighbours, next_seed, next_at = None, -1, 0
        while room:
            if neighbours is None:
                neighbours = shard.ranking(seed, used)
            best = next(neighbours, -1)
            if best < 0:
                while follow < len(used) and used[follow]:
                    follow += 1
                if follow == len(used):
                    break
                best = follow
            used[best] = True
            take = min(room, len(shard.tails[best]))
            yield best, 0, take, number, window - room
            room -= take
            if take < len(shard.tails[best]):
                next_seed, next_at = best, take
        number, seed, at = number + 1, next_seed, next_at


def content_keys(ids: np.ndarray, idf: np.ndarray, average: float, rarest: list[float]) -> list[int]:
    """The heaviest BM25 term of a tail among those of at most each given idf; -1 if it has none."""
    terms, count = distinct(ids)
    rarity = idf[terms]
    weight = rarity * count * (K1 + 1) / (count + K1 * (1 - B + B * len(ids) / max(average, 1e-9)))
    out = []
    for most in rarest:
        fit = rarity <= most
        out.append(int(terms[fit][weight[fit].argmax()]) if fit.any() else -1)
    return out


def _key(idf: np.ndarray, average: float, rarest: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [content_keys(_raw_ids(t, w), idf, average, rarest) for t, w in zip(
                batch.column("tail").to_pylist(), batch.column("width").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, pa.int64()) for c in (zip(*keys) if keys else [()] * len(rarest)))],
                [*batch.schema.names, "k1", "k2", "k3"])
    return run


_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _pack(idf: np.ndarray, average: float, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in whole_groups(batches, ["shard"], 1):
            doc, tokens = table["doc_id"].to_pylist(), table["tokens"].to_numpy()
            full, tails, widths = (table[c].to_pylist() for c in ("full", "tail", "width"))
            shards = table["shard"].to_numpy()
            for a, b in zip(begin[:-1], begin[1:]):
                own = [_ids(t, w) for t, w in zip(tails[a:b], widths[a:b])]
                base, rows, number = int(shards[a]) << 32, [], 0
                for i, start, length, number, offset in fill(Shard(own, idf, average), window):
                    piece = own[i][start : start + length]
                    rows.append((doc[a + i], len(full[a + i]) * window + start, length, checksum(piece),
                                 int(tokens[a + i]), base + number, offset))
                for i in range(a, b):
                    for k, crc in enumerate(full[i]):
                        number += 1
                        rows.append((doc[i], k * window, window, crc, int(tokens[i]), base + number, 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
         end_id: int = END_ID, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    `vocabulary` names a tokenizer file that every executor has. `doc_id` has
    to be a whole number. Every id of a document, the end id included, lies in
    exactly one piece.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tokens, tokens_path = write_table(rows.mapInArrow(
        _tokenize(vocabulary, window, end_id),
        "doc_id long, tokens long, full array<long>, tail binary, width int"), "tokens")
    counts = tokens.select("tail", "width").mapInArrow(_count_terms, "token long, n long").groupBy("token").agg(
        F.sum("n").alias("n")).toPandas()  # one row per entry of the vocabulary at most
    by = dict(zip(counts["token"].tolist(), counts["n"].tolist()))
    n, total = by.pop(-1, 0), by.pop(-2, 0)
    frequency = np.zeros(max(by, default=0) + 1)
    frequency[list(by)] = list(by.values())
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
    shards = max(1, -(-n // shard_docs))
    if shards > 1:
        bounds = [max(2.0, shard_docs / 2), max(2.0, shard_docs / 16), 2.0]  # the least document frequencies of the keys
        rarest = [float(np.log1p((n - least + 0.5) / (least + 0.5))) + 1e-9 for least in bounds]
        keyed = stored(tokens.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).mapInArrow(
            _key(idf, total / max(n, 1), rarest),
            "doc_id long, tokens long, full array<long>, tail binary, width int, tie long, k1 long, k2 long, k3 long"),
            "tokens-keyed")
        discard(docs.sparkSession, tokens_path)
        # Copies of one document differ in their tie.
        tokens = keyed.repartitionByRange(shards, "k1", "k2", "k3", "tie")
    else:
        tokens = tokens.repartition(1)
    dealt = tokens.withColumn("shard", F.spark_partition_id().cast("long"))
    return dealt.sortWithinPartitions("shard", "doc_id", "tokens").select(
        "shard", "doc_id", "tokens", "full", "tail", "width").mapInArrow(_pack(idf, total / max(n, 1), window), _PIECES)
