"""Byte-pair encoding and decoding through an index of pair occurrences.

A task encodes the new pieces of many texts together. All their symbols
lie in one row of linked nodes, and an index maps the rank of every mergeable
pair to the places where it stands. The active ranks are applied in ascending
order: a rank's places are merged from left to right, and only the lists of the
pairs that a merge changes at its two sides are updated. A merge never makes a
pair of a lower rank, as long as every token comes from one merge, which is
checked when the vocabulary is read; so one pass over the ranks is complete,
and no pair is looked for twice.

The vocabulary is a `tokenizers` file with a byte-level BPE model with a
word-end suffix that cuts texts into lower-case pieces without white space, and
its path is a parameter. Common scripts are cut by the same rule here; words
with any other character go through the vocabulary's own normalizer and
pre-tokenizer. ASCII white space separates words before that, which changes
nothing, as it is never part of a piece. Added tokens inside a text become
their own ids, as the library does it.

A null or empty text has no ids. Texts of any length are read whole; what a
task holds is one batch of texts, `KNOWN_PIECES` and the pieces of a batch at
most. Both directions are functions of columns:
rows that repeat get equal results, and other columns do not matter.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import WHITESPACE, ship

KNOWN_PIECES = 300_000
BATCH_CHARS = 2 << 20
MANY = 24

# Below U+0300 nothing combines and letters, numbers and lower case are the same in every version of Unicode. Texts of
# such characters only are cut here; what holds any other goes through the vocabulary's own normalizer, word by word.
_LETTERS = "".join(chr(c) for c in range(0x300) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(chr(c) for c in range(0x300) if unicodedata.category(chr(c))[0] == "N")
_UNUSUAL = re.compile("[\x85\xa0\u0130\u0300-\U0010ffff]")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{WHITESPACE}{_LETTERS}{_NUMBERS}]+")
_WORD = re.compile(f"[^{WHITESPACE}]+")

# The byte-level alphabet: visible bytes stand for themselves, the others, in order, for the characters from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_BYTE_OF = {c: b for b, c in _ALPHABET.items()}

# How the word vocabulary cuts texts; see _PIECE.
_CUTTING = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "behavior": "Removed", "invert": True,
         "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Ranks(dict):
    """The rank of every mergeable pair; a pair of ids is one number."""

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int]):
        super().__init__((pair_code(a, b), r) for r, (a, b) in enumerate(pairs))
        self.left, self.right = [a for a, _ in pairs], [b for _, b in pairs]
        self.merged = merged
        self.codes = np.array(sorted(self), np.int64)
        self.of_code = np.array([self[c] for c in self.codes.tolist()], np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The ranks of many pairs, -1 for what cannot be merged."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.of_code[at], -1)


def pair_code(left: int, right: int) -> int:
    return left << 20 | right


class Vocabulary:
    """Ids, merges and pieces of a tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already fill the cores
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or (
                model.get("continuing_subword_prefix")):
            raise ValueError("only plain byte-level BPE is supported")
        if spec.get("decoder"):
            raise ValueError("tokens are joined by a space; decoders are not supported")
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        self.id_of: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens have to stand for themselves")
        self.cut_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.token = np.empty(whole.get_vocab_size(), object)
        for token, i in chain(self.id_of.items(), self.added.items()):
            self.token[i] = token
        texts = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merged = [self.id_of[a + b] for a, b in texts]
        self.rank = Ranks([(self.id_of[a], self.id_of[b]) for a, b in texts], merged)
        made = dict(zip(merged, range(len(merged))))
        if len(made) < len(merged) or any(
                r <= max(made.get(a, -1), made.get(b, -1)) for r, (a, b) in enumerate(zip(self.rank.left, self.rank.right))):
            raise ValueError("a token is made by two merges, or used before it is made")
        if {k: spec[k] for k in _CUTTING} != _CUTTING:
            raise ValueError("texts are cut in another way")

    def pieces(self, word: str) -> Iterator[bytes | int]:
        """What a word consists of: pieces, and ids of added tokens."""
        at = 0
        for found in self.cut_added.finditer(word) if self.cut_added else ():
            yield from self._plain(word[at : found.start()])
            yield self.added[found.group()]
            at = found.end()
        yield from self._plain(word[at:])

    def _plain(self, text: str) -> Iterator[bytes]:
        if text:
            for piece, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text)):
                yield piece.translate(_BYTE_OF).encode("latin-1")


class PairIndex:
    """Rows of symbols as one chain of nodes, and the places of every mergeable pair in it.

    `symbol` has the rows one after the other, a -1 behind each. Places with
    many entries are merged by array operations, the others one by one through
    views of the same arrays.
    """

    def __init__(self, symbol: np.ndarray, rank: Ranks):
        self.rank = rank
        self.symbol = symbol
        n = len(symbol)
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.views = memoryview(self.symbol), memoryview(self.after), memoryview(self.before)
        self.places: dict[int, list[int]] = {}
        self.active: list[int] = []
        codes = symbol[:-1] << 20 | symbol[1:]
        codes[(symbol[:-1] < 0) | (symbol[1:] < 0)] = -1
        self._add(codes, np.arange(n - 1))

    def _add(self, codes: np.ndarray, at: np.ndarray) -> None:
        """Enter the places of pairs, given as their codes; negative ones are none."""
        ranks = self.rank.find(codes)
        hit = np.flatnonzero(ranks >= 0)
        if not len(hit):
            return
        hit = hit[np.argsort(ranks[hit], kind="stable")]
        found, at = ranks[hit], at[hit].tolist()
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        for r, a, b in zip(found[first].tolist(), first.tolist(), [*first[1:].tolist(), len(found)]):
            self._extend(r, at[a:b])

    def _extend(self, r: int, at: list[int]) -> None:
        if r in self.places:
            self.places[r] += at
        else:
            self.places[r] = at
            heapq.heappush(self.active, r)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """Apply the active ranks in ascending order; the symbols left of all rows, and where each row ends among them."""
        while self.active:
            r = heapq.heappop(self.active)
            at = self.places.pop(r)
            if self.rank.left[r] == self.rank.right[r]:
                self._merge_few(r, sorted(at))  # places may overlap: the leftmost goes first
            elif len(at) < MANY:
                self._merge_few(r, at)
            else:
                self._merge_many(r, np.array(at))
        kept = self.symbol[self.symbol != -2]
        end = kept == -1
        return kept[~end], np.flatnonzero(end) - np.arange(int(end.sum()))

    def _merge_many(self, r: int, at: np.ndarray) -> None:
        """Two different symbols cannot overlap with the same two, so all places are merged at once."""
        symbol, after, before, merged = self.symbol, self.after, self.before, self.rank.merged[r]
        end = after[at]
        still = (symbol[at] == self.rank.left[r]) & (symbol[end] == self.rank.right[r])
        at, end = at[still], end[still]
        symbol[at], symbol[end] = merged, -2
        follow = after[end]
        after[at], before[follow] = follow, at
        first = before[at]
        right, left = symbol[follow], np.where(first >= 0, symbol[first], -1)
        self._add(np.concatenate((np.where(right >= 0, merged << 20 | right, -1), np.where(left >= 0, left << 20 | merged, -1))),
                  np.concatenate((at, first)))

    def _merge_few(self, r: int, places: list[int]) -> None:
        symbol, after, before = self.views
        left, right, merged, find = self.rank.left[r], self.rank.right[r], self.rank.merged[r], self.rank.get
        for at in places:
            end = after[at]
            if symbol[at] != left or symbol[end] != right:
                continue  # an earlier merge took one of the two
            symbol[at], symbol[end] = merged, -2
            after[at] = follow = after[end]
            before[follow] = at
            new = find(merged << 20 | symbol[follow])
            if new is not None:
                self._extend(new, [at])
            first = before[at]
            new = find(symbol[first] << 20 | merged) if first >= 0 else None
            if new is not None:
                self._extend(new, [first])


class Encoder:
    """Ids of texts; pieces met of late are not encoded again."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        letters = [chr(_ALPHABET.get(b, b)) for b in range(256)]
        self.inner = np.array([v.id_of[c] for c in letters])
        self.final = np.array([v.id_of[c + v.suffix] for c in letters])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[object, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 14, np.int64)  # of each piece in `flat`; one more entry than pieces

    def _cut(self, text: str | None) -> list:
        """The pieces of a text, as they stand in lower case; an unusual word is a piece of its own, as a tuple."""
        if not text:
            return []
        if "<|" not in text and (text.isascii() or not _UNUSUAL.search(text)):
            return _PIECE.findall(text.lower())
        out: list = []
        for word in _WORD.findall(text):
            if "<|" in word or _UNUSUAL.search(word):
                out.append((word,))
            else:
                out.extend(_PIECE.findall(word.lower()))
        return out

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pieces, and where each ends among them."""
        raw = np.frombuffer(b"\n".join([*pieces, b""]), np.uint8)  # no piece holds a line feed
        end = np.flatnonzero(raw == 10)
        symbol = self.inner[raw]
        symbol[end[1:] - 1] = self.final[raw[end[1:] - 1]]
        symbol[end[0] - 1] = self.final[raw[end[0] - 1]]
        symbol[end] = -1
        return PairIndex(symbol, self.vocabulary.rank).merge()

    def _learn(self, new: list) -> None:
        plain = [p for p in new if isinstance(p, str)]
        pieces = [p.encode() for p in plain]
        odd = {w: list(self.vocabulary.pieces(w[0])) for w in new if not isinstance(w, str)}
        pieces += [p for parts in odd.values() for p in parts if isinstance(p, bytes)]
        flat, ends = self.merged(pieces) if pieces else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if odd:
            flat, ends = self._with_odd(flat, ends, len(plain), list(odd.values()))
        row, used = len(self.known), int(self.first[len(self.known)])
        while row + len(ends) >= len(self.first):
            self.first = np.concatenate((self.first, np.zeros(len(self.first), np.int64)))
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.int32)))
        self.first[row + 1 : row + 1 + len(ends)] = used + ends
        self.flat[used : used + len(flat)] = flat
        self.known.update(zip(chain(plain, odd), range(row, row + len(ends))))

    @staticmethod
    def _with_odd(flat: np.ndarray, ends: np.ndarray, n: int, words: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Join the pieces of each unusual word, which come after `n` others, with the ids of its added tokens."""
        begin = int(ends[n - 1]) if n else 0
        ids, stops = [flat[:begin]], []
        at, total = begin, begin
        places = iter(ends[n:].tolist())
        for parts in words:
            for part in parts:
                if isinstance(part, bytes):
                    to = next(places)
                    ids.append(flat[at:to])
                    at = to
                else:
                    ids.append(np.array([part]))
                total += len(ids[-1])
            stops.append(total)
        return np.concatenate(ids), np.concatenate((ends[:n], np.array(stops, np.int64)))

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        held: list[list] = []
        size = 0
        for text in texts:
            held.append(self._cut(text))
            size += len(text or "")
            if size >= BATCH_CHARS:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[list]) -> Iterator[np.ndarray]:
        if len(self.known) > KNOWN_PIECES:
            self._forget()
        new = set().union(*texts).difference(self.known)
        if new:
            self._learn(list(new))
        for pieces in texts:
            row = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
            start, length = self.first[row], self.first[row + 1] - self.first[row]
            end = np.cumsum(length)
            yield self.flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + length, length)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """The token ids of whole texts, without special tokens that the model would add."""
    ship(spark)

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        rows = list(encoder(vocabulary).encode(t.as_py() for t in column))
        ends = np.cumsum([0, *map(len, rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))

    return ids(text)


def decode(spark: SparkSession, ids: Column, vocabulary: str) -> Column:
    """The tokens of the ids joined by a space; special tokens stay, null and unknown ids go, no ids give an empty text."""
    ship(spark)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        token = encoder(vocabulary).vocabulary.token
        texts = []
        for row in column:
            own = np.zeros(0, np.int64) if row.values is None else row.values.drop_null().to_numpy(zero_copy_only=False)
            own = own[(own >= 0) & (own < len(token))]
            texts.append(" ".join(filter(None, token[own])))
        return pa.array(texts, pa.string())

    return text(ids)
