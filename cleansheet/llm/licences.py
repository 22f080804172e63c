"""Licence notices in documents: a trained paragraph classifier, confirmed by comparison with templates.

Lines are looked at, and runs of lines without a blank one between them, longer
ones in overlapping windows. What crosses a line feed counts where no line alone
has that notice. A
logistic regression over hashed word n-grams (one to three words) gives each
the probability of every licence family and of the class `unknown`. It is
trained here, on altered copies of the templates below and on paragraphs of a
bounded sample of the corpus that resemble none of them; a temperature fitted
on examples kept aside calibrates the probabilities. A prediction counts if its
calibrated probability is high enough and enough of the word pairs of one of
the family's templates stand in the paragraph. The words of a notice that has
been found are then left aside, and other families are looked for in what is
left of the window, against `unknown` only, so one window can have several.

A null or empty text has no notices, nor has a line without letters. Texts are
scanned whole. Rows that repeat are one row of the result; null ids stay null.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, joined, mix, ship, span_hashes, words

# How notices of each family are usually worded.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License", "Licensed under the MIT license", "This project is licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0", "Released under the Apache License 2.0",
        "This file is distributed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License"),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 2 or later", "Released under the GNU GPL v3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation"),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 3",
        "Released under the GNU LGPL v2.1", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3", "Released under the GNU AGPL v3",
        "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD": (
        "Licensed under the BSD 3-Clause License", "Released under the BSD 2-Clause License",
        "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0", "Released under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    "ISC": (
        "Released under the ISC License", "Licensed under the ISC license", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted"),
    "Unlicense": (
        "Released under the Unlicense", "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain"),
    "CC0": (
        "Dedicated to the public domain under CC0 1.0", "Licensed under CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0"),
    "CC-BY": (
        "Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0"),
}
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
# Words that stand near notices without being one.
STRAYS = ("licensed released under the terms of a version public general free software copy use source rights license "
          "work project file commons open 2.0 3.0 4.0").split()

BITS = 17
WINDOW, STRIDE = 48, 24
SLICE_WORDS = 1 << 14  # of windows that are classified at once
CHUNK_BYTES = 1 << 18
MAX_SAMPLE = 400
PROBABILITY, SIMILARITY = 0.5, 0.6

_ALNUM = np.zeros(256, bool)
for _span in ("0123456789", "abcdefghijklmnopqrstuvwxyz"):
    _ALNUM[[ord(c) for c in _span]] = True
_ALNUM[128:] = True


@dataclass
class Pieces:
    """Windows of lines of some texts: their words' hashes, first and last word, text, and bytes spanned."""

    code: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word_start: np.ndarray
    word_end: np.ndarray
    begin: np.ndarray

    def rows(self, a: int, b: int) -> Pieces:
        """The pieces from a to before b, over their own words only."""
        low, high = int(self.first[a:b].min()), int(self.last[a:b].max())
        return Pieces(self.code[low:high], self.first[a:b] - low, self.last[a:b] - low, self.text[a:b], self.start[a:b],
                      self.end[a:b], self.word_start[low:high], self.word_end[low:high], self.begin)

    def part(self, i: int, a: int, b: int) -> Pieces:
        """The words from a to before b as a piece of the text of piece i."""
        text = self.text[i : i + 1]
        return Pieces(self.code, np.array([a]), np.array([b]), text, self.word_start[[a]] - self.begin[text],
                      self.word_end[[b - 1]] - self.begin[text], self.word_start, self.word_end, self.begin)


def pieces(raw: list[bytes], across: bool = False) -> Pieces:
    """Windows of single lines, or those of runs of non-blank lines that cross a line feed."""
    buf, begin = joined(raw)
    low = LOWER[buf]
    start, end = words(np.where(_ALNUM[low], low, np.uint8(32)))
    line = np.concatenate(([0], np.cumsum(buf == 10)))[start]
    run = line
    if across:
        number = np.concatenate(([0], np.cumsum(buf == 10)))[:-1]
        blank = np.ones(number[-1] + 1 if len(number) else 1, bool)
        blank[number[(buf != 32) & ((buf < 9) | (buf > 13))]] = False
        run = np.cumsum(blank)[line] + np.searchsorted(begin, start, "right") * (len(blank) + 1)
    head = np.flatnonzero(np.diff(run, prepend=-1))
    size = np.diff(np.append(head, len(start)))
    count = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
    first = np.repeat(head, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    last = np.minimum(first + WINDOW, np.repeat(head + size, count))
    if across and len(first):
        crosses = line[first] < line[last - 1]
        first, last = first[crosses], last[crosses]
    text = np.searchsorted(begin, start[first], "right") - 1 if len(first) else np.zeros(0, np.int64)
    return Pieces(span_hashes(low, start, end), first, last, text,
                  start[first] - begin[text] if len(first) else first, end[last - 1] - begin[text] if len(first) else last,
                  start, end, begin)


def features(p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every piece, and the piece of each."""
    bucket, owner = [], []
    code = p.code
    for n in (1, 2, 3):
        gram = code.copy()
        for j in range(1, n):
            gram[:-j] = mix(gram[:-j] + code[j:] * np.uint64(2 * j + 1))
        size = np.maximum(p.last - p.first - n + 1, 0)
        at = np.repeat(p.first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        bucket.append((mix(gram[at] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
        owner.append(np.repeat(np.arange(len(size)), size))
    bucket, owner = np.concatenate(bucket), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


def pairs(p: Pieces, i: int) -> set[int]:
    """Word pairs of a piece (its word, if it has one only)."""
    code = p.code[p.first[i] : p.last[i]]
    return set((mix(code[:-1]) + code[1:]).tolist()) if len(code) > 1 else set(code.tolist())


def _templates() -> dict[str, list[set[int]]]:
    out = {}
    for family, texts in TEMPLATES.items():
        p = pieces([t.encode() for t in texts])
        out[family] = [pairs(p, i) for i in range(len(p.first))]
    return out


def similarity(own: set[int], templates: list[set[int]]) -> float:
    """The largest share of a template's word pairs that a piece holds."""
    return max(len(own & t) / len(t) for t in templates)


@dataclass
class Model:
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, bucket: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(FAMILIES)), np.float32)
        if len(owner):
            head = np.flatnonzero(np.diff(owner, prepend=-1))
            size = np.diff(np.append(head, len(owner)))
            out[owner[head]] = np.add.reduceat(self.weights[bucket], head, axis=0) / np.sqrt(size)[:, None]
        return out + self.bias

    def probabilities(self, p: Pieces) -> np.ndarray:
        """The chances of all families for every piece, a bounded number of words at a time."""
        upto = np.cumsum(p.last - p.first)
        out, a = [], 0
        while a < len(p.first):
            before = int(upto[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(upto, before + SLICE_WORDS, "right")))
            out.append(_softmax(self.logits(*features(p.rows(a, b)), b - a) / self.temperature))
            a = b
        return np.concatenate(out) if out else np.zeros((0, len(FAMILIES)), np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _examples(negatives: list[str], rng: np.random.RandomState, copies: int = 60) -> tuple[list[str], np.ndarray]:
    """Altered templates (words dropped, swapped, put into other prose) and paragraphs that are no notices."""
    filler = [w for t in negatives for w in t.split()] or ["text"]
    some = lambda n: [filler[i] for i in rng.randint(0, len(filler), n)]
    texts, labels = list(negatives), [len(FAMILIES) - 1] * len(negatives)
    for family, templates in enumerate(TEMPLATES.values()):
        for template in templates:
            for copy in range(copies):
                own = template.split()
                if copy % 3:
                    own = [w for w in own if rng.random_sample() > 0.08] or own
                if copy % 4 == 3:
                    own[rng.randint(len(own))] = some(1)[0]
                if copy % 2:
                    own = some(rng.randint(0, 12)) + own + some(rng.randint(0, 12))
                texts.append(" ".join(own))
                labels.append(family)
    for _ in range(20 * copies):
        mixed = [STRAYS[i] for i in rng.randint(0, len(STRAYS), rng.randint(1, 6))] + some(rng.randint(2, 20))
        rng.shuffle(mixed)
        texts.append(" ".join(mixed))
        labels.append(len(FAMILIES) - 1)
    return texts, np.array(labels)


def fit(negatives: list[str], *, epochs: int = 6, rate: float = 0.5, seed: int = 9) -> Model:
    """Weights by stochastic gradient descent (Adagrad), temperature by grid search on a fifth kept aside."""
    rng = np.random.RandomState(seed)
    texts, labels = _examples(negatives, rng)
    bags = []
    for text in texts:
        bucket, owner = features(p := pieces([text.replace("\n", " ").encode("utf-8", "surrogatepass")]))
        bags.append(bucket[owner == 0] if len(p.first) else bucket)
    aside = rng.random_sample(len(bags)) < 0.2
    model = Model(np.zeros((1 << BITS, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32))
    pace_w, pace_b = np.full((1 << BITS, len(FAMILIES)), 1e-3, np.float32), np.full(len(FAMILIES), 1e-3, np.float32)

    def flat(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate([bags[d] for d in docs]),
                np.repeat(np.arange(len(docs)), [len(bags[d]) for d in docs]))

    target = np.eye(len(FAMILIES), dtype=np.float32)
    learn, check = np.flatnonzero(~aside), np.flatnonzero(aside)
    for _ in range(epochs):
        rng.shuffle(learn)
        for part in range(0, len(learn), 64):
            docs = learn[part : part + 64]
            bucket, owner = flat(docs)
            error = (_softmax(model.logits(bucket, owner, len(docs))) - target[labels[docs]]) / len(docs)
            size = np.maximum(np.bincount(owner, minlength=len(docs)), 1)
            used, inverse = np.unique(bucket, return_inverse=True)
            slope = np.zeros((len(used), len(FAMILIES)), np.float32)
            np.add.at(slope, inverse, (error / np.sqrt(size)[:, None])[owner])
            slope += 1e-5 * model.weights[used]
            pace_w[used] += slope**2
            model.weights[used] -= rate * slope / np.sqrt(pace_w[used])
            bias = error.sum(0)
            pace_b += bias**2
            model.bias -= 0.1 * rate * bias / np.sqrt(pace_b)
    if len(check):
        logits = model.logits(*flat(check), len(check))
        losses = {t: -np.log(_softmax(logits / t)[np.arange(len(check)), labels[check]] + 1e-12).mean()
                  for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
        model.temperature = min(losses, key=losses.get)
    return model


def train(docs: DataFrame, *, text: str = "text", max_sample: int = MAX_SAMPLE) -> Model:
    """A model whose unknown class is learnt from lines of `max_sample` documents, those with the least text hash.

    Lines that resemble a template are left out.
    """
    rows = docs.select(F.col(text).alias("text")).where("text is not null")
    # Hashes are even, so four times the sample, at least nearly always, lie below this share of their range; no task
    # then holds more texts than it may have of them.
    share = min(1.0, (4 * max_sample + 100) / max(rows.count(), 1))
    few = rows.where(F.xxhash64("text") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    sample = few.orderBy(F.xxhash64("text"), F.xxhash64("text", F.lit(1))).limit(max_sample)
    line = sample.select(F.explode(F.split("text", "\n")).alias("line")).where(F.char_length("line") > 0)
    lines = [r["line"] for r in line.orderBy(F.xxhash64("line"), "line").limit(10 * max_sample).collect()]
    templates = [t for ts in _templates().values() for t in ts]
    negatives = []
    for text_ in lines:
        p = pieces([text_.encode("utf-8", "surrogatepass")])
        if len(p.first) and all(similarity(pairs(p, i), templates) < SIMILARITY for i in range(len(p.first))):
            negatives.append(" ".join(text_.split()[:WINDOW]))
    return fit(negatives)


class Finder:
    """All notices of a piece."""

    def __init__(self, model: Model, probability: float, similar: float):
        self.model, self.probability, self.similar = model, probability, similar
        self.templates = list(_templates().values())
        self.all = [np.array(sorted(set().union(*t)), np.uint64) for t in self.templates]
        codes, families = np.unique(np.concatenate(self.all), return_counts=True)
        self.only = [a[np.isin(a, codes[families == 1])] for a in self.all]

    def likely(self, chance: np.ndarray) -> np.ndarray:
        """Which families are more probable than `unknown`, by as much as a probability has to be."""
        known = chance[:, :-1]
        return known / (known + chance[:, -1:] + 1e-30) >= self.probability

    def notices(self, p: Pieces, i: int, chance: np.ndarray) -> list[tuple[int, int, int, float, float, bool]]:
        """(family, first word, end word, probability, similarity, main) of each; the main one is told by the whole piece."""
        own = pairs(p, i)
        like = [similarity(own, t) for t in self.templates]
        best = int(chance.argmax())
        if not (best < len(self.templates) and chance[best] >= self.probability and like[best] >= self.similar):
            fit = [f for f in np.flatnonzero(self.likely(chance[None])[0]).tolist()
                   if like[f] >= self.similar and not own.isdisjoint(self.only[f].tolist())]
            if not fit:
                return []
            best = max(fit, key=lambda f: (max(len(own & t) for t in self.templates[f] if len(own & t) >= self.similar * len(t)),
                                           chance[f]))
        a, b = int(p.first[i]), int(p.last[i])
        code = p.code[a:b]
        pair = mix(code[:-1]) + code[1:]
        free = np.ones(len(code), bool)

        def leave(family: int) -> np.ndarray:
            at = np.flatnonzero(np.isin(pair, self.all[family]))
            free[at] = free[at + 1] = False
            return at

        at = leave(best)
        out = [(best, a + int(at[0]), a + int(at[-1]) + 2, _against_unknown(chance, best), like[best], True)] if len(at) else [
            (best, a, b, _against_unknown(chance, best), like[best], True)]
        for family in np.argsort(-np.array(like), kind="stable").tolist():
            if family == best or like[family] < self.similar:
                continue
            at = np.flatnonzero(np.isin(pair, self.all[family]) & free[:-1] & free[1:])
            if not np.isin(pair[at], self.only[family]).any():
                continue
            runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
            run = max(runs, key=lambda r: (np.isin(pair[r], self.only[family]).sum(), len(r)))
            x, y = a + int(run[0]), a + int(run[-1]) + 2
            alone = self.model.probabilities(p.part(i, x, y))
            if int(alone[0, :-1].argmax()) == family and self.likely(alone)[0, family]:
                out.append((family, x, y, _against_unknown(alone[0], family), like[family], False))
                leave(family)
        return out


def _against_unknown(chance: np.ndarray, family: int) -> float:
    """The probability of a family, or against `unknown` alone where other families share it."""
    return float(max(chance[family], chance[family] / (chance[family] + chance[-1] + 1e-30))) if (
        chance[family] < PROBABILITY) else float(chance[family])


_FOUND = "doc_id long, family string, start long, end long, probability double, similarity double"


def _scan(model: Model, probability: float, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model, probability, similar)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for at, raw in chunks(texts, CHUNK_BYTES):
                held: dict[tuple[int, int], list[list]] = {}
                for across in (False, True):
                    p = pieces(raw, across)
                    if not len(p.first):
                        continue
                    chance = model.probabilities(p)
                    fresh: dict[tuple[int, int], list[list]] = {}
                    for i in np.flatnonzero(finder.likely(chance).any(1)):
                        text = int(p.text[i])
                        for family, x, y, chance_i, like, main in finder.notices(p, i, chance[i]):
                            if main and not across:
                                a, b = int(p.start[i]), int(p.end[i])
                            else:
                                a, b = int(p.word_start[x] - p.begin[text]), int(p.word_end[y - 1] - p.begin[text])
                            if across and any(a < h[1] and h[0] < b for h in held.get((text, family), ())):
                                continue
                            hits = fresh.setdefault((text, family), [])
                            old = hits[-1] if hits else None
                            if old and a < old[1]:  # the next window of the same line
                                old[:] = [min(a, old[0]), max(b, old[1]), max(old[2], chance_i), max(old[3], like)]
                            else:
                                hits.append([a, b, chance_i, like])
                    for key, hits in fresh.items():
                        held.setdefault(key, []).extend(hits)
                rows += [_row(ids[at + text], raw[text], family, hit) for (text, family), hits in held.items() for hit in hits]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in _FOUND.split(", ")])
    return run


def _row(doc: int | None, raw: bytes, family: int, hit: list) -> tuple:
    a, b, chance, like = hit
    start = len(raw[:a].decode("utf-8", "surrogatepass"))
    return (doc, FAMILIES[family], start, start + len(raw[a:b].decode("utf-8", "surrogatepass")), chance, like)


def find_notices(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text",
                 probability: float = PROBABILITY, similar: float = SIMILARITY) -> DataFrame:
    """(doc_id, family, start, end, probability, similarity) of every confirmed notice, in code points of the text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(_scan(model, probability, similar), _FOUND).distinct()
