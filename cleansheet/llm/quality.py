"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is described by
numbers taken from its characters and words, encoded by a small layer, and
weighted by gated attention; the weighted sum of the encodings is scored. Only
document labels are known when it learns, so the attention finds out which
passages matter.

Fitting uses a bounded sample of labelled documents (`max_docs`, those with
the least hash of the id); scoring reads every text whole. A null, empty or
blank text is a bag of one empty passage. Labels that are null do not count;
a document labelled several times has the mean of its labels. Without any
labels every score is 0.5. Neither ids nor other columns enter a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, joined, mix, ship, span_hashes, words

PASSAGE_WORDS = 64
MAX_DOCS = 20_000
THRESHOLD = 0.7

# Groups of ASCII characters whose shares describe a passage.
GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".", ",;:", "!?", "#$%&*+=<>^~",
          "|\\/_", "@", "\n", "'\"`()[]{}-")
_GROUP = np.zeros((len(GROUPS) + 1, 256), bool)
for _g, _chars in enumerate(GROUPS):
    _GROUP[_g, [ord(c) for c in _chars]] = True
_GROUP[-1, 128:] = True
FEATURES = len(GROUPS) + 1 + 12


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages and the number of passages of each text."""
    rows, counts = [], []
    for _, raw in chunks(texts):
        x, n = _describe(raw)
        rows.append(x)
        counts.append(n)
    return (np.concatenate(rows) if rows else np.zeros((0, FEATURES), np.float32),
            np.concatenate(counts) if counts else np.zeros(0, np.int64))


def _describe(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf, begin = joined(raw)
    start, end = words(buf)
    first = np.searchsorted(start, begin)
    n_words = np.diff(first)
    n_passages = np.maximum(-(-n_words // PASSAGE_WORDS), 1)
    head = np.concatenate(([0], np.cumsum(n_passages)))
    x = np.zeros((head[-1], FEATURES), np.float32)
    if not len(start):
        return x, n_passages
    doc = np.repeat(np.arange(len(raw)), n_words)
    inside = np.arange(len(start)) - first[doc]
    passage = head[doc] + inside // PASSAGE_WORDS
    lead = np.flatnonzero(np.diff(passage, prepend=-1))
    at = passage[lead]
    last = np.append(lead[1:], len(start)) - 1
    n = (last - lead + 1).astype(np.float64)
    a, b = start[lead], np.minimum(end[last] + 1, len(buf))
    width = (b - a).astype(np.float64)
    for g in range(len(_GROUP)):
        total = np.concatenate(([0], np.cumsum(_GROUP[g][buf], dtype=np.int64)))
        x[at, g] = (total[b] - total[a]) / width
    code = span_hashes(buf, start, end)
    size = (end - start).astype(np.float64)
    same = np.zeros(len(start))
    same[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    near = np.zeros(len(start))
    near[2:] = (code[2:] == code[:-2]) & (doc[2:] == doc[:-2])
    upper = _GROUP[0][buf[start]]
    shout = upper & _GROUP[0][buf[np.maximum(end - 1, start)]]
    punct = ~(_GROUP[0] | _GROUP[1] | _GROUP[2] | _GROUP[-1])[buf[end - 1]]

    def per_passage(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float64), lead) / n

    def distinct(owner: np.ndarray) -> np.ndarray:
        _, index = np.unique(code ^ mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True)
        fresh = np.zeros(len(code))
        fresh[index] = 1
        return fresh

    mean = per_passage(size)
    new_in_doc = distinct(doc)
    of_doc = np.bincount(doc, new_in_doc, len(raw)) / np.maximum(n_words, 1)
    g = len(_GROUP)
    for k, values in enumerate((
            np.log(mean), np.sqrt(np.maximum(per_passage(size**2) - mean**2, 0)) / mean, per_passage(same),
            per_passage(near), per_passage(distinct(passage)), per_passage(new_in_doc), of_doc[doc[lead]],
            per_passage(upper), per_passage(shout), per_passage(punct), np.log1p(n),
            np.log1p(n_words[doc[lead]]))):
        x[at, g + k] = values
    return x, n_passages


@dataclass
class Model:
    """Weights of the network; `mean` and `scale` bring features to one size."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
        bag = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ w["encode"] + w["encode0"])
        tanh = np.tanh(h @ w["value"] + w["value0"])
        gate = 1 / (1 + np.exp(-(h @ w["gate"] + w["gate0"])))
        e = (tanh * gate) @ w["attend"]
        e = np.exp(e - np.maximum.reduceat(e, begin)[bag])
        attention = e / np.add.reduceat(e, begin)[bag]
        z = np.add.reduceat(attention[:, None] * h, begin, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out0"], -40, 40)))
        return {"h": h, "tanh": tanh, "gate": gate, "attention": attention, "z": z, "score": score, "bag": bag,
                "begin": begin}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x, counts = passages(texts)
        if not self.weights or not len(counts):
            return np.full(len(texts), 0.5)
        return self.forward((x - self.mean) / self.scale, counts)["score"].astype(np.float64)


def fit(x: np.ndarray, counts: np.ndarray, label: np.ndarray, *, hidden: int = 24, attention: int = 8, epochs: int = 25,
        batch: int = 128, rate: float = 0.01, decay: float = 1e-5, seed: int = 5) -> Model:
    """Weights by gradient descent (Adam) on the log loss of document labels."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    rng = np.random.RandomState(seed)
    model = Model(mean, scale)
    shapes = {"encode": (FEATURES, hidden), "encode0": (hidden,), "value": (hidden, attention), "value0": (attention,),
              "gate": (hidden, attention), "gate0": (attention,), "attend": (attention,), "out": (hidden,), "out0": ()}
    w = model.weights = {k: (rng.randn(*s) / np.sqrt(s[0]) if s and not k.endswith("0") else np.zeros(s)).astype(
        np.float64) for k, s in shapes.items()}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    x = (x - mean) / scale
    begin = np.concatenate(([0], np.cumsum(counts)))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(counts))
        for part in range(0, len(order), batch):
            docs = order[part : part + batch]
            rows = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
            grads = _gradients(model, x[rows], counts[docs], label[docs])
            step += 1
            pace = rate * (1 - epoch / epochs)
            for k, g in grads.items():
                g = g + decay * w[k]
                m, v = moment[k] = 0.9 * moment[k][0] + 0.1 * g, 0.999 * moment[k][1] + 0.001 * g * g
                w[k] = w[k] - pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def _gradients(model: Model, x: np.ndarray, counts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    w, f = model.weights, model.forward(x, counts)
    h, tanh, gate, attention, bag = f["h"], f["tanh"], f["gate"], f["attention"], f["bag"]
    d_logit = (f["score"] - label) / len(counts)
    d_z = d_logit[:, None] * w["out"]
    d_h = attention[:, None] * d_z[bag]
    d_attention = (h * d_z[bag]).sum(1)
    d_e = attention * (d_attention - np.add.reduceat(attention * d_attention, f["begin"])[bag])
    d_mixed = d_e[:, None] * w["attend"]
    d_value, d_gate = d_mixed * gate * (1 - tanh**2), d_mixed * tanh * gate * (1 - gate)
    d_h = (d_h + d_value @ w["value"].T + d_gate @ w["gate"].T) * (1 - h**2)
    return {"out": f["z"].T @ d_logit, "out0": d_logit.sum(), "attend": (tanh * gate).T @ d_e,
            "value": h.T @ d_value, "value0": d_value.sum(0), "gate": h.T @ d_gate, "gate0": d_gate.sum(0),
            "encode": x.T @ d_h, "encode0": d_h.sum(0)}


def held_out(doc_id: Column) -> Column:
    """The split of the corpus: documents no label may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          max_docs: int = MAX_DOCS) -> Model:
    """A model from the labelled documents outside the held-out split, `max_docs` of them at most."""
    ship(docs.sparkSession)
    marked = labels.select(F.col(doc_id).alias("doc"), F.col(label).cast("double").alias("y")).where(
        "doc is not null and y is not null").where(~held_out(F.col("doc")))
    sample = marked.groupBy("doc").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("doc"), "doc").limit(max_docs)
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(F.broadcast(sample), "doc")

    def describe(batches):
        for batch in batches:
            x, n = passages(batch.column("text").to_pylist())
            cut = np.concatenate(([0], np.cumsum(n)))
            yield pa.RecordBatch.from_arrays([batch.column("doc").cast(pa.string()), batch.column("y"), pa.array(
                [x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["doc", "y", "x"])

    bags = rows.select("doc", "y", "text").mapInArrow(describe, "doc string, y double, x binary").toPandas()
    if not len(bags):
        return Model(np.zeros(FEATURES), np.ones(FEATURES))
    bags = bags.sort_values(["doc", "x"])
    parts = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in bags["x"]]
    return fit(np.concatenate(parts), np.array([len(p) for p in parts]), bags["y"].to_numpy())


def score(text: Column, model: Model) -> Column:
    """The probability that a text is good, as a column."""
    ship(SparkSession.active())

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts.to_pylist()), pa.float64())

    return of(text)


def reject_poor(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                threshold: float = THRESHOLD, **rules) -> DataFrame:
    """The documents that score at least `threshold`; all columns stay.

    Without a usable label nothing is learnt, and all documents stay.
    """
    model = train(docs, labels, doc_id=doc_id, text=text, **rules)
    return docs.where(score(F.col(text), model) >= threshold) if model.weights else docs
