"""Scoring texts with prediction by partial matching, learnt from the rest of the corpus.

The model is a trie of byte contexts of up to five bytes. A symbol is coded in the
longest context that has been seen; if it never followed there, an escape is
paid (as often as the context has distinct followers) and the next shorter
context is asked, without the symbols that the longer one has already ruled
out. Below the empty context all symbols that were never seen are alike.

With fixed counts the excluded mass is a property of the context, because all
followers of a context follow its suffix too. So the trie is a table: counts of
runs of six bytes are gathered by Spark from every training text, and scoring looks
runs up, a whole array at a time.

The tables grow with the corpus and reach the tasks in parts: runs are dealt by
the last two bytes of their context, words by their hash, and one pass over the
texts is made for each part of a bounded number of entries. A document's parts
are summed at the end.

On top of the trie, a text's own past is a context of its own (twelve bytes,
one follower, the last one seen), so repeats inside a text are cheap. It learns
from what has been read only, so the score stays a probability.

The base score is that of a word unigram model with add-one smoothing.

A null text is empty: it has one token, the end. Null ids are trained on and
scored like others. Rows that repeat are scored, and learnt from, as often as
they occur. Other columns are ignored. Without training texts all symbols are
alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, discard, mix, powers, ship, span_hashes, words, write_table

ORDER = 5
LOCAL, LOCAL_ESCAPE = 12, 6  # bytes of a text's own context; its follower is right 5 times in 6 at first
END, START, SYMBOLS = 0xFF, 0xFE, 256  # neither byte occurs in UTF-8
PART_ENTRIES = 2_000_000
CHUNK = 1 << 20
HELD_KEYS = 2_000_000
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def held_out(doc_id: Column) -> Column:
    """The split of the corpus: documents that the model may not learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def symbols(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, each behind five start symbols and followed by the end, and where each begins."""
    pad = bytes([START]) * ORDER
    buf = np.frombuffer(b"".join(pad + r + bytes([END]) for r in raw), np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(r) + ORDER + 1 for r in raw]))).astype(np.int64)
    return LOWER[buf], begin


def runs(buf: np.ndarray) -> np.ndarray:
    """The run of a context and its follower that ends at each place, as one number."""
    out = np.zeros(len(buf) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        out = (out << np.uint64(8)) | buf[k : k + len(out)]
    return out


def _is_coded(buf: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Places of runs whose last byte is a symbol of a text, not padding."""
    coded = np.ones(len(buf), bool)
    for k in range(ORDER):
        coded[begin[:-1] + k] = False
    return coded[ORDER:]


class _Tally:
    """Counts of keys, merged now and then, so that a task holds a bounded number."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.parts) > 1:
            key = np.concatenate([k for k, _ in self.parts])
            order = np.argsort(key, kind="stable")
            key, count = key[order], np.concatenate([c for _, c in self.parts])[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            self.parts = [(key[first], np.add.reduceat(count, first))]
            self.size = len(first)
        return self.parts[0]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): counts of runs (kind 0), of words (1), and of texts (2)."""
    tallies, texts = (_Tally(), _Tally()), 0

    def out(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n)],
            ["kind", "key", "n"])

    for batch in batches:
        for _, raw in chunks(batch.column(0).to_pylist(), CHUNK):
            buf, begin = symbols(raw)
            texts += len(raw)
            tallies[0].add(runs(buf)[_is_coded(buf, begin)])
            start, end = token_spans(buf)
            tallies[1].add(span_hashes(buf, start, end))
            for kind, tally in enumerate(tallies):
                if tally.size > HELD_KEYS:
                    key, n = tally.merged()
                    if len(key) > HELD_KEYS // 2:
                        yield out(kind, key, n)
                        tallies[kind].parts, tallies[kind].size = [], 0
    for kind, tally in enumerate(tallies):
        yield out(kind, *tally.merged())
    yield out(2, np.zeros(1, np.uint64), np.array([texts]))


def token_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words between white space and the symbols around texts."""
    spaced = np.where(buf >= START, np.uint8(10), buf)
    return words(spaced)


class Lookup:
    """Places of 64-bit keys in a table, found for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        code = mix(keys)
        self.order = np.argsort(code)
        self.code = np.append(code[self.order], np.uint64(0xFFFFFFFFFFFFFFFF))
        bits = max(1, int(np.ceil(np.log2(len(keys) + 1))))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(
            self.code[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key in the order of `code`, or -1."""
        code = mix(keys)
        at = self.first[code >> self.shift]
        behind = np.flatnonzero(self.code[at] < code)
        while len(behind):
            at[behind] += 1
            behind = behind[self.code[at[behind]] < code[behind]]
        at[(self.code[at] != code) | (at == len(self.code) - 1)] = -1
        return at


def _mask(length: int) -> np.uint64:
    return np.uint64((1 << (8 * length)) - 1)


def _sum_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def _key(run: np.ndarray, length: int, full: int) -> np.ndarray:
    """One number for a context or a run of some length: the same for no two of them but by a 64-bit coincidence."""
    return mix(run + np.uint64((2 * length + full + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


class Trie:
    """One part of the model: the contexts whose last two bytes belong to it, and all shorter ones.

    In the longest contexts followers have their counts; in a shorter one a
    follower counts once for each context one byte longer in which it has been
    seen (update exclusion). A follower of count c has the chance (2c - 1) / 2N
    and an escape that of d / 2N, where N and d are the sum of the counts and
    the number of the followers that are not excluded.
    """

    def __init__(self, longest: np.ndarray, n: np.ndarray, two: np.ndarray, n_two: np.ndarray):
        """From counts of the part's longest runs, and of the three-byte runs of the corpus that end in each two-byte run."""
        grams = {ORDER: _sum_by(longest, n)}
        for k in range(ORDER - 1, 1, -1):
            longer = grams[k + 1][0] & _mask(k + 1)
            grams[k] = _sum_by(longer, np.ones(len(longer), np.int64))
        grams[1] = _sum_by(two, n_two)
        grams[0] = _sum_by(grams[1][0] & _mask(1), np.ones(len(two), np.int64))
        self.alphabet = SYMBOLS - len(grams[0][0])
        contexts, columns, keys, values = {}, [], [], []
        for k in range(ORDER + 1):
            gram, count = grams[k]
            context = gram >> np.uint64(8)
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(gram) else np.zeros(
                0, np.int64)
            context = context[first]
            total = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
            kinds = np.diff(np.append(first, len(gram)))
            contexts[k] = (context, total, kinds)
            escape, room = np.log10(kinds / (2 * total)), np.log10(2 * total)
            if k:
                shorter, n_shorter = grams[k - 1]
                same = n_shorter[np.searchsorted(shorter, gram & _mask(k))]
                excluded = np.add.reduceat(same, first) if len(first) else np.zeros(0, np.int64)
                parent = np.searchsorted(contexts[k - 1][0], context & _mask(k - 1))
                left_n = contexts[k - 1][1][parent] - excluded
                left_kinds = contexts[k - 1][2][parent] - kinds
                after = np.log10(np.maximum(2 * left_n, 1))
                pass_on = np.where(left_kinds == 0, 0.0, np.log10(np.maximum(left_kinds, 1)) - after)
            else:
                after, pass_on = np.zeros(len(context)), np.zeros(len(context))
            columns.append((_key(context, k, 0), escape, room, pass_on, after))
            value = np.log10(2 * count - 1)
            if k == ORDER:
                value = value - np.repeat(room, kinds)
            keys.append(_key(gram, k, 1))
            values.append(value)
        self.grams = Lookup(np.concatenate(keys))
        self.value = np.append(np.concatenate(values)[self.grams.order], 0).astype(np.float32)
        self.contexts = Lookup(np.concatenate([c[0] for c in columns]))
        self.escape, self.room, self.pass_on, self.after = (
            np.append(np.concatenate([c[i] for c in columns])[self.contexts.order], 0).astype(np.float32)
            for i in range(1, 5))
        self.grams.order = self.contexts.order = None

    def log10(self, run: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each run after the others."""
        row = self.grams.find(_key(run, ORDER, 1))
        score = self.value[row].astype(np.float64)
        open_ = np.flatnonzero(row < 0)
        left = run[open_]
        total = np.zeros(len(open_))
        above = np.full(len(open_), -1, np.int64)
        for k in range(ORDER, -1, -1):
            if not len(open_):
                break
            gram = left & _mask(k + 1)
            context = self.contexts.find(_key(gram >> np.uint64(8), k, 0))
            found = self.grams.find(_key(gram, k, 1))
            seen, first = context >= 0, above < 0
            done = found >= 0
            room = np.where(first, self.room[context], self.after[above])
            score[open_[done]] = total[done] + self.value[found[done]] - room[done]
            total += np.where(seen, np.where(first, self.escape[context], self.pass_on[above]), 0)
            above = np.where(seen, context, -1)
            keep = ~done
            open_, left, total, above = open_[keep], left[keep], total[keep], above[keep]
        score[open_] = total - np.where(above >= 0, np.log10(max(self.alphabet, 1)), np.log10(SYMBOLS))
        return score


def repeats(buf: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose last LOCAL bytes stood earlier in the same text, with the byte that followed there last, and how often.

    Only what comes before a place is used, so a text's own past is one more,
    longest, context of the trie, with a single follower.
    """
    size = len(buf) - LOCAL
    if size <= 0:
        return (np.zeros(0, np.int64),) * 3
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(buf.astype(np.uint64) * powers(_BASE, len(buf)), out=total[1:])
    code = (total[LOCAL:-1] - total[: size]) * powers(_BASE_BACK, len(buf))[:size]
    text = np.searchsorted(begin, np.arange(LOCAL, len(buf)), "right") - 1
    code = mix(code + text.astype(np.uint64) * _BASE)
    # Sorted together with their places, which is faster than a stable sort; the low bits that this costs are compared after.
    bits = np.uint64(int(size).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    own = np.flatnonzero(np.arange(size) >= begin[text])
    key = np.sort((code[own] & ~low) | own.astype(np.uint64))
    place = (key & low).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = code[place[1:]] != code[place[:-1]]
    same = np.flatnonzero(~new)
    first = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
    return place[same] + LOCAL, buf[place[same - 1] + LOCAL], same - first[same]


def local_terms(trie: Trie, buf: np.ndarray, begin: np.ndarray, run: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """What a text's own past changes about the log10 score of each run that is `mine`.

    Where the local context foresees the right byte, the trie's term is
    replaced; where it fails, an escape is paid and the trie's chances are
    shared out among the other bytes.
    """
    at, foreseen, often = repeats(buf, begin)
    term = np.zeros(len(run))
    right = buf[at] == foreseen
    at, often = at - ORDER, LOCAL_ESCAPE * often
    own = mine[at]
    at, foreseen, often, right = at[own], foreseen[own], often[own], right[own]
    hit, miss = at[right], at[~right]
    term[hit] = np.log10(1 - 1 / often[right]) - trie.log10(run[hit])
    wrong = (run[miss] & ~_mask(1)) | foreseen[~right].astype(np.uint64)
    term[miss] = -np.log10(often[~right]) - np.log10(np.maximum(1 - 10 ** trie.log10(wrong), 1e-9))
    return term


def part_of(run: np.ndarray, parts: int) -> np.ndarray:
    """The part that holds a run: by the last two bytes of its context."""
    return (((run >> np.uint64(8)) & _mask(2)) * np.uint64(40503) >> np.uint64(5)) % np.uint64(parts)


_SCORED = ("doc string, version long, pass int, tokens long, known long, words double, bytes double")


def _score(part: int, parts: int, shared, ends: int, total: int, distinct: int):
    rest = np.log10(total + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, look, count = shared.value
        for batch in batches:
            for at, raw in chunks(batch.column(2).to_pylist(), CHUNK):
                buf, begin = symbols(raw)
                n = len(raw)
                run_ = runs(buf)
                mine = _is_coded(buf, begin)
                if parts > 1:  # a wrong byte in place of the right one stays in the part, which follows from the context
                    mine &= part_of(run_, parts) == part
                place = np.flatnonzero(mine)
                owner = np.searchsorted(begin, place + ORDER, "right") - 1
                local = local_terms(trie, buf, begin, run_, mine)
                run_ = run_[place]
                coded = np.bincount(owner, trie.log10(run_) + local[place], n)
                start, end = token_spans(buf)
                code = span_hashes(buf, start, end)
                owner = np.searchsorted(begin, start, "right") - 1
                if parts > 1:
                    mine = code % np.uint64(parts) == part
                    code, owner = code[mine], owner[mine]
                row = look.find(code)
                hit = row >= 0
                tokens, known = np.bincount(owner, minlength=n), np.bincount(owner, hit, n).astype(np.int64)
                base = np.bincount(owner, np.log10(np.where(hit, count[row], 0) + 1) - rest, n)
                if part == 0:
                    tokens, known, base = tokens + 1, known + (ends > 0), base + np.log10(ends + 1) - rest
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(np.full(n, part, np.int32)),
                     pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base.astype(np.float64)),
                     pa.array(coded.astype(np.float64))],
                    ["doc", "version", "pass", "tokens", "known", "words", "bytes"])
    return run


def _column(df: DataFrame, *names: str) -> list[np.ndarray]:
    """A bounded part of the model as arrays."""
    table = df.select(*names).toArrow()
    return [table[n].to_numpy() for n in names]


def score_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                    part_entries: int = PART_ENTRIES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the documents outside the held-out split.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    counted = rows.where(~held_out(F.col("doc"))).select("text").mapInArrow(
        _gather, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    model, path = write_table(counted, "ppm-counts")
    sizes = {r["kind"]: r for r in model.groupBy("kind").agg(F.count("*").alias("keys"), F.sum("n").alias("n")).collect()}
    n_of = lambda kind, what: int(sizes[kind][what]) if kind in sizes else 0
    ends = n_of(2, "n")
    total, distinct = n_of(1, "n") + ends, n_of(1, "keys") + (ends > 0)
    parts = max(1, -(-max(n_of(0, "keys"), n_of(1, "keys")) // part_entries))
    tail = lambda name, bits: F.col(name).bitwiseAND(F.lit((1 << bits) - 1))
    three = model.where("kind = 0").select(tail("key", 24).alias("three")).distinct()
    two, n_two = _column(three.groupBy(tail("three", 16).alias("key")).agg(F.count("*").alias("n")), "key", "n")
    scored = None
    shares = []
    for part in range(parts):
        shared = spark.sparkContext.broadcast(_part(model, part, parts, two, n_two))
        own = rows.select(F.col("doc").cast("string").alias("doc"),
                          F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text")
        done, place = write_table(own.mapInArrow(_score(part, parts, shared, ends, total, distinct), _SCORED), "ppm-pass")
        shared.destroy()
        shares.append(place)
        scored = done if scored is None else scored.unionByName(done)
    discard(spark, path)
    kind = docs.schema[doc_id].dataType
    one_pass = F.count(F.when(F.col("pass") == 0, 1))
    result = scored.groupBy("doc", "version").agg(
        one_pass.alias("copies"), *(F.sum(c).alias(c) for c in ("tokens", "known", "words", "bytes")))
    result = result.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return result.select(
        F.col("doc").cast(kind).alias("doc_id"), held_out(F.col("doc")).alias("held_out"),
        (F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("words") / F.col("copies")).alias("base_score"),
        (F.col("bytes") / F.col("copies")).alias("score"))


def _part(model: DataFrame, part: int, parts: int, two: np.ndarray, n_two: np.ndarray) -> tuple[Trie, Lookup, np.ndarray]:
    """The trie, the words and their counts of one part."""
    six, n_six = _column(model.where("kind = 0").where(_mine(part, parts)), "key", "n")
    trie = Trie(six.view(np.uint64), n_six, two.view(np.uint64), n_two)
    del six, n_six
    word, n_word = _column(
        model.where("kind = 1").where(F.pmod("key", F.lit(parts)) == _signed(part, parts)), "key", "n")
    look = Lookup(word.view(np.uint64))
    count = np.append(n_word[look.order], 0)
    look.order = None
    return trie, look, count


def _signed(part: int, parts: int) -> Column:
    """The remainder that Spark sees for keys whose unsigned value has remainder `part`."""
    return F.when(F.col("key") >= 0, F.lit(part)).otherwise(F.lit((part - (1 << 64)) % parts))


def _mine(part: int, parts: int) -> Column:
    """The same parts as part_of, for stored runs."""
    context = F.shiftright(F.col("key"), 8).bitwiseAND(F.lit(0xFFFF))
    return F.shiftright(context * 40503, 5) % parts == part
