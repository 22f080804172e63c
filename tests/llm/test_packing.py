import random
import zlib

import numpy as np
import odd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cleansheet.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, pieces, window):
    """Every id lies in one piece, sequences have no gaps, and the checksums are those of the ids."""
    wanted = sorted((d is not None, d or 0, len(ids_of(t))) for d, t in rows)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    texts = {}
    for d, t in rows:
        texts.setdefault((d, len(ids_of(t))), []).append(ids_of(t))
    assert set(texts) == set(by_doc)
    for key, own in by_doc.items():
        copies = len(texts[key])
        cover = np.zeros(key[1], int)
        for p in own:
            part = slice(p["start"], p["start"] + p["length"])
            cover[part] += 1
            sums = {zlib.crc32(np.array(t[part], "<u4").tobytes()) for t in texts[key]}
            assert p["ids_crc32"] in sums and p["length"] > 0
        assert (cover == copies).all()
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    return sum(w[2] for w in wanted), len(sequences)


@pytest.mark.parametrize("window", [64, 1024])
def test_pieces_rebuild_the_documents(spark, window):
    rows = [r for r in odd.texts() if r[0] != 14]
    pieces = packing.pack(odd.frame(spark, rows), PATH, window=window).collect()
    tokens, sequences = check(rows, pieces, window)
    assert sequences == -(-tokens // window)  # only the last window of the shard has padding


def test_several_shards(spark):
    rows = [(d, odd.prose(d, 20 + d % 50)) for d in range(200)]
    pieces = packing.pack(odd.frame(spark, rows), PATH, window=128, shard_docs=20).collect()
    tokens, sequences = check(rows, pieces, 128)
    assert sequences <= tokens / 128 + 10


def test_empty_table(spark):
    assert packing.pack(odd.frame(spark, []), PATH).count() == 0


def test_neighbours_share_a_window():
    rng = np.random.RandomState(1)
    topics = [rng.randint(t * 100 + 1, t * 100 + 100, (8, 30)) for t in range(6)]
    tails = [t for group in zip(*topics) for t in group]  # topics alternate
    idf = np.ones(700)
    windows = {}
    for doc, _, _, window, _ in packing.fill(packing.Shard(list(tails), idf, 30.0), 120):
        windows.setdefault(window, []).append(doc % 6)
    assert sum(len(set(w)) == 1 for w in windows.values()) >= len(windows) - 2


def test_neighbours_of_many_shards_share_a_window(spark):
    own = [" ".join(odd.prose(7000 + t, 12).split()) for t in range(40)]
    rng = random.Random(6)
    rows = []
    for d in range(200):
        words = own[d % 40].split()
        rng.shuffle(words)
        rows.append((d, " ".join(words)))
    windows = {}
    for p in packing.pack(odd.frame(spark, rows), PATH, window=128, shard_docs=20).collect():
        windows.setdefault(p["sequence_id"], []).append((p["doc_id"], p["length"]))
    together = sum(n for w in windows.values() for d, n in w if any(e % 40 == d % 40 and e != d for e, _ in w))
    assert together >= 0.8 * sum(n for w in windows.values() for _, n in w)


def test_all_terms_of_the_seed_count():
    common, rare = np.arange(1, 41), np.arange(100, 140)  # the seed has more rare terms than were once asked for
    tails = [np.concatenate((common, rare)), np.arange(200, 240), np.arange(300, 340), common.copy()]
    idf = np.ones(400)
    idf[:41] = 0.5
    shard = packing.Shard(tails, idf, 50.0)
    assert list(shard.ranking(0, np.array([True, False, False, False]))) == [3]


def test_scores_against_plain_sums():
    rng = np.random.RandomState(3)
    tails = [rng.randint(0, 60 if i % 2 else 900, rng.randint(1, 80)) for i in range(150)]
    idf = rng.rand(900) + 0.1
    shard = packing.Shard([t.astype(np.int64) for t in tails], idf, 40.0)
    assert len(shard.common) and (shard.row < 0).any()
    used = np.zeros(150, bool)
    for seed in range(0, 150, 7):
        used[seed] = True
        if seed == 77:
            used[::2] = True
        expected = np.zeros(150)
        for d, tail in enumerate(tails):
            for term in set(tails[seed].tolist()) & set(tail.tolist()):
                n = int((tail == term).sum())
                expected[d] += idf[term] * n * (packing.K1 + 1) / (
                    n + packing.K1 * (1 - packing.B + packing.B * len(tail) / 40.0))
        expected[used] = 0
        assert shard.scores(seed, used.copy()) == pytest.approx(expected)
        order = list(shard.ranking(seed, used.copy()))
        assert sorted(order) == np.flatnonzero(expected).tolist()
        assert (np.diff(shard.scores(seed, used.copy())[order]) <= 1e-9).all()


def test_encoder_agrees_with_the_tokenizer():
    rng = random.Random(2)
    alphabet = "ab é'\n\t    s1.!9日\x1f 　 \x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["I'll they've x's", "a <|endoftext|> b", "a  <|endoftext|>b", "<|endoftext|>", "\t <|endoftext|><|endoftext|>  \n", "x<|endoftext|", None, "", odd.LONG]
    texts += ["Hey,you(there)42x_y don't'so 'tis x'1'y a.b.c 3.14e-5 #tag @me e-mail\t\tC++ naïve,été!œ…ſ ǆ'x ¿qué?ª1²3"]
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "0123456789.,;:!?'\"()[]{}<>/|#$%&*+-=_@~^ " * 2 + "éüßñçœ"
    texts += ["".join(rng.choice(mixed) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice("etaoinshrdlu ") for _ in range(300)) for _ in range(200)]
    assert packing.Encoder(PATH).fast is not None
    for text, ids in zip(texts, packing.Encoder(PATH).encode(texts)):
        assert ids.tolist() + [0] == ids_of(text), repr(text)


def test_a_large_batch_is_encoded_in_parts():
    """A task holds the texts and ids of some rows, not of a whole batch."""
    rows = [(i, f"text {i} " * (i % 7)) for i in range(2 * packing.BATCH_ROWS + 5)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "text": t} for d, t in rows])
    parts = list(packing._tokenize(PATH, 8, 0)(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [packing.BATCH_ROWS, packing.BATCH_ROWS, 5]
    found = [(r["doc_id"], r["tokens"]) for p in parts for r in p.to_pylist()]
    assert found == [(d, len(ids_of(t))) for d, t in rows]
