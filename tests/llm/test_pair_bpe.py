import hashlib
import random

import odd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cleansheet.llm import pair_bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [
    None, "", " ", "\n\t ", "a", "A", "aaaaaaa", "aaaa aaa aa a", "it's we'll I'M don't 's", "x" * 5000, "ab" * 3000 + "!!!",
    "Straße İstanbul ΣΊΣΥΦΟΣ ǅ ﬁ ½ ² Ⅷ", "é ́a ọ̈", "日本語 テキスト 한국어 가", "👍🏽👨‍👩‍👧 ☃", "a b c　d\x85e",
    "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|startoftext|>", "<|ENDOFTEXT|> <|endoftext| >", "1234567 12,5 3.14", "\x00\x1c\x1f\x7f",
    "foo\x0bbar\x0cbaz\r\nqux", "﻿bom ​zero‍width", "café<|endoftext|>́x", "...!!!???", "Å ẛ̣ ̈́",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def same(texts, library):
    got = [ids.tolist() for ids in pair_bpe.encoder(PATH).encode(texts)]
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for t, g, e in zip(texts, got, expected, strict=True):
        assert g == e, t
    return got


def test_awkward_texts(library):
    same(AWKWARD, library)


def test_random_strings(library):
    rng = random.Random(9)
    letters = "aabcdeé'stlvm 19.!\n\t́ßΣ<|endoftext|>日한 "
    same(["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)], library)
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    same(["".join(chr(c) for c in rng.choices(points, k=40)) for _ in range(500)], library)


def test_words_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(pair_bpe, "KNOWN_PIECES", 100)
    monkeypatch.setattr(pair_bpe, "BATCH_CHARS", 200)
    same([odd.prose(i, 20) for i in range(100)], library)


def test_merges_against_repeated_search(monkeypatch):
    """Every row alone, always the pair of the least rank, leftmost first."""
    code = pair_bpe.encoder(PATH)
    rank = code.vocabulary.rank
    rng = random.Random(5)
    pieces = ["".join(rng.choices("aaehinorst", k=rng.randint(1, 40))).encode() for _ in range(300)] + [b"a" * 33, b"e"]

    def plain(piece):
        row = [*code.inner[list(piece[:-1])].tolist(), int(code.final[piece[-1]])]
        while True:
            codes = [pair_bpe.pair_code(*p) for p in zip(row, row[1:])]
            ranks = [(rank[c], i) for i, c in enumerate(codes) if c in rank]
            if not ranks:
                return row
            r, i = min(ranks)
            row[i : i + 2] = [rank.merged[r]]

    expected = [plain(p) for p in pieces]
    for many in (1, 24, 10**9):
        monkeypatch.setattr(pair_bpe, "MANY", many)
        flat, ends = code.merged(pieces)
        assert [flat[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == expected


def test_columns(spark, library):
    df = odd.frame(spark, odd.texts() + [(100 + i, t) for i, t in enumerate(AWKWARD)])
    out = df.select("doc_id", "text", pair_bpe.encode(spark, F.col("text"), PATH).alias("ids"))
    out = out.withColumn("back", pair_bpe.decode(spark, F.col("ids"), PATH))
    rows = out.collect()
    assert len(rows) == len(odd.texts()) + len(AWKWARD)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["back"] == library.decode(ids, skip_special_tokens=False)
    assert out.limit(0).count() == 0


def test_ids_that_do_not_exist(spark):
    df = spark.createDataFrame([([1, None, -5, 10**6],), (None,), ([],)], "ids array<int>")
    got = [r[0] for r in df.select(pair_bpe.decode(spark, F.col("ids"), PATH)).collect()]
    assert got == ['"', "", ""]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, library, size):
    folder = f"/root/testdata/{size}"
    got = {r["doc_id"]: r for r in queries.op13_pair_bpe(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids)
        assert mine["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert mine["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pair_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
