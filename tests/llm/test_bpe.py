import hashlib

import pytest

from tidemark.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    "Hello  World's!! 123", "Éá ﬁ <|endoftext|> a<|startoftext|>b", "", "   ", "\xa0x　y\u0085z\x1cq İI ß ΑΣ ΟΔΟΣ", "a\x00b﻿c 日本 ½ ²",
    "<|ENDOFTEXT|>", "don't DON'T we'll 'S's", "<|endoftext|><|endoftext|>x", "é x" * 50, "🙂🙂 ok 𝒳", "x" * 3000,
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.definition(public_tokenizers.path("word_bpe_49k.json"))


def test_equals_the_library(vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ours = bpe.WordBpe(vocabulary)
    for text in TEXTS:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    assert ours.encode(None) == []


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    ours = bpe.WordBpe(vocabulary)
    text = " ".join(f"word{i}abc" for i in range(300))
    whole = ours.encode(text)
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 5)
    assert bpe.WordBpe(vocabulary).encode(text) == whole


def test_rows(spark, vocabulary):
    rows = [(1, "a b", "ids"), (1, "a b", "ids"), (None, None, None), (3, "", "x"), (4, "word " * 100_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    found = bpe.encode(docs, vocabulary).collect()
    assert sorted((str(r.row.doc_id), len(r.ids), len(r.decoded)) for r in found) == [
        ("1", 2, 11), ("1", 2, 11), ("3", 0, 0), ("4", 100_000, 900_000 - 1), ("None", 0, 0)
    ]
    digests = {r.row.doc_id: r for r in bpe.digests(docs, vocabulary).collect()}
    for r in found:
        d = digests[r.row.doc_id]
        assert d.n_tokens == len(r.ids)
        assert d.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0
