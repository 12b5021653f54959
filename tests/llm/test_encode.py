import random

import pytest

from geotrail.llm.encode import Decoder, default_vocabulary, load_encoder, token_ids
from geotrail.llm.registry import p6_ids


@pytest.fixture(scope="module")
def encoder():
    return load_encoder(default_vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_odd_texts_against_the_library(encoder, library):
    g = random.Random(1)
    signs = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(g.choice(signs) for _ in range(40)) for _ in range(400)]
    texts += ["".join(g.choice("aabcdefghi tTnr'ls") for _ in range(200)) for _ in range(300)]
    texts += ["a" * 5000, " " * 3000 + "x", "\n\n\t x", "<|endoftext|> it's we'll", "\x1c\x1d\x85", "漢字" * 400, "0123456789" * 300, "👩‍👩‍👧", "﻿x"]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == library(t), t[:60]
        assert Decoder(encoder).decode(ids) == t


def test_table_rows_against_the_library_and_back(spark, data, encoder, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in p6_ids(spark, data).collect()}
    assert got == {k: library(t) if t else [] for k, t in texts.items()}
    assert all(Decoder(encoder).decode(got[k]) == (t or "") for k, t in texts.items())


def test_nulls_repeats_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "k"), (1, "", "k"), (None, "a b", "k"), (2, "a b", "k"), (2, "a b", "k")], "doc_id bigint, text string, key string")
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in token_ids(df, "doc_id", "text").collect()), key=str)
    assert got == [(0, [64, 275]), (1, []), (1, []), (2, [64, 275]), (2, [64, 275])]
    empty = token_ids(df.limit(0), "doc_id", "text")
    assert empty.count() == 0 and empty.columns == ["doc_id", "ids"]
