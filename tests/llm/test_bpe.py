import os
import random

import pytest

from tidemark.llm import bpe

FOLDER = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
PATH = f"{FOLDER}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


@pytest.fixture(scope="module")
def known():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


TEXTS = [
    "", " ", "  \n\n\t x  y\r\n", "It's the company's 12,345.67% café — naïve", "<|endoftext|> text <|endoftext|>", "a" * 3000, "ab" * 2500,
    "的" * 900 + "。", "日本語のテキスト、句読点。", "​­﻿ x", "\U0001f469‍\U0001f4bc\U0001f468\U0001f3fd", "é", "\x00\x01\x7f",
    "".join(chr(0x4E00 + (i * 7919) % 20000) for i in range(800)), "don't we'll I'm they've 'S 'Re", "x = {\n    'a': [1, 2]\n}", "   wide",
]


def test_ids_equal_those_of_the_library(spark, known):
    texts = [*TEXTS, *TEXTS[:5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS ids", "1 AS word").repartition(3)
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df, "doc_id", "text", PATH).collect()}
    assert got == {i: known(t) for i, t in enumerate(texts)}


def test_null_and_empty_texts_and_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.ids) for r in bpe.encode_corpus(df, "doc_id", "text", PATH).collect())
    assert got == [(0, [64]), (1, []), (2, []), (2, [])]
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_random_bytes_and_small_pieces(known, monkeypatch):
    monkeypatch.setattr(bpe, "ROWS_PER_QUERY", 400)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 50)
    rnd = random.Random(4)
    alphabet = "aeiou tnshrd'   \n.,0123éßøñжшαβ漢字́\U0001f600"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(300))) for _ in range(120)] + ["antidisestablishmentarianism" * 30]
    e = bpe.Encoder(PATH)
    for k in range(0, len(texts), 11):
        assert e.encode(texts[k : k + 11]).to_pylist() == [known(t) for t in texts[k : k + 11]]
