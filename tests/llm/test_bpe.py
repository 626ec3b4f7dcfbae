"""Encoding and decoding by the table of distinct words against the tokenizer itself."""

import hashlib
import random

import pytest

from stayrate.llm import bpe, queries

ODD = [
    None, "", " ", "\n\t ", "Hello World, it's fine", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "<|endoftext", "a<|b|>c",
    "café café ÉCOLE İstanbul ſharp Å ﬁn", "你好 안녕 \U0001F600a \U0001F468‍\U0001F469", "a b \u0085  c　d",
    "각 ́x 1١² 12345", "don't DON'T 'S ''s 'rea we'll", "#$%&*|<> </w> </w>", " `Ω", "×÷ a×b", "ǅ ŉn",
    "ȩ́", "a\x00b \x7f \x1c\x1d", "word " * 30_000, "y" * 50_000, "ßẞ", "ò́ ᾳ", "ends with space ",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path(None))


def plain(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))


def run(spark, monkeypatch, rows, more=False):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    if more:
        df = df.selectExpr("*", "'x' as word", "1 as n", "array(7) as ids", "'z' as __id", "2 as token")
    monkeypatch.setattr(queries, "table", lambda s, d, n: df)
    got = queries.op12_bpe_words(spark, "")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("words", [bpe.LEXICON_WORDS, 6, 0])
def test_query_equals_tokenizer(spark, monkeypatch, tokenizer, words):
    monkeypatch.setattr(bpe, "LEXICON_WORDS", words)
    rng = random.Random(8)
    texts = ODD + [" ".join(rng.choice([t or "" for t in ODD[:20]]) for _ in range(rng.randrange(9))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "again one"), (1, "again two"), (None, "no id"), (None, "no id"), (None, None), (5, texts[5])]
    assert run(spark, monkeypatch, rows, more=words == 6) == sorted(((i, *plain(tokenizer, t)) for i, t in rows), key=str)


def test_lexicon_keeps_to_its_bytes(spark, monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "LEXICON_BYTES", 40)
    monkeypatch.setattr(bpe, "LEXICON_LONGEST", 3)
    rows = [(i, "of the longer words the of the") for i in range(5)]
    assert run(spark, monkeypatch, rows) == sorted(((i, *plain(tokenizer, t)) for i, t in rows), key=str)


def test_empty_table(spark, monkeypatch):
    assert run(spark, monkeypatch, []) == []


def test_ids_and_text_themselves(spark, tokenizer):
    text = "Packed, not SHOUTED: café <|endoftext|>"
    row = bpe.encode(spark.createDataFrame([("k", text)], "name string, body string"), id_col="name", text_col="body").first()
    made = tokenizer.encode(text, add_special_tokens=False).ids
    assert row["ids"] == " ".join(map(str, made)) and row["decoded"] == tokenizer.decode(made, skip_special_tokens=False)


def test_whole_table(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op12_bpe_words(spark, data).collect())
    assert got == sorted((r["doc_id"], *plain(tokenizer, r["text"])) for r in docs)


def test_other_tokenizers_are_refused(spark):
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), public_tokenizers.path("byte_bpe_50k.json"))
