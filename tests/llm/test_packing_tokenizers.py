"""Packed ids are those of the tokenizer that was asked for."""

import public_tokenizers
import pytest

from stayrate.llm import packing, tokens

TEXTS = ["Hello  World, it's\n\tnot SHOUTED", "", None, "a b c <|endoftext|> d", "çé ÉCOLE 12 345", "tail spaces  ", "long " * 3000]


@pytest.mark.parametrize("name, shared", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_of_both_files(spark, name, shared):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    assert tokens.shares_parts(path) == shared
    made = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    found = {}
    for r in sorted(packing.pack(docs, tokenizer=path, with_ids=True).collect(), key=lambda r: (r["doc_id"], r["start"])):
        found.setdefault(r["doc_id"], []).extend(r["ids"])
    for i, text in enumerate(TEXTS):
        assert found[i] == [*made.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
