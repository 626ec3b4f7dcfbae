"""op2 over the small tables equals a version in plain Python."""

import hashlib
import re

import pytest

from stayrate.llm.queries import registered

PIECE = re.compile(r"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,16}")


def pieces(text):
    return {p.rstrip(" ") for p in PIECE.findall(text)}


def like(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_texts_and_likenesses(spark, data):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert len({i for i, _ in docs}) == len(docs) and all(i is not None for i, _ in docs)
    docs.sort(key=lambda x: -x[0])
    want = {}
    for (i, own), (_, lent) in zip(docs, docs[1:] + docs[:1]):
        third = len(own) // 3
        edited = own[: len(own) - third] + lent[:third]
        want[i] = (len(own), hashlib.sha256(edited.encode()).hexdigest(), like(own, edited), like(own, lent))
    rows = registered()["op2_document_fingerprints"](spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, sha, near_edited, near_next = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(near_edited), pytest.approx(near_next))
