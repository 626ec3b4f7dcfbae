"""Texts of the fingerprint query move once; repeated and missing ids, null texts and empty tables have a result."""

import hashlib

from stayrate.llm import queries


def result(spark, monkeypatch, rows, more=()):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = df.selectExpr("*", *more) if more else df
    monkeypatch.setattr(queries, "table", lambda s, d, n: df)
    return queries.op2_document_fingerprints(spark, "")


def test_one_exchange_of_texts(spark, data):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries.op2_document_fingerprints(spark, data)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("partial_first(text") == 1, plan
    assert sum("ReusedExchange [id#" in line and "first#" in line for line in plan.splitlines()) == 1, plan


def test_repeated_and_missing_ids(spark, monkeypatch):
    rows = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "delta epsilon zeta"), (None, "no id here"), (0, "no id here"), (3, None), (4, "")]
    got = result(spark, monkeypatch, rows, ["'x' as text_", "1 as id", "2 as mark", "3 as copies"]).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted(
        (i is not None, i or 0, len(t or "")) for i, t in rows
    )
    alike = {r["fingerprint"] for r in got if r["n_chars"] == 0}
    assert len(alike) == 1
    empty = [r for r in got if r["n_chars"] == 0]
    assert {r["edited_sha256"] for r in empty} == {hashlib.sha256(b"").hexdigest()}
    same = [r for r in got if r["doc_id"] == 1 and r["n_chars"] == 16]
    assert len(same) == 2 and len({r["fingerprint"] for r in same}) == 1
    # the first of two copies is followed by the other one, so its end is replaced by its own start
    assert hashlib.sha256(b"alpha beta alpha").hexdigest() in {r["edited_sha256"] for r in same}


def test_empty_table(spark, monkeypatch):
    assert result(spark, monkeypatch, []).collect() == []
