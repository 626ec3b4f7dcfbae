"""One encoder per worker process: later tasks find what earlier ones learnt, with the same ids."""

import pyarrow as pa
from pyspark.sql import functions as F

from stayrate.llm import packing, tokens

TEXTS = ["Fix the race condition, don't wait.", "", None, "żółw 12 <|x|> über", "the the race"]


def test_later_tasks_find_the_words_of_earlier_ones():
    first = tokens.encoder(None)
    ids = [list(x) for x in first.encode(pa.array(TEXTS))]
    known = dict(first.words)
    again = tokens.encoder(None)
    assert again is first and set(known) <= set(again.words)
    assert [list(x) for x in again.encode(pa.array(TEXTS))] == ids
    assert [list(x) for x in tokens.Encoder(None).encode(pa.array(TEXTS))] == ids


def test_emptied_memory_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 2)
    kept = tokens.Encoder(None)
    ids = [[list(x) for x in kept.encode(pa.array(TEXTS))] for _ in range(3)]
    assert ids[0] == ids[1] == ids[2]


def test_pieces_do_not_depend_on_earlier_tasks(spark):
    rows = spark.createDataFrame([(i, TEXTS[i % 5]) for i in range(40)], "doc_id bigint, text string")
    pieces = [packing.pack(rows.repartition(n, "doc_id")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).orderBy("doc_id").collect() for n in (1, 16)]
    assert pieces[0] == pieces[1]
