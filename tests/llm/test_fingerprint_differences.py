"""The digests that peeling recovers, for texts of any length, and the parts that it leaves."""

import pytest
from pyspark.sql import functions as F

from stayrate.llm import fingerprint


def long_text(n, start=0):
    return " ".join(f"w{start + i}" for i in range(n))


PAIRS = [
    ("", ""), ("a", ""), ("x\ny\nz", "x\nz\nq"),
    (long_text(200), long_text(200, 7)), (long_text(500), long_text(500, 100_000)),
    (long_text(20_000), long_text(20_000, 100_000)), (long_text(40_000), long_text(24_000, 160)),
    (long_text(40_000), "\n".join([long_text(20_000), "new", long_text(20_000, 20_000)])), (long_text(30_000), "one"),
]


@pytest.fixture(scope="module")
def rows(spark):
    c = F.col
    frame = spark.createDataFrame(PAIRS, "a string, b string").repartition(8)
    frame = frame.select(fingerprint.digests(c("a")).alias("a"), fingerprint.digests(c("b")).alias("b"))
    frame = frame.select("*", fingerprint.sketch(c("a")).alias("x"), fingerprint.sketch(c("b")).alias("y"))
    cells = fingerprint.subtracted(c("x"), c("y"))
    return frame.select(
        "a", "b",
        fingerprint.differences(c("a"), c("b"), c("x"), c("y")).alias("d"),
        fingerprint.likeness(c("a"), c("b"), c("x"), c("y")).alias("like"),
        fingerprint.dealt(c("a"), c("b"), cells).alias("dealt"),
    ).collect()


def test_differences_are_recovered_with_their_side(rows):
    assert len(rows) == len(PAIRS)
    for r in rows:
        a, b = set(r["a"]), set(r["b"])
        want = sorted([(d, 1) for d in a - b] + [(d, -1) for d in b - a])
        assert sorted((d["digest"], d["side"]) for d in r["d"]) == want
        assert r["like"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_no_part_of_a_long_text_is_left_unpeeled(rows):
    assert max(len(r["a"]) for r in rows) >= 2_500
    assert [len(r["dealt"]["open"]) for r in rows] == [0] * len(rows)
    for r in rows:
        assert len(r["dealt"]["found"]) == len(set(r["a"]) ^ set(r["b"]))
