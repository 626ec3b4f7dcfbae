"""Policy v3 keeps clean documents with a repeated short line or a few numbers, and rejects what is repeated or mostly digits."""

from stayrate.llm import quality
from stayrate.llm.queries import registered

WORDS = [f"{a}{b}ord" for a in "bcdfghjklm" for b in "aeiou"]
HEADER = "Read more on our page"
LINES = [" ".join(WORDS[i : i + 8]) for i in range(0, 48, 8)]


def test_policy_v3(spark):
    texts = {
        1: f"{HEADER}\n{' '.join(WORDS)}\n{HEADER}",
        2: "please call me back on +1 (372) 555-7739 or charge 9597024294303453 today or tomorrow",
        3: "\n".join([LINES[0]] + [x[:24] for x in [LINES[1]] * 5]),
        4: " ".join(f"w{10_000 + i}" for i in range(60)),
        5: "\n".join([*LINES, LINES[0], LINES[1], LINES[2]]),
    }
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    entries = quality.ledger(frame)
    of = {r["doc_id"]: r["failed"] for r in entries.collect()}
    assert of[1] & quality.BITS["duplicate_lines"] and of[2] & quality.BITS["digits"]
    assert not of[1] & quality.POLICIES["v3"] and not of[2] & quality.POLICIES["v3"]
    assert {r["doc_id"] for r in quality.reject(frame).collect()} == {1, 2}
    assert of[3] & quality.BITS["duplicate_text"] and of[4] & quality.BITS["many_digits"]
    assert of[5] & quality.BITS["duplicate_text"] and {r["doc_id"] for r in quality.reject(frame, "v2").collect()} == set()
    sizes = {r["doc_id"]: (r["line_chars"], r["dup_line_chars"]) for r in entries.collect()}
    assert sizes[1] == (2 * len(HEADER) + len(" ".join(WORDS)), len(HEADER))


def test_ledger_query_still_shows_v2(spark, data):
    rows = registered()["op5_quality_rules"](spark, data).select("failed", "kept").collect()
    assert all(r["kept"] == (r["failed"] == 0) and r["failed"] < 1024 for r in rows)
