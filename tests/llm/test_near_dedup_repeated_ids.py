"""Rows that repeat an id with different texts are compared and dropped each on its own."""

from stayrate.llm import near_dedup

A = " ".join(f"a{i}" for i in range(60))
B = " ".join(f"b{i}" for i in range(60))
C = " ".join(f"c{i}" for i in range(60))
NEAR_B = B.replace("b59", "zz")
ROWS = [(3, A), (7, A), (7, B), (9, NEAR_B), (7, ""), (4, C), (4, C + " more"), (4, C), (11, A + " end"), (5, B.upper()), (None, A), (None, None)]


def test_each_text_of_an_id(spark):
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    left = sorted(((str(r["doc_id"]), r["text"]) for r in near_dedup.keep_one(frame).collect()), key=str)
    some = [x for x in left if x[0] != "4"]
    assert some == sorted([("3", A), ("5", B.upper()), ("7", ""), ("None", A), ("None", None)], key=str)
    fours = [t for i, t in left if i == "4"]
    assert fours in ([C, C], [C + " more"])  # one text of the group of id 4, with its copies


def test_texts_of_an_id_that_are_not_alike_stay(spark):
    frame = spark.createDataFrame([(1, A), (1, B), (1, C), (2, C), (3, B)], "doc_id bigint, text string")
    assert sorted((r[0], r[1]) for r in near_dedup.keep_one(frame).collect()) == [(1, A), (1, B), (1, C)]
    got = sorted(tuple(r) for r in near_dedup.groups(frame).collect())
    assert got == [(1, 56, 1, True)] * 3 + [(2, 56, 1, False), (3, 56, 1, False)]


def test_rows_without_an_id_are_shown(spark):
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    got = [tuple(r) for r in near_dedup.groups(frame, null_ids=True).where("doc_id is null").collect()]
    assert sorted(got, key=str) == sorted([(None, 56, None, True), (None, 0, None, True)], key=str)
