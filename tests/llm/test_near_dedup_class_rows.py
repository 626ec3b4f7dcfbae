"""In the last step a class learns its group as one row, not once for each of its shingles."""

from test_near_dedup_last_step import _brute_force, _texts

from stayrate.llm import near_dedup


def test_groups_are_told_once_per_class(spark, monkeypatch):
    regrouped, most = near_dedup._regrouped, []

    def watched(rows, stars):
        most.append(max(r["count"] for r in rows.groupBy("id").count().collect()))
        return regrouped(rows, stars)

    monkeypatch.setattr(near_dedup, "_regrouped", watched)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "SPARSE", 0)
    monkeypatch.setattr(near_dedup, "LEADERS", 2)
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(docs).collect()}
    assert {i: c if c is not None else i for i, c in found.items()} == _brute_force(texts)
    assert most and set(most) == {1}
