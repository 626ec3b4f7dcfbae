"""The last step chooses prefixes once, and its rounds look at crowded keys only."""

from test_near_dedup_last_step import _brute_force, _texts

from stayrate.llm import near_dedup


def test_prefixes_are_chosen_once(spark, monkeypatch):
    prefixes, rounds, calls = near_dedup._prefixes, near_dedup._leader_pairs, []
    monkeypatch.setattr(near_dedup, "_prefixes", lambda *a: calls.append("prefixes") or prefixes(*a))
    monkeypatch.setattr(near_dedup, "_leader_pairs", lambda *a: calls.append("round") or rounds(*a))
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "SPARSE", 0)
    monkeypatch.setattr(near_dedup, "LEADERS", 2)
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(docs).collect()}
    assert {i: c if c is not None else i for i, c in found.items()} == _brute_force(texts)
    assert calls.count("prefixes") == 1 and "round" in calls


def test_leaders_of_crowded_keys(spark, monkeypatch):
    """A key of 40 classes, two of them in one group, a key of one group and a key of few rows; batches cut the large key."""
    monkeypatch.setattr(near_dedup, "LEADERS", 3)
    key = lambda s: {"shingle": s, "low": 1, "high": 1}
    rows = [(key(7), i, max(i, 1), 10, 1, 9) for i in range(40)] + [(key(8), 100 + i, 1, 10, 1, 9) for i in range(40)]
    rows += [(key(9), i, i, 10, 1, 9) for i in range(2)]
    posted = spark.createDataFrame(rows, "key struct<shingle: bigint, low: int, high: int>, id bigint, part bigint, n bigint, own int, ahead int")
    crowded = near_dedup._crowded(posted).localCheckpoint()
    assert {r["id"] for r in crowded.collect()} == set(range(40)) and crowded.count() == 40
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        pairs = {(r["a"], r["b"]) for r in near_dedup._leader_pairs(crowded, 0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    leaders = {a for a, _ in pairs}
    same = {frozenset((0, 1))}
    assert len(leaders) <= 3
    met = {frozenset(p) for p in pairs}
    full = {frozenset((a, b)) for a in leaders for b in range(40) if a != b} - same
    # a leader without a later class of another group shows as no a; with 40 classes every leader has some
    assert len(leaders) == 3 and met == full
