"""Near duplicates around the threshold against brute force, with every part of the last step in use."""

import random

import pytest

from stayrate.llm import near_dedup


def _texts() -> list[str]:
    """Copies of two texts with words replaced, so that pairs lie on both sides of the threshold."""
    rng = random.Random(5)
    out = []
    for base in range(2):
        words = [f"w{base}x{i}" for i in range(120)]
        for _ in range(24):
            own = list(words)
            for place in rng.sample(range(120), rng.randint(1, 4)):
                own[place] = f"n{rng.randint(0, 3)}"
            out.append(" ".join(own))
    return out + [out[0], "", None, "one two"]


def _brute_force(texts: list[str]) -> dict[int, int]:
    sets = []
    for text in texts:
        words = (text or "").split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    return dict(enumerate(group))


@pytest.mark.parametrize("rounds", [0, 1])
def test_groups_around_the_threshold(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_dedup, "ROUNDS", 1 + rounds)
    monkeypatch.setattr(near_dedup, "SPARSE", 0)
    monkeypatch.setattr(near_dedup, "LEADERS", 2)
    monkeypatch.setattr(near_dedup, "TOGETHER", 3)
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(docs).collect()}
    assert {i: c if c is not None else i for i, c in found.items()} == _brute_force(texts)
