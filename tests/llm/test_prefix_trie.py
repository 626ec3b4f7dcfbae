"""The prefix trie against a plain version over small tables with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

from stayrate.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain_turns(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, digest(role, text), (role, text)))
    return {c: [t[3] for t in sorted(v)] for c, v in turns.items()}


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, ids in members.items():
        children = [p for p in members if len(p) == len(path) + 1 and p[: len(path)] == path]
        below = [p for p in members if p[: len(path)] == path]
        inner = {p[:-1] for p in members if p}
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        row = (min(ids), len(path), parent, len(ids), len(children), sum(p not in inner for p in below), saved)
        out.append((*row, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(turns):
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def odd_rows():
    rng = random.Random(4)
    rows = [(None, 0, "user", "none")]
    ids = [*range(0, 230), 1_000_003, 2**62 + 5, -7, -250, -200, *range(5_000, 5_140)]
    for c in ids:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b\U0001F600", "", None, "a" * 40])))
    # one conversation in many copies, repeated rows and equal turn numbers with different texts
    rows += [(c, t, "user", f"hot {t}") for c in range(20_001, 20_400) for t in range(3)]
    rows += [(30, 1, "user", "tie x"), (30, 1, "user", "tie y"), (30, 1, "user", "tie y")]
    return rows


def run(spark, monkeypatch, rows, more=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if more:
        df = df.selectExpr("*", "'x' as node", "1 as t", "2 as shard", "3 as depth", "array(1) as turns")
    monkeypatch.setattr(queries, "table", lambda s, d, n: df)
    got = queries.op11_prefix_trie(spark, "")
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_query_equals_plain_version(spark, monkeypatch):
    rows = odd_rows()
    assert run(spark, monkeypatch, rows, more=True) == plain_trie(rebuilt(plain_turns(rows)))


def test_empty_table(spark, monkeypatch):
    assert run(spark, monkeypatch, []) == []


def test_operator_gives_end_lists(spark):
    rows = [(c, t, "user", f"t{t % 2}") for c in (3, 600, 40_000, 40_001) for t in range(c % 4)]
    convs = plain_turns(rows)
    found = prefix_trie.trie(prefix_trie.conversations(spark.createDataFrame(rows, SCHEMA)))
    depth = {bytes(r["node"]): r["depth"] for r in found.nodes.collect()}
    got = sorted((depth[bytes(r["node"])], r["conv_id"]) for r in prefix_trie.end_lists(found.ends).collect())
    assert got == sorted((len(v), c) for c, v in convs.items())


def test_long_conversation(spark, monkeypatch):
    rows = [(c, t, "user", "x" if t < 2_900 else f"{c}") for c in (100, 101) for t in range(3_000)]
    got = run(spark, monkeypatch, rows)
    assert max(r[1] for r in got) == 3_000 and got == sorted(got, key=str)
    root = next(r for r in got if r[1] == 0)
    assert root[:7] == (100, 0, None, 2, 1, 2, 2_900)
