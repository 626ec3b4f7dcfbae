"""Small cases of the text operators: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayrate.llm import chat, fingerprint, gru, lang_id, line_dedup, lm_score, mixing, near_dedup, packing, quality, tokens, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, __text string, failed int"
LONG = " ".join(f"w{i}" for i in range(30_000))
TEXT = "the quick brown fox jumps over the lazy dog near the old river bank today"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "x", "y", 1) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(
        spark,
        [(1, None, None, None), (2, "", "en", "a"), (3, TEXT, "en", "a"), (3, TEXT, "en", "a"), (None, TEXT + " x", "en", None), (5, LONG, None, "b"), (6, TEXT, "de", "a")],
    )


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, []).limit(0)


def test_url_rules(spark):
    rules = spark.createDataFrame(
        [("com", "/", "allow"), ("a.com", "/x", "block"), ("a.com", "/x", "allow"), (None, "/", "block")], "host string, path string, action string"
    )
    pages = spark.createDataFrame(
        [(1, "http://WWW.a.com/xy?q", "p"), (2, None, "p"), (3, "nothing", "p"), (4, "x://com", "p"), (4, "x://com", "p"), (5, "http://b.com/é#f", "p")],
        "page_id bigint, url string, host string",
    )
    got = sorted(tuple(r) for r in url_filter.judge(pages, rules).fillna("-").collect())
    assert got == [
        (1, "www.a.com", "/xy", "a.com/x", "block"), (2, "", "", "-", "allow"), (3, "", "", "-", "allow"),
        (4, "com", "", "-", "allow"), (4, "com", "", "-", "allow"), (5, "b.com", "/é", "com/", "allow"),
    ]
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert url_filter.judge(pages, rules.limit(0)).where("rule is null and verdict = 'allow'").count() == 6


def test_quality_cases(odd, none):
    got = {(r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in quality.ledger(odd).collect()}
    assert got == {(1, 0, 0), (2, 0, 0), (3, 15, 0), (None, 16, 0), (5, 30_000, 0), (6, 15, 0)}
    kept = quality.reject(odd)
    assert kept.columns == odd.columns and {r[0] for r in kept.collect()} == {3, None, 6}  # 5 is mostly digits
    assert quality.reject(none).count() == 0 and quality.ledger(none).count() == 0


def test_quality_repeats_and_ablations(spark):
    rows = docs(spark, [(1, " ".join(["a b c d e"] * 4), "en", "a"), (2, TEXT, "en", "a")])
    entries = quality.ledger(rows)
    assert {r["doc_id"]: r["n_repeat_words"] for r in entries.collect()} == {1: 20, 2: 0}
    found = {r["rule"]: (r["fail"], r["fail_alone"], r["kept_without"]) for r in quality.ablations(entries, "v1").collect()}
    assert found == {"few_words": (0, 0, 1), "repeated_words": (1, 1, 2)}


def test_line_dedup_cases(odd, none, spark):
    many = docs(spark, [(i, f"own {i}\n  Shared LINE \t\nend {i}", "en", "a") for i in range(10)] + [(50, None, None, None), (51, "", None, None)])
    got = {r["doc_id"]: (r["text"], r["n"], r["gone"]) for r in line_dedup.drop_lines(many, counts=("n", "gone")).collect()}
    assert got[3] == ("own 3\nend 3", 3, 1) and got[50] == (None, 1, 0) and got[51] == ("", 1, 0)
    assert line_dedup.drop_lines(odd).columns == odd.columns and line_dedup.drop_lines(odd).count() == 7
    assert line_dedup.drop_lines(none).count() == 0


def test_near_dedup_cases(odd, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.groups(odd).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (11, 3, True), 5: (29_996, 5, True), 6: (11, 3, False)}
    left = near_dedup.keep_one(odd)
    assert left.columns == odd.columns and sorted(str(r[0]) for r in left.collect()) == ["1", "2", "3", "3", "5", "None"]
    assert near_dedup.groups(none).count() == 0


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return group


def test_near_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):
        base = [f"t{x}" for x in rng.integers(0, 10_000, 60)]
        for k in range(6):
            copy = list(base)
            for at in rng.integers(0, 60, k):
                copy[at] = "zz"
            rows.append((g * 10 + k, " ".join(copy)))
    frame = docs(spark, [(i, t, "en", "a") for i, t in rows])
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.groups(frame).collect()} == brute_groups(rows)


def test_mixing_shares():
    assert mixing.shares([100, 100]) == pytest.approx([200 * 5 / 7, 200 * 2 / 7])
    assert mixing.shares([10, 100, 100]) == pytest.approx([30, 120, 60])
    assert mixing.shares([]) == [] and mixing.shares([0]) == [0.0]


def test_mixing_cases(odd, none):
    rows = mixing.taken(odd).collect()
    assert len(rows) == 7 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.taken(none).count() == 0 and mixing.mix(none).count() == 0
    again = mixing.taken(odd).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    words = sum(len(r["text"].split()) for r in mixing.mix(odd).collect())
    assert words == sum(r["taken"] for r in rows)


def test_packing_pieces(odd, none):
    assert packing.pack(none).count() == 0
    pieces = packing.pack(odd.coalesce(1), with_ids=True).collect()
    fills = {}
    for r in pieces:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["length"] == len(r["ids"]) > 0
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in fills.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    assert sum(r["length"] for r in pieces if r["doc_id"] == 1) == 1


def test_place_minimises_sum_of_squares():
    rng = np.random.default_rng(2)
    levels = packing.LevelArray(20, 0)
    for length in rng.integers(1, 20, 200):
        before = levels.counts.copy()
        options = []
        for level in range(0, 20 - length + 1):
            if level and not before[level]:
                continue
            after = before.copy()
            if level:
                after[level] -= 1
            if level + length < 20:
                after[level + length] += 1
            options.append(int((after[1:20] ** 2).sum()))
        levels.place(int(length))
        assert int((levels.counts[1:20] ** 2).sum()) == min(options)


def test_encoder_equals_whole_text_encoding():
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [TEXT, "Ça VA <|endoftext|> x's 'S don't a1b22 !!?? ΑΣ", "", " a\x0bb ", "İ é e\u0301 \u00a0x", "日本 語"]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = [list(x) for x in tokens.Encoder(None).encode(pa.array(texts))]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_language_cases(odd, none, spark):
    model = lang_id.train(odd, F.lit(True))
    got = {(r["doc_id"], r["lang_pred"]) for r in lang_id.predict(odd, model, ["doc_id"]).collect()}
    assert (1, "und") in got and (2, "und") in got and lang_id.predict(none, model, ["doc_id"]).count() == 0
    empty = lang_id.train(none, F.lit(True))
    assert {r["lang_pred"] for r in lang_id.predict(odd, empty, ["doc_id"]).collect()} == {"und"}


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<~/s>", "", None, "[~~INST] [/INST", "a\n[", "<s>"]
    rows = [(i, k, r, t) for i, t in enumerate(odd) for k, r in enumerate(["system", "user", "assistant", "user"])]
    rows += [(100, 0, None, "x"), (100, 0, "ro~l\ne[INST]", "y"), (None, 0, "user", "z"), (None, 0, "assistant", "z")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.examples(frame)
    longest = made.groupBy("conv_id", "conv_key").agg(F.max(F.struct("example", "text"))["text"].alias("t"))
    got = {r[0]: [tuple(x) for x in r[1]] for r in longest.where("conv_id is not null").select("conv_id", chat.parsed(F.col("t"))).collect()}
    for i, t in enumerate(odd):
        assert got[i] == [(r, t or "") for r in ["system", "user", "assistant", "user"]]
    assert got[100] == [("", "x"), ("ro~l\ne[INST]", "y")]
    assert made.where("conv_id is null").count() == 2 and chat.read_back(made).count() == len(odd) + 3
    assert chat.examples(frame.limit(0)).count() == 0


def test_sketches_peel_to_the_difference(spark):
    a, b = [TEXT, "x\ny\nz", "", "same"], [TEXT + "\nmore", "\n".join(map(str, range(300))), "", "same"]
    frame = spark.createDataFrame(list(zip(a, b)), "a string, b string").select(fingerprint.digests(F.col("a")).alias("a"), fingerprint.digests(F.col("b")).alias("b"))
    sketched = frame.select("*", fingerprint.sketch(F.col("a")).alias("x"), fingerprint.sketch(F.col("b")).alias("y"))
    rows = sketched.select("a", "b", fingerprint.likeness(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("like")).collect()
    for r in rows:
        x, y = set(r["a"]), set(r["b"])
        assert r["like"] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


def test_language_model_is_a_distribution():
    words = ["the", "a", "of", ""] + [f"x{i}" for i in range(30)]
    counts = np.arange(60, 26, -1).astype(float)
    tail, distinct = np.zeros(gru.TAIL_CLASSES), np.zeros(gru.TAIL_CLASSES)
    v = gru.Vocabulary(words, counts, len(words), tail, distinct, int(counts.sum()), len(words))
    reader = gru.Reader(v, gru.Net.start(v))
    ends = [w for w in words if w] + [gru.END]
    texts = list(gru.texts_of(v, range(len(ends)), pa.array(ends)))
    out = []
    for t in texts:
        out += list(reader.add(t))
    out += list(reader.finish())
    first = 0.0
    for t in out:
        logs = gru.Reader(v, reader.net)._run(t.x[:1, None], t.c[:1, None], t.w[:1, None], np.ones((1, 1), bool), np.zeros((1, 1, 1), np.float32))
        first += float(np.exp(logs[0, 0]))
    assert 0.5 < first <= 1.001


def test_scores_of_odd_rows(odd, none):
    rows = lm_score.score(odd, F.lit(True), ["doc_id"]).collect()
    assert len(rows) == 7 and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {1} and {r["train_tokens"] for r in rows} == {7 + 3 * 15 + 16 + 30_000}
    assert lm_score.score(none, F.lit(True), ["doc_id"]).count() == 0
    assert lm_score.score(odd, F.lit(False), ["doc_id"]).count() == 7
