"""Phrase collocations against a plain version over small texts with odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from stayrate.llm import phrases, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    found = defaultdict(list)
    longer = defaultdict(int)
    for (lang, ws), a in f.items():
        if len(ws) > 2 and a >= least:
            for m in range(2, len(ws)):
                for i in range(len(ws) - m + 1):
                    key = lang, ws[i : i + m]
                    longer[key] = max(longer[key], a)
    for (lang, ws), a in f.items():
        if len(ws) < 2 or a < least or 100 * longer[lang, ws] >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(ws)):
            l, r = f[lang, ws[:k]], f[lang, ws[k:]]
            cuts.append((2_000_000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        phrase = " ".join(ws)
        found[lang].append((-score, -a, phrase.encode(), (phrase, a, l, r, n[lang], score)))
    return sorted(((lang, i + 1, *x[3]) for lang, v in found.items() for i, x in enumerate(sorted(v)[:top])), key=str)


def odd_rows():
    rng = random.Random(12)
    vocabulary = ["the", "of", "The", "cat", "é", "É", "\U0001F600", "don't", "x-y", "c d", "\x00", "a" * 300, "(so", "he said"]
    say = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", "  ", ", ", ".\n", "; "]) for _ in range(k))
    shared = say(400)
    rows = [(rng.choice(["en", "fr", None, ""]), say(rng.randrange(60))) for _ in range(60)]
    rows += [("en", say(5) + shared + say(4)) for _ in range(35)] + [("fr", None), (None, None), ("en", ""), ("en", " ... ")]
    rows += [("en", "again and again " * 900)] + [("de", "ein satz, der sich wiederholt")] * 31
    return rows


def run(spark, monkeypatch, rows, more=False):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    if more:
        df = df.selectExpr("*", "1 as n", "'x' as chunk", "2 as own", "'p' as phrase", "3 as f", "4 as rank")
    monkeypatch.setattr(queries, "table", lambda s, d, n: df)
    got = queries.op13_phrase_collocations(spark, "")
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("bits, trigger, furthest", [(1 << 27, 32, 1024), (64, 2, 7), (1 << 12, 10**9, 5)])
def test_query_equals_plain_version(spark, monkeypatch, bits, trigger, furthest):
    monkeypatch.setattr(phrases, "BITS", bits)
    monkeypatch.setattr(phrases, "TRIGGER", trigger)
    monkeypatch.setattr(phrases, "FURTHEST", furthest)
    rows = odd_rows()
    want = plain(rows)
    assert len(want) > 50 and run(spark, monkeypatch, rows, more=bits == 64) == want


def test_small_holds_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 3)
    rows = odd_rows()
    assert run(spark, monkeypatch, rows) == plain(rows)


def test_empty_table_and_rare_words(spark, monkeypatch):
    assert run(spark, monkeypatch, []) == []
    assert run(spark, monkeypatch, [("en", "only once here")]) == []


def test_arithmetic_beyond_64_bits(spark):
    big = 4_611_686_018_427_387_905
    counts = [("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 1), ("en", 1, "c", 30), ("en", 3, "a b c", 30), ("en", 2, "b c", 30)]
    made = spark.createDataFrame(counts, "lang string, size int, phrase string, f bigint")
    totals = spark.createDataFrame([("en", big)], "lang string, n bigint")
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["score"]) for r in phrases._scored(made.where("size > 1"), made, totals).collect()}
    assert got["a b"] == (big - 1, big, big, 2_000_000 * (big - 1) // (2 * big))
    assert got["a b c"] == (30, big, 30, 0) and "b c" not in got


def test_dictionary_counts_a_shared_passage_once(spark):
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(900)}" for _ in range(4000))
    docs = spark.createDataFrame([("en", f"head{i} {passage} tail{i}") for i in range(20)], "lang string, text string")
    chunks = phrases.dictionary(docs).collect()
    assert sum(r["own"] * r["n"] for r in chunks) == 20 * 4002
    assert sum(r["own"] for r in chunks) < 2 * 4002


def test_ranking_over_parts(spark):
    rows = [(lang, f"w{i} x", i % 7, i // 500) for lang in ("en", "fr") for i in range(3000)]
    found = spark.createDataFrame(rows, "lang string, phrase string, a bigint, score bigint")
    got = sorted((r["lang"], r["rank"], r["phrase"]) for r in phrases.first_ranked(found, 1100).collect())
    want = [(lang, i + 1, r[1]) for lang in ("en", "fr") for i, r in enumerate(sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[3], -r[2], r[1]))[:1100])]
    assert got == want
