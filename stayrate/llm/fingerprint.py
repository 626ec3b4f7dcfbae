"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut at line breaks, and a long line every ``PIECE_WORDS`` words; each distinct paragraph has a 63-bit
digest. A sketch has three tables of ``CELLS`` cells; a digest is added to one cell of each table: a
count, the XOR of digests and the XOR of check values. Subtracting two sketches cell by cell leaves the digests that differ,
and peeling takes them out one after the other, from cells that hold exactly one. The likeness of
two texts is the number of common digests over the number of all, both known from the counts and the
recovered differences.

The fingerprint is the sketch of all digests. Where it is too small to be peeled, the digests of both sides are dealt to
parts by a hash of their own, each part is sketched with cells of its own and peeled, and only parts that cannot be peeled
are dealt again, with other hashes. The number of parts follows the size of the difference, which the cells tell:
the squares of the counts in a table add up to about the number of differing digests. All of it is column arithmetic inside a row.

Defined cases: a null or empty text has no paragraph; two texts without any have likeness 1. Repeated paragraphs
count once. Equal texts have equal fingerprints. Whole texts are read at any length. ``likeness`` and ``fingerprint`` are
columns, so names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayrate.llm.common import let

PIECE_WORDS = 16
TABLES = 3
CELLS = 8
#: Differing digests that a part holds on average, the most parts that one is dealt to, and how often it is dealt.
GROUP = 4
PARTS = 64
DEALS = 24
#: Rounds of peeling; a sketch of 24 cells needs fewer.
ROUNDS = 12

_PIECE = r"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){1,%d}+" % PIECE_WORDS
_MASK = (1 << 63) - 1


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs, without white space at their ends."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(F.rtrim(p)).bitwiseAND(F.lit(_MASK))))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _spread(digest: Column, seed: Column | None) -> Column:
    """The bits that choose the cells: of the digest itself, or of a hash of it."""
    return digest if seed is None else F.xxhash64(digest, F.lit(2), seed)


def _cells(bits: Column) -> list[Column]:
    """The cells of a digest, one of each table, counted through all tables, as fields t0, t1 and so on."""
    place = lambda t: F.shiftright(bits, 7 + 16 * t).bitwiseAND(F.lit(CELLS - 1)) + t * CELLS
    return [place(t).cast("int").alias(f"t{t}") for t in range(TABLES)]


def _at(placed: Column, i: Column) -> Column:
    hit = placed["t0"] == i
    for t in range(1, TABLES):
        hit = hit | (placed[f"t{t}"] == i)
    return hit


def sketch(found: Column, seed: Column | None = None) -> Column:
    """Cells (n, k, c) of an array of digests."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("c"))
    placed = F.transform(found, lambda d: F.struct(d.alias("k"), _check(d).alias("c"), *_cells(_spread(d, seed))))
    add = lambda a, d: F.struct(
        (a["n"] + 1).alias("n"), a["k"].bitwiseXOR(d["k"]).alias("k"), a["c"].bitwiseXOR(d["c"]).alias("c")
    )
    cells = F.sequence(F.lit(0), F.lit(TABLES * CELLS - 1))
    return let(placed, lambda p: F.transform(cells, lambda i: F.aggregate(F.filter(p, lambda d: _at(d, i)), empty, add)))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c"))
    )


_DIGESTS = "array<struct<digest:bigint,side:int>>"


def peeled(cells: Column, seed: Column | None = None) -> Column:
    """The digests that differ, with side 1 (only in the first) or -1 (only in the second), or null if some stay in the cells.

    Each round takes out all digests that stand alone in a cell.
    """
    alone = lambda x: (F.abs(x["n"]) == 1) & (_check(x["k"]) == x["c"])

    def take(state: Column, pure: Column) -> Column:
        less = lambda a, p: F.struct(
            (a["n"] - p["n"]).alias("n"), a["k"].bitwiseXOR(p["k"]).alias("k"), a["c"].bitwiseXOR(p["c"]).alias("c")
        )
        placed = F.transform(
            pure, lambda p: F.struct(p["n"].alias("n"), p["k"].alias("k"), p["c"].alias("c"), *_cells(_spread(p["k"], seed)))
        )
        rest = let(placed, lambda q: F.transform(state["cells"], lambda x, i: F.aggregate(F.filter(q, lambda p: _at(p, i)), x, less)))
        got = F.transform(pure, lambda p: F.struct(p["k"].alias("digest"), p["n"].cast("int").alias("side")))
        return F.struct(rest.alias("cells"), F.concat(state["d"], got).alias("d"))

    def step(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.filter(state["cells"], alone))
        return let(pure, lambda p: F.when(F.size(p) == 0, state).otherwise(take(state, p)))

    start = F.struct(cells.alias("cells"), F.array().cast(_DIGESTS).alias("d"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    clean = lambda s: F.when(~F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0)), s["d"])
    return let(done, clean)


def _about(cells: Column, least: Column) -> Column:
    """The number of differing digests, about: at least the difference of the counts."""
    total = F.aggregate(cells, F.lit(0).cast("bigint"), lambda n, x: n + x["n"].cast("bigint") * x["n"])
    return F.greatest((total / TABLES - least * least / CELLS) * CELLS / (CELLS - 1), least.cast("double"), F.lit(2.0 * GROUP))


def _parts(a: Column, b: Column, cells: Column) -> Column:
    """In how many parts to deal two arrays whose subtracted cells cannot be peeled."""
    wanted = _about(cells, F.abs(F.size(a) - F.size(b)).cast("bigint"))
    return F.least(F.ceil(wanted / GROUP), F.lit(PARTS)).cast("bigint")


def dealt(a: Column, b: Column, cells: Column) -> Column:
    """What ``peeled`` gives, from the digests of both sides dealt to parts: (found, open), ``open`` with the parts that no deal could peel.

    ``cells`` are the subtracted cells that could not be peeled.
    """
    todo = F.array(F.struct(a.alias("a"), b.alias("b"), _parts(a, b, cells).alias("n")))
    start = F.struct(F.array().cast(_DIGESTS).alias("found"), todo.alias("todo"))

    def split(p: Column, t: Column) -> Column:
        place = lambda d: F.struct(d.alias("d"), F.pmod(F.xxhash64(d, F.lit(3), t), p["n"]).alias("s"))
        mine = lambda of, s: F.transform(F.filter(of, lambda x: x["s"] == s), lambda x: x["d"])
        both = F.struct(F.transform(p["a"], place).alias("a"), F.transform(p["b"], place).alias("b"))
        return let(both, lambda q: F.transform(
            F.sequence(F.lit(0).cast("bigint"), p["n"] - 1), lambda s: F.struct(mine(q["a"], s).alias("a"), mine(q["b"], s).alias("b"))
        ))

    def tried(p: Column, t: Column) -> Column:
        cells_of = subtracted(sketch(p["a"], t), sketch(p["b"], t))
        return let(cells_of, lambda c: F.struct(p["a"].alias("a"), p["b"].alias("b"), _parts(p["a"], p["b"], c).alias("n"), peeled(c, t).alias("d")))

    def deal(state: Column, t: Column) -> Column:
        parts = F.transform(F.flatten(F.transform(state["todo"], lambda p: split(p, t))), lambda p: tried(p, t))
        again = lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["n"].alias("n"))
        return let(parts, lambda q: F.struct(
            F.concat(state["found"], F.flatten(F.transform(F.filter(q, lambda p: p["d"].isNotNull()), lambda p: p["d"]))).alias("found"),
            F.transform(F.filter(q, lambda p: p["d"].isNull()), again).alias("todo"),
        ))

    step = lambda state, t: F.when(F.size(state["todo"]) == 0, state).otherwise(deal(state, t))
    return F.aggregate(F.sequence(F.lit(1), F.lit(DEALS)), start, step, lambda s: F.struct(s["found"].alias("found"), s["todo"].alias("open")))


def _compared(a: Column, b: Column) -> Column:
    """The differing digests of two arrays as they are."""
    of = lambda x, y, side: F.transform(F.array_except(x, y), lambda d: F.struct(d.alias("digest"), F.lit(side).alias("side")))
    return F.concat(of(a, b, 1), of(b, a, -1))


def differences(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """The digests (digest, side) that only the first (1) or only the second text (-1) has, from their sketches.

    Where those are too small, from larger ones of the digests; a part that no deal could peel is compared as it is.
    """

    def whole(cells: Column) -> Column:
        rest = lambda s: F.concat(s["found"], F.flatten(F.transform(s["open"], lambda p: _compared(p["a"], p["b"]))))
        return F.coalesce(peeled(cells), let(dealt(a, b, cells), rest))

    return let(subtracted(sketch_a, sketch_b), whole)


def likeness(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Likeness of two texts from the differences that their sketches give."""
    both = F.size(a) + F.size(b)
    share = lambda d: F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))
    return let(F.size(differences(a, b, sketch_a, sketch_b)), share)


def fingerprint(cells: Column) -> Column:
    """A sketch as text."""
    return F.concat_ws(".", F.transform(cells, lambda x: F.concat_ws(":", F.hex(x["n"].cast("bigint")), F.hex(x["k"]), F.hex(x["c"]))))
