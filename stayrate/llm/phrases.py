"""Phrase collocations by prefix-free parsing.

1. A text is a stream of words with breaks between its pieces. A window of two words whose hash is a multiple of
   ``TRIGGER`` starts a new chunk, wherever it occurs, so that shared passages are cut alike. A chunk owns the words
   up to the next trigger and also shows the next ``LONGEST`` - 1 words, up to a break: every phrase that starts at an owned
   word is inside its chunk, and is counted there and nowhere else.
2. The dictionary has each distinct chunk (language, words, owned words) with its frequency in the parse. From here on
   only the dictionary is read; a phrase in a chunk counts as often as the chunk.
3. Words are counted. A phrase can only be as frequent as its words and pairs: hashes of pairs of frequent
   words are counted next, and phrases are counted where all their pairs are frequent. Both conditions are bit sets of a
   fixed size (``BITS``) addressed by hashes; a hit that is none only means that a phrase is counted in vain.
4. Counts are exact sums over the phrases themselves. Cuts, containment and ranks are joins and aggregations on what is
   frequent enough; the ranking takes the first of each of many parts before they meet.

Defined cases: a null or empty text has no word; a null language is ``und``. Repeated rows count each. Texts of any length
are read whole; a chunk without a trigger ends after ``FURTHEST`` words, which changes nothing but the dictionary. Ties are
broken by count, then by the phrase in byte order. Only the two named columns are read, so other columns never clash. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.functions.ordering import durable
from stayrate.llm.tokens import slices, split_words

LONGEST = 4
#: One window in so many starts a chunk; the longest chunk without one.
TRIGGER = 32
FURTHEST = 1024
#: Size of the bit sets (a power of two): 16 MB each.
BITS = 1 << 27
#: Distinct items that a task holds before it hands them on.
HELD = 400_000
#: Parts of a language of which each gives its first phrases to the ranking.
DEALT = 64

#: Stands for the end of a piece; no word has it.
BREAK = "."
#: Bytes of chunks that a task looks at together.
TOGETHER = 8_000_000
UNKNOWN = "und"
_ENDS = r"[.,;:!?\x0A-\x0D]+"

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _ODD + b)


def _named(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and the number of each word among them."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    found = words.dictionary_encode()
    return found.dictionary, np.asarray(found.indices, dtype=np.int64)


def _list(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens (words and breaks), the token of each position, and where each text's positions start."""
    words, starts = split_words(pc.replace_substring_regex(texts, _ENDS, f" {BREAK} "))
    return *_named(words), starts


def _cuts(hashes: np.ndarray, starts: np.ndarray, trigger: int, furthest: int) -> np.ndarray:
    """Positions at which chunks start."""
    first = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        first[1:] = _pairs(hashes[:-1], hashes[1:]) % np.uint64(trigger) == 0
    first[starts[:-1][starts[:-1] < len(hashes)]] = True
    at = np.flatnonzero(first)
    gaps = np.diff(np.append(at, len(hashes)))
    if len(gaps) and gaps.max() > furthest:
        at = np.concatenate([np.arange(a, a + g, furthest) for a, g in zip(at, gaps)])
    return at


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, chunk, own, n): the distinct chunks, words separated by spaces, with the words they own and their frequency."""
    trigger, furthest, most = TRIGGER, FURTHEST, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, int], int] = {}

        def out() -> pa.RecordBatch:
            langs, chunks, owns = zip(*held)
            arrays = [pa.array(langs, pa.string()), pa.array(chunks, pa.string()), pa.array(owns, pa.int32()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "chunk", "own", "n"])

        for batch in batches:
            for part in slices(batch):
                tokens, codes, starts = _split(pc.ascii_lower(part.column(1)))
                if not len(codes):
                    continue
                distinct = _list(tokens)
                at = _cuts(_hashes(distinct)[codes], starts, trigger, furthest)
                owner = np.searchsorted(starts, at, side="right") - 1
                ends = np.append(at[1:], len(codes))
                # what a chunk shows beyond its own words ends at a break or with the text
                stop = np.append(np.flatnonzero(codes == distinct.index(BREAK)) if BREAK in distinct else [], len(codes)).astype(np.int64)
                shown = np.minimum(np.minimum(ends + LONGEST - 1, starts[owner + 1]), np.maximum(stop[np.searchsorted(stop, ends)], ends))
                words = np.array(distinct, dtype=object)[codes].tolist()
                langs = part.column(0).to_pylist()
                for a, b, c, o in zip(at.tolist(), ends.tolist(), shown.tolist(), owner.tolist()):
                    key = (langs[o], " ".join(words[a:c]), b - a)
                    held[key] = held.get(key, 0) + 1
                if len(held) > most:
                    yield out()
                    held.clear()
        if held:
            yield out()

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    rows = docs.select(lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(run, "lang string, chunk string, own int, n bigint")
    return found.groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n"))


class _Chunks:
    """The tokens of some chunks as arrays."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        lists = pc.split_pattern(batch.column(1).cast(pa.large_string()), " ")
        offsets = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
        self.names, self.codes = _named(lists.flatten())
        sizes = np.diff(offsets)
        self.langs, lang = _named(batch.column(0))
        self.lang = np.repeat(lang, sizes)
        self.times = np.repeat(np.asarray(batch.column(3)), sizes)
        within = np.arange(len(self.codes)) - np.repeat(offsets[:-1], sizes)
        self.own = within < np.repeat(np.asarray(batch.column(2), dtype=np.int64), sizes)
        self.left = np.repeat(offsets[1:], sizes) - np.arange(len(self.codes))
        self.word = np.asarray(pc.not_equal(self.names, BREAK))[self.codes]

    def hashes(self) -> np.ndarray:
        """Hash of each token in its language."""
        return _pairs(_hashes(_list(self.langs))[self.lang], _hashes(_list(self.names))[self.codes])

    def runs(self, n: int) -> np.ndarray:
        """Whether n words without a break start at a position of a chunk."""
        ok = self.left >= n
        for j in range(n):
            ok[: len(ok) - j] &= self.word[j:]
        return ok

    def counts(self, at: np.ndarray, size: int, f: np.ndarray) -> pa.RecordBatch:
        """Rows (lang, size, phrase, f) of the phrases of a size at some positions."""
        words = [self.names.take(pa.array(self.codes[at + j])) for j in range(size)]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if size > 1 else words[0]
        lang = self.langs.take(pa.array(self.lang[at]))
        return _rows(lang, np.full(len(at), size, np.int32), phrase.cast(pa.string()), f)


def _rows(lang: pa.Array, size: np.ndarray, phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, pa.array(size, pa.int32()), phrase, pa.array(f, pa.int64())], ["lang", "size", "phrase", "f"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunks]:
    """The chunks of consecutive batches, about ``TOGETHER`` bytes at a time."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= TOGETHER:
            yield _Chunks(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held, size = [], 0
    if held:
        yield _Chunks(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


_COUNTS = "lang string, size int, phrase string, f bigint"


def _counted(chunks: DataFrame, count: Callable[[_Chunks], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows (lang, size, phrase, f): the sums of what ``count`` gives for the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _together(batches):
            yield from count(some)

    found = chunks.select("lang", "chunk", "own", "n").mapInArrow(run, _COUNTS)
    return found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def words(chunks: DataFrame) -> DataFrame:
    """All words with their counts as rows (lang, 1, word, f), and per language their sum as (lang, 0, empty, f)."""

    def count(c: _Chunks) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(c.own & c.word)
        _, first, number = np.unique(c.lang[at] * len(c.names) + c.codes[at], return_index=True, return_inverse=True)
        yield c.counts(at[first], 1, _sums(number, c.times[at], len(first)))
        totals = _sums(c.lang[at], c.times[at], len(c.langs))
        yield _rows(c.langs, np.zeros(len(totals)), pa.array([""] * len(totals), pa.string()), totals)

    return _counted(chunks, count)


def _sums(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, groups, values)
    return out


def _bits(rows: DataFrame, hashed: str) -> np.ndarray:
    """A bit set of the hashes in a column: at most ``BITS`` / 64 rows reach the driver."""
    place = F.col(hashed).bitwiseAND(F.lit(BITS - 1))
    word = F.shiftright(place, 6).cast("int").alias("w")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b")
    found = rows.select(word, bit).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint64)


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(64 * len(bits) - 1)
    return bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) == 1


def _word_hashes(counted: DataFrame) -> DataFrame:
    """Rows (h) for rows (lang, phrase): the hash of a word of a language, as ``_Chunks`` has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _pairs(*(_hashes(_list(batch.column(i))) for i in range(2)))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return counted.select("lang", "phrase").mapInArrow(run, "h bigint")


def _frequent_pairs(chunks: DataFrame, in_use: np.ndarray, least: int) -> DataFrame:
    """Rows (h): the hashes of pairs of frequent words that occur often enough. Two pairs with one hash only add up."""
    most = 10 * HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def out() -> pa.RecordBatch:
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = _sums(at, np.concatenate(counts), len(distinct))
            return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n)], ["h", "f"])

        for c in _together(batches):
            hashes = c.hashes()
            often = _in(in_use, hashes)
            at = np.flatnonzero(c.own & c.runs(2) & often & np.append(often[1:], False))
            keys.append(_pairs(hashes[at], hashes[at + 1]))
            counts.append(c.times[at])
            size += len(at)
            if size > most:
                yield out()
                keys, counts, size = [], [], 0
        if size:
            yield out()

    found = chunks.select("lang", "chunk", "own", "n").mapInArrow(run, "h bigint, f bigint")
    return found.groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("h")


def _phrases(chunks: DataFrame, in_use: np.ndarray, paired: np.ndarray) -> DataFrame:
    """Rows (lang, size, phrase, f) of the phrases of frequent pairs of frequent words."""

    def count(c: _Chunks) -> Iterator[pa.RecordBatch]:
        hashes = c.hashes()
        often = _in(in_use, hashes)
        follows = c.runs(2) & often & np.append(often[1:], False)
        at = np.flatnonzero(follows)
        follows[at] = _in(paired, _pairs(hashes[at], hashes[at + 1]))
        ok, group = follows, c.codes + c.lang * len(c.names)
        for size in range(2, LONGEST + 1):
            # number the phrases of this size from the numbers of the phrases without their last word
            at = np.flatnonzero(ok)
            if not len(at):
                return
            _, first, number = np.unique(group[at] * len(c.names) + c.codes[at + size - 1], return_index=True, return_inverse=True)
            own = c.own[at]
            sums = _sums(number[own], c.times[at][own], len(first))
            yield c.counts(at[first][sums > 0], size, sums[sums > 0])
            group = np.zeros(len(c.codes), np.int64)
            group[at] = number
            longer = np.zeros(len(ok), bool)
            longer[: len(ok) - size + 1] = ok[: len(ok) - size + 1] & follows[size - 1 :]
            ok = longer

    return _counted(chunks, count)


def _quotient(a: Column, b: Column) -> Column:
    """Whole part of 2000000 * a / b without losing a digit."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(F.lit(2_000_000)) * a.cast("decimal(20,0)"), wide(b))


def collocations(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, phrase, size, a, l, r, n, score) of all phrases that are not dropped, ``a`` at least ``least``.

    ``a``, ``l`` and ``r`` count the phrase and the two sides of its lowest-scoring cut, ``n`` all words of the language.
    """
    chunks = durable(dictionary(docs, text_col, lang_col))
    found = durable(words(chunks))
    totals = found.where("size = 0").select("lang", F.col("f").alias("n"))
    frequent = found.where((F.col("size") == 1) & (F.col("f") >= least))
    in_use = _bits(_word_hashes(frequent), "h")
    paired = _bits(_frequent_pairs(chunks, in_use, least), "h")
    counted = durable(_phrases(chunks, in_use, paired).where(F.col("f") >= least))
    return _scored(counted, frequent.unionByName(counted), totals)


def _part(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("w", start, length), " ")


def _scored(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Cuts, scores and containment of candidates (lang, size, phrase, f); ``counts`` has all their parts."""
    split = candidates.withColumn("w", F.split("phrase", " ", -1))
    cut = split.select("lang", "phrase", "size", "f", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "size", "f", "k", _part(F.lit(1), F.col("k")).alias("one"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("two"))
    side = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    met = cut.join(side("one", "l"), ["lang", "one"]).join(side("two", "r"), ["lang", "two"])
    # the sum of two counts and the product with the weight may pass 64 bits
    score = _quotient(F.col("f"), F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)"))
    lowest = met.withColumn("score", score).groupBy("lang", "phrase", "size").agg(
        F.max("f").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )

    inner = split.where("size > 2").select(
        "lang", "size", "f", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m")
    ).select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    around = inner.select("lang", "f", _part(F.col("at"), F.col("m")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = lambda c, times: F.col(c).cast("decimal(20,0)") * F.lit(times)
    kept = lowest.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", 80)))
    # one row per language
    return kept.join(F.broadcast(totals), "lang").select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def first_ranked(found: DataFrame, top: int = 2000) -> DataFrame:
    """The first phrases of each language with their rank, by score, count and bytes.

    A language is dealt to ``DEALT`` parts by hash; only the first of each part meet.
    """
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    part = F.pmod(F.xxhash64("phrase"), F.lit(DEALT))
    number = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ahead = found.withColumn("__part", part).withColumn("__place", number("lang", "__part")).where(F.col("__place") <= top)
    ranked = ahead.drop("__part", "__place").withColumn("rank", number("lang")).where(F.col("rank") <= top)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))
