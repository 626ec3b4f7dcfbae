"""Byte-pair encoding and decoding by a table of distinct words.

1. Texts are cut at ASCII white space, and words of plain characters at the borders at which the tokenizer cuts them as
   well: into runs of letters, digits and other signs. No token crosses such a border, so a part has the same
   ids in every text.
2. The distinct parts with their counts are one table; each is encoded once, and decoded through a join of its ids
   with the table of pieces.
3. Ids are joined back by position. The most frequent parts, as many as fit into ``LEXICON_WORDS`` and
   ``LEXICON_BYTES``, are at hand in every task; a block of texts becomes one row with its parts' numbers there, compressed. All
   other parts go through a join on the part, with their block's key and their place among its other parts, and come
   back as one list per block.
4. Blocks are then put together: the ids of each text, and the pieces with a space between, which is what the
   tokenizer's own decoding gives for files without a decoder.

What moves is each task's distinct parts, the rare parts and the numbers of the frequent ones; texts stay where they are read.
They are read three times: counted, numbered, and searched for rare parts. A block's key is a hash of its ids and texts, so both
of the last two readings name it alike; a block that misses its list stops the job.

Defined cases: a null or empty text has no ids and decodes to the empty text. Rows that repeat an id, or have none, give a row
each; equal blocks share one list. Texts of any length are read whole. Special tokens inside a text are encoded as the tokenizer
does it, as one id. The result has the columns asked for, so other columns never clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.functions.ordering import durable
from stayrate.llm.tokens import REMEMBERED, slices, split_words

#: Bounds of the table that every task holds: parts, and bytes of all its parts, ids and pieces as text.
LEXICON_WORDS = 262_144
LEXICON_BYTES = 1 << 25
#: A longer part is never in that table.
LEXICON_LONGEST = 256
_PER_CALL = 1000
#: Parts of a block of texts; a text with more is a block of its own.
BLOCK = 1 << 17

#: Words of these characters can be cut before the tokenizer sees them: ASCII, and letters with marks up to U+017F.
_LETTER = "a-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile("[!-~À-ſ]+")
_UNIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^0-9{_LETTER}]+")
#: A letter and a sign or digit after it are never in one token, but for the apostrophe; words that need not be cut.
_SIGN = r"!-&(-/:-@\[-`{-~"
_BORDER = f"([{_LETTER}])([0-9{_SIGN}])"
_ONE = f"^([{_LETTER}]+|[{_SIGN}]+|[0-9])$"
#: Bytes of text that a task cuts together.
TOGETHER = 4_000_000


def tokenizer_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return path


def _checked(path: str) -> None:
    """Raises for a tokenizer whose tokens can cross white space, depend on case or decode in another way."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cut = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    steps = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
    if made.get("decoder") or steps != ["NFC", "Replace", "Lowercase"] or (cut[0].get("type"), cut[0].get("behavior"), cut[0].get("invert")) != ("Split", "Removed", True):
        raise ValueError("the tokenizer must lower-case, drop white space between its words and have no decoder")


def units(word: str) -> list[str]:
    """The parts of a word; a word with other characters stays whole."""
    if _PLAIN.fullmatch(word) and "<|" not in word:
        return _UNIT.findall(word.lower())
    return [word]


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct parts, the part of each position, and where each text's positions start (one more entry than texts).

    A text that may hold a special token is cut at white space first, with its case.
    """
    bordered = pc.replace_substring_regex(pc.ascii_lower(texts), _BORDER, r"\1 \2")
    words, starts = split_words(pc.if_else(pc.match_substring(texts, "<|"), texts, bordered))
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    found = words.dictionary_encode()
    distinct, codes = found.dictionary, np.asarray(found.indices)
    more = np.flatnonzero(~np.asarray(pc.match_substring_regex(distinct, _ONE)))
    if not len(more):
        return distinct, codes, starts
    parts = [units(w) for w in distinct.take(pa.array(more)).to_numpy(zero_copy_only=False)]
    sizes = np.ones(len(distinct), np.int64)
    sizes[more] = [len(x) for x in parts]
    begins = np.cumsum(sizes) - sizes
    # first all words as they are, then the parts of those that were cut
    whole = np.concatenate([distinct.to_numpy(zero_copy_only=False), np.array([u for x in parts for u in x], dtype=object)])
    pool = np.repeat(np.arange(len(distinct)), sizes)
    cut_up = np.zeros(len(distinct), bool)
    cut_up[more] = True
    pool[np.repeat(cut_up, sizes)] = len(distinct) + np.arange(len(whole) - len(distinct))
    named = pa.array(whole, pa.large_string()).dictionary_encode()
    pool = np.asarray(named.indices)[pool]
    lengths = sizes[codes]
    upto = np.concatenate([[0], np.cumsum(lengths)])
    flat = pool[np.repeat(begins[codes] - upto[:-1], lengths) + np.arange(upto[-1])]
    used = np.zeros(len(named.dictionary), bool)
    used[flat] = True
    return named.dictionary.filter(pa.array(used)), (np.cumsum(used) - 1)[flat], upto[starts]


def word_table(texts: DataFrame) -> DataFrame:
    """Rows (word, n): the distinct parts of all texts (one column) with their counts."""
    most = REMEMBERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            for part in slices(batch, 0, TOGETHER):
                distinct, flat, _ = cut(part.column(0))
                counts = np.bincount(flat, minlength=len(distinct))
                held.append(pa.table({"word": distinct.cast(pa.string()), "n": pa.array(counts, pa.int64())}))
                if sum(t.num_rows for t in held) > 2 * most:
                    held = [summed()]
                    if held[0].num_rows > most:
                        yield from held[0].combine_chunks().to_batches()
                        held = []
        if held:
            yield from summed().combine_chunks().to_batches()

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The rows with ids, each word encoded once; the rows stay in their partitions."""

    @F.arrow_udf("array<int>")
    def ids_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(tokenizer_path(tokenizer))
        made.no_truncation()
        made.no_padding()
        for column in columns:
            found = column.to_pylist()
            ids = [e.ids for i in range(0, len(found), _PER_CALL) for e in made.encode_batch(found[i : i + _PER_CALL], add_special_tokens=False)]
            yield pa.array(ids, pa.list_(pa.int32()))

    return words.withColumn("ids", ids_of("word"))


def pieces(spark: SparkSession, tokenizer: str | None = None) -> DataFrame:
    """Rows (token, piece) of the whole vocabulary, special tokens included."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path(tokenizer)).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(i, p) for p, i in found.items()], "token int, piece string")


def decode(rows: DataFrame, key: str, spark: SparkSession, tokenizer: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, n_ids, ids, decoded) for rows with a unique ``key`` and ``ids``: the pieces of the ids with a space between.

    The vocabulary is of a fixed size and goes to every task. ``keep`` names columns to carry along. Rows move once, before
    their ids become rows.
    """
    each = rows.repartition(key).select(key, *keep, F.posexplode_outer("ids").alias("pos", "token"))
    met = each.join(F.broadcast(pieces(spark, tokenizer)), "token", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "token", "piece"))))
    whole = met.groupBy(key, *keep).agg(ordered.alias("p"))
    ids = F.array_join(F.col("p.token").cast("array<string>"), " ")
    return whole.select(key, *keep, F.size("p").alias("n_ids"), ids.alias("ids"), F.array_join("p.piece", " ").alias("decoded"))


def _lexicon(table: DataFrame) -> tuple[pa.Array, np.ndarray, pa.Array, pa.Array]:
    """The most frequent parts, their counts of ids, and their ids and pieces as text, within the bounds."""
    size = F.octet_length("word") + F.octet_length("ids") + F.octet_length("decoded")
    step = F.floor(F.log2("n") * 64).cast("int")
    short = table.where(F.octet_length("word") <= LEXICON_LONGEST).select("word", "n", "n_ids", "ids", "decoded", size.alias("bytes"), step.alias("step"))
    # some 4,000 steps of counts at most: all words from the least step on that still fits
    least, words, total = 1 << 20, 0, 0
    for r in sorted(short.groupBy("step").agg(F.count(F.lit(1)).alias("w"), F.sum("bytes").alias("b")).collect(), reverse=True):
        words, total = words + r["w"], total + r["b"]
        if words > LEXICON_WORDS or total > LEXICON_BYTES:
            break
        least = r["step"]
    top = short.where(F.col("step") >= least).select("word", "n", "n_ids", "ids", "decoded").toArrow()
    top = top.sort_by([("n", "descending"), ("word", "ascending")])
    text = lambda c: top[c].cast(pa.large_string()).combine_chunks()
    return text("word"), top["n_ids"].to_numpy().astype(np.int64), text("ids"), text("decoded")


class _Blocks:
    """Texts as blocks of parts' numbers in the lexicon; the first number beyond it stands for all other parts."""

    def __init__(self, known: pa.Array) -> None:
        self.known = known

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array, np.ndarray, np.ndarray, Iterator]]:
        """(key, ids, parts per text, numbers, the other parts) of each block of rows (id, text)."""
        import xxhash

        for batch in batches:
            for part in slices(batch, 1, TOGETHER):
                distinct, flat, starts = cut(part.column(1))
                numbers = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=self.known), len(self.known)), dtype=np.uint32)
                a = 0
                while a < part.num_rows:
                    b = max(int(np.searchsorted(starts, starts[a] + BLOCK, side="right")) - 1, a + 1)
                    rows, own = part.slice(a, b - a), flat[starts[a] : starts[b]]
                    text = rows.column(1)
                    name = xxhash.xxh3_128(repr(rows.column(0).to_pylist()).encode())
                    name.update(repr(pc.binary_length(text).to_pylist()).encode())
                    name.update("".join(text.to_pylist()).encode("utf-8", "surrogatepass"))
                    key = tuple(np.frombuffer(name.digest(), np.int64).tolist())
                    codes = numbers[own]
                    yield key, rows.column(0), np.diff(starts[a : b + 1]), codes, distinct.take(pa.array(own[codes == len(self.known)]))
                    a = b


def encode(
    docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """Per row: id, n_tokens, ids (decimal, with a space between) and decoded, both as text; with ``digests`` their SHA-256 instead.

    ``tokenizer`` is the path of a tokenizer file that every executor can read; left out, ``word_bpe_49k.json`` of the public tokenizers.
    """
    _checked(tokenizer_path(tokenizer))
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))

    words = encode_words(word_table(rows.select("__text")), tokenizer)
    table = durable(decode(words, "word", spark, tokenizer, keep=("n",)))
    known, sizes, id_texts, piece_texts = _lexicon(table)
    beyond = len(known)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for (a, b), ids, lengths, codes, others in _Blocks(known).of(batches):
            packed = zstandard.ZstdCompressor(level=1).compress(_planes(codes))
            one = [pa.array([x]) for x in (a, b, len(others))]
            of_texts = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            blobs = [pa.array([x], pa.binary()) for x in (lengths.astype("<i8").tobytes(), packed)]
            yield pa.RecordBatch.from_arrays([*one, of_texts, *blobs], ["a", "b", "n_others", "ids", "lengths", "codes"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, b), _, _, _, others in _Blocks(known).of(batches):
            n = len(others)
            arrays = [pa.array(np.full(n, a)), pa.array(np.full(n, b)), pa.array(np.arange(n, dtype=np.int32)), others.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "place", "word"])

    blocks = rows.mapInArrow(numbered, f"a bigint, b bigint, n_others bigint, ids array<{kind}>, lengths binary, codes binary")
    others = rows.mapInArrow(rare, "a bigint, b bigint, place int, word string")
    found = others.join(table.select("word", F.col("ids").alias("found")), "word")
    # equal blocks give equal parts at equal places, which the set takes once
    lists = found.groupBy("a", "b").agg(F.collect_set(F.struct("place", "found")).alias("others"))
    met = blocks.join(lists, ["a", "b"], "left").select("n_others", "ids", "lengths", "codes", "others")
    names = _vocabulary(tokenizer)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show = (lambda x: hashlib.sha256(x.encode()).hexdigest()) if digests else str
        size_of = np.append(sizes, 0)
        id_of, piece_of = ([*x.to_numpy(zero_copy_only=False), ""] for x in (id_texts, piece_texts))
        for batch in batches:
            for n, keys, lengths, packed, more in zip(*(batch.column(i) for i in range(5))):
                codes = _unplanes(packed.as_py())
                numbers, total = codes.tolist(), size_of[codes]
                ids, spelt = [id_of[c] for c in numbers], [piece_of[c] for c in numbers]
                places = np.flatnonzero(codes == beyond)
                came = more.as_py() if more.is_valid else []
                if not len(places) == len(came) == n.as_py():
                    raise RuntimeError("the texts were not read twice in the same blocks")
                for r in came:
                    at, of_part = places[r["place"]], r["found"].split()
                    ids[at], spelt[at], total[at] = r["found"], " ".join([names[int(i)] for i in of_part]), len(of_part)
                upto = np.concatenate([[0], np.cumsum(np.frombuffer(lengths.as_py(), "<i8"))])
                sums = np.concatenate([[0], np.cumsum(total)])[upto]
                spans = list(zip(upto.tolist(), upto[1:].tolist()))
                # parts without ids, such as white space beyond ASCII, leave no gap
                joined = lambda x: pa.array([show(" ".join(filter(None, x[a:b]))) for a, b in spans], pa.string())
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(np.diff(sums)), joined(ids), joined(spelt)], [id_col, "n_tokens", "ids", "decoded"])

    return met.mapInArrow(assembled, f"`{id_col}` {kind}, n_tokens bigint, ids string, decoded string")


def _vocabulary(tokenizer: str | None) -> list[str]:
    """The piece of each id, for a vocabulary whose ids have no gap or few."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path(tokenizer)).get_vocab(with_added_tokens=True)
    out = [""] * (max(found.values()) + 1)
    for piece, i in found.items():
        out[i] = piece
    return out


def _planes(codes: np.ndarray) -> bytes:
    """The three low bytes of the numbers, byte place by byte place, which compresses better."""
    raw = codes.astype("<u4").view(np.uint8).reshape(-1, 4)
    return raw[:, :3].T.tobytes()


def _unplanes(packed: bytes) -> np.ndarray:
    import zstandard

    low = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(3, -1)
    return low[0].astype(np.int64) | low[1].astype(np.int64) << 8 | low[2].astype(np.int64) << 16
