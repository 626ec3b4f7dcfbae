"""Near duplicates by a signature-coordinate inverted join.

1. A document's five-word shingles are hashed; documents with equal shingle sets are one class, which
   its smallest id stands for. Each class has a signature of ``COORDINATES`` minimum hashes.
2. Classes are posted under every (coordinate, value). A pair with a similarity of 0.75 agrees on 36 of 48
   coordinates on average, with a deviation of 3; pairs that agree on ``MATCHES`` are candidates.
3. Rounds of leaders: in every posting the classes are paired with one leader only, so a posting with n
   classes gives n - 1 rows. Collisions per pair are counted, candidates are confirmed on full shingle
   sets, and confirmed links merge classes into groups. Postings inside one group are skipped from then on, since
   their pairs are linked already; so is a class with fewer than ``MATCHES`` coordinates left, which cannot be
   linked with another group. Each round chooses anew who leads; the rounds
   end when the postings hardly get fewer.
4. The rest is exact. The classes that are left meet, each in those of its shingles only that bring the fewest pairs together, as many as make sure that a linked pair meets in one (the prefix,
   by set size); what meets is confirmed,
   in crowded keys first with a few leaders only, which brings most of what is linked into one group.
5. Components of the confirmed links are the duplicate groups.

A link exactly at the threshold is missed with a probability of about 4e-6, a link at 0.8 with less
than 1e-8; a confirmed link is exact up to 64-bit hashes of shingles.

Defined cases: a null or empty text has no shingle and is linked with nothing; a text with one to four words is one shingle.
Ids are whole numbers. Rows that repeat an id with one shingle set are one document; with several sets they are several, each
compared and dropped on its own. Rows with a null id are linked with nothing and kept; ``groups`` shows them on request. Whole texts are read at any length. ``keep_one`` keeps all columns of
the rows it keeps, so other columns never clash. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.functions.ordering import durable
from stayrate.llm.graph import components
from stayrate.llm.tokens import slices, split_words

WORDS = 5
COORDINATES = 48
MATCHES = 22
ROUNDS = 5
#: A round of leaders that leaves more than this share of the postings it began with is the last; the last step does the rest.
SETTLING = 0.9
#: Leaders of a key in a round of the last step. Its rounds are for keys with more than so many pairs a row, and go on
#: while a round finds a link for one of so many of their classes.
LEADERS = 8
SPARSE = 4
LINKING = 16
#: Pairs of one leader that are confirmed together, so that its set moves once for so many.
TOGETHER = 256
#: Agreeing bits of the sketch under which a leader round does not look at a pair; the last step does.
#: 3.5 deviations under the mean at 0.75.
SKETCH_BITS = 48
SKETCH_AGREE = 34
#: Ratio of the bounds of a bucket of set sizes.
SIZE_STEP = 1.05

#: Numbers of further classes of an id with several sets.
SEVERAL = 1 << 62

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base * base and so on, modulo 2 to the 64th."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]), dtype=np.uint64)


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per word: a polynomial over a random number per byte value, from running sums over all bytes."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    cuts = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    of_byte = np.random.default_rng(977).integers(0, 2**64, 256, dtype=np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(of_byte[raw] * _powers(_BASE, len(raw))[:-1], out=sums[1:])
    return _finish((sums[cuts[1:]] - sums[cuts[:-1]]) * _powers(_UNBASE, len(raw))[cuts[:-1]])


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A-Z count as a-z."""
    words, starts = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = _word_hashes(words)
    rolled = np.zeros(max(len(hashes) - WORDS + 1, 0), np.uint64)
    for j in range(WORDS):
        rolled = _finish(rolled * np.uint64(31) + hashes[j : j + len(rolled)] + _MIX)
    for a, b in zip(starts, starts[1:]):
        if b - a >= WORDS:
            yield _distinct(rolled[a : b - WORDS + 1])
        elif b > a:
            value = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                value = _finish(value * np.uint64(31) + h + _MIX)
            yield value
        else:
            yield np.zeros(0, np.uint64)


def _set_hash(shingles: np.ndarray) -> tuple[int, int]:
    import xxhash

    return struct.unpack("<qq", xxhash.xxh128_digest(shingles.tobytes()))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1913)
    full = lambda: rng.integers(1, 2**63, COORDINATES, dtype=np.uint64)
    return full() * np.uint64(2) + np.uint64(1), full()


def signature(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum over the shingles of each coordinate's hash, cut to 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048]
        least = np.minimum(least, (part[None, :] * factors[:, None] + offsets[:, None]).min(axis=1))
    return (_finish(least) >> np.uint64(32)).astype(np.uint32)


def profiles(docs: DataFrame) -> DataFrame:
    """Rows (id, mark, n_shingles, set_a, set_b, sketch, signature) for the rows (id, text, mark).

    set_a and set_b are a 128-bit hash of the shingle set, null without shingles; the sketch has one bit of
    each of the first coordinates.
    """
    schema = "id bigint, mark bigint, n_shingles bigint, set_a bigint, set_b bigint, sketch bigint, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = _factors()
        weights = np.uint64(1) << np.arange(SKETCH_BITS, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch):
                n, a, b, sketch, sig = [], [], [], [], []
                for s in shingle_sets(part.column(1)):
                    n.append(len(s))
                    if not len(s):
                        a.append(None), b.append(None), sketch.append(None), sig.append(None)
                        continue
                    first, second = _set_hash(s)
                    m = signature(s, factors, offsets)
                    bits = (m[:SKETCH_BITS] & np.uint32(1)).astype(np.uint64)
                    a.append(first), b.append(second), sig.append(m.tobytes())
                    sketch.append(int((bits * weights).sum().astype(np.int64)))
                long = lambda v: pa.array(v, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), long(n), long(a), long(b), long(sketch), pa.array(sig, pa.binary())],
                    ["id", "mark", "n_shingles", "set_a", "set_b", "sketch", "signature"],
                )

    return docs.mapInArrow(run, schema)


def postings(classes: DataFrame) -> DataFrame:
    """Rows (token, id): a class under each of its coordinate-value pairs, in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            ids = np.asarray(batch.column(0), dtype=np.int64)
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            tokens = (values.astype(np.uint64) + place[None, :]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens.ravel()), pa.array(np.repeat(ids, COORDINATES))], ["token", "id"]
            )

    return classes.select("id", "signature").mapInArrow(run, "token bigint, id bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= 75 * union.

    The pairs of an a are dealt to parts of about ``TOGETHER``. The set of b moves with its pair, that of a once per part.
    """
    often = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts")).where("parts > 1")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("b"), F.col("parts"))).otherwise(0).cast("bigint")
    dealt = durable(pairs.join(often, "a", "left").select("a", "b", part.alias("part")))
    none = F.lit(None).cast("bigint")
    firsts = dealt.select("a", "part").distinct().withColumn("b", none)
    # one join brings the sets: a part's first row that of a, all others that of b
    rows = dealt.unionByName(firsts).withColumn("id", F.coalesce("b", "a"))
    met = rows.join(sets, "id").select("a", "part", "b", "hashes")
    ordered = met.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, part, b = (batch.column(i).to_pylist() for i in range(3))
            keep = []
            for key, other, v in zip(zip(a, part), b, batch.column(3)):
                hashes = np.frombuffer(v.as_buffer(), np.uint64)
                if other is None:
                    now, x = key, hashes.copy()
                    keep.append(False)
                    continue
                if key != now:
                    raise ValueError("a pair without its set")
                both = len(np.intersect1d(x, hashes, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(hashes) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return durable(ordered.mapInArrow(run, "a bigint, b bigint"))


def _set_table(ids: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (id, hashes) of the classes with these ids. Texts are read once for it, and the table is written once."""
    wanted = classes.join(ids, "id", "left_semi").select(F.col("id").alias("class_id"), F.col("lead").alias("id"), "mark", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), shingle_sets(part.column(1)))
                found = [(i, s.tobytes()) for i, a, b, s in rows if _set_hash(s) == (a, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in found], pa.int64()), pa.array([h for _, h in found], pa.binary())], ["id", "hashes"]
                )

    texts = docs.join(wanted, ["id", "mark"]).select(F.col("class_id").alias("id"), "text", "set_a", "set_b")
    return durable(texts.mapInArrow(run, "id bigint, hashes binary").dropDuplicates(["id"]))


def _small_enough(x: str, y: str) -> Column:
    """Set sizes that allow a similarity of 0.75."""
    return (4 * F.col(x) >= 3 * F.col(y)) & (4 * F.col(y) >= 3 * F.col(x))


def _joined(live: DataFrame, stars: DataFrame) -> DataFrame:
    """The postings with the group that each class is in by now."""
    groups_now = stars.withColumnRenamed("node", "id")
    return live.join(groups_now, "id", "left").select("id", "token", "hub", F.coalesce("component", "id").alias("part"))


def _led(live: DataFrame, salt: int) -> DataFrame:
    """The postings with classes of several groups, with a leader each.

    In the first round the class with most shared coordinates leads: the text that near copies were made
    from shares all of its own. Later the least salted hash leads.
    """
    mine = F.xxhash64(F.lit(salt), "id")
    rank = F.struct((-F.col("hub") if salt == 0 else mine).alias("h"), mine.alias("k"), "id", "part")
    leaders = live.groupBy("token").agg(F.min(rank).alias("l"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi")
    return live.join(leaders.select("token", F.col("l.id").alias("leader"), F.col("l.part").alias("lead")), "token")


def _collisions(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of a posting's leader and a class of another group, with the number of collisions."""
    apart = met.where("part != lead")
    return apart.groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _enough(postings_left: DataFrame, name: str = "m") -> DataFrame:
    """Rows (id, m) of the classes that have coordinates enough for a link."""
    return postings_left.groupBy("id").agg(F.count(F.lit(1)).alias(name)).where(F.col(name) >= MATCHES)


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """For rows (id, text, mark): documents (id, set_a, set_b, n_shingles, class_id), confirmed links (a, b) between classes, their groups (node, component), and the profiles.

    Groups only grow, so a posting inside one group and a class with too few other postings are done
    with for good: each round reads only what the round before left. A document is an id with one of its sets; one without shingles has no class. A class
    has its smallest id as a number; of several classes with one smallest id all but one get a number from 2 ** 62 on.
    """
    seen = durable(profiles(docs))
    rows = seen.groupBy("id", "set_a", "set_b").agg(F.max("n_shingles").alias("n_shingles"))
    leads = rows.where("set_a is not null").groupBy("set_a", "set_b").agg(F.min("id").alias("lead"))
    firsts = leads.groupBy("lead").agg(F.min(F.struct("set_a", "set_b")).alias("first"))
    own = F.struct("set_a", "set_b") == F.col("first")
    number = F.xxhash64("lead", "set_a", "set_b").bitwiseAND(F.lit(SEVERAL - 1)).bitwiseOR(F.lit(SEVERAL))
    named = durable(leads.join(firsts, "lead").select("set_a", "set_b", "lead", F.when(own, F.col("lead")).otherwise(number).alias("class_id")))
    members = durable(rows.join(named, ["set_a", "set_b"], "left").select("id", "set_a", "set_b", "n_shingles", "class_id"))
    led = named.select(F.col("lead").alias("id"), "set_a", "set_b", "class_id")
    classes = durable(
        seen.join(led, ["id", "set_a", "set_b"]).dropDuplicates(["class_id"]).select(
            F.col("class_id").alias("id"), F.col("id").alias("lead"), "mark", "n_shingles", "set_a", "set_b", "sketch", "signature"
        )
    )
    posted = postings(classes)
    counted = posted.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = durable(posted.join(counted.select("token"), "token"))

    sizes = classes.select("id", "n_shingles", "sketch")
    able = durable(_enough(shared, "hub"))
    sets = _set_table(able.select("id"), docs, classes)
    live = durable(shared.join(able, "id").select("id", "token", "hub", F.col("id").alias("part")))
    found = stars = before = None
    for salt in range(ROUNDS):
        met = durable(_led(live, salt))
        left = met.count()
        if before is not None and left > SETTLING * before:
            break
        before = left
        pairs = _collisions(met).where(F.col("n") >= MATCHES // 2)
        pairs = durable(_plausible(pairs.select("a", "b"), sizes))
        new = _confirmed(pairs, sets)
        stars = components(new if stars is None else _edges(stars).unionByName(new))
        found = new if found is None else found.unionByName(new)
        live = durable(_joined(met.join(_enough(met), "id", "left_semi"), stars))
        if live.isEmpty():
            return members, found, stars, seen
    new, stars = _rest(live, stars, sets, classes)
    return members, found.unionByName(new), stars, seen


def _edges(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("mark", _mark("text"))


def _mark(text: str | Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(text)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (id, set_a, set_b, n_shingles, class_id) and confirmed links (a, b) between classes."""
    members, found, *_ = _linked(_documents(docs, id_col, text_col).where("id is not null"))
    return members, found


def _plausible(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    a = sizes.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    b = sizes.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    agree = F.lit(SKETCH_BITS) - F.bit_count(F.col("sa").bitwiseXOR(F.col("sb")))
    return pairs.join(a, "a").join(b, "b").where(_small_enough("na", "nb") & (agree >= SKETCH_AGREE)).select("a", "b")


def _open_classes(shared: DataFrame) -> DataFrame:
    """Rows (id, part) of the classes that can still be linked with another group."""
    mixed = shared.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi")
    left = shared.join(mixed.select("token"), "token", "left_semi")
    return _enough(left).select("id").join(shared.select("id", "part").distinct(), "id")


def _bucket(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / math.log(SIZE_STEP)).cast("int")


def _shingles(sets: DataFrame, able: DataFrame) -> DataFrame:
    """Rows (id, shingle, part) of the classes (id, part); a class gets its group before its set is spread out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                hashes = np.frombuffer(v.as_buffer(), np.int64)
                columns = [pa.array(np.full(len(hashes), i)), pa.array(hashes), pa.array(np.full(len(hashes), part))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "shingle", "part"])

    held = sets.join(able.select("id", "part"), "id").select("id", "part", "hashes")
    return held.mapInArrow(run, "id bigint, shingle bigint, part bigint")


def _prefixes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (id, part, n, own, common) for rows (id, shingle, part): the classes that may be linked with another group, with the
    shingles that they share with one, those first that bring the fewest pairs of different groups together.

    A class is one row here; ``_posted`` spreads it out, so that a new group is told once per class.
    """
    held = rows.groupBy("shingle", "part").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("shingle")
    met_in = (F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("f")
    often = held.agg(met_in, F.count(F.lit(1)).alias("parts")).where("parts > 1")
    order = F.array_sort(F.collect_list(F.struct("f", "shingle")))
    met = rows.join(often.select("shingle", "f"), "shingle").groupBy("id", "part").agg(order["shingle"].alias("common"))
    sized = met.join(classes.select("id", F.col("n_shingles").alias("n")), "id").where(4 * F.size("common") >= 3 * F.col("n"))
    return durable(sized.select("id", "part", "n", _bucket(F.col("n")).alias("own"), "common"))


def _posted(prefixes: DataFrame) -> DataFrame:
    """Rows (key, id, part, n, own, ahead): the classes under what a linked class of another group must share one of.

    A pair of sizes n and m shares 3 (n + m) / 7 shingles at least, so it meets in the n - 3 (n + m) / 7 + 1
    first ones of either side. Classes are posted per bucket of partner sizes; shingles inside one
    group are not posted at all. ``ahead`` counts a class's posted shingles from this one on.
    """
    partner = prefixes.select(
        "*", F.explode(F.sequence(_bucket(F.floor(F.col("n") * 0.75)), _bucket(F.ceil(F.col("n") / 0.75)))).alias("other")
    )
    need = F.ceil(3 * (F.col("n") + F.floor(F.pow(F.lit(SIZE_STEP), F.col("other")))) / 7)
    count = (F.size("common") - need + 1).cast("int")
    posted = partner.where(count > 0).select(
        "id", "part", "n", "own", "other", F.size("common").alias("all"), F.posexplode(F.slice("common", F.lit(1), count)).alias("at", "shingle")
    )
    key = F.struct("shingle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return posted.select(key.alias("key"), "id", "part", "n", "own", (F.col("all") - F.col("at")).alias("ahead"))


def _may_link(x: str, y: str) -> Column:
    """Rows of one key whose classes can be linked and have not met in a key before."""
    sides = (F.col("key.low") == F.col("key.high")) | (F.col(f"{x}.own") != F.col(f"{y}.own"))
    # at the first shingle that a pair shares, both still have all shared ones ahead
    reach = 7 * F.least(f"{x}.ahead", f"{y}.ahead") >= 3 * (F.col(f"{x}.n") + F.col(f"{y}.n"))
    return sides & reach & (F.col(f"{x}.part") != F.col(f"{y}.part")) & _small_enough(f"{x}.n", f"{y}.n")


def _regrouped(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """The rows with the group that each class is in by now."""
    now = stars.withColumnRenamed("node", "id")
    return rows.join(now, "id", "left").withColumn("part", F.coalesce("component", "part")).drop("component")


def _rest(shared: DataFrame, stars: DataFrame, sets: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) between what is left, exact, and the groups (node, component) with them.

    Classes meet by prefixes of their full sets. Rounds first pair the classes of crowded keys with a few leaders of each,
    which merges what is linked; then all pairs of different groups that still meet are confirmed. The prefixes are
    chosen once: they hold for every pair of different groups, also when there are fewer groups later.
    """
    able = durable(_open_classes(shared))
    first = _prefixes(_shingles(sets, able), classes)
    crowded = durable(_crowded(_posted(first)))
    many = crowded.select("id").distinct().count()
    found, salt, linked = None, 0, many
    while linked * LINKING >= many > 0:
        new = _confirmed(durable(_apart(_leader_pairs(crowded, salt), stars)), sets)
        stars = components(_edges(stars).unionByName(new))
        found = new if found is None else found.unionByName(new)
        salt, linked = salt + 1, new.count()
    posted = _posted(first if found is None else durable(_regrouped(first, stars)))
    x, y = posted.alias("x"), posted.alias("y")
    met = x.join(y, ["key"]).where((F.col("x.id") > F.col("y.id")) & _may_link("x", "y"))
    pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    new = _confirmed(durable(pairs), sets)
    return new if found is None else found.unionByName(new), components(_edges(stars).unionByName(new))


def _crowded(posted: DataFrame) -> DataFrame:
    """Rows (key, even, id, part, n, own, ahead) of the keys in which several groups and more than ``SPARSE`` pairs a row meet.

    ``even`` is whether both sides of a key have the same bucket of sizes; the key is one number here.
    """
    each = Window.partitionBy("key")
    held = posted.withColumns({"rows": F.count(F.lit(1)).over(each), "lo": F.min("part").over(each), "hi": F.max("part").over(each)})
    even = (F.col("key.low") == F.col("key.high")).alias("even")
    several = held.where((F.col("lo") != F.col("hi")) & (F.col("rows") - 1 > 2 * SPARSE))
    return several.select(F.xxhash64("key").alias("key"), even, "id", "part", "n", "own", "ahead")


def _leader_pairs(crowded: DataFrame, salt: int) -> DataFrame:
    """Pairs (a, b) of a key's leaders, the least by a salted hash of the id, and the classes that they may be linked with."""
    leaders = LEADERS
    ordered = crowded.repartition("key").sortWithinPartitions("key", F.xxhash64(F.lit(salt), "id"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            key, even, ids, part, n, own, ahead = columns
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            start = np.repeat(first, np.diff(np.append(first, len(key))))
            place = np.arange(len(key)) - start
            pairs = [np.zeros((0, 2), np.int64)]
            for j in range(leaders):
                y = np.flatnonzero(place > j)
                x = start[y] + j
                ok = (part[x] != part[y]) & (even[y] | (own[x] != own[y])) & (4 * n[x] >= 3 * n[y]) & (4 * n[y] >= 3 * n[x])
                ok &= 7 * np.minimum(ahead[x], ahead[y]).astype(np.int64) >= 3 * (n[x] + n[y])
                pairs.append(np.stack([ids[x[ok]], ids[y[ok]]], axis=1))
            # a key that goes on in the next batch keeps its leaders
            held = [c[first[-1] : first[-1] + leaders] for c in columns]
            met = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(met[:, 0]), pa.array(met[:, 1])], ["a", "b"])

    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def _apart(pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes are in different groups by now."""
    for side in ("a", "b"):
        now = stars.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        pairs = pairs.join(now, side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    return pairs.where("of_a != of_b").select("a", "b")


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows (id, text, mark): documents (id, set_a, set_b, n_shingles, component_id, kept), and the profiles."""
    members, _, parts, seen = _linked(rows)
    joined = members.join(parts.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    grouped = joined.select("id", "set_a", "set_b", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("group"))
    # where several classes have one smallest id, that id may have more than one of its texts in a group: one stays
    numbered = grouped.where(F.col("class_id") >= SEVERAL).select("group").distinct()
    best = grouped.join(numbered, "group", "left_semi").groupBy("group").agg(F.min(F.struct("id", "class_id")).alias("best"))
    smallest = F.coalesce("best.id", "group", "id")
    stays = (F.col("id") == smallest) & (F.col("best").isNull() | (F.col("class_id") == F.col("best.class_id")))
    out = grouped.join(best, "group", "left").select(
        "id", "set_a", "set_b", "n_shingles", smallest.alias("component_id"), F.coalesce(stays, F.lit(True)).alias("kept")
    )
    return out, seen


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = False) -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id reachable) and kept (it is the smallest).

    ``null_ids`` adds the rows without an id, each for itself and without a component.
    """
    rows = _documents(docs, id_col, text_col)
    out = _grouped(rows.where("id is not null"))[0].select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")
    if not null_ids:
        return out
    alone = profiles(rows.where("id is null"))
    none = F.lit(None).cast("bigint")
    return out.unionByName(alone.select(none.alias(id_col), "n_shingles", none.alias("component_id"), F.lit(True).alias("kept")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that a smaller id stands for, with all their columns. A row goes by its own text's group."""
    grouped, seen = _grouped(_documents(docs, id_col, text_col).where("id is not null"))
    gone = grouped.where(~F.col("kept")).select("id", "set_a", "set_b")  # a text without shingles stays
    dropped = seen.join(gone, ["id", "set_a", "set_b"], "left_semi").select(F.col("id").alias("__gone"), F.col("mark").alias("__mark"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    of = lambda c: F.col("__row").getField(c)
    left = rows.join(dropped, (of(id_col).cast("bigint") == F.col("__gone")) & (_mark(of(text_col).cast("string")) == F.col("__mark")), "left_anti")
    return left.select(*[of(c).alias(c) for c in docs.columns])
