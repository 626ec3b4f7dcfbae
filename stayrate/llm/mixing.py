"""Mixing of sources to target weights.

1. The documents of a source are laid end to end, in the order of their ids, and cut into blocks of
   ``block`` words; a block is a run of words that may span documents.
2. The mix is a row of slots, dealt to output shards. For every shard the number of slots per source is drawn
   from the multinomial distribution of the target weights. Slots that a source draws beyond its
   target go to the sources that drew too few, so that the totals are the targets.
3. The n-th slot of a source is the (n mod blocks)-th entry of a pseudorandom permutation of its
   block indexes, with another permutation for every pass over the source. Blocks are joined by (source, index).

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share all words. No
target is above ``most`` times its source's size; the excess goes to the others by weight until none is above.
A source is passed over ``most`` times at most, so no document is taken more often.

Defined cases: a null or empty text has no words, and nothing is taken from it. A null source is a source of its own. Rows that
repeat an id are documents of their own (equal rows are interchangeable). With no words at all every target is 0. An empty
table gives an empty result. ``mix`` keeps all columns of the documents, so other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.functions.ordering import durable, number_rows, running_totals
from stayrate.llm.common import text_or_empty

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words of a block, and slots of an output shard.
BLOCK = 64
SHARD = 4096
#: Distinct sources that the plan is made for on the driver.
MAX_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space: the places where a word starts."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("bigint")


def shares(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """The target of each source: its part of all words by weight, at most ``most`` times its size."""
    total = float(sum(sizes))
    out = [0.0] * len(sizes)
    free, left = list(range(len(sizes))), total
    while free:
        weight = sum(weights[i % len(weights)] for i in free)
        over = [i for i in free if left * weights[i % len(weights)] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i % len(weights)] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def source_plan(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per source: number, source_size, target, blocks and slots."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    targets = shares([r["n"] for r in rows])
    plan = []
    for number, (r, target) in enumerate(zip(rows, targets)):
        blocks = -(-r["n"] // block)
        # slots are counted in full blocks, of which the last may be short
        slots = min(MOST * blocks, round(target / r["n"] * blocks) if r["n"] else 0)
        plan.append((r["source"], number, r["n"], target, blocks, slots))
    spark = sized.sparkSession
    kind = "source string, number int, source_size bigint, target double, blocks bigint, slots bigint"
    values = [F.struct(*[F.lit(v).cast(t.split()[1]).alias(t.split()[0]) for v, t in zip(p, kind.split(", "))]) for p in plan]
    if not values:
        return spark.range(0).select(*[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in kind.split(", ")])
    return spark.range(1).select(F.inline(F.array(*values)))


def _uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 53)) / float(1 << 53)


def draws(plan: DataFrame, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """Rows (shard, slot, number, turn): the source of each slot, and which of the source's slots it is.

    A slot's source is where its uniform number falls in the running weights: the counts of a shard are
    multinomial. ``turn`` counts the slots of a source, those beyond its number of slots stand in for a source that lacks some.
    """
    spark = plan.sparkSession
    rows = plan.orderBy("number").collect()
    total = sum(r["slots"] for r in rows)
    if not total:
        return spark.range(0).selectExpr("id as shard", "id as slot", "cast(id as int) as number", "id as turn")
    upto, edges = 0, []
    for r in rows:
        upto += r["slots"]
        edges.append(upto / total)
    edges[-1] = 1.0
    u = _uniform(F.lit(seed), F.col("id"))
    # the number of edges at or under u is the source's number
    slots = spark.range(total).select(
        "id", F.floor(F.col("id") / shard).cast("bigint").alias("shard"), _position(edges, u).alias("number")
    )
    counts = durable(slots.groupBy("shard", "number").agg(F.count(F.lit(1)).alias("n")))
    upto_shard = running_totals(counts, [F.col("shard").asc()], ["n"], groups=["number"])
    before = upto_shard.select("shard", "number", (F.col("n_run") - F.col("n")).alias("before"))
    within = Window.partitionBy("shard", "number").orderBy("id")
    placed = slots.withColumn("w", F.row_number().over(within)).join(before, ["shard", "number"])
    turns = durable(placed.select("id", "shard", "number", (F.col("before") + F.col("w") - 1).alias("turn")))

    drawn = {r["number"]: r["n"] for r in counts.groupBy("number").agg(F.sum("n").alias("n")).collect()}
    wanted = {r["number"]: r["slots"] for r in rows}
    limits = F.create_map(*[F.lit(x) for k, n in wanted.items() for x in (k, n)])
    beyond = F.col("turn") >= F.element_at(limits, F.col("number"))
    excess = number_rows(turns.where(beyond), [F.col("id").asc()], name="k")
    # which source the k-th slot beyond goes to: sources that lack slots, one after the other
    gaps, at = [], 0
    for k, n in wanted.items():
        lack = n - drawn.get(k, 0)
        if lack > 0:
            gaps.append((at, at + lack, k, n - lack))
            at += lack
    regular = turns.where(~beyond).select("shard", F.col("id").alias("slot"), "number", "turn")
    if not gaps:
        return regular
    gap = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("n"), F.lit(t).alias("t")) for a, b, k, t in gaps])
    hit = F.filter(gap, lambda g: (g["a"] < F.col("k")) & (F.col("k") <= g["b"])).getItem(0)
    moved = excess.select("shard", F.col("id").alias("slot"), hit["n"].alias("number"), (hit["t"] + F.col("k") - 1 - hit["a"]).cast("bigint").alias("turn"))
    return regular.unionByName(moved)


def _position(edges: list[float] | list[int], value: Column) -> Column:
    """How many of the ascending edges are at or under the value: a tree of conditions over short arrays."""

    def tree(low: int, high: int) -> Column:
        if high - low <= 32:
            return F.size(F.filter(F.array(*[F.lit(e) for e in edges[low:high]]), lambda e: e <= value)) + F.lit(low)
        middle = (low + high) // 2
        return F.when(value < edges[middle], tree(low, middle)).otherwise(tree(middle, high))

    return tree(0, len(edges))


def permutations(plan: DataFrame, seed: int = 0) -> DataFrame:
    """Rows (number, pass, rank, index): for each pass over a source, its block indexes in a pseudorandom order.

    The order is that of a hash of (seed, source, pass, index); ranks are counted over all tasks.
    """
    rows = plan.where("slots > 0").orderBy("number").collect()
    edges, starts, total = [], [], 0
    for r in rows:
        starts.append(total)
        total += r["blocks"] * -(-r["slots"] // r["blocks"])
        edges.append(total)
    if not total:
        return plan.sparkSession.range(0).selectExpr("cast(id as int) as number", "id as pass", "id as rank", "id as index")
    own = F.array(*[F.struct(F.lit(r["number"]).alias("number"), F.lit(a).cast("bigint").alias("start"), F.lit(r["blocks"]).alias("blocks")) for r, a in zip(rows, starts)])
    found = plan.sparkSession.range(total).select("id", F.get(own, _position(edges, F.col("id"))).alias("s"))
    i = F.col("id") - F.col("s.start")
    entries = found.select(F.col("s.number").alias("number"), F.floor(i / F.col("s.blocks")).cast("bigint").alias("pass"), (i % F.col("s.blocks")).alias("index"))
    order = F.xxhash64(F.lit(seed), "number", "pass", "index")
    return number_rows(entries, [order.asc(), F.col("index").asc()], groups=["number", "pass"], name="rank").withColumn("rank", F.col("rank") - 1)


def taken_blocks(plan: DataFrame, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """Rows (shard, slot, number, index, pass): which block of which source each slot of the mix holds."""
    slots = draws(plan, shard, seed).join(F.broadcast(plan.select("number", "blocks")), "number")
    turns = slots.select(
        "shard", "slot", "number", F.floor(F.col("turn") / F.col("blocks")).cast("bigint").alias("pass"), F.pmod("turn", "blocks").alias("rank")
    )
    return turns.join(permutations(plan, seed), ["number", "pass", "rank"]).select("shard", "slot", "number", "index", "pass")


def _laid(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents (key, id, source, size, upto) laid end to end per source, and the plan."""
    sized = durable(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_or_empty(text_col)).alias("size"),
            F.xxhash64(text_or_empty(text_col)).alias("mark"),
        )
    )
    laid = running_totals(sized, [F.col("id").asc_nulls_last(), F.col("mark").asc()], ["size"], groups=["source"])
    return laid.withColumnRenamed("size_run", "upto"), source_plan(sized)


def spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """The mix as spans (id, mark, source, size, upto, first, words, times) and the documents (…, source_size, target).

    A span is a run of words of one document inside one block, which the mix holds ``times`` times; spans that it does not
    hold are left out.
    """
    laid, plan = _laid(docs, id_col, text_col, source_col)
    laid = durable(laid)
    planned = laid.join(F.broadcast(plan), laid["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    times = taken_blocks(plan, seed=seed).groupBy("number", "index").agg(F.count(F.lit(1)).alias("times"))
    start = F.col("upto") - F.col("size")
    cut = (
        planned.where("size > 0")
        .select(
            "id", "mark", "source", "size", "upto", "number",
            F.explode(F.sequence(F.floor(start / block).cast("bigint"), F.floor((F.col("upto") - 1) / block).cast("bigint"))).alias("index"),
        )
        .join(times, ["number", "index"])
    )
    low = F.greatest(start, F.col("index") * block)
    high = F.least(F.col("upto"), (F.col("index") + 1) * block)
    return (
        cut.select("id", "mark", "source", "size", "upto", (low - start).alias("first"), (high - low).alias("words"), "times"),
        planned.select("id", "mark", "source", "size", "upto", "source_size", "target"),
    )


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, size, source_size, target and taken, the words that the mix takes, repeats counted."""
    found, laid = spans(docs, id_col, text_col, source_col)
    # documents with words differ in where they end in their source
    sums = found.groupBy("source", "upto").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    some = laid.where("size > 0").alias("d").join(
        sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.upto") == F.col("s.upto")), "left"
    )
    rows = some.select("d.id", "d.size", "d.source_size", "d.target", F.coalesce("s.taken", F.lit(0)).cast("bigint").alias("taken"))
    none = laid.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
    return rows.unionByName(none).withColumnRenamed("id", id_col)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as the mix holds them: a row for each pass that takes words of a document, with those words.

    Words that follow one another keep the white space between them.
    """
    found, _ = spans(docs, id_col, text_col, source_col)
    runs = (
        found.select("id", "mark", "size", "upto", "first", "words", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("copy"))
        .groupBy("id", "mark", "size", "upto", "copy")
        .agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("runs"))
        .select("id", "mark", "size", "copy", "runs", F.row_number().over(Window.partitionBy("id", "mark", "copy").orderBy("upto")).alias("nth"))
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    text = F.coalesce(F.col("__row").getField(text_col).cast("string"), F.lit(""))
    keyed = rows.select("__row", F.col("__row").getField(id_col).alias("__id"), F.xxhash64(text).alias("__mark"))
    own = F.row_number().over(Window.partitionBy("__id", "__mark").orderBy(F.xxhash64("__row")))
    keyed = keyed.withColumn("__nth", own)
    joined = keyed.join(
        runs, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__mark") == F.col("mark")) & (F.col("__nth") == F.col("nth"))
    )
    whole = (F.size("runs") > 0) & (F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r["words"]) == F.col("size"))
    parts = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"), F.lit(0))
    cut = F.array_join(
        F.flatten(F.transform("runs", lambda r: F.slice(F.col("__parts"), (r["first"] + 1).cast("int"), r["words"].cast("int")))), ""
    )
    with_parts = joined.select("__row", "runs", whole.alias("__whole"), F.when(~whole, parts).alias("__parts"))
    done = with_parts.select(
        "__row", F.when(F.col("__whole"), F.col("__row").getField(text_col)).otherwise(F.rtrim(cut)).alias("__text")
    )
    return done.select(*[(F.col("__text") if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns])
