"""Scores of whole texts by a gated recurrent language model learnt from the corpus.

1. All training texts are counted: per task in Arrow, then by a partial and a final aggregation.
2. The most frequent tokens (a fixed number) make the vocabulary; the other counts stay a table.
3. Every training text is read once by truncated backpropagation. Tasks learn side by side from a
   common start; their models are averaged in two levels, so that only about the square root of the number of
   tasks reaches the driver. A first round on an eighth of the texts gives the second round its start.
4. Every text is scored with the state carried across windows. Tokens outside the vocabulary get
   their counts by a join on the token.

Defined cases: a null or empty text is the end token alone. A null id is held out of nothing and
trains as its text does only if the caller's condition says so. Repeated rows are counted, learnt from and scored
each. Without training texts the counts are zero and the start model scores. An empty table gives an
empty result. The result has the columns asked for, so other columns never clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.ordering import durable
from stayrate.llm.gru import END, HEAD, TAIL_CLASSES, Net, Reader, Vocabulary, tail_class, texts_of
from stayrate.llm.tokens import REMEMBERED, slices, split_words

#: Tokens whose counts every task holds.
LEXICON = 65_536
#: Share of the training texts that the first round reads.
FIRST_SHARE = 8
RATE = 0.005


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (word, n) over all texts, one end token for each. The table is written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                words, _ = split_words(pc.ascii_lower(part.column(0)))
                held[END] = held.get(END, 0) + part.num_rows
                counted = pc.value_counts(words)
                for w, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist()):
                    held[w] = held.get(w, 0) + n
                if len(held) > REMEMBERED:
                    yield out()
                    held = {}
        if held:
            yield out()

    parts = docs.select(_text(text_col)).mapInArrow(run, "word string, n bigint")
    return durable(parts.groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(counts: DataFrame) -> Vocabulary:
    top = counts.orderBy(F.col("n").desc(), "word").limit(LEXICON).collect()
    words, numbers = [r["word"] for r in top], np.array([r["n"] for r in top], dtype=np.float64)
    head = min(HEAD, len(words))
    ending = F.pmod(F.crc32(F.expr("right(word, 2)").cast("binary")), F.lit(TAIL_CLASSES)).alias("k")
    rows = counts.groupBy(ending).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tokens, distinct = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in rows:
        tokens[r["k"]], distinct[r["k"]] = r["n"], r["v"]
    n, v = int(tokens.sum()), int(distinct.sum())
    for w, c in zip(words[:head], numbers[:head]):
        tokens[tail_class(w)] -= c
        distinct[tail_class(w)] -= 1
    return Vocabulary(words, numbers, head, tokens, distinct, n, v)


def _learn_round(docs: DataFrame, v: Vocabulary, net: Net, rate: float) -> Net:
    """The average, weighted by tokens, of the models that the tasks have learnt from their texts."""
    start = net.vector

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(v, Net(v.head, start.copy()), rate)
        for batch in batches:
            for part in slices(batch, 0):
                for text in texts_of(v, range(part.num_rows), pc.ascii_lower(part.column(0))):
                    for _ in reader.add(text):
                        pass
        for _ in reader.finish():
            pass
        if reader.seen:
            task = TaskContext.get()
            yield pa.RecordBatch.from_arrays(
                [pa.array([task.partitionId() if task else 0], pa.int64()), pa.array([float(reader.seen)]), pa.array([(reader.net.vector * np.float64(reader.seen)).tobytes()])],
                ["part", "weight", "vector"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0.0, np.zeros(len(start))
        for batch in batches:
            for w, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                weight, total = weight + w, total + np.frombuffer(x)
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([weight]), pa.array([total.tobytes()])], ["part", "weight", "vector"])

    schema = "part bigint, weight double, vector binary"
    rows = docs.select(F.col("__text"))
    tasks = max(1, rows.rdd.getNumPartitions())
    learnt = rows.mapInArrow(learn, schema).repartition(max(1, math.isqrt(tasks)), "part").mapInArrow(add, schema).collect()
    if not learnt:
        return net
    total = sum(np.frombuffer(r["vector"]) for r in sorted(learnt, key=lambda r: bytes(r["vector"])))
    return Net(v.head, (total / sum(r["weight"] for r in learnt)).astype(np.float32))


def train(docs: DataFrame, v: Vocabulary, text_col: str = "text", rate: float = RATE) -> Net:
    """Reads every text once; the first round takes those whose hash falls into the first share."""
    net = Net.start(v)
    first = F.pmod(F.xxhash64("__text"), F.lit(FIRST_SHARE)) == 0
    rows = docs.select(_text(text_col))
    net = _learn_round(rows.where(first), v, net, rate)
    return _learn_round(rows.where(~first), v, net, rate)


def score(docs: DataFrame, trains: Column, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``keep`` with n_tokens, n_known, train_tokens, base_score and score (log10) of every text.

    ``trains`` says which rows the counts and the model come from.
    """
    learning = docs.where(F.coalesce(trains, F.lit(False)))
    counts = token_counts(learning, text_col)
    v = vocabulary(counts)
    net = train(learning, v, text_col)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        reader = Reader(v, net)
        number = (task.partitionId() if task else 0) << 40
        pending: dict[int, tuple] = {}
        done: list = []

        def out() -> pa.RecordBatch:
            rows = [pending.pop(t.key) for t in done]
            columns = [pa.array([t.key for t in done], pa.int64())]
            columns += [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(keep))]
            columns += [
                pa.array([len(t.c) for t in done], pa.int64()),
                pa.array([t.logs for t in done]),
                pa.array([t.score / math.log(10) + t.rest for t in done]),
                pa.array([t.rare for t in done], pa.list_(pa.string())),
            ]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["__row", *keep, "__tokens", "__logs", "__score", "__rare"])

        kinds: list = []
        for batch in batches:
            kinds = [f.type for f in batch.schema][: len(keep)]
            for part in slices(batch, len(keep)):
                keys = range(number, number + part.num_rows)
                number += part.num_rows
                pending.update(zip(keys, zip(*[part.column(i).to_pylist() for i in range(len(keep))])))
                for text in texts_of(v, keys, pc.ascii_lower(part.column(len(keep)))):
                    done.extend(reader.add(text))
                    if len(done) >= 2000:
                        yield out()
        done.extend(reader.finish())
        if done:
            yield out()

    schema = f"__row bigint, {fields}, __tokens bigint, __logs double, __score double, __rare array<string>"
    scored = durable(docs.select(*keep, _text(text_col)).mapInArrow(run, schema))
    rare = (
        scored.select("__row", F.explode("__rare").alias("word"))
        .join(counts, "word")
        .groupBy("__row")
        .agg(F.sum(F.log10(F.col("n") + 1.0)).alias("__add"), F.count(F.lit(1)).alias("__found"))
    )
    whole = scored.select("__row", *keep, "__tokens", "__logs", "__score", F.size("__rare").alias("__n_rare")).join(rare, "__row", "left")
    more = F.coalesce("__add", F.lit(0.0))
    return whole.select(
        *keep,
        F.col("__tokens").alias("n_tokens"),
        (F.col("__tokens") - F.col("__n_rare") + F.coalesce("__found", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(v.n).cast("bigint").alias("train_tokens"),
        (F.col("__logs") + more - F.col("__tokens") * math.log10(v.n + v.v + 1)).alias("base_score"),
        (F.col("__score") + more).alias("score"),
    )
