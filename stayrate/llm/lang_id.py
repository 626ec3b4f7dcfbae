"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of the hashed character n-grams of its words; a linear softmax
on that average gives the language. Both are trained by stochastic gradient descent in numpy on a
bounded, hash-chosen sample of labelled rows (``per_language`` rows of each language). A part of that sample
calibrates: the temperature of the softmax, and the score under which a prediction is rejected.

Prediction reads every whole text. As everything before the softmax is linear, a trained model is one
table (bucket, language) of logits; a distinct word is looked at once per task, not once per occurrence.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and is not accepted. A null
label or id never trains. Repeated rows are predicted each. Without labelled rows every text is ``und``. An empty table gives an empty
result. The result has the id and flag columns asked for, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.tokens import REMEMBERED, coded, slices, split_words

BUCKETS = 1 << 15
DIM = 16
NGRAMS = (1, 2, 3, 4)
#: Bounds on what is trained on: rows of each language, and languages.
PER_LANGUAGE = 500
MAX_LANGUAGES = 256
UNKNOWN = "und"
_PRIME = np.uint64(0x100000001B3)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the lower-cased words, and how many each word has."""
    marked = [f"<{w.lower()}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(m) for m in marked), dtype=np.int64, count=len(marked))
    owner = np.repeat(np.arange(len(marked)), lengths)
    buckets, owners = [], []
    value = np.zeros(0, np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        size = max(len(codes) - n + 1, 0)
        value = codes + np.uint64(1) if n == 1 else value[:size] * _PRIME ^ codes[n - 1 :]
        if n in NGRAMS:
            inside = owner[:size] == owner[n - 1 :]
            mixed = value * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            buckets.append((mixed >> np.uint64(40))[inside] % np.uint64(BUCKETS))
            owners.append(owner[:size][inside])
    found, who = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return found[order], np.bincount(who, minlength=len(words))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their counts."""
    tokens, _ = split_words(pa.array([text]))
    distinct, codes = coded(tokens)
    if not distinct:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets, sizes = subwords(distinct)
    times = np.repeat(np.bincount(codes, minlength=len(distinct)), sizes)
    counts = np.bincount(buckets, weights=times, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used.astype(np.int32), counts[used].astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(sizes, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(bags: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Trains on bags (language, buckets, counts), a fifth of which calibrate."""
    bags = [b for b in bags if len(b[1])]
    languages = sorted({b[0] for b in bags})
    index = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    embed = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    out = np.zeros((DIM, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    order = rng.permutation(len(bags))
    held, train = order[: len(bags) // 5], order[len(bags) // 5 :]
    shares = [b[2] / b[2].sum() for b in bags]
    steps = max(1, epochs * len(train))
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            language, buckets, _ = bags[i]
            lr = rate * (1 - done / steps) + 0.01
            done += 1
            mean = shares[i] @ embed[buckets]
            g = _softmax(mean @ out + bias)
            g[index[language]] -= 1
            down = out @ g
            out -= lr * np.outer(mean, g)
            bias -= 0.1 * lr * g
            # a bucket's share is small, so its step is scaled up by the number of buckets
            embed[buckets] -= lr * len(buckets) ** 0.5 * np.outer(shares[i], down)
    model = Model(languages, (embed @ out).astype(np.float32), bias, 1.0, 0.0)
    if len(held) and len(languages) > 1:
        raw = np.array([shares[i] @ model.logits[bags[i][1]] for i in held])
        truth = np.array([index[bags[i][0]] for i in held])

        def loss(t: float) -> float:
            z = (raw + bias) / t
            z = z - z.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(truth)), truth]))

        model.temperature = min(np.geomspace(0.02, 20, 60), key=loss)
        p = model.probabilities(raw, np.ones(len(raw)))
        right = p.argmax(axis=1) == truth
        if right.any():
            model.reject_below = float(np.quantile(p.max(axis=1)[right], 0.005))
    return model


def train(
    docs: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> Model:
    """A model from about ``per_language`` rows of each language among the usable rows, chosen by a hash of the id."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r["l"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    cut = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1_000_000, 1_000_000 * per_language // n + 1))])
    chosen = rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < F.element_at(cut, F.col(lang_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [bag(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([b for b, _ in found], pa.list_(pa.int32())),
                        pa.array([c for _, c in found], pa.list_(pa.float32())),
                    ],
                    ["lang", "buckets", "counts"],
                )

    bags = (
        chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(run, "lang string, buckets array<int>, counts array<float>")
        .collect()
    )
    bags = [(r["lang"], np.asarray(r["buckets"], np.int64), np.asarray(r["counts"], np.float32)) for r in bags]
    return fit(sorted(bags, key=lambda b: (b[0], len(b[1]), b[1].tobytes(), b[2].tobytes())))


class WordLogits:
    """Summed logits of the distinct words seen so far, one row per word."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages) + 1), np.float32)

    def of(self, distinct: list[str]) -> np.ndarray:
        new = [w for w in distinct if w not in self.rows]
        if len(self.rows) + len(new) > REMEMBERED:
            self.rows, self.table, new = {}, self.table[:0], distinct
        if new:
            buckets, sizes = subwords(new)
            sums = np.add.reduceat(self.model.logits[buckets], np.cumsum(sizes) - sizes, axis=0)
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.table = np.concatenate([self.table, np.column_stack([sums, sizes]).astype(np.float32)])
        return self.table[np.fromiter((self.rows[w] for w in distinct), np.int64, len(distinct))]


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``keep`` with lang_pred, score and accepted (the score is not under the calibrated limit)."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    languages = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordLogits(model)
        for batch in batches:
            for part in slices(batch, len(keep)):
                text = part.column(len(keep))
                read = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                score = np.zeros(len(text))
                best = np.zeros(len(text), np.int64)
                if languages:
                    tokens, starts = split_words(text)
                    distinct, codes = coded(tokens)
                    per_word = known.of(distinct)[codes] if distinct else np.zeros((0, languages + 1), np.float32)
                    upto = np.concatenate([np.zeros((1, languages + 1)), np.cumsum(per_word, axis=0, dtype=np.float64)])
                    sums = upto[starts[1:]] - upto[starts[:-1]]
                    p = model.probabilities(sums[:, :-1], sums[:, -1])
                    best, score = p.argmax(axis=1), p.max(axis=1)
                read &= bool(languages)
                named = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, read)]
                score = np.where(read, score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(keep))], pa.array(named, pa.string()), pa.array(score), pa.array(read & (score >= model.reject_below))],
                    [*keep, "lang_pred", "score", "accepted"],
                )

    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, accepted boolean")
