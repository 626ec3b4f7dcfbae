"""Words and token ids of Arrow batches, one step per distinct word instead of one per occurrence."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slice of a batch ends at so many rows or characters, but holds one row at least.
SLICE_ROWS = 2000
SLICE_BYTES = 8_000_000
#: A word of plain characters is cut like the tokenizer cuts it, so that words share their parts.
_PLAIN = re.compile("[!-~\u00c0-\u017f]+")
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
#: Parts per call of the tokenizer.
_PER_CALL = 1000
#: Distinct words whose ids are remembered; beyond, the memory is emptied.
REMEMBERED = 400_000


def slices(batch: pa.RecordBatch, text: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with bounded text."""
    sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype=float))
    upto = np.concatenate([[0.0], np.cumsum(sizes)])
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(upto, upto[start] + most, side="right")) - 1
        end = min(max(end, start + 1), start + SLICE_ROWS, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, and where each text's words start (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    upto = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), upto[offsets]


def coded(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct words and the code of each word."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    found = words.dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(found.indices, dtype=np.int64)


#: Fixed value: the pattern by which a tokenizer file cuts the parts that words can share.
_SHARED_CUT = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


@functools.cache
def shares_parts(path: str) -> bool:
    """Whether a tokenizer file lower-cases, drops white space and cuts words as ``_PART`` does, so that texts can be put together from parts."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
    first = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    cut = (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
    return steps == ["NFC", "Replace", "Lowercase"] and cut and first["pattern"].get("Regex", "").endswith(_SHARED_CUT)


@functools.lru_cache(maxsize=1)
def encoder(path: str | None) -> Encoder:
    """The encoder of a worker process: later tasks of the process find the tokenizer and the words of earlier ones."""
    return Encoder(path)


class Encoder:
    """Token ids of texts: from parts that words share where the tokenizer file allows it, else of each whole text."""

    def __init__(self, path: str | None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.from_parts = shares_parts(path)
        self.words: dict[str, np.ndarray] = {}
        self.parts: dict[str, np.ndarray] = {}

    slices = staticmethod(slices)

    def _learn(self, parts: list[str]) -> None:
        """Ids of new parts. Each is one unit to the tokenizer, so a call can take many, set apart by spaces."""
        for i in range(0, len(parts), _PER_CALL):
            some = parts[i : i + _PER_CALL]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, owner = np.asarray(e.ids, dtype=np.int32), np.asarray(e.word_ids)
            cuts = np.searchsorted(owner, np.arange(len(some) + 1))
            self.parts.update((p, ids[a:b]) for p, a, b in zip(some, cuts, cuts[1:]))

    def _ids(self, distinct: list[str]) -> list[np.ndarray]:
        """Ids of each distinct word; words with characters beyond the plain ones go to the tokenizer whole."""
        if len(self.words) > REMEMBERED or len(self.parts) > REMEMBERED:
            self.words, self.parts = {}, {}
        words, parts = self.words, self.parts
        new = [w for w in distinct if w not in words]
        cut = [_PART.findall(w.lower()) if _PLAIN.fullmatch(w) and "<|" not in w else None for w in new]
        self._learn(list({p for c in cut if c for p in c if p not in parts}))
        for w, c in zip(new, cut):
            if c is None:
                words[w] = np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype=np.int32)
            else:
                words[w] = parts[c[0]] if len(c) == 1 else np.concatenate([parts[p] for p in c])
        return [words[w] for w in distinct]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if not self.from_parts:
            for text in pc.fill_null(texts, "").to_pylist():
                yield np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)
            return
        words, starts = split_words(texts)
        distinct, codes = coded(words)
        ids = self._ids(distinct)
        sizes = np.fromiter((len(x) for x in ids), dtype=np.int64, count=len(ids))
        pool = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        begins = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        within = np.arange(upto[-1]) - np.repeat(upto[:-1], lengths)
        flat = pool[np.repeat(begins[codes], lengths) + within]
        for a, b in zip(upto[starts[:-1]], upto[starts[1:]]):
            yield flat[a:b]
