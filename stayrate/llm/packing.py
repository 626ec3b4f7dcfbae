"""Sum-of-squares online packing of documents into fixed windows.

Each task packs its own rows: whole windows are cut off a document, and what is left goes to the fill
level that keeps the sum of squared counts of partly filled windows smallest. The state is one array
with a count per level, and the open windows of each level.

Documents wait in a queue until the queue holds more tokens than all open windows lack. At the end of
the task the queue therefore fills every open window exactly, by cutting; what remains is cut into
whole windows and, for the last part, into windows whose lengths are powers of two, which need no
padding either. The queue holds about as many tokens as the open windows lack, whatever the size of the task's input.

Defined cases: a null or empty text is the end id alone; a text longer than a window is cut; repeated
rows are packed each; an empty table gives no pieces. Rows are taken in the order in which the task
reads them, so a rerun over the same files agrees, and no window spans two tasks. Only the id and
text columns are read, so other columns never clash.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.tokens import encoder

WINDOW = 4096
END_ID = 2


class LevelArray:
    """Open windows by fill level. ``counts[l]`` is the number of windows filled to ``l`` (0 < l < size)."""

    def __init__(self, size: int, first_id: int) -> None:
        self.size = size
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = {}
        self.lacking = 0
        self.next_id = first_id

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for a piece shorter than a window."""
        size, counts = self.size, self.counts
        gain = counts[length:] - counts[: size - length + 1]
        # twice the change of the sum of squares, less what all choices share
        change = 2 * gain + 2
        change[size - length] -= 1
        change[0] = 2 * counts[length] + 1
        change[1:][counts[1 : size - length + 1] == 0] = np.iinfo(np.int64).max
        # of equal levels the fullest
        level = int(len(change) - 1 - np.argmin(change[::-1]))
        if level:
            window = self.take(level)
        else:
            window = self.new()
        self.put(window, level + length)
        return window, level

    def take(self, level: int) -> int:
        self.counts[level] -= 1
        self.lacking -= self.size - level
        return self.open[level].pop()

    def put(self, window: int, level: int) -> None:
        if level < self.size:
            self.counts[level] += 1
            self.lacking += self.size - level
            self.open.setdefault(level, []).append(window)

    def rest(self) -> list[tuple[int, int]]:
        """(level, window) of all open windows, fullest first."""
        return [(level, w) for level in sorted(self.open, reverse=True) for w in self.open[level]]


class Packer:
    """Packs a task's documents; rows come out as (key, start, ids, total, window, offset)."""

    def __init__(self, size: int, first_id: int) -> None:
        self.size = size
        self.levels = LevelArray(size, first_id)
        self.queue: deque[tuple[object, np.ndarray]] = deque()
        self.waiting = 0

    def add(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        self.queue.append((key, ids))
        self.waiting += len(ids)
        while self.queue and self.waiting - len(self.queue[0][1]) >= self.levels.lacking + self.size:
            yield from self._pack(*self.queue.popleft())

    def _pack(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        total = len(ids)
        self.waiting -= total
        whole = total - total % self.size
        for start in range(0, whole, self.size):
            yield key, start, ids[start : start + self.size], total, self.levels.new(), 0
        if whole < total:
            window, offset = self.levels.place(total - whole)
            yield key, whole, ids[whole:], total, window, offset

    def finish(self) -> Iterator[tuple]:
        """Fills the open windows from the queue and cuts the rest into windows without padding."""
        left = self.waiting
        spaces = []
        for level, window in self.levels.rest():
            room = min(self.size - level, left)
            spaces.append((window, level, room))
            left -= room
        while left:
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            spaces.append((self.levels.new(), 0, room))
            left -= room
        at = 0
        for key, ids in self.queue:
            start = 0
            while start < len(ids):
                while spaces[at][2] == 0:
                    at += 1
                window, level, room = spaces[at]
                n = min(room, len(ids) - start)
                yield key, start, ids[start : start + n], len(ids), window, level
                spaces[at] = (window, level + n, room - n)
                start += n


PIECES = "{id} {type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start in its document, length, CRC-32 of its ids, tokens of the document, window, offset.

    ``with_ids`` adds the ids themselves. ``tokenizer`` is the path of a tokenizer file that every
    executor can read; left out, it is ``word_bpe_49k.json`` of the public tokenizers.
    """
    kind = docs.schema[id_col].dataType
    schema = PIECES.format(id=f"`{id_col}`", type=kind.simpleString()) + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        packer = Packer(window, (task.partitionId() if task else 0) << 40)
        shared = encoder(tokenizer)
        key_type = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            keys, starts, ids, totals, windows, offsets = zip(*rows)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            long = lambda v: pa.array(v, pa.int64())
            columns = [pa.array(keys, key_type), long(starts), long([len(x) for x in ids]), long(crc), long(totals), long(windows), long(offsets)]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        rows: list[tuple] = []
        for batch in batches:
            key_type = batch.schema.field(0).type
            for part in shared.slices(batch):
                for key, ids in zip(part.column(0).to_pylist(), shared.encode(part.column(1))):
                    rows.extend(packer.add(key, np.append(ids, np.int32(end_id))))
                if len(rows) >= 4096:
                    yield table(rows)
                    rows = []
        rows.extend(packer.finish())
        if rows:
            yield table(rows)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
