"""A trie of conversation prefixes from vertical bitmaps.

1. A turn is a digest of its role and text with the number of its code points; a conversation is the array of its
   turns in order. Texts do not go any further.
2. Conversations are dealt to shards by ranges of ``SHARD`` ids. A shard indexes every (position, turn) to a bitset of
   the conversations that have it there, and every length to a bitset of those that end there.
3. A depth-first walk intersects the bitset of a node with the postings at its position: every result that is not
   empty is a child. Popcounts, smallest members and end bitsets of the shards are merged per node, whose name is a
   128-bit hash chained over its path.
4. A second walk adds up what lies below a node. Each node counts once, in the shard of its smallest member: along a
   conversation the nodes that it is the smallest member of are the deepest ones, so one depth per conversation says which.

A shard is the unit of memory: the turns of ``SHARD`` conversations at 24 bytes and more. The end list of a node is a bitset of 64
bytes per shard, however many conversations end there; only ``end_digests`` reads the list of a node in one task,
as a stream, since a SHA-256 has to be taken in order.

Defined cases: rows without a conversation id belong to no conversation. Null roles and texts are empty. Turns are ordered by
number, null first, ties by their digest; repeated rows are turns each. A conversation may have no turn and
then ends at the root. Without conversations there is no node. Only the four named columns are read, so
other columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.ordering import durable

#: Conversation ids of a shard.
SHARD = 512
ROOT = bytes(16)
_NEVER = 1 << 62


@dataclass(frozen=True)
class Trie:
    """``nodes`` has one row per prefix; ``ends`` the bitsets of the conversations that end at a node, by shard."""

    nodes: DataFrame
    ends: DataFrame


def conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Rows (conv_id, turns): the turns (turn, digest, chars) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.char_length(text).cast("bigint").alias("chars"))
    said = rows.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv_id"), turn.alias("t"))
    return said.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


class _Shard:
    """The vertical index of a shard and its walk."""

    def __init__(self, offsets: list[int], digests: list[list[bytes]], chars: list[list[int]]) -> None:
        self.digests, self.chars = dict(zip(offsets, digests)), dict(zip(offsets, chars))
        self.postings: list[dict[bytes, int]] = [{} for _ in range(max(map(len, digests), default=0))]
        self.ends: dict[int, int] = {}
        for offset, turns in self.digests.items():
            bit = 1 << offset
            self.ends[len(turns)] = self.ends.get(len(turns), 0) | bit
            for at, digest in zip(self.postings, turns):
                at[digest] = at.get(digest, 0) | bit

    def walk(self) -> Iterator[tuple[bytes, int, int, int, int]]:
        """(node, place of its parent in this order, depth, members, code points), parents before children."""
        everyone = 0
        for bits in self.ends.values():
            everyone |= bits
        places, waiting = 0, [(ROOT, -1, 0, everyone, 0)]
        while waiting:
            node, _, depth, members, _ = found = waiting.pop()
            yield found
            place, places = places, places + 1
            left = members & ~self.ends.get(depth, 0)
            while left:
                one = (left & -left).bit_length() - 1
                digest = self.digests[one][depth]
                child = members & self.postings[depth][digest]
                name = hashlib.blake2b(node + digest, digest_size=16).digest()
                waiting.append((name, place, depth + 1, child, self.chars[one][depth]))
                left &= ~child


def _shards(convs: DataFrame, *more: str) -> DataFrame:
    """Conversations with their shard, side by side and in order inside a task."""
    start = F.col("conv_id") - F.pmod("conv_id", F.lit(SHARD))
    turns = (F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("chars"))
    return convs.select(start.alias("shard"), "conv_id", *turns, *more).repartition("shard").sortWithinPartitions("shard", "conv_id")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """(first id, columns) of each shard from rows that are ordered by shard."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[0] != now and held:
                yield now, [list(c) for c in zip(*held)]
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield now, [list(c) for c in zip(*held)]


def _index(start: int, columns: list[list]) -> _Shard:
    return _Shard([c - start for c in columns[0]], columns[1], columns[2])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _counted(convs: DataFrame) -> DataFrame:
    """Rows (node, parent, depth, conv_id, n_convs, n_ends) of all shards together."""
    schema = pa.schema(
        [("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_ends", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for start, columns in _by_shard(batches):
                shard, names = _index(start, columns), []
                for node, parent, depth, members, _ in shard.walk():
                    names.append(node)
                    least = start + (members & -members).bit_length() - 1
                    ended = members & shard.ends.get(depth, 0)
                    yield node, names[parent] if depth else None, depth, least, members.bit_count(), ended.bit_count()

        return _batches(rows(), schema)

    found = _shards(convs).mapInArrow(run, "node binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, n_ends bigint")
    return found.groupBy("node").agg(
        F.max("parent").alias("parent"),
        F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_ends").alias("n_ends"),
    )


def _below(convs: DataFrame) -> DataFrame:
    """Rows (node, shard, saved_tokens, n_leaves, ends) per shard, for conversations with (top, leaf).

    ``top`` is the least depth at which the conversation is the smallest member of its node, ``leaf`` tells whether
    the deepest such node has no child.
    """
    schema = pa.schema([("node", pa.binary()), ("shard", pa.int64()), ("saved_tokens", pa.int64()), ("n_leaves", pa.int64()), ("ends", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for start, columns in _by_shard(batches):
                shard = _index(start, columns)
                top = {c - start: t for c, t in zip(columns[0], columns[3])}
                leaf = {c - start: x for c, x in zip(columns[0], columns[4])}
                order = list(shard.walk())
                saved, leaves = [0] * len(order), [0] * len(order)
                for i in range(len(order) - 1, -1, -1):
                    _, parent, depth, members, chars = order[i]
                    least = (members & -members).bit_length() - 1
                    stands = depth >= top[least]
                    saved[i] += (members.bit_count() - stands) * chars
                    leaves[i] += stands and leaf[least] and depth == len(shard.digests[least])
                    if depth:
                        saved[parent] += saved[i]
                        leaves[parent] += leaves[i]
                for (node, _, depth, members, _), s, n in zip(order, saved, leaves):
                    ended = members & shard.ends.get(depth, 0)
                    yield node, start, s, n, ended.to_bytes(SHARD // 8, "little") if ended else None

        return _batches(rows(), schema)

    standing = convs.withColumns({"top": F.coalesce("top", F.lit(_NEVER)), "leaf": F.coalesce("leaf", F.lit(False))})
    return _shards(standing, "top", "leaf").mapInArrow(run, "node binary, shard bigint, saved_tokens bigint, n_leaves bigint, ends binary")


def trie(convs: DataFrame) -> Trie:
    """The trie of conversations (conv_id, turns), where turns are structs with digest and chars.

    Nodes: node, parent, depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.
    """
    convs = durable(convs)
    nodes = durable(_counted(convs))
    deepest = F.max(F.struct("depth", (F.col("n_ends") == F.col("n_convs")).alias("leaf")))
    stands = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), deepest.getField("leaf").alias("leaf"))
    below = durable(_below(convs.join(stands, "conv_id", "left")))
    none = F.lit(0).cast("bigint")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    facts = below.select("node", "saved_tokens", "n_leaves", none.alias("n_children")).unionByName(
        children.select("node", none.alias("saved_tokens"), none.alias("n_leaves"), "n_children")
    )
    sums = facts.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("saved_tokens", "n_leaves", "n_children")])
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # many children of one parent: a skewed join, which adaptive execution splits on the side of the children
    whole = nodes.drop("n_ends").join(sums, "node").join(parents, "parent", "left")
    return Trie(whole, below.where("ends is not null").select("node", "shard", "ends"))


def _members(start: int, bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) + start


def end_lists(ends: DataFrame) -> DataFrame:
    """Rows (node, conv_id) of the conversations that end at a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, start, bits in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = _members(start, bits)
                yield pa.RecordBatch.from_arrays([pa.array([node] * len(ids), pa.binary()), pa.array(ids)], ["node", "conv_id"])

    return ends.mapInArrow(run, "node binary, conv_id bigint")


def end_digests(ends: DataFrame) -> DataFrame:
    """Rows (node, ends_sha256): the SHA-256 of a node's decimal ids, ascending, with commas between. A list is read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        for batch in batches:
            done = []
            for node, start, bits in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = ",".join(map(str, _members(start, bits).tolist()))
                if node == now:
                    state.update(("," + text).encode())
                else:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ordered = ends.select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard")
    return ordered.mapInArrow(run, "node binary, ends_sha256 string")
