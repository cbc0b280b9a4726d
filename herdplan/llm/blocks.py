"""Blocks of documents, and exchanges of sorted keys between blocks and shards.

A *block* is one row that holds a run of whole documents, compressed. Blocks
are written once to the shared folder, so their numbers are stable under
retries. An *exchange* asks a question about keys (hashes) that occur in many
blocks: each block sends every range of the key space its own sorted, distinct
keys (duplicates are combined before the shuffle, so a key that fills a third
of the rows arrives once per block), the shard merges what the blocks sent,
and each block gets one answer per key back, aligned with what it sent. Shards
are hash ranges, sized from the bytes of the input: no key makes one large.

Blocks times shards would grow with the square of the input. So a block sends at
most FANOUT messages, one for each of as many ranges; where the input needs more
shards, up to FANOUT messages of a range meet in a node, which merges them, cuts
what it has into narrower ranges and asks on for its blocks. Messages are then
in proportion to the input, at each of the log(shards) levels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialised, prepare

#: Text bytes of a block; one longer document makes a block of its own.
BLOCK_BYTES = 4 << 20
#: Text bytes of the input for each shard of the key space.
SHARD_BYTES = 16 << 20
#: Messages of one block, and blocks or nodes that one node answers.
FANOUT = 128
#: Rows of blocks or messages are handed to Python a few at a time.
BLOCK_SCHEMA = "block long, bytes long, docs long, payload binary"


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def pack_sorted(x: np.ndarray) -> bytes:
    """Differences of sorted unsigned numbers, each byte plane by itself."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return pack(d.view(np.uint8).reshape(-1, x.dtype.itemsize).T)


def unpack_sorted(b: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = unpack(b, np.uint8).reshape(dtype.itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)


def pack_planes(x: np.ndarray) -> bytes:
    """Whole numbers, each byte plane by itself."""
    return pack(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T)


def unpack_planes(b: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def frame(*parts: bytes) -> bytes:
    """Byte strings as one."""
    return b"".join(len(p).to_bytes(8, "little") for p in parts) + b"".join(parts)


def unframe(m: bytes, n: int) -> list[bytes]:
    out, at = [], 8 * n
    for i in range(n):
        size = int.from_bytes(m[8 * i : 8 * i + 8], "little")
        out.append(m[at : at + size])
        at += size
    return out


def write_blocks(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, as a written table of blocks."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out():
            sink = pa.BufferOutputStream()
            rows = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(rows)
            return pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + number], pa.int64()), "bytes": pa.array([size], pa.int64()), "docs": pa.array([rows.num_rows], pa.int64()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0))
            low = 0
            while low < batch.num_rows:
                ends = size + np.cumsum(lengths[low:])
                take = min(len(ends), int(np.searchsorted(ends, block_bytes)) + 1)
                held.append(batch.slice(low, take))
                size, low = int(ends[take - 1]), low + take
                if size >= block_bytes:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    return materialised(docs.mapInArrow(frugal(run), BLOCK_SCHEMA))


def open_block(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def shards_for(total: int) -> int:
    """Shards of the key space for so many bytes of input."""
    return int(max(4, -(-total // SHARD_BYTES)))


def fans_for(shards: int, fanout: int = FANOUT) -> list[int]:
    """Into how many ranges each level cuts: up to ``fanout``, ``shards`` in all
    at least."""
    levels = 1
    while fanout**levels < shards:
        levels += 1
    fan = 1
    while fan**levels < shards:
        fan += 1
    return [fan] * levels


def shard_bounds(keys: np.ndarray, shards: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Where each of ``shards`` equal ranges of 64-bit sorted keys begins, and
    where the last ends; of the ranges ``first`` to ``last`` - 1, which hold
    all keys."""
    cuts = [(i << 64) // shards for i in range(first + 1, shards if last is None else last)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(cuts, np.uint64)), [len(keys)]])


class Kind(Protocol):
    """What messages say of their keys. Arrays are aligned, the first are the
    keys in order; values are answers, one for each key."""

    def pack(self, arrays: tuple) -> bytes: ...

    def unpack(self, m: bytes) -> tuple: ...

    def merge(self, parts: list[tuple]) -> tuple[tuple, list[np.ndarray]]:
        """What all parts say as one, and the place of each part's keys in it."""
        ...

    def root(self, merged: tuple) -> np.ndarray:
        """Values for all that was said of a range."""
        ...

    def down(self, values: np.ndarray, merged: tuple, place: np.ndarray, own: tuple) -> np.ndarray:
        """Values for a part, from those for what it was merged into."""
        ...

    def pack_values(self, values: np.ndarray) -> bytes: ...

    def unpack_values(self, m: bytes, n: int) -> np.ndarray: ...

    def head(self, merged: tuple) -> bytes | None:
        """What is said of a range as a whole, if anything."""
        ...


Ask = Callable[..., Iterator[tuple[int, bytes]]]


def ask(blocks: DataFrame, question: Ask) -> DataFrame:
    """Messages (shard, block, message) that ``question(payload, replies)``
    yields for each block; replies is a dict by shard, empty at first. To be
    answered, a message is frame(memo, packed arrays); the memo comes back."""

    def run(batches):
        for batch in batches:
            has = "replies" in batch.schema.names
            for i in range(batch.num_rows):
                block, payload = batch.column("block")[i].as_py(), batch.column("payload")[i].as_py()
                replies = {r["shard"]: r["reply"] for r in batch.column("replies")[i].as_py() or []} if has else {}
                sent = list(question(payload, replies))
                if sent:
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([s for s, _ in sent], pa.int64()), "block": pa.array([block] * len(sent), pa.int64()), "message": pa.array([m for _, m in sent], pa.binary())})

    return blocks.mapInArrow(frugal(run), "shard long, block long, message binary")


_REPLIES = "block long, shard long, reply binary"


def _replies(blocks: list, shard: int, replies: list) -> pa.Table:
    return pa.table({"block": pa.array(blocks, pa.int64()), "shard": pa.array([shard] * len(blocks), pa.int64()), "reply": pa.array(replies, pa.binary())})


def _opened(group: pa.Table, kind: Kind):
    """(blocks, memos, arrays, merged, places) of a group of messages, by block."""
    group = group.sort_by("block")
    framed = [unframe(m, 2) for m in group.column("message").to_pylist()]
    parts = [kind.unpack(body) for _, body in framed]
    return group.column("block").to_pylist(), [memo for memo, _ in framed], parts, *kind.merge(parts)


def _told(values, memos, parts, merged, places, kind: Kind) -> list[bytes]:
    return [frame(memo, kind.pack_values(kind.down(values, merged, place, own))) for memo, own, place in zip(memos, parts, places)]


def answer(messages: DataFrame, kind: Kind, fans: list[int], senders: int, rows: int = 1, ranges: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """Replies (block, shard, frame(memo, packed values)) to messages, and heads
    of ranges with block -1. ``fans`` as fans_for() has them, ``senders`` the
    number of blocks, ``rows`` of separate key spaces: shard = row * ranges + range."""
    ranges = fans[0] if ranges is None else ranges
    if len(fans) == 1:

        def leaf(group: pa.Table) -> pa.Table:
            blocks, memos, parts, merged, places = _opened(group, kind)
            out, head = _told(kind.root(merged), memos, parts, merged, places, kind), kind.head(merged)
            more = ([], []) if head is None else ([-1], [head])
            return _replies(blocks + more[0], group.column("shard")[0].as_py(), out + more[1])

        return messages.repartition(ranges * rows, "shard").groupBy("shard").applyInArrow(leaf, _REPLIES)

    fan, groups = fans[1], -(-senders // fanout)
    node = F.col("shard") * groups + F.pmod(F.xxhash64("block"), F.lit(groups))
    own = materialised(messages.withColumn("node", node))

    def cut(merged: tuple, shard: int):
        first = shard % ranges * fan
        return shard_bounds(merged[0], ranges * fan, first, first + fan)

    def up(group: pa.Table) -> pa.Table:
        node, shard = group.column("node")[0].as_py(), group.column("shard")[0].as_py()
        merged = _opened(group, kind)[3]
        bounds = cut(merged, shard)
        some = [i for i in range(fan) if bounds[i + 1] > bounds[i]]
        out = [frame(b"", kind.pack(tuple(x[bounds[i] : bounds[i + 1]] for x in merged))) for i in some]
        return pa.table({"shard": pa.array([shard * fan + i for i in some], pa.int64()), "block": pa.array([node] * len(some), pa.int64()), "message": pa.array(out, pa.binary())})

    told = materialised(answer(own.groupBy("node").applyInArrow(up, "shard long, block long, message binary"), kind, fans[1:], groups, rows, ranges * fan, fanout))

    def down(group: pa.Table, replies: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        blocks, memos, parts, merged, places = _opened(group, kind)
        bounds, got = cut(merged, shard), dict(zip(replies.column("shard").to_pylist(), replies.column("reply").to_pylist()))
        values = np.concatenate([kind.unpack_values(unframe(got[shard * fan + i], 2)[1], int(bounds[i + 1] - bounds[i])) for i in range(fan) if bounds[i + 1] > bounds[i]])
        return _replies(blocks, shard, _told(values, memos, parts, merged, places, kind))

    below = told.where("block >= 0").withColumnRenamed("block", "node")
    return own.groupBy("node").cogroup(below.groupBy("node")).applyInArrow(down, _REPLIES).unionByName(told.where("block < 0"))


def returned(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Each block with the replies to it, as an array of (shard, reply)."""
    by = replies.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("shard", "reply")).alias("replies"))
    return blocks.join(by, "block", "left")


def apply(blocks: DataFrame, finish: Callable[[bytes, dict], pa.Table], schema) -> DataFrame:
    """``finish(payload, replies)`` of each block, as rows of ``schema``."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                replies = {r["shard"]: r["reply"] for r in batch.column("replies")[i].as_py() or []}
                yield from finish(batch.column("payload")[i].as_py(), replies).to_batches()

    return blocks.mapInArrow(frugal(run), schema)
