"""Substring deduplication with a count-min prefilter.

Every window of ``window`` consecutive words is counted, by blocks, in a
count-min sketch whose partitions are merged shard by shard. The sketch never
counts too little, so a window that it counts once occurs once; only windows
estimated to repeat go into a second exchange that groups them exactly (by 96
bits of hash) and finds whether an earlier document holds the same words.
Sketch and shards are sized from the bytes of the input. Blocks send the cells
that they touch, so a row of the sketch costs an entry a window, but twice the
cells in a row only one bit more: by default one wide row.

Defined results: a null or empty text has no words; a window repeats only
across documents, the smaller ``doc_id`` keeps its words, so rows with equal
ids do not remove each other's words; a row with a null id removes nothing and
loses nothing; documents shorter than a window stay whole; other columns pass
through, and input columns named like an output are replaced.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .blocks import FANOUT, answer, apply, ask, fans_for, frame, open_block, pack, pack_planes, pack_sorted, returned, shard_bounds, shards_for, unframe, unpack, unpack_planes, unpack_sorted, write_blocks
from .common import table

WINDOW = 50
#: Rows of the sketch, and its cells in a row for each window of the input.
ROWS, CELLS_PER_WINDOW = 1, 32
_LAST = np.iinfo(np.int64).max
_TABLE = A.byte_table(91)


def _ids(t: pa.Table, key: str) -> np.ndarray:
    """Ids of the documents; null ones as the largest number."""
    return np.asarray(pa.compute.fill_null(t.column(key), _LAST).combine_chunks(), dtype=np.int64)


def _windows(t: pa.Table, text: str, k: int, second: bool):
    """(first hash, second hash or None, document row, word count per document,
    index of the first word in its document) of all windows of a block."""
    data, offsets = A.utf8(t.column(text))
    h1, h2, doc, at = [], [], [], []
    count = np.zeros(t.num_rows, np.int64)
    for low, high, part, off in A.slices(data, offsets):
        starts, _, owner = A.words(part, off)
        n = np.bincount(owner, minlength=high - low)
        count[low:high] = n
        if len(starts) < k:
            continue
        inside = owner[: len(owner) - k + 1] == owner[k - 1 :]
        if not inside.any():
            continue
        h = A.hash_words(part, starts, _TABLE, 92)
        h1.append(A.window_hash(h, k, 93)[inside])
        if second:
            h2.append((A.window_hash(h, k, 94)[inside] >> np.uint64(32)).astype(np.uint32))
        firsts = np.flatnonzero(inside)
        doc.append((owner[firsts] + low).astype(np.int32))
        at.append((firsts - (np.cumsum(n) - n)[owner[firsts]]).astype(np.int32))
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return join(h1, np.uint64), join(h2, np.uint32), join(doc, np.int32), count, join(at, np.int32)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each window, as the top bits of a key."""
    return A.mix(h + A.stream(95, row + 1)[row]) & ~np.uint64((1 << 64 - bits) - 1)


def _sketched(h: np.ndarray, bits: int, rows: int, ranges: int):
    """For each row of the sketch: (distinct cells in order, their place for
    each window, counts, where each range begins)."""
    for row in range(rows):
        cells, place, counts = np.unique(_cells(h, row, bits), return_inverse=True, return_counts=True)
        yield row, cells, place, counts, shard_bounds(cells, ranges)


class _Bits:
    """Kinds whose values are yes or no."""

    def pack_values(self, values: np.ndarray) -> bytes:
        return pack(np.packbits(values))

    def unpack_values(self, m: bytes, n: int) -> np.ndarray:
        return np.unpackbits(unpack(m, np.uint8), count=n).astype(bool)

    def head(self, merged: tuple) -> None:
        return None


class Cells(_Bits):
    """Cells and whether they count two or more: counts saturate there."""

    def pack(self, arrays: tuple) -> bytes:
        return frame(pack_sorted(arrays[0]), pack(np.packbits(arrays[1])))

    def unpack(self, m: bytes) -> tuple:
        cells, more = unframe(m, 2)
        cells = unpack_sorted(cells, np.uint64)
        return cells, self.unpack_values(more, len(cells))

    def merge(self, parts: list[tuple]):
        cells, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(place, weights=1 + np.concatenate([p[1] for p in parts]))
        return (cells, total >= 2), np.split(place, np.cumsum([len(p[0]) for p in parts])[:-1])

    def root(self, merged: tuple) -> np.ndarray:
        return merged[1]

    def down(self, values, merged, place, own) -> np.ndarray:
        return values[place]


class Earliest(_Bits):
    """Windows (two hashes) and the least id of a document that holds each;
    values: does a document with a smaller id, outside, hold it?"""

    def pack(self, arrays: tuple) -> bytes:
        ids, ordinal = np.unique(arrays[2], return_inverse=True)
        return frame(pack_sorted(arrays[0]), pack(arrays[1]), pack(ordinal.astype(np.uint32)), pack(ids))

    def unpack(self, m: bytes) -> tuple:
        one, two, ordinal, ids = unframe(m, 4)
        return unpack_sorted(one, np.uint64), unpack(two, np.uint32), unpack(ids, np.int64)[unpack(ordinal, np.uint32)]

    def merge(self, parts: list[tuple]):
        one, two, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
        one, two, place, least = _distinct(one, two, ids)
        return (one, two, least), np.split(place, np.cumsum([len(p[0]) for p in parts])[:-1])

    def root(self, merged: tuple) -> np.ndarray:
        return np.zeros(len(merged[0]), bool)

    def down(self, values, merged, place, own) -> np.ndarray:
        return values[place] | (merged[2][place] < own[2])


def _groups(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct pair begins in the order, the order)."""
    order = np.lexsort((two, one))
    x, y = one[order], two[order]
    return np.flatnonzero(np.append(np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1]))), order


def _distinct(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray):
    """(distinct keys' hashes in order, key of each window, least id of each key)."""
    if not len(h1):
        return h1, h2, np.empty(0, np.int64), np.empty(0, np.int64)
    start, order = _groups(h1, h2)
    place = np.empty(len(h1), np.int64)
    place[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h1))))
    return h1[order][start], h2[order][start], place, np.minimum.reduceat(ids[order], start)


def _cover(at: np.ndarray, n: int, k: int) -> np.ndarray:
    """Words that windows of k words beginning at ``at`` cover."""
    edge = np.bincount(at, minlength=n + k) - np.concatenate([np.zeros(k, np.int64), np.bincount(at, minlength=n)[:n]])
    return np.cumsum(edge[:n]) > 0


def _kept(t: pa.Table, text: str, k: int, n: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.Table:
    removed, kept = np.zeros(len(n), np.int64), []
    low, high = np.searchsorted(doc, np.arange(len(n))), np.searchsorted(doc, np.arange(len(n)), "right")
    for i, x in enumerate(t.column(text).to_pylist()):
        own = (x or "").encode().split()
        if high[i] > low[i]:
            covered = _cover(at[low[i] : high[i]], int(n[i]), k)
            removed[i] = covered.sum()
            own = compress(own, (~covered).tolist())
        kept.append(b" ".join(own).decode())
    return t.append_column("n_words", pa.array(n)).append_column("n_removed", pa.array(removed)).append_column("kept_text", pa.array(kept, pa.string()))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", rows: int = ROWS, cells_per_window: int = CELLS_PER_WINDOW, fanout: int = FANOUT, shards: int | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``: the words that
    no repeated window of an earlier document covers, joined by one space."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    docs = docs.withColumn(key, F.col(key).cast("long")).withColumn(text, F.col(text).cast("string"))
    blocks = write_blocks(docs, text)
    total, senders = (x or 0 for x in blocks.agg(F.sum("bytes"), F.count("*")).first())
    fans = fans_for(shards or shards_for(total), fanout)
    ranges = fans[0]
    bits = min(60, max(12, math.ceil(math.log2(cells_per_window * total / 6 + 1))))

    def count(payload: bytes, _):
        h = _windows(open_block(payload), text, window, False)[0]
        for row, cells, _place, counts, bounds in _sketched(h, bits, rows, ranges):
            for s in range(ranges):
                a, b = bounds[s], bounds[s + 1]
                if b > a:
                    yield row * ranges + s, frame(b"", Cells().pack((cells[a:b], counts[a:b] >= 2)))

    def repeated(h: np.ndarray, replies: dict) -> np.ndarray:
        """Hashes whose estimate, the least count of the rows, is two or more."""
        out = np.ones(len(h), bool)
        for row, cells, place, _counts, bounds in _sketched(h, bits, rows, ranges):
            bit = np.zeros(len(cells), bool)
            for s in range(ranges):
                a, b = bounds[s], bounds[s + 1]
                if b > a:
                    bit[a:b] = Cells().unpack_values(unframe(replies[row * ranges + s], 2)[1], b - a)
            out &= bit[place]
        return out

    def group(payload: bytes, replies: dict):
        t = open_block(payload)
        h1, h2, doc, _n, _at = _windows(t, text, window, True)
        mask = repeated(h1, replies)
        own, first = np.unique(h1, return_index=True)
        one, two, _place, least = _distinct(h1[mask], h2[mask], _ids(t, key)[doc[mask]])
        every, bounds = shard_bounds(own, ranges), shard_bounds(one, ranges)
        for s in range(ranges):
            a, b = bounds[s], bounds[s + 1]
            if b > a:  # the memo tells which windows went
                went = pack(np.packbits(mask[first[every[s] : every[s + 1]]]))
                yield s, frame(went, Earliest().pack((one[a:b], two[a:b], least[a:b])))

    def finish(payload: bytes, replies: dict) -> pa.Table:
        t = open_block(payload)
        h1, h2, doc, n, at = _windows(t, text, window, True)
        own, place = np.unique(h1, return_inverse=True)
        every, went, told = shard_bounds(own, ranges), np.zeros(len(own), bool), {}
        for s, reply in replies.items():
            mask, told[s] = unframe(reply, 2)
            went[every[s] : every[s + 1]] = np.unpackbits(unpack(mask, np.uint8), count=every[s + 1] - every[s])
        mask = went[place]
        ids = _ids(t, key)[doc[mask]]
        one, _two, place, least = _distinct(h1[mask], h2[mask], ids)
        bounds, earlier = shard_bounds(one, ranges), np.zeros(len(one), bool)
        for s, b in told.items():
            earlier[bounds[s] : bounds[s + 1]] = Earliest().unpack_values(b, bounds[s + 1] - bounds[s])
        gone = ((least[place] < ids) | earlier[place]) & (ids != _LAST)
        return _kept(t, text, window, n, doc[mask][gone], at[mask][gone])

    flagged = answer(ask(blocks, count), Cells(), fans, senders, rows, fanout=fanout)
    earlier = answer(ask(returned(blocks, flagged), group), Earliest(), fans, senders, fanout=fanout)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return apply(returned(blocks, earlier), finish, schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 9 over all of ``documents``."""
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
