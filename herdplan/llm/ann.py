"""Approximate nearest neighbours by a permutation index.

A bounded sample gives the pivots, each as far as can be from those before, so
that a crowd of like vectors does not take them all. Every vector is represented
by the order of its nearest pivots and posted under each of them, with its rank,
in the pivot inverted files of its block; the blocks with their files are written
once. A query walks the files of its own nearest pivots and adds up, for every
vector that shares one, the part of Spearman's footrule that the shared pivot
saves; the footrule of two lists of length L is L(L+1) - 2 * sum over shared
pivots of min(L - rank, L - other rank), so this sum ranks by footrule exactly.
The best tenth of each block's distinct vectors is then scored on the original
vectors in double precision; equal vectors are indexed once and listed each, so
copies take nobody's place.

Every row is indexed. Queries go out in waves of bounded bytes; a task walks the
files of its blocks and hands back each query's best of them all. Recall against
brute force on the test tables is in the README.

Defined results: vectors that are null or zero, or hold null or non-finite parts
take no part, nor do rows without an id; vectors of one length are searched among
those of that length; rows with the query's id are not its neighbours; a
repeated query id is asked once, repeated candidate rows are listed each; ties go
to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, frugal, materialised, prepare, table

#: Vectors (of each length) that pivots are chosen from, pivots, and the length of
#: a vector's list of nearest pivots.
SAMPLE, PIVOTS, NEAREST = 2048, 256, 128
#: The share of a block, and rows at least, that is scored on the vectors themselves.
RERANK, RERANK_ROWS = 0.1, 256
#: Rows of one block, and bytes of the vectors of one wave of queries.
BLOCK_ROWS, WAVE_BYTES = 1 << 14, 32 << 20


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _by_width(batch: pa.RecordBatch):
    """(ids, matrix) of the rows of each length of vectors."""
    ids, column = np.asarray(batch.column("_id")), batch.column("_v")
    widths = np.asarray(pa.compute.list_value_length(column))
    for n in np.unique(widths).tolist():
        own = np.flatnonzero(widths == n)
        yield n, ids[own], np.asarray(column.take(pa.array(own)).flatten()).reshape(len(own), n)


def sampled(vectors: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """For each length up to ``rows`` distinct vectors, those of least hash:
    a partition hands on no more than that many."""

    def run(batches):
        held: dict[int, tuple] = {}
        for b in batches:
            hashes = pa.array(np.asarray(b.column("_h")))
            for n in np.unique(widths := np.asarray(pa.compute.list_value_length(b.column("_v")))).tolist():
                own = pa.array(np.flatnonzero(widths == n))
                h, v = np.asarray(hashes.take(own)), np.asarray(b.column("_v").take(own).flatten()).reshape(len(own), n)
                if n in held:
                    h, v = np.concatenate([held[n][0], h]), np.concatenate([held[n][1], v])
                h, first = np.unique(h, return_index=True)
                held[n] = (h[:rows], v[first[:rows]])
        for n, (h, v) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(h), pa.int32()), pa.array(h), pa.array(list(v), pa.list_(pa.float64()))], ["n", "h", "v"])

    some = vectors.select("_v", F.xxhash64("_v").alias("_h")).mapInArrow(frugal(run), "n int, h long, v array<double>").dropDuplicates(["n", "h"])
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("n").orderBy("h"))).where(F.col("k") <= rows).orderBy("n", "h").toArrow()
    widths = some.column("n").to_numpy()
    return {n: np.array(some.filter(pa.array(widths == n)).column("v").to_pylist()) for n in np.unique(widths).tolist()}


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the one whose largest cosine with those before is least."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out, near = [0], unit @ unit[0]
    while len(out) < min(n, len(x)):
        out.append(int(np.argmin(near)))
        near = np.maximum(near, unit @ unit[out[-1]])
    return x[out]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Pivots of each row in the order of falling inner product."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length]


class InvertedFiles:
    """A file for each pivot: L - rank of every row that has the pivot among its
    L nearest, 0 for the others; half of the entries are used, so files are plain
    byte arrays."""

    def __init__(self, files: np.ndarray, length: int):
        self.files, self.length = files, length

    @classmethod
    def of(cls, x: np.ndarray, pivots: np.ndarray, length: int) -> "InvertedFiles":
        order = nearest_pivots(x, pivots, length)
        length = order.shape[1]
        files = np.zeros((len(pivots), len(x)), np.uint8)
        files[order.ravel(), np.repeat(np.arange(len(x)), length)] = np.tile(length - np.arange(length), len(x))
        return cls(files, length)

    def shared(self, own: np.ndarray) -> np.ndarray:
        """For each row: sum over shared pivots of min(L - rank, L - own rank)."""
        out, part = np.zeros(self.files.shape[1], np.uint16), np.empty(self.files.shape[1], np.uint8)
        for rank, p in enumerate(own.tolist()):
            np.minimum(self.files[p], np.uint8(self.length - rank), out=part)
            out += part
        return out


_INDEX = "width int, rows int, ids binary, ends binary, parts binary, files binary"


def index(vectors: DataFrame, pivots: dict[int, np.ndarray], length: int, block_rows: int) -> DataFrame:
    """Written blocks of up to ``block_rows`` rows of one length: the ids by
    distinct vector, where each one's ids end, distinct vectors, inverted files."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors a length

    def block(width: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        keys = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, width * x.itemsize))).ravel()
        _, first, place = np.unique(keys, return_index=True, return_inverse=True)
        order = np.lexsort((ids, place))
        ends = np.searchsorted(place[order], np.arange(1, len(first) + 1))
        files = InvertedFiles.of(x[first], sent.value[width], length).files
        return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([len(first)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids[order], ends.astype(np.int64), x[first], files))], ["width", "rows", "ids", "ends", "parts", "files"])

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for width, ids, x in _by_width(b):
                while len(ids):
                    own = held.setdefault(width, [])
                    room = block_rows - sum(len(i) for i, _ in own)
                    own.append((ids[:room], x[:room]))
                    ids, x = ids[room:], x[room:]
                    if room <= len(own[-1][0]):
                        yield block(width, *map(np.concatenate, zip(*held.pop(width))))
        for width, own in held.items():
            yield block(width, *map(np.concatenate, zip(*own)))

    return materialised(vectors.select("_id", "_v").mapInArrow(frugal(run), _INDEX))


def search_block(ids: np.ndarray, ends: np.ndarray, x: np.ndarray, files: InvertedFiles, queries: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, rerank: float, least: int):
    """(number of the query, ids, scores) of the k best of the block for each."""
    n = len(x)
    take, first = min(n, max(int(np.ceil(rerank * n)), least, k + 1)), np.concatenate([[0], ends[:-1]])
    for i, query in enumerate(queries.tolist()):
        shared = files.shared(own[i])
        some = np.argpartition(shared, n - take)[n - take :] if take < n else np.arange(n)
        score = x[some] @ q[i]
        if n < len(ids):  # the first k + 1 rows of each vector, as only they can count
            many = np.minimum((ends - first)[some], k + 1)
            rows = np.repeat(first[some] - np.cumsum(many) + many, many) + np.arange(many.sum())
            score = np.repeat(score, many)
        else:
            rows = some
        other = ids[rows] != query
        rows, score = rows[other], score[other]
        if len(score) > k:  # all that may be among the k best
            top = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[top], score[top]
        best = np.lexsort((ids[rows], -score))[:k]
        yield i, ids[rows[best]], score[best]


def _waves(asked: DataFrame, size: int) -> list[list[int]]:
    """Numbers of the parts of queries, in runs of up to ``size`` bytes."""
    out, held = [], 0
    for r in asked.groupBy("_part").agg(F.sum(8 * F.size("_v") + 8).alias("n")).orderBy("_part").collect():  # a row for WAVE_BYTES / 64 or more
        if not out or held + r["n"] > size:
            out.append([])
            held = 0
        out[-1].append(r["_part"])
        held += r["n"]
    return out


def nearest(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, length: int = NEAREST, rerank: float = RERANK, least: int = RERANK_ROWS, block_rows: int = BLOCK_ROWS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """Rows (query_id, rank, key, score): the k rows of largest inner product
    found for each row where ``queries`` holds."""
    spark = vectors.sparkSession
    prepare(spark)
    own = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"), queries.alias("_asks"))
    chosen = {n: spread(x, pivots) for n, x in sampled(own, SAMPLE).items()}
    if not chosen:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    data = index(own, chosen, length, block_rows)
    names = spark.sparkContext.broadcast(chosen)
    asked = own.where("_asks").dropDuplicates(["_id"])
    size = asked.agg(F.sum(8 * F.size("_v") + 8)).first()[0] or 0
    asked = materialised(asked.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(max(1, -(-64 * size // wave_bytes))))).select("_id", "_v", "_part"))
    found = []
    for wave in _waves(asked, wave_bytes):
        got = asked.where(F.col("_part").between(wave[0], wave[-1])).select("_id", "_v").orderBy("_id").toArrow()  # wave_bytes, about
        sent = spark.sparkContext.broadcast({n: (i, q) for n, i, q in _by_width(got.combine_chunks().to_batches()[0])})

        def run(batches, sent=sent):
            best: dict[int, tuple] = {}
            for b in batches:
                for r in range(b.num_rows):
                    width, rows = b.column("width")[r].as_py(), b.column("rows")[r].as_py()
                    if width not in sent.value:
                        continue
                    queries, q = sent.value[width]
                    ids, ends, x, files = (np.frombuffer(b.column(c)[r].as_py(), kind) for c, kind in (("ids", np.int64), ("ends", np.int64), ("parts", np.float64), ("files", np.uint8)))
                    if width not in best:
                        best[width] = (nearest_pivots(q, names.value[width], length), [(np.empty(0, np.int64), np.empty(0))] * len(queries))
                    near, held = best[width]
                    for i, found_ids, score in search_block(ids, ends, x.reshape(rows, width), InvertedFiles(files.reshape(-1, rows), near.shape[1]), queries, q, near, k, rerank, least):
                        found_ids, score = np.concatenate([held[i][0], found_ids]), np.concatenate([held[i][1], score])
                        top = np.lexsort((found_ids, -score))[:k]
                        held[i] = (found_ids[top], score[top])
            for width, (_, held) in best.items():
                query = np.repeat(sent.value[width][0], [len(i) for i, _ in held])
                yield pa.RecordBatch.from_arrays([pa.array(query), *(pa.array(np.concatenate(c)) for c in zip(*held))], ["query_id", key, "score"])

        found.append(materialised(data.mapInArrow(frugal(run), f"query_id long, {key} long, score double")))
        sent.destroy()
    if not found:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    discard(data, asked)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 10 over all of ``embeddings``."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
