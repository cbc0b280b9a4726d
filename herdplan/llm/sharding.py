"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows of every input partition are dealt to output blocks by counts drawn
from the exact law of a uniform permutation: a contingency table with the
partition sizes and the block sizes as margins. No task or driver holds the
table. Partitions are the leaves of a binary tree; at each node the block
counts of the left half are one multivariate hypergeometric draw, seeded by the
node, so a task finds its own row by one walk down the tree. The deal is a
random order of the partition's rows (local permutation), the exchange moves
rows by block, and a second random order inside each block gives the slots.
Shards are runs of blocks, so a shard may be larger than a task.

Law: ``rows``; shard sizes differ by one at most. Defined results: repeated
rows and equal ids are separate rows, null texts count as empty, an empty table
gives an empty result, input columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialised, prepare, table

#: Rows of one block at most: what one task orders.
BLOCK_ROWS = 1 << 14
SHARDS = 8


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (i < rows % shards) for i in range(shards)], np.int64)


def block_sizes(rows: int, shards: int, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, shard, first slot) of each block, in order."""
    size, shard, first = [], [], []
    for s, n in enumerate(shard_sizes(rows, shards).tolist()):
        parts = max(1, -(-n // block_rows))
        own = shard_sizes(n, parts)
        size.append(own)
        shard.append(np.full(parts, s))
        first.append(np.cumsum(own) - own)
    return np.concatenate(size), np.concatenate(shard), np.concatenate(first)


def matrix_row(partition: int, sizes: np.ndarray, blocks: np.ndarray, seed: int) -> np.ndarray:
    """How many rows of ``partition`` go to each block.

    ``sizes`` are the rows of all partitions, ``blocks`` those of all blocks.
    """
    low, high, left, node = 0, len(sizes), blocks.astype(np.int64), 1
    before = np.concatenate([[0], np.cumsum(sizes)])
    while high - low > 1:
        middle = (low + high) // 2
        n = int(before[middle] - before[low])
        rng = np.random.Generator(np.random.PCG64([seed, node]))
        draw = rng.multivariate_hypergeometric(left, n, method="marginals")
        if partition < middle:
            high, left, node = middle, draw, 2 * node
        else:
            low, left, node = middle, left - draw, 2 * node + 1
    return left


def destinations(partition: int, sizes: np.ndarray, blocks: np.ndarray, seed: int) -> tuple[np.ndarray, np.random.Generator]:
    """The block of each row of ``partition``, in the order of its rows, and the
    generator that drew it, for what the partition draws next."""
    rng = np.random.Generator(np.random.PCG64([seed, 1 << 40, partition]))
    to = np.repeat(np.arange(len(blocks), dtype=np.int32), matrix_row(partition, sizes, blocks, seed))
    rng.shuffle(to)
    return to, rng


def shuffle_into_shards(rows: DataFrame, shards: int = SHARDS, seed: int = 20240617, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0).

    The rows are written once to the shared folder first, so that partitions
    hold the same rows in both passes and under retries; give narrow rows, with
    a key to fetch wide columns by, where the columns are large.
    """
    spark = rows.sparkSession
    prepare(spark)
    rows = materialised(rows.drop("shard", "slot"))
    pid = F.spark_partition_id()
    counts = dict(rows.groupBy(pid.alias("p")).count().collect())
    if not counts:
        return rows.withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    sizes = np.array([counts.get(p, 0) for p in range(max(counts) + 1)], np.int64)
    size, shard, first = block_sizes(int(sizes.sum()), shards, block_rows)

    def deal(batches):
        from pyspark import TaskContext

        p, at = TaskContext.get().partitionId(), 0
        known = int(sizes[p]) if p < len(sizes) else 0
        to, rng = destinations(p, sizes, size, seed) if known else (np.empty(0, np.int32), None)
        for batch in batches:
            n = batch.num_rows
            if at + n > known:
                raise RuntimeError(f"partition {p} has more rows than the {known} that were counted")
            if n:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to[at : at + n]), pa.array(rng.integers(0, 1 << 62, n)), pa.array(np.arange(at, at + n) + (p << 40))], [*batch.schema.names, "__shard_block", "__shard_order", "__shard_row"])
            at += n
        if at < known:
            raise RuntimeError(f"partition {p} has {at} rows, not the {known} that were counted")

    names = [f.name for f in rows.schema.fields]
    dealt = rows.mapInArrow(deal, T.StructType([*rows.schema.fields, T.StructField("__shard_block", T.IntegerType()), T.StructField("__shard_order", T.LongType()), T.StructField("__shard_row", T.LongType())]))
    place = F.row_number().over(Window.partitionBy("__shard_block").orderBy("__shard_order", "__shard_row")) - 1
    many = F.array(*[F.lit(int(x)) for x in shard])
    if len(size) > 64:  # blocks by table: bounded by rows / block_rows
        blocks = spark.createDataFrame(pa.table({"__shard_block": pa.array(range(len(size)), pa.int32()), "shard": pa.array(shard, pa.int32()), "__shard_first": pa.array(first, pa.int64())}))
        return dealt.withColumn("__shard_place", place).join(blocks, "__shard_block").select(*names, "shard", (F.col("__shard_first") + F.col("__shard_place")).alias("slot"))
    firsts = F.array(*[F.lit(int(x)).cast("long") for x in first])
    return dealt.withColumn("__shard_place", place).select(*names, F.get(many, F.col("__shard_block")).cast("int").alias("shard"), (F.get(firsts, F.col("__shard_block")) + F.col("__shard_place")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 7 over all of ``documents``, law ``rows``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
