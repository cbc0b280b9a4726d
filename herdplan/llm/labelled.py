"""A bounded, documented sample of labelled documents for training."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Labelled rows at most, and bytes of all sampled texts together at most.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 16 << 20
#: Labels are learned from rows of the other folds.
FOLDS, HELD_OUT = 5, 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[pa.ChunkedArray, np.ndarray]:
    """(texts, labels 0 or 1) of up to ``rows`` documents outside the held-out
    fold, in the order of a hash of the id, and of up to ``size`` bytes: a text
    that what is left of them cannot hold is passed over, whatever its length.
    Null labels and ids take no part, of conflicting labels for one id the
    larger holds; repeated rows count once."""
    key = F.col("doc_id").cast("long")
    chosen = (
        labels.where(key.isNotNull() & F.col(label).isin(0, 1) & (fold(key, FOLDS) != HELD_OUT))
        .groupBy(key.alias("_id")).agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(key.alias("_id"), text.alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_label", "_text", F.xxhash64("_text").alias("_hash"))
    order = F.xxhash64("_id"), F.col("_id"), F.col("_hash")
    sizes = own.groupBy("_id", "_hash").agg(F.max(F.octet_length("_text")).alias("_bytes")).orderBy(*order).limit(rows).toArrow()
    left, fits = size, []
    for n in sizes.column("_bytes").to_pylist():
        fits.append(n <= left)
        left -= n * fits[-1]
    few = docs.sparkSession.createDataFrame(sizes.filter(pa.array(fits, pa.bool_())).select(["_id", "_hash"]))
    once = own.join(F.broadcast(few), ["_id", "_hash"], "left_semi").groupBy("_id", "_hash").agg(F.first("_text").alias("_text"), F.first("_label").alias("_label"))
    got = once.orderBy(*order).select("_text", "_label").toArrow()
    return got.column("_text"), np.asarray(got.column("_label")).astype(np.int64)


def held_out(doc_id) -> "F.Column":
    return fold(doc_id, FOLDS) == HELD_OUT
