"""Quality classifier: supervised subword embeddings.

Words, pairs of neighbouring words and the character n-grams of words (3 to 5
bytes, with the white space at a word's edge as a sign) are hashed to buckets,
each with a learned vector. A document is the average of the vectors of all its
n-grams; a linear layer and softmax give the probability of label 1. Vectors
and layer are trained together by stochastic gradient descent in numpy on a
bounded sample. As the output is linear in the average, scoring needs one number
a bucket: the vector times the difference of the two output rows.

A pair of equal words hashes to one bucket whatever the word: that n-gram is
"the word before again".

Defined results: a null or empty text scores by the bias alone; without rows of
both labels every score is the share of label 1 in the sample (0.5 without
rows); other columns pass through, input columns named ``score`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .common import frugal, prepare, table
from .labelled import held_out, training_sample

BITS, DIM, EPOCHS, RATE = 17, 8, 6, 12.0
#: Labelled rows of the training sample at most.
ROWS = 4000
LENGTHS = (3, 4, 5)
THRESHOLD = 0.3

_MASK = np.uint32((1 << BITS) - 1)
_BYTES = (A.stream(71, 256 * max(LENGTHS)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(-1, 256)
_SALT = (A.stream(72, max(LENGTHS) + 1) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
_WORDS = A.byte_table(73)
_AGAIN = np.uint32(12345) & _MASK


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x * np.uint32(0x9E3779B1)
    return (x ^ (x >> np.uint32(15))) & _MASK


def ngrams(data: np.ndarray, offsets: np.ndarray):
    """Yields (buckets, document of each) for each kind of n-gram of a slice."""
    starts, _, owner = A.words(data, offsets)
    h = A.hash_words(data, starts, _WORDS, 74)
    yield (h & np.uint64(_MASK)).astype(np.uint32), owner
    if len(h) > 1:
        pair = (A.window_hash(h, 2, 75) & np.uint64(_MASK)).astype(np.uint32)
        pair[h[1:] == h[:-1]] = _AGAIN
        same = owner[1:] == owner[:-1]
        yield pair[same], owner[1:][same]
    # a space between documents, and at both ends
    n = len(offsets) - 1
    spaced = np.full(len(data) + n + 1, 32, np.uint8)
    doc = np.repeat(np.arange(n + 1), np.append(np.diff(offsets), 0) + 1)
    inside = np.ones(len(spaced), bool)
    inside[offsets[:-1] + np.arange(n)] = False
    inside[-1] = False
    spaced[inside] = data
    gap = A._SPACE[spaced]
    spaced = np.where(gap, np.uint8(32), spaced)
    total = _BYTES[0][spaced]
    broken = np.zeros(len(spaced), bool)
    for k in range(1, max(LENGTHS)):
        m = len(spaced) - k
        if m <= 0:
            return
        total = total[:m] + _BYTES[k][spaced[k:]]
        if k >= 2:
            broken = broken[:m] | gap[k - 1 : k - 1 + m]
        if k + 1 in LENGTHS:
            good = np.flatnonzero(~broken[:m])
            yield _scramble(total[good] + _SALT[k + 1]), doc[good]


def bags(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, buckets, weights): the distinct buckets of all texts and their
    shares, one text after the other in flat arrays."""
    ends, buckets, weights = [np.zeros(1, np.int64)], [np.empty(0, np.uint32)], [np.empty(0, np.float32)]
    data, offsets = A.utf8(texts)
    for low, high, part, off in A.slices(data, offsets):
        every = [(b.astype(np.int64) + (d.astype(np.int64) << BITS)) for b, d in ngrams(part, off)]
        keys, counts = np.unique(np.concatenate(every) if every else np.empty(0, np.int64), return_counts=True)
        doc = keys >> BITS
        total = np.bincount(doc, weights=counts, minlength=high - low)
        ends.append(np.searchsorted(doc, np.arange(high - low), "right") + ends[-1][-1])
        buckets.append((keys & int(_MASK)).astype(np.uint32))
        weights.append((counts / total[doc]).astype(np.float32))
    return np.concatenate(ends), np.concatenate(buckets), np.concatenate(weights)


def train(texts: pa.ChunkedArray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> tuple[np.ndarray, float]:
    """(number of each bucket, bias): logit of label 1 = bias + average number."""
    share = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (1 << BITS, DIM)) / DIM
    layer, bias = np.array([-1.0, 1.0])[:, None] * rng.uniform(0.1, 0.3, (1, DIM)), np.log(np.array([1 - share, share]))
    ends, every, shares = bags(texts)
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            buckets, weights = every[ends[i] : ends[i + 1]], shares[ends[i] : ends[i + 1]]
            step = rate * (1 - done / steps)
            done += 1
            if not len(buckets):
                continue
            x = weights @ vectors[buckets]
            z = layer @ x + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[labels[i]] -= 1
            back = layer.T @ g
            layer -= 0.05 * step * np.outer(g, x)
            bias -= 0.01 * step * g
            vectors[buckets] -= (step * weights / np.sqrt(weights.max()))[:, None] * back
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def score(texts: pa.Array, numbers: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 of each text."""
    out = np.full(len(texts), bias)
    data, offsets = A.utf8(texts)
    for low, high, part, off in A.slices(data, offsets):
        total, count = np.zeros(high - low), np.zeros(high - low)
        for buckets, doc in ngrams(part, off):
            total += np.bincount(doc, weights=numbers[buckets], minlength=high - low)[: high - low]
            count += np.bincount(doc, minlength=high - low)[: high - low]
        out[low:high] += total / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability that ``labels`` has label 1."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop("score")
    model = spark.sparkContext.broadcast(train(*training_sample(docs, labels, label, ROWS)))  # 2 ** BITS numbers

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(b.column(text), *model.value))], [*b.schema.names, "score"])

    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 5 over all of ``documents``."""
    out = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
