"""Fill-in-the-middle transformation by succinct rank and select.

A batch of texts is one run of bytes. A packed bit vector marks the last byte of
every line, with a directory of set bits before each block of 512. Rank at a
text's edges gives its number of lines n; select on two ranks gives the bytes at
which it is cut, so neither lines nor texts are split into pieces first. The
vector is built slice by slice and takes an eighth of the text's bytes.

The cuts and the form (plain; prefix, suffix, middle; suffix, prefix, middle) are
drawn from a hash of the seed and the document's id, so they depend on nothing
else. A text that holds one of the three marks stays plain, and so does an empty
one; an output that is not plain thus holds each mark once, and ``restored``
rebuilds the text from output and form alone.

Defined results: a null text is empty; a null id counts as an empty one; repeated
rows are transformed alike; a text without a line end is one line; very long texts
are one row of work each; an empty table gives none; columns other than the text
pass through, those named like an output are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import utf8
from .common import frugal, prepare, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Hash seed, per cent of texts that are transformed, per cent of those in the form spm.
SEED, RATE, SPM_RATE = 7, 100, 50
#: Bytes of one word group of the directory, and of one slice while bits are packed.
BLOCK, SLICE = 64, 1 << 20
OUTPUT = "n int, form string, prefix_chars long, middle_chars long, output string"


class BitVector:
    """Packed bits with the number of set bits before each block."""

    def __init__(self, packed: np.ndarray, length: int):
        blocks = max(1, -(-len(packed) // BLOCK))
        self.bits = np.zeros(blocks * BLOCK, np.uint8)
        self.bits[: len(packed)] = packed
        self.length = length
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits).reshape(blocks, BLOCK).sum(axis=1, dtype=np.int64))])

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: int) -> int:
        """Set bits before position ``at``."""
        block = at // (8 * BLOCK)
        whole = self.bits[block * BLOCK : at // 8]
        out = int(self.before[block]) + int(np.bitwise_count(whole).sum(dtype=np.int64))
        return out + (int(self.bits[at // 8] >> (8 - at % 8)).bit_count() if at % 8 else 0)

    def select(self, r: int) -> int:
        """Position of the r-th set bit, from 1."""
        block = int(np.searchsorted(self.before, r, "left")) - 1
        left = r - int(self.before[block])
        counts = np.cumsum(np.bitwise_count(self.bits[block * BLOCK : (block + 1) * BLOCK]).astype(np.int64))
        byte = int(np.searchsorted(counts, left, "left"))
        left -= int(counts[byte - 1]) if byte else 0
        places = np.flatnonzero(np.unpackbits(self.bits[block * BLOCK + byte : block * BLOCK + byte + 1]))
        return (block * BLOCK + byte) * 8 + int(places[left - 1])


def line_ends(data: np.ndarray, offsets: np.ndarray) -> BitVector:
    """A bit for the last byte of every line of every text."""
    packed = np.zeros(-(-len(data) // 8), np.uint8)
    for low in range(0, len(data), SLICE):  # SLICE is a multiple of 8
        part = np.packbits(data[low : low + SLICE] == 0x0A)
        packed[low // 8 : low // 8 + len(part)] = part
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    np.bitwise_or.at(packed, last // 8, (0x80 >> (last % 8)).astype(np.uint8))
    return BitVector(packed, len(data))


def draws(key: str, seed: int) -> list[int]:
    """Four numbers of 32 bits."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def characters(raw: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return len(raw) - sum(int(np.count_nonzero((raw[i : i + SLICE] & 0xC0) == 0x80)) for i in range(0, len(raw), SLICE))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """The columns of ``docs`` but the text, with n, form, prefix_chars,
    middle_chars and output."""
    prepare(docs.sparkSession)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    new = T.StructType.fromDDL(OUTPUT)
    kept = [c for c in docs.columns if c != text and c not in new.names]

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(b.schema.names.index("_text")))
            ends = line_ends(data, offsets)
            raw, out = data.tobytes(), []
            for name, low, high in zip(b.column(b.schema.names.index("_id")).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                first = ends.rank(low)
                n = ends.rank(high) - first
                h1, h2, h3, h4 = draws(name or "", seed)
                if low == high or h3 % 100 >= rate or any(raw.find(x, low, high) >= 0 for x in marks):
                    out.append((n, "plain", None, None, raw[low:high]))
                    continue
                r1, r2 = sorted((h1 % (n + 1), h2 % (n + 1)))
                c1, c2 = (ends.select(first + r) + 1 if r else low for r in (r1, r2))
                prefix, middle, suffix = raw[low:c1], raw[c1:c2], raw[c2:high]
                spm = h4 % 100 < spm_rate
                joined = b"".join([s, suffix, p, prefix, m, middle] if spm else [p, prefix, s, suffix, m, middle])
                out.append((n, "spm" if spm else "psm", characters(data[low:c1]), characters(data[c1:c2]), joined))
            own = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int64(), pa.int64()))] if out else [pa.array([], t) for t in (pa.int32(), pa.string(), pa.int64(), pa.int64())]
            texts = pa.array([o[4] for o in out], pa.binary()).cast(pa.string())
            at = [b.schema.names.index(f"_in{i}") for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in at], *own, texts], [*kept, *new.names])

    own = docs.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("_text"), F.col(f"`{key}`").cast("string").alias("_id"))
    return own.mapInArrow(frugal(run), T.StructType([*[docs.schema[c] for c in kept], *new.fields]))


def restored(output: "F.Column", form: "F.Column") -> "F.Column":
    """The text that ``fill_in_middle`` made ``output`` of, in its ``form``."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 13 over all of ``documents``."""
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n").cast("long").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
