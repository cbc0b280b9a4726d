"""Best-fit packing of token pieces into sequences, bulk-synchronous.

Documents are tokenised once and cut into pieces of at most ``size`` tokens.
Whole pieces fill a sequence; the others are matched with the gaps of sequences
in rounds. A round range-sorts the lengths of the highest class left (those
above half of the greatest) and the gaps, and sweeps both upwards: every gap
takes the longest piece that fits and that no smaller gap took, its predecessor,
which is to say that every piece gets the smallest gap that is left for it, its
successor. Where several pieces of a length and several gaps of a size meet, the
r-th by rank gets the r-th. Gaps are updated and the next round follows; when no
gap holds a piece of the class, new sequences open.

Lengths and gaps are whole numbers up to ``size``, so the sorted lists are
histograms with ranks inside each length: Spark counts the lengths by partition
and merges the counts, one task sweeps over at most ``size`` runs of ranks,
however many documents there are, and the table of matches is applied to every
piece. A piece's rank is the count of its length in the partitions before its
own (a prefix sum over partitions) and its place in its partition, so a length
that a third of all rows share is no hot key.

Defined results: a null text is empty and has the end token alone; ties and
repeated rows are packed as separate pieces in any order; an empty table gives
none. Input columns other than the key pass through; those named like an output
are replaced.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, materialised, prepare, table

SIZE, END = 4096, 1
#: Words whose tokens a worker keeps.
CACHED_WORDS = 400_000


def successor_sweeps(counts: dict[int, int], size: int) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset) that place all
    ``counts[length]`` pieces of each length up to ``size``."""
    left = {n: (0, many) for n, many in counts.items() if many}  # first rank and number of ranks to place
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    out, opened = [], 0
    while left:
        top = max(left)
        lengths = sorted(n for n in left if 2 * n >= top)
        if not gaps or max(gaps) < lengths[0]:
            new = max(1, sum(n * left[n][1] for n in lengths) // size)
            gaps.setdefault(size, []).append((opened, new))
            opened += new
        waiting, at, smaller = [], 0, []  # lengths that fit the gap, the longest last
        for gap in sorted(g for g in gaps if g >= lengths[0]):
            while at < len(lengths) and lengths[at] <= gap:
                waiting.append(lengths[at])
                at += 1
            runs = gaps[gap]
            while runs and waiting:
                n = waiting[-1]
                (first, many), (rank, rest) = runs.pop(), left[n]
                take = min(many, rest)
                out.append((n, rank, take, first, size - gap))
                smaller.append((gap - n, first, take))
                left[n] = (rank + take, rest - take)
                if take < many:
                    runs.append((first + take, many - take))
                if take == rest:
                    del left[n]
                    waiting.pop()
            if not runs:
                del gaps[gap]
        for gap, first, many in smaller:  # gaps of this round count from the next on
            if gap:
                gaps.setdefault(gap, []).append((first, many))
    return np.array(out, np.int64).reshape(-1, 5)


def matches(lengths: DataFrame, size: int) -> np.ndarray:
    """successor_sweeps() of rows (length, n), in one task: at most ``size`` rows."""
    names = ["length", "rank", "n", "sequence", "offset"]

    def run(batches):
        counts: dict[int, int] = {}
        for b in batches:
            counts.update(zip(b.column("length").to_pylist(), b.column("n").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in successor_sweeps(counts, size).T], names)

    got = lengths.coalesce(1).mapInArrow(run, ", ".join(f"{c} long" for c in names)).toArrow()
    return np.stack([got.column(c).to_numpy() for c in names], axis=1)


#: The signs that stand for bytes in the vocabulary: printable ones themselves,
#: the others, in order, from 256 on.
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


#: Signs that, but for the apostrophe, join each other and nothing else.
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


class _Encoded(dict):
    """Token ids, as bytes, by lower-case word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)

    def text(self, text: bytes) -> bytes:
        return np.array(self.encoder.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def letters(word: bytes) -> str | None:
        """A word of Latin-1 letters alone as the merges see it: the steps before
        them would leave it one piece. None for other words."""
        if word.isalpha():  # ASCII
            return word.decode()
        text = word.decode()
        if not text.isalpha() or max(text) > "\xff":
            return None
        return text.lower().encode().decode("latin-1").translate(_BYTE_SIGNS)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = out = self._encoded(word)
        return out

    def _encoded(self, word: bytes) -> bytes:
        piece = self.letters(word)
        if piece is not None:
            return array("I", [t.id for t in self.encoder.model.tokenize(piece)]).tobytes()
        body = word.rstrip(_SIGNS)
        if len(body) < len(word) and self.letters(body) is not None:  # after a Latin-1 letter the signs are a piece by themselves
            return (self[body] if body in self else self._encoded(body)) + self[word[len(body) :]]
        return self.text(word)


_ENCODERS: dict[str, _Encoded] = {}


def encode(text: str | None, path: str) -> np.ndarray:
    """The ids of ``text``: each word by itself, as this tokenizer drops white
    space and joins nothing across it. Texts that may hold the special
    tokens' strings, which count in one case only, go to it whole."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoded(path)
    known, data = _ENCODERS[path], (text or "").encode()
    if b"<|" in data:
        return np.frombuffer(known.text(data), "<u4")
    return np.frombuffer(b"".join(map(known.__getitem__, data.lower().split())), "<u4")


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, and where its
    task has it among the pieces of that length (_part, _place). Written."""
    prepare(docs.sparkSession)
    id_type = docs.schema[key].dataType

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(t, tokenizer), np.uint32(end))
                for k, start in enumerate(range(0, len(ids), size)):
                    own = ids[start : start + size]
                    place = seen[len(own)] = seen.get(len(own), -1) + 1
                    rows.append((i, k, start, len(own), zlib.crc32(own.astype("<u4").tobytes()), part, place))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], [key, "piece", "start", "length", "ids_crc32", "_part", "_place"])

    schema = T.StructType([T.StructField(key, id_type), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")], T.StructField("_part", T.IntegerType()), T.StructField("_place", T.LongType())])
    return materialised(docs.select(key, text).mapInArrow(frugal(run), schema))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, key, text, size, end)
    by_part = cut.groupBy("_part", "length").count()
    before = by_part.select("_part", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("_part")) - F.col("count")).alias("_before"))
    # a match ends a run of pieces or of gaps, of which there are at most ``size`` sizes
    plan = spark.sparkContext.broadcast(matches(by_part.groupBy("length").agg(F.sum("count").alias("n")), size))

    def place(batches):
        moves = plan.value
        order = np.lexsort((moves[:, 1], -moves[:, 0]))
        moves = moves[order]
        # one key for (length, rank), lengths in falling order
        base = np.concatenate([[0], np.cumsum(moves[:, 2])])
        first_of = {int(x): int(b) for x, b in zip(moves[::-1, 0], base[:-1][::-1])}
        for b in batches:
            n, rank = np.asarray(b.column("length")), np.asarray(b.column("_before")) + np.asarray(b.column("_place"))
            at = rank + np.array([first_of[x] for x in n.tolist()], np.int64)
            m = np.searchsorted(base, at, "right") - 1
            names = [c for c in b.schema.names if not c.startswith("_")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(moves[m, 3] + at - base[m]), pa.array(moves[m, 4])], [*names, "sequence_id", "offset"])

    schema = T.StructType([*cut.drop("_part", "_place").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return cut.join(before, ["_part", "length"]).select(*[f.name for f in cut.schema.fields], "_before").mapInArrow(place, schema)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 3 over all of ``documents``."""
    out = pack(table(spark, sf_dir, "documents"), word_tokenizer())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
