"""Byte-level BPE of whole texts by overlapping chunks, and back to bytes.

A text of more than one chunk is cut every ``stride`` code points into chunks
that run ``overlap`` code points into the next. Chunks are rows: tasks split them
into pre-tokens in parallel, each from its own start, which may lie inside a
pre-token. Two neighbours are stitched where their boundaries resynchronise: the
splitter has no memory, so from the first place in the overlap that both call a
boundary they agree. Such places count only after a character that is no white
space (what is cut off there does not change the pre-tokens before) and two
characters before a chunk's end (contractions and runs look that far). A place
where white space follows is a boundary of any scan and stands by itself; others
count if all before them back to such a place, or to the start, were found. Where
neighbours do not meet, as in a run of letters longer than the overlap, their
chunks stay together. The pieces between the stitches are then encoded as rows of
their own, and a text's ids are those of its pieces in order.

The splitter used for boundaries takes the class of a character (letter, digit,
space, other) from the encoder itself, so that both go by one edition of Unicode.

Decoding looks up the bytes of each id and concatenates them, piece by piece.

Defined results: a null text is empty and has one piece without ids; repeated
rows and null ids are texts of their own; texts of any length are cut, so no task
encodes more than a piece at once; an empty table gives none; columns other than
the text pass through, those named like an output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, materialised, prepare, table

#: Code points of a chunk's own part, and of what it shares with the next.
STRIDE, OVERLAP = 1 << 15, 512
#: Characters before a chunk's end whose boundaries may depend on what follows it.
LOOK_AHEAD = 2
#: Bytes of ids in one batch of results, about.
FLUSH = 4 << 20


@lru_cache(maxsize=4)
def encoder(ranks: str, pattern: str):
    """The tiktoken encoder of a rank file, once a worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


class _Classes(dict):
    """Characters beyond ASCII by one that stands for their class. Two characters
    are of one class where the encoder's pattern keeps them in one pre-token,
    which a vocabulary of pairs makes visible."""

    STANDS = {"a": "\u00e9", "1": "\u00b2", "!": "\u00a7", " ": "\t"}  # a blank itself may begin a pre-token

    def __init__(self, pattern: str):
        import tiktoken

        pairs = [bytes([b]) for b in range(256)] + [p.encode() + bytes([b]) for p in "a1!" for b in range(256)]
        self.probe = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={x: i for i, x in enumerate(pairs)}, special_tokens={})

    def __missing__(self, code: int) -> str:
        if code < 128:
            out = chr(code)
        else:
            joined = [p for p in "a1!" if self.probe.encode_ordinary(p + chr(code))[0] > 255]
            out = self.STANDS[joined[0] if joined else " "]
        self[code] = out
        return out


class Splitter:
    """Boundaries of pre-tokens as the encoder sees them."""

    def __init__(self, pattern: str):
        import regex

        self.pattern, self.classes = regex.compile(pattern), _Classes(pattern)

    def ends(self, text: str) -> tuple[np.ndarray, str]:
        """(places after each pre-token, the text with classes for characters)."""
        plain = text if text.isascii() else text.translate(self.classes)
        return np.fromiter((m.end() for m in self.pattern.finditer(plain)), np.int64), plain


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


def cut(text: str, stride: int, overlap: int) -> list[tuple[int, str, bool]]:
    """(start, chunk with what it shares with the next, is it the last)."""
    starts = range(0, max(len(text), 1), stride)
    return [(s, text[s : s + stride + overlap], s + stride >= len(text)) for s in starts]


def marks(split: Splitter, start: int, chunk: str, last: bool, stride: int, overlap: int, whole: bool) -> tuple[list[int], list[int], list[int]]:
    """Boundaries of a chunk's scan, as places in the text: those where it begins
    (up to the overlap's end), those where it runs into the next chunk, and those
    of the latter that any scan has. ``whole``: the chunk reaches the text's end."""
    ends, plain = split.ends(chunk)
    ends = np.concatenate([[0], ends])
    if not whole:
        ends = ends[ends <= len(chunk) - LOOK_AHEAD]
    head = ends[ends <= overlap]
    tail = ends[(ends >= stride) & (ends <= stride + overlap)] if not last else ends[:0]
    tail = [e for e in tail.tolist() if not plain[e - 1].isspace()]
    sure = [e for e in tail if e < len(plain) and plain[e].isspace()]
    return (head + start).tolist(), [e + start for e in tail], [e + start for e in sure]


def _encode(ranks: str, pattern: str, texts: list[str]) -> pa.Array:
    enc = encoder(ranks, pattern)
    got = [enc.encode_to_numpy(t, disallowed_special=()) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got).astype(np.int32) if got else np.empty(0, np.int32)))


def chunks(texts: DataFrame, pattern: str, stride: int, overlap: int) -> DataFrame:
    """Rows (_doc, _row, chunk, start, text, head, tail, sure) of (_doc, _text)."""

    def run(batches):
        split, n = splitter(pattern), 0
        part = TaskContext.get().partitionId()
        names = ["_doc", "_row", "chunk", "start", "text", "head", "tail", "sure"]
        for b in batches:
            for i, text in enumerate(b.column("_text")):
                text, row, n = text.as_py(), part << 33 | n, n + 1
                out, doc, size = [], b.column("_doc").slice(i, 1), 0
                for k, (start, chunk, last) in enumerate(cut(text, stride, overlap)):
                    out.append((row, k, start, chunk, *marks(split, start, chunk, last, stride, overlap, start + len(chunk) == len(text))))
                    size += len(chunk)
                    if size >= FLUSH or last:
                        own = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3))]
                        yield pa.RecordBatch.from_arrays([doc.take(pa.array([0] * len(out))), *own], names)
                        out, size = [], 0

    kind = texts.schema["_doc"].dataType
    fields = [T.StructField("_doc", kind), T.StructField("_row", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("text", T.StringType())]
    places = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("head", "tail", "sure")]
    return texts.mapInArrow(frugal(run), T.StructType([*fields, *places]))


def stitched(cut_up: DataFrame) -> DataFrame:
    """(_row, chunk, piece, start of its part, end of its part or null): which
    piece each chunk belongs to and what of it; only boundaries are moved."""
    own = cut_up.select("_row", "chunk", "start", "head", "tail", "sure")
    before = Window.partitionBy("_row").orderBy("chunk")
    first = F.col("chunk") == 0
    common = lambda c: F.array_min(F.array_intersect(F.lag(c).over(before), F.col("head")))
    met = own.select("_row", "chunk", "start", common("tail").alias("any"), common("sure").alias("certain"))
    # a place that another scan would not have counts while all since the last certain one were found
    since = lambda c: F.coalesce(F.max(F.when(c, F.col("chunk"))).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    held = met.select("*", since(first | F.col("certain").isNotNull()).alias("known"), since(~first & F.col("any").isNull()).alias("lost"))
    place = F.when(first, F.lit(0).cast("long")).otherwise(F.coalesce("certain", F.when(F.col("known") > F.col("lost"), F.col("any"))))
    placed = held.select("_row", "chunk", "start", place.alias("at"))
    piece = (F.count("at").over(before) - 1).cast("int")
    low, high = F.coalesce("at", "start"), F.coalesce(F.lead("at").over(before), F.lead("start").over(before))
    return placed.select("_row", "chunk", piece.alias("piece"), low.alias("low"), high.alias("high"))


def _encoded_pieces(parts: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(_doc, _row, piece, ids) of the parts (_doc, _row, piece, chunk, part),
    which come by piece and in order."""

    def run(batches):
        held, texts, done = None, [], []

        def flush(done):
            docs, rows, pieces, texts = zip(*done)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(docs), pa.array(rows, pa.int64()), pa.array(pieces, pa.int32()), _encode(ranks, pattern, list(texts))], ["_doc", "_row", "piece", "ids"])

        size = 0
        for b in batches:
            for i, (row, piece, part) in enumerate(zip(b.column("_row").to_pylist(), b.column("piece").to_pylist(), b.column("part").to_pylist())):
                if held is None or held[1:] != (row, piece):
                    if held:
                        done.append((*held, "".join(texts)))
                        size += len(done[-1][-1])
                        if size >= FLUSH:
                            yield flush(done)
                            done, size = [], 0
                    held, texts = (b.column("_doc").slice(i, 1), row, piece), []
                texts.append(part)
        if held:
            yield flush([*done, (*held, "".join(texts))])

    fields = [T.StructField("_doc", parts.schema["_doc"].dataType), T.StructField("_row", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return parts.mapInArrow(frugal(run), T.StructType(fields))


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """The columns of ``docs`` but the text, with ``piece`` (from 0) and ``ids``.
    The pieces of a text are rows of one partition, one after the other."""
    if not 0 < overlap < stride:
        raise ValueError("the overlap must be less than the stride")
    prepare(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = T.StructType([T.StructField("_doc", base.schema["_doc"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def whole(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("_doc"), pa.array(np.zeros(b.num_rows, np.int32)), _encode(ranks, pattern, b.column("_text").to_pylist())], ["_doc", "piece", "ids"])

    short = base.where(F.length("_text") <= stride + overlap).mapInArrow(frugal(whole), schema)
    cut_up = materialised(chunks(base.where(F.length("_text") > stride + overlap), pattern, stride, overlap))
    places = stitched(cut_up)
    part = F.substring(F.col("text"), (F.col("low") - F.col("start") + 1).cast("int"), (F.coalesce(F.col("high") - F.col("low"), F.length("text"))).cast("int"))
    parts = cut_up.select("_doc", "_row", "chunk", "start", "text").join(places, ["_row", "chunk"]).select("_doc", "_row", "piece", "chunk", part.alias("part"))
    by_piece = parts.repartition("_row", "piece").sortWithinPartitions("_row", "piece", "chunk")
    long = _encoded_pieces(by_piece, ranks, pattern).repartition("_row").sortWithinPartitions("_row", "piece").select("_doc", "piece", "ids")
    kept = [F.col(f"_doc.`{c}`").alias(c) for c in others if c not in ("piece", "ids")]
    return short.unionByName(long).select(*kept, "piece", "ids")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encoded`` with ``bytes``, the raw bytes of each row's ids: a piece may
    begin or end anywhere but inside a character."""

    def run(batches):
        enc = encoder(ranks, pattern)
        for b in batches:
            raw = [enc.decode_bytes(i) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [*b.schema.names, "bytes"])

    return encoded.mapInArrow(frugal(run), T.StructType([*encoded.schema.fields, T.StructField("bytes", T.BinaryType())]))


def digests(encoded: DataFrame, ranks: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each text; pieces are read
    one after the other, so a text of any length takes the memory of one."""

    def run(batches):
        enc, state = encoder(ranks, pattern), None
        names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]

        def result(states):
            return pa.RecordBatch.from_arrays([pa.concat_arrays([s[0] for s in states]), pa.array([s[1] for s in states], pa.int64()), *(pa.array([s[k].hexdigest() for s in states], pa.string()) for k in (2, 3))], names)

        for b in batches:
            done = []
            for i, (piece, ids) in enumerate(zip(b.column("piece").to_pylist(), b.column("ids").to_pylist())):
                if piece == 0:
                    if state:
                        done.append(state)
                    state = [b.column(key).slice(i, 1), 0, hashlib.sha256(), hashlib.sha256()]
                if ids:
                    state[2].update(("," * (state[1] > 0) + ",".join(map(str, ids))).encode())
                    state[3].update(enc.decode_bytes(ids))
                    state[1] += len(ids)
            if done:
                yield result(done)
        if state:
            yield result([state])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "piece", "ids").mapInArrow(frugal(run), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> tuple[str, str]:
    """(rank file, pattern) of the contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 12 over all of ``documents``."""
    return digests(encode(table(spark, sf_dir, "documents"), *vocabulary()), *vocabulary())
