"""Language-model scoring by the marginal likelihood of a subword lattice.

The pieces of an existing vocabulary, weighted by its scores, span a lattice over
the bytes of each word: every way to cut the word into pieces is a path. A
forward recursion in log space sums all paths, so a word's probability does not
hang on one segmentation; a text is its words, each with the mark of a word's
begin, and one end. Byte pieces reach every text. The vocabulary's scores order
its pieces only, so the first weights fall with the rank; one step of
expectation-maximisation over all training texts, with the expected count of
every piece over all paths, gives the weights that score.

Words and counts travel between blocks and shards as hashes: the same exchange
gives each word's count over the whole training part for the unigram baseline.

Defined results: a null or empty text is one end; without training texts the
baseline has N = V = 0 and the first weights stay; repeated rows count each;
ids that are null are in fold crc32('') as text. Input columns named like an
output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .blocks import FANOUT, answer, apply, ask, fans_for, frame, open_block, pack, pack_planes, pack_sorted, returned, shard_bounds, shards_for, unframe, unpack, unpack_planes, unpack_sorted, write_blocks
from .common import discard, fold, frugal, materialised, prepare, table

BLOCK_BYTES = 12 << 20
#: Training counts that the first weights are worth in the learned ones.
PRIOR = 1000.0
#: Cells (end, length, word) of a table of pieces at a time.
TABLE_CELLS = 1 << 20
#: Words of one length up to which each is summed by itself.
FEW_WORDS = 12
FOLDS, HELD_OUT = 7, 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = A.byte_table(31)
_END = A.stream(33, 1)[0]
_BASE = A.stream(34, 1)[0] | np.uint64(1)
_BYTE_VALUE = A.stream(35, 256) | np.uint64(1)
MARK = np.frombuffer("▁".encode(), np.uint8)


class Lattice:
    """The pieces of a vocabulary in a cuckoo table over hashes of their bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces: dict[bytes, int] = {}
        rank = np.zeros(n)
        for i in range(n):
            if sp.is_byte(i):
                text, rank[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)]), n
            elif sp.is_control(i) or sp.is_unknown(i):
                continue
            else:
                text, rank[i] = sp.id_to_piece(i).encode(), -sp.get_score(i)
            if text not in pieces or sp.is_byte(pieces[text]):
                pieces[text] = i
        self.size, ids = n, np.array(sorted(pieces.values()))
        by_id = {v: k for k, v in pieces.items()}
        texts = [by_id[i] for i in ids.tolist()]
        self.longest = max(len(x) for x in texts if x.strip("▁".encode()) != b"")
        first = np.full(n + 1, 0.0)
        first[ids] = 1 / (2.0 + rank[ids])
        first[n] = first.sum() / 1000  # the end
        self.first = first / first.sum()
        keys = np.array([self._key(x) for x in texts], np.uint64)
        self.bits = 17
        self.slot_key, self.slot_id = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for key, i in zip(keys, ids):
            spot = -1
            for _turn in range(500):
                at = [int(x[0]) for x in self._places(np.array([key]))]
                free = next((a for a in at if self.slot_id[a] < 0), None)
                spot = (at[1] if at[0] == spot else at[0]) if free is None else free
                key, self.slot_key[spot] = self.slot_key[spot], key
                i, self.slot_id[spot] = self.slot_id[spot], i
                if free is not None:
                    break
            else:
                raise ValueError("the piece table is too full")

    @staticmethod
    def _key(piece: bytes) -> np.uint64:
        total = np.zeros(1, np.uint64)
        for b in piece:
            total = total * _BASE + _BYTE_VALUE[b]
        return total[0]

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, shift = A.mix(keys), np.uint64(64 - self.bits)
        return (h >> shift).astype(np.int64), ((h << np.uint64(20)) >> shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each key; -1 where there is none."""
        one, two = self._places(keys)
        return np.where(self.slot_key[one] == keys, self.slot_id[one], np.where(self.slot_key[two] == keys, self.slot_id[two], -1))

    def into(self, words: np.ndarray, backwards: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(positions before, piece or -1 by end, length - 1 and word) of words
        of one length, for runs of ends of bounded size."""
        n, length = words.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _BASE + _BYTE_VALUE[words[:, j]]
        power = np.cumprod(np.full(length + 1, _BASE, np.uint64))
        step = max(1, TABLE_CELLS // (min(self.longest, length) * max(n, 1)))
        runs = range(0, length, step)
        for low in reversed(runs) if backwards else runs:
            high = min(length, low + step)
            piece = np.full((high - low, min(self.longest, high), n), -1, np.int32)
            for d in range(1, piece.shape[1] + 1):
                a = max(low + 1, d)
                piece[a - low - 1 :, d - 1] = self.find(prefix[a : high + 1] - prefix[a - d : high + 1 - d] * power[d - 1])
            yield low, piece

    def forward(self, words: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """ln of the summed probability of all ways to each position, in log space."""
        n, length = words.shape
        if n <= FEW_WORDS:
            return np.stack([self._forward(*self._found(w[None, :], log_p), length) for w in words], axis=1) if n else np.zeros((length + 1, 0))
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        padded = np.append(log_p, -np.inf)  # piece -1
        for low, piece in self.into(words):
            for j in range(low + 1, low + len(piece) + 1):
                d = min(j, self.longest)
                stack = alpha[j - d : j] + padded[piece[j - low - 1, d - 1 :: -1]]
                top = stack.max(axis=0)
                top = np.where(np.isfinite(top), top, 0.0)
                with np.errstate(divide="ignore"):
                    alpha[j] = top + np.log(np.exp(stack - top).sum(axis=0))
        return alpha

    def _found(self, word: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece, ln p) of every piece in one word, by end."""
        begins, ends, pieces = [], [], []
        for low, piece in self.into(word):
            row, d = np.nonzero(piece[:, :, 0] >= 0)
            begins.append(row + low - d)
            ends.append(row + low + 1)
            pieces.append(piece[row, d, 0])
        begin, end, piece = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (begins, ends, pieces))
        return begin, end, piece, log_p[piece]

    @staticmethod
    def _forward(begin: np.ndarray, end: np.ndarray, piece: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
        """forward() of one word: a word by itself has few pieces at a position."""
        out, begins, weights = [0.0], begin.tolist(), weight.tolist()
        cuts = np.searchsorted(end, np.arange(1, length + 2)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            ways = [out[i] + w for i, w in zip(begins[a:b], weights[a:b])]
            top = max(ways, default=-math.inf)
            out.append(top + math.log(sum([math.exp(x - top) for x in ways])) if top > -math.inf else top)
        return np.array(out)

    def log_marginal(self, words: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """ln of the summed probability of all segmentations."""
        return self.forward(words, log_p)[-1]

    def expected(self, words: np.ndarray, weights: np.ndarray, log_p: np.ndarray, out: np.ndarray) -> None:
        """Adds the expected count of each piece over all paths of the words, in log space."""
        n, length = words.shape
        if n <= FEW_WORDS:
            for word, weight in zip(words, weights.tolist()):
                begin, end, piece, w = self._found(word[None, :], log_p)
                alpha = self._forward(begin, end, piece, w, length)
                back = np.argsort(length - begin, kind="stable")  # the same from the other side
                beta = self._forward(length - end[back], length - begin[back], piece[back], w[back], length)[::-1]
                whole = alpha[length] if np.isfinite(alpha[length]) else 0.0
                out += np.bincount(piece, np.exp(alpha[begin] + w + beta[end] - whole) * weight, len(out))
            return
        alpha, beta = self.forward(words, log_p), np.full((length + 1, n), -np.inf)
        beta[length] = 0
        padded = np.append(log_p, -np.inf)
        whole = np.where(np.isfinite(alpha[length]), alpha[length], 0.0)
        for low, piece in self.into(words, backwards=True):
            count = np.zeros(piece.shape)
            for j in range(low + len(piece), low, -1):
                d = min(j, self.longest)
                rest = padded[piece[j - low - 1, d - 1 :: -1]] + beta[j]
                beta[j - d : j] = np.logaddexp(beta[j - d : j], rest)
                count[j - low - 1, d - 1 :: -1] = np.exp(alpha[j - d : j] + rest - whole) * weights
            some = piece >= 0
            out += np.bincount(piece[some], count[some], len(out))


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def _words(t: pa.Table, text: str):
    """(bytes in lower case, starts, ends, document, hash) of a block's words."""
    data, offsets = A.utf8(t.column(text))
    low = _LOWER[data]
    starts, ends, docs, keys = [], [], [], []
    for first, past, part, off in A.slices(low, offsets):
        s, e, d = A.words(part, off)
        if len(s):
            starts.append(s + offsets[first])
            ends.append(e + offsets[first])
            docs.append(d + first)
            keys.append(A.hash_words(part, s, _TABLE, 32))
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return low, join(starts, np.int64), join(ends, np.int64), join(docs, np.int64), join(keys, np.uint64)


def _by_length(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: int = 20_000):
    """(which words, their bytes after the mark) in groups of one length."""
    size = ends - starts
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(size[order]) > 0)) if len(order) else np.empty(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        n = int(size[order[a]])
        step = max(1, rows * 8 // (n + 8))
        for low_at in range(a, b, step):
            some = order[low_at : min(b, low_at + step)]
            own = low[starts[some][:, None] + np.arange(n)]
            yield some, np.concatenate([np.broadcast_to(MARK, (len(some), len(MARK))), own], axis=1)


class Counts:
    """Words (hashes) and how often they occur in training texts."""

    def pack(self, arrays: tuple) -> bytes:
        return frame(pack_sorted(arrays[0]), pack_planes(arrays[1]))

    def unpack(self, m: bytes) -> tuple:
        keys, counts = unframe(m, 2)
        return unpack_sorted(keys, np.uint64), unpack_planes(counts, np.int64)

    def merge(self, parts: list[tuple]):
        keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, place, np.concatenate([p[1] for p in parts]))
        return (keys, total), np.split(place, np.cumsum([len(p[0]) for p in parts])[:-1])

    def root(self, merged: tuple) -> np.ndarray:
        return merged[1]

    def down(self, values, merged, place, own) -> np.ndarray:
        return values[place]

    def pack_values(self, values: np.ndarray) -> bytes:
        return pack_planes(np.ascontiguousarray(values))

    def unpack_values(self, m: bytes, n: int) -> np.ndarray:
        return unpack_planes(m, np.int64)

    def head(self, merged: tuple) -> bytes:
        """All occurrences in training texts, and how many words have any."""
        return np.array([merged[1].sum(), (merged[1] > 0).sum()], np.int64).tobytes()


def _piece_sums(messages: DataFrame, size: int) -> DataFrame:
    """(piece, n): the messages' dense sums, added in each partition first."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            for m in b.column("message"):
                total += unpack(m.as_py(), np.float64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])

    return messages.mapInArrow(frugal(run), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))


def _head_sums(heads: DataFrame) -> tuple[int, int]:
    def run(batches):
        for b in batches:
            if b.num_rows:
                own = np.array([np.frombuffer(x.as_py(), np.int64) for x in b.column("reply")])
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1])], ["n", "v"])

    row = heads.mapInArrow(run, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return int(row[0] or 0), int(row[1] or 0)


def score_texts(docs: DataFrame, vocabulary: str, train: Column, key: str = "doc_id", text: str = "text", fanout: int = FANOUT, shards: int | None = None) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score (log10 of the
    unigram baseline) and score (log10 of the lattice model's probability)."""
    spark = docs.sparkSession
    prepare(spark)
    outputs = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    docs = docs.drop(*[c for c, _ in outputs], "__lm_train").withColumn("__lm_train", F.coalesce(train, F.lit(False))).withColumn(text, F.col(text).cast("string"))
    blocks = write_blocks(docs, text, BLOCK_BYTES)
    total, senders = (x or 0 for x in blocks.agg(F.sum("bytes"), F.count("*")).first())
    fans = fans_for(shards or shards_for(total), fanout)
    ranges = fans[0]

    def question(payload: bytes, _):
        model = lattice(vocabulary)
        t = open_block(payload)
        low, starts, ends, doc, h = _words(t, text)
        learn = np.asarray(t.column("__lm_train"))
        own, first, place = np.unique(np.append(h, _END), return_index=True, return_inverse=True)
        counts = np.bincount(place, weights=np.append(learn[doc], 0), minlength=len(own)).astype(np.int64)
        end = int(np.searchsorted(own, _END))
        counts[end] += int(learn.sum())
        bounds = shard_bounds(own, ranges)
        for s in range(ranges):
            a, b = bounds[s], bounds[s + 1]
            if b > a:
                yield s, frame(b"", Counts().pack((own[a:b], counts[a:b])))
        expected, log_p = np.zeros(model.size + 1), np.log(np.maximum(model.first, 1e-300))
        expected[model.size] = counts[end]
        some = np.flatnonzero((counts > 0) & (first < len(h)) & (np.arange(len(own)) != end))
        for which, words in _by_length(low, starts[first[some]], ends[first[some]]):
            model.expected(words, counts[some[which]].astype(np.float64), log_p, expected)
        yield -1, pack(expected)  # expected piece counts of the block

    sent = materialised(ask(blocks, question))
    replies = materialised(answer(sent.where("shard >= 0"), Counts(), fans, senders, fanout=fanout))
    n_train, distinct = _head_sums(replies.where("block < 0"))
    first = lattice(vocabulary).first
    got, expected = _piece_sums(sent.where("shard < 0"), len(first)).toArrow(), np.zeros(len(first))  # a number a piece
    expected[got.column("piece").to_numpy()] = got.column("n").to_numpy()
    discard(sent)
    learned = spark.sparkContext.broadcast(np.log(np.maximum((expected + PRIOR * first) / (np.sum(expected) + PRIOR), 1e-300)))  # one number a piece

    def finish(payload: bytes, own_replies: dict) -> pa.Table:
        model, log_p = lattice(vocabulary), learned.value
        t = open_block(payload)
        low, starts, ends, doc, h = _words(t, text)
        own, first_at, place = np.unique(np.append(h, _END), return_index=True, return_inverse=True)
        bounds, counts = shard_bounds(own, ranges), np.zeros(len(own), np.int64)
        for s in range(ranges):
            a, b = bounds[s], bounds[s + 1]
            if b > a:
                counts[a:b] = Counts().unpack_values(unframe(own_replies[s], 2)[1], b - a)
        base = np.log10((counts + 1) / (n_train + distinct + 1))
        value = np.zeros(len(own))
        end = int(np.searchsorted(own, _END))
        some = np.flatnonzero((first_at < len(h)) & (np.arange(len(own)) != end))
        for which, words in _by_length(low, starts[first_at[some]], ends[first_at[some]]):
            value[some[which]] = model.log_marginal(words, log_p)
        value[end] = log_p[model.size]
        rows, n = np.append(doc, np.arange(t.num_rows)), t.num_rows
        token = np.append(place[:-1], np.full(n, end))
        per = lambda x: np.bincount(rows, weights=x[token], minlength=n)
        out = [pa.array(np.bincount(rows, minlength=n)), pa.array(per(counts > 0).astype(np.int64)), pa.array(np.full(n, n_train)), pa.array(per(base)), pa.array(per(value) / np.log(10))]
        t = t.drop_columns(["__lm_train"])
        for (name, _), column in zip(outputs, out):
            t = t.append_column(name, column)
        return t

    schema = T.StructType([*docs.drop("__lm_train").schema.fields, *[T.StructField(c, k) for c, k in outputs]])
    return apply(returned(blocks, replies), finish, schema)


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8 over all of ``documents``."""
    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    out = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_vocabulary(), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
