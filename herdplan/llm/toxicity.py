"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities and counts of lexicon words (a short fixed
list, and words and word beginnings mined from the labels), how many of them
stand near a second-person word, shares of capitals, punctuation and digits, and
how many words are a lexicon word only after look-alike characters are undone.
The mined lexicons are the words, and beginnings of 3 to 9 bytes, that are
almost only found in toxic documents of the sample; copies of a document
count together as one. Features for training come from lexicons mined without
the document's own fold, as do the scores that the calibration is fitted on.

Defined results: a null or empty text has all features 0 and scores as such;
without rows of both labels every score is the sample's share of label 1 (0.5
without rows); other columns pass through, an input column ``score`` is
replaced.
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

THRESHOLD = 0.5
#: Insults of the fixed lexicon, and words that address the reader.
INSULTS = "idiot moron stupid loser scum worthless pathetic trash disgusting clown imbecile dumb jerk fool filth vermin bastard crap shit fuck bitch asshole dumbass retard whore slut".split()
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch tu te ton ta tes vous votre vos toi usted ustedes tú ti su sus vosotros".split()
NEAR = 5
PREFIXES = tuple(range(3, 10))
#: A mined entry: documents of label 1 that hold it at least, and their share.
SUPPORT, PREFIX_SUPPORT, PRECISION = 4.0, 6.0, 0.9
FOLDS = 4
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.2, 32, 8.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Look-alike characters undone: fixed values.
_LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_UNDONE = _LOWER.copy()
for _a, _b in _LOOKALIKE.items():
    _UNDONE[ord(_a)] = ord(_b)
_UNDONE_KEPT = _LETTER[_UNDONE]
_TABLE = A.byte_table(61, ~_LETTER)
#: Digits and signs that may stand for a letter or split a word.
_ODD = np.zeros(256, bool)
_ODD[[*range(48, 58), *b"@$*.-_"]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

_DOC = A.stream(66, 1)[0]
N_FEATURES = 17


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case."""
    out = _LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    up = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[up] += 0x20
    return out


def hash_strings(words: list[str]) -> np.ndarray:
    data, offsets = A.utf8(pa.array(words))
    low = lower(data)
    starts, _, _ = A.words(low, offsets, ~_LETTER)
    return np.unique(A.hash_words(low, starts, _TABLE, 62))


def _prefixes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(length, words that long or longer, hash of their beginning)."""
    power, total, rows = A.powers(max(PREFIXES), 63), np.zeros(len(starts), np.uint64), np.arange(len(starts))
    for k in range(max(PREFIXES)):
        keep = ends[rows] - starts[rows] > k
        rows, total = rows[keep], total[keep]
        total = total + _TABLE[low[starts[rows] + k]] * power[k]
        if k + 1 in PREFIXES:
            yield k + 1, rows, A.mix(total + np.uint64(k + 1))


class Lexicons:
    """Mined words and beginnings as sorted hashes, behind a bitmap each."""

    def __init__(self, words: np.ndarray, prefixes: dict[int, np.ndarray]):
        self.words, self.prefixes = np.unique(words), {k: np.unique(v) for k, v in prefixes.items()}

    @staticmethod
    def has(h: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        if len(own):
            seen = np.zeros(1 << 16, bool)
            seen[(own & np.uint64(0xFFFF)).astype(np.int64)] = True
            maybe = np.flatnonzero(seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.searchsorted(own, h[maybe])
            out[maybe] = own[np.minimum(at, len(own) - 1)] == h[maybe]
        return out


_INSULTS = hash_strings(INSULTS)
_SECOND = hash_strings(SECOND_PERSON)


def _tokens(data: np.ndarray, offsets: np.ndarray):
    low = lower(data)
    starts, ends, owner = A.words(low, offsets, ~_LETTER)
    return low, starts, ends, owner, A.hash_words(low, starts, _TABLE, 62)


def features(texts: pa.Array | pa.ChunkedArray, lexicons: Lexicons) -> np.ndarray:
    """One row of N_FEATURES numbers a text."""
    data, offsets = A.utf8(texts)
    return np.concatenate([_features(part, off, lexicons) for _, _, part, off in A.slices(data, offsets)] or [np.empty((0, N_FEATURES))])


def _features(data: np.ndarray, offsets: np.ndarray, lexicons: Lexicons) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    if not len(data):
        return out
    low, starts, ends, owner, h = _tokens(data, offsets)
    per_word = lambda flags: np.bincount(owner[flags], minlength=n)[:n]
    fixed, mined = lexicons.has(h, _INSULTS), lexicons.has(h, lexicons.words)
    begins = np.zeros(len(h), bool)
    for k, rows, p in _prefixes(low, starts, ends):
        if k in lexicons.prefixes:
            begins[rows[lexicons.has(p, lexicons.prefixes[k])]] = True
    hit = fixed | mined | begins
    second = np.flatnonzero(lexicons.has(h, _SECOND))
    near = np.zeros(len(h), bool)
    at = np.flatnonzero(hit)
    if len(second) and len(at):
        place = np.searchsorted(second, at)
        for side in (np.maximum(place - 1, 0), np.minimum(place, len(second) - 1)):
            near[at] |= (np.abs(second[side] - at) <= NEAR) & (owner[second[side]] == owner[at])
    words = np.bincount(owner, minlength=n)[:n]
    per_byte = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
    upper, letters = per_byte((data >= 65) & (data <= 90)), per_byte(_LETTER[data])
    size = np.diff(offsets)
    # whole chunks with look-alikes undone, against the same chunks plain
    cs, ce, co = A.words(data, offsets)
    mixed = np.zeros(len(cs), bool)
    if len(cs):
        odd = _ODD[data]
        odd[:-1] &= _LETTER[data[1:]]  # inside a word: a letter follows
        odd[-1] = False
        has_odd, has_letter = np.add.reduceat(odd, cs) > 0, np.add.reduceat(_LETTER[data], cs) > 1
        mixed = has_odd & has_letter
    hidden = np.zeros(len(cs), bool)
    some = np.flatnonzero(mixed)
    if len(some):  # the letters of all such chunks, one chunk after the other
        width = ce[some] - cs[some]
        raw = data[np.repeat(cs[some] - np.cumsum(width) + width, width) + np.arange(width.sum())]
        keep = _UNDONE_KEPT[raw]
        first = np.concatenate([[0], np.cumsum(keep)])[np.cumsum(width) - width]
        plain = _UNDONE[raw[keep]]
        own = A.hash_words(plain, first, _TABLE, 62)
        long = np.diff(np.append(first, len(plain))) > 2
        hidden[some] = long & (lexicons.has(own, _INSULTS) | lexicons.has(own, lexicons.words))
    if hidden.any():  # a chunk whose plain word is in a lexicon already is not hidden
        plain_hit = np.zeros(len(cs) + 1, np.int64)
        np.add.at(plain_hit, np.searchsorted(cs, starts[hit], "right") - 1, 1)
        hidden &= plain_hit[:-1] == 0
    hidden_n, mixed_n = np.bincount(co[hidden], minlength=n)[:n], np.bincount(co[mixed], minlength=n)[:n]
    hits = per_word(hit)
    out.T[:] = (
        np.log1p(words), per_word(fixed), per_word(fixed) / (words + 1), per_word(mined), per_word(mined) / (words + 1),
        per_word(begins), per_word(begins) / (words + 1), hits, hits / (words + 1), per_word(near), near_share(per_word(near), hits),
        upper / (letters + 1), per_byte(data == 33) / (size + 1), per_byte(_PUNCT[data]) / (size + 1), per_byte((data >= 48) & (data <= 57)) / (size + 1),
        hidden_n, (hidden_n + 0.0) / (mixed_n + 1),
    )
    return out


def near_share(near: np.ndarray, hits: np.ndarray) -> np.ndarray:
    return near / (hits + 1)


def mine(texts: pa.ChunkedArray, labels: np.ndarray) -> Lexicons:
    """Words and beginnings found almost only in documents of label 1.

    A document shares its weight with those of the same least 5-word shingle,
    by either of two hashes, so copies of one text do not make its words.
    """
    data, offsets = A.utf8(texts)
    entries = {k: ([], []) for k in (0, *PREFIXES)}
    least = np.zeros((2, len(labels)), np.uint64)
    for first, past, part, off in A.slices(data, offsets):
        low, starts, ends, owner, h = _tokens(part, off)
        for kind, rows, x in ((0, np.arange(len(h)), h), *_prefixes(low, starts, ends)):
            # one of each entry of a document: by a hash of both
            _, once = np.unique(A.mix(x + A.mix(owner[rows].astype(np.uint64) + _DOC)), return_index=True)
            entries[kind][0].append((owner[rows[once]] + first).astype(np.int32))
            entries[kind][1].append(x[once])
        if len(h) >= 5:
            for j in range(2):
                w = A.window_hash(h, 5, 64 + j)
                own = owner[: len(w)]
                begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                least[j, first + own[begin]] = np.minimum.reduceat(w, begin)
    weight = np.ones(len(labels))
    for row in least:
        _, place, counts = np.unique(row, return_inverse=True, return_counts=True)
        weight = np.minimum(weight, 1 / counts[place])
    found = {}
    for kind in (0, *PREFIXES):  # each kind's entries go when it is done
        docs, keys = (np.concatenate(x or [np.empty(0, np.int32)]) for x in entries.pop(kind))
        order = np.argsort(keys, kind="stable")
        docs, keys = docs[order], keys[order].astype(np.uint64)
        begin = np.flatnonzero(np.append(np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
        toxic, every = (np.add.reduceat(x[docs], begin) if len(begin) else np.empty(0) for x in (weight * labels, weight))
        found[kind] = keys[begin[(toxic >= (PREFIX_SUPPORT if kind else SUPPORT)) & (toxic >= PRECISION * every)]]
    return Lexicons(found.pop(0), found)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict:
    """Boosted trees of the logistic loss on quantile bins."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [np.unique(np.append(e, [0.0, 1e-9])) for e in edges]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    width = int(max(len(e) for e in edges)) + 1
    flat = bins + np.arange(x.shape[1]) * width
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, forest = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, w = y - p, p * (1 - p)
        feature, cut, value = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, width, np.int64), np.zeros(2**depth)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for own in range(2**level):
                i, rows = 2**level - 1 + own, np.flatnonzero(node == own)
                if not len(rows):
                    continue
                cells = flat[rows].ravel()
                gs = np.bincount(cells, np.repeat(g[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
                ws = np.bincount(cells, np.repeat(w[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
                cs = np.bincount(cells, minlength=x.shape[1] * width).reshape(-1, width).cumsum(1)
                gain = gs**2 / (ws + 1) + (gs[:, -1:] - gs) ** 2 / (ws[:, -1:] - ws + 1) - gs[:, -1:] ** 2 / (ws[:, -1:] + 1)
                gain[(cs < LEAF) | (cs[:, -1:] - cs < LEAF)] = 0
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] > 1e-6:
                    feature[i], cut[i] = f, b
            node = node * 2 + (bins[np.arange(len(y)), feature[2**level - 1 + node]] > cut[2**level - 1 + node])
        for leaf in range(2**depth):
            rows = node == leaf
            value[leaf] = rate * g[rows].sum() / (w[rows].sum() + 1)
        margin += value[node]
        forest.append((feature, cut, value))
    return {"edges": edges, "base": base, "trees": forest, "depth": depth}


def margins(x: np.ndarray, model: dict) -> np.ndarray:
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(model["edges"])], axis=1)
    out, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for feature, cut, value in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for level in range(model["depth"]):
            i = 2**level - 1 + node
            node = node * 2 + (bins[rows, feature[i]] > cut[i])
        out += value[node]
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins, probabilities): the rising steps nearest to the labels."""
    order = np.argsort(score, kind="stable")
    s, means, sizes, firsts = score[order], [], [], []
    for i, v in enumerate(y[order].astype(float)):
        means.append(v)
        sizes.append(1)
        firsts.append(i)
        while len(means) > 1 and means[-2] >= means[-1]:
            total = sizes[-1] + sizes[-2]
            means[-2] = (means[-1] * sizes[-1] + means[-2] * sizes[-2]) / total
            sizes[-2] = total
            means.pop(), sizes.pop(), firsts.pop()
    firsts = np.array(firsts)
    middle = [s[a : a + n].mean() for a, n in zip(firsts, sizes)]
    return np.array(middle), np.array(means)


def train(texts: pa.ChunkedArray, labels: np.ndarray) -> dict:
    if len(set(labels.tolist())) < 2:
        return {"share": float(labels.mean()) if len(labels) else 0.5}
    part = np.random.default_rng(6).integers(0, FOLDS, len(labels))
    x = np.zeros((len(labels), N_FEATURES))
    for k in range(FOLDS):
        own, rest = np.flatnonzero(part == k), np.flatnonzero(part != k)
        if len(own):
            x[own] = features(texts.take(pa.array(own)), mine(texts.take(pa.array(rest)), labels[rest]))
    out_of_fold = np.zeros(len(labels))
    for k in range(FOLDS):
        own = part == k
        out_of_fold[own] = margins(x[own], grow(x[~own], labels[~own]))
    return {"lexicons": mine(texts, labels), "model": grow(x, labels), "steps": isotonic(out_of_fold, labels)}


def score(texts: pa.Array, trained: dict) -> np.ndarray:
    """Calibrated probability of label 1 of each text."""
    if "share" in trained:
        return np.full(len(texts), trained["share"])
    margin = margins(features(texts, trained["lexicons"]), trained["model"])
    # a thousandth of the plain logistic keeps the order inside the steps
    return 0.999 * np.interp(margin, *trained["steps"]) + 0.001 / (1 + np.exp(-margin))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the calibrated probability of label 1."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop("score")
    trained = spark.sparkContext.broadcast(train(*training_sample(docs, labels, label)))  # bounded by the sample

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(b.column(text), trained.value))], [*b.schema.names, "score"])

    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 2 over all of ``documents``."""
    out = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
