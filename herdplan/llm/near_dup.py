"""Near-duplicates by ProbMinHash, banding and exact verification.

A text's word shingles are weighted by 1 + log2(count) / 32: a repeated shingle
counts more, but never so much that texts whose sets are alike stop agreeing.
ProbMinHash draws, for each
shingle, a Poisson process whose rate is the weight; every arrival goes to a
random register, which keeps the earliest, and a shingle stops as soon as its
next arrival is later than the latest register. The chance that two texts agree
in a register is their probability Jaccard similarity. Registers are grouped
into bands; texts that agree in a band are candidates; candidates are verified
by the exact Jaccard similarity of their shingle sets (32-bit hashes), and
texts linked at ``threshold`` or more, directly or through others, are a class.

No task holds a bucket:
1. Equal texts are one node from the start, combined map-side. A node is a
   64-bit hash; a second hash tells different texts of one hash apart.
2. Each bucket has a hub, the node that meets most others in all its buckets
   (of copies of a text that is there, the text itself); every other node is
   verified against the hubs of its buckets, and links give components.
3. Every pair between components of a bucket that still holds several is
   verified or ruled out by an exact bound: two sets that are similar enough
   share a shingle among the first n - ceil(threshold n) + 1 of each in any
   common order, at places that leave room for the overlap. Nodes meet by
   these shingles, rare ones first, so that a passage that many texts share
   comes last and makes texts meet only where it is most of both.
No link between texts that share a bucket is lost.
Sizes that rule the threshold out drop a pair before its sets are fetched.

Pairs and node lists are sent to all executors only below BROADCAST_ROWS, by
count; larger ones are joined by shuffles.

Defined results: the class id is the least ``doc_id`` of the class; a text of
fewer words than a shingle is one shingle; texts without words are only alike
when equal; a null text is a class by itself (class id its doc_id), as is a row
with null id and no copies; repeated rows are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .blocks import pack_sorted, unpack_sorted
from .common import discard, frugal, materialised, prepare, table

WORDS, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 32, 4
BROADCAST_ROWS = 1_000_000
#: Links whose components one task finds.
LOCAL_EDGES = 500_000
#: Bytes of text whose shingles are in memory at once, beyond a single longer text.
GROUP_BYTES = 1 << 20
#: Texts, about, whose shingles are counted to order all shingles by rarity, and
#: how many frequent ones are told apart. The order bears on time, not on results.
ORDER_TEXTS, ORDER_SHINGLES = 20_000, 1_000_000

_TABLE = A.byte_table(41)
_SALTS = A.stream(44, 4) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int):
    """(document, shingle hash, count) of the distinct shingles of each text."""
    docs, keys = [], []
    for low, high, part, off in A.slices(data, offsets):
        starts, _, owner = A.words(part, off)
        if not len(starts):
            continue
        h = A.hash_words(part, starts, _TABLE, 42)
        n = np.bincount(owner, minlength=high - low)
        if len(h) >= k:
            inside = owner[: len(owner) - k + 1] == owner[k - 1 :]
            docs.append(owner[: len(inside)][inside] + low)
            keys.append(A.window_hash(h, k, 43)[inside])
        first = np.cumsum(n) - n
        for i in np.flatnonzero((n > 0) & (n < k)):
            docs.append(np.array([i + low]))
            keys.append(A.window_hash(h[first[i] : first[i] + n[i]], int(n[i]), 43))
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
    return doc[new], key[new], np.diff(np.append(new, len(doc)))


def prob_min_hash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The element in each register of n documents (0 where there is none)."""
    time = np.full(n * registers, np.inf)
    least = np.zeros(n * registers, np.uint64)
    latest = np.full(n, np.inf)
    at = np.zeros(len(key))
    state = A.mix(key * _SALTS[0])
    while len(key):
        state = A.mix(state + _SALTS[1])
        at = at - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        alive = at < latest[doc]
        doc, key, weight, at, state = doc[alive], key[alive], weight[alive], at[alive], state[alive]
        if not len(key):
            break
        cell = doc * registers + (A.mix(state * _SALTS[2]) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, cell, at)
        best = time[cell] == at
        least[cell[best]] = key[best]
        some = np.unique(doc)
        latest[some] = time.reshape(n, registers)[some].max(axis=1)
    return least.reshape(n, registers)


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each document."""
    rows = least.reshape(len(least), bands, -1)
    key = np.broadcast_to(A.stream(45, bands), rows.shape[:2]).copy()
    for r in range(rows.shape[2]):
        key = A.mix(key * _SALTS[3] + rows[:, :, r])
    return key.view(np.int64)


def weights(count: np.ndarray) -> np.ndarray:
    """Weight of a shingle that a text holds ``count`` times."""
    return 1 + np.log2(count) / 32


def signatures(docs: DataFrame, key: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """Written rows (id, two hashes of the text, keys, shingles, how many): no
    keys where there are no words."""

    def run(batches):
        for batch in batches:
            _, offsets = A.utf8(batch.column("_text"))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + GROUP_BYTES, "right")) - 1)
                b, low = batch.slice(low, high - low), high
                doc, h, count = shingles(*A.utf8(b.column("_text")), k)
                keys = band_keys(prob_min_hash(doc, h, weights(count), b.num_rows, bands * rows), bands)
                ends = np.searchsorted(doc, np.arange(b.num_rows + 1))
                sets, sizes = [], []
                for x, y in zip(ends[:-1], ends[1:]):
                    short = np.unique((h[x:y] >> np.uint64(32)).astype(np.uint32))
                    sets.append(pack_sorted(short) if len(short) else None)
                    sizes.append(len(short))
                lists = pa.array([k if s is not None else k[:0] for k, s in zip(keys, sets)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "_hash", "_check")), lists, pa.array(sets, pa.binary()), pa.array(sizes, pa.int32())], ["_id", "_hash", "_check", "_keys", "_set", "_n"])

    narrow = docs.select(F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), F.xxhash64(F.lit(1), text).alias("_check"), F.col(text).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    return materialised(narrow.mapInArrow(frugal(run), "_id long, _hash long, _check long, _keys array<long>, _set binary, _n int"))


def told_apart(signed: DataFrame) -> DataFrame:
    """With ``_node``: the first hash, or where different texts share it, as the
    second hash tells, a hash of both for all but one of them."""
    shared = signed.groupBy("_hash").agg(F.min("_check").alias("_first"), F.max("_check").alias("_last")).where("_first < _last").select("_hash", "_first")
    if not shared.limit(1).count():
        return signed.withColumn("_node", F.col("_hash"))
    other = F.col("_check") != F.col("_first")
    return signed.join(shared, "_hash", "left").withColumn("_node", F.when(other, F.xxhash64("_hash", "_check")).otherwise(F.col("_hash"))).drop("_first")


def _sets_of(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """Written rows (_node, _n, _set), one for each of the written ``ids``: copies
    of a text are combined before the shuffle, however many there are."""
    one = [F.first("_n").alias("_n"), F.first("_set").alias("_set")]
    if ids.count() <= BROADCAST_ROWS:
        return materialised(sets.join(F.broadcast(ids), "_node", "left_semi").groupBy("_node").agg(*one))
    return materialised(sets.groupBy("_node").agg(*one).join(ids, "_node", "left_semi"))


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The written pairs (a, b) whose shingle sets are similar enough."""
    few = pairs.count() <= BROADCAST_ROWS
    ids = materialised(pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct())
    own = _sets_of(sets, ids)
    left = own.select(F.col("_node").alias("a"), F.col("_set").alias("sa"))
    right = own.select(F.col("_node").alias("b"), F.col("_set").alias("sb"))
    both = right.join(F.broadcast(pairs) if few else pairs, "b").join(left, "a").select("a", "b", "sa", "sb")

    def run(batches):
        last, mine = None, None
        for batch in batches:
            keep = []
            for a, sa, sb in zip(batch.column("a").to_pylist(), batch.column("sa"), batch.column("sb")):
                if a != last:
                    last, mine = a, unpack_sorted(sa.as_py(), np.uint32)
                other = unpack_sorted(sb.as_py(), np.uint32)
                least, most = sorted((len(mine), len(other)))
                shared = len(np.intersect1d(mine, other, assume_unique=True)) if least >= threshold * most - 1e-9 else 0
                keep.append(shared >= threshold * (least + most - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = materialised(both.mapInArrow(frugal(run), "a long, b long"))
    discard(own, ids)
    return out


def _union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:  # least label over edges, then jumps to the labels' own labels
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the least node that it
    reaches. Up to ``local_edges`` edges, by count, are one bounded task. More
    are joined: labels travel along edges and then jump to their own label, so
    rounds grow with the logarithm of a component's width; each is checkpointed."""
    if edges.count() <= local_edges:

        def run(batches):
            every = list(batches)
            if every:
                t = pa.Table.from_batches(every)
                node, label = _union_find(*(t.column(c).to_numpy() for c in ("a", "b")))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], ["node", "label"])

        return materialised(edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, label long"))
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")).checkpoint()
    while True:
        other = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        told = both.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("least"))
        hooked = labels.join(told, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = hooked.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")).checkpoint()
        labels = new.select("node", "label")
        if not new.where(F.col("label") != F.col("old")).limit(1).count():
            return labels


def _frequent(own: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that several of about ORDER_TEXTS texts hold, with how many do."""
    every = max(1, own.count() // ORDER_TEXTS)

    def run(batches):
        for b in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
            sets = [unpack_sorted(s.as_py(), np.uint32) for s in b.column("_set")]
            if sets:
                token, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int32)), pa.array(n)], ["token", "n"])

    some = own.where(F.pmod(F.xxhash64("b", F.lit(7)), F.lit(every)) == 0).select("_set").mapInArrow(run, "token int, n long")
    top = some.groupBy("token").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "token").limit(ORDER_SHINGLES).toArrow()
    token, n = top.column("token").to_numpy().view(np.uint32), top.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def _prefixes(own: DataFrame, threshold: float) -> DataFrame:
    """Written rows (token, place, b, label, n): the first shingles of each set, rare
    ones first, of which two sets that are similar enough share at least one."""
    frequent = own.sparkSession.sparkContext.broadcast(_frequent(own))

    def run(batches):
        known, times = frequent.value
        for b in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
            tokens, lengths = [], []
            for s in b.column("_set"):
                token = unpack_sorted(s.as_py(), np.uint32)
                at = np.minimum(np.searchsorted(known, token), max(len(known) - 1, 0))
                rank = np.where(known[at] == token, times[at], 0) if len(known) else np.zeros(len(token), np.int64)
                some = len(token) - int(np.ceil(threshold * len(token) - 1e-9)) + 1
                tokens.append(token[np.lexsort((token, rank))[:some]])
                lengths.append(len(tokens[-1]))
            if tokens:
                row = pa.array(np.repeat(np.arange(b.num_rows), lengths))
                place = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int32)), pa.array(place), *[b.column(c).take(row) for c in ("b", "label", "n")]], ["token", "place", "b", "label", "n"])

    return materialised(own.mapInArrow(frugal(run), "token int, place int, b long, label long, n int"))


def _joined(links: DataFrame, labels: DataFrame, pairs: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links and labels, with those of further candidate pairs."""
    if not pairs.limit(1).count():
        return links, labels
    new = _similar(pairs, sets, threshold)
    if not new.limit(1).count():
        return links, labels
    every = materialised(links.union(new))
    discard(links, new, labels)
    return every, components(every)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """Rows (key, class_id, links, text_hash, label): one for each row of
    ``docs``; ``links`` counts the links of its text to different texts that were
    verified, ``label`` is the same in one class only (null for a null text)."""
    return _near(docs, key, text, words, threshold, bands, band_rows)[0]


def _near(docs: DataFrame, key: str, text: str, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = BAND_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """near_duplicates() and the scratch tables that it reads."""
    prepare(docs.sparkSession)
    written = signatures(docs, key, text, words, bands, band_rows)
    signed = told_apart(written)
    sets = signed.where(F.col("_set").isNotNull()).select("_node", "_n", "_set")
    banded = signed.select("_node", "_n", F.posexplode("_keys").alias("band", "bucket"))
    several = banded.groupBy("bucket").agg(F.min("_node").alias("_l"), F.max("_node").alias("_m")).where("_l < _m").select("bucket")
    members = materialised(banded.join(several, "bucket").select("bucket", "band", F.col("_node").alias("b"), F.col("_n").alias("n")).distinct())
    full = members.groupBy("bucket").agg(F.count("*").alias("met"))
    meets = members.join(full, "bucket").groupBy("b").agg(F.sum("met").alias("met"))
    hub = F.max(F.struct("met", F.bitwise_not("b").alias("b"), "n")).alias("h")
    hubs = members.join(meets, "b").groupBy("bucket").agg(hub).select("bucket", F.bitwise_not(F.col("h.b")).alias("a"), F.col("h.n").alias("na"))
    fits = F.least("n", "na") >= threshold * F.greatest("n", "na") - 1e-9
    stars = materialised(members.join(hubs, "bucket").where((F.col("a") != F.col("b")) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = _similar(stars, sets, threshold)
    labels = components(links)
    # buckets of several components: all pairs between them that prefixes do not rule out
    held = members.join(labels.select(F.col("node").alias("b"), "label"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    mixed = held.groupBy("bucket").agg(F.min("label").alias("_l"), F.max("label").alias("_m")).where("_l < _m").select("bucket")
    held = materialised(held.join(mixed, "bucket", "left_semi").select(F.col("b").alias("_node"), "label").distinct())
    mine = _sets_of(sets, held.select("_node"))
    own = mine.join(held, "_node").select(F.col("_node").alias("b"), "label", F.col("_n").alias("n"), "_set")
    prefixes = first = _prefixes(own, threshold)
    first = first.join(first.groupBy("token").agg(F.min("label").alias("_l"), F.max("label").alias("_m")).where("_l < _m").select("token"), "token", "left_semi")
    x = first.select("token", F.col("place").alias("_pa"), F.col("b").alias("a"), F.col("label").alias("_la"), F.col("n").alias("_na"))
    y = first.select("token", F.col("place").alias("_pb"), "b", F.col("label").alias("_lb"), F.col("n").alias("_nb"))
    fits = F.least("_na", "_nb") >= threshold * F.greatest("_na", "_nb") - 1e-9
    room = F.least(F.col("_na") - F.col("_pa"), F.col("_nb") - F.col("_pb")) >= threshold / (1 + threshold) * (F.col("_na") + F.col("_nb")) - 1e-6
    cross = x.join(y, "token").where((F.col("a") < F.col("b")) & (F.col("_la") != F.col("_lb")) & fits & room).select("a", "b").distinct()
    pairs = materialised(cross.join(stars, ["a", "b"], "left_anti"))
    discard(members, stars, held, mine, prefixes)
    links, labels = _joined(links, labels, pairs, sets, threshold)
    discard(pairs)
    return _classes(docs, signed, labels, links, key, text), [written, links, labels]


def _classes(docs: DataFrame, signed: DataFrame, labels: DataFrame, links: DataFrame, key: str, text: str) -> DataFrame:
    nodes = signed.groupBy(F.col("_node").alias("node")).agg(F.min("_id").alias("_first"))
    named = nodes.join(labels, "node", "left").select("node", "_first", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("_first").alias("class_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    of_node = named.join(least, "label").join(degree, "node", "left").select(F.col("node").alias("_node"), "class_id", F.coalesce("links", F.lit(0)).alias("links"), "label")
    out = signed.select("_id", "_node", "_hash").join(of_node, "_node").select(F.col("_id").alias(key), "class_id", "links", F.col("_hash").alias("text_hash"), "label")
    none, own = F.lit(None).cast("long"), F.col(key).cast("long")
    alone = docs.where(F.col(text).isNull()).select(own.alias(key), own.alias("class_id"), F.lit(0).cast("long").alias("links"), none.alias("text_hash"), none.alias("label"))
    return out.unionByName(alone)


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that of the least key (null ones
    last), of rows that are alike in key and text any one."""
    classes, tables = _near(docs, key, text, **options)
    rows = classes.where(F.col("label").isNotNull()).groupBy("label", F.col(key).alias("k"), F.col("text_hash").alias("h")).count()
    one = rows.groupBy("label").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h", "count")).alias("r"))
    kept = materialised(one.select(F.col("r.k").alias("__copy_kept"), F.col("r.h").alias("__copy_hash"), F.col("r.count").alias("__copy_count")))
    discard(*tables)
    own = docs.where(F.col(text).isNotNull()).withColumn("__copy_h", F.xxhash64(text))
    out = own.join(kept, own[key].cast("long").eqNullSafe(kept["__copy_kept"]) & (own["__copy_h"] == kept["__copy_hash"]), "left_semi")
    if kept.where("__copy_count > 1").limit(1).count():  # repeated rows
        out = out.dropDuplicates([key, "__copy_h"])
    return out.select(*docs.columns).unionByName(docs.where(F.col(text).isNull()))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all of ``documents``: doc_id, class_id, links."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "label")
