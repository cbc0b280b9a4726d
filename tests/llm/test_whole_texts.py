"""Operators on whole texts against brute force, over the awkward table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from herdplan.llm import arrays, decontaminate, lattice_lm, near_dup, packing, secret_scan, sharding, substring_dedup

from .samples import documents, empty, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def test_word_arrays():
    texts = [t for _, t in documents()]
    data, offsets = arrays.utf8(pa.array(texts))
    found = defaultdict(list)
    for low, _, part, off in arrays.slices(data, offsets, 500):
        for a, b, d in zip(*arrays.words(part, off)):
            found[low + d].append(bytes(part[a:b]).decode())
    assert all(found[i] == words(t) for i, t in enumerate(texts))


@pytest.mark.parametrize("k", [1, 2, 3, 5, 7, 50])
def test_window_hashes_tell_windows_apart(k):
    rng = np.random.default_rng(k)
    h = arrays.mix(rng.integers(0, 2, 400).astype(np.uint64))
    got = arrays.window_hash(h, k, 3)
    keys = [tuple(h[i : i + k]) for i in range(len(h) - k + 1)]
    assert len(got) == len(keys) and len(set(zip(keys, got.tolist()))) == len(set(keys)) == len(set(got.tolist()))


@pytest.mark.parametrize("window,rows", [(50, 2), (5, 1)])
def test_substrings(spark, window, rows):
    docs = documents()
    least = {}
    for i, t in docs:
        w = words(t)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    want = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and least[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    out = substring_dedup.dedup_substrings(frame(spark), window, rows=rows)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(got, key=key) == sorted(want, key=key) and "score" in out.columns and any(r[2] for r in want)
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


def components(sets, threshold):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9 and (both or sets[i] is sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def test_near_duplicates(spark):
    docs = [(i, t) for i, t in documents()]
    sets, by_text = [], {}
    for n, (_, t) in enumerate(docs):
        w = words(t)
        own = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else {("empty", t if t is not None else n)}
        sets.append(by_text.setdefault(t, own) if t is not None else own)
    root = components(sets, 0.8)
    least = {}
    for r, (i, _) in zip(root, docs):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, least.get(r)) for r, (i, _) in zip(root, docs)), key=str)
    got = near_dup.near_duplicates(frame(spark))
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=str) == want
    kept = near_dup.without_copies(frame(spark))
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({r for r in root}) and kept.columns == frame(spark).columns
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_a_chain_and_a_large_group(spark):
    """A class may hold texts that are not alike; a shared passage links nobody."""
    import random

    from .samples import edited, passage

    rng = random.Random(9)
    chain = [passage(rng, 150)]
    for _ in range(6):
        chain.append(edited(chain[-1], rng, 2))
    group = [edited(chain[0] + " z", rng, 1) for _ in range(25)]
    block = passage(rng, 60)
    others = [block + " " + passage(rng, 60) for _ in range(30)]
    texts = chain + group + others
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    want = components(sets, 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_a_pair_that_no_hub_meets(spark):
    """Two texts at 0.813 among 60 at less than 0.8: in each of the buckets that
    they share a text of the others is the hub."""
    some = lambda n, tag: [f"{tag}40x{k}" for k in range(n)]
    texts = [" ".join(some(204, "c") + some(23 if i < 2 else 28, f"t{i}y")) for i in range(62)]
    got = {r.doc_id: (r.class_id, r.links) for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (0, 1), 1: (0, 1)} | {i: (i, 0) for i in range(2, 62)}


def test_components_of_many_links(spark):
    """One bounded task and joined rounds give the same labels."""
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, int(x)) for x in range(101, 130)] + [(int(a) + 200, int(b) + 200) for a, b in rng.integers(0, 60, (40, 2)) if a != b]
    edges = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long")
    one = {r.node: r.label for r in near_dup.components(edges).collect()}
    many = {r.node: r.label for r in near_dup.components(edges, 0).collect()}
    assert one == many and all(one[i] == 0 for i in range(41))
    assert near_dup.components(edges.limit(0)).count() == 0


def test_prob_min_hash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    keys = arrays.stream(7, 60)
    wa, wb = rng.uniform(0.1, 3, 40), rng.uniform(0.1, 3, 40)
    a, b = keys[:40], keys[20:]
    got = near_dup.prob_min_hash(np.repeat([0, 1], 40), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4096)
    x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x if i in y)
    assert abs((got[0] == got[1]).mean() - exact) < 0.03


def test_decontamination(spark):
    docs = documents()
    rows = [(0, docs[6][1]), (1, " ".join(words(docs[7][1])[10:40])), (2, None), (3, ""), (4, "too short"), (5, docs[6][1])]
    subs = words(docs[8][1])[5:45]
    subs[::6] = ["other"] * len(subs[::6])
    rows.append((6, " ".join(subs)))
    rows.append((7, " ".join(["nowhere", "to", "be", "found", "in", "any", "of", "them"] * 3)))
    bench = spark.createDataFrame(rows, "item_id long, text string")
    for limit in (10**6, 0):  # by broadcast, and by shuffles
        got = {(r.doc_id, r.item_id): (r.equal_words, r.item_words) for r in decontaminate.contaminated(frame(spark), bench, broadcast_bytes=limit).collect()}
        assert set(got) == {(6, 0), (7, 1), (8, 6)} and got[7, 1] == (30, 30) and got[8, 6][0] == 33
    clean = decontaminate.without_contaminated(frame(spark), bench)
    assert clean.count() == len(docs) - 3 and clean.columns == frame(spark).columns
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(frame(spark), bench.limit(0)).count() == 0


def test_decontamination_by_items_without_id_or_with_two_texts(spark):
    docs = documents()
    rows = [(None, docs[6][1]), (1, " ".join(words(docs[7][1])[10:40])), (1, " ".join(words(docs[8][1])[3:28]))]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    one, two = (sorted(decontaminate.contaminated(frame(spark), bench, broadcast_bytes=limit).collect(), key=str) for limit in (10**6, 0))
    assert one == two and {(r.doc_id, r.item_id, r.equal_words) for r in two} >= {(7, 1, 30), (8, 1, 25)} and (6, None) in {(r.doc_id, r.item_id) for r in two}
    assert decontaminate.without_contaminated(frame(spark), bench, broadcast_bytes=0).where("doc_id in (6, 7, 8)").count() == 0


BASE = [
    ("assign", re.compile(secret_scan.ASSIGN.replace("(?i)", ""), re.IGNORECASE | re.ASCII), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def test_secrets(spark):
    extra = ["é你 PASSWORD:'abcdef' x" * 3, "a" * 23 + " " + "b" * 24, "AKIA" + "A" * 15 + " AKIA" + "A" * 16, "far " + "Q" * 40 + " " * 600 + "AKIA" + "B" * 16, "api_key=" + "c" * 30 + " near " + "Q" * 40 + " AKIA" + "B" * 16]
    docs = [*documents(), *[(1000 + i, t) for i, t in enumerate(extra)]]
    got = secret_scan.report(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in docs:
        if i is None:
            continue
        spans = sorted((m.start(), o, k, m.end()) for o, (k, p, ok) in enumerate(BASE) for m in p.finditer(t or "") if ok(m))
        assert [(s.start, s.ord, s.kind, s.end) for s in by[i].base_spans] == spans
    weak = {i: [s.kind for s in r.spans if not s.base] for i, r in by.items()}
    first = next(i for i, t in docs if t and "https://a.example" in t)
    assert weak[first] == ["endpoint", "token"] and weak[1003] == [] and weak[1004] == ["token"]
    assert all(not w for i, w in weak.items() if i not in (first, 1004))
    out = {r.doc_id: r.text for r in secret_scan.without_secrets(frame(spark, docs)).collect()}
    assert "hunter22" not in out[first] and out[first].count("[SECRET]") == 5 and out[0] == docs[0][1] and out[1003].endswith("[SECRET]")
    assert secret_scan.report(empty(spark)).count() == 0


def test_packing_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = packing.word_tokenizer()
    t = tokenizers.Tokenizer.from_file(path)
    docs = documents()
    for size in (4096, 64):
        rows = packing.pack(frame(spark), path, size=size).collect()
        want = Counter()
        for i, text in docs:
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
            for k in range(0, len(ids), size):
                part = np.array(ids[k : k + size], "<u4")
                want[i, k // size, k, len(part), zlib.crc32(part.tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for own in bins.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= size
        total = sum(r.length for r in rows)
        assert len(bins) <= math.ceil(total / size) * 1.1 + 1
    assert packing.pack(empty(spark), path).count() == 0


@pytest.mark.parametrize("case", ["mixed", "long", "short", "one", "none"])
def test_sweeps_pack_as_well_as_best_fit_decreasing(case):
    rng = np.random.default_rng(2)
    lengths = {"mixed": np.concatenate([rng.integers(1, 101, 300), np.full(100, 37)]), "long": rng.integers(40, 101, 500), "short": rng.integers(1, 9, 900), "one": np.array([100]), "none": np.empty(0, int)}[case]
    gaps = []
    for n in sorted(lengths.tolist(), reverse=True):  # one by one
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(100 - n)
    plan = packing.successor_sweeps(Counter(lengths.tolist()), 100)
    assert plan[:, 2].sum() == len(lengths)
    bins, ranks = defaultdict(list), defaultdict(list)
    for n, rank, many, first, offset in plan.tolist():
        ranks[n] += range(rank, rank + many)
        for b in range(first, first + many):
            bins[b].append((offset, n))
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values()) and {n: len(r) for n, r in ranks.items()} == Counter(lengths.tolist())
    assert len(bins) <= len(gaps) + 1
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 100


def test_a_sweep_gives_each_piece_the_smallest_gap_left():
    """Pieces of 60, 70 and 70 leave gaps of 40, 30 and 30; of the class of 40
    to 20, 40 takes the gap of 40, and the two gaps of 30 go to 30 and 25 by rank."""
    plan = packing.successor_sweeps({70: 2, 60: 1, 40: 1, 30: 1, 25: 1}, 100)
    place = {(n, r + k): (s + k, o) for n, r, many, s, o in plan.tolist() for k in range(many)}
    at = {n: place[n, 0][0] for n in (60, 40, 30, 25)}
    assert at[40] == at[60] and {at[30], at[25]} == {place[70, 0][0], place[70, 1][0]} and len({s for s, _ in place.values()}) == 3


def test_encode_equals_the_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    path = packing.word_tokenizer()
    t = tokenizers.Tokenizer.from_file(path)
    odd = ["", "İstanbul ß. Straße, ÉCOLE. café, it's IT'S don't. '. a. . ,. ab.. 你好。 ª. µ. 12. a1. <|endoftext|> <|ENDOFTEXT|> ΑΣ Σ. ñ.", "a\x00b \x1f c\x85d", "é É.", " x y"]
    for x in [*odd, *[t for _, t in documents() if t]]:
        assert packing.encode(x, path).tolist() == t.encode(x, add_special_tokens=False).ids


def test_encode_does_not_depend_on_what_it_saw_before():
    """Every letter alone, before signs and beside others, on a warm encoder."""
    import unicodedata

    tokenizers = pytest.importorskip("tokenizers")
    path = packing.word_tokenizer()
    t = tokenizers.Tokenizer.from_file(path)
    for c in [*range(0x20, 0x3100), *range(0x3100, 0xD800, 101), *range(0xF900, 0x1F000, 3)]:
        if unicodedata.category(chr(c))[0] not in "LMNP":
            continue
        x = f"{chr(c)} {chr(c)}. {chr(c)}, a{chr(c)} a{chr(c)}. {chr(c)}a, {chr(c)}{chr(c)}. {chr(c)}### e{chr(c)}.%` a'{chr(c)}~"
        want = t.encode(x, add_special_tokens=False).ids
        assert packing.encode(x, path).tolist() == want and packing.encode(x, path).tolist() == want, hex(c)


def test_sharding(spark):
    docs = frame(spark)
    for shards, block in ((8, 1 << 14), (3, 5)):
        out = sharding.shuffle_into_shards(docs.repartition(5), shards, block_rows=block)
        rows = out.collect()
        sizes = Counter(r.shard for r in rows)
        assert len(rows) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
        for s in sizes:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
        assert Counter((r.doc_id, r.text) for r in rows) == Counter(documents())
    assert sharding.shuffle_into_shards(empty(spark)).count() == 0


def test_scratch_goes(spark):
    from pathlib import Path

    from herdplan.llm import common

    path = common.materialised(spark.range(5)).inputFiles()[0].removeprefix("file://")
    assert Path(path).exists() and common.drop_scratch(spark) >= 1
    assert not Path(path).exists()


def test_matrix_margins_and_law():
    sizes, blocks = np.array([5, 0, 7, 3]), np.array([6, 4, 5])
    first = Counter()
    for seed in range(400):
        m = np.array([sharding.matrix_row(p, sizes, blocks, seed) for p in range(4)])
        assert (m.sum(1) == sizes).all() and (m.sum(0) == blocks).all()
        first[int(m[0, 0])] += 1
    mean = sum(k * v for k, v in first.items()) / 400
    assert abs(mean - 5 * 6 / 15) < 0.2  # hypergeometric


def test_every_deal_is_equally_likely():
    """Six rows of three partitions into blocks of two: each of the 90 deals
    comes as often as any other (chi-square, 89 degrees of freedom)."""
    sizes, blocks, n = np.array([2, 3, 1]), np.array([2, 2, 2]), 9000
    seen = Counter(tuple(np.concatenate([sharding.destinations(p, sizes, blocks, seed)[0] for p in range(3)]).tolist()) for seed in range(n))
    assert len(seen) == 90 and sum((v - n / 90) ** 2 / (n / 90) for v in seen.values()) < 150


def test_rows_that_were_not_counted_are_an_error(spark, monkeypatch):
    """No row is lost where the second reading splits the table otherwise."""
    docs = frame(spark).repartition(3)
    read = sharding.materialised

    class Moved:
        def __init__(self, df):
            self.df, self.sparkSession, self.schema = df, df.sparkSession, df.schema

        def groupBy(self, *c):
            return self.df.coalesce(1).groupBy(*c)

        def mapInArrow(self, *a):
            return self.df.mapInArrow(*a)

    monkeypatch.setattr(sharding, "materialised", lambda df: Moved(read(df).repartition(3)))
    with pytest.raises(Exception, match="counted"):
        sharding.shuffle_into_shards(docs).collect()


def test_language_model(spark):
    pytest.importorskip("sentencepiece")
    path = lattice_lm.piece_vocabulary()
    docs = documents()
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    own = [(i, [*words((t or "").translate(table)), None]) for i, t in docs]
    count = Counter(w for i, ws in own if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    from herdplan.llm.common import fold

    out = lattice_lm.score_texts(frame(spark), path, ~(fold(F.col("doc_id"), 7) == 2)).collect()
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    want = Counter((i, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in own)
    assert got == want and all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert lattice_lm.score_texts(empty(spark), path, F.lit(True)).count() == 0


def test_lattice_sums_all_segmentations():
    spm = pytest.importorskip("sentencepiece")
    model = lattice_lm.lattice(lattice_lm.piece_vocabulary())
    sp = spm.SentencePieceProcessor(model_file=lattice_lm.piece_vocabulary())
    pieces = defaultdict(float)
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i)):
            pieces[bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode()] += model.first[i]
    assert abs(model.first.sum() - 1) < 1e-9
    for word in ("thinking", "é你", "zzzz", "a"):
        text = "▁".encode() + word.encode()
        total = [0.0] * len(text) + [1.0]
        for i in range(len(text) - 1, -1, -1):
            total[i] = sum(pieces.get(text[i:j], 0.0) * total[j] for j in range(i + 1, len(text) + 1))
        rows = np.frombuffer(text, np.uint8)[None, :]
        with np.errstate(divide="ignore"):
            assert abs(model.log_marginal(rows, np.log(model.first))[0] - math.log(total[0])) < 1e-9
            out = np.zeros(model.size + 1)
            model.expected(rows, np.ones(1), np.log(np.maximum(model.first, 1e-300)), out)
        assert out.sum() > 0


@pytest.mark.parametrize("word", ["-" * 57, "=" * 58, "a" * 61, "-" * 3000, "你好" * 500 + "-" * 900])
def test_expected_counts_of_long_words(word):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = lattice_lm.lattice(lattice_lm.piece_vocabulary())
    rows = np.frombuffer("▁".encode() + word.encode(), np.uint8)[None, :]
    out = np.zeros(model.size + 1)
    model.expected(rows, np.ones(1), np.log(np.maximum(model.first, 1e-300)), out)
    sp = sentencepiece.SentencePieceProcessor(model_file=lattice_lm.piece_vocabulary())
    size = np.array([1 if sp.is_byte(i) else len(sp.id_to_piece(i).encode()) for i in range(model.size)] + [0])
    assert np.isfinite(out).all() and abs((out * size).sum() / rows.shape[1] - 1) < 1e-9


def test_long_words_teach_the_language_model(spark):
    pytest.importorskip("sentencepiece")
    path = lattice_lm.piece_vocabulary()
    run = "今天天气很好我们去公园" * 20
    docs = spark.createDataFrame([(0, run), (1, run[33:] + "公园"), (2, "-" * 57)], "doc_id long, text string")
    taught, untaught = ({r.doc_id: r.score for r in lattice_lm.score_texts(docs, path, t).collect()} for t in (F.col("doc_id") != 1, F.col("doc_id") > 1))
    assert all(map(math.isfinite, taught.values())) and taught[1] > untaught[1] + 1


def test_hash_of_kept_text_is_the_digest(spark):
    from herdplan.llm.queries import QUERIES

    row = QUERIES["op9_substring_dedup"](spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    assert len(row.kept_sha256) == len(hashlib.sha256(b"").hexdigest())


def test_one_row_of_a_class_where_ids_repeat(spark):
    """Texts of one id: of one class one stays, of two classes both."""
    import random

    from .samples import edited, passage

    rng = random.Random(3)
    one, two = passage(rng, 150), passage(rng, 150)
    near = edited(one, rng, 1)
    df = spark.createDataFrame([(1, one), (1, near), (1, two), (1, two), (2, one), (None, near), (None, None), (3, None)], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in near_dup.without_copies(df).collect()), key=str)
    assert sorted(kept, key=str) in (sorted([(1, x), (1, two), (None, None), (3, None)], key=str) for x in (one, near))


def test_different_texts_of_one_hash_are_told_apart(spark):
    rows = [(1, 10, 5), (2, 10, 5), (3, 10, 6), (4, 11, 5), (5, 12, 7)]
    out = near_dup.told_apart(spark.createDataFrame(rows, "_id long, _hash long, _check long"))
    node = {r._id: r._node for r in out.collect()}
    assert out.count() == 5 and node[1] == node[2] == 10 and node[4] == 11 and node[5] == 12 and len(set(node.values())) == 4


def test_repeated_shingles_hide_no_link(spark):
    """Sets at 0.8 to 0.95 of which one text holds some shingles many times."""
    rng = np.random.default_rng(8)
    texts = []
    for pair in range(200):
        same, own = (40, 2) if pair % 2 else (40, 5)
        tags = [f"p{pair}s{k}" for k in range(same)]
        loops = " ".join(" ".join(f"l{pair}x{k}" for k in range(5)) for _ in range(int(rng.integers(2, 60))))
        texts += [" ".join([*tags, *(f"p{pair}a{k}" for k in range(own))]), " ".join([*tags, loops])]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in map(words, texts)]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i in range(0, len(texts), 2):
        a, b = sets[i], sets[i + 1]
        assert (got[i + 1] == got[i]) == (len(a & b) >= 0.8 * len(a | b))
    # how often registers agree for such pairs, and so how rarely no band does
    count = np.ones(50)
    count[:10] = 1000
    x, y = near_dup.weights(count), np.ones(50)
    agree = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(50)) * 0.8
    assert (1 - agree**4) ** 32 < 1e-5


def test_many_texts_in_a_group_of_bytes(spark, monkeypatch):
    """Signatures do not depend on how texts are grouped."""
    docs = frame(spark)
    one = {(r._id, r._hash): (r._keys, r._n) for r in near_dup.signatures(docs, "doc_id", "text", 5, 32, 4).collect()}
    monkeypatch.setattr(near_dup, "GROUP_BYTES", 700)
    two = {(r._id, r._hash): (r._keys, r._n) for r in near_dup.signatures(docs, "doc_id", "text", 5, 32, 4).collect()}
    assert one == two


def test_short_items_are_found_whole(spark):
    """Items of 1 to 13 words against brute force: those of fewer than seven
    words as exact runs, longer ones also with a word replaced."""
    import random

    from .samples import passage

    rng = random.Random(12)
    split = re.compile(r"[^\W_]+")
    docs = [(i, passage(rng, 60)) for i in range(40)]
    own = [split.findall(t.lower()) for _, t in docs]
    items = [(n, " ".join(own[n][7 : 7 + n])) for n in range(1, 14)] + [(20, "nowhere at all"), (21, own[20][3] + " gap " + own[20][5])]
    changed = own[30][10:23]
    changed[6] = "other"
    items.append((30, " ".join(changed)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, w in enumerate(own):
        for i, t in items:
            x = t.split()
            if len(x) < 7:
                want |= {(d, i) for s in range(len(w) - len(x) + 1) if w[s : s + len(x)] == x}
    for limit in (10**6, 0):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, broadcast_bytes=limit).collect()}
        assert {p for p in got if p[1] < 7 or p[1] in (20, 21)} == want and {(n, n) for n in range(1, 14)} <= got and (30, 30) in got
        assert len(got) == len(want) + 8
    clean = decontaminate.without_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, least_words=5)
    assert {r.doc_id for r in clean.collect()} == set(range(40)) - {d for d, i in got if len(dict(items)[i].split()) >= 5}


def test_redaction_of_overlapping_and_many_spans(spark):
    text = "é" * 5 + "abcdefghij" * 2000
    spans = sorted([(5 + 10 * k, 5 + 10 * k + 4) for k in range(1500)] + [(6, 12), (15, 17), (20003, 20005)])
    rows = [(text, [(a, b) for a, b in spans])]
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:bigint,end:bigint>>")
    got = df.select(secret_scan.redacted(F.col("text"), F.col("spans"), "#").alias("x")).first().x
    out, pos = [], 0
    for a, b in spans:
        if a >= pos:
            out += [text[pos:a], "#"]
        pos = max(pos, b)
    assert got == "".join(out) + text[pos:]


@pytest.mark.parametrize("shards,fanout", [(4, 128), (30, 3)])
def test_exchange_levels_change_nothing(spark, shards, fanout):
    """One level, and four levels of three ranges with nodes between."""
    from herdplan.llm import blocks

    assert len(blocks.fans_for(shards, fanout)) == (1 if fanout > 30 else 4) and math.prod(blocks.fans_for(shards, fanout)) >= shards
    docs = frame(spark).repartition(9)
    plain = sorted(map(str, substring_dedup.dedup_substrings(docs, 20).select("doc_id", "n_removed", "kept_text").collect()))
    got = substring_dedup.dedup_substrings(docs, 20, rows=2, fanout=fanout, shards=shards).select("doc_id", "n_removed", "kept_text").collect()
    assert sorted(map(str, got)) == plain and any(r.n_removed for r in got)
    assert substring_dedup.dedup_substrings(empty(spark), fanout=fanout, shards=shards).count() == 0
    path, names = lattice_lm.piece_vocabulary(), ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score"]
    one, two = (lattice_lm.score_texts(docs, path, F.coalesce(F.col("doc_id") % 3 > 0, F.lit(True)), **o).collect() for o in ({}, {"fanout": fanout, "shards": shards}))
    assert Counter(tuple(r[n] for n in names) for r in one) == Counter(tuple(r[n] for n in names) for r in two)
    assert np.allclose(sorted(r.score for r in one), sorted(r.score for r in two), rtol=1e-9)
    assert lattice_lm.score_texts(empty(spark), path, F.lit(True), fanout=fanout, shards=shards).count() == 0


def test_words_alone_and_together_are_summed_alike():
    pytest.importorskip("sentencepiece")
    model = lattice_lm.lattice(lattice_lm.piece_vocabulary())
    rng = np.random.default_rng(5)
    words = rng.choice(np.frombuffer(b"thinkgers-.1\xe4\xbd\xa0", np.uint8), (40, 33))
    words = np.concatenate([np.broadcast_to(lattice_lm.MARK, (40, 3)), words], axis=1)
    log_p, weight = np.log(np.maximum(model.first, 1e-300)), rng.uniform(1, 9, 40)
    one, two = np.zeros(model.size + 1), np.zeros(model.size + 1)
    model.expected(words, weight, log_p, one)
    for i in range(40):
        model.expected(words[i : i + 1], weight[i : i + 1], log_p, two)
    assert np.allclose(one, two, rtol=1e-9, atol=1e-12)
    assert np.allclose(model.log_marginal(words, log_p), [model.log_marginal(w[None, :], log_p)[0] for w in words], rtol=1e-12)


def test_expected_counts_equal_all_segmentations():
    """The counts of the learning step against a sum over every path."""
    spm = pytest.importorskip("sentencepiece")
    model = lattice_lm.lattice(lattice_lm.piece_vocabulary())
    sp = spm.SentencePieceProcessor(model_file=lattice_lm.piece_vocabulary())
    pieces = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i)):
            text = bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode()
            if text not in pieces or sp.is_byte(pieces[text]):
                pieces[text] = i

    def paths(text):
        if not text:
            yield []
        for n in range(1, len(text) + 1):
            if text[:n] in pieces:
                for rest in paths(text[n:]):
                    yield [pieces[text[:n]], *rest]

    for word in ("the", "é你", "zz-a"):
        text = "▁".encode() + word.encode()
        want, whole = np.zeros(model.size + 1), 0.0
        for path in paths(text):
            p = float(np.prod(model.first[path]))
            whole += p
            np.add.at(want, path, p)
        out = np.zeros(model.size + 1)
        model.expected(np.frombuffer(text, np.uint8)[None, :], np.full(1, 3.0), np.log(np.maximum(model.first, 1e-300)), out)
        assert np.allclose(out, 3 * want / whole, rtol=1e-9, atol=1e-15)


def test_a_very_long_word_is_scored_in_time():
    import time

    pytest.importorskip("sentencepiece")
    model = lattice_lm.lattice(lattice_lm.piece_vocabulary())
    word = np.frombuffer("▁".encode() + b"ab-c" * 25_000, np.uint8)[None, :]
    log_p, out, start = np.log(np.maximum(model.first, 1e-300)), np.zeros(model.size + 1), time.time()
    model.expected(word, np.ones(1), log_p, out)
    assert np.isfinite(out).all() and np.isfinite(model.log_marginal(word, log_p)[0]) and time.time() - start < 20
