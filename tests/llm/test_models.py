"""Classifiers, search and pipeline."""

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from herdplan.llm import ann, arrays, quality, toxicity
from herdplan.llm.queries import ORACLE_SQL, QUERIES

from .samples import documents, empty, frame

SF = "/root/testdata/sf0.01"
need = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def labelled(name):
    docs, labels = pq.read_table(f"{SF}/documents.parquet").to_pandas(), pq.read_table(f"{SF}/labels.parquet").to_pandas()
    return docs.merge(labels, on="doc_id").set_index("doc_id")[name]


@need
@pytest.mark.parametrize("query,label,limit", [("op2_toxicity", "toxic", 0.5), ("op5_quality", "quality", 0.3)])
def test_held_out_accuracy(spark, query, label, limit):
    out = QUERIES[query](spark, SF).toPandas().set_index("doc_id")
    assert out.score.between(0, 1).all() and ((out.score >= limit).astype(int) == out.predicted).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.index]).all()
    both = out[out.held_out].join(labelled(label), how="inner")
    assert (both.predicted == both[label]).mean() > 0.93


@pytest.mark.parametrize("run", [lambda d, l: quality.score_quality(d, l, "y"), lambda d, l: toxicity.score_toxicity(d, l, "y")])
def test_awkward_rows(spark, run):
    docs = frame(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None), (5, 1)], "doc_id long, y int")
    out = run(docs, labels)
    rows = out.collect()
    assert len(rows) == len(documents()) and all(0 <= r.score <= 1 for r in rows) and sorted(out.columns) == sorted(docs.columns)
    one = run(docs, labels.where("y = 1")).select("score").distinct().collect()
    assert len(one) == 1 and one[0].score > 0.99
    assert {r.score for r in run(docs, labels.limit(0)).collect()} == {0.5}
    assert run(empty(spark), labels).count() == 0


@pytest.mark.parametrize("lead", ["1234567890 " * 9, "\n! 4", "\x00" * 70])
def test_texts_that_begin_with_long_runs_without_letters(lead):
    """Alone in a slice, what stands before their first word is longer than any word."""
    lexicons = toxicity.Lexicons(toxicity.hash_strings(["zebra"]), {})
    plain, led = (toxicity.features(pa.array([x]), lexicons)[0] for x in ("a zebra", lead + "a zebra"))
    assert plain[:11].tolist() == led[:11].tolist() and led[3] == 1
    assert toxicity.features(pa.array([lead + "a"]), lexicons)[0, 0] == np.log1p(1)
    data, starts = np.frombuffer((lead + "ab cd").encode(), np.uint8), np.array([len(lead), len(lead) + 3])
    bare = np.frombuffer(b"ab cd", np.uint8)
    assert (arrays.hash_words(data, starts, toxicity._TABLE, 62) == arrays.hash_words(bare, np.array([0, 3]), toxicity._TABLE, 62)).all()


def test_isotonic_rises_and_averages():
    rng = np.random.default_rng(0)
    s = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-s))).astype(int)
    x, p = toxicity.isotonic(s, y)
    assert (np.diff(x) > 0).all() and (np.diff(p) > 0).all() and 0 <= p[0] and p[-1] <= 1
    assert all(a >= b for a, b in [toxicity.isotonic(np.arange(4.0), np.array([1, 0, 1, 1]))[1][[1, 0]]])


def test_trees_learn_a_step():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(int)
    model = toxicity.grow(x, y)
    assert ((toxicity.margins(x, model) > 0) == y).mean() > 0.95


def test_hidden_insults_are_seen():
    lexicons = toxicity.Lexicons(np.empty(0, np.uint64), {})
    f = toxicity.features(pa.array(["you are an 1d10t my friend", "you are an idiot my friend", "a plain text", "", None]), lexicons)
    assert f[0, 15] == 1 and f[0, 1] == 0 and f[1, 1] == 1 and f[1, 15] == 0 and f[1, 9] == 1 and not f[3].any() and not f[4].any()


def plain_features(text, mined=(), beginnings=()):
    """The toxicity features by plain loops; mined words and beginnings as text."""
    import math
    import re

    raw = text.encode()
    low = toxicity.lower(np.frombuffer(raw, np.uint8)).tobytes()
    letters = rb"[A-Za-z\x80-\xff]"
    found = re.findall(letters + b"+", low)
    insults, second = ({toxicity.lower(np.frombuffer(w.encode(), np.uint8)).tobytes() for w in x} for x in (toxicity.INSULTS, toxicity.SECOND_PERSON))
    fixed = [w in insults for w in found]
    own = [w in {m.encode() for m in mined} for w in found]
    begins = [any(w.startswith(b.encode()) for b in beginnings) for w in found]
    hit = [a or b or c for a, b, c in zip(fixed, own, begins)]
    near = [h and any(found[j] in second for j in range(max(0, i - 5), i + 6) if j < len(found)) for i, h in enumerate(hit)]
    n, size, hits = len(found), len(raw), sum(hit)
    alpha = len(re.findall(letters, raw))
    mixed = hidden = 0
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw):
        chunk = m[0]
        if not any(chunk[k : k + 1] in b"0123456789@$*.-_" and re.match(letters, chunk[k + 1 : k + 2]) for k in range(len(chunk) - 1)) or len(re.findall(letters, chunk)) < 2:
            continue
        mixed += 1
        undone = bytes(toxicity._UNDONE[list(chunk)])
        plain = b"".join(re.findall(letters, undone))
        shown = re.findall(letters + b"+", toxicity.lower(np.frombuffer(chunk, np.uint8)).tobytes())
        lexical = plain in insults or plain in {w.encode() for w in mined}
        hidden += lexical and len(plain) > 2 and not any(w in insults or w in {x.encode() for x in mined} or any(w.startswith(b.encode()) for b in beginnings) for w in shown)
    punct = sum(33 <= c < 127 and not chr(c).isalnum() for c in raw)
    return [
        math.log1p(n), sum(fixed), sum(fixed) / (n + 1), sum(own), sum(own) / (n + 1), sum(begins), sum(begins) / (n + 1), hits, hits / (n + 1), sum(near), sum(near) / (hits + 1),
        sum(65 <= c <= 90 for c in raw) / (alpha + 1), raw.count(b"!") / (size + 1), punct / (size + 1), sum(48 <= c <= 57 for c in raw) / (size + 1), hidden, hidden / (mixed + 1),
    ]


def test_features_equal_plain_loops():
    """Over awkward texts, chunks of more than 40 bytes with hidden words among them."""
    mined, beginnings = ["zorblax", "quimby"], ["flurb", "snee"]
    words = ["you", "IDIOT", "idiot", "1d10t", "m0ron", "st.u.p.i.d", "zorblax", "z0rblax", "Flurbish", "sneeze", "tú", "é", "a", "x-y", "http://a.b/c?d=1", "12", "!!", "-".join("idiot"), ".".join("zorblax"), "1" * 60 + "d10t", "x.y" * 30, "stup" + "-" * 50 + "id", "Ärger", "vous,"]
    rng = np.random.default_rng(3)
    texts = ["", "a", "1d10t", *[t for _, t in documents() if t], *(" ".join(rng.choice(words, 30)) for _ in range(120)), " " * 9 + "z0rblax"]
    lexicons = toxicity.Lexicons(toxicity.hash_strings(mined), {})
    for b in beginnings:
        low, starts, ends, _, _ = toxicity._tokens(*toxicity.A.utf8(pa.array([b])))
        lexicons.prefixes[len(b)] = np.unique(next(h for k, _, h in toxicity._prefixes(low, starts, ends) if k == len(b)))
    got = toxicity.features(pa.array(texts), lexicons)
    for row, t in zip(got, texts):
        assert np.allclose(row, plain_features(t, mined, beginnings), rtol=1e-12), t[:80]
    assert got[:, 15].max() >= 3


def test_ngram_buckets_equal_plain_loops():
    from collections import Counter

    texts = ["", "a", "ab", "one two two", " x  yz ", "é ß", *[t for _, t in documents() if t][:12]]
    data, offsets = quality.A.utf8(pa.array(texts))
    got = [Counter() for _ in texts]
    for buckets, doc in quality.ngrams(data, offsets):
        for b, d in zip(buckets.tolist(), doc.tolist()):
            got[d][b] += 1

    def hashed(word):
        raw = np.frombuffer(word, np.uint8)
        return quality.A.hash_words(raw, np.zeros(1, np.int64), quality._WORDS, 74)

    for t, own in zip(texts, got):
        raw, want = t.encode(), Counter()
        words = [hashed(w) for w in raw.split()]
        want.update(int(h[0]) & int(quality._MASK) for h in words)
        for x, y in zip(words, words[1:]):
            want[int(quality._AGAIN) if x[0] == y[0] else int(quality.A.window_hash(np.concatenate([x, y]), 2, 75)[0]) & int(quality._MASK)] += 1
        spaced = b" " + b"".join(b" " if c in b" \t\n\x0b\x0c\r" else bytes([c]) for c in raw) + b" "
        for k in quality.LENGTHS:
            for i in range(len(spaced) - k + 1):
                gram = spaced[i : i + k]
                if b" " in gram[1:-1]:
                    continue
                total = np.uint32(0)
                for j, c in enumerate(gram):
                    total = np.uint32((int(total) + int(quality._BYTES[j][c])) & 0xFFFFFFFF)
                want[int(quality._scramble(np.array([(int(total) + int(quality._SALT[k])) & 0xFFFFFFFF], np.uint32))[0])] += 1
        assert own == want, t[:60]


def test_sample_is_bounded_by_rows_and_bytes(spark):
    from herdplan.llm.labelled import training_sample

    docs = spark.createDataFrame([(i, "x" * (10 if i % 4 else 50_000)) for i in range(200)] + [(1, "x" * 10), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, y int")
    texts, y = training_sample(docs, labels, "y")
    assert len(texts) == len(y) > 120 and max(map(len, texts.to_pylist())) == 50_000
    few, _ = training_sample(docs, labels, "y", 30)
    assert len(few) == 30
    small, _ = training_sample(docs, labels, "y", size=51_000)
    sizes = [len(t) for t in small.to_pylist()]
    assert sum(sizes) <= 51_000 and sizes.count(50_000) == 1 and len(sizes) > 50


def vectors(n=3000, width=16):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(n, width))
    v[:200] = v[0]  # a very common vector
    return v


def test_search_recall_and_exact_scores(spark):
    v = vectors()
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(None, v[5].tolist()), (4000, None), (4020, [0.0] * 16), (4040, [float("nan")] * 16), (4060, [1.0, None] + [0.0] * 14), (4080, [1.0] * 3), (4100, [float("inf")] * 16)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>").withColumn("rank", F.lit(0)).withColumn("block", F.lit(1))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, block_rows=700).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 20))
    hits = 0
    for q, own in got.groupby("query_id"):
        s = v @ v[q]
        assert np.allclose(own.score, s[own.vec_id], rtol=1e-12) and q not in set(own.vec_id)
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and all(a >= b for a, b in zip(own.score, own.score[1:]))
        s[q] = -np.inf
        hits += (own.score >= np.sort(s)[-20] - 1e-9).sum()
    assert hits / len(got) >= 0.9


def test_search_of_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") == 0).toPandas()
    assert got.sort_values("rank").vec_id.tolist() == [1, 2, 3, 4]  # all scores are 1: ties to the smaller id
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_search_in_waves_blocks_and_lengths(spark):
    """Waves of few queries, small blocks, two lengths of vectors and repeated
    rows: with everything scored, the same as brute force."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-2, 3, 4 if i % 3 else 7).astype(float).tolist()) for i in range(240)]
    rows = [(i, v) for i, v in rows if any(v)]
    rows += [rows[5], rows[6], (20, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=6, rerank=1.0, block_rows=25, wave_bytes=300).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = {i for i, _ in rows if i % 20 == 0}
    assert set(by) == ids
    for q in ids - {20}:  # the repeated id is asked once, by either row
        v = next(v for i, v in rows if i == q)
        want = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:6]
        assert sorted(by[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_pivots_are_spread():
    rng = np.random.default_rng(2)
    crowd = np.array([1.0, 0, 0]) + 0.001 * rng.normal(size=(500, 3))
    x = np.concatenate([crowd, rng.normal(size=(20, 3))])
    chosen = ann.spread(x, 12)
    assert len(chosen) == 12 and (chosen[:, 0] > 0.99).sum() <= 6 and len(ann.spread(x[:3], 12)) == 3


@need
def test_search_recall_on_the_test_table(spark):
    got = QUERIES["op10_ann"](spark, SF).toPandas()
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, e = np.asarray(t.column("vec_id")), np.array(t.column("embedding").to_pylist(), float)
    hits = 0
    for q, own in got.groupby("query_id"):
        s = e @ e[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(own.vec_id))
    assert hits / len(got) >= 0.9


@need
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    q = c.sql(ORACLE_SQL[name])
    names = q.columns
    assert sorted(names) == columns
    assert sorted(tuple(str(r[x]) for x in columns) for r in df.collect()) == sorted(tuple(str(dict(zip(names, r))[x]) for x in columns) for r in q.fetchall())


def test_pipeline_stages_on_awkward_rows(spark):
    """Each stage against plain code, over texts that are null, empty, equal,
    alike, contaminated or hold secrets, columns of other operators' names, and
    an empty table."""
    import re
    import tempfile

    pipeline = pytest.importorskip("corpus_pipeline")
    docs, rows = frame(spark), documents()
    item = re.findall(r"[^\W_]+", rows[6][1].lower())[:30]
    sf = tempfile.mkdtemp()
    spark.createDataFrame([(0, " ".join(item)), (1, "one"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    kept = pipeline.keep_quality(spark, docs, sf)
    scored = quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert plain(kept) == sorted(((r.doc_id, r.text) for r in scored if r.score >= 0.3), key=str) and set(kept.columns) == set(docs.columns) - {"score"}
    single = pipeline.drop_near_duplicates(spark, docs, sf)
    from .test_whole_texts import BASE, components, words

    texts = sorted({t for _, t in rows if t is not None})
    sets = [{tuple(words(t)[j : j + 5]) for j in range(len(words(t)) - 4)} or {tuple(words(t)) or ("empty", t)} for t in texts]
    root = dict(zip(texts, components(sets, 0.8)))
    best = {}
    for i, t in rows:
        if t is not None:
            best[root[t]] = min(best.get(root[t], (True, 0)), (i is None, i or 0))
    left = single.collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in left if r.text is not None)) == sorted(best.values()) and sum(r.text is None for r in left) == sum(t is None for _, t in rows)
    clean = pipeline.drop_contaminated(spark, docs, sf)
    assert plain(clean) == sorted(((i, t) for i, t in rows if t != rows[6][1]), key=str)
    redacted = pipeline.redact_secrets(spark, docs, sf)
    marks = {r.doc_id: r.text for r in redacted.collect() if r.text and "[SECRET]" in r.text}
    assert set(marks) == {i for i, t in rows if any(ok(m) for _, p, ok in BASE for m in p.finditer(t or ""))} != set() and redacted.count() == len(rows) and redacted.columns == docs.columns and dict(redacted.dtypes) == dict(docs.dtypes)
    assert redacted.where("n_chars <> length(text)").count() == 0
    packed = pipeline.pack_sequences(spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in rows}) and packed.where("length < 1 or length > 4096").count() == 0
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty(spark), sf).count() == 0


@need
def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, count = docs.columns, docs.count()
    for stage, f in pipeline.STAGES[:-1]:
        docs = pipeline.materialised(f(spark, docs, sf))
        assert docs.columns == names, stage
        assert 0 < docs.count() <= count
        count = docs.count()
    packed = pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == count
    again = pipeline.run(spark, sf)
    key = ["doc_id", "piece", "ids_crc32"]
    assert again.select(key).exceptAll(packed.select(key)).count() == 0
