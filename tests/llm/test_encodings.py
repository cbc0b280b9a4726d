"""Whitening, byte-level BPE and fill-in-the-middle against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from herdplan.llm import byte_bpe, fill_in_middle, whitening
from herdplan.llm.arrays import utf8

from .samples import documents, empty, frame


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# -- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, [1]) for i, v in rows], "vec_id long, embedding array<float>, n int, x array<int>")


def test_jacobi_finds_small_eigenvalues():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 16):
        q, _ = np.linalg.qr(rng.normal(size=(n, n)))
        e = 10.0 ** -np.arange(n)
        d = np.diag(10.0 ** -np.arange(n))
        graded = d @ (np.eye(n) + 0.1 * (q + q.T) / 2) @ d  # entries fall off: a general solver loses the small ones
        got, v = whitening.jacobi(graded)
        assert np.allclose(v.T @ v, np.eye(n), atol=1e-13) and (np.diff(got) <= 0).all()
        assert np.allclose(graded @ v, v * got, atol=1e-15)
        inverse = np.linalg.inv(np.eye(n) + 0.1 * (q + q.T) / 2)
        assert np.isclose((1 / got).sum(), np.trace(np.diag(1 / e) @ inverse @ np.diag(1 / e)), rtol=1e-9)
        full = q @ np.diag(e) @ q.T
        assert np.allclose(whitening.jacobi(full)[0], np.sort(np.linalg.eigvalsh(full))[::-1], atol=1e-15)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of the rows are one vector
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 5), (2003, [float("inf")] + [0.0] * 4), (2004, []), (None, rows[5][1]), (2005, [1e30] * 5), rows[7]]
    rows += [(3000 + i, [float(a), float(2 * a)]) for i, a in enumerate(rng.integers(-9, 9, 40))]  # of another length, and of rank one
    got = whitening.whiten(vectors(spark, rows)).collect()
    for width, rank in ((5, 5), (2, 1)):
        own = [(i, np.floor(np.array(v) * 64).astype(int) + 1000000) for i, v in rows if v and len(v) == width and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 1e13]
        fit = np.array(sorted({tuple(v) for _, v in own}))
        n, s = len(fit), fit.sum(axis=0)
        v = np.cov(fit.T, bias=True)
        e = np.sort(np.linalg.eigvalsh(v))[::-1][:rank]
        mine = [r for r in got if r["n"] == n and r["explained"] is not None and (r["vec_id"] is not None and r["vec_id"] >= 3000) == (width == 2)]
        assert Counter(r["vec_id"] for r in mine) == Counter({i: k * rank for i, k in Counter(i for i, _ in own).items()})
        by = {(r["vec_id"], r["component"]): r for r in mine}
        y = np.array([[by[i, k + 1]["whitened"] for k in range(rank)] for i, _ in own])
        first = {tuple(v): a for a, (_, v) in reversed(list(enumerate(own)))}
        cov = np.cov(y[[first[tuple(v)] for v in fit]].T, bias=True).reshape(rank, rank)
        assert np.allclose(cov, np.eye(rank), atol=1e-9)
        assert all(r["identity_error"] < 1e-9 and abs(r["explained"] / (e[r["component"] - 1] / np.trace(v)) - 1) < 1e-9 for r in mine)
        assert all(by[i, 1]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(q, s)) for i, q in own)
        centred = np.array([q - s / n for _, q in own])
        for k in range(rank):  # a unit eigenvector, of either sign
            w = np.linalg.lstsq(centred, y[:, k] * np.sqrt(e[k]), rcond=None)[0]
            assert np.isclose(w @ w, 1, atol=1e-8) and np.allclose(v @ w, e[k] * w, atol=1e-6 * e[0])
    assert not whitening.whiten(vectors(spark, rows).limit(0)).collect()
    assert not whitening.whiten(vectors(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()


def test_deviation_beyond_a_long_is_null():
    m = whitening.Whitening(10**12, [0, 0], np.eye(2), np.ones(2), 2.0)
    assert m.deviation(np.array([[1, 2], [10**9, 0], [0, -3]])) == [None, None, None]
    m = whitening.Whitening(10**8, [10**17, 10**17], np.eye(2), np.ones(2), 2.0)
    assert m.deviation(np.array([[10**9 + 1, 10**9 - 2]])) == [5 * 10**16]


# -- byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    ranks, pattern = byte_bpe.vocabulary()
    return ranks, pattern, byte_bpe.encoder(ranks, pattern)


ODD = ["a", "b", "\u00e9", "\u4f60", " ", "\u00a0", "  ", "\n", "\t", "'", "'s", "'ll", "l", "1", "\u0663", "!", "\u2026", "\u2003", "\x1c", "\u053a\u0558", "\U0001f600", "\ua7ce", "nothing", "WORD "]


def odd_text(rng, n):
    return "".join(rng.choice(ODD) for _ in range(n))


@pytest.mark.parametrize("stride, overlap", [(3, 2), (8, 5), (20, 7)])
def test_stitched_pieces_give_the_ids_of_the_whole_text(spark, bpe, stride, overlap):
    rng = random.Random(stride)
    texts = [odd_text(rng, rng.randint(0, 60)) for _ in range(150)] + ["x" * 100, " " * 50, "ab " * 40 + "c" * 40 + " end" * 9, None, ""]
    docs = frame(spark, list(enumerate(texts)) + [(None, "q w " * 20), (3, texts[3])]).withColumn("ids", F.lit(1)).withColumn("piece", F.lit(1))
    coded = byte_bpe.encode(docs, *bpe[:2], stride=stride, overlap=overlap)
    assert set(coded.columns) == set(docs.columns) - {"text"}
    rows = byte_bpe.decode(coded, *bpe[:2]).collect()
    found = {}
    for r in rows:  # a text's pieces follow one another
        if r["piece"] == 0:
            found.setdefault(r["doc_id"], []).append([[], b""])
        found[r["doc_id"]][-1][0].extend(r["ids"])
        found[r["doc_id"]][-1][1] += bytes(r["bytes"])
    for i, t in enumerate(texts):
        assert len(found[i]) == 1 + (i == 3)
        for ids, raw in found[i]:
            assert ids == bpe[2].encode_ordinary(t or ""), t
            assert raw == (t or "").encode()
    assert found[None][0][0] == bpe[2].encode_ordinary("q w " * 20)
    assert max(r["piece"] for r in rows) > 1  # there is something to stitch
    digests = {r["doc_id"]: r for r in byte_bpe.digests(coded, *bpe[:2]).collect()}
    assert all(digests[i]["n_tokens"] == len(found[i][0][0]) and digests[i]["ids_sha256"] == sha(",".join(map(str, found[i][0][0]))) and digests[i]["decoded_sha256"] == sha(t or "") for i, t in enumerate(texts))


def test_neighbours_that_do_not_meet_stay_together(spark, bpe):
    text = "start " + "k" * 30 + " middle words here " + "m" * 30 + " end of it all"
    got = byte_bpe.encode(frame(spark, [(1, text)]), *bpe[:2], stride=10, overlap=4).collect()
    assert [r["piece"] for r in got] == list(range(len(got))) and 1 < len(got) < len(text) / 10
    assert [i for r in got for i in r["ids"]] == bpe[2].encode_ordinary(text)


def test_splitter_agrees_with_the_encoder(bpe):
    """A vocabulary of all pairs of ASCII bytes shows the encoder's boundaries."""
    rng, split = random.Random(2), byte_bpe.splitter(bpe[1])
    assert all(split.classes[c] in "\u00e9\u00b2\u00a7\t" for c in range(128, 0x3000, 7)) and split.classes[0xA0] == "\t"
    for _ in range(300):
        text = odd_text(rng, 20)
        ends = split.ends(text)[0].tolist()
        pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
        assert "".join(pieces) == text
        assert [i for p in pieces for i in bpe[2]._core_bpe.encode_single_piece(p.encode())] == bpe[2].encode_ordinary(text)


def test_byte_bpe_over_awkward_and_long_texts(spark, bpe):
    rows = [*documents(), (900, "long words and lines\n" * 60_000)]
    got = byte_bpe.digests(byte_bpe.encode(frame(spark, rows), *bpe[:2]), *bpe[:2]).collect()
    want = Counter((i, len(ids := bpe[2].encode_ordinary(t or "")), sha(",".join(map(str, ids))), sha(t or "")) for i, t in rows)
    assert Counter(map(tuple, got)) == want
    assert not byte_bpe.digests(byte_bpe.encode(empty(spark), *bpe[:2]), *bpe[:2]).collect()


def test_rank_file_is_what_the_encoder_holds(bpe):
    with open(bpe[0], "rb") as f:
        token, rank = f.readline().split()
    assert bpe[2].decode_bytes([int(rank)]) == base64.b64decode(token)


# -- fill in the middle


def fim(i, text):
    text = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"7:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (i, n, "plain", None, None, text)
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (i, n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m) if h4 % 100 < 50 else (i, n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m)


def test_rank_and_select():
    rng = np.random.default_rng(0)
    for length in (0, 1, 7, 8, 9, 511, 512, 513, 5000):
        for share in (0.0, 0.01, 0.5, 1.0):
            bits = rng.random(length) < share
            v = fill_in_middle.BitVector(np.packbits(bits), length)
            assert v.total == bits.sum()
            assert [v.rank(i) for i in range(length + 1)] == np.concatenate([[0], np.cumsum(bits)]).tolist()
            assert [v.select(r + 1) for r in range(v.total)] == np.flatnonzero(bits).tolist()


def test_line_ends():
    texts = ["a\nb", "", "\n\n", None, "x", "é\n你\n", "\n"] * 40
    data, offsets = utf8(pa.array(texts))
    v = fill_in_middle.line_ends(data, offsets)
    got = [v.rank(b) - v.rank(a) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    assert got == [len(re.findall(r"[^\n]*\n|[^\n]+", t or "")) for t in texts]


def test_fill_in_middle_equals_brute_force(spark):
    rng = random.Random(4)
    lines = ["", "a", "é你 b", "x <P", "S> y", "\r", "<", ">", "M>", "tail <S"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))) + rng.choice(["", "\n"]) for _ in range(200)]
    texts += ["has <P> in it", "\n<M>\n", "<S>", "line\n" * 250_000, "one", "\n"]
    rows = [*documents(), *((500 + i, t) for i, t in enumerate(texts))]
    docs = frame(spark, rows)
    made = fill_in_middle.fill_in_middle(docs)
    assert set(made.columns) == set(docs.columns) - {"text"} | {"n", "form", "prefix_chars", "middle_chars", "output"}
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_in_middle.restored(F.col("output"), F.col("form")).alias("again")).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(fim(i, t) for i, t in rows)
    assert Counter((r["doc_id"], r["again"]) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {"plain", "spm", "psm"} == {r["form"] for r in got}
    assert not fill_in_middle.fill_in_middle(empty(spark)).collect()
