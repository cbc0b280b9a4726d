"""Spectra, systems, packings, subsets, packed products and shared passes against
dense numpy."""

import hashlib

import numpy as np
import pytest

from herdplan.errors import NonPositivePivot, RidgeExhausted
from herdplan.operators import relatedness
from herdplan.plans import Goal, LocalPricer, PackedPricer, RowPricer, cap_for_effective_size, frontier, select_all, solve_arrays, spectral, tiled
from herdplan.plans.bounds import gain_bounds
from herdplan.plans.dense import greedy_pack, inverse_participation
from herdplan.plans.pricing import looked_up, pack_calls, packed_products, packed_relationships
from herdplan.sources import generators, studies


def rows(spark, z, b=None, parts=3):
    data = [(i, [float(v) for v in z[i]], float(b[i]) if b is not None else 0.0) for i in range(len(z))]
    return spark.createDataFrame(data, "candidate_id long, z array<double>, b double").repartition(parts)


def dense(z, s, ridge=0.0):
    return z @ z.T / s + ridge * np.eye(len(z))


@pytest.mark.parametrize("n, m, rank, equal", [(40, 25, 25, False), (20, 60, 20, False), (50, 30, 6, False), (30, 24, 12, True)])
def test_lanczos_finds_the_whole_spectrum(spark, n, m, rank, equal):
    rng = np.random.default_rng(n)
    u, v = np.linalg.qr(rng.normal(size=(n, rank)))[0], np.linalg.qr(rng.normal(size=(m, rank)))[0]
    e = np.full(rank, 2.0) if equal else np.linspace(1, 5, rank)  # equal: more of one value than a block has vectors
    z = (u * np.sqrt(e * 3.0)) @ v.T
    p = spectral.Products(rows(spark, z), 3.0)
    got = spectral.lanczos(p, block=4)
    assert np.allclose(got.values, np.sort(e)[::-1], rtol=1e-8) and got.residuals.max() < 1e-7
    assert np.allclose(got.vectors.T @ got.vectors, np.eye(rank), atol=1e-8)
    few = spectral.lanczos(p, wanted=2, block=4)
    assert np.allclose(few.values, np.sort(e)[::-1][:2], rtol=1e-8) and few.passes <= got.passes
    v = spectral.spectrum_summary(got)
    assert v["rank"] == rank and v["stable_rank"] == pytest.approx((e**2).sum() / e.max() ** 2) and v["participation"] == pytest.approx(e.sum() ** 2 / (e**2).sum())
    low, high = spectral.extremes(p, 1e-3, block=4)
    full = np.linalg.eigvalsh(dense(z, 3.0, 1e-3))
    assert low == pytest.approx(full[0], rel=1e-6) and high == pytest.approx(full[-1], rel=1e-8)
    p.close()


def test_passes_add_up_the_same_in_spark(spark, monkeypatch):
    z = np.random.default_rng(7).normal(size=(31, 9))
    p, v = spectral.Products(rows(spark, z), 2.0), np.random.default_rng(8).normal(size=(9, 3))
    here = p.apply(v)
    monkeypatch.setattr(spectral, "GATHERED", 0)
    assert np.allclose(p.apply(v), here) and np.allclose(here, z.T @ (z @ v) / 2.0)
    p.close()


def test_clones_escalate_the_ridge(spark):
    z = np.random.default_rng(1).normal(size=(8, 20))
    p = spectral.Products(rows(spark, np.vstack([z, z[:3]])), 20.0)
    ridge, tries, condition = spectral.escalated(p, 1e-6, 5e-5, 10)
    e = np.linalg.eigvalsh(dense(np.vstack([z, z[:3]]), 20.0, 1e-4))
    assert (ridge, tries) == (pytest.approx(1e-4), 3) and condition == pytest.approx(e[-1] / e[0], rel=1e-4)
    with pytest.raises(RidgeExhausted):
        spectral.escalated(p, 1e-9, 1.0, 3)
    p.close()


def test_empty_and_flat_panels_have_no_spectrum(spark):
    none = rows(spark, np.ones((2, 3))).limit(0)
    assert len(spectral.lanczos(spectral.Products(none, 1.0)).values) == 0
    flat = spectral.Products(rows(spark, np.zeros((4, 3))), 1.0)
    assert spectral.spectrum_summary(spectral.lanczos(flat))["rank"] == 0 and spectral.extremes(flat, 0.5) == (0.5, 0.5)
    assert [r.x for r in spectral.inverse_times(spectral.Products(rows(spark, np.zeros((2, 3)), [1.0, 2.0]), 1.0), 0.5).orderBy("b").collect()] == [2.0, 4.0]


@pytest.mark.parametrize("n, m, ridge", [(60, 20, 1e-5), (12, 30, 1e-2)])
def test_inverse_times_solves_the_system(spark, n, m, ridge):
    rng = np.random.default_rng(m)
    z, b = rng.normal(size=(n, m)), rng.normal(size=n)
    p = spectral.Products(rows(spark, z, b), float(m))
    found = spectral.inverse_times(p, ridge)
    x = np.array([r.x for r in found.orderBy("candidate_id").collect()])
    g = dense(z, m, ridge)
    assert np.linalg.norm(g @ x - b) <= 1e-8 * np.linalg.norm(b)
    assert spectral.participation(found, "x").first().participation == pytest.approx(inverse_participation(g, b), rel=1e-6)
    p.close()


def long(spark, z):
    return spark.createDataFrame([(i, j, float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1])], "candidate_id long, marker_id int, z double")


def test_greedy_packing_equals_the_sequential_one(spark):
    z = studies.low_rank_cloud(70, 12, 4, 3)
    z[60:] = z[:10]  # clones
    b = np.round(np.random.default_rng(5).normal(size=70), 1)  # with ties
    scale = spark.createDataFrame([(12.0,)], "s double")
    candidates = spark.createDataFrame([(i, float(b[i])) for i in range(70)], "candidate_id long, b double")
    taus = (-0.2, 0.0, 0.3, 50.0)
    table = relatedness.conflicts(long(spark, z), scale, candidates, taus)
    got, rounds = relatedness.greedy_packing(candidates, table, taus)
    found = {t: set() for t in taus}
    for r in got.collect():
        found[r.tau].add(r.candidate_id)
    g = np.round(dense(z, 12.0), 9)
    assert found == {t: set(greedy_pack(g, b, t)) for t in taus}
    assert 1 < rounds < 30 and len(found[50.0]) == 70
    none = candidates.limit(0)
    assert relatedness.greedy_packing(none, table.limit(0), taus)[0].count() == 0


def test_random_subsets_take_the_least_hashes(spark):
    z = np.random.default_rng(2).normal(size=(30, 6))
    candidates = spark.createDataFrame([(i,) for i in range(30)], "candidate_id long").repartition(4)
    drawn = relatedness.random_subsets(candidates, 5, 8, seed=3)
    sets = {}
    for r in drawn.collect():
        sets.setdefault(r.draw, set()).add(r.candidate_id)
    key = lambda d, i: hashlib.md5(f"3:{d}:{i}".encode()).hexdigest()
    assert sets == {d: set(sorted(range(30), key=lambda i: key(d, i))[:5]) for d in range(8)}  # noqa: B023
    g = dense(z, 4.0)
    for r in relatedness.subset_kinship(drawn, long(spark, z), spark.createDataFrame([(4.0,)], "s double")).collect():
        own = g[np.ix_(sorted(sets[r.draw]), sorted(sets[r.draw]))]
        assert r["size"] == 5 and r["mean"] == pytest.approx((own.sum() - np.trace(own)) / 20)
    assert relatedness.random_subsets(candidates, 50, 2).count() == 60


def calls(n, m, seed):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.1, 0.5, m)
    d = rng.binomial(2, p, (n, m)).astype(np.uint8)
    d[rng.random((n, m)) < 0.05] = 3
    known = d < 3
    p = np.where(known, d, 0).sum(axis=0) / np.maximum(2 * known.sum(axis=0), 1)
    return d, p, np.where(known, d - 2 * p, 0.0)


@pytest.mark.parametrize("m", [1, 4, 7, 33])
def test_packed_products_with_missing_calls(m):
    d, p, z = calls(23, m, m)
    t = np.random.default_rng(0).normal(size=(m, 3))
    assert np.allclose(looked_up(pack_calls(d), p, t), z @ t)
    assert np.allclose(packed_products(pack_calls(d[:9]), pack_calls(d[9:]), p), z[:9] @ z[9:].T)


def test_packed_rows_price_like_centred_rows(spark):
    d, p, z = calls(90, 41, 6)
    b, s = np.random.default_rng(1).normal(size=90), float(2 * (p * (1 - p)).sum())
    of = lambda data, kind: spark.createDataFrame([(i, data[i], float(b[i]), None, i % 2) for i in range(90)], f"candidate_id long, z {kind}, b double, cap double, group int")
    packed = of([pack_calls(x[None, :])[0].tobytes() for x in d], "binary")
    assert len(packed.first().z) == -(-41 // 4)
    one, two = RowPricer(of(z.tolist(), "array<double>")), PackedPricer(packed, p)
    goals = [Goal(k) for k in (0.15, 0.3, 0.6)]
    a, c = select_all(one, [0.5, 0.5], goals, s), select_all(two, [0.5, 0.5], goals, s)
    for x, y in zip(a, c):
        assert x.solved and y.solved and x.ids == y.ids and x.gain == pytest.approx(y.gain, abs=1e-9)
    assert one.passes == two.passes
    g = {(r.i, r.j): r.g for r in packed_relationships(packed.select("candidate_id", "z"), p, s, block=20).collect()}
    want = z @ z.T / s
    assert len(g) == 90 * 91 // 2 and all(abs(v - want[i, j]) < 1e-9 for (i, j), v in g.items())
    one.close(), two.close()


def test_a_frontier_shares_its_passes(spark):
    d, p, z = calls(300, 40, 9)
    b, s = np.random.default_rng(4).normal(size=300), float(2 * (p * (1 - p)).sum())
    data = spark.createDataFrame([(i, z[i].tolist(), float(b[i]), i % 2 == 0, 0.2) for i in range(300)], "candidate_id long, z array<double>, b double, male boolean, cap double")
    ks = np.linspace(0.05, 0.6, 7)
    for capped in (False, True):
        got = frontier(data, ks, s, capped=capped)
        alone = [solve_arrays(z, b, k, s=s, male=np.arange(300) % 2 == 0, caps=np.full(300, 0.2) if capped else None) for k in ks]
        assert all(x.solved and x.gain == pytest.approx(y.gain, abs=1e-8) and x.quad <= k + 1e-9 for x, y, k in zip(got, alone, ks))
        assert max(x.products for x in got) <= max(y.products for y in alone) + 2  # not their sum


def test_effective_size_is_met_in_one_walk(spark):
    d, p, z = calls(200, 30, 2)
    b, s = np.random.default_rng(8).normal(size=200), float(2 * (p * (1 - p)).sum())
    data = spark.createDataFrame([(i, z[i].tolist(), float(b[i]), i % 2 == 0, None) for i in range(200)], "candidate_id long, z array<double>, b double, male boolean, cap double")
    for target in (4.0, 12.0, 25.0):
        got, size = cap_for_effective_size(data, target, s)
        assert size == pytest.approx(target, rel=1e-6)
        again = solve_arrays(z, b, got.k, s=s, male=np.arange(200) % 2 == 0)
        assert again.gain == pytest.approx(got.gain, abs=1e-7) and 1 / (again.c**2).sum() == pytest.approx(target, rel=1e-4)
        assert got.products < 2 * again.products + 2
    with pytest.raises(ValueError):
        cap_for_effective_size(data, 500.0, s)
    got, size = cap_for_effective_size(data, 1.5, s)
    assert size == pytest.approx(2.0) and got.lam == 0.0  # the best of each sex has more already


def test_bounds_enclose_the_optimum():
    d, p, z = calls(150, 30, 4)
    b, s = np.random.default_rng(3).normal(size=150), float(2 * (p * (1 - p)).sum())
    group = np.arange(150) % 2
    for budgets, who in (([1.0], np.zeros(150, int)), ([0.5, 0.5], group)):
        for k in (0.08, 0.3, 9.0):
            held = gain_bounds(LocalPricer(np.arange(150), z, b, np.full(150, np.inf), who), budgets, k, s)
            gain = solve_arrays(z, b, k, s=s, male=None if len(budgets) == 1 else group == 0).gain
            assert held.upper - held.lower < 1e-6 and held.lower - 1e-7 <= gain <= held.upper + 1e-7


def test_genes_drop_down_a_pedigree_of_several_generations(spark):
    founders = [(i, j, (i * j + i) % 3) for i in (1, 2, 3) for j in range(12)]
    ped = [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 2), (5, 1, 3), (6, 4, 5), (7, 4, 99)]  # 99 is not there
    d = spark.createDataFrame(founders, "candidate_id long, marker_id int, dosage int")
    got = generators.gene_drop(spark.createDataFrame(ped, "candidate_id long, sire long, dam long"), d, 3).collect()
    dosage = {(r.candidate_id, r.marker_id): r.dosage for r in got}
    assert {(r.candidate_id, r.generation) for r in got} == {(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 2)} and len(got) == 6 * 12
    assert all(dosage[i, j] == v for i, j, v in founders)
    for i, s, m in ped[3:6]:
        for j in range(12):
            assert (dosage[s, j] == 2) + (dosage[m, j] == 2) <= dosage[i, j] <= (dosage[s, j] > 0) + (dosage[m, j] > 0)


@pytest.mark.parametrize("n, side", [(1, 4), (4, 4), (11, 4), (30, 7)])
def test_tiled_cholesky(spark, n, side):
    rng = np.random.default_rng(n)
    ids = np.sort(rng.choice(1000, n, replace=False))
    z = rng.normal(size=(n, n + 3))
    g = z @ z.T / n
    g[np.abs(g) < 0.2] = 0.0
    g += n * np.eye(n)
    pairs = [(int(ids[i]), int(ids[j]), float(g[i, j])) for i in range(n) for j in range(i, n) if g[i, j]]
    pairs += [pairs[0], (pairs[-1][1], pairs[-1][0], pairs[-1][2])]  # repeated, and from the other side
    table = spark.createDataFrame(pairs, "i long, j long, g double")
    places, factor, ridge = tiled.factored(table, 0.25, side=side)
    rows = tiled.factor_rows(places, factor, side).orderBy("candidate_id").collect()
    low = np.array([r.z for r in rows])
    assert [r.candidate_id for r in rows] == ids.tolist() and low.shape == (n, n) and ridge == 0.25
    assert np.allclose(low, np.linalg.cholesky(g + 0.25 * np.eye(n)))
    back = {(r.i, r.j): r.g for r in tiled.product(places, factor, side).collect()}
    assert len(back) == n * (n + 1) // 2 and all(abs(back[ids[i], ids[j]] - g[i, j] - 0.25 * (i == j)) < 1e-9 for i in range(n) for j in range(i, n))
    bad = n // 2
    g[bad, bad] = -1.0
    wrong = spark.createDataFrame([(int(ids[i]), int(ids[j]), float(g[i, j])) for i in range(n) for j in range(i, n)], "i long, j long, g double")
    with pytest.raises(NonPositivePivot) as e:
        tiled.factored(wrong, side=side)
    assert e.value.index == ids[bad]
    least = -np.linalg.eigvalsh(g)[0]
    _, _, ridge = tiled.factored(wrong, least / 50, tries=4, side=side)
    assert ridge == pytest.approx(2 * least)
    with pytest.raises(RidgeExhausted):
        tiled.factored(wrong, 1e-9, tries=2, side=side)


def test_pairs_solve_like_arrays(spark):
    d, p, z = calls(40, 60, 11)
    b, s = np.random.default_rng(2).normal(size=40), float(2 * (p * (1 - p)).sum())
    g = dense(z, s, 1e-3)
    pairs = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(40) for j in range(i, 40)], "i long, j long, g double")
    candidates = spark.createDataFrame([(i, float(b[i]), i % 2 == 0, 0.2) for i in range(40)], "candidate_id long, b double, male boolean, cap double")
    for capped in (False, True):
        got = tiled.solve_pairs(pairs, candidates, 0.3, capped=capped, side=16)
        want = solve_arrays(z, b, 0.3, s=s, ridge=1e-3, male=np.arange(40) % 2 == 0, caps=np.full(40, 0.2) if capped else None)
        assert got.gain == pytest.approx(want.gain, abs=1e-8) and sorted(got.ids) == sorted(want.ids)
    empty = tiled.factored(pairs.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0
