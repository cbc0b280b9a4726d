"""Crossing rounds, study panels and the command line."""

import numpy as np
import pytest

from herdplan.__main__ import main
from herdplan.operators import breeding
from herdplan.sources import studies


def test_parents_follow_contributions(spark):
    rows = [(1, True, 0.3), (2, True, 0.1), (3, True, 0.1), (4, False, 0.5), (5, False, 0.0), (6, True, -0.2)]
    c = spark.createDataFrame(rows, "candidate_id long, male boolean, c double")
    got = breeding.draw_parents(c, 4000, 3).toPandas()
    assert len(got) == 4000 and set(got.dam) == {4} and set(got.sire) == {1, 2, 3}
    share = got.sire.value_counts(normalize=True)
    assert share[1] == pytest.approx(0.6, abs=0.03) and share[2] == pytest.approx(0.2, abs=0.03)


def test_children_carry_their_parents_alleles(spark):
    h = breeding.founders(spark, 20, 9, 4)
    c = spark.createDataFrame([(i, i % 2 == 0, float(i)) for i in range(20)], "candidate_id long, male boolean, b double")
    pairs = breeding.draw_best(c, 30, 5, n=3)
    assert {r.sire for r in pairs.collect()} <= {18, 16, 14} and {r.dam for r in pairs.collect()} <= {19, 17, 15}
    kids = breeding.gametes(pairs, h, 6)
    own = {(r.candidate_id, r.marker_id): {r.a, r.b} for r in h.collect()}
    parents = {r.child: (r.sire, r.dam) for r in pairs.collect()}
    rows = kids.collect()
    assert len(rows) == 30 * 9
    assert all(r.a in own[parents[r.candidate_id][0], r.marker_id] and r.b in own[parents[r.candidate_id][1], r.marker_id] for r in rows)


def test_study_panels():
    assert np.linalg.matrix_rank(studies.low_rank_cloud(40, 60, 5, 1)) == 5
    assert studies.decaying_cloud(30, 20, 1.0, 1).shape == (30, 20)
    g = studies.decaying_matrix(12, 1.0, 2)
    assert np.allclose(g, g.T) and np.linalg.eigvalsh(g)[0] > 0 and g.diagonal().mean() == pytest.approx(1)


@pytest.mark.parametrize("command", [["correctness"], ["frontier", "--caps", "3"], ["compare", "--simplex"], ["scale"], ["bench"], ["matrixfree", "--sizes", "40,60", "--g-gib", "0.00002"], ["parents", "--sizes", "60", "--target", "8"]])
def test_commands(spark, capsys, command):
    assert main([*command, "--n", "60", "--m", "30"]) == 0
    assert capsys.readouterr().out.count(",") >= 3


def test_unknown_command():
    with pytest.raises(SystemExit) as e:
        main(["nothing"])
    assert e.value.code == 2


def test_generations_gain_and_lose_heterozygosity(spark):
    """Both ways gain; the optimum at twenty effective parents keeps more variety
    than mating the two best of each sex."""
    best = breeding.generations(spark, 60, 30, 2, "truncation", n_best=2).toPandas()
    plan = breeding.generations(spark, 60, 30, 2, "optimum", target=15.0).toPandas()
    for x in (best, plan):
        assert x.gen.tolist() == [0, 1, 2] and x.gain[0] == 0 and x.gain[2] > 0
    assert plan.het[2] > best.het[2]
