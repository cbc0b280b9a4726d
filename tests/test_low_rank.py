"""The factor of a low rank plus ridge, from rows."""

from pathlib import Path

import numpy as np
import pytest

from herdplan.errors import InputError, NonPositivePivot
from herdplan.plans import low_rank
from herdplan.queries import QUERIES

from .test_pairs import shuffled

SF = "/root/testdata/sf0.01"


def rows(spark, z, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, z)], "candidate_id long, z array<double>")


@pytest.mark.parametrize("n, m, side", [(1, 3, 64), (300, 5, 64), (130, 40, 16), (90, 7, 1024)])
def test_factor_times_transpose(spark, n, m, side):
    rng = np.random.default_rng(n)
    z, ids = rng.normal(size=(n, m)), rng.permutation(np.arange(n) * 7 - 50)
    got = low_rank.product(rows(spark, z, ids), 3.0, 1e-4, side).toPandas()
    place = {i: k for k, i in enumerate(ids)}
    i, j = got.i.map(place).to_numpy(), got.j.map(place).to_numpy()
    assert len(got) == n * (n + 1) // 2 == len(set(zip(i, j))) and (got.i <= got.j).all()
    assert np.abs(got.g.to_numpy() - (z @ z.T / 3 + 1e-4 * np.eye(n))[i, j]).max() < 1e-10


def test_blocks_are_those_of_the_factor():
    rng = np.random.default_rng(0)
    u, ridge = rng.normal(size=(50, 4)), 0.01
    whole = np.linalg.cholesky(u @ u.T + ridge * np.eye(50))
    for low, high in ((0, 20), (20, 35), (35, 50)):
        a = ridge**0.5 * np.linalg.inv(np.linalg.qr(np.vstack([ridge**0.5 * np.eye(4), u[:low]]), mode="r"))
        tile, y = low_rank._tile(u[low:high], a, ridge)
        assert np.allclose(tile, whole[low:high, low:high]) and np.allclose(u[high:] @ y, whole[high:, low:high])


def test_empty_panels_and_bad_pivots(spark):
    assert low_rank.product(rows(spark, [], []), 1.0, 0.1).count() == 0
    bare = low_rank.product(rows(spark, [[], []], [1, 2]), 1.0, 0.5).orderBy("i", "j").toPandas()
    assert np.allclose(bare.to_numpy(), [(1, 1, 0.5), (1, 2, 0.0), (2, 2, 0.5)], atol=1e-15)
    z = np.array([[1.0], [1.0], [2.0]])
    with pytest.raises(NonPositivePivot) as e:
        low_rank.product(rows(spark, z, [3, 5, 9]), 1.0, 1e-30)
    assert e.value.index == 5
    with pytest.raises(InputError):
        low_rank.product(rows(spark, z, [3, 5, 9]), 1.0, 0.0)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_query_deals_out_no_tiles(spark):
    """A tile alone has 8 MB."""
    moved, n = shuffled(spark, QUERIES["cholesky_pairs"](spark, SF))
    assert n == 500 * 501 // 2 and moved < 1_500_000
