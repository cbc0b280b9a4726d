"""Bounds where the ridge spreads the optimum over more candidates than markers."""

import numpy as np
import pytest

from herdplan.plans import solve_arrays
from herdplan.plans.bounds import gain_bounds
from herdplan.plans.pricing import LocalPricer


@pytest.mark.parametrize("budgets", [[1.0], [0.5, 0.5]])
def test_bounds_meet_at_a_wide_support(budgets):
    rng = np.random.default_rng(7)
    n, m = 4000, 24
    z, b = rng.integers(0, 3, (n, m)) - 1.0, rng.normal(size=m)
    b, s, male = z @ b, m / 2, np.arange(n) % 2 == 0
    k = 0.03 * float((z * z).sum(axis=1).mean()) / s
    group = np.zeros(n, int) if len(budgets) == 1 else np.where(male, 0, 1)
    want = solve_arrays(z, b, k, s=s, male=None if len(budgets) == 1 else male)
    held = gain_bounds(LocalPricer(np.arange(n), z, b, np.full(n, np.inf), group), budgets, k, s)
    assert want.solved and want.support > 2 * m
    assert held.upper - held.lower <= 1e-6 and held.lower - 1e-6 <= want.gain <= held.upper + 1e-6
