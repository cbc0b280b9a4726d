"""Lower and upper bounds of the best gain, by a method of their own.

Fully corrective conditional gradients on the Lagrangian

    L(c) = b'c - lambda (c'Gc - k):

the best plan of a pool is solved for by active sets, exactly however many of the
pool it takes, and secant steps move lambda until the cap holds. A pass over all
candidates then finds the largest gradient of each budget. L is concave, so for this lambda no feasible plan gains more than

    lambda k + lambda c'Gc + sum over budgets d * (largest gradient),

whatever c is; and a plan within the cap gains what it gains. Candidates of
larger gradient than the pool's join it, until the bounds meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .pricing import Price, Pricer


@dataclass
class Bounds:
    lower: float
    upper: float
    passes: int
    pool: int


def _inverse(z: np.ndarray, scale: float, ridge: float):
    """What solves (ZZ'/s + ridge I) x = y; through the markers where they are fewer."""
    n, m = z.shape
    if ridge > 0 and m < n:
        low = np.linalg.inv(np.linalg.cholesky(scale * ridge * np.eye(m) + z.T @ z))
        once = lambda y: (y - z @ (low.T @ (low @ (z.T @ y)))) / ridge

        def solve(y: np.ndarray) -> np.ndarray:
            x = once(y)
            return x + once(y - z @ (z.T @ x) / scale - ridge * x)  # what the division by the ridge has lost

        return solve
    g = z @ z.T / scale + ridge * np.eye(n)
    return lambda y: np.linalg.lstsq(g, y, rcond=1e-14)[0]


def corrected(z: np.ndarray, b: np.ndarray, group: np.ndarray, budgets: np.ndarray, c: np.ndarray, t: float, scale: float, ridge: float, tol: float) -> np.ndarray:
    """The best plan of a pool at the price 1 / (2t), from plan c: the candidate of
    largest gradient becomes free, the optimum over the free ones is solved for, and
    where it is not a plan, c goes as far towards it as it can and the candidate
    that stops it is free no more."""
    c, free = c.copy(), c > 0
    for _ in range(20 * len(b) + 100):
        f = np.flatnonzero(free)
        a = (group[f][:, None] == np.arange(len(budgets))).astype(float)
        solved = _inverse(z[f], scale, ridge)(np.column_stack([t * b[f], a]))
        mu = np.linalg.lstsq(a.T @ solved[:, 1:], a.T @ solved[:, 0] - budgets, rcond=None)[0]
        x = solved[:, 0] - solved[:, 1:] @ mu
        if (x < 0).any():
            share = np.where(x < 0, c[f] / np.maximum(c[f] - x, 1e-300), 1.0)
            stops = share <= share.min()
            c[f] = np.where(stops, 0.0, np.maximum(c[f] + share.min() * (x - c[f]), 0.0))
            free[f[stops]] = False
            continue
        c[f] = x
        r = np.where(free, -np.inf, t * b - z @ (z[f].T @ x) / scale - mu[group])
        i = int(np.argmax(r))
        if r[i] <= tol * t:
            break
        free[i] = True
    return c


def at_cap(z: np.ndarray, b: np.ndarray, group: np.ndarray, budgets: np.ndarray, c: np.ndarray, k: float, scale: float, ridge: float, price: float, tol: float = 1e-10, steps: int = 200) -> tuple[np.ndarray, float]:
    """(plan, lambda) over a pool, from plan c and a first lambda. Coancestry rises
    with t, in pieces linear in t^2, so secants between bounds of t^2 end soon."""
    t, low, high, before = 1 / (2 * price), 0.0, np.inf, None
    for _ in range(steps):
        c = corrected(z, b, group, budgets, c, t, scale, ridge, tol)
        total = z.T @ c
        quad, now = float(total @ total) / scale + ridge * float(c @ c), t * t
        if abs(quad - k) <= 1e-12 * max(1.0, k):
            break
        low, high = (max(low, now), high) if quad < k else (low, min(high, now))
        if high < 1e-16 or high <= low * (1 + 1e-15):  # no plan of the pool keeps the cap
            break
        new = now + (k - quad) * (now - before[0]) / (quad - before[1]) if before is not None and quad != before[1] else now * k / quad
        if not low < new < high:
            new = 4 * low if np.isinf(high) else (low + high) / 2 if low > 0 else high / 16
        before, t = (now, quad), float(np.sqrt(new))
    return c, 1 / (2 * t)


def gain_bounds(pricer: Pricer, budgets, k: float, scale: float, ridge: float = 1e-5, within: float = 1e-7, passes: int = 200, chunk: int = 64) -> Bounds:
    """Bounds for a panel without per-candidate caps; a cap that no plan meets has
    no lower bound (minus infinity)."""
    budgets = np.asarray(budgets, float)
    alone = [np.where(np.arange(len(budgets)) == q, 0.0, np.inf) for q in range(len(budgets))]
    got, _ = pricer.best([Price(None, 1.0, 0.0, mu, -np.inf) for mu in alone], set(), chunk)
    ids, z, b, group = list(got.ids), got.z, got.b, np.asarray(got.group)
    c = np.zeros(len(ids))
    for q, d in enumerate(budgets):
        c[np.flatnonzero(group == q)[np.argmax(b[group == q])]] = d
    total = z.T @ c
    if float(total @ total) / scale + ridge * float(c @ c) <= k:  # the best of each budget, which the cap allows
        return Bounds(float(b @ c), float(b @ c), 0, len(ids))
    lower, upper, price, tol = -np.inf, np.inf, 1.0, 1e-4
    inside = k * (1 - 1e-10)  # so that rounding leaves the plan within the cap
    for done in range(1, passes + 1):
        c, price = at_cap(z, b, group, budgets, c, inside, scale, ridge, price, tol)
        total = z.T @ c
        quad = float(total @ total) / scale + ridge * float(c @ c)
        r = b - 2 * price * (z @ total / scale + ridge * c)
        own = np.array([r[group == q].max() for q in range(len(budgets))])
        got, _ = pricer.best([Price(total / scale, 1.0, 2 * price, own[q] + mu, 0.0) for q, mu in enumerate(alone)], set(ids), chunk)
        beyond = got.b - 2 * price * (got.z @ total / scale) if got.ids else np.empty(0)
        most = np.array([max([own[q], *beyond[np.asarray(got.group) == q]]) for q in range(len(budgets))])
        upper = min(upper, price * (k + quad) + float(budgets @ most))
        if quad <= k:
            lower = max(lower, float(b @ c))
        if upper - lower <= within or (not got.ids and tol <= 1e-10):
            break
        tol = max(tol / (10 if got.ids else 1000), 1e-10)  # exact only where the bounds are close
        if not got.ids:
            continue
        ids, z, b, group, c = ids + list(got.ids), np.vstack([z, got.z]), np.append(b, got.b), np.append(group, got.group), np.append(c, np.zeros(len(got.ids)))
    return Bounds(lower, upper, done, len(ids))
