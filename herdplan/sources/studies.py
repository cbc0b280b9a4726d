"""Small numpy panels for studies of the support's size."""

from __future__ import annotations

import numpy as np


def low_rank_cloud(n: int, m: int, rank: int, seed: int) -> np.ndarray:
    """Centred genotype-like rows that lie near ``rank`` directions."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, m)) / np.sqrt(rank)
    return x - x.mean(axis=0)


def decaying_cloud(n: int, m: int, decay: float, seed: int) -> np.ndarray:
    """Centred rows whose spectrum falls as a power of the rank."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, m)) * (np.arange(1, m + 1) ** (-decay / 2))
    return x - x.mean(axis=0)


def decaying_matrix(n: int, decay: float, seed: int) -> np.ndarray:
    """A relationship-like matrix with eigenvalues i ** -decay, mean diagonal 1."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    q = q * np.sign(np.diag(r))
    g = (q * np.arange(1, n + 1) ** -decay) @ q.T
    return g / g.diagonal().mean()
