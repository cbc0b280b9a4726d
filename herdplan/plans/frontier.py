"""Many caps at once, and the cap that gives an effective size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import Selection, grouped, select_all
from .master import Goal
from .pricing import pricer_for


def _solved(rows: DataFrame, goals: Sequence[Goal], scale: float, ridge: float, sexed: bool, capped: bool, local_bytes: int, held: bool) -> list[Selection]:
    own = grouped(rows if capped else rows.withColumn("cap", F.lit(None).cast("double")), sexed)
    pricer = pricer_for(own, local_bytes, held)
    try:
        return select_all(pricer, [0.5, 0.5] if sexed else [1.0], goals, scale, ridge)
    finally:
        pricer.close()


def frontier(rows: DataFrame, ks: Sequence[float], scale: float, ridge: float = 1e-5, sexed: bool = True, capped: bool = False, local_bytes: int = 0, held: bool = False) -> list[Selection]:
    """The optimum for each cap: one working set and one pricing pass serve all of
    them, so passes do not grow with the number of caps."""
    return _solved(rows, [Goal(float(k)) for k in ks], scale, ridge, sexed, capped, local_bytes, held)


def frontier_table(rows: DataFrame, found: Sequence[Selection]) -> DataFrame:
    """(k, quad, gain, feasible, n_support) of a frontier."""
    return rows.sparkSession.createDataFrame([(float(x.k), float(x.quad), float(x.gain), x.solved, x.support) for x in found], "k double, quad double, gain double, feasible boolean, n_support int")


def cap_for_effective_size(rows: DataFrame, target: float, scale: float, ridge: float = 1e-5, sexed: bool = True, capped: bool = False, local_bytes: int = 0, held: bool = False) -> tuple[Selection, float]:
    """(selection, size) at the point of the critical line where 1 / sum c^2 meets
    the target: one walk over the working set and the passes of one solve. Its
    coancestry is the cap that gives the size. Where the plan of most gain is at
    or above the target already, that plan; an error where no plan reaches it."""
    got = _solved(rows, [Goal(square=1.0 / target)], scale, ridge, sexed, capped, local_bytes, held)[0]
    if not got.solved:
        raise ValueError("no plan has so many effective parents")
    return got, 1 / float(np.sum(got.c**2))
