"""Solvers: a small exact master problem on the driver, pricing in Spark."""

from .api import ArrayPanel, Selection, read_plink, select_all, solve_arrays, solve_given, solve_panel, vanraden_scale
from .frontier import cap_for_effective_size, frontier, frontier_table
from .master import Goal, Master, closed_form
from .pricing import LocalPricer, PackedPricer, Price, Pricer, RowPricer

__all__ = ["ArrayPanel", "read_plink", "solve_arrays", "solve_given", "vanraden_scale", "Goal", "Master", "closed_form", "Price", "Pricer", "LocalPricer", "RowPricer", "PackedPricer", "Selection", "select_all", "solve_panel", "frontier", "frontier_table", "cap_for_effective_size"]
