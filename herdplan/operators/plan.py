"""Contribution plans: gain, coancestry, feasibility, seeds, pricing.

A plan is (candidate_id, c); rows that are absent contribute 0. Only rows with a
contribution are joined, so cost follows the support and not the panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import delta_f_percent, effective_parents


def marker_totals(genotypes: DataFrame, plan: DataFrame) -> DataFrame:
    """t = Z'c by marker."""
    own = plan.where(F.col("c") != 0)
    return genotypes.join(own, "candidate_id").groupBy("marker_id").agg(F.sum(F.col("c") * F.col("z")).alias("t"))


def kinship_product(genotypes: DataFrame, plan: DataFrame, scale: DataFrame, ridge: float = 0.0) -> DataFrame:
    """(candidate_id, gc): Gc of all candidates as Z (Z'c) / s + ridge c."""
    t = marker_totals(genotypes, plan)
    zt = genotypes.join(t, "marker_id").groupBy("candidate_id").agg(F.sum(F.col("z") * F.col("t")).alias("zt"))
    own = plan.select("candidate_id", "c")
    return zt.join(own, "candidate_id", "left").crossJoin(scale).select("candidate_id", (F.col("zt") / F.col("s") + ridge * F.coalesce("c", F.lit(0.0))).alias("gc"))


def coancestry(genotypes: DataFrame, plan: DataFrame, scale: DataFrame) -> DataFrame:
    """One row: c'Gc = |Z'c|^2 / s, without ridge."""
    return marker_totals(genotypes, plan).agg(F.sum(F.col("t") * F.col("t")).alias("tt")).crossJoin(scale).select((F.coalesce("tt", F.lit(0.0)) / F.col("s")).alias("quad"))


def coancestry_by_pairs(pairs: DataFrame, plan: DataFrame, ridge: float) -> DataFrame:
    """One row: c'(G + ridge I)c - ridge |c|^2 from a pair table with i <= j."""
    ci, cj = plan.select(F.col("candidate_id").alias("i"), F.col("c").alias("ci")), plan.select(F.col("candidate_id").alias("j"), F.col("c").alias("cj"))
    g = F.col("g") + F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0)
    both = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    ridged = pairs.join(ci, "i").join(cj, "j").agg(F.sum(both * F.col("ci") * g * F.col("cj")).alias("q"))
    return ridged.crossJoin(plan.agg(F.sum(F.col("c") * F.col("c")).alias("cc"))).select((F.col("q") - ridge * F.col("cc")).alias("quad"))


def gain(plan: DataFrame, candidates: DataFrame) -> DataFrame:
    return plan.join(candidates, "candidate_id").agg(F.sum(F.col("b") * F.col("c")).alias("gain"))


def score_plan(plan: DataFrame, candidates: DataFrame, genotypes: DataFrame, scale: DataFrame) -> DataFrame:
    """One row: gain and coancestry of any tool's plan, in this library's terms."""
    return gain(plan, candidates).crossJoin(coancestry(genotypes, plan, scale))


def feasibility(plan: DataFrame, quad: DataFrame, k: float, tol: float = 1e-6) -> DataFrame:
    """One row: sum_err, min_c, quad, k, ok; from the plan, not from a solver."""
    sums = plan.agg(F.abs(F.sum("c") - 1).alias("sum_err"), F.min("c").alias("min_c"))
    ok = (F.col("sum_err") <= tol) & (F.col("min_c") >= -tol) & (F.col("quad") <= k + tol)
    return sums.crossJoin(quad).select("sum_err", "min_c", "quad", F.lit(float(k)).alias("k"), ok.alias("ok"))


def effective_size(plan: DataFrame) -> DataFrame:
    return plan.agg(effective_parents(F.col("c")).alias("ne")).select("ne", delta_f_percent(F.col("ne")).alias("delta_f_pct"))


def by_sex(plan: DataFrame, candidates: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Sum of contributions and size of the support in each sex."""
    return plan.join(candidates, "candidate_id").groupBy("male").agg(F.sum("c").alias("total"), F.count_if(F.col("c") > tol).alias("support"))


def support(plan: DataFrame, tol: float = 1e-6) -> DataFrame:
    return plan.where(F.col("c") > tol)


def uniform_plan(candidates: DataFrame) -> DataFrame:
    """Half to each sex, equal within: counts by sex are aggregated first, so
    no task holds a whole sex."""
    n = candidates.groupBy("male").agg(F.count("*").alias("n"))
    return candidates.join(n, "male").select("candidate_id", (0.5 / F.col("n")).alias("c"))


def best_of(candidates: DataFrame, n: int = 1) -> DataFrame:
    """The n best by b; ties to the smaller id."""
    return candidates.orderBy(F.desc("b"), "candidate_id").limit(n)


def best_by_sex(candidates: DataFrame, n: int = 1) -> DataFrame:
    """The n best of each sex with their rank."""
    out = None
    for sex in (True, False):
        own = best_of(candidates.where(F.col("male") == sex), n)
        own = own.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("b"), "candidate_id")))
        out = own if out is None else out.unionByName(own)
    return out


def greedy_plan(candidates: DataFrame) -> DataFrame:
    return best_by_sex(candidates).select("candidate_id", F.lit(0.5).alias("c"))


def reduced_costs(candidates: DataFrame, product: DataFrame, mu_male: float, mu_female: float, lam: float) -> DataFrame:
    """r = b - mu of the sex - 2 lambda (Gc) of each candidate."""
    mu = F.when(F.col("male"), mu_male).otherwise(mu_female)
    return candidates.join(product, "candidate_id").withColumn("r", F.col("b") - mu - 2 * lam * F.col("gc"))


def price(costs: DataFrame, plan: DataFrame, tol: float = 1e-9, n: int = 1) -> DataFrame:
    """The n candidates outside the plan that violate optimality most."""
    return costs.join(plan, "candidate_id", "left_anti").where(F.col("r") > tol).orderBy(F.desc("r"), "candidate_id").limit(n)


def price_capped(costs: DataFrame, at_upper: DataFrame, plan: DataFrame, tol: float = 1e-9, n: int = 1) -> DataFrame:
    """Adds and releases under one best: a candidate at its cap counts with -r."""
    flagged = costs.join(at_upper.select("candidate_id", F.lit(True).alias("upper")), "candidate_id", "left")
    free = plan.join(at_upper, "candidate_id", "left_anti")
    flagged = flagged.join(free, "candidate_id", "left_anti")
    v = F.when(F.coalesce("upper", F.lit(False)), -F.col("r")).otherwise(F.col("r"))
    return flagged.withColumn("violation", v).where(F.col("violation") > tol).orderBy(F.desc("violation"), "candidate_id").limit(n)


def least_related(product: DataFrame, plan: DataFrame, n: int = 1) -> DataFrame:
    """The n candidates outside the plan with the smallest Gc."""
    return product.join(plan, "candidate_id", "left_anti").orderBy("gc", "candidate_id").limit(n)


def truncation(candidates: DataFrame, n: int = 25) -> DataFrame:
    return best_by_sex(candidates, n)


def check_alignment(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: ids on one side only, and whether there are none."""
    l, r = left.select("candidate_id", F.lit(1).alias("l")), right.select("candidate_id", F.lit(1).alias("r"))
    return l.join(r, "candidate_id", "full").agg(F.count_if(F.col("l").isNull() | F.col("r").isNull()).alias("unmatched")).withColumn("aligned", F.col("unmatched") == 0)


def sex_from_pedigree(ids: DataFrame, pedigree: DataFrame) -> DataFrame:
    """Male where an id is a sire, female where it is a dam, null otherwise;
    '0' is an unknown parent."""
    parents = pedigree.select(F.col("sire").alias("candidate_id"), F.lit(True).alias("male")).union(pedigree.select("dam", F.lit(False)))
    known = parents.where(F.col("candidate_id") != 0).distinct()
    return ids.join(known, "candidate_id", "left").select("candidate_id", "male")


def sires_and_dams(pedigree: DataFrame) -> DataFrame:
    """Ids that are both, which a pedigree must not have."""
    return pedigree.select(F.col("sire").alias("candidate_id")).where("candidate_id <> 0").intersect(pedigree.select(F.col("dam").alias("candidate_id")).where("candidate_id <> 0"))


def standardised(candidates: DataFrame) -> DataFrame:
    stats = candidates.agg(F.avg("b").alias("mean"), F.stddev_pop("b").alias("sd"))
    return candidates.crossJoin(stats).withColumn("b", (F.col("b") - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def shifted(candidates: DataFrame) -> DataFrame:
    """b moved to be positive: the optimum stays."""
    least = candidates.agg(F.min("b").alias("least"))
    return candidates.crossJoin(least).withColumn("b", F.col("b") - F.col("least") + 1).drop("least")
