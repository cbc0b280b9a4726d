"""Reports over small result tables: frontiers, scaling points, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cubic_label


def frontier_check(points: DataFrame, tol: float = 1e-9) -> DataFrame:
    """One row: gain never falls as k rises, and the largest fall."""
    fall = F.greatest(F.lag("gain").over(Window.orderBy("k")) - F.col("gain"), F.lit(0.0))
    return points.withColumn("fall", F.coalesce(fall, F.lit(0.0))).agg(F.max("fall").alias("worst")).select("worst", (F.col("worst") <= tol).alias("monotone"))


def growth_exponent(points: DataFrame) -> DataFrame:
    """One row: ln(t2/t1) / ln(n2/n1) of the two largest solved sizes; null
    with fewer, or with equal sizes."""
    last = points.where("solved").orderBy(F.desc("n"), F.desc("seconds")).limit(2)
    w = Window.orderBy("n", "seconds")
    pair = last.withColumn("n0", F.lag("n").over(w)).withColumn("t0", F.lag("seconds").over(w)).where("n0 is not null")
    e = F.when(F.col("n") != F.col("n0"), F.ln(F.col("seconds") / F.col("t0")) / F.ln(F.col("n") / F.col("n0")))
    return pair.agg(F.max(e).alias("exponent")).withColumn("label", cubic_label(F.col("exponent")))


def verdict(points: DataFrame, frontier: DataFrame, max_ridge: float = 1e-3, max_exponent: float = 3.5, reach: int = 10000, max_rss_mb: float = 32768.0) -> DataFrame:
    """One row with every criterion and GO or NO-GO."""
    base = points.agg(
        F.bool_and("solved").alias("all_solved"), F.bool_and("feasible").alias("all_feasible"), F.max("ridge").alias("max_ridge"),
        F.max(F.when(F.col("solved"), F.col("n"))).alias("max_n"), F.max("rss_mb").alias("max_rss_mb"),
    )
    row = base.crossJoin(frontier_check(frontier)).crossJoin(growth_exponent(points))
    go = (
        F.col("all_solved") & F.col("all_feasible") & F.col("monotone") & (F.col("max_ridge") <= max_ridge) & (F.col("max_n") >= reach)
        & F.coalesce(F.col("max_rss_mb") <= max_rss_mb, F.lit(True)) & F.coalesce(F.col("exponent") <= max_exponent, F.lit(True))
    )
    return row.select("all_solved", "all_feasible", "max_ridge", "max_n", "max_rss_mb", "monotone", "exponent", F.when(go, "GO").otherwise("NO-GO").alias("verdict"))


def timings(runs: DataFrame, by: str, value: str) -> DataFrame:
    return runs.groupBy(by).agg(F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def power_law(points: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of ln y on ln x."""
    lx, ly = F.ln(x), F.ln(y)
    return points.where((F.col(x) > 0) & (F.col(y) > 0)).agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.regr_r2(ly, lx).alias("r2"))


def average_ranks(df: DataFrame, column: str, name: str, parts: int = 256) -> DataFrame:
    """(column, name) with the mean rank of each distinct number: counts are
    aggregated first, then summed inside ranges of equal width and over ranges,
    so no task holds all values. NaN is above all, as in an ordering."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    d = F.col(column).cast("double")
    finite = F.when(F.abs(d) < float("inf"), d)
    ends = df.agg(F.min(finite).alias("_low"), F.max(finite).alias("_high"))
    inside = F.when(F.col("_high") > F.col("_low"), F.floor((d - F.col("_low")) / (F.col("_high") - F.col("_low")) * parts)).otherwise(0)
    part = F.when(F.isnan(d), parts + 2).when(d == float("inf"), parts + 1).when(d == -float("inf"), -1).otherwise(inside)
    dealt = counts.crossJoin(ends).withColumn("_part", part)
    totals = dealt.groupBy("_part").agg(F.sum("_n").alias("_all"))
    before = totals.select("_part", (F.sum("_all").over(Window.orderBy("_part")) - F.col("_all")).alias("_before"))
    own = F.sum("_n").over(Window.partitionBy("_part").orderBy(column)) - F.col("_n")
    return dealt.withColumn("_own", own).join(before, "_part").select(column, (F.col("_before") + F.col("_own") + (F.col("_n") + 1) / 2).alias(name))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return full.join(average_ranks(full, x, "_rx"), x).join(average_ranks(full, y, "_ry"), y).agg(F.corr("_rx", "_ry").alias("rho"))


def same_support(one: DataFrame, other: DataFrame, tol: float = 1e-6) -> DataFrame:
    """One row: do two plans (candidate_id, c) have the same candidates above
    ``tol``, and how far are their contributions apart at most?"""
    a = one.where(F.col("c") > tol).select("candidate_id", F.col("c").alias("_a"))
    b = other.where(F.col("c") > tol).select("candidate_id", F.col("c").alias("_b"))
    both = a.join(b, "candidate_id", "full")
    apart = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return both.agg((F.count_if(F.col("_a").isNull() | F.col("_b").isNull()) == 0).alias("same"), F.coalesce(F.max(apart), F.lit(0.0)).alias("apart"))
