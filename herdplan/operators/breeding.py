"""Rounds of crossing: parents in proportion to contributions, or the best."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.generators import normal, uniform
from . import panel
from .plan import best_by_sex


def draw_parents(contributions: DataFrame, offspring: int, seed: int) -> DataFrame:
    """(child, sire, dam): each child draws a parent of either sex with the odds
    of its contribution (negative ones count as none): a uniform number meets the
    cumulative sums within a sex in a range condition. A plan is a few hundred
    rows, so the sums are one small window."""
    spark = contributions.sparkSession
    w = Window.partitionBy("male").orderBy("candidate_id")
    c = F.greatest("c", F.lit(0.0))
    total = F.sum(c).over(Window.partitionBy("male"))
    bins = contributions.where(c > 0).select("male", "candidate_id", (F.sum(c).over(w) / total).alias("high"), (c / total).alias("width"))
    bins = bins.withColumn("low", F.col("high") - F.col("width"))
    children = spark.range(offspring).select(F.col("id").alias("child"))
    out = children
    for male, name in ((True, "sire"), (False, "dam")):
        own = F.broadcast(bins.where(F.col("male") == male).select(F.col("candidate_id").alias(name), "low", "high", F.col("high").alias("top")))
        u = uniform(seed + int(male), F.col("child"))
        met = children.withColumn("u", u).join(own, (F.col("u") >= F.col("low")) & ((F.col("u") < F.col("high")) | (F.col("top") > 1 - 1e-12)))
        out = out.join(met.groupBy("child").agg(F.min_by(name, "high").alias(name)), "child")
    return out


def draw_best(candidates: DataFrame, offspring: int, seed: int, n: int = 25) -> DataFrame:
    """(child, sire, dam): parents at random among the n best of each sex."""
    equal = best_by_sex(candidates, n).select("candidate_id", "male", F.lit(1.0).alias("c"))
    return draw_parents(equal, offspring, seed)


def gametes(parents: DataFrame, haplotypes: DataFrame, seed: int) -> DataFrame:
    """(candidate_id, marker_id, a, b) of the children: from each parent's two
    alleles (a, b) at a marker, one by a fair toss."""
    s = haplotypes.select(F.col("candidate_id").alias("sire"), "marker_id", F.col("a").alias("sa"), F.col("b").alias("sb"))
    d = haplotypes.select(F.col("candidate_id").alias("dam"), "marker_id", F.col("a").alias("da"), F.col("b").alias("db"))
    toss = lambda k: uniform(seed + k, F.col("child"), F.col("marker_id")) < 0.5
    both = parents.join(s, "sire").join(d, ["dam", "marker_id"])
    return both.select(F.col("child").alias("candidate_id"), "marker_id", F.when(toss(2), F.col("sa")).otherwise(F.col("sb")).alias("a"), F.when(toss(3), F.col("da")).otherwise(F.col("db")).alias("b"))


def founders(spark: SparkSession, n: int, m: int, seed: int) -> DataFrame:
    """Two alleles a marker for n unrelated candidates."""
    p = 0.05 + 0.45 * uniform(seed, F.col("marker_id"))
    allele = lambda k: (uniform(seed + k, F.col("candidate_id"), F.col("marker_id")) < p).cast("int")
    grid = spark.range(n).select(F.col("id").alias("candidate_id"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("marker_id"))
    return grid.select("candidate_id", "marker_id", allele(10).alias("a"), allele(11).alias("b"))


def settled(df: DataFrame) -> DataFrame:
    """A generation as it is, written where the session has a checkpoint folder."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def population(haplotypes: DataFrame, effects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates with b and male, genotypes, markers) of two alleles a marker;
    b is the genetic value of the dosages, sex the parity of the id."""
    dosages = haplotypes.select("candidate_id", "marker_id", (F.col("a") + F.col("b")).alias("dosage"))
    markers = panel.allele_frequencies(dosages)
    value = dosages.join(effects, "marker_id").groupBy("candidate_id").agg(F.sum(F.col("dosage") * F.col("w")).alias("b"))
    return value.withColumn("male", F.col("candidate_id") % 2 == 0), panel.centre(dosages, markers), markers


def crossing_round(haplotypes: DataFrame, effects: DataFrame, offspring: int, method: str, seed: int, target: float = 20.0, n_best: int = 25, ridge: float = 2e-5) -> DataFrame:
    """Haplotypes of the next generation. 'optimum': the plan on the critical line
    that has ``target`` effective parents, in proportion to which parents are
    drawn; 'truncation': among the n_best of each sex."""
    from ..plans import cap_for_effective_size

    candidates, genotypes, markers = population(haplotypes, effects)
    if method == "truncation":
        return settled(gametes(draw_best(candidates, offspring, seed, n_best), haplotypes, seed))
    candidates, scale = settled(candidates), panel.vanraden_scale(markers)
    rows = panel.widen(genotypes).join(candidates, "candidate_id").withColumn("cap", F.lit(None).cast("double"))
    found, _ = cap_for_effective_size(rows, target, scale.first()["s"], ridge)
    plan = found.contributions(haplotypes.sparkSession).join(candidates.select("candidate_id", "male"), "candidate_id")
    return settled(gametes(draw_parents(plan, offspring, seed), haplotypes, seed))


def generations(spark: SparkSession, n: int, m: int, rounds: int, method: str, seed: int = 1, rep: int = 1, **options) -> DataFrame:
    """(rep, method, gen, gain, het): mean genetic value above that of the
    founders, and the share of heterozygous calls, of each generation."""
    effects = settled(spark.range(m).select(F.col("id").cast("int").alias("marker_id"), normal(seed + 50, F.col("id")).alias("w")))
    own, out = settled(founders(spark, n, m, seed)), []
    for gen in range(rounds + 1):
        dosages = own.select("candidate_id", "marker_id", (F.col("a") + F.col("b")).alias("dosage"))
        het = panel.heterozygosity(dosages).first()["het"]
        mean = population(own, effects)[0].agg(F.avg("b")).first()[0]
        out.append((rep, method, gen, float(mean), float(het)))
        if gen < rounds:
            own = crossing_round(own, effects, n, method, seed + 100 * (gen + 1), **options)
    start = out[0][3]
    return spark.createDataFrame([(r, k, g, x - start, h) for r, k, g, x, h in out], "rep int, method string, gen int, gain double, het double")
