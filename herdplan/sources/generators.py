"""Synthetic panels, made where they are needed: every value is a function of
seed, candidate and marker, so any partitioning gives the same panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from a hash of the keys."""
    h = F.xxhash64(F.lit(seed), *keys)
    return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *keys: Column) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, *keys))) * F.cos(2 * F.pi() * uniform(seed + 1, *keys))


def _grid(spark: SparkSession, n: int, m: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("candidate_id"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("marker_id"))


def panel(spark: SparkSession, n: int, m: int, seed: int = 1) -> DataFrame:
    """Long (candidate_id, marker_id, p, dosage): p ~ U(0.05, 0.5) by marker,
    dosage ~ Bin(2, p)."""
    p = 0.05 + 0.45 * uniform(seed, F.col("marker_id"))
    allele = lambda k: (uniform(seed + k, F.col("candidate_id"), F.col("marker_id")) < F.col("p")).cast("int")
    return _grid(spark, n, m).withColumn("p", p).withColumn("dosage", allele(10) + allele(11))


def like(candidates: DataFrame, markers: DataFrame, seed: int = 1) -> DataFrame:
    """Long (candidate_id, marker_id, p, dosage ~ Bin(2, p)) for given candidates and
    the frequencies of given markers, each call from the ids alone."""
    allele = lambda k: (uniform(seed + k, F.col("candidate_id"), F.col("marker_id")) < F.col("p")).cast("int")
    return candidates.crossJoin(markers.select("marker_id", "p")).withColumn("dosage", allele(10) + allele(11))


def gene_drop(pedigree: DataFrame, founders: DataFrame, seed: int = 1) -> DataFrame:
    """Long (generation, candidate_id, marker_id, dosage, sire, dam): calls of the
    founders (those without a sire and a dam, 0) passed down a given pedigree, a
    generation a round; each parent passes one of its alleles at every locus.
    Candidates that no founder with calls is above get none."""
    zero = F.lit(0)
    roots = pedigree.where((F.col("sire") == 0) & (F.col("dam") == 0)).select("candidate_id", "sire", "dam")
    d = F.col("dosage")
    known = cut(founders.join(roots, "candidate_id").select("candidate_id", "marker_id", (d >= 1).cast("int").alias("a"), (d == 2).cast("int").alias("b"), "sire", "dam", zero.alias("generation")))
    left, out, g = cut(pedigree.where((F.col("sire") != 0) & (F.col("dam") != 0)).select("candidate_id", "sire", "dam")), known, 0
    while not left.isEmpty():
        g += 1
        own = out.select("candidate_id").distinct()
        ready = cut(left.join(own.withColumnRenamed("candidate_id", "sire"), "sire", "left_semi").join(own.withColumnRenamed("candidate_id", "dam"), "dam", "left_semi"))
        if ready.isEmpty():
            break
        of = lambda who: out.select(F.col("candidate_id").alias(who), "marker_id", F.col("a").alias(f"{who}_a"), F.col("b").alias(f"{who}_b"))  # noqa: E731, B023
        toss = lambda k: uniform(seed + k, F.col("candidate_id"), F.col("marker_id")) < 0.5
        passed = lambda who, k: F.when(toss(k), F.col(f"{who}_a")).otherwise(F.col(f"{who}_b"))
        born = ready.join(of("sire"), "sire").join(of("dam"), ["dam", "marker_id"]).select("candidate_id", "marker_id", passed("sire", 300).alias("a"), passed("dam", 400).alias("b"), "sire", "dam", F.lit(g).alias("generation"))
        out = out.unionByName(cut(born))
        left = cut(left.join(ready, "candidate_id", "left_anti"))
    return out.select("generation", "candidate_id", "marker_id", (F.col("a") + F.col("b")).alias("dosage"), "sire", "dam")


def criterion(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(candidate_id, b ~ N(0, 1), male by parity)."""
    return spark.range(n).select(F.col("id").alias("candidate_id"), normal(seed + 20, F.col("id")).alias("b"), (F.col("id") % 2 == 0).alias("male"))


def families(spark: SparkSession, n: int, m: int, seed: int = 1, mutation: float = 0.05) -> DataFrame:
    """Long panel of max(2, n // 20) families: members copy the family's base
    genotype and redraw a share of their calls."""
    count = max(2, n // 20)
    p = 0.05 + 0.45 * uniform(seed, F.col("marker_id"))
    draw = lambda k, who: (uniform(seed + k, who, F.col("marker_id")) < F.col("p")).cast("int")
    family = F.col("candidate_id") % count
    own = F.col("candidate_id")
    redraw = uniform(seed + 30, own, F.col("marker_id")) < mutation
    dosage = F.when(redraw, draw(32, own) + draw(33, own)).otherwise(draw(34, family) + draw(35, family))
    return _grid(spark, n, m).withColumn("p", p).select("candidate_id", "marker_id", "p", dosage.alias("dosage"), family.alias("family"))


def pedigree(spark: SparkSession, founders: int, generations: int, offspring: int, m: int, seed: int = 1) -> DataFrame:
    """Gene dropping: long (generation, candidate_id, marker_id, dosage, sire,
    dam). Parents are drawn at random among each sex (parity) of the generation
    before; each passes one of its alleles at every locus."""
    p = 0.05 + 0.45 * uniform(seed, F.col("marker_id"))
    allele = lambda k: (uniform(seed + k, F.col("candidate_id"), F.col("marker_id")) < p).cast("int")
    now = _grid(spark, founders, m).select("candidate_id", "marker_id", allele(10).alias("a"), allele(11).alias("b"), F.lit(None).cast("long").alias("sire"), F.lit(None).cast("long").alias("dam"))
    out = now.withColumn("generation", F.lit(0))
    first, size = 0, founders
    for g in range(1, generations + 1):
        start = first + size
        child = spark.range(start, start + offspring).select(F.col("id").alias("candidate_id"))
        pick = lambda k, parity: first + 2 * F.floor(uniform(seed + k + g, F.col("candidate_id")) * (size // 2)).cast("long") + parity  # noqa: E731, B023
        child = child.select("candidate_id", pick(100, 0).alias("sire"), pick(200, 1).alias("dam"))
        parent = now.select("candidate_id", "marker_id", "a", "b")
        s = parent.select(F.col("candidate_id").alias("sire"), "marker_id", F.col("a").alias("sa"), F.col("b").alias("sb"))
        d = parent.select(F.col("candidate_id").alias("dam"), "marker_id", F.col("a").alias("da"), F.col("b").alias("db"))
        both = child.join(s, "sire").join(d, ["dam", "marker_id"])
        toss = lambda k: uniform(seed + k + g, F.col("candidate_id"), F.col("marker_id")) < 0.5  # noqa: E731, B023
        now = both.select("candidate_id", "marker_id", F.when(toss(300), F.col("sa")).otherwise(F.col("sb")).alias("a"), F.when(toss(400), F.col("da")).otherwise(F.col("db")).alias("b"), "sire", "dam")
        if spark.sparkContext.getCheckpointDir():
            now = now.checkpoint()
        out = out.unionByName(now.withColumn("generation", F.lit(g)))
        first, size = start, offspring
    return out.select("generation", "candidate_id", "marker_id", (F.col("a") + F.col("b")).alias("dosage"), "sire", "dam")
