"""A marker panel derived from ``embeddings``, the same in Spark and in DuckDB.

Vectors become dosages by thresholds, with some calls missing by a rule; b is a
dot product with fixed effects, sex the parity of the id, a cap every third id's.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import panel, plan

#: Common table expressions of the same tables in DuckDB's dialect.
SQL = """
long AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding) AS x FROM embeddings),
d AS (SELECT vec_id AS candidate_id, CAST(j AS INTEGER) AS marker_id,
        CASE WHEN (vec_id * 31 + j * 17) % 97 = 0 THEN NULL WHEN x < -0.05 THEN 0 WHEN x < 0.05 THEN 1 ELSE 2 END AS dosage FROM long),
mk AS (SELECT marker_id, coalesce(avg(dosage) / 2, 0.0) AS p, count(dosage) AS calls FROM d GROUP BY marker_id),
sc AS (SELECT 2 * sum(p * (1 - p)) AS s FROM mk),
z AS (SELECT d.candidate_id, d.marker_id, coalesce(d.dosage - 2 * mk.p, 0.0) AS z FROM d JOIN mk USING (marker_id)),
eff AS (SELECT marker_id, ((marker_id * 7919) % 1009) / 1009.0e0 - 0.5e0 AS w FROM mk),
cand AS (SELECT candidate_id, round(sum(z * w), 9) AS b, candidate_id % 2 = 0 AS male, CASE WHEN candidate_id % 3 = 0 THEN 0.05e0 END AS cap
        FROM z JOIN eff USING (marker_id) GROUP BY candidate_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY male ORDER BY b DESC, candidate_id) AS rank FROM cand),
greedy AS (SELECT candidate_id, 0.5e0 AS c FROM ranked WHERE rank = 1),
ten AS (SELECT candidate_id, 0.1e0 AS c FROM ranked WHERE rank <= 5)
"""

#: A pedigree over the same ids: the first forty are founders, later ones have a
#: sire of odd and a dam of even number below 41; 0 is unknown.
PEDIGREE_SQL = """
ids AS (SELECT vec_id + 1 AS candidate_id FROM embeddings),
ped AS (SELECT candidate_id, CASE WHEN candidate_id > 40 THEN 2 * ((candidate_id * 7) % 20) + 1 ELSE 0 END AS sire,
        CASE WHEN candidate_id > 40 THEN 2 * ((candidate_id * 11) % 20) + 2 ELSE 0 END AS dam FROM ids)
"""


class Panel:
    """The tables of the derived panel as plans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")

    @cached_property
    def dosages(self) -> DataFrame:
        x = F.col("x")
        long = self.embeddings.select(F.col("vec_id").alias("candidate_id"), F.posexplode("embedding").alias("marker_id", "x"))
        missing = (F.col("candidate_id") * 31 + F.col("marker_id") * 17) % 97 == 0
        return long.select("candidate_id", "marker_id", F.when(~missing, F.when(x < -0.05, 0).when(x < 0.05, 1).otherwise(2)).alias("dosage"))

    @cached_property
    def markers(self) -> DataFrame:
        return panel.allele_frequencies(self.dosages)

    @cached_property
    def scale(self) -> DataFrame:
        return panel.vanraden_scale(self.markers)

    @cached_property
    def genotypes(self) -> DataFrame:
        return panel.centre(self.dosages, self.markers)

    @cached_property
    def effects(self) -> DataFrame:
        return self.markers.select("marker_id", (((F.col("marker_id") * 7919) % 1009) / F.lit(1009.0) - 0.5).alias("w"))

    @cached_property
    def candidates(self) -> DataFrame:
        own = panel.genetic_values(self.genotypes, self.effects)
        return own.select("candidate_id", F.round("b", 9).alias("b"), (F.col("candidate_id") % 2 == 0).alias("male"), F.when(F.col("candidate_id") % 3 == 0, 0.05).alias("cap"))

    @cached_property
    def greedy(self) -> DataFrame:
        return plan.greedy_plan(self.candidates)

    @cached_property
    def ten(self) -> DataFrame:
        return plan.best_by_sex(self.candidates, 5).select("candidate_id", F.lit(0.1).alias("c"))

    @cached_property
    def pedigree(self) -> DataFrame:
        own = self.embeddings.select((F.col("vec_id") + 1).alias("candidate_id"))
        parent = lambda k, first: F.when(F.col("candidate_id") > 40, 2 * ((F.col("candidate_id") * k) % 20) + first).otherwise(0)
        return own.select("candidate_id", parent(7, 1).alias("sire"), parent(11, 2).alias("dam"))
