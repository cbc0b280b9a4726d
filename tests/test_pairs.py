"""Tables of all pairs: what they shuffle, and what a task holds of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdplan.operators import panel
from herdplan.plans.pricing import packed_relationships, packed_rows

N, M = 6000, 6


@pytest.fixture(scope="module")
def dosages(spark):
    call = F.pmod(F.xxhash64("candidate_id", "marker_id"), F.lit(3)).cast("int")
    return spark.range(N).select(F.col("id").alias("candidate_id"), F.explode(F.sequence(F.lit(0), F.lit(M - 1))).alias("marker_id")).withColumn("dosage", call)


def shuffled(spark, df) -> tuple[int, int]:
    """(bytes written to shuffles, rows) of a run of ``df``."""
    store = lambda: sum(x.shuffleWriteBytes() for x in (at.apply(i) for at in [spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)] for i in range(at.size())))
    before = store()
    rows = df.agg(F.count("*").alias("n"), F.sum("g").alias("g")).first()["n"]
    return store() - before, rows


def test_pair_tables_shuffle_rows_and_no_pairs(spark, dosages):
    markers = panel.allele_frequencies(dosages)
    scale = panel.vanraden_scale(markers)
    of = {"grm": panel.relationship_pairs(panel.centre(dosages, markers), scale), "packed": panel.gram_packed(dosages, markers, scale)}
    p = np.array([r.p for r in markers.orderBy("marker_id").collect()])
    of["missing"] = packed_relationships(packed_rows(dosages), p, scale.first()["s"])
    got = {k: shuffled(spark, v) for k, v in of.items()}
    assert {rows for _, rows in got.values()} == {N * (N + 1) // 2}
    assert all(got[k][0] < most for k, most in (("grm", 1_700_000), ("packed", 1_700_000), ("missing", 1_000_000))), got


@pytest.mark.parametrize("n, block", [(1, None), (37, 5), (1300, None)])
def test_blocks_meet_once(spark, n, block):
    z = np.random.default_rng(n).normal(size=(n, 3))
    long = spark.createDataFrame([(7 * i, j, float(z[i, j])) for i in range(n) for j in range(3)], "candidate_id long, marker_id int, z double")
    r = spark.createDataFrame([(7 * i, float(i)) for i in range(n)], "candidate_id long, r double")
    got = panel.pair_products(long, "z", block, plus=r).toPandas()
    i, j = got.i.to_numpy() // 7, got.j.to_numpy() // 7
    assert len(got) == n * (n + 1) // 2 == len(set(zip(i, j))) and (i <= j).all()
    assert np.allclose(got.v.to_numpy(), (z @ z.T)[i, j] + i + j)
