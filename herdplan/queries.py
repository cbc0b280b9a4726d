"""Queries over the operators, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .fixtures import Panel
from .functions import cubic_label, decode_call, footprint_bytes, markers_for, real_roots, recovered_dosage, recoded_sex, rounded
from .operators import panel, plan, report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

R = rounded


def query(sql: str | None = None, tables: str = fixtures.SQL, recursive: bool = False):
    """Registers a function of a Panel; sql follows the panel's expressions."""
    word = "WITH RECURSIVE" if recursive else "WITH"

    def add(f: Callable[[Panel], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Panel(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = f"{word} {tables} {sql}" if sql.lstrip()[:1] != "," else f"{word} {tables}{sql}"
        return f

    return add


# -- markers and genotypes


@query("SELECT marker_id, round(p, 9) AS p, calls FROM mk")
def allele_freq(x: Panel) -> DataFrame:
    return x.markers.select("marker_id", R(F.col("p"), 9).alias("p"), "calls")


@query("SELECT round(s, 6) AS s FROM sc")
def vanraden_scale(x: Panel) -> DataFrame:
    return x.scale.select(R(F.col("s")).alias("s"))


@query("SELECT candidate_id, marker_id, round(z, 9) + 0.0 AS z FROM z")
def center_genotypes(x: Panel) -> DataFrame:
    return x.genotypes.select("candidate_id", "marker_id", R(F.col("z"), 9).alias("z"))


@query("SELECT candidate_id, marker_id, CAST(round(z + 2 * p) AS INTEGER) AS dosage FROM z JOIN mk USING (marker_id) JOIN d USING (candidate_id, marker_id) WHERE d.dosage IS NOT NULL")
def recover_dosage(x: Panel) -> DataFrame:
    known = x.dosages.where(F.col("dosage").isNotNull()).select("candidate_id", "marker_id")
    return x.genotypes.join(x.markers, "marker_id").join(known, ["candidate_id", "marker_id"]).select("candidate_id", "marker_id", recovered_dosage(F.col("z"), F.col("p")).alias("dosage"))


_BYTES = "bytes AS (SELECT p_partkey AS byte_id, p_size * 5 + p_partkey % 6 AS byte FROM part WHERE p_size IS NOT NULL)"


@query("SELECT byte_id, k AS place, CASE CAST(floor(byte / power(4, k)) AS INTEGER) & 3 WHEN 0 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS dosage FROM bytes, (VALUES (0), (1), (2), (3)) v(k)", tables=_BYTES)
def decode_genotype(x: Panel) -> DataFrame:
    part = x.spark.read.parquet(f"{x.sf_dir}/part.parquet").where("p_size is not null").select(F.col("p_partkey").alias("byte_id"), (F.col("p_size") * 5 + F.col("p_partkey") % 6).alias("byte"))
    return part.select("byte_id", "byte", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("place")).select("byte_id", "place", decode_call(F.col("byte").cast("int"), F.col("place")).alias("dosage"))


@query("SELECT round(avg(zz) / max(s), 6) AS mean_diag FROM (SELECT candidate_id, sum(z * z) AS zz FROM z GROUP BY 1), sc")
def mean_diag(x: Panel) -> DataFrame:
    return panel.mean_diagonal(x.genotypes, x.scale).select(R(F.col("mean_diag")).alias("mean_diag"))


@query("""SELECT round(1.05 * tt / s / (n * n), 6) + 0.0 AS k_lo, round(greatest(1.1 * top, 1.5 * (1.05 * tt / s / (n * n))), 6) AS k_hi FROM
 (SELECT sum(t * t) AS tt FROM (SELECT sum(z) AS t FROM z GROUP BY marker_id)), (SELECT max(zz / s) AS top, count(*) AS n FROM (SELECT sum(z * z) AS zz FROM z GROUP BY candidate_id), sc), sc""")
def kinship_range(x: Panel) -> DataFrame:
    return panel.kinship_range(x.genotypes, x.scale).select(R(F.col("k_lo")).alias("k_lo"), R(F.col("k_hi")).alias("k_hi"))


_PAIRS = ", pairs AS (SELECT a.candidate_id AS i, b.candidate_id AS j, sum(a.z * b.z) / max(s) AS g FROM z a JOIN z b ON a.marker_id = b.marker_id AND a.candidate_id <= b.candidate_id, sc GROUP BY 1, 2)"


@query(_PAIRS + " SELECT i, j, round(g, 6) + 0.0 AS g FROM pairs")
def grm_pairs(x: Panel) -> DataFrame:
    return panel.relationship_pairs(x.genotypes, x.scale).select("i", "j", R(F.col("g")).alias("g"))


_TEN_Z = ", zs AS (SELECT z.* FROM z JOIN ten USING (candidate_id)), pairs AS (SELECT a.candidate_id AS i, b.candidate_id AS j, sum(a.z * b.z) / max(s) AS g FROM zs a JOIN zs b ON a.marker_id = b.marker_id AND a.candidate_id <= b.candidate_id, sc GROUP BY 1, 2)"


@query(_TEN_Z + " SELECT i, j, round(g + CASE WHEN i = j THEN 1e-5 ELSE 0 END, 6) + 0.0 AS g FROM pairs")
def gram_support(x: Panel) -> DataFrame:
    own = x.genotypes.join(x.ten.select("candidate_id"), "candidate_id", "left_semi")
    return panel.relationship_pairs(own, x.scale).select("i", "j", R(F.col("g") + F.when(F.col("i") == F.col("j"), 1e-5).otherwise(0.0)).alias("g"))


@query(_TEN_Z + " SELECT round(avg(g), 6) + 0.0 AS mean_kinship, round(max(g), 6) + 0.0 AS max_kinship FROM pairs WHERE i <> j")
def within_set_kinship(x: Panel) -> DataFrame:
    own = x.genotypes.join(x.ten.select("candidate_id"), "candidate_id", "left_semi")
    return panel.relationship_pairs(own, x.scale).where("i <> j").agg(R(F.avg("g")).alias("mean_kinship"), R(F.max("g")).alias("max_kinship"))


@query("SELECT round(avg(CASE WHEN dosage = 1 THEN 1 ELSE 0 END), 6) AS het FROM d WHERE dosage IS NOT NULL")
def heterozygosity(x: Panel) -> DataFrame:
    return panel.heterozygosity(x.dosages).select(R(F.col("het")).alias("het"))


_FULL = ", df AS (SELECT candidate_id, marker_id, coalesce(dosage, 0) AS dosage FROM d), mf AS (SELECT marker_id, avg(dosage) / 2 AS p FROM df GROUP BY 1), r AS (SELECT candidate_id, sum(p * dosage) AS r FROM df JOIN mf USING (marker_id) GROUP BY 1)"


def _full(x: Panel) -> tuple[DataFrame, DataFrame]:
    """The panel without missing calls, and its own frequencies."""
    own = x.dosages.select("candidate_id", "marker_id", F.coalesce("dosage", F.lit(0)).alias("dosage"))
    return own, own.groupBy("marker_id").agg((F.avg("dosage") / 2).alias("p"))


@query(_FULL + " SELECT candidate_id, round(r, 6) + 0.0 AS r FROM r")
def packed_scalars(x: Panel) -> DataFrame:
    return panel.packed_scalars(*_full(x)).select("candidate_id", R(F.col("r")).alias("r"))


@query(_FULL + """ SELECT i, j, round(g, 6) + 0.0 AS g FROM (SELECT a.candidate_id AS i, b.candidate_id AS j, sum((a.dosage - 2 * p) * (b.dosage - 2 * p)) / max(s) AS g
 FROM df a JOIN df b ON a.marker_id = b.marker_id AND a.candidate_id <= b.candidate_id JOIN mf ON mf.marker_id = a.marker_id, (SELECT 2 * sum(p * (1 - p)) AS s FROM mf) GROUP BY 1, 2)""")
def gram_packed(x: Panel) -> DataFrame:
    """The identity of packed products against centred genotypes."""
    own, markers = _full(x)
    return panel.gram_packed(own, markers, panel.vanraden_scale(markers)).select("i", "j", R(F.col("g")).alias("g"))


@query(", best AS (SELECT candidate_id, b, row_number() OVER (ORDER BY b DESC, candidate_id) AS r FROM cand), top AS (SELECT max(candidate_id) AS t FROM cand) SELECT candidate_id, b FROM cand UNION ALL SELECT t + r, b FROM best, top WHERE r <= 5")
def dup_candidates(x: Panel) -> DataFrame:
    return panel.add_clones(x.genotypes, x.candidates)[1].select("candidate_id", "b")


# -- candidates


@query("SELECT candidate_id, b FROM cand")
def genetic_value(x: Panel) -> DataFrame:
    return x.candidates.select("candidate_id", "b")


@query("SELECT candidate_id, b, male, cap, round(sum(z), 6) + 0.0 AS z_sum, count(*) AS m FROM cand JOIN z USING (candidate_id) GROUP BY 1, 2, 3, 4")
def assemble_candidates(x: Panel) -> DataFrame:
    own = x.genotypes.groupBy("candidate_id").agg(R(F.sum("z")).alias("z_sum"), F.count("*").alias("m"))
    return own.join(x.candidates, "candidate_id").select("candidate_id", "b", "male", "cap", "z_sum", "m")


@query("SELECT candidate_id, round((b - m) / sd, 6) + 0.0 AS b FROM cand, (SELECT avg(b) AS m, stddev_pop(b) AS sd FROM cand)")
def standardize_criterion(x: Panel) -> DataFrame:
    return plan.standardised(x.candidates).select("candidate_id", R(F.col("b")).alias("b"))


@query("SELECT candidate_id, round(b - m + 1, 6) AS b FROM cand, (SELECT min(b) AS m FROM cand)")
def shift_criterion(x: Panel) -> DataFrame:
    return plan.shifted(x.candidates).select("candidate_id", R(F.col("b")).alias("b"))


@query("SELECT candidate_id, b, rank FROM (SELECT candidate_id, b, 1 AS rank, row_number() OVER (ORDER BY b DESC, candidate_id) AS k FROM cand) WHERE k = 1")
def seed_simplex(x: Panel) -> DataFrame:
    return plan.best_of(x.candidates).select("candidate_id", "b", F.lit(1).alias("rank"))


@query("SELECT candidate_id, male, b FROM ranked WHERE rank = 1")
def seed_sexed(x: Panel) -> DataFrame:
    return plan.best_by_sex(x.candidates).select("candidate_id", "male", "b")


@query("SELECT candidate_id, male, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 25")
def truncation_select(x: Panel) -> DataFrame:
    return plan.truncation(x.candidates).select("candidate_id", "male", F.col("rank").cast("int").alias("rank"))


_RAW = "raw AS (SELECT c_custkey AS id, c_mktsegment AS seg, c_acctbal AS bal, CASE c_custkey % 7 WHEN 0 THEN ' Male ' WHEN 1 THEN 'F' WHEN 2 THEN '1' WHEN 3 THEN '2' WHEN 4 THEN 'female' WHEN 5 THEN 'm' ELSE 'x' END AS sex FROM customer)"


def _raw(x: Panel) -> DataFrame:
    k = F.col("c_custkey") % 7
    sex = F.when(k == 0, " Male ").when(k == 1, "F").when(k == 2, "1").when(k == 3, "2").when(k == 4, "female").when(k == 5, "m").otherwise("x")
    return x.spark.read.parquet(f"{x.sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"), sex.alias("sex"))


@query("SELECT id, CASE WHEN lower(trim(sex)) IN ('m', 'male', '1') THEN TRUE WHEN lower(trim(sex)) IN ('f', 'female', '2') THEN FALSE END AS male FROM raw", tables=_RAW)
def recode_sex(x: Panel) -> DataFrame:
    return _raw(x).select("id", recoded_sex(F.col("sex"), "null").alias("male"))


@query("SELECT id, bal AS b FROM raw WHERE bal >= 0 AND bal IS NOT NULL", tables=_RAW)
def drop_null_criterion(x: Panel) -> DataFrame:
    """A negative balance stands for a missing phenotype here."""
    return _raw(x).select("id", F.when(F.col("bal") >= 0, F.col("bal")).alias("b")).na.drop(subset=["b"])


@query("SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE bal END AS b FROM raw", tables=_RAW)
def scan_text_null(x: Panel) -> DataFrame:
    """A '.' in delimited text reads as null: through the text source's parser."""
    text = _raw(x).select(F.concat_ws(",", F.col("id").cast("string"), F.when(F.col("id") % 11 == 0, ".").otherwise(F.format_string("%.17g", F.col("bal")))).alias("line"))
    parsed = text.select(F.from_csv("line", F.lit("id bigint, b double"), {"nullValue": "."}).alias("r"))
    return parsed.select("r.id", "r.b")


@query("SELECT o_orderkey AS id, c_acctbal AS ebv FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 = 0")
def lookup_ebv(x: Panel) -> DataFrame:
    read = lambda t: x.spark.read.parquet(f"{x.sf_dir}/{t}.parquet")
    ebv = read("customer").where("c_custkey % 3 = 0").select("c_custkey", F.col("c_acctbal").alias("ebv"))
    return read("orders").join(ebv, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("id"), "ebv")


@query("SELECT candidate_id, CASE WHEN candidate_id IN (SELECT sire FROM ped) THEN TRUE WHEN candidate_id IN (SELECT dam FROM ped) THEN FALSE END AS male FROM ids", tables=fixtures.PEDIGREE_SQL)
def sex_from_pedigree(x: Panel) -> DataFrame:
    return plan.sex_from_pedigree(x.pedigree.select("candidate_id"), x.pedigree)


@query("SELECT count(*) AS both FROM (SELECT sire FROM ped WHERE sire <> 0 INTERSECT SELECT dam FROM ped WHERE dam <> 0)", tables=fixtures.PEDIGREE_SQL)
def sire_dam_disjoint(x: Panel) -> DataFrame:
    return plan.sires_and_dams(x.pedigree).agg(F.count("*").alias("both"))


@query("SELECT DISTINCT sire FROM ped WHERE sire <> 0", tables=fixtures.PEDIGREE_SQL)
def distinct_sires(x: Panel) -> DataFrame:
    return x.pedigree.where("sire <> 0").select("sire").distinct()


@query("SELECT count(*) AS unmatched, count(*) = 0 AS aligned FROM cand a FULL JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 50 <> 7) e ON a.candidate_id = e.vec_id WHERE a.candidate_id IS NULL OR e.vec_id IS NULL")
def check_alignment(x: Panel) -> DataFrame:
    other = x.embeddings.where("vec_id % 50 <> 7").select(F.col("vec_id").alias("candidate_id"))
    return plan.check_alignment(x.candidates, other)


# -- plans

_T = ", t AS (SELECT marker_id, sum(c * z) AS t FROM z JOIN ten USING (candidate_id) GROUP BY 1), gc AS (SELECT candidate_id, sum(z * t) / max(s) AS g0 FROM z JOIN t USING (marker_id), sc GROUP BY 1), gcr AS (SELECT gc.candidate_id, g0 + 1e-5 * coalesce(c, 0) AS gc FROM gc LEFT JOIN ten USING (candidate_id))"
_COST = _T + ", cost AS (SELECT candidate_id, b - CASE WHEN male THEN 1.0e0 ELSE 0.5e0 END - 2 * 1.5e0 * gc AS r, male, b, gc FROM cand JOIN gcr USING (candidate_id))"


@query(_T + " SELECT marker_id, round(t, 6) + 0.0 AS t FROM t")
def matvec_zt(x: Panel) -> DataFrame:
    return plan.marker_totals(x.genotypes, x.ten).select("marker_id", R(F.col("t")).alias("t"))


def _product(x: Panel) -> DataFrame:
    return plan.kinship_product(x.genotypes, x.ten, x.scale, 1e-5)


@query(_T + " SELECT candidate_id, round(gc, 6) + 0.0 AS gc FROM gcr")
def matvec_g(x: Panel) -> DataFrame:
    return _product(x).select("candidate_id", R(F.col("gc")).alias("gc"))


@query("SELECT round(sum(b * c), 6) + 0.0 AS gain FROM cand JOIN ten USING (candidate_id)")
def plan_gain(x: Panel) -> DataFrame:
    return plan.gain(x.ten, x.candidates).select(R(F.col("gain")).alias("gain"))


@query(_T + " SELECT round(sum(t * t) / max(s), 6) + 0.0 AS quad FROM t, sc")
def quad_form_z(x: Panel) -> DataFrame:
    return plan.coancestry(x.genotypes, x.ten, x.scale).select(R(F.col("quad")).alias("quad"))


@query(_TEN_Z + " SELECT round(sum(CASE WHEN i = j THEN 1 ELSE 2 END * 0.01e0 * (g + CASE WHEN i = j THEN 1e-3 ELSE 0 END)) - 1e-3 * 0.1, 6) + 0.0 AS quad FROM pairs")
def quad_form_g(x: Panel) -> DataFrame:
    own = x.genotypes.join(x.ten.select("candidate_id"), "candidate_id", "left_semi")
    return plan.coancestry_by_pairs(panel.relationship_pairs(own, x.scale), x.ten, 1e-3).select(R(F.col("quad")).alias("quad"))


@query(_T + ", q AS (SELECT sum(t * t) / max(s) AS quad FROM t, sc) SELECT round(abs(sum(c) - 1), 6) AS sum_err, min(c) AS min_c, round(max(quad), 6) + 0.0 AS quad, abs(sum(c) - 1) <= 1e-6 AND min(c) >= -1e-6 AND max(quad) <= 0.5 + 1e-6 AS ok FROM ten, q")
def feasibility(x: Panel) -> DataFrame:
    quad = plan.coancestry(x.genotypes, x.ten, x.scale)
    return plan.feasibility(x.ten, quad, 0.5).select(R(F.col("sum_err")).alias("sum_err"), "min_c", R(F.col("quad")).alias("quad"), "ok")


@query("SELECT round(1 / sum(c * c), 6) AS ne, round(50 * sum(c * c), 6) AS delta_f_pct FROM ten")
def ne_delta_f(x: Panel) -> DataFrame:
    return plan.effective_size(x.ten).select(R(F.col("ne")).alias("ne"), R(F.col("delta_f_pct")).alias("delta_f_pct"))


@query("SELECT male, round(sum(c), 6) AS total, count(*) FILTER (WHERE c > 1e-6) AS support FROM ten JOIN cand USING (candidate_id) GROUP BY 1")
def support_by_sex(x: Panel) -> DataFrame:
    return plan.by_sex(x.ten, x.candidates).select("male", R(F.col("total")).alias("total"), "support")


@query("SELECT candidate_id, c FROM (SELECT candidate_id, CASE WHEN rank <= 3 THEN 0.1e0 ELSE 0e0 END AS c FROM ranked WHERE rank <= 5) WHERE c > 1e-6")
def support_filter(x: Panel) -> DataFrame:
    own = plan.best_by_sex(x.candidates, 5).select("candidate_id", F.when(F.col("rank") <= 3, 0.1).otherwise(0.0).alias("c"))
    return plan.support(own)


@query("SELECT candidate_id, round(0.5e0 / count(*) OVER (PARTITION BY male), 9) AS c FROM cand")
def uniform_plan(x: Panel) -> DataFrame:
    return plan.uniform_plan(x.candidates).select("candidate_id", R(F.col("c"), 9).alias("c"))


@query(", t AS (SELECT marker_id, sum(c * z) AS t FROM z JOIN greedy USING (candidate_id) GROUP BY 1) SELECT round((SELECT sum(b * c) FROM cand JOIN greedy USING (candidate_id)), 6) + 0.0 AS gain, round(sum(t * t) / max(s), 6) + 0.0 AS quad, 2.0e0 AS ne FROM t, sc")
def greedy_plan(x: Panel) -> DataFrame:
    return plan.score_plan(x.greedy, x.candidates, x.genotypes, x.scale).crossJoin(plan.effective_size(x.greedy)).select(R(F.col("gain")).alias("gain"), R(F.col("quad")).alias("quad"), R(F.col("ne")).alias("ne"))


@query(_T + " SELECT round((SELECT sum(b * c) FROM cand JOIN ten USING (candidate_id)), 6) + 0.0 AS gain, round(sum(t * t) / max(s), 6) + 0.0 AS quad FROM t, sc")
def score_plan(x: Panel) -> DataFrame:
    return plan.score_plan(x.ten, x.candidates, x.genotypes, x.scale).select(R(F.col("gain")).alias("gain"), R(F.col("quad")).alias("quad"))


def _costs(x: Panel) -> DataFrame:
    return plan.reduced_costs(x.candidates, _product(x), 1.0, 0.5, 1.5)


@query(_COST + " SELECT candidate_id, round(r, 6) AS r FROM cost WHERE candidate_id NOT IN (SELECT candidate_id FROM ten) AND r > 1e-9 ORDER BY r DESC, candidate_id LIMIT 1")
def price_candidates(x: Panel) -> DataFrame:
    return plan.price(_costs(x), x.ten).select("candidate_id", R(F.col("r")).alias("r"))


@query(_COST + ", up AS (SELECT candidate_id FROM ranked WHERE rank <= 2), v AS (SELECT cost.candidate_id, CASE WHEN up.candidate_id IS NOT NULL THEN -r ELSE r END AS violation FROM cost LEFT JOIN up USING (candidate_id) WHERE cost.candidate_id NOT IN (SELECT candidate_id FROM ranked WHERE rank BETWEEN 3 AND 5)) SELECT candidate_id, round(violation, 6) AS violation FROM v WHERE violation > 1e-9 ORDER BY violation DESC, candidate_id LIMIT 1")
def price_capped(x: Panel) -> DataFrame:
    upper = plan.best_by_sex(x.candidates, 2).select("candidate_id")
    return plan.price_capped(_costs(x), upper, x.ten).select("candidate_id", R(F.col("violation")).alias("violation"))


@query(_T + " SELECT candidate_id, round(gc, 6) + 0.0 AS gc FROM gcr WHERE candidate_id NOT IN (SELECT candidate_id FROM ten) ORDER BY gcr.gc, candidate_id LIMIT 1")
def diversify(x: Panel) -> DataFrame:
    return plan.least_related(_product(x), x.ten).select("candidate_id", R(F.col("gc")).alias("gc"))


@query(_T + " SELECT candidate_id, round(gc, 6) + 0.0 AS gc FROM gcr WHERE candidate_id NOT IN (SELECT candidate_id FROM ten) ORDER BY gcr.gc, candidate_id LIMIT 10")
def diversify_chunk(x: Panel) -> DataFrame:
    return plan.least_related(_product(x), x.ten, 10).select("candidate_id", R(F.col("gc")).alias("gc"))


@query(", t AS (SELECT marker_id, sum(b * z) AS t FROM z JOIN cand USING (candidate_id) GROUP BY 1) SELECT round(sum(t * t) / max(s) / (SELECT sum(b * b) FROM cand), 5) AS rayleigh FROM t, sc")
def rayleigh(x: Panel) -> DataFrame:
    by_b = x.candidates.select("candidate_id", F.col("b").alias("c"))
    return plan.coancestry(x.genotypes, by_b, x.scale).crossJoin(x.candidates.agg(F.sum(F.col("b") * F.col("b")).alias("bb"))).select(R(F.col("quad") / F.col("bb"), 5).alias("rayleigh"))


@query(""", t AS (SELECT marker_id, sum(c * z) AS t FROM z JOIN greedy USING (candidate_id) GROUP BY 1), q AS (SELECT sum(t * t) / max(s) AS kg FROM t, sc), m AS (SELECT avg(zz) / max(s) AS md FROM (SELECT sum(z * z) AS zz FROM z GROUP BY candidate_id), sc)
 SELECT round(0.6 * md, 6) AS k_diag, round(0.12 * kg, 6) AS k_greedy_12, round(0.15 * kg, 6) AS k_greedy_15, round(0.25 * (md - 0.0), 6) AS k_between FROM q, m""")
def cap_rules(x: Panel) -> DataFrame:
    kg = plan.coancestry(x.genotypes, x.greedy, x.scale).select(F.col("quad").alias("kg"))
    row = kg.crossJoin(panel.mean_diagonal(x.genotypes, x.scale))
    return row.select(R(0.6 * F.col("mean_diag")).alias("k_diag"), R(0.12 * F.col("kg")).alias("k_greedy_12"), R(0.15 * F.col("kg")).alias("k_greedy_15"), R(0.25 * F.col("mean_diag")).alias("k_between"))


@query("SELECT candidate_id, round(2 * (0.01e0 * (candidate_id % 10 + 1)), 9) AS k, 2e-5 AS ridge, round(0.01e0 * (candidate_id % 10 + 1), 9) AS ub FROM cand")
def unit_convert(x: Panel) -> DataFrame:
    """Caps on half relationships as caps here, and back."""
    ub = 0.01 * (F.col("candidate_id") % 10 + 1)
    return x.candidates.select("candidate_id", R(2 * ub, 9).alias("k"), F.lit(2e-5).alias("ridge"), R(ub, 9).alias("ub"))


# -- reports

#: Runs of growing size: order lines by the power of two below their quantity.
_POINTS = """pts AS (SELECT CAST(count(*) AS INTEGER) AS n, sum(l_quantity) / 1000 AS seconds, max(l_tax) * 1e-4 AS ridge, sum(l_extendedprice) / 1e6 AS rss_mb, min(l_discount) >= 0 AS solved, max(l_discount) <= 0.1 + 1e-9 AS feasible
 FROM lineitem GROUP BY floor(log2(l_quantity + 0.5))),
 front AS (SELECT l_discount AS k, round(avg(l_quantity), 9) AS gain FROM lineitem GROUP BY 1),
 fall AS (SELECT greatest(coalesce(lag(gain) OVER (ORDER BY k) - gain, 0), 0) AS fall FROM front),
 two AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY n DESC, seconds DESC) AS r FROM pts WHERE solved) WHERE r <= 2),
 growth AS (SELECT CASE WHEN max(n) <> min(n) THEN ln(max(CASE WHEN r = 1 THEN seconds END) / max(CASE WHEN r = 2 THEN seconds END)) / ln(max(n) / min(n)) END AS e FROM two)"""
_LABEL = "CASE WHEN e IS NULL THEN 'undefined' WHEN e < 2.85 THEN 'sub-cubic' WHEN e <= 3.15 THEN 'essentially cubic' WHEN e <= 3.6 THEN 'marginally super-cubic' ELSE 'super-cubic' END"


def _points(x: Panel) -> DataFrame:
    lines = x.spark.read.parquet(f"{x.sf_dir}/lineitem.parquet")
    return lines.groupBy(F.floor(F.log2(F.col("l_quantity") + 0.5)).alias("power")).agg(
        F.count("*").cast("int").alias("n"), (F.sum("l_quantity") / 1000).alias("seconds"), (F.max("l_tax") * 1e-4).alias("ridge"), (F.sum("l_extendedprice") / 1e6).alias("rss_mb"),
        (F.min("l_discount") >= 0).alias("solved"), (F.max("l_discount") <= 0.1 + 1e-9).alias("feasible"),
    ).drop("power")


def _front(x: Panel) -> DataFrame:
    lines = x.spark.read.parquet(f"{x.sf_dir}/lineitem.parquet")
    return lines.groupBy(F.col("l_discount").alias("k")).agg(R(F.avg("l_quantity"), 9).alias("gain"))


@query("SELECT round(max(fall), 6) AS worst, max(fall) <= 1e-9 AS monotone FROM fall", tables=_POINTS)
def frontier_check(x: Panel) -> DataFrame:
    return report.frontier_check(_front(x)).select(R(F.col("worst")).alias("worst"), "monotone")


@query(f"SELECT round(e, 6) AS exponent, {_LABEL} AS label FROM growth", tables=_POINTS)
def growth_exponent(x: Panel) -> DataFrame:
    return report.growth_exponent(_points(x)).select(R(F.col("exponent")).alias("exponent"), "label")


@query("SELECT bool_and(solved) AS all_solved, bool_and(feasible) AS all_feasible, round(max(ridge), 12) AS max_ridge, max(CASE WHEN solved THEN n END) AS max_n, round(max(rss_mb), 6) AS max_rss_mb FROM pts", tables=_POINTS)
def verdict_criteria(x: Panel) -> DataFrame:
    return report.verdict(_points(x), _front(x)).select("all_solved", "all_feasible", F.round("max_ridge", 12).alias("max_ridge"), "max_n", R(F.col("max_rss_mb")).alias("max_rss_mb"))


@query(
    """SELECT CASE WHEN a.s AND a.f AND m.mono AND a.ridge <= 1e-3 AND a.n >= 10000 AND a.rss <= 32768 AND coalesce(e <= 3.5, TRUE) THEN 'GO' ELSE 'NO-GO' END AS verdict, m.mono AS monotone
 FROM (SELECT bool_and(solved) AS s, bool_and(feasible) AS f, max(ridge) AS ridge, max(CASE WHEN solved THEN n END) AS n, max(rss_mb) AS rss FROM pts) a, (SELECT max(fall) <= 1e-9 AS mono FROM fall) m, growth""",
    tables=_POINTS,
)
def verdict(x: Panel) -> DataFrame:
    """GO where every criterion holds for the runs and the frontier of the tables."""
    return report.verdict(_points(x), _front(x)).select("verdict", "monotone")


@query(f"SELECT n, {_LABEL} AS label FROM (SELECT n, ln(seconds / lag(seconds) OVER (ORDER BY n, seconds)) / nullif(ln(n / lag(n) OVER (ORDER BY n, seconds)), 0) AS e FROM pts)", tables=_POINTS)
def growth_label(x: Panel) -> DataFrame:
    from pyspark.sql import Window

    w = Window.orderBy("n", "seconds")
    step = F.ln(F.col("n") / F.lag("n").over(w))
    e = F.ln(F.col("seconds") / F.lag("seconds").over(w)) / F.when(step != 0, step)
    return _points(x).select("n", cubic_label(e).alias("label"))


@query("SELECT n, greatest(20000, 2 * n) AS m FROM pts", tables=_POINTS)
def markers_rule(x: Panel) -> DataFrame:
    return _points(x).select("n", markers_for(F.col("n")).alias("m"))


@query("SELECT n, CAST(8 AS BIGINT) * n * 1000 AS dense_z, CAST(1000 * ceil(n / 4.0) AS BIGINT) AS packed_z, CAST(8 AS BIGINT) * n * n AS dense_g FROM pts", tables=_POINTS)
def footprint(x: Panel) -> DataFrame:
    cols = footprint_bytes(F.col("n").cast("long"), F.lit(1000).cast("long"))
    return _points(x).select("n", *[v.cast("long").alias(k) for k, v in cols.items()])


@query("SELECT round(regr_slope(ln(seconds), ln(n)), 6) AS slope, round(regr_intercept(ln(seconds), ln(n)), 6) AS intercept, round(regr_r2(ln(seconds), ln(n)), 6) AS r2 FROM pts", tables=_POINTS)
def power_law_fit(x: Panel) -> DataFrame:
    return report.power_law(_points(x), "n", "seconds").select(*[R(F.col(c)).alias(c) for c in ("slope", "intercept", "r2")])


_LINES = "l AS (SELECT * FROM lineitem)"


@query("SELECT l_returnflag AS method, l_linenumber AS gen, round(avg(l_quantity), 6) AS gain, round(avg(l_discount), 6) AS het FROM l GROUP BY 1, 2", tables=_LINES)
def trajectory_mean(x: Panel) -> DataFrame:
    lines = x.spark.read.parquet(f"{x.sf_dir}/lineitem.parquet")
    return lines.groupBy(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("gen")).agg(R(F.avg("l_quantity")).alias("gain"), R(F.avg("l_discount")).alias("het"))


@query("SELECT l_linestatus AS name, round(median(l_extendedprice), 4) AS median, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM l GROUP BY 1", tables=_LINES)
def timing_summary(x: Panel) -> DataFrame:
    lines = x.spark.read.parquet(f"{x.sf_dir}/lineitem.parquet")
    return report.timings(lines, "l_linestatus", "l_extendedprice").select(F.col("l_linestatus").alias("name"), R(F.col("median"), 4).alias("median"), "least", "most")


@query("SELECT round(corr(b, v), 6) AS r FROM cand JOIN (SELECT candidate_id, sum(z * z) AS v FROM z GROUP BY 1) USING (candidate_id)")
def criterion_corr(x: Panel) -> DataFrame:
    v = x.genotypes.groupBy("candidate_id").agg(F.sum(F.col("z") * F.col("z")).alias("v"))
    return x.candidates.join(v, "candidate_id").agg(R(F.corr("b", "v")).alias("r"))


@query("SELECT round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0e0 AS rx, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0e0 AS ry FROM l)", tables=_LINES)
def spearman(x: Panel) -> DataFrame:
    lines = x.spark.read.parquet(f"{x.sf_dir}/lineitem.parquet")
    return report.spearman(lines, "l_quantity", "l_discount").select(R(F.col("rho")).alias("rho"))


@query("""SELECT p_partkey AS id, CASE WHEN abs(a) <= tiny THEN CASE WHEN abs(b) > tiny THEN [round(-c / b, 6)] ELSE [] END WHEN b * b - 4 * a * c < 0 THEN []
 ELSE list_sort([round((-b - sqrt(b * b - 4 * a * c)) / (2 * a), 6), round((-b + sqrt(b * b - 4 * a * c)) / (2 * a), 6)]) END::VARCHAR AS roots FROM (SELECT *, 1e-14 * greatest(1.0, abs(a) + abs(b) + abs(c)) AS tiny FROM co)""".replace("SELECT p_partkey AS id, CASE", "SELECT id, len(CASE").replace("END::VARCHAR AS roots", "END) AS n_roots"), tables="co AS (SELECT p_partkey AS id, CAST(p_partkey % 4 AS DOUBLE) AS a, CAST(p_size - 20 AS DOUBLE) AS b, CAST(p_partkey % 9 - 3 AS DOUBLE) AS c FROM part)")
def quadratic_roots(x: Panel) -> DataFrame:
    part = x.spark.read.parquet(f"{x.sf_dir}/part.parquet")
    a, b, c = (F.col("p_partkey") % 4).cast("double"), (F.col("p_size") - 20).cast("double"), (F.col("p_partkey") % 9 - 3).cast("double")
    return part.select(F.col("p_partkey").alias("id"), F.size(real_roots(a, b, c)).cast("long").alias("n_roots"))


# -- solvers

def _rows(x: Panel, cap: bool = False) -> DataFrame:
    wide = panel.widen(x.genotypes)
    return wide.join(x.candidates, "candidate_id").select("candidate_id", "z", "b", "male", F.lit(0.05).alias("cap") if cap else F.lit(None).cast("double").alias("cap"))


@contextmanager
def rows_of(x: Panel, cap: bool = False):
    """(rows, scale): the panel's rows, made once and held while they are used."""
    rows = _rows(x, cap).persist()
    try:
        yield rows, x.scale.first()["s"]
    finally:
        rows.unpersist()


@query(", g AS (SELECT a.marker_id AS i, b.marker_id AS j, sum(a.z * b.z) / max(s) AS g FROM z a JOIN z b ON a.candidate_id = b.candidate_id, sc GROUP BY 1, 2) SELECT round(sum(CASE WHEN i = j THEN g END) * sum(CASE WHEN i = j THEN g END) / sum(g * g), 5) AS participation FROM g")
def spectrum_participation(x: Panel) -> DataFrame:
    """trace(G)^2 / |G|^2 from the Gram of markers: no eigenvalue is needed."""
    a = x.genotypes.select("candidate_id", F.col("marker_id").alias("i"), F.col("z").alias("zi"))
    b = x.genotypes.select("candidate_id", F.col("marker_id").alias("j"), F.col("z").alias("zj"))
    gram = a.join(b, "candidate_id").groupBy("i", "j").agg(F.sum(F.col("zi") * F.col("zj")).alias("g"))
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("g")))
    return gram.agg(R(trace * trace / F.sum(F.col("g") * F.col("g")), 5).alias("participation"))


@query(""" SELECT id, CASE WHEN abs(a) <= tiny THEN CASE WHEN abs(b) > tiny THEN round(-c / b, 6) + 0.0 END WHEN d >= 0 THEN round(least((-b - sqrt(greatest(d, 0))) / (2 * a), (-b + sqrt(greatest(d, 0))) / (2 * a)), 6) + 0.0 END AS low,
 CASE WHEN abs(a) <= tiny THEN CASE WHEN abs(b) > tiny THEN round(-c / b, 6) + 0.0 END WHEN d >= 0 THEN round(greatest((-b - sqrt(greatest(d, 0))) / (2 * a), (-b + sqrt(greatest(d, 0))) / (2 * a)), 6) + 0.0 END AS high
 FROM (SELECT *, b * b - 4 * a * c AS d, 1e-14 * greatest(1.0, abs(a) + abs(b) + abs(c)) AS tiny FROM co)""", tables="co AS (SELECT p_partkey AS id, CAST(p_partkey % 4 AS DOUBLE) AS a, CAST(p_size - 20 AS DOUBLE) AS b, CAST(p_partkey % 9 - 3 AS DOUBLE) AS c FROM part)")
def quadratic_root_values(x: Panel) -> DataFrame:
    part = x.spark.read.parquet(f"{x.sf_dir}/part.parquet")
    a, b, c = (F.col("p_partkey") % 4).cast("double"), (F.col("p_size") - 20).cast("double"), (F.col("p_partkey") % 9 - 3).cast("double")
    roots = part.select(F.col("p_partkey").alias("id"), real_roots(a, b, c).alias("r"))
    return roots.select("id", R(F.get("r", F.lit(0))).alias("low"), R(F.get("r", F.size("r") - 1)).alias("high"))


@query(""", u AS (SELECT sum(t * t) / max(s) AS tt FROM (SELECT sum(z) AS t FROM z GROUP BY marker_id), sc), dg AS (SELECT avg(zz) / max(s) + 1e-5 AS md, count(*) AS n FROM (SELECT sum(z * z) AS zz FROM z GROUP BY candidate_id), sc)
 SELECT round(tt / (n * n) + 1e-5 / n + 0.3 * (md - tt / (n * n) - 1e-5 / n), 6) AS k_between, round(1.04 * tt / (n * n) / 2, 9) + 0.0 AS k_tight FROM u, dg""")
def cap_rules_from_least(x: Panel) -> DataFrame:
    """Caps from the uniform plan's coancestry: a share of the way up to the mean
    self-relationship, and a little above the mean coancestry."""
    return panel.caps_from_least(x.genotypes, x.scale, 0.3, 1e-5).select(R(F.col("k_between")).alias("k_between"), R(F.col("k_tight"), 9).alias("k_tight"))


def _closed_form_sql(members: list[tuple[int, str, float]]) -> str:
    """The optimum on a line: role 1 gains what role 2 gives; others stand."""
    who = " UNION ALL ".join(f"SELECT {role} AS role, {weight}e0 AS w, candidate_id FROM o WHERE {where}" for role, where, weight in members)
    return f""", o AS (SELECT *, row_number() OVER (ORDER BY b DESC, candidate_id) AS r FROM ranked), who AS ({who}),
 g AS (SELECT p.role AS i, q.role AS j, max(p.w) AS wi, max(q.w) AS wj, sum(zp.z * zq.z) / max(s) + CASE WHEN p.role = q.role THEN 1e-5 ELSE 0 END AS g FROM who p, who q, z zp, z zq, sc WHERE zp.candidate_id = p.candidate_id AND zq.candidate_id = q.candidate_id AND zp.marker_id = zq.marker_id GROUP BY p.role, q.role),
 co AS (SELECT sum(CASE WHEN i = 1 AND j = 1 OR i = 2 AND j = 2 THEN g WHEN i + j = 3 THEN -g ELSE 0 END) AS a, 2 * sum(CASE WHEN i = 1 THEN wj * g WHEN i = 2 THEN -wj * g ELSE 0 END) AS b, sum(wi * wj * g) AS c, max(CASE WHEN i = 2 THEN wi END) AS top FROM g),
 x AS (SELECT top, (-b + sqrt(b * b - 4 * a * (c - (c - b * b / (4 * a) + greatest(c, a * top * top + b * top + c)) / 2))) / (2 * a) AS x FROM co)
 SELECT candidate_id, round(CASE role WHEN 1 THEN x WHEN 2 THEN top - x ELSE w END, 6) + 0.0 AS c FROM who, x"""


def _closed_form(x: Panel, free: list[tuple[bool | None, int]], upper: list[tuple[bool | None, int, float]]) -> DataFrame:
    """The closed form on given free candidates (sex and rank, the sex null for
    the rank in all), others at their caps, at a cap halfway up the line."""
    import numpy as np
    from pyspark.sql import Window

    from .plans.master import closed_form

    wanted = [(m, k) for m, k in free] + [(m, k) for m, k, _ in upper]
    most = max(k for _, k in wanted)
    if free[0][0] is None:
        named = plan.best_of(x.candidates, most).withColumn("r", F.row_number().over(Window.orderBy(F.desc("b"), "candidate_id")))
    else:
        named = plan.best_by_sex(x.candidates, most)
    pick = lambda m, k: (F.col("r") == k) if m is None else (F.col("male") == m) & (F.col("rank") == k)
    role = F.lit(None).cast("int")
    for n, w in enumerate(wanted):
        role = F.when(pick(*w), n).otherwise(role)
    few = named.withColumn("role", role).where("role is not null")
    got = panel.widen(x.genotypes.join(F.broadcast(few.select("candidate_id")), "candidate_id")).join(few, "candidate_id").orderBy("role").toArrow()
    z, b, s = np.array(got.column("z").to_pylist()), got.column("b").to_numpy(), x.scale.first()["s"]
    g = z @ z.T / s + 1e-5 * np.eye(len(z))
    n, at = len(free), np.array([w for _, _, w in upper])
    sexed = free[0][0] is not None
    a = np.array([[float(m is not False) for m, _ in free], [float(m is False) for m, _ in free]]) if sexed else np.ones((1, n))
    d = (np.array([0.5, 0.5]) if sexed else np.ones(1)) - np.array([at.sum(), 0.0])[: 1 + sexed]
    low = np.zeros(n + len(at))
    low[n:] = at
    low[1], low[2:n] = d[0], 0.5
    high = low.copy()
    high[0], high[1] = d[0], 0.0
    step = np.zeros(len(low))
    step[:2] = 1, -1
    a2, b2, c2 = step @ g @ step, 2 * low @ g @ step, low @ g @ low
    k = (c2 - b2 * b2 / (4 * a2) + max(c2, float(high @ g @ high))) / 2
    point = closed_form(g[:n, :n], b[:n], a, d, k, g[:n, n:] @ at, float(at @ g[n:, n:] @ at))
    rows = list(zip(got.column("candidate_id").to_pylist(), [round(float(v), 6) + 0.0 for v in [*point.c, *at]]))
    return x.spark.createDataFrame(rows, "candidate_id long, c double")


@query(_closed_form_sql([(1, "r = 1", 0.0), (2, "r = 2", 1.0)]))
def closed_form_simplex(x: Panel) -> DataFrame:
    return _closed_form(x, [(None, 1), (None, 2)], [])


@query(_closed_form_sql([(1, "r = 1", 0.0), (2, "r = 2", 0.95), (3, "r = 3", 0.05)]))
def closed_form_capped(x: Panel) -> DataFrame:
    return _closed_form(x, [(None, 1), (None, 2)], [(None, 3, 0.05)])


@query(_closed_form_sql([(1, "male AND rank = 1", 0.0), (2, "male AND rank = 2", 0.5), (3, "NOT male AND rank = 1", 0.5)]))
def closed_form_sexed(x: Panel) -> DataFrame:
    return _closed_form(x, [(True, 1), (True, 2), (False, 1)], [])


@query(_closed_form_sql([(1, "male AND rank = 1", 0.0), (2, "male AND rank = 2", 0.45), (3, "NOT male AND rank = 1", 0.5), (4, "male AND rank = 3", 0.05)]))
def closed_form_sexed_capped(x: Panel) -> DataFrame:
    return _closed_form(x, [(True, 1), (True, 2), (False, 1)], [(True, 3, 0.05)])


# -- sources


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS candidate_id, c_mktsegment AS fid, CAST(c_custkey AS VARCHAR) AS iid FROM customer", tables="one AS (SELECT 1)")
def scan_fam(x: Panel) -> DataFrame:
    """A .fam file of all customers, with blank lines, reads back in its order."""
    from .scratch import put_lines, shared_folder
    from .sources import plink

    line = F.concat(F.concat_ws(" ", "c_mktsegment", "c_custkey"), F.lit("\t0 0 0 -9"), F.when(F.col("c_custkey") % 50 == 0, "\n").otherwise(""))
    path = shared_folder(x.spark) + "/panel.fam"
    put_lines(x.spark.read.parquet(f"{x.sf_dir}/customer.parquet").orderBy("c_custkey").select(line), path)
    return plink.scan_fam(x.spark, path)


@query("SELECT count(*) AS markers FROM part", tables="one AS (SELECT 1)")
def scan_bim(x: Panel) -> DataFrame:
    from .scratch import put_lines, shared_folder
    from .sources import plink

    path = shared_folder(x.spark) + "/panel.bim"
    put_lines(x.spark.read.parquet(f"{x.sf_dir}/part.parquet").orderBy("p_partkey").select(F.concat(F.lit("1\tS"), F.col("p_partkey"), F.lit("\t0\t1\tA\tC"))), path)
    return plink.scan_bim(x.spark, path)


@query(_TEN_Z + ", o AS (SELECT candidate_id, row_number() OVER (ORDER BY candidate_id) - 1 AS k FROM ten) SELECT p.k AS i, q.k AS j, round(g, 6) + 0.0 AS g, b AS bv, male, 0.25e0 AS ub FROM (SELECT i, j, g FROM pairs UNION ALL SELECT j, i, g FROM pairs WHERE i <> j) JOIN o p ON p.candidate_id = i JOIN o q ON q.candidate_id = j JOIN cand ON cand.candidate_id = i")
def scan_bench(x: Panel) -> DataFrame:
    """The exchange trio of ten candidates, written and read back."""
    from pyspark.sql import Window

    from .scratch import shared_folder
    from .sources import tables

    order = x.ten.select("candidate_id", (F.row_number().over(Window.orderBy("candidate_id")) - 1).alias("i"))
    pairs = panel.relationship_pairs(x.genotypes.join(order, "candidate_id").select(F.col("i").cast("long").alias("candidate_id"), "marker_id", "z"), x.scale)
    folder = shared_folder(x.spark)
    tables.write_bench(pairs, order.join(x.candidates, "candidate_id").select("i", F.col("b").alias("bv"), F.lit(0.1).alias("oc"), "male"), 0.25, folder)
    k, bc, ub = tables.read_bench(x.spark, folder)
    return k.join(bc, "i").select("i", F.col("j").cast("long").alias("j"), R(F.col("g")).alias("g"), "bv", "male", F.lit(ub).alias("ub"))


@query("SELECT n, 'Solved' AS status, points, gains, slowest FROM (SELECT count(*) AS n FROM embeddings), (SELECT count(*) AS points, round(sum(gain), 6) AS gains FROM front), (SELECT max(seconds) AS slowest FROM pts)", tables=_POINTS)
def read_artifacts(x: Panel) -> DataFrame:
    """Key and value lines, a frontier and a scaling table, written and read back."""
    from .scratch import shared_folder
    from .sources import tables

    folder = shared_folder(x.spark)
    tables.write_meta(x.spark, {"n": x.candidates.count(), "k": 0.1, "status": "Solved"}, f"{folder}/meta.csv")
    tables.write_table(tables.frontier_table(_front(x).withColumns({"quad": F.col("k"), "feasible": F.lit(True)})), f"{folder}/frontier")
    names = [c.split()[0] for c in tables.SCALING.split(", ")]
    points = _points(x).withColumnsRenamed({"seconds": "t_solve_s", "rss_mb": "peak_rss_mb"})
    kinds = dict(c.split() for c in tables.SCALING.split(", "))
    tables.write_table(points.select(*[F.col(c) if c in points.columns else F.lit("A" if kinds[c] == "string" else "0").cast(kinds[c]).alias(c) for c in names]), f"{folder}/scaling")
    meta = tables.read_meta(x.spark, f"{folder}/meta.csv").select(F.col("n").cast("long").alias("n"), "status")
    line = tables.read_table(x.spark, f"{folder}/frontier", tables.FRONTIER).agg(F.count("*").alias("points"), R(F.sum("gain")).alias("gains"))
    sizes = tables.read_table(x.spark, f"{folder}/scaling", tables.SCALING).agg(F.max("t_solve_s").alias("slowest"))
    return meta.crossJoin(line).crossJoin(sizes)


@query("SELECT marker_id, count(*) AS cells, count(dosage) AS known, coalesce(sum(dosage), 0) AS total, coalesce(sum(dosage * (candidate_id % 1000 + 1)), 0) AS weighted FROM d GROUP BY 1")
def scan_plink(x: Panel) -> DataFrame:
    """Sums of every marker of the trio written from the panel, as it reads back."""
    from .scratch import shared_folder
    from .sources import plink

    prefix = f"{shared_folder(x.spark)}/panel"
    plink.write_trio(x.dosages, prefix)
    ids = F.regexp_replace("iid", "^I", "").cast("long")  # files number candidates from 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return plink.read_calls(x.spark, prefix).groupBy("marker_id").agg(F.count("*").alias("cells"), F.count("dosage").alias("known"), total(F.col("dosage")).alias("total"), total(F.col("dosage") * (ids % 1000 + 1)).alias("weighted"))


@query("SELECT n, round(seconds, 6) AS t_solve_s, solved FROM pts", tables=_POINTS)
def incremental_points(x: Panel) -> DataFrame:
    """Points published one after the other, the first of them twice: each is there once."""
    from .scratch import shared_folder
    from .sources import tables

    points = _points(x).select("n", F.col("seconds").alias("t_solve_s"), "solved").persist()
    folder = shared_folder(x.spark)
    sizes = sorted(r["n"] for r in points.select("n").collect())
    for n in [*sizes, sizes[0]]:
        tables.append_point(points.where(F.col("n") == n), folder, f"n{n}")
    points.unpersist()
    return tables.read_table(x.spark, folder, "n int, t_solve_s double, solved boolean").select("n", R(F.col("t_solve_s")).alias("t_solve_s"), "solved")


@query("SELECT marker_id, (SELECT count(*) FROM cand) AS calls, round(p, 9) AS p, TRUE AS alike, TRUE AS repeatable FROM mk")
def gen_panel(x: Panel) -> DataFrame:
    """A panel drawn with the frequencies and the size of the given one: each
    marker's own frequency is within five standard errors, and another partitioning
    draws the same calls."""
    from .sources import generators

    one = generators.like(x.candidates.select("candidate_id"), x.markers, 7)
    two = generators.like(x.candidates.select("candidate_id").repartition(3), x.markers, 7)
    sums = lambda g: g.groupBy("marker_id", "p").agg(F.count("*").alias("calls"), F.avg("dosage").alias("mean"), F.sum(F.xxhash64("candidate_id", "dosage").cast("decimal(20,0)")).alias("print"))
    both = sums(one).join(sums(two).select("marker_id", F.col("print").alias("again")), "marker_id")
    error = F.sqrt(F.col("p") * (1 - F.col("p")) / (2 * F.col("calls")))
    return both.select("marker_id", "calls", R(F.col("p"), 9).alias("p"), (F.abs(F.col("mean") / 2 - F.col("p")) <= 5 * error).alias("alike"), (F.col("print") == F.col("again")).alias("repeatable"))


@query("SELECT CAST(greatest(2, count(*) // 20) AS INTEGER) AS families, count(*) AS members, TRUE AS alike FROM cand")
def gen_families(x: Panel) -> DataFrame:
    """As many members as the panel has: those of a family share most calls, others
    do not; from counts by marker, family and dosage, without pairs."""
    from .sources import generators

    g = generators.families(x.spark, x.candidates.count(), x.markers.count(), 3)
    pairs = lambda n: n * (n - 1) / 2
    own = g.groupBy("marker_id", "family", "dosage").count().groupBy("marker_id", "family").agg(F.sum(pairs(F.col("count"))).alias("same"), F.sum("count").alias("n")).agg(F.sum("same").alias("same"), F.sum(pairs(F.col("n"))).alias("all"))
    every = g.groupBy("marker_id", "dosage").count().groupBy("marker_id").agg(F.sum(pairs(F.col("count"))).alias("same_any"), F.sum("count").alias("n")).agg(F.sum("same_any").alias("same_any"), F.sum(pairs(F.col("n"))).alias("all_any"))
    size = g.agg(F.countDistinct("family").cast("int").alias("families"), F.countDistinct("candidate_id").alias("members"))
    other = (F.col("same_any") - F.col("same")) / (F.col("all_any") - F.col("all"))
    return size.crossJoin(own).crossJoin(every).select("families", "members", (F.col("same") / F.col("all") > other + 0.1).alias("alike"))


@query("SELECT CASE WHEN candidate_id > 40 THEN 1 ELSE 0 END AS generation, count(*) AS n, TRUE AS mendelian FROM ped GROUP BY 1", tables=fixtures.PEDIGREE_SQL)
def gen_pedigree(x: Panel) -> DataFrame:
    """Genes dropped down the given pedigree from the panel's own calls: no child
    lacks an allele that a parent can only pass on."""
    from .sources import generators

    founders = x.dosages.select((F.col("candidate_id") + 1).alias("candidate_id"), "marker_id", F.coalesce("dosage", F.lit(0)).alias("dosage"))
    g = generators.gene_drop(x.pedigree, founders, 5)
    parent = lambda who: g.select(F.col("candidate_id").alias(who), "marker_id", F.col("dosage").alias(f"of_{who}"))
    both = g.join(parent("sire"), ["sire", "marker_id"], "left").join(parent("dam"), ["dam", "marker_id"], "left")
    least = F.coalesce((F.col("of_sire") == 2).cast("int"), F.lit(0)) + F.coalesce((F.col("of_dam") == 2).cast("int"), F.lit(0))
    most = F.coalesce((F.col("of_sire") > 0).cast("int"), F.lit(1)) + F.coalesce((F.col("of_dam") > 0).cast("int"), F.lit(1))
    return both.groupBy("generation").agg(F.countDistinct("candidate_id").alias("n"), F.bool_and(F.col("dosage").between(least, most)).alias("mendelian"))


from . import solver_queries, study_queries  # noqa: E402, F401  (they register their own)
