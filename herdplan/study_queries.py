"""Queries over spectra, systems, packings and random subsets, with SQL that works
them out by other means: matrix squaring, elimination and a walk down the ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixtures import Panel
from .functions import rounded as R
from .operators import panel, plan, relatedness
from .queries import query, rows_of

RIDGE = 1e-5

# -- matrices as lists of rows in DuckDB

#: G over markers, which has the non-zero eigenvalues of G over candidates.
_MARKER_GRAM = """gm AS (SELECT a.marker_id AS i, b.marker_id AS j, sum(a.z * b.z) / max(s) AS g FROM z a JOIN z b ON a.candidate_id = b.candidate_id, sc GROUP BY 1, 2),
 mat AS (SELECT list(r ORDER BY i) AS a FROM (SELECT i, list(g ORDER BY j) AS r FROM gm GROUP BY i))"""


def _largest(name: str, source: str, steps: int = 22) -> str:
    """Largest eigenvalue of a symmetric matrix ``a`` of ``source``: its 2^steps-th
    power has the eigenvector in every column."""
    return f"""{name}_pw(step, a, p) AS (SELECT 0, a, a FROM {source} UNION ALL SELECT step + 1, a, list_transform(q, lambda r: list_transform(r, lambda v: v / tr)) FROM (
   SELECT *, list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i][i])) AS tr FROM (SELECT step, a, list_transform(p, lambda r: list_transform(p, lambda c: list_dot_product(r, c))) AS q FROM {name}_pw WHERE step < {steps}))),
 {name}_v AS (SELECT a, list_transform(p, lambda r: list_sum(r)) AS v0, p FROM {name}_pw WHERE step = {steps}),
 {name}_w AS (SELECT a, p[list_position(dg, list_max(dg))] AS v FROM (SELECT *, list_transform(range(1, len(p) + 1), lambda i: p[i][i]) AS dg FROM {name}_v)),
 {name} AS (SELECT list_dot_product(v, list_transform(a, lambda r: list_dot_product(r, v))) / list_dot_product(v, v) AS e FROM {name}_w)"""


def _solved(name: str, source: str) -> str:
    """Rows ``x`` of what Gauss-Jordan elimination leaves of the augmented rows
    ``a`` of ``source``: the right-hand sides times the inverse."""
    return f"""{name}_gj(step, n, a) AS (SELECT 0, len(a), a FROM {source} UNION ALL SELECT step + 1, n, list_concat(list_transform(a[2:], lambda r: list_transform(range(2, len(r) + 1), lambda j: r[j] - r[1] * a[1][j] / a[1][1])),
   [list_transform(a[1][2:], lambda v: v / a[1][1])]) FROM {name}_gj WHERE step < n),
 {name} AS (SELECT a AS x FROM {name}_gj WHERE step = n)"""


#: Eigenvalues above a threshold are as many as positive pivots of A less it.
_RANK = """sh AS (SELECT list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) + 1), lambda j: a[i][j] - CASE WHEN i = j THEN 1e-9 * e ELSE 0 END)) AS a FROM mat, top),
 el(step, n, a, pos) AS (SELECT 0, len(a), a, 0 FROM sh UNION ALL SELECT step + 1, n, list_transform(a[2:], lambda r: list_transform(range(2, len(r) + 1), lambda j: r[j] - r[1] * a[1][j] / a[1][1])), pos + CASE WHEN a[1][1] > 0 THEN 1 ELSE 0 END FROM el WHERE step < n),
 rk AS (SELECT pos AS rank FROM el WHERE step = n)"""


def _with(*parts: str) -> str:
    return ", " + ", ".join(parts)


@query(
    _with(_MARKER_GRAM, _largest("top", "mat"), _RANK, "sq AS (SELECT i, j, sum(g2) AS g2 FROM (SELECT a.i, b.j, a.g * b.g AS g2 FROM gm a JOIN gm b ON a.j = b.i) GROUP BY 1, 2)", "tr AS (SELECT sum(CASE WHEN i = j THEN g END) AS tr, sum(g * g) AS ss FROM gm)")
    + " SELECT round(tr, 6) AS trace, round(ss, 6) AS squares, round((SELECT sum(g2 * g2) FROM sq), 4) AS fourth, round(e, 6) AS largest, CAST(rank AS INTEGER) AS rank, round(ss / (e * e), 5) AS stable_rank, round(tr * tr / ss, 5) AS participation, TRUE AS pairs_hold FROM tr, top, rk",
    recursive=True,
)
def spectrum_summary(x: Panel) -> DataFrame:
    """Sums of powers of all eigenvalues of G, the largest, numerical rank, stable
    rank and participation ratio, by block Lanczos; whether every pair found is one
    to 1e-8 of the largest."""
    from .plans import spectral

    with rows_of(x) as (rows, s):
        products = spectral.Products(rows, s)
        try:
            found = spectral.lanczos(products)
        finally:
            products.close()
    v = spectral.spectrum_summary(found)
    held = bool((found.residuals <= 1e-8 * v["largest"]).all())
    row = (*(round(v[c], d) for c, d in (("trace", 6), ("squares", 6), ("fourth", 4), ("largest", 6))), v["rank"], round(v["stable_rank"], 5), round(v["participation"], 5), held)
    return x.spark.createDataFrame([row], "trace double, squares double, fourth double, largest double, rank int, stable_rank double, participation double, pairs_hold boolean")


@query(
    _with(
        _MARKER_GRAM,
        "zb AS (SELECT marker_id, sum(z * b) / max(s) AS v FROM z JOIN cand USING (candidate_id), sc GROUP BY 1)",
        f"aug AS (SELECT list(list_append(list_transform(range(1, len(a) + 1), lambda j: a[i][j] + CASE WHEN i = j THEN {RIDGE} ELSE 0 END), v) ORDER BY i) AS a FROM mat, (SELECT marker_id + 1 AS i, v FROM zb))",
        _solved("sol", "aug"),
        "y AS (SELECT unnest(range(0, len(x))) AS marker_id, unnest(list_transform(x, lambda r: r[1])) AS y FROM sol)",
        f"xs AS (SELECT candidate_id, (max(b) - sum(z * y)) / {RIDGE} AS x, max(b) AS b FROM z JOIN y USING (marker_id) JOIN cand USING (candidate_id) GROUP BY 1)",
        "tx AS (SELECT marker_id, sum(z * x) AS t FROM z JOIN xs USING (candidate_id) GROUP BY 1)",
        f"res AS (SELECT candidate_id, max(b) - sum(z * t) / max(s) - {RIDGE} * max(x) AS r, max(b) AS b FROM z JOIN tx USING (marker_id) JOIN xs USING (candidate_id), sc GROUP BY 1)",
    )
    + " SELECT round(sum(p * p) * sum(p * p) / sum(p * p * p * p), 5) AS participation, round(sum(x * b), 5) AS quad, (SELECT sqrt(sum(r * r)) <= 1e-8 * sqrt(sum(b * b)) FROM res) AS solved FROM (SELECT *, greatest(x, 0) AS p FROM xs)",
    recursive=True,
)
def inverse_participation(x: Panel) -> DataFrame:
    """Participation ratio of the positive part of G^-1 b and b'G^-1 b, by conjugate
    gradients; the residual is recomputed from the rows by joins."""
    from .plans import spectral

    with rows_of(x) as (rows, s):
        products = spectral.Products(rows, s)
        try:
            found = spectral.inverse_times(products, RIDGE).persist()
            gx = plan.kinship_product(x.genotypes, found.select("candidate_id", F.col("x").alias("c")), x.scale, RIDGE)
            left = found.join(gx, "candidate_id").agg((F.sqrt(F.sum((F.col("b") - F.col("gc")) ** 2)) <= 1e-8 * F.sqrt(F.sum(F.col("b") ** 2))).alias("solved"))
            out = spectral.participation(found, "x").crossJoin(found.agg(F.sum(F.col("x") * F.col("b")).alias("quad"))).crossJoin(left)
            row = out.first()
            found.unpersist()
        finally:
            products.close()
    return x.spark.createDataFrame([(round(row["participation"], 5), round(row["quad"], 5), row["solved"])], "participation double, quad double, solved boolean")


def _condition_sql(few: int) -> str:
    """A set of up to as many as markers through its own matrix; all candidates
    through the markers', G being singular but for the ridge."""
    return (
        _with(
            _MARKER_GRAM, _largest("top", "mat"),
            f"own AS (SELECT candidate_id FROM ranked WHERE rank <= {few})",
            f"gs AS (SELECT a.candidate_id AS i, b.candidate_id AS j, sum(a.z * b.z) / max(s) + CASE WHEN a.candidate_id = b.candidate_id THEN {RIDGE} ELSE 0 END AS g FROM z a JOIN z b USING (marker_id), sc WHERE a.candidate_id IN (SELECT candidate_id FROM own) AND b.candidate_id IN (SELECT candidate_id FROM own) GROUP BY 1, 2)".replace("a JOIN z b USING (marker_id)", "a JOIN z b ON a.marker_id = b.marker_id"),
            "smat AS (SELECT list(r ORDER BY i) AS a FROM (SELECT i, list(g ORDER BY j) AS r FROM gs GROUP BY i))",
            _largest("high", "smat"),
            "saug AS (SELECT list_transform(range(1, len(a) + 1), lambda i: list_concat(a[i], list_transform(range(1, len(a) + 1), lambda j: CASE WHEN i = j THEN 1.0e0 ELSE 0.0e0 END))) AS a FROM smat)",
            _solved("inv", "saug"), "imat AS (SELECT x AS a FROM inv)", _largest("ilow", "imat"),
        )
        + f""" SELECT 'few' AS members, (SELECT count(*) FROM own) AS n, round(1 / ilow.e, 9) AS least, round(high.e, 6) AS greatest, round(high.e * ilow.e, 4) AS condition FROM ilow, high
 UNION ALL SELECT 'all', (SELECT count(*) FROM cand), {RIDGE}, round(top.e + {RIDGE}, 6), round((top.e + {RIDGE}) / {RIDGE}, 1) FROM top"""
    )


@query(_condition_sql(30), recursive=True)
def condition_number(x: Panel) -> DataFrame:
    """Both ends of the spectrum of G + ridge I over the thirty best of each sex,
    and over all candidates, which are more than G has independent ones."""
    from .plans import spectral

    out = []
    with rows_of(x) as (rows, s):
        few = plan.best_by_sex(x.candidates, 30).select("candidate_id")
        for name, own in (("few", rows.join(few, "candidate_id", "left_semi")), ("all", rows)):
            products = spectral.Products(own, s)
            try:
                low, high = spectral.extremes(products, RIDGE)
            finally:
                products.close()
            out.append((name, products.n, round(low, 9), round(high, 6), round(high / low, 4 if name == "few" else 1)))
    return x.spark.createDataFrame(out, "members string, n long, least double, greatest double, condition double")


@query(
    _with(
        "best AS (SELECT candidate_id, CAST(NULL AS BIGINT) AS copy FROM (SELECT *, row_number() OVER (ORDER BY b DESC, candidate_id) AS r FROM cand) WHERE r <= 10)",
        "more AS (SELECT candidate_id, row_number() OVER (ORDER BY b DESC, candidate_id) AS copy FROM cand QUALIFY copy <= 5)",
        "own AS (SELECT row_number() OVER (ORDER BY candidate_id, copy) AS m, candidate_id FROM (SELECT * FROM best UNION ALL SELECT * FROM more))",
        "gs AS (SELECT a.m AS i, b.m AS j, sum(za.z * zb.z) / max(s) + CASE WHEN a.m = b.m THEN 1e-4 ELSE 0 END AS g FROM own a JOIN z za USING (candidate_id), own b JOIN z zb USING (candidate_id), sc WHERE za.marker_id = zb.marker_id GROUP BY 1, 2)",
        "smat AS (SELECT list(r ORDER BY i) AS a FROM (SELECT i, list(g ORDER BY j) AS r FROM gs GROUP BY i))", _largest("high", "smat"),
        "saug AS (SELECT list_transform(range(1, len(a) + 1), lambda i: list_concat(a[i], list_transform(range(1, len(a) + 1), lambda j: CASE WHEN i = j THEN 1.0e0 ELSE 0.0e0 END))) AS a FROM smat)",
        _solved("inv", "saug"), "imat AS (SELECT x AS a FROM inv)", _largest("ilow", "imat"),
        "ends AS (SELECT 1 / ilow.e - 1e-4 AS low, high.e - 1e-4 AS high FROM ilow, high)",
        "tries AS (SELECT unnest(range(1, 11)) AS t)",
    )
    + " SELECT round(1e-6 * pow(10, t - 1), 9) AS ridge, CAST(t AS INTEGER) AS tries, round((high + 1e-6 * pow(10, t - 1)) / (low + 1e-6 * pow(10, t - 1)) / 1000, 3) AS condition_k FROM ends, tries WHERE low + 1e-6 * pow(10, t - 1) > 5e-5 ORDER BY t LIMIT 1",
    recursive=True,
)
def ridge_escalation(x: Panel) -> DataFrame:
    """The ten best candidates and copies of the first five: G is singular, and the
    ridge grows tenfold until its least eigenvalue is above a bound."""
    from .plans import spectral

    with rows_of(x) as (rows, s):
        best = plan.best_of(x.candidates, 10).select("candidate_id")
        own = rows.join(best, "candidate_id", "left_semi").select("candidate_id", "z", "b")
        _, more = panel.add_clones(own, own, 5)
        products = spectral.Products(more, s)
        try:
            ridge, tries, condition = spectral.escalated(products, 1e-6, 5e-5, 10)
        finally:
            products.close()
    return x.spark.createDataFrame([(round(ridge, 9), tries, round(condition / 1000, 3))], "ridge double, tries int, condition_k double")


_TAUS = (0.0, 0.15, 0.4)


@query(
    f""", o AS (SELECT candidate_id, row_number() OVER (ORDER BY b DESC, candidate_id) AS r FROM cand),
 gg AS (SELECT a.candidate_id AS i, b.candidate_id AS j, round(sum(a.z * b.z) / max(s), 9) AS g FROM z a JOIN z b ON a.marker_id = b.marker_id AND a.candidate_id <> b.candidate_id, sc GROUP BY 1, 2),
 t(tau) AS (VALUES {', '.join(f'({t}e0)' for t in _TAUS)}),
 adj AS MATERIALIZED (SELECT tau, p.r, max(p.candidate_id) AS candidate_id, coalesce(list(q.r) FILTER (WHERE g > tau AND q.r < p.r), []) AS better FROM t, o p JOIN gg ON gg.i = p.candidate_id JOIN o q ON gg.j = q.candidate_id GROUP BY tau, p.r),
 walk(tau, r, taken) AS (SELECT tau, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM t UNION ALL SELECT w.tau, w.r + 1, CASE WHEN len(list_intersect(w.taken, adj.better)) = 0 THEN list_append(w.taken, adj.r) ELSE w.taken END FROM walk w JOIN adj ON adj.tau = w.tau AND adj.r = w.r + 1),
 last AS (SELECT tau, unnest(taken) AS r FROM walk WHERE r = (SELECT count(*) FROM o))
 SELECT tau, candidate_id FROM last JOIN o USING (r)""",
    recursive=True,
)
def greedy_packing(x: Panel) -> DataFrame:
    """Candidates by falling b whose relationship to all taken is at most tau, for
    three taus together, in rounds."""
    with rows_of(x) as (rows, s):
        return relatedness.packing(rows, s, _TAUS)[0]


@query(
    """, o AS (SELECT draw, candidate_id, row_number() OVER (PARTITION BY draw ORDER BY substr(md5('0:' || draw || ':' || candidate_id), 1, 16), candidate_id) AS r FROM cand, (SELECT unnest(range(0, 300)) AS draw)),
 own AS (SELECT draw, candidate_id FROM o WHERE r <= 20),
 tt AS (SELECT draw, marker_id, sum(z) AS t, sum(z * z) AS zz, count(*) AS n FROM own JOIN z USING (candidate_id) GROUP BY 1, 2)
 SELECT CAST(draw AS INTEGER) AS draw, max(n) AS size, round(sum(t * t - zz) / max(s) / (max(n) * (max(n) - 1)), 8) + 0.0 AS mean FROM tt, sc GROUP BY draw"""
)
def random_subset_kinship(x: Panel) -> DataFrame:
    """Mean relationship within each of 300 random sets of twenty: the baseline a
    support's relatedness is held against."""
    drawn = relatedness.random_subsets(x.candidates, 20, 300)
    return relatedness.subset_kinship(drawn, x.genotypes, x.scale).select("draw", "size", R(F.col("mean"), 8).alias("mean"))
