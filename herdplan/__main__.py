"""python -m herdplan COMMAND: data on standard output, progress on standard error.

  correctness   solve a small panel and check it from the panel itself
  frontier      gain against cap, as CSV
  scale         time one size, as CSV
  all           frontier and a sweep of sizes, then the verdict
  report        verdict of a sweep written before (--points, --frontier)
  compare       rows in Spark against the same panel in memory
  bench         marker totals of a dense and a sparse plan, rows against packed
                calls, and a sweep of caps: agreement and seconds, as CSV
  matrixfree    for each size: bytes of Z and of G, seconds to make G (not where it
                passes --g-gib) and to solve without it, as CSV
  parents       for each size: the optimum of --target effective parents, as CSV
"""

from __future__ import annotations

import argparse
import resource
import sys
import time
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import panel, plan, report
from .plans import cap_for_effective_size, frontier, frontier_table, solve_panel
from .plans.api import solve_arrays
from .sources import generators, tables

COMMANDS = ("correctness", "frontier", "scale", "all", "report", "compare", "bench", "matrixfree", "parents", "help")


def make(spark: SparkSession, n: int, m: int, seed: int) -> tuple[DataFrame, DataFrame, float, float]:
    """(rows, long genotypes, s, mean diagonal) of a synthetic panel, centred
    by the frequencies that were drawn."""
    long = generators.panel(spark, n, m, seed)
    z = long.select("candidate_id", "marker_id", (F.col("dosage") - 2 * F.col("p")).alias("z"))
    s = long.select("marker_id", "p").distinct().agg(2 * F.sum(F.col("p") * (1 - F.col("p")))).first()[0]
    rows = panel.widen(z).join(generators.criterion(spark, n, seed), "candidate_id").withColumn("cap", F.lit(None).cast("double")).persist()
    mean = rows.select((F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v) / s).alias("g")).agg(F.avg("g")).first()[0]
    return rows, z, s, mean


def say(*what) -> None:
    print(*what, file=sys.stderr, flush=True)


def show(df: DataFrame) -> None:
    print(df.toPandas().to_csv(index=False), end="")


def peak_mb(spark: SparkSession) -> float | None:
    """Peak memory of this process and its JVM; null where it cannot be read."""
    try:
        pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
        jvm = next(int(x.split()[1]) for x in Path(f"/proc/{pid}/status").read_text().splitlines() if x.startswith("VmHWM"))
        return (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss + jvm) / 1024
    except (OSError, StopIteration):
        return None


def bench(spark: SparkSession, args) -> DataFrame:
    """(what, seconds, other_seconds, apart): two ways to the same numbers."""
    from .plans.api import grouped, select
    from .plans.pricing import PackedPricer, RowPricer, packed_rows

    def timed(f):
        began = time.time()
        return f(), time.time() - began

    rows, z, s, mean = make(spark, args.n, args.m, args.seed)
    long, out = z.persist(), []
    every = rows.select("candidate_id", F.lit(1.0 / args.n).alias("c"))
    few = every.where(F.col("candidate_id") < 10).withColumn("c", F.lit(0.1))
    wide = few.unionByName(every.where(F.col("candidate_id") >= 10).withColumn("c", F.lit(0.0)))
    total = lambda p: {r["marker_id"]: r["t"] for r in plan.marker_totals(long, p).collect()}
    (a, ta), (b, tb) = timed(lambda: total(few)), timed(lambda: total(wide))
    out.append(("marker totals: sparse, dense plan", ta, tb, max(abs(a[j] - b[j]) for j in a)))
    calls = generators.panel(spark, args.n, args.m, args.seed).select("candidate_id", "marker_id", "dosage")
    p = np.array([r["p"] for r in panel.allele_frequencies(calls).orderBy("marker_id").collect()])
    scale, attributes = float(2 * (p * (1 - p)).sum()), rows.select("candidate_id", "b", "male", "cap")
    centred = panel.widen(panel.centre(calls, panel.allele_frequencies(calls))).join(attributes, "candidate_id")
    one, two = RowPricer(grouped(centred, True)), PackedPricer(grouped(packed_rows(calls).join(attributes, "candidate_id"), True), p)
    try:
        (x, tx), (y, ty) = (timed(lambda q=q: select(q, [0.5, 0.5], args.k_frac * mean, scale, args.ridge)) for q in (one, two))
    finally:
        one.close(), two.close()
    out.append(("optimum: rows, packed calls", tx, ty, abs(x.gain - y.gain)))
    for f in (0.1, 0.2, 0.4):
        (x, tx) = timed(lambda f=f: solve_panel(rows, f * mean, s, args.ridge))
        own = rows.orderBy("candidate_id").toPandas()
        (y, ty) = timed(lambda f=f: solve_arrays(np.stack(own["z"]), own["b"].to_numpy(), f * mean, s=s, ridge=args.ridge, male=own["male"].to_numpy()))
        out.append((f"cap {f:g}: Spark, memory", tx, ty, abs(x.gain - y.gain)))
    long.unpersist(), rows.unpersist()
    return spark.createDataFrame(out, "what string, seconds double, other_seconds double, apart double")


def matrix_free(spark: SparkSession, args) -> DataFrame:
    """Rows of tables.MATRIX_FREE."""
    out = []
    for n in args.sizes:
        rows, z, s, mean = make(spark, n, args.m, args.seed)
        g_gib, build = n * n / 2**27, "infeasible"
        if g_gib <= args.g_gib:
            began = time.time()
            panel.relationship_pairs(z, spark.createDataFrame([(float(s),)], "s double")).write.format("noop").mode("overwrite").save()
            build = f"{time.time() - began:.3f}"
        began = time.time()
        got = solve_panel(rows, args.k_frac * mean, s, args.ridge, not args.simplex)
        out.append((n, args.m, n * args.m / 2**27, g_gib, build, time.time() - began, got.support, got.status))
        rows.unpersist()
    return spark.createDataFrame(out, tables.MATRIX_FREE)


def parents(spark: SparkSession, args) -> DataFrame:
    """Rows of tables.SIZES: the point of the critical line that meets the target."""
    out = []
    for n in args.sizes:
        rows, z, s, mean = make(spark, n, args.m, args.seed)
        began = time.time()
        got, size = cap_for_effective_size(rows, args.target, s, args.ridge, not args.simplex)
        took, males = time.time() - began, {r["candidate_id"] for r in rows.where("male").select("candidate_id").collect()}
        of_males = sum(i in males for i in got.ids)
        out.append(("simplex" if args.simplex else "sexed", n, args.m, float(got.k), float(got.quad), len(got.ids), of_males, len(got.ids) - of_males, size, 50 / size, took, got.status))
        rows.unpersist()
    return spark.createDataFrame(out, tables.SIZES)


def one_size(spark: SparkSession, n: int, m: int, args) -> tuple:
    rows, z, s, mean = make(spark, n, m, args.seed)
    began = time.time()
    got = solve_panel(rows, args.k_frac * mean, s, args.ridge, not args.simplex)
    took = time.time() - began
    rows.unpersist()
    return (n, m, took, args.ridge, peak_mb(spark), got.solved, got.solved and got.quad <= got.k + 1e-6, got.support, got.products)


POINT = "n int, m int, seconds double, ridge double, rss_mb double, solved boolean, feasible boolean, support int, products int"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="herdplan", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--n", type=int, default=500)
    p.add_argument("--m", type=int, default=200)
    p.add_argument("--seed", type=int, default=20240617)
    p.add_argument("--k-frac", type=float, default=0.1)
    p.add_argument("--ridge", type=float, default=1e-5)
    p.add_argument("--caps", type=int, default=8, help="points of a frontier")
    p.add_argument("--sizes", type=lambda t: [int(x) for x in t.split(",")], default=[250, 500, 1000])
    p.add_argument("--simplex", action="store_true", help="one budget instead of one for each sex")
    p.add_argument("--target", type=float, default=20.0, help="effective parents")
    p.add_argument("--g-gib", type=float, default=4.0, help="largest relationship matrix that is made")
    p.add_argument("--in-memory", type=int, default=0, help="MB up to which a panel is solved in memory")
    p.add_argument("--points")
    p.add_argument("--frontier", dest="frontier_path")
    args = p.parse_args(argv)
    if args.command == "help":
        p.print_help()
        return 0
    spark = SparkSession.builder.appName("herdplan").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "report":
        points = tables.read_table(spark, args.points, POINT)
        line = tables.read_table(spark, args.frontier_path, "k double, quad double, gain double, feasible boolean, n_support int")
        print(tables.verdict_markdown(report.verdict(points, line, reach=0).first().asDict()))
        return 0
    if args.command in ("scale", "all"):
        sizes = [args.n] if args.command == "scale" else args.sizes
        done = []
        for n in sizes:
            say(f"n = {n}")
            done.append(one_size(spark, n, args.m, args))
        points = spark.createDataFrame(done, POINT)
        show(points)
        if args.command == "scale":
            return 0
    if args.command in ("bench", "matrixfree", "parents"):
        show({"bench": bench, "matrixfree": matrix_free, "parents": parents}[args.command](spark, args))
        return 0
    rows, z, s, mean = make(spark, args.n, args.m, args.seed)
    if args.command in ("frontier", "all"):
        line = frontier_table(rows, frontier(rows, np.linspace(0.08, 0.8, args.caps) * mean, s, args.ridge, not args.simplex))
        show(line.orderBy("k"))
        if args.command == "all":
            row = report.verdict(points, line, reach=max(args.sizes)).first().asDict()
            print(tables.verdict_markdown(row, {"max_n": max(args.sizes)}, [r.asDict() for r in points.orderBy("n").collect()], [r.asDict() for r in line.orderBy("k").collect()]))
        return 0
    got = solve_panel(rows, args.k_frac * mean, s, args.ridge, not args.simplex, local_bytes=args.in_memory << 20)
    say(repr(got))
    if args.command == "correctness":
        c = got.contributions(spark)
        checks = plan.feasibility(c, plan.coancestry(z, c, spark.createDataFrame([(float(s),)], "s double")), got.k)
        show(checks)
        return 0 if got.solved and checks.first()["ok"] and got.reduced < 1e-6 else 1
    own = rows.orderBy("candidate_id").toPandas()
    want = solve_arrays(np.stack(own["z"]), own["b"].to_numpy(), args.k_frac * mean, s=s, ridge=args.ridge, male=None if args.simplex else own["male"].to_numpy())
    delta = abs(got.gain - want.gain)
    print(f"gain,{got.gain:.10e}\nother,{want.gain:.10e}\ndelta,{delta:.3e}")
    return 0 if got.solved and want.solved and delta < 1e-6 else 1


if __name__ == "__main__":
    sys.exit(main())
