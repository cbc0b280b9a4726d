"""Text tables of panels, plans and reports: readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..errors import InputError
from ..functions.genetics import GROWTH
from ..scratch import arrow_store, put, put_lines
from ..shipping import ship

#: The columns of a scaling table and of two studies, in order: fixed values.
SCALING = (
    "n int, m int, route string, status string, solved boolean, feasible boolean, iterations int, ridge double, ridge_tries int, t_datagen_s double, t_grm_s double, "
    "t_factor_s double, t_assemble_s double, t_solve_s double, clarabel_solve_s double, gain double, quad double, k double, sum_err double, min_c double, "
    "a_rows long, a_nnz long, dense_work_gb double, peak_rss_mb double"
)
MATRIX_FREE = "n int, m int, z_gib double, g_gib double, g_build_s string, mfree_solve_s double, support int, status string"
SIZES = "mode string, n int, m int, k double, realised_f double, support int, support_male int, support_female int, ne_c double, delta_f_pct double, solve_s double, status string"
FRONTIER = "k double, diversity_cGc double, gain double, feasible boolean"


def read_table(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",", null: str = "") -> DataFrame:
    """Delimited text under a fixed schema; malformed rows are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").csv(path, header=header, sep=sep, nullValue=null)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


class PointWriter(DataSourceArrowWriter):
    """Writes a point's rows beside the table and publishes them when all are there:
    tasks write pending files, which readers pass over, and the commit joins those
    of the attempts that succeeded into one file of the point's name. A task that
    is tried again leaves no second row, a job that fails leaves the earlier points,
    and a point that is written again replaces itself."""

    def __init__(self, path: str, point: str, header: str):
        self.path, self.point, self.header = path, point, header

    def write(self, iterator):
        import pyarrow.csv as csv
        from pyarrow import BufferOutputStream

        store, folder = arrow_store(self.path)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/_pending-{self.point}-{uuid.uuid4().hex}"
        with store.open_output_stream(name) as f:
            for batch in iterator:
                out = BufferOutputStream()
                csv.write_csv(batch, out, csv.WriteOptions(include_header=False))
                f.write(out.getvalue())
        return _Pending(name)

    def commit(self, messages):
        store, folder = arrow_store(self.path)
        whole = f"{folder}/_pending-{self.point}-{uuid.uuid4().hex}"
        with store.open_output_stream(whole) as f:
            f.write(self.header.encode() + b"\n")
            for m in messages:
                if m is not None:
                    with store.open_input_stream(m.name) as part:
                        f.write(part.read())
        store.move(whole, f"{folder}/point-{self.point}.csv")
        self._clear(store, folder)

    def abort(self, messages):
        store, folder = arrow_store(self.path)
        self._clear(store, folder)

    def _clear(self, store, folder: str) -> None:
        """Pending files of this point, those of failed attempts too."""
        from pyarrow import fs

        for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(f"_pending-{self.point}-"):
                store.delete_file(f.path)


class _Pending(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class PointSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "points"

    def writer(self, schema, overwrite: bool) -> PointWriter:
        return PointWriter(self.options["path"], self.options["point"], ",".join(f.name for f in schema.fields))


def append_point(df: DataFrame, path: str, point: str | None = None) -> None:
    """Adds a finished point to the table in a folder: what was there stays if a
    later one fails. A named point is there once, however often it is written."""
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(PointSink)
    df.write.format("points").mode("append").option("point", point or uuid.uuid4().hex).save(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, place, text): every line with its number, and its number among
    those that are not blank. Lines are numbered inside the blocks that files
    are read in, and blocks by prefix sums of their counts."""
    block = ["_file", "_start"]
    own = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"), F.trim("value").alias("text"))
    full = F.when(F.col("text") != "", 1).otherwise(0)
    counts = own.groupBy(*block).agg(F.count("*").alias("_n"), F.sum(full).alias("_f"))
    until = Window.orderBy(*block)  # a row a block of a file
    before = counts.select(*block, (F.sum("_n").over(until) - F.col("_n")).alias("_n0"), (F.sum("_f").over(until) - F.col("_f")).alias("_f0"))
    inside = Window.partitionBy(*block).orderBy("_row")
    placed = own.withColumns({"_i": F.row_number().over(inside) - 1, "_j": F.sum(full).over(inside) - 1}).join(before, block)
    return placed.select((F.col("_n0") + F.col("_i")).alias("line"), (F.col("_f0") + F.col("_j")).alias("place"), "text")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, cells): tokens between commas or spaces of the non-blank lines."""
    return text_lines(spark, path).where("text <> ''").select(F.col("place").alias("line"), F.split("text", r"[,\s]+").alias("cells"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, g) of a square matrix without header; other shapes are an error."""
    rows = numbered_lines(spark, path)
    n = rows.agg(F.count("*").alias("n"))
    checked = rows.crossJoin(n).withColumn("cells", F.when(F.size("cells") == F.col("n"), F.col("cells")).otherwise(F.raise_error(F.lit("the matrix is not square"))))
    return checked.select(F.col("line").alias("i"), F.posexplode("cells").alias("j", "g")).select("i", "j", F.col("g").cast("double").alias("g"))


def read_vector(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(i, value): the last cell of each line."""
    rows = numbered_lines(spark, path)
    skip = 1 if header else 0
    return rows.where(F.col("line") >= skip).select((F.col("line") - skip).alias("i"), F.element_at("cells", -1).cast("double").alias("value"))


def read_bench(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, float]:
    """The exchange trio: K (i, j, g), bc (i, bv, oc, male), ub."""
    k = read_matrix(spark, f"{folder}/K.csv")
    rows = numbered_lines(spark, f"{folder}/bc.csv").where("line > 0")
    cell = lambda i: F.get("cells", F.lit(i))
    bc = rows.select((F.col("line") - 1).alias("i"), cell(0).cast("double").alias("bv"), cell(1).cast("double").alias("oc"), (F.lower(F.translate(cell(2), '"', "")) == "male").alias("male"))
    ub = spark.read.text(f"{folder}/ub.txt").select(F.trim("value").cast("double").alias("ub")).where("ub is not null").first()["ub"]
    return k, bc, ub


def read_contributions(spark: SparkSession, path: str) -> DataFrame:
    """(id, c) of another tool's report: columns 0 and 5 after the header."""
    rows = numbered_lines(spark, path).where("line > 0").where(F.size("cells") >= 6)
    return rows.select(F.get("cells", F.lit(0)).alias("id"), F.get("cells", F.lit(5)).cast("double").alias("c"))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row from key,value lines."""
    pairs = spark.read.schema("key string, value string").csv(path)
    return pairs.groupBy().pivot("key").agg(F.first("value"))


def dense_rows(pairs: DataFrame, digits: int = 10) -> DataFrame:
    """(i, text): comma-joined rows of a symmetric matrix from i <= j pairs."""
    both = pairs.select("i", "j", "g").union(pairs.where("i <> j").select("j", "i", "g"))
    cells = F.sort_array(F.collect_list(F.struct("j", "g")))
    return both.groupBy("i").agg(F.array_join(F.transform(cells, lambda x: F.format_string(f"%.{digits}e", x["g"])), ",").alias("text"))


def write_matrix(pairs: DataFrame, path: str) -> None:
    """One line a row, in order: range partitioning keeps files in order too."""
    dense_rows(pairs).repartitionByRange("i").sortWithinPartitions("i").select("text").write.text(path)


def write_vector(vector: DataFrame, name: str, path: str) -> None:
    """(i, value) as one column under a header, in order, as one file."""
    lines = vector.orderBy("i").select(F.format_string("%.10e", "value"))
    head = vector.sparkSession.createDataFrame([(name,)], "text string")
    put_lines(head.union(lines), path)


def write_meta(spark: SparkSession, values: dict, path: str) -> None:
    """key,value lines in the order given."""
    put(spark, path, "".join(f"{k},{v:.10e}\n" if isinstance(v, float) else f"{k},{v}\n" for k, v in values.items()).encode())


def frontier_table(points: DataFrame) -> DataFrame:
    """Points of a frontier under the column names of its table."""
    return points.select("k", F.col("quad").alias("diversity_cGc"), "gain", "feasible").orderBy("k")


def write_bench(pairs: DataFrame, plan: DataFrame, ub: float, folder: str) -> None:
    """The exchange trio that read_bench reads: a matrix from pairs i <= j,
    (i, bv, oc, male), and one number."""
    spark = pairs.sparkSession
    put_lines(dense_rows(pairs, 17).orderBy("i").select("text"), f"{folder}/K.csv")
    sex = F.when(F.col("male"), '"male"').otherwise('"female"')
    lines = plan.orderBy("i").select(F.concat_ws(",", F.format_string("%.17g", "bv"), F.format_string("%.17g", "oc"), sex))
    put_lines(spark.createDataFrame([('"bv","oc","sex"',)], "text string").union(lines), f"{folder}/bc.csv")
    put(spark, f"{folder}/ub.txt", f"{ub:.17g}\n".encode())


def write_exchange(rows: DataFrame, path: str, scale: float = 1.0) -> None:
    """id, criterion * scale and gender code (1 male, 2 female), by spaces."""
    line = F.concat_ws(" ", F.col("candidate_id").cast("string"), F.format_string("%.10g", F.col("b") * scale), F.when(F.col("male"), "1").otherwise("2"))
    rows.select(line.alias("value")).write.text(path)


#: Keys of an exchange's specification, padded to one width: fixed values.
SPEC = {"seed": "Seed", "gender": "GenderFile", "matrix": "NrmMatrixFile", "coancestry": "CoancestryMatrixFile", "criterion": "SelCriterionFile", "matings": "NumberOfMatings", "males": "NumberOfMaleParents", "equal_males": "EqualizeMaleContributions", "females": "NumberOfFemaleParents", "equal_females": "EqualizeFemaleContributions", "degree": "TargetDegree", "target": "TargetCoancestry", "rate": "TargetCoancestryRate"}


def write_exchange_folder(pairs: DataFrame, candidates: DataFrame, folder: str, scale: float = 1.0, halved: bool = False, seed: int = 1, matings: int | None = None, targets: dict | None = None, males: int | None = None, females: int | None = None, equal: bool = False) -> None:
    """What an external mating tool reads, each a single file: matrix * scale
    (relationships, or coancestries if ``halved``), criterion and gender by id,
    and the specification, where ``equal`` parents of a sex contribute alike.
    Without a sex or without candidates: an error."""
    spark = pairs.sparkSession
    sexes = {r["male"]: r["count"] for r in candidates.groupBy("male").count().collect()}
    if not sexes or None in sexes:
        raise InputError("every candidate needs a sex")
    name = "Coancestry.txt" if halved else "Nrm.txt"
    matrix = dense_rows(pairs.withColumn("g", F.col("g") * scale)).orderBy("i").select(F.concat_ws(" ", F.col("i").cast("string"), F.translate("text", ",", " ")))
    put_lines(matrix, f"{folder}/{name}")
    by_id = candidates.orderBy("candidate_id")
    put_lines(by_id.select(F.concat_ws(" ", F.col("candidate_id").cast("string"), F.format_string("%.10g", "b"))), f"{folder}/Criterion.txt")
    put_lines(by_id.select(F.concat_ws(" ", F.col("candidate_id").cast("string"), F.when(F.col("male"), "1").otherwise("2"))), f"{folder}/Gender.txt")
    dams, alike = max(1, sexes.get(False, 0)), {"equal_males": "Yes", "equal_females": "Yes"} if equal else {}
    values = {"seed": seed, "gender": "Gender.txt", "coancestry" if halved else "matrix": name, "criterion": "Criterion.txt", "matings": matings or dams, "males": males or max(1, sexes.get(True, 0)), "females": females or dams, **alike, **{k: f"{v:g}" for k, v in (targets or {}).items()}}
    put(spark, f"{folder}/Spec.txt", ("".join(f"{SPEC[k]:<28}, {values[k]}\n" for k in SPEC if k in values) + "Stop\n").encode())


def _cell(value, digits: str = "{:.3f}") -> str:
    return "-" if value is None else digits.format(value) if isinstance(value, float) else str(value)


def markdown_table(rows: list[dict], columns: list[str], digits: str = "{:.3f}") -> str:
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return head + "".join(f"| {' | '.join(_cell(r.get(c), digits) for c in columns)} |\n" for r in rows)


def verdict_markdown(row: dict, limits: dict | None = None, points: list[dict] | None = None, line: list[dict] | None = None) -> str:
    """A report of a verdict row: each criterion with its value, limit and
    whether it holds, the sizes that were timed and the frontier, if given."""
    limits = {"max_ridge": 1e-3, "exponent": 3.5, "max_rss_mb": 32768.0} | (limits or {})
    lines = [f"# Verdict: {row['verdict']}", "", "| criterion | value | limit | holds |", "|---|---|---|---|"]
    for k, v in row.items():
        if k in ("verdict", "label"):
            continue
        limit = limits.get(k)
        holds = v if isinstance(v, bool) else v is None or v >= limit if k == "max_n" and limit is not None else v is None or limit is None or v <= limit
        lines.append(f"| {k} | {v} | {'' if limit is None else limit} | {'yes' if holds else 'no'} |")
    out = "\n".join(lines) + "\n"
    if row.get("exponent") is not None:
        p = row["exponent"]
        out += f"\nTime grows as n^{p:.2f}: {next(label for i, (limit, label) in enumerate(GROWTH) if (p < limit if i == 0 else p <= limit))}.\n"
    if points:
        out += "\n## Sizes\n\n" + markdown_table(points, list(points[0]))
    if line:
        out += "\n## Frontier\n\n" + markdown_table(line, list(line[0]), "{:.6g}")
    return out
