"""Readers, writers and generators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdplan import queries
from herdplan.errors import FormatError
from herdplan.operators import panel
from herdplan.sources import generators, plink, tables

CALLS = np.array([[0, 2, 0], [1, -1, 0], [2, 0, 0], [2, 1, 0], [1, 1, 0], [0, 2, 0]], np.int8)


@pytest.fixture
def trio(tmp_path):
    prefix = str(tmp_path / "panel.v1")
    plink.write(prefix, CALLS)
    return prefix


def read(spark, prefix, step=2):
    plink.register(spark)
    rows = spark.read.format("plink").option("markersPerPartition", str(step)).load(prefix).collect()
    out = np.full(CALLS.shape if len(rows) == CALLS.size else (37, 11), -1, np.int8)
    for r in rows:
        out[r.candidate_id, r.marker_id] = -1 if r.dosage is None else r.dosage
    return out


def test_round_trip(spark, trio):
    assert (read(spark, trio) == CALLS).all()
    assert [r.iid for r in plink.scan_fam(spark, trio + ".fam").orderBy("candidate_id").collect()] == [f"I{i}" for i in range(6)]
    assert plink.scan_bim(spark, trio + ".bim").first().markers == 3


def test_round_trip_odd_sizes(spark, tmp_path):
    d = np.random.default_rng(3).integers(-1, 3, (37, 11)).astype(np.int8)
    plink.write(str(tmp_path / "p"), d)
    assert (read(spark, str(tmp_path / "p"), 4) == d).all()


def test_frequencies_of_missing_markers(spark):
    rows = [(0, 0, 2), (1, 0, None), (0, 1, None), (1, 1, None)]
    d = spark.createDataFrame(rows, "candidate_id long, marker_id int, dosage int")
    got = {r.marker_id: (r.p, r.calls) for r in panel.allele_frequencies(d).collect()}
    assert got == {0: (1.0, 1), 1: (0.0, 0)}
    z = {(r.candidate_id, r.marker_id): r.z for r in panel.centre(d, panel.allele_frequencies(d)).collect()}
    assert z == {(0, 0): 0.0, (1, 0): 0.0, (0, 1): 0.0, (1, 1): 0.0}


@pytest.mark.parametrize("damage", ["magic", "mode", "fam", "short"])
def test_damaged_files(trio, damage):
    with open(trio + ".bed", "rb") as f:
        data = bytearray(f.read())
    if damage == "magic":
        data[0] = 0
    elif damage == "mode":
        data[2] = 0
    elif damage == "short":
        data = data[:-1]
    else:
        with open(trio + ".fam", "a") as f:
            f.writelines(f"F I{i}x 0 0 0 -9\n" for i in range(3))
    with open(trio + ".bed", "wb") as f:
        f.write(data)
    with pytest.raises(FormatError):
        plink.PlinkReader(trio, 2)


def test_short_lines_and_missing_files(tmp_path):
    with pytest.raises(FormatError):
        plink.individuals(iter(["F1 I1", "", "F2"]), "x")
    with pytest.raises(FormatError):
        plink.individuals(iter([""]), "x")
    with pytest.raises(FormatError):
        plink.marker_count(iter(["1"]), "x")
    with pytest.raises(FileNotFoundError):
        plink.PlinkReader(str(tmp_path / "none"), 2)


def test_exchange_files(spark, tmp_path):
    (tmp_path / "K.csv").write_text("1,0.5\n0.5,2\n")
    (tmp_path / "bc.csv").write_text("bv,oc,sex\n1.5,0.5,male\n-1,0.5,female\n")
    (tmp_path / "ub.txt").write_text("0.25\n")
    k, bc, ub = tables.read_bench(spark, str(tmp_path))
    assert sorted((r.i, r.j, r.g) for r in k.collect()) == [(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 2.0)] and ub == 0.25
    assert [(r.bv, r.male) for r in bc.orderBy("i").collect()] == [(1.5, True), (-1.0, False)]
    pairs = k.where("i <= j")
    tables.write_matrix(pairs, str(tmp_path / "out"))
    again = tables.read_matrix(spark, str(tmp_path / "out" / "*.txt"))
    assert again.count() == 4


def test_not_square(spark, tmp_path):
    (tmp_path / "k.csv").write_text("1 2\n3\n")
    with pytest.raises(Exception, match="square"):
        tables.read_matrix(spark, str(tmp_path / "k.csv")).collect()


def test_scaling_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(10, 20, "A", "Solved", True, True, 3, 1e-5, 1, *[1.0] * 6, 1.0, 0.1, 0.1, 0.0, 0.0, 12, 40, 0.1, 5.0)], tables.SCALING)
    assert len(df.columns) == 24  # 23 fixed ones and the memory
    path = str(tmp_path / "s")
    tables.append_point(df, path)
    tables.append_point(df, path)
    assert tables.read_table(spark, path, tables.SCALING).count() == 2


def test_shared_folders_are_dropped(spark):
    from herdplan import scratch

    path = scratch.shared_folder(spark)
    scratch.put(spark, f"{path}/x.txt", b"1\n")
    assert spark.read.text(path).count() == 1 and scratch.drop_folders(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.text(path)


def test_a_point_is_published_once(spark, tmp_path):
    """A task that failed after it wrote, a job that fails, and a point written again."""
    path, schema = str(tmp_path / "points"), "n long, t double"
    read = lambda: sorted(map(tuple, tables.read_table(spark, path, schema).collect()))
    points = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, 2.5)], schema).repartition(3)
    tables.append_point(points, path, "a")
    assert read() == [(1, 0.5), (2, 1.5), (3, 2.5)]
    tables.append_point(points.where("n < 3"), path, "a")
    tables.append_point(points.where("n = 1").withColumn("t", F.lit(9.0)), path, "b")
    assert read() == [(1, 0.5), (1, 9.0), (2, 1.5)]
    broken = points.withColumn("t", F.when(F.col("n") == 2, F.raise_error(F.lit("no such point")).cast("double")).otherwise(F.col("t")))
    with pytest.raises(Exception, match="no such point"):
        tables.append_point(broken, path, "c")
    writer = tables.PointWriter(path, "d", "n,t")
    batches = lambda n: iter(spark.createDataFrame([(n, 0.25)], schema).toArrow().to_batches())
    writer.write(batches(7))  # an attempt whose result never reached the driver
    writer.commit([writer.write(batches(7)), None, writer.write(batches(8))])
    assert read() == [(1, 0.5), (1, 9.0), (2, 1.5), (7, 0.25), (8, 0.25)]
    assert {p.name for p in (tmp_path / "points").iterdir() if not p.name.startswith(".")} == {"point-a.csv", "point-b.csv", "point-d.csv"}


def test_generators_do_not_depend_on_partitions(spark):
    a = generators.panel(spark, 40, 30, 3)
    assert a.exceptAll(generators.panel(spark, 40, 30, 3).repartition(3)).count() == 0
    assert a.exceptAll(generators.panel(spark, 40, 30, 4)).count() > 0
    p = {(r.marker_id, r.p) for r in a.select("marker_id", "p").distinct().collect()}
    assert len(p) == 30 and all(0.05 <= x[1] <= 0.5 for x in p)


class Small:
    """A panel of 230 candidates and 31 markers with missing calls."""

    def __init__(self, spark):
        self.spark, self.calls = spark, np.random.default_rng(8).integers(-1, 3, (230, 31))
        rows = [(i, j, None if d < 0 else int(d)) for i, own in enumerate(self.calls) for j, d in enumerate(own)]
        self.dosages = spark.createDataFrame(rows, "candidate_id long, marker_id int, dosage int")


def test_whole_panel_products(spark, monkeypatch):
    x = Small(spark)
    monkeypatch.setattr(queries, "Panel", lambda *_: x)
    got = queries.QUERIES["gram_packed"](spark, "").toPandas()
    d = np.maximum(x.calls, 0)
    p = d.mean(axis=0) / 2
    want = (d - 2 * p) @ (d - 2 * p).T / (2 * (p * (1 - p)).sum())
    assert len(got) == 230 * 231 // 2 and np.abs(got.g.to_numpy() - want[got.i, got.j]).max() < 1e-6


def test_whole_panel_reads_back(spark, monkeypatch):
    x = Small(spark)
    monkeypatch.setattr(queries, "Panel", lambda *_: x)
    own = np.maximum(x.calls, 0)
    want = [(j, 230, int((x.calls[:, j] >= 0).sum()), int(own[:, j].sum()), int((own[:, j] * (np.arange(230) + 1)).sum())) for j in range(31)]
    assert sorted(map(tuple, queries.QUERIES["scan_plink"](spark, "").collect())) == want


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    """Blank lines count in one numbering only; blocks are much smaller than the file."""
    path = tmp_path / "lines.txt"
    path.write_text("\n".join("" if k % 7 == 3 else f"row {k} {'x' * (k % 40)}" for k in range(3000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = tables.text_lines(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    full = sorted((r.line, r.place, r.text) for r in got if r.text)
    assert [x[0] for x in full] == [k for k in range(3000) if k % 7 != 3] and [x[1] for x in full] == list(range(len(full)))
    assert all(t.startswith(f"row {n}") for n, _, t in full) and sorted(r.line for r in got) == list(range(3000))


def test_panel_through_any_reader(spark, tmp_path):
    """The data source, Spark's binary reader and memory give one panel."""
    from herdplan.plans import read_plink, vanraden_scale

    d = np.random.default_rng(4).integers(-1, 3, (37, 11))
    plink.write(str(tmp_path / "p"), d)
    one, two = (plink.read_panel(spark, f"{way}{tmp_path}/p") for way in ("", "file://"))
    three = plink.read_through_spark(spark, f"file://{tmp_path}/p")
    key = lambda df: sorted((r.candidate_id, r.marker_id, r.iid, -1 if r.dosage is None else r.dosage) for r in df.collect())
    assert key(one.dosages) == key(two.dosages) == key(three) == [(i, j, f"I{i}", int(d[i, j])) for i in range(37) for j in range(11)]
    arrays = read_plink(tmp_path / "p")
    z = {(r.candidate_id, r.marker_id): r.z for r in two.genotypes.collect()}
    assert arrays.ids == [r.iid for r in two.ids.orderBy("candidate_id").collect()]
    assert all(abs(arrays.Z[i, j] - z[i, j]) < 1e-12 for i in range(37) for j in range(11))
    assert two.scale.first()["s"] == pytest.approx(arrays.s) == pytest.approx(vanraden_scale(arrays.p)) and "37 candidates" in repr(arrays)
    (tmp_path / "p.bed").write_bytes((tmp_path / "p.bed").read_bytes()[:-1])
    with pytest.raises(Exception, match="bytes do not hold"):
        plink.read_calls(spark, f"file://{tmp_path}/p").collect()
    with pytest.raises(Exception, match="bytes do not hold"):
        plink.read_through_spark(spark, f"file://{tmp_path}/p").collect()


def test_filters_read_only_their_bytes(spark, tmp_path, monkeypatch):
    d = np.random.default_rng(5).integers(-1, 3, (203, 60))
    plink.write(str(tmp_path / "p"), d)
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def read_at(self, n, at):
            read.append((at, n))
            return self.f.read_at(n, at)

    from pyspark.sql import datasource as ds

    marker, candidate = ("marker_id",), ("candidate_id",)
    cases = [
        ([ds.GreaterThanOrEqual(marker, 20), ds.LessThan(marker, 26)], range(20, 26), range(203), 6 * 51),
        ([ds.In(marker, (3, 50)), ds.IsNotNull(marker)], [3, 50], range(203), 2 * 51),
        ([ds.EqualTo(candidate, 9), ds.GreaterThan(marker, 57)], [58, 59], [9], 2),
        ([ds.GreaterThan(candidate, 100), ds.LessThanOrEqual(candidate, 107), ds.EqualTo(marker, 7)], [7], range(101, 108), 2),
        ([ds.EqualTo(marker, 99)], [], range(203), 0), ([ds.In(candidate, (5, 6)), ds.EqualTo(candidate, 7)], range(60), [], 0),
    ]
    for filters, markers, candidates, size in cases:
        reader = plink.PlinkReader(str(tmp_path / "p"), 16)
        assert list(reader.pushFilters([*filters, ds.EqualTo(("iid",), "I3"), ds.EqualTo(marker, "x")])) == [ds.EqualTo(("iid",), "I3"), ds.EqualTo(marker, "x")]
        own = plink.PlinkReader._bytes
        monkeypatch.setattr(plink.PlinkReader, "_bytes", staticmethod(lambda f, *rest: own(Counted(f), *rest)))  # noqa: B023
        read.clear()
        got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        monkeypatch.undo()
        want = [(i, j, f"I{i}", int(d[i, j])) for j in markers for i in candidates]
        assert [(r["candidate_id"], r["marker_id"], r["iid"], -1 if r["dosage"] is None else r["dosage"]) for r in got] == want
        assert sum(n for _, n in read) == size
    calls = plink.read_calls(spark, str(tmp_path / "p"))
    some = calls.where("marker_id between 10 and 12 and candidate_id > 198 and iid <> 'I200'")
    assert sorted((r.candidate_id, r.marker_id) for r in some.collect()) == [(i, j) for i in (199, 201, 202) for j in (10, 11, 12)]


def test_a_trio_is_written_from_tasks(spark, tmp_path):
    d = np.random.default_rng(6).integers(-1, 3, (9, 5))
    rows = [(i, j, None if d[i, j] < 0 else int(d[i, j])) for i in range(9) for j in range(5)]
    plink.write_trio(spark.createDataFrame(rows, "candidate_id long, marker_id int, dosage int").repartition(3), str(tmp_path / "q"))
    for suffix, data in plink.trio(d).items():
        assert (tmp_path / f"q{suffix}").read_bytes() == data


def test_exchange_folder_and_meta(spark, tmp_path):
    from herdplan.errors import InputError

    pairs = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.25), (2, 2, 1.5)], "i long, j long, g double")
    cand = spark.createDataFrame([(1, 2.5, True), (2, -1.0, False)], "candidate_id long, b double, male boolean")
    tables.write_exchange_folder(pairs, cand, str(tmp_path / "x"), scale=0.5, halved=True, targets={"degree": 45.0})
    rows = (tmp_path / "x" / "Coancestry.txt").read_text().split("\n")
    assert [[float(v) for v in r.split()] for r in rows if r] == [[1, 0.5, 0.125], [2, 0.125, 0.75]]
    assert (tmp_path / "x" / "Gender.txt").read_text() == "1 1\n2 2\n" and [[float(v) for v in r.split()] for r in (tmp_path / "x" / "Criterion.txt").read_text().splitlines()] == [[1, 2.5], [2, -1]]
    spec = (tmp_path / "x" / "Spec.txt").read_text()
    assert spec.endswith("Stop\n") and f"{'TargetDegree':<28}, 45" in spec and f"{'CoancestryMatrixFile':<28}, Coancestry.txt" in spec
    assert "Equalize" not in spec
    tables.write_exchange_folder(pairs, cand, str(tmp_path / "z"), males=7, equal=True, targets={"target": 0.01})
    spec = [tuple(x.strip() for x in r.split(",")) for r in (tmp_path / "z" / "Spec.txt").read_text().splitlines()]
    assert spec[5:] == [("NumberOfMaleParents", "7"), ("EqualizeMaleContributions", "Yes"), ("NumberOfFemaleParents", "1"), ("EqualizeFemaleContributions", "Yes"), ("TargetCoancestry", "0.01"), ("Stop",)]
    with pytest.raises(InputError):
        tables.write_exchange_folder(pairs, cand.withColumn("male", F.lit(None).cast("boolean")), str(tmp_path / "y"))
    tables.write_vector(spark.createDataFrame([(1, 2.0), (0, 1.0)], "i int, value double"), "gebv", str(tmp_path / "v.csv"))
    assert [r.value for r in tables.read_vector(spark, str(tmp_path / "v.csv"), True).orderBy("i").collect()] == [1.0, 2.0]


def test_report_names_what_fails():
    row = {"all_solved": True, "monotone": False, "max_ridge": 1e-2, "max_n": 1000, "exponent": 3.3, "verdict": "NO-GO"}
    text = tables.verdict_markdown(row, {"max_n": 10000}, [{"n": 5, "seconds": 0.5}], [{"k": 0.1, "gain": 1.0}])
    holds = {x.split("|")[1].strip(): x.split("|")[4].strip() for x in text.splitlines() if x.startswith("|") and x.count("|") == 5}
    assert holds["all_solved"] == "yes" and {holds[k] for k in ("monotone", "max_ridge", "max_n")} == {"no"} and holds["exponent"] == "yes"
    assert "marginally super-cubic" in text and "## Sizes" in text and "| 0.1 | 1 |" in text


def test_unknown_sex_codes_are_an_error(spark):
    from herdplan.functions import recoded_sex

    df = spark.createDataFrame([(" Male ",), ("2",), (None,)], "sex string")
    assert [r.m for r in df.select(recoded_sex(F.col("sex")).alias("m")).collect()] == [True, False, None]
    with pytest.raises(Exception, match="unknown sex code"):
        spark.createDataFrame([("x",)], "sex string").select(recoded_sex(F.col("sex"))).collect()


def test_ranks_of_odd_numbers(spark):
    from herdplan.operators import report

    values = [3.0, 1.0, 1.0, float("inf"), -float("inf"), float("nan"), 2.5, 3.0, 3.0, 1e9, float("nan")]
    got = {str(r.x): r.rank for r in report.average_ranks(spark.createDataFrame([(v,) for v in values], "x double"), "x", "rank", 4).collect()}
    assert got == {"-inf": 1.0, "1.0": 2.5, "2.5": 4.0, "3.0": 6.0, "1000000000.0": 8.0, "inf": 9.0, "nan": 10.5}
    one = report.same_support(spark.createDataFrame([(1, 0.5), (2, 0.5)], "candidate_id long, c double"), spark.createDataFrame([(1, 0.4), (3, 0.6)], "candidate_id long, c double")).first()
    assert not one.same and one.apart == pytest.approx(0.6)
