"""PLINK 1 binary panels (.bed, .bim, .fam) as a Spark data source.

``spark.read.format("plink").load(prefix)`` gives long dosages (candidate_id,
marker_id, iid, dosage): one partition for each range of markers, read by ranges of
bytes, so neither driver nor any task holds the panel and a .bed may be of any size.
Filters on marker_id and candidate_id are pushed down: only the bytes of those
markers, and of a marker only those of the candidates from the least to the greatest
asked for, are read. Prefixes are local paths or URIs of the stores that Arrow's file systems
open. read_calls and read_panel take paths on any store: the .bed of one that only
Spark reads comes through its binary reader, which holds a file (up to 2 GB, so one
for each chromosome of a large panel) in a task.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..errors import FormatError
from ..functions.genetics import packed_bytes
from ..scratch import arrow_store, put_lines, put_rows
from ..shipping import ship
from .tables import text_lines

MAGIC, MARKER_MAJOR = b"\x6c\x1b", 1
#: Dosage of the first allele by 2-bit code: fixed by the format; -1 is missing.
DOSAGES = np.array([2, -1, 1, 0], np.int8)
SCHEMA = "candidate_id long, marker_id int, iid string, dosage int"
MARKERS_PER_PARTITION = 4096
#: Calls of one batch, about.
BATCH_CALLS = 1 << 18


def check_header(head: bytes, name: str) -> None:
    if len(head) < 3 or head[:2] != MAGIC:
        raise FormatError(f"{name}: not a PLINK .bed file")
    if head[2] != MARKER_MAJOR:
        raise FormatError(f"{name}: individual-major files are not read")


def individuals(lines: Iterator[str], name: str) -> list[str]:
    """Within-family ids of a .fam file, in order."""
    out = []
    for number, line in enumerate(lines, 1):
        fields = line.split()
        if not fields:
            continue
        if len(fields) < 2:
            raise FormatError(f"{name}, line {number}: two fields are needed")
        out.append(fields[1])
    if not out:
        raise FormatError(f"{name}: no individuals")
    return out


def marker_count(lines: Iterator[str], name: str) -> int:
    n = 0
    for number, line in enumerate(lines, 1):
        fields = line.split()
        if fields and len(fields) < 2:
            raise FormatError(f"{name}, line {number}: two fields are needed")
        n += bool(fields)
    if not n:
        raise FormatError(f"{name}: no markers")
    return n


def decode(packed: np.ndarray, n: int) -> np.ndarray:
    """Dosages (-1: missing) of markers' bytes; padding bits are dropped."""
    codes = np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=-1).reshape(len(packed), -1)[:, :n]
    return DOSAGES[codes]


def check_size(size: int, n: int, m: int, name: str) -> None:
    if size != 3 + m * -(-n // 4):
        raise FormatError(f"{name}: {size} bytes do not hold {n} individuals and {m} markers")


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Wanted:
    """Numbers from ``low`` to below ``high``, of ``only`` some where that is given."""

    def __init__(self, high: int):
        self.low, self.high, self.only = 0, high, None

    def take(self, f: Filter) -> bool:
        """Narrows to what a filter keeps; False for a filter of another kind."""
        whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, (EqualTo, In)):
            values = [f.value] if isinstance(f, EqualTo) else list(f.value)
            if not all(whole(v) for v in values):
                return False
            self.only = set(values) if self.only is None else self.only & set(values)
            self.low = max(self.low, min(self.only, default=self.high))
            self.high = min(self.high, max(self.only, default=-1) + 1)
            return True
        if not isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or not whole(f.value):
            return False
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        else:
            self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
        return True

    def numbers(self) -> np.ndarray:
        every = np.arange(self.low, max(self.high, self.low))
        return every if self.only is None else every[np.isin(every, list(self.only))]


def _lines(store, path: str) -> Iterator[str]:
    return io.TextIOWrapper(io.BufferedReader(store.open_input_stream(path)), encoding="utf-8")


class PlinkReader(DataSourceReader):
    def __init__(self, prefix: str, step: int):
        self.prefix, self.step = prefix, step
        store, at = arrow_store(prefix)
        self.ids = individuals(_lines(store, at + ".fam"), prefix + ".fam")
        self.m = marker_count(_lines(store, at + ".bim"), prefix + ".bim")
        with store.open_input_file(at + ".bed") as f:
            check_header(f.read_at(3, 0), prefix + ".bed")
            check_size(f.size(), len(self.ids), self.m, prefix + ".bed")
        self.markers, self.candidates = _Wanted(self.m), _Wanted(len(self.ids))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of the two ids with whole numbers; hands back others."""
        for f in filters:
            wanted = {("marker_id",): self.markers, ("candidate_id",): self.candidates}.get(tuple(getattr(f, "attribute", ())))
            if wanted is None or not wanted.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        w = self.markers
        return [_Range(i, min(w.high, i + self.step)) for i in range(w.low, w.high, self.step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        own, width = self.candidates.numbers(), -(-len(self.ids) // 4)
        markers = self.markers.numbers()
        markers = markers[(markers >= partition.first) & (markers < partition.last)]
        if not len(own) or not len(markers):
            return
        first, last = int(own[0]) // 4, int(own[-1]) // 4 + 1  # bytes of a marker that hold them
        iid = pa.array(self.ids, pa.string()).take(pa.array(own))
        store, at = arrow_store(self.prefix)
        many = max(1, BATCH_CALLS // len(own))
        with store.open_input_file(at + ".bed") as f:
            for k in range(0, len(markers), many):
                some = markers[k : k + many]
                packed = self._bytes(f, some, first, last, width)
                d = decode(packed, 4 * (last - first))[:, own - 4 * first].astype(np.int32).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(own, len(some))), pa.array(np.repeat(some, len(own)).astype(np.int32)), iid.take(pa.array(np.tile(np.arange(len(own)), len(some)))), pa.array(d, mask=d < 0)], ["candidate_id", "marker_id", "iid", "dosage"])

    @staticmethod
    def _bytes(f: pa.NativeFile, markers: np.ndarray, first: int, last: int, width: int) -> np.ndarray:
        """Bytes first to last of each marker: in one read where neighbouring markers
        are wanted whole, else a read a marker."""
        if last - first == width and markers[-1] - markers[0] + 1 == len(markers):
            return np.frombuffer(f.read_at(len(markers) * width, 3 + int(markers[0]) * width), np.uint8).reshape(-1, width)
        return np.stack([np.frombuffer(f.read_at(last - first, 3 + int(j) * width + first), np.uint8) for j in markers])


class PlinkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plink"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlinkReader:
        return PlinkReader(self.options["path"], int(self.options.get("markersPerPartition", MARKERS_PER_PARTITION)))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets it push filters down."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PlinkSource)


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """(line, place, f): fields of the non-blank lines; one field is an error."""
    rows = text_lines(spark, path).where("text <> ''").select("line", "place", F.split("text", r"\s+").alias("f"))
    short = F.raise_error(F.concat(F.lit("line "), (F.col("line") + 1).cast("string"), F.lit(": two fields are needed"))).cast("array<string>")
    return rows.withColumn("f", F.when(F.size("f") >= 2, F.col("f")).otherwise(short))


def scan_fam(spark: SparkSession, path: str) -> DataFrame:
    """(candidate_id, fid, iid) in the order of lines; short lines are an error."""
    return _fields(spark, path).select(F.col("place").cast("long").alias("candidate_id"), F.get("f", F.lit(0)).alias("fid"), F.get("f", F.lit(1)).alias("iid"))


def scan_bim(spark: SparkSession, path: str) -> DataFrame:
    """One row: the number of markers; short lines are an error."""
    return _fields(spark, path).agg(F.count_if(F.get("f", F.lit(1)).isNotNull()).cast("long").alias("markers"))


def read_calls(spark: SparkSession, prefix: str) -> DataFrame:
    """Long dosages (candidate_id, marker_id, iid, dosage) of a trio on any store."""
    try:
        arrow_store(prefix)
    except (pa.ArrowException, OSError, ImportError):  # a store that only Spark reads
        return read_through_spark(spark, prefix)
    register(spark)
    return spark.read.format("plink").load(prefix)


def read_through_spark(spark: SparkSession, prefix: str) -> DataFrame:
    """The same through Spark's binary reader, which holds the .bed in a task."""
    ship(spark)
    ids = scan_fam(spark, prefix + ".fam").select("candidate_id", "iid")
    n, m = ids.count(), scan_bim(spark, prefix + ".bim").first()["markers"]
    if not n or not m:
        raise FormatError(f"{prefix}: no individuals or no markers")

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                check_header(data[:3].tobytes(), prefix + ".bed")
                check_size(len(data), n, m, prefix + ".bed")
                packed = data[3:].reshape(m, -1)
                for marker in range(m):
                    d = decode(packed[marker : marker + 1], n)[0].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, marker, np.int32)), pa.array(d, mask=d < 0)], ["candidate_id", "marker_id", "dosage"])

    long = spark.read.format("binaryFile").load(prefix + ".bed").select("content").mapInArrow(run, "candidate_id long, marker_id int, dosage int")
    return long.join(ids, "candidate_id").select("candidate_id", "marker_id", "iid", "dosage")


class Scanned(NamedTuple):
    """A panel as plans: ids (candidate_id, iid), dosages, markers (marker_id,
    p, calls), scale (s), genotypes (candidate_id, marker_id, z)."""

    ids: DataFrame
    dosages: DataFrame
    markers: DataFrame
    scale: DataFrame
    genotypes: DataFrame


def read_panel(spark: SparkSession, prefix: str) -> Scanned:
    """A trio centred by the frequencies of its non-missing calls, missing calls
    at the mean of their marker."""
    from ..operators import panel

    dosages = read_calls(spark, prefix)
    markers = panel.allele_frequencies(dosages)
    ids = scan_fam(spark, prefix + ".fam").select("candidate_id", "iid")
    return Scanned(ids, dosages, markers, panel.vanraden_scale(markers), panel.centre(dosages, markers))


def marker_bytes(dosages: DataFrame) -> DataFrame:
    """(marker_id, bytes): the .bed rows of long dosages, candidates in the order of
    their ids, all in built-in expressions."""
    order = F.sort_array(F.collect_list(F.struct("candidate_id", "dosage")))
    code = lambda x: F.when(x["dosage"].isNull(), 1).when(x["dosage"] == 2, 0).when(x["dosage"] == 1, 2).otherwise(3)
    return dosages.groupBy("marker_id").agg(F.transform(order, code).alias("c")).select("marker_id", packed_bytes(F.col("c")).alias("bytes"))


def write_trio(dosages: DataFrame, prefix: str) -> None:
    """Writes long dosages as a trio on any store: markers are packed in tasks, and
    pass through the driver a partition at a time, as the format is one file."""
    spark = dosages.sparkSession
    put_lines(dosages.select("candidate_id").distinct().orderBy("candidate_id").select(F.concat(F.lit("F"), "candidate_id", F.lit(" I"), "candidate_id", F.lit(" 0 0 0 -9"))), prefix + ".fam")
    put_lines(dosages.select("marker_id").distinct().orderBy("marker_id").select(F.concat(F.lit("1 S"), "marker_id", F.lit(" 0 "), (F.col("marker_id") + 1).cast("string"), F.lit(" A C"))), prefix + ".bim")
    put_rows(marker_bytes(dosages).orderBy("marker_id").select("bytes"), prefix + ".bed", MAGIC + bytes([MARKER_MAJOR]))


def trio(dosage: np.ndarray) -> dict[str, bytes]:
    """The files of a small panel by suffix; -1 is missing."""
    n, m = dosage.shape
    codes = np.select([dosage == 2, dosage == 1, dosage == 0], [0, 2, 3], 1).astype(np.uint8).T
    padded = np.zeros((m, -(-n // 4) * 4), np.uint8)
    padded[:, :n] = codes
    q = padded.reshape(m, -1, 4)
    bed = MAGIC + bytes([MARKER_MAJOR]) + (q[:, :, 0] | q[:, :, 1] << 2 | q[:, :, 2] << 4 | q[:, :, 3] << 6).tobytes()
    return {".bed": bed, ".fam": "".join(f"F{i} I{i} 0 0 0 -9\n" for i in range(n)).encode(), ".bim": "".join(f"1 S{j} 0 {j + 1} A C\n" for j in range(m)).encode()}


def write(prefix: str, dosage: np.ndarray) -> None:
    """Writes the trio of a small panel."""
    for suffix, data in trio(dosage).items():
        with open(prefix + suffix, "wb") as f:
            f.write(data)
