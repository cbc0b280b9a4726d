"""Helpers shared by the operators of this package: tables, scratch space, folds."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: White space of the text contracts: ASCII space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Paths that scratch_dir has given out.
_SCRATCH: list[str] = []

#: Bytes of one Arrow batch sent to a Python worker.
ARROW_BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, read through Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers, and bound Arrow batches by bytes, so
    that a batch of very long texts stays small."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that the cluster shares.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset,
    a local session (as in tests) takes and sets a temporary folder, and one on
    a cluster is an error, as its executors would not see that folder.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="herdplan-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/herdplan-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Deletes what this process wrote to the shared folder; call it when no
    result that reads from there is needed any more. How many paths went."""
    n = 0
    while _SCRATCH:
        n += _delete(spark, _SCRATCH.pop())
    return n


def materialised(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage
    that survives lost executors and fixes what is not deterministic."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    (df.coalesce(files) if files else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables that ``materialised`` wrote and nothing reads any more;
    other frames are left alone."""
    for df in frames:
        path = vars(df).get("_scratch_path")
        if path in _SCRATCH:
            _SCRATCH.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def frugal(run: Callable) -> Callable:
    """A function of batches whose worker, at its end, gives freed memory back
    to the system: workers live on and serve other stages."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return out


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (null ids: of '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
