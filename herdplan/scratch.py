"""A folder that driver and executors share, and files in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths that shared_folder has given out.
_FOLDERS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below the session's ``spark.checkpoint.dir``; where that is
    unset, a local session takes and sets a temporary folder, and one on a
    cluster is an error."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="herdplan-")
        sc.setCheckpointDir(base)
    _FOLDERS.append(f"{base.rstrip('/')}/herdplan-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def drop_folders(spark: SparkSession) -> int:
    """Deletes the folders that this process was given; call it when no result that
    reads from there is needed any more. How many were there."""
    n = 0
    while _FOLDERS:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        n += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    return n


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: what a loop needs so that its plan
    stays small and a lost executor costs one step."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession).rsplit("/", 1)[0])
    return df.checkpoint()


def arrow_store(path: str):
    """(file system of Arrow, path on it) of a local path or a URI; tasks have no
    other way to ranges of a file."""
    from pyarrow import fs

    path = re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][\w+.-]*:", path) else (fs.LocalFileSystem(), path)


def _open(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, on whatever store the path names."""
    out = _open(spark, path)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()


def put_lines(lines: DataFrame, path: str) -> None:
    """The only column of ``lines``, in order, as one file: partition after
    partition passes through the driver, for tools that read single files."""
    out = _open(lines.sparkSession, path)
    try:
        for row in lines.toLocalIterator():
            out.write(bytearray((row[0] + "\n").encode()))
    finally:
        out.close()


def put_rows(rows: DataFrame, path: str, head: bytes = b"") -> None:
    """The only, binary column of ``rows``, in order, after ``head``, as one file;
    a partition at a time is with the driver."""
    out = _open(rows.sparkSession, path)
    try:
        out.write(bytearray(head))
        for row in rows.toLocalIterator():
            out.write(bytearray(row[0]))
    finally:
        out.close()
