"""Make this package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_herdplan_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="herdplan-src-")) / "herdplan.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_HERE.rglob("*.py")):
            z.write(p, p.relative_to(_HERE.parent))
    sc.addPyFile(str(archive))
    sc._herdplan_shipped = True
