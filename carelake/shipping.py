"""Gives executors this package, for functions that run in Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the Python path of the session's workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="carelake-")).resolve()
    atexit.register(shutil.rmtree, folder, True)
    archive = folder / f"{home.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
