"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once.

    Not needed where workers find it by PYTHONPATH or the working folder.
    """
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if any(Path(p).resolve() == ROOT for p in [*known, os.getcwd()]):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    # Spark serves the file for as long as the application runs.
    path = Path(tempfile.mkdtemp(prefix="graphloom-")) / f"graphloom-{app}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "graphloom").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
