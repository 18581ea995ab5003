"""Ships the package to Python workers, which may start anywhere and know nothing of the driver's import path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_siglake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="siglake-")) / "siglake_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._siglake_shipped = True
