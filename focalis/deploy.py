"""Ships the package to Python workers, for clusters on which it is not installed."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once a context. Spark's own file server hands it out."""
    context = spark.sparkContext
    if getattr(context, "_focalis_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(context._temp_dir) / "focalis.zip"  # goes with the context
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(path))
    context._focalis_shipped = True
