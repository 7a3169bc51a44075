"""The package on the workers: kernels are sent by reference, so workers must be able to import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_NAME = "helixmill_package.zip"


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources to the session's Python files, once."""
    context = spark.sparkContext
    if not any(str(x).endswith(_NAME) for x in context._python_includes):
        root = Path(__file__).resolve().parent.parent
        if root.suffix == ".zip" or not root.is_dir():
            return spark  # it was shipped already
        path = Path(tempfile.mkdtemp()) / _NAME
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, Path(root.name) / f.relative_to(root))
        context.addPyFile(str(path))
    return spark
