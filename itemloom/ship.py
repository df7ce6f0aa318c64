"""Send the package to the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

NAME = "itemloom-package.zip"


def ship(spark: SparkSession) -> None:
    """Python workers can import the package afterwards, wherever they run; once per Spark context."""
    sc = spark.sparkContext
    if NAME not in (sc._python_includes or []):
        at = Path(__file__).resolve().parent
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/{NAME.removesuffix('.zip')}", "zip", at.parent, at.name)
        sc.addPyFile(made)
