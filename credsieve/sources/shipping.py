"""Sends this package to executors that can't import it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_credsieve_package_sent", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="credsieve-"), "credsieve_package.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    sc.addPyFile(target)
    sc._credsieve_package_sent = True
