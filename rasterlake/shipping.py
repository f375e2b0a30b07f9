"""Makes the package importable in Python workers that would not find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, unless their path or working folder already has it.

    Where it was submitted with ``--py-files`` or installed, sending it again does no harm.
    """
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == ROOT for p in paths) or getattr(spark.sparkContext, "_rasterlake_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="rasterlake-"), "rasterlake.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted([*(ROOT / "rasterlake").rglob("*.py"), *ROOT.glob("corpus_pipeline.py")]):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._rasterlake_shipped = True
