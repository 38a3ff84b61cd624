"""Makes the package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship_package(spark: SparkSession) -> None:
    """Adds the package to the application's files unless workers find it by PYTHONPATH or their working folder."""
    known = [Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    sc = spark.sparkContext
    if ROOT in known or any(str(f).endswith("/takewise.zip") for f in sc.listFiles):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "takewise.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(ROOT.glob("takewise/**/*.py")):
            out.write(source, source.relative_to(ROOT))
    sc.addPyFile(str(path))
