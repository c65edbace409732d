"""Session helpers: shipping the package to executors, test sessions."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of ``spark``, once per application.

    Where the package is on PYTHONPATH (or installed) on every node this changes nothing.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="latticework-ship-")
    try:
        staging = Path(folder) / "src"
        shutil.copytree(root, staging / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        top = root.parent / "corpus_pipeline.py"
        if top.exists():
            shutil.copy(top, staging / top.name)
        archive = shutil.make_archive(os.path.join(folder, "latticework-src"), "zip", staging)
        context.addPyFile(archive)
    finally:
        shutil.rmtree(Path(folder) / "src", ignore_errors=True)
    _shipped.add(context.applicationId)
