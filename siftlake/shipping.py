"""Gives Python workers this package where they cannot import it by themselves."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers of a session, once; not where PYTHONPATH already has its folder."""
    package = Path(__file__).resolve().parent
    context = spark.sparkContext
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(package.parent) in known or context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(package, Path(folder, "top", package.name), ignore=shutil.ignore_patterns("__pycache__"))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="siftlake-ship-"), package.name), "zip", Path(folder, "top"))
    context.addPyFile(made)
