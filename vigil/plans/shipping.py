"""Sending this package to Python workers that can't import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root, out = Path(__file__).resolve().parents[1], tempfile.mkdtemp(prefix="vigil-zip-")
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    tree = Path(out, "tree", root.name)
    shutil.copytree(root, tree, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(out, root.name), "zip", tree.parent))
    shutil.rmtree(tree)
    _sent.add(sc.applicationId)
