"""Intermediate tables in the folder that driver and executors share.

A long plan is cut by writing a table and reading it back, so that a lost executor costs a reread and not a
recomputation. The folder is the one the cluster names in ``spark.checkpoint.dir``; only on a local master, where
driver and executors are one process, does a temporary folder take its place if that is unset.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: The tables that are not deleted yet, and the session of each.
_left: dict[str, SparkSession] = {}
#: Spark then deletes the shuffle files of a query when it ends, and not when its driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """A new, unused path below the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset: on {master} it must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="vigil-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = f"file://{_own[0]}"
    return f"{root.rstrip('/')}/vigil-{uuid.uuid4().hex}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files. For queries that are run once."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the reread table."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    with cleaned(spark):
        df.write.parquet(path)
    _left[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.vg_path = path
    return out


def track(spark: SparkSession, path: str) -> None:
    """A path from ``folder`` that was written by other means, to be deleted like a table."""
    _left[path] = spark


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``table`` that no plan reads any more."""
    for df in tables:
        delete(df.vg_path)


def delete(path: str) -> None:
    spark = _left.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns as a table; the tables made on the way are deleted."""
    before = set(_left)
    out = table(make())
    for path in set(_left) - before - {out.vg_path}:
        delete(path)
    return out


@contextmanager
def owned() -> Iterator[None]:
    """Tables made inside are deleted at the end. What operators return is lazy and reads such tables, so the results
    must be written inside too."""
    before = set(_left)
    try:
        yield
    finally:
        for path in set(_left) - before:
            delete(path)


@atexit.register
def _at_end() -> None:
    """Tables that lazy results read go when the driver's Python ends, if its Spark is still there."""
    for path, spark in list(_left.items()):
        if spark.sparkContext._jsc is None:
            _left.pop(path)
            continue
        try:
            delete(path)
        except (OSError, Py4JError):  # the JVM ended first
            return
