"""An exactly-once store of alerts, and capture and replay of micro-batches.

A micro-batch is written into a folder of its own that its number names, replacing what a failed attempt left there, so
a batch that runs again after a restart changes nothing. Readers take only batches that the ledger lists; the ledger
entry is written last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.checks import multiset_difference


def case_store(path: str, sink_id: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that stores alerts below ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/cases/sink={sink_id}/batch={number}")
        done = batch.sparkSession.createDataFrame([(sink_id, number)], "sink string, batch long")
        done.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/{sink_id}-{number}")

    return write


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """All alerts of batches in the ledger."""
    ledger = spark.read.parquet(f"{path}/ledger/*")
    cases = spark.read.option("basePath", f"{path}/cases").parquet(f"{path}/cases")
    return cases.withColumn("batch", F.col("batch").cast("long")).join(ledger, ["sink", "batch"], "left_semi")


def captured(path: str, inner: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Keep each micro-batch's rows below ``path`` before ``inner`` gets them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={number}")
        inner(batch.sparkSession.read.parquet(f"{path}/epoch={number}"), number)

    return write


def replay(spark: SparkSession, path: str, epoch: int, operator: Callable[[DataFrame], DataFrame], recorded: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Run ``operator`` on a captured epoch; with ``recorded``, also the rows in which the two results differ."""
    result = operator(spark.read.parquet(f"{path}/epoch={epoch}"))
    return result, None if recorded is None else multiset_difference(result.select(*recorded.columns), recorded)


def emit_bundle(spark: SparkSession, path: str, epoch: int, operator: Callable[[DataFrame], DataFrame], bundle: str) -> None:
    """A regression case: an epoch's input and the result it should have."""
    rows = spark.read.parquet(f"{path}/epoch={epoch}")
    rows.write.parquet(f"{bundle}/input")
    operator(rows).write.parquet(f"{bundle}/expected")
