"""Comparing alerts with what was expected: a multiset of (pattern, entity_kind, entity_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["pattern", "entity_kind", "entity_id"]


def counts(alerts: DataFrame) -> DataFrame:
    """Alerts per pattern."""
    return alerts.groupBy("pattern").agg(F.count("*").alias("alerts"))


def differences(alerts: DataFrame, expected: DataFrame, only_patterns: list[str] | None = None) -> DataFrame:
    """Keys whose numbers of alerts differ: KEY, n_actual, n_expected. Empty means equal."""
    if only_patterns is not None:
        alerts, expected = (x.filter(F.col("pattern").isin(only_patterns)) for x in (alerts, expected))
    a = alerts.groupBy(*KEY).agg(F.count("*").alias("n_actual"))
    e = expected.groupBy(*KEY).agg(F.count("*").alias("n_expected"))
    both = a.join(e, KEY, "full").na.fill(0, ["n_actual", "n_expected"])
    return both.filter(F.col("n_actual") != F.col("n_expected"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other doesn't have as often, with the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def loud_controls(alerts: DataFrame, controls: DataFrame) -> DataFrame:
    """Alerts of entities that should have none."""
    return alerts.join(controls.select(*KEY), KEY, "left_semi")
