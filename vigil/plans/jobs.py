"""Jobs by name, for ``python -m vigil`` and spark-submit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vigil.operators import detectors, profile
from vigil.operators.cep import FOREVER, detect
from vigil.operators.rules import rule_hits
from vigil.sources import records


@dataclass(frozen=True)
class Job:
    name: str
    version: str
    description: str
    build: Callable[..., DataFrame]


JOBS: dict[str, Job] = {}


def job(name: str, version: str, description: str) -> Callable:
    """Register a function (spark, events path, rules path or None) that returns the job's result."""

    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in JOBS:
            raise ValueError(f"a job is named {name} already")
        JOBS[name] = Job(name, version, description, build)
        return build

    return register


@job("detect", "1", "all detectors over a bounded tape")
def detect_tape(spark: SparkSession, events: str, rules: str | None = None) -> DataFrame:
    rows = records.read_events(spark, events)
    alerts = detect(rows, detectors.all_detectors(), complete_to=FOREVER)
    return alerts if rules is None else alerts.unionByName(rule_hits(rows, records.read_rules(spark, rules)))


@job("profiles", "1", "risk profiles of all cards")
def profile_tape(spark: SparkSession, events: str, rules: str | None = None) -> DataFrame:
    return profile.profiles(records.read_events(spark, events))
