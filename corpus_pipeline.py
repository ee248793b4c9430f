"""A corpus pipeline of five stages over ``documents``.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.

Defined results: rows are decided on by id and text, so null or repeated ids do no harm; null, empty and short texts are
rejected by the first stage; of rows that repeat one stays; a null source is a source of its own; extra columns stay; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import decontaminate, mixing, near_copies, quality, sharding
from vigil.plans import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id: SimHash and covering masks, an exact
    check, and an exact way for links beyond the fingerprints' radius."""
    return near_copies.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its shard."""
    return sharding.placed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]


#: The stages hash, fit and follow links, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        path = scratch.folder(spark)
        with scratch.owned(), scratch.cleaned(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if before is not None:
            scratch.delete(before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
        scratch.track(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
