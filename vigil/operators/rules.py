"""Effective-dated rules joined to events.

A rule acts on events from its ``activate_at`` on. The set counts only once it is sealed by an ``end_of_rules`` row;
without one nothing is reported. One alert is made for each matching rule. There is no broadcast hint: Spark broadcasts
the rules if their measured size allows it and else joins by merchant, splitting skewed merchants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.scalars import two_decimals
from vigil.schema import ALERT


def is_sealed(rules: DataFrame) -> bool:
    return not rules.filter(F.col("kind") == "end_of_rules").isEmpty()


def sealed(rules: DataFrame) -> DataFrame:
    """The rules of a sealed set; none of an unsealed one."""
    seals = rules.filter(F.col("kind") == "end_of_rules").agg(F.count("*")).scalar()
    return rules.filter((F.col("kind") != "end_of_rules") & (seals > 0))


def rule_hits(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts of purchases at watched merchants and of those over a merchant's cap."""
    e = events.filter(F.col("type") == "auth").select("card", "ts", "amount", "merchant")
    r = sealed(rules).select(F.col("kind"), F.col("merchant").alias("m"), "activate_at", "cap")
    watched = F.col("kind") == "merchant_watchlist"
    over = (F.col("kind") == "merchant_cap") & (F.col("amount") > F.col("cap"))
    hits = e.join(r, (F.col("merchant") == F.col("m")) & (F.col("ts") >= F.col("activate_at")) & (watched | over))
    return hits.select(
        F.when(watched, "watchlist_hit").otherwise("cap_exceeded").alias("pattern"),
        F.lit("card").alias("entity_kind"),
        F.col("card").alias("entity_id"),
        "ts",
        F.when(watched, F.concat(F.lit("auth at watchlisted "), "merchant", F.lit(" for "), two_decimals(F.col("amount"))))
        .otherwise(F.concat(F.lit("auth at "), "merchant", F.lit(" for "), two_decimals(F.col("amount")), F.lit(" over cap "), two_decimals(F.col("cap"))))
        .alias("detail"),
    ).to(ALERT)
