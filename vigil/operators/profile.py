"""Risk profiles by card: a fold of all purchases, point lookups, bounded scans and their JSON form.

The fold doesn't depend on the order of events: the last country is that of the latest event time, and of equal times
that of the later arrival (the larger id). The same aggregation runs on a stream, whose state is read where it is.
"""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.scalars import risk_score

#: The name of the state and the version of its schema, for the compatibility check.
STATE_TYPE, VERSION = "cs-risk-profile.profile", 2


def profiles(events: DataFrame) -> DataFrame:
    """One row per card: the fields of PROFILE_V2 and the score."""
    folded = (
        events.filter(F.col("type") == "auth")
        .groupBy("card")
        .agg(
            F.count("*").alias("auths"),
            F.count_if(~F.col("approved")).alias("declines"),
            F.sum("amount").alias("total"),
            F.greatest(F.lit(0.0), F.max("amount")).alias("max_amount"),
            F.greatest(F.lit(0), F.max("ts")).alias("last_ts"),
            F.max_by("country", F.struct("ts", "id")).alias("last_country"),
            F.min("ts").alias("first_ts"),
        )
    )
    return folded.withColumn("score", risk_score(F.col("declines"), F.col("max_amount")))


def in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The profiles in the state of a streaming query of ``profiles``, as of its last micro-batch, for ``lookup``, ``scan``
    and ``server``. The query may be running."""
    state = spark.read.format("statestore").load(checkpoint)
    # the buffers of the aggregates, in their order; cast whole, as their own names repeat and so can't be read apart
    buffers = "auths long, declines long, total double, max_amount double, last_ts long, last_country string, order struct<ts: long, id: long>, first_ts long"
    rows = state.select("key.card", F.col("value").cast(T.StructType.fromDDL(buffers)).alias("v")).select("card", "v.*")
    rows = rows.withColumns({"max_amount": F.greatest(F.lit(0.0), "max_amount"), "last_ts": F.greatest(F.lit(0).cast("long"), "last_ts")}).drop("order")
    return rows.withColumn("score", risk_score(F.col("declines"), F.col("max_amount")))


def lookup(table: DataFrame, key: str) -> dict | None:
    """The profile of a card; None for a key that is absent or doesn't begin with a number. What follows the number is
    not looked at."""
    number = re.match(r"[ \t\n\v\f\r]*([+-]?[0-9]+)", key)
    if not number or not -(2**63) <= int(number[1]) < 2**63:
        return None
    row = table.filter(F.col("card") == int(number[1])).first()
    return row and row.asDict()


def scan(table: DataFrame, limit: int) -> tuple[list[dict], bool]:
    """Up to ``limit`` profiles by card, and whether there are more."""
    rows = [r.asDict() for r in table.orderBy("card").limit(limit + 1).collect()]
    return rows[:limit], len(rows) > limit


def to_json(p: dict) -> str:
    """A profile with its money fields to two decimals."""
    text = "{" + f'"card":{p["card"]},"auths":{p["auths"]},"declines":{p["declines"]},"total":{p["total"]:.2f},"max_amount":{p["max_amount"]:.2f},'
    return text + f'"last_ts":{p["last_ts"]},"last_country":{json.dumps(p["last_country"])},"score":{p["score"]}' + "}"


def server(table: DataFrame, port: int = 0) -> HTTPServer:
    """A server of ``/profile?key=`` and ``/scan?limit=`` on the local host; start it with serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            url = urlparse(self.path)
            args = parse_qs(url.query)
            if url.path == "/profile" and (found := lookup(table, args.get("key", [""])[0])):
                body = to_json(found)
            elif url.path == "/scan":
                limit = args.get("limit", ["100"])[0]
                if not limit.isdecimal():
                    self.send_error(400, "limit is no number")
                    return
                entries, more = scan(table, int(limit))
                body = '{"entries":[' + ",".join(map(to_json, entries)) + f'],"truncated":{json.dumps(more)}' + "}"
            else:
                self.send_error(404)
                return
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args: object) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)
