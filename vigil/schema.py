"""Record types. Times are milliseconds since the epoch; a missing value is 0, "" or false, never null."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"LONG": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType()}


def _struct(ddl: str) -> T.StructType:
    """A schema of plain columns; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


EVENT = _struct(
    "id LONG, ts LONG, type STRING, card LONG, account LONG, amount DOUBLE, approved BOOLEAN, present BOOLEAN, lat DOUBLE, lon DOUBLE, merchant STRING, country STRING"
)
ALERT = _struct("pattern STRING, entity_kind STRING, entity_id LONG, ts LONG, detail STRING")
RULE = _struct("kind STRING, merchant STRING, activate_at LONG, cap DOUBLE")
PROFILE_V1 = _struct("auths LONG, declines LONG, total DOUBLE, max_amount DOUBLE, last_ts LONG, last_country STRING")
PROFILE_V2 = T.StructType([*PROFILE_V1.fields, T.StructField("first_ts", T.LongType())])

#: The names on the wire.
EVENT_TYPES = ("auth", "transfer", "login_fail", "login_ok", "password_change", "otp_request", "otp_verify")
RULE_KINDS = ("merchant_watchlist", "merchant_cap", "end_of_rules")

MINUTE, HOUR = 60_000, 3_600_000
