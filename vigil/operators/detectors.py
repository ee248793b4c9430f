"""The card-fraud detectors. One definition serves batch and streaming."""

from __future__ import annotations

from vigil.functions.scalars import distance_km
from vigil.operators.cep import Detector
from vigil.plans.pattern import Captures, Event, Pattern
from vigil.schema import HOUR, MINUTE

#: The thresholds. The words of the details below are fixed too.
PROBE_MAX, STRIKE_MIN, STRIKE_VS_PROBE = 2.00, 250.00, 20.0
TRAVEL_KMH, TRAVEL_MIN_KM = 900.0, 200.0
DRAIN_MIN = 1500.00
STRUCT_LOW, STRUCT_HIGH, STRUCT_TOTAL = 800.00, 1000.00, 3000.00


def _first(c: Captures, step: str) -> Event:
    return c[step][0]


def card_testing() -> Detector:
    """Several small declined probes, then an approved strike that dwarfs them."""
    pattern = (
        Pattern.begin("probes").where(f"type = 'auth' and not approved and amount <= {PROBE_MAX}").times(4, 20)
        .followed_by("strike").where(f"type = 'auth' and approved and amount >= {STRIKE_MIN}")
        .where_match(lambda e, c: e["amount"] >= STRIKE_VS_PROBE * max(p["amount"] for p in c["probes"]))
        .within(10 * MINUTE).after_match_skip_past_last()
    )

    def alert(c: Captures) -> tuple[int, str]:
        s = _first(c, "strike")
        return s["ts"], f"{len(c['probes'])} probes then {s['amount']:.2f} approved"

    return Detector("card_testing", "card", "card", pattern, ("type", "approved", "amount"), alert)


def _travel(a: Event, b: Event) -> tuple[float, float]:
    km = distance_km(a["lat"], a["lon"], b["lat"], b["lon"])
    return km, km / (max(b["ts"] - a["ts"], 1) / HOUR)


def impossible_travel() -> Detector:
    """Two card-present purchases too far apart for the time between them."""
    seen = "type = 'auth' and approved and present"

    def too_fast(e: Event, c: Captures) -> bool:
        km, kmh = _travel(c["a"][0], e)
        return km >= TRAVEL_MIN_KM and kmh > TRAVEL_KMH

    pattern = Pattern.begin("a").where(seen).followed_by("b").where(seen).where_match(too_fast).within(6 * HOUR).after_match_skip_past_last()

    def alert(c: Captures) -> tuple[int, str]:
        a, b = _first(c, "a"), _first(c, "b")
        km, kmh = _travel(a, b)
        return b["ts"], f"{a['country']} to {b['country']}, {km:.2f} km at {kmh:.2f} km/h"

    return Detector("impossible_travel", "card", "card", pattern, ("lat", "lon", "country"), alert)


def account_takeover() -> Detector:
    """Failed logins, a password change and a drain, with no verification anywhere between."""
    verified = "type = 'otp_verify'"
    pattern = (
        Pattern.begin("fails").where("type = 'login_fail'").times(3, 8)
        .not_followed_by("verified").where(verified)
        .followed_by("change").where("type = 'password_change'")
        .not_followed_by("verified_later").where(verified)
        .followed_by("drain").where(f"type = 'transfer' and amount >= {DRAIN_MIN}")
        .within(30 * MINUTE).after_match_skip_past_last()
    )

    def alert(c: Captures) -> tuple[int, str]:
        d = _first(c, "drain")
        return d["ts"], f"{len(c['fails'])} failed logins, password change, then {d['amount']:.2f} out, no OTP"

    return Detector("account_takeover", "account", "account", pattern, ("amount",), alert)


def otp_never_verified(healthy: bool = False) -> Detector:
    """A one-time password that is requested and not verified in time; ``healthy`` adds those that are."""
    pattern = Pattern.begin("request").where("type = 'otp_request'").followed_by("verify").where("type = 'otp_verify'").within(5 * MINUTE)
    return Detector(
        "otp_never_verified", "account", "account", pattern, (),
        on_match=(lambda c: (c["request"][0]["ts"], "")) if healthy else None,
        on_timeout=lambda c: (c["request"][0]["ts"], "otp requested, never verified within 5 min"),
        match_name="otp_verified_ok",
    )


def structuring() -> Detector:
    """Transfers just below a threshold whose running total trips it."""
    band = f"type = 'transfer' and amount >= {STRUCT_LOW} and amount < {STRUCT_HIGH}"

    def total(e: Event, c: Captures) -> float:
        return sum(x["amount"] for x in c.get("parts", ())) + e["amount"]

    pattern = (
        Pattern.begin("parts").where(band).where_match(lambda e, c: total(e, c) < STRUCT_TOTAL).times(2, 12)
        .followed_by("trip").where(band).where_match(lambda e, c: total(e, c) >= STRUCT_TOTAL)
        .within(24 * HOUR).after_match_skip_past_last()
    )

    def alert(c: Captures) -> tuple[int, str]:
        t = _first(c, "trip")
        return t["ts"], f"{len(c['parts']) + 1} sub-threshold transfers totalling {total(t, c):.2f}"

    return Detector("structuring", "account", "account", pattern, ("amount",), alert)


def all_detectors(healthy: bool = False) -> list[Detector]:
    return [card_testing(), impossible_travel(), account_takeover(), otp_never_verified(healthy), structuring()]
