"""The matcher by itself: each detector's cases with explicit times and watermarks, boundaries and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.operators import detectors as D
from vigil.operators.cep import alerts_of
from vigil.operators.matcher import Matcher
from vigil.plans.pattern import Pattern
from vigil.schema import HOUR, MINUTE

T0 = 1_753_920_000_000
LONDON, SINGAPORE, PARIS = (51.5074, -0.1278), (1.3521, 103.8198), (48.8566, 2.3522)


def auth(amount, approved, ts, at=LONDON, present=False):
    return {"type": "auth", "amount": amount, "approved": approved, "present": present, "lat": at[0], "lon": at[1], "country": "GB", "ts": T0 + int(ts)}


def acct(kind, ts, amount=0.0):
    return {"type": kind, "amount": amount, "approved": False, "present": False, "lat": 0.0, "lon": 0.0, "country": "", "ts": T0 + int(ts)}


def holds(condition, e):
    """The few SQL conditions of detectors, read as Python."""
    return bool(eval(condition.replace(" = ", " == "), {}, e))  # noqa: S307


def run(detector, events, watermarks=(), end=None):
    """Alerts; ``watermarks``: for each event, the watermark after it."""
    m, out = Matcher(detector.pattern), []
    for i, e in enumerate(events):
        e = {**e, "id": i}
        bits = sum(holds(s.condition, e) << k for k, s in enumerate(detector.pattern.steps))
        out += alerts_of(detector, "x", 1, m.on_event(e, e["ts"], bits))
        if i < len(watermarks):
            out += alerts_of(detector, "x", 1, m.advance(watermarks[i]))
    if end is not None:
        out += alerts_of(detector, "x", 1, m.advance(end))
    return out


def test_card_testing():
    probes = [auth(0.5 + 0.2 * i, False, i * MINUTE) for i in range(6)]
    found = run(D.card_testing(), [*probes, auth(486.31, True, 6 * MINUTE)])
    assert [(a[0], a[3], a[4]) for a in found] == [("card_testing", T0 + 6 * MINUTE, "6 probes then 486.31 approved")]
    assert not run(D.card_testing(), [*[auth(1.0, False, i * MINUTE) for i in range(3)], auth(486.31, True, 3 * MINUTE)])
    assert not run(D.card_testing(), [*[auth(1.0, False, i * MINUTE) for i in range(6)], auth(30.0, True, 6 * MINUTE)])
    slow = [*[auth(1.0, False, i * 4 * MINUTE) for i in range(6)], auth(486.31, True, 24 * MINUTE)]
    assert not run(D.card_testing(), slow, [e["ts"] for e in slow])


@pytest.mark.parametrize(("probe", "strike", "alerts"), [(2.0, 250.0, 1), (2.01, 250.0, 0), (1.0, 249.99, 0), (2.0, 250.0, 1), (1.0, 250.0, 1)])
def test_card_testing_boundaries(probe, strike, alerts):
    assert len(run(D.card_testing(), [*[auth(probe, False, i * 1000) for i in range(4)], auth(strike, True, 5000)])) == alerts


def test_card_testing_ratio_and_window_edge():
    probes = [auth(2.0, False, i) for i in range(4)]
    d = D.card_testing()
    assert len(run(d, [*probes, auth(250.0, True, 10 * MINUTE)])) == 1  # the window's end is inside
    assert not run(d, [*probes, auth(250.0, True, 10 * MINUTE + 4)])
    p = Pattern.begin("p").where("approved == False").times(1, 9).followed_by("s").where_match(lambda e, c: e["amount"] >= 20 * max(x["amount"] for x in c["p"]))
    m = Matcher(p)
    m.on_event(auth(20.0, False, 0), 0, 1)
    assert not m.on_event(auth(399.99, True, 1), 1, 2)
    assert m.on_event(auth(400.0, True, 2), 2, 2)


def test_impossible_travel():
    d = D.impossible_travel()
    far = [auth(50, True, 0, LONDON, True), auth(50, True, 45 * MINUTE, SINGAPORE, True)]
    found = run(d, far)
    assert [a[3] for a in found] == [T0 + 45 * MINUTE]
    assert found[0][4] == "GB to GB, 10847.84 km at 14463.79 km/h" or "10847.8" in found[0][4]
    assert not run(d, [auth(50, True, 0, LONDON, True), auth(50, True, 50 * MINUTE, PARIS, True)])
    assert not run(d, [{**e, "present": False} for e in far])
    assert len(run(d, [auth(50, True, 0, LONDON, True), auth(50, True, 0, SINGAPORE, True)])) == 1  # no time between


def takeover(*steps):
    return run(D.account_takeover(), [acct(kind, minute * MINUTE, amount) for kind, minute, amount in steps])


def test_account_takeover():
    fails = [("login_fail", i, 0.0) for i in range(4)]
    assert [a[3] for a in takeover(*fails, ("password_change", 7, 0), ("transfer", 10, 2400.0))] == [T0 + 10 * MINUTE]
    assert not takeover(*fails, ("otp_verify", 4, 0), ("password_change", 5, 0), ("transfer", 7, 2900.0))
    assert not takeover(*fails, ("password_change", 5, 0), ("otp_verify", 5.5, 0), ("transfer", 6.5, 2900.0))
    assert not takeover(*fails[:2], ("password_change", 2, 0), ("transfer", 3, 2900.0))
    assert not takeover(*fails, ("password_change", 5, 0), ("transfer", 6, 1499.99))
    assert takeover(*fails, ("password_change", 5, 0), ("transfer", 6, 1500.0))
    # before the least number of failures a verification is ignored
    assert takeover(*fails[:2], ("otp_verify", 1.5, 0), *fails[2:], ("password_change", 5, 0), ("transfer", 6, 1500.0))


def test_otp():
    d = D.otp_never_verified(healthy=True)
    assert [(a[0], a[3]) for a in run(d, [acct("otp_request", 0)], [T0 + 6 * MINUTE])] == [("otp_never_verified", T0)]
    done = run(d, [acct("otp_request", 0), acct("otp_verify", 290_000)], end=T0 + 30 * MINUTE)
    assert [(a[0], a[3], a[4]) for a in done] == [("otp_verified_ok", T0, "")]
    later = [acct("otp_request", 0), acct("otp_request", 40 * MINUTE), acct("otp_verify", 40 * MINUTE + 45_000)]
    assert [(a[0], a[3]) for a in run(d, later, end=T0 + 100 * MINUTE)] == [("otp_never_verified", T0), ("otp_verified_ok", T0 + 40 * MINUTE)]
    two = [acct("otp_request", 0), acct("otp_request", MINUTE), acct("otp_verify", 2 * MINUTE)]
    assert len(run(d, two, end=T0 + HOUR)) == 2  # without skipping, one verification serves both
    assert not run(D.otp_never_verified(), [acct("otp_request", 0)])  # nothing tells that time has passed


def structuring(*steps, watermarks=False):
    events = [acct("transfer", hour * HOUR, amount) for hour, amount in steps]
    return run(D.structuring(), events, [e["ts"] for e in events] if watermarks else [], T0 + 1000 * HOUR)


def test_structuring():
    found = structuring((0, 850.0), (2, 920.0), (4, 880.0), (6, 940.0))
    assert [(a[3], a[4]) for a in found] == [(T0 + 6 * HOUR, "4 sub-threshold transfers totalling 3590.00")]
    assert not structuring((0, 870.0), (1, 910.0))
    assert not structuring((0, 1500.0), (1, 2000.0), (2, 1800.0), (3, 2200.0))
    assert not structuring((0, 850.0), (26, 920.0), (52, 880.0), (78, 940.0), watermarks=True)
    assert not structuring((0, 999.99), (1, 999.99), (2, 999.99))  # 2999.97
    assert not structuring((0, 1000.0), (1, 1000.0), (2, 1000.0), (3, 1000.0))  # above the band
    assert structuring((0, 800.0), (1, 800.0), (2, 800.0), (3, 800.0))
    assert not structuring((0, 799.99), (1, 800.0), (2, 800.0), (3, 800.0))


def test_pattern_is_checked():
    with pytest.raises(ValueError):
        Matcher(Pattern.begin("a").not_followed_by("b"))
    with pytest.raises(ValueError):
        Pattern.begin("a").followed_by("a")
    with pytest.raises(ValueError):
        Pattern.begin("a").times(3, 2)


PAIRS = Pattern.begin("a").followed_by("b").within(50)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from("abx")), max_size=30), st.lists(st.integers(0, 900), max_size=5))
def test_properties(gaps, marks):
    """Matches don't overlap under skip-past-last; a request is answered or times out, never both; and watermarks that
    events have passed change nothing but when timeouts come."""
    events, ts = [], 0
    for gap, kind in gaps:
        ts += gap
        events.append((ts, kind))

    def feed(pattern, watermarks=()):
        m, out = Matcher(pattern), []
        for i, (t, kind) in enumerate(events):
            for w in sorted(x for x in watermarks if x < t and (i == 0 or x >= events[i - 1][0])):
                out += m.advance(w)
            out += m.on_event({"ts": t, "id": i}, t, {"a": 1, "b": 2, "x": 0}[kind])
        return out + m.advance(1 << 60)

    spans = [(c["a"][0]["id"], c["b"][0]["id"]) for k, c in feed(PAIRS.after_match_skip_past_last()) if k == "match"]
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    free = feed(PAIRS)
    assert sorted(c["a"][0]["id"] for _, c in free) == [i for i, (_, k) in enumerate(events) if k == "a"]
    for k, c in free:
        i = c["a"][0]["id"]
        answered = any(kind == "b" and j > i and t - events[i][0] <= 50 for j, (t, kind) in enumerate(events))
        assert (k == "match") == answered
    key = lambda out: sorted((k, c["a"][0]["id"]) for k, c in out)
    assert key(feed(PAIRS, marks)) == key(free)
