"""Scores of findings as Columns. Each function takes the names of what it reads as keyword Columns; what is left out counts
as unknown (false, null or empty). All are CASE expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a severity is worth by itself.
EXPLOIT_BASE = {"critical": 0.80, "high": 0.65, "medium": 0.40, "low": 0.20, "info": 0.10}
RISK_BASE = {"critical": 70, "high": 55, "medium": 35, "low": 20, "info": 10}
CONFIDENCE_BASE = {"critical": 0.85, "high": 0.75, "medium": 0.55, "low": 0.35, "info": 0.20}
PARSER_BOOST = {"AST": 0.10, "CHAIN": 0.12, "CONFIRMED": 0.20, "VALIDATOR": 0.25}
IMPACT = {"PHI": 400_000, "PCI": 500_000, "PII": 250_000, "Confidential": 150_000}
REACH_DISCOUNT = {"public-route": 1.0, "route": 0.9, "route-via-function": 0.7, "function": 0.5, "function-not-route": 0.4, "unknown": 0.3, "unreachable": 0.05}


def lookup(value: Column, table: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def _yes(flag: Column | None) -> Column:
    return F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))


def _clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def _up(x: Column, digits: int) -> Column:
    """Half away from zero at the given digits, without the surprises of binary fractions just under a half."""
    return F.round(F.round(x, 9), digits)


def exploitability(severity: Column, *, route_rooted=None, reachable=None, guarded=None, sanitized=None, mismatch=None, kev=None, epss=None, exploited_now=None, csp=None, family=None, helmet=None, waf=None, has_auth=None) -> Column:
    """0 to 1, two digits. Steps are taken in this order, so floors may still lose to later reductions."""
    s = lookup(severity, EXPLOIT_BASE, 0.30)
    reach = F.lit(0.0) if reachable is None else F.when(reachable, 0.10).when(~reachable, -0.20).otherwise(0.0)
    s = s + F.when(_yes(route_rooted), 0.20).otherwise(reach) - F.when(_yes(guarded), 0.15).otherwise(0.0)
    s = F.when(_yes(sanitized), F.least(s, F.lit(0.10))).otherwise(s) + F.when(_yes(mismatch), 0.10).otherwise(0.0)
    s = F.when(_yes(kev), F.greatest(s, F.lit(0.92))).otherwise(s)
    hot = _yes(exploited_now) | (F.lit(False) if epss is None else F.coalesce(epss >= 0.95, F.lit(False)))
    s = F.when(hot, F.greatest(s, F.lit(0.85))).otherwise(s)
    xss = F.lit(False) if family is None else F.coalesce(F.lower(family).contains("xss"), F.lit(False))
    s = s - F.when(_yes(csp) & xss, 0.10).otherwise(0.0) - F.when(_yes(helmet), 0.05).otherwise(0.0) - F.when(_yes(waf), 0.05).otherwise(0.0)
    open_route = F.lit(False) if has_auth is None else _yes(route_rooted) & ~_yes(has_auth)
    return _up(_clamp(s + F.when(open_route, 0.10).otherwise(0.0)), 2)


def exploitability_tier(score: Column) -> Column:
    return F.when(score >= 0.80, "critical").when(score >= 0.60, "high").when(score >= 0.35, "medium").otherwise("low")


def composite_risk(severity: Column, *, exploit=None, mitigated=None, unreachable=None, toxicity=None, kev=None, exploited_now=None) -> Column:
    """0 to 100, whole: exploitability or severity, lowered in production, raised by toxicity, with floors."""
    base = lookup(severity, RISK_BASE, 10).cast("double")
    base = base if exploit is None else F.coalesce(exploit * 100, base)
    base = base * F.when(_yes(mitigated), 0.4).when(_yes(unreachable), 0.2).otherwise(1.0)
    base = base + (F.lit(0.0) if toxicity is None else F.least(F.lit(15.0), F.coalesce(toxicity, F.lit(0.0)) / 10))
    base = F.when(_yes(kev), F.greatest(base, F.lit(80.0))).otherwise(base)
    base = F.when(_yes(exploited_now), F.greatest(base, F.lit(75.0))).otherwise(base)
    return _up(_clamp(base, 0.0, 100.0), 0).cast("int")


def risk_tier(risk: Column) -> Column:
    return F.when(risk >= 85, "critical").when(risk >= 65, "high").when(risk >= 35, "medium").when(risk >= 15, "low").otherwise("minimal")


def confidence(severity: Column, *, preset=None, triage=None, parser=None, evidence=None, mismatch=None, route_rooted=None, sanitized=None, guarded=None, unreachable=None, unvalidated=None) -> Column:
    """0 to 1, three digits; a preset value stands."""
    s = lookup(severity, CONFIDENCE_BASE, 0.40)
    s = s if triage is None else F.coalesce((s + triage / 100) / 2, s)
    s = s + (F.lit(0.0) if parser is None else F.coalesce(lookup(parser, PARSER_BOOST, 0.0), F.lit(0.0)))
    for flag in (evidence, mismatch, route_rooted):
        s = s + F.when(_yes(flag), 0.05).otherwise(0.0)
    for flag, by in ((sanitized, 0.10), (guarded, 0.80), (unreachable, 0.55), (unvalidated, 0.85)):
        s = s * F.when(_yes(flag), by).otherwise(1.0)
    s = _up(_clamp(s), 3)
    return s if preset is None else F.coalesce(preset, s)


def expected_loss(probability: Column, *, data_class=None, crown_jewel=None, reach=None, sure=None) -> Column:
    """Whole units of money: chance, impact of the data at stake, discount of the way there, confidence of 0.4 at least."""
    impact = F.when(_yes(crown_jewel), 300_000).otherwise(50_000)
    impact = impact if data_class is None else F.coalesce(lookup(data_class, IMPACT, None).cast("int"), impact)
    discount = F.lit(0.3) if reach is None else F.coalesce(lookup(reach, REACH_DISCOUNT, 0.3), F.lit(0.3))
    belief = F.lit(0.8) if sure is None else F.greatest(F.lit(0.4), F.coalesce(sure, F.lit(0.8)))
    return _up(F.coalesce(probability, F.lit(0.05)) * impact * discount * belief, 0).cast("long")


def through(effects: Column) -> Column:
    """Chance that taint passes sanitizers with these effects (array of 0 to 1; unknown ones, null, don't count)."""
    return F.aggregate(F.coalesce(effects, F.array().cast("array<double>")), F.lit(1.0), lambda p, e: F.when((p < 1e-6) | e.isNull(), p).otherwise(p * _clamp(1 - e)))


def step_down(severity: Column) -> Column:
    return F.when(severity == "critical", "high").when(severity == "high", "medium").when(severity == "medium", "low").when(severity == "low", "info").otherwise(severity)


def step_up(severity: Column) -> Column:
    """What an exploit in the wild does: medium and high go up one, others stay."""
    return F.when(severity == "medium", "high").when(severity == "high", "critical").otherwise(severity)


def version_bump(old: Column, new: Column) -> Column:
    """major, minor, patch or same, by the numbers of both versions; null where one has none."""
    part = lambda v, i: F.regexp_extract(v, r"^[^0-9]*([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?", i)
    known = (part(old, 1) != "") & (part(new, 1) != "")
    number = lambda v, i: F.coalesce(F.nullif(part(v, i), F.lit("")).cast("long"), F.lit(0))
    differ = [number(old, i) != number(new, i) for i in (1, 2, 3)]
    return F.when(known, F.when(differ[0], "major").when(differ[1], "minor").when(differ[2], "patch").otherwise("same"))


def dependency_verdict(severity: Column, bump: Column, *, suppressed=None, kev=None, reachable=None, mitigated=None, frozen=None, exploited=None, epss=None, tests=None) -> Column:
    """What to do with an upgrade; the first rule that holds wins. ``bump`` is null where there is no fix."""
    hot = _yes(exploited) | (F.lit(False) if epss is None else F.coalesce(epss >= 0.95, F.lit(False)))
    reached = _yes(reachable)
    unreached = F.lit(False) if reachable is None else F.coalesce(~reachable, F.lit(False))
    auto, manual, accept = F.lit("AUTO_MERGE_PATCH"), F.lit("MANUAL_REVIEW"), F.lit("ACCEPT_RISK")
    return (
        F.when(_yes(suppressed), accept).when(bump.isNull(), F.lit("WAIT_FOR_PATCH"))
        .when(_yes(kev) & reached, F.when(bump.isin("patch", "minor"), auto).otherwise(manual))
        .when(_yes(mitigated) | unreached, accept).when(_yes(frozen) | (bump == "major"), manual)
        .when((bump == "patch") & severity.isin("high", "critical"), auto).when(hot & reached, auto)
        .when((bump == "minor") & (severity == "critical") & _yes(tests), auto).otherwise(manual)
    )
