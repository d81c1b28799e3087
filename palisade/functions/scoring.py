"""Confidence, verdict and priority scalars as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_up

#: Evidence levels in ascending order.
LEVELS = ["static", "reachable", "triggered", "demonstrated", "verified"]


def confidence_floor(values: Column) -> Column:
    """The least confidence of an array; 0.1 where there is none."""
    return F.coalesce(F.array_min(values), F.lit(0.1))


def ceiling(verdict: Column, tier: Column, tools: Column) -> Column:
    """Highest confidence a verdict allows; null: none."""
    open_ = F.when(tier == "fallback", 55).when(tools == 0, 40).when(tools == 1, 60).otherwise(75)
    return F.when(verdict == "PROVEN", F.lit(None).cast("int")).when(verdict == "UNPROVEN", 25).when(verdict == "NOT_REPRODUCIBLE", 35).when(verdict.isin("INCONCLUSIVE", "SKIPPED"), open_).otherwise(40)


def clamped(confidence: Column, verdict: Column, tier: Column, tools: Column) -> Column:
    top = ceiling(verdict, tier, tools)
    return half_up(F.when(verdict == "PROVEN", F.greatest(confidence, F.lit(80.0))).otherwise(F.least(confidence, top.cast("double")))).cast("int")


def evidence_tag(flags: list[tuple[str, Column]]) -> Column:
    names = F.filter(F.array(*[F.when(f, F.lit(n)) for n, f in flags]), lambda x: x.isNotNull())
    return F.when(F.size(names) == 0, F.lit("llm-only")).otherwise(F.array_join(names, "+"))


def level_max(a: Column, b: Column) -> Column:
    rank = F.array(*[F.lit(x) for x in LEVELS])
    return F.element_at(rank, F.greatest(F.array_position(rank, a), F.array_position(rank, b), F.lit(1)).cast("int"))


def priority(cvss: Column, epss: Column, kev: Column, exploit: Column, direct: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    bonus = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    score = F.least(zero(cvss) / 10.0 * 40.0, F.lit(40.0)) + F.least(zero(epss) / 100.0 * 25.0, F.lit(25.0)) + bonus(kev, 20) + bonus(exploit, 10) + bonus(direct, 5)
    return F.least(half_up(score), F.lit(100)).cast("int")


def priority_label(p: Column) -> Column:
    return F.when(p >= 75, "critical").when(p >= 50, "high").when(p >= 25, "medium").otherwise("low")


def first_reason(cases: list[tuple[Column, str]]) -> Column:
    """The name of the first condition that holds; null: none."""
    return reduce(lambda rest, c: F.when(c[0], F.lit(c[1])).otherwise(rest), reversed(cases), F.lit(None).cast("string"))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)
