"""Decay, weights and rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Weights of the six signals, and of the four tiers.
SIGNAL_WEIGHTS = {"frequency": 0.24, "relevance": 0.30, "diversity": 0.15, "recency": 0.15, "consolidation": 0.10, "richness": 0.06}
TIER_WEIGHTS = {"working": 1.0, "episodic": 0.7, "semantic": 0.8, "procedural": 0.6}
PROMOTE, MAINTAIN = 0.6, 0.3


def half_life_decay(mtime: str | Column, now: float, half_life_days: float) -> Column:
    """exp(-ln 2 * age / half-life) with ages below 0 as 0; 0 without a time or a half-life."""
    age = F.greatest(F.lit(0.0), (F.lit(now) - col(mtime)) / 86400.0)
    return F.when((col(mtime) <= 0) | F.lit(half_life_days <= 0), 0.0).otherwise(F.exp(-math.log(2) * age / (half_life_days or 1.0)))


def weekly_decay(last_seen: str | Column, now: float) -> Column:
    """exp(-0.693 * age / 7), ages as they are."""
    return F.exp(F.lit(-0.693) * ((F.lit(now) - col(last_seen)) / 86400.0) / 7)


def micro(x: str | Column) -> Column:
    """A double in millionths as a long, rounded half up the same way in any engine."""
    return F.floor(col(x) * 1e6 + 0.5).cast("long")


def half_even(x: str | Column, digits: int) -> Column:
    return F.bround(col(x), digits)


def verdict(score: str | Column) -> Column:
    """promote, maintain or prune, by the score rounded to three digits."""
    s = half_even(score, 3)
    return F.when(s >= PROMOTE, "promote").when(s >= MAINTAIN, "maintain").otherwise("prune")
