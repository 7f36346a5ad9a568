"""Outcome rates per pitcher, type and batter side: one aggregation with all counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks.functions.constants import HARD_HIT, STRIKEOUTS, SWINGS, WHIFFS
from moundworks.functions.expressions import quoted, rounded

KEYS = ("pitcher", "pitch_type", "stand")
COUNTERS = {
    "whiffs": f"description IN ({quoted(WHIFFS)})",
    "swings": f"description IN ({quoted(SWINGS)})",
    "two_strikes": "strikes = 2",
    "strikeouts": f"strikes = 2 AND events IN ({quoted(STRIKEOUTS)})",
    "in_play": "description = 'hit_into_play' AND launch_speed IS NOT NULL",
    "hard_hit": f"description = 'hit_into_play' AND launch_speed >= {HARD_HIT}e0",
}
RATES = {"whiff_rate": ("whiffs", "swings"), "put_away_rate": ("strikeouts", "two_strikes"), "hard_hit_rate": ("hard_hit", "in_play")}


def rate(name: str) -> Column:
    """A percentage with one decimal; null without a denominator."""
    part, whole = RATES[name]
    return F.expr(rounded(f"{part} * 100e0 / nullif({whole}, 0)", 1)).alias(name)


def counters(pitches: DataFrame) -> DataFrame:
    counts = [F.sum(F.when(F.expr(e), 1).otherwise(0)).alias(c) for c, e in COUNTERS.items()]
    return pitches.groupBy(*KEYS).agg(F.count("*").alias("sample_size"), F.avg("release_speed").alias("speed"), *counts)


def outcome_stats(pitches: DataFrame) -> DataFrame:
    return counters(pitches).select(*KEYS, "sample_size", F.expr(rounded("speed", 1)).alias("avg_speed"), *map(rate, RATES))


def outcome_flags(stats: DataFrame) -> DataFrame:
    """Highlights: a whiff rate over 30, a put-away rate over 20."""
    flag = lambda c, least: F.coalesce(F.col(c) > least, F.lit(False))
    return stats.select(*KEYS, flag("whiff_rate", 30).alias("high_whiff"), flag("put_away_rate", 20).alias("high_put_away"))
