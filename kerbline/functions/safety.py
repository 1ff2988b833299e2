"""Expressions of car-following safety: gap, headway, time to collision, required deceleration, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.params import Params

# What is written where a quantity does not exist.
NO_TTC = 99.0
NO_HEADWAY = 99.0
NO_DRAC = float("inf")


def protected_divide(numerator: Column, denominator: Column, default: float = NO_HEADWAY) -> Column:
    """Quotient; ``default`` for a zero denominator; null for a missing operand."""
    return F.when(denominator == 0, F.lit(default)).otherwise(numerator / denominator)


def gap(leader_s: Column, s: Column, leader_width: Column, width: Column) -> Column:
    return leader_s - s - F.lit(0.5) * (leader_width + width)


def positive_part(value: Column) -> Column:
    """max(value, 0) that stays null for null (``greatest`` would give 0)."""
    return F.when(value > 0, value).when(value.isNotNull(), F.lit(0.0).cast("float"))


def drac(gap_m: Column, closing_speed: Column, reaction_time: float = 1.0) -> Column:
    """Deceleration that just avoids a crash once the reaction time has passed."""
    remaining = gap_m - positive_part(closing_speed) * F.lit(float(reaction_time))
    return F.when(remaining > 0, closing_speed * closing_speed / (2 * remaining)).otherwise(F.lit(NO_DRAC)).cast("float")


def risk_level(ttc: Column, p: Params) -> Column:
    return (
        F.when(ttc < p.ttc_high_risk, F.lit(2)).when(ttc < p.ttc_low_risk, F.lit(1)).otherwise(F.lit(0)).cast("byte")
    )


def add_interaction(df: DataFrame) -> DataFrame:
    """Gap, relative speed and time headway, from the columns the leader join brings."""
    width = F.col("width")
    return df.withColumns({
        "dist_headway": gap(F.col("leader_s_long"), F.col("s_long"), F.col("leader_width"), width),
        "rel_velocity": F.col("v_long_smooth") - F.col("leader_v_long"),
    }).withColumn("time_headway", protected_divide(F.col("dist_headway"), F.col("v_long_smooth")).cast("float"))


def add_safety(df: DataFrame, p: Params) -> DataFrame:
    closing = F.col("rel_velocity")
    if p.recompute_safety:
        speed_gain = -closing if p.ttc_convention == "opening" else closing
        ttc = F.when(speed_gain > 0, F.col("dist_headway") / speed_gain)
        required = drac(F.col("dist_headway"), positive_part(closing), p.reaction_time)
    else:
        ttc = F.when(F.col("ttc_raw") != 0, F.col("ttc_raw"))
        required = drac(F.col("dist_headway_raw"), closing, p.reaction_time)
    return df.withColumns({
        "TTC": F.coalesce(ttc.cast("float"), F.lit(NO_TTC).cast("float")),
        "DRAC": required,
    }).withColumn("risk_level", risk_level(F.col("TTC"), p))
