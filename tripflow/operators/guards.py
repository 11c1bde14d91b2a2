"""Deterministic guards on heater commands, and the log of what they changed.

A guard is a function of a command Column that returns ``struct(value, reason, fault)``.  Row guards
compose as Columns; the rate limit is the one guard with memory and runs over blocks of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.functions.scalars import clip, finite
from tripflow.operators.ordered import Series
from tripflow.operators.slew import slew

# Actuator, envelope, sensor and slew limits, and the smallest change worth a reason.
MAX_W, MAX_RATE_W_PER_S, SMALLEST_CHANGE_W = 7000.0, 2000.0, 1e-6
AMBIENT_C, SPEED_MAX_MS, CABIN_C = (-10.0, 15.0), 45.0, (-40.0, 60.0)

Guard = Callable[[Column], Column]


def _verdict(value: Column, reason: Column, fault: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), reason.cast("string").alias("reason"), fault.alias("fault"))


def actuator_clamp(max_w: float = MAX_W) -> Guard:
    """Inside [0, max]; a command that is no number becomes zero and is a fault."""
    def check(w: Column) -> Column:
        ok, held = finite(w), clip(w, 0.0, max_w)
        reason = F.when(~ok, "non-finite action").when(held != w, "actuator limit")
        return _verdict(F.when(ok, held).otherwise(F.lit(0.0)), reason, ~ok)
    return check


def input_envelope(ambient: str, speed_ms: str, limits: tuple[float, float] = AMBIENT_C,
                   speed_max: float = SPEED_MAX_MS) -> Guard:
    """Fault outside the conditions a model was identified on; a missing ambient is outside too."""
    def check(w: Column) -> Column:
        amb, speed = F.col(ambient), F.col(speed_ms)
        cold_or_hot = ~F.coalesce(finite(amb) & amb.between(*limits), F.lit(False))
        fast = F.coalesce((speed > speed_max) & ~F.isnan(speed), F.lit(False))
        reason = (F.when(cold_or_hot, F.concat(F.lit("ambient "), F.format_string("%.0f", F.bround(amb)),
                                               F.lit("C outside identified envelope")))
                  .when(fast, F.concat(F.lit("speed "), F.format_string("%.0f", F.bround(speed)),
                                       F.lit(" m/s beyond identified envelope"))))
        return _verdict(w, reason, cold_or_hot | fast)
    return check


def sensor_valid(cabin: str, limits: tuple[float, float] = CABIN_C) -> Guard:
    """Fault on a missing or impossible cabin temperature."""
    def check(w: Column) -> Column:
        t = F.col(cabin)
        bad = ~F.coalesce(finite(t) & t.between(*limits), F.lit(False))
        return _verdict(w, F.when(bad, F.concat(F.lit("implausible cabin sensor ("),
                                                F.coalesce(t.cast("string"), F.lit("None")), F.lit(")"))), bad)
    return check


def first_fault(guards: list[Guard], probe: Column | None = None) -> Column:
    """Reason of the first guard that declares a fault in the situation itself."""
    probe = F.lit(0.0) if probe is None else probe
    found = [g(probe) for g in guards]
    return F.coalesce(*[F.when(v["fault"], v["reason"]) for v in found])


def rate_limit(df: DataFrame, s: Series, proposed: str, dt_s: float, carry: list[str], out: str = "applied_w",
               max_rate: float = MAX_RATE_W_PER_S, previous: str | None = None,
               bounds: tuple[float, float] | None = None, rows: int = 4096) -> DataFrame:
    """Slew-limited command along each key, ``dt_s`` apart; the first row passes and anchors."""
    return slew(df, s, proposed, max_rate * dt_s, out, carry, previous, bounds, rows)


def rate_reason(applied: Column, proposed: Column) -> Column:
    return F.when(F.abs(applied - proposed) >= SMALLEST_CHANGE_W, F.lit("rate limit"))


def supervise(df: DataFrame, s: Series, primary: str, fallback: str, situation: list[Guard], dt_s: float,
              carry: list[str], max_w: float = MAX_W, max_rate: float = MAX_RATE_W_PER_S,
              rows: int = 4096, previous: str | None = None) -> DataFrame:
    """Run every command through the guards.

    The first fault in the situation hands the step to the fallback; a primary that is no number
    does so too.  Every command is then clamped and slew-limited.  Adds ``proposed_w``,
    ``applied_w``, ``fell_back`` and ``reason`` (a fault before an amendment, NULL if unchanged).
    The slew limit keeps one state per step; ``previous`` names a column with the key's command before its first row.
    """
    fault = first_fault(situation)
    source = F.when(fault.isNotNull(), F.col(fallback)).otherwise(F.col(primary))
    no_number = ~finite(source)
    clamp = actuator_clamp(max_w)
    chosen = df.select(
        *s.keys, s.time, *s.tie, *[c for c in carry if c not in (s.time, *s.keys, *s.tie)],
        fault.alias("_fault"), source.alias("proposed_w"), no_number.alias("_nan"),
        F.col(fallback).alias("_fallback"), *([previous] if previous else []))
    # A faulty primary is replaced in the same step by the clipped fallback.
    swap = F.col("_nan") & F.col("_fault").isNull()
    clamped = F.when(swap, F.coalesce(clip("_fallback", 0.0, max_w), F.lit(0.0))).otherwise(clamp(F.col("proposed_w"))["value"])
    amend = F.when(F.col("_nan"), F.lit("non-finite action")).when(
        clamp(F.col("proposed_w"))["value"] != F.col("proposed_w"), F.lit("actuator limit"))
    ready = chosen.select("*", clamped.alias("_command"), amend.alias("_amend"), swap.alias("_swap"))
    keep = [s.time, *s.tie, *carry, "_fault", "proposed_w", "_command", "_amend", "_swap"]
    limited = rate_limit(ready, s, "_command", dt_s, list(dict.fromkeys(c for c in keep if c not in s.keys)),
                         max_rate=max_rate, previous=previous, bounds=(0.0, max_w), rows=rows)
    fell_back = F.col("_fault").isNotNull() | F.col("_swap")
    slewed = rate_reason(F.col("applied_w"), F.col("_command"))
    fault_reason = F.coalesce("_fault", F.when(F.col("_swap"), F.lit("non-finite action")))
    return limited.select(*s.keys, *[c for c in dict.fromkeys([s.time, *s.tie, *carry]) if c not in s.keys], "pos",
                          F.when(finite("proposed_w"), F.col("proposed_w")).alias("proposed_w"), "applied_w",
                          fell_back.alias("fell_back"), F.coalesce(fault_reason, "_amend", slewed).alias("reason"))


def takeovers(supervised: DataFrame) -> DataFrame:
    """One row per step the guards changed or replaced."""
    return supervised.filter(F.col("fell_back") | F.col("reason").isNotNull())


def takeover_reasons(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return log.groupBy(*(keys or []), "reason").agg(F.count(F.lit(1)).alias("steps"))


def takeover_summary(supervised: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Steps, amended steps and steps on the fallback."""
    fell = F.col("fell_back")
    return supervised.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if(fell).alias("n_fallback"),
        F.count_if(~fell & F.col("reason").isNotNull()).alias("n_amended"))
