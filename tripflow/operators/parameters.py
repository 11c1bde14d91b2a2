"""Tables of thermal parameters: plausible ranges, penalties, movement from the start, holding power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plausible ranges and starting values of the parameters.
PLAUSIBLE = {"c_cab": (2.0e4, 1.0e6), "c_mass": (5.0e4, 5.0e6), "ua0": (10.0, 300.0), "ua1": (0.0, 40.0),
             "ua_mass": (5.0, 500.0), "eta": (0.3, 1.0), "tau_h": (2.0, 300.0), "cop_ac": (0.5, 6.0),
             "tau_mass": (300.0, 7200.0), "mdot_cp": (30.0, 180.0)}
INITIAL = {"c_cab": 1.0e5, "ua0": 55.0, "ua1": 2.0, "ua_mass": 60.0, "eta": 0.85, "tau_h": 30.0, "cop_ac": 2.0,
           "tau_mass": 1800.0, "mdot_cp": 70.0}


def long_parameters(params: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return params.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])))


def _ranges(ranges: dict[str, tuple[float, float]], name: Column) -> tuple[Column, Column]:
    lo, hi = (F.coalesce(*[F.when(name == n, F.lit(r[i])) for n, r in ranges.items()]) for i in (0, 1))
    return lo, hi


def implausible(long: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Parameters outside their range; a missing or undefined value is outside."""
    lo, hi = _ranges(PLAUSIBLE if ranges is None else ranges, F.col("name"))
    v = F.col("value")
    inside = F.coalesce(v.between(lo, hi) & ~F.isnan(v), F.lit(False))
    return long.withColumns({"lo": lo, "hi": hi}).filter(F.col("lo").isNotNull() & ~inside)


def plausibility_penalty(long: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Squared log distance outside the range, summed per parameter set; zero inside."""
    lo, hi = _ranges(PLAUSIBLE if ranges is None else ranges, F.col("name"))
    v = F.log(F.greatest("value", F.lit(1e-9)))
    below, above = F.greatest(F.log(lo) - v, F.lit(0.0)), F.greatest(v - F.log(hi), F.lit(0.0))
    below = F.when(lo > 0, below).otherwise(F.lit(0.0))
    return long.groupBy(*keys).agg(F.sum(below * below + above * above).alias("penalty"))


def movement(long: DataFrame, initial: dict[str, float] | None = None, stuck_below: float = 0.05,
             frozen: tuple[str, ...] = ()) -> DataFrame:
    """Relative distance of each parameter from its start, and whether it is stuck there."""
    initial = INITIAL if initial is None else initial
    start = F.coalesce(*[F.when(F.col("name") == n, F.lit(v)) for n, v in initial.items()])
    moved = F.abs(F.col("value") - start) / start
    return (long.withColumn("moved", moved).filter("moved IS NOT NULL")
            .withColumn("stuck", (F.col("moved") < stuck_below) & ~F.col("name").isin(*frozen)))


def holding_power(ua0: Column, ua1: Column, eta: Column, delta_t: float = 22.0, speed_ms: float = 0.0) -> Column:
    return (ua0 + ua1 * speed_ms) * delta_t / F.greatest(eta, F.lit(1e-6))
