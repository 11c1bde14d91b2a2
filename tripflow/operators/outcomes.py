"""What a heater policy costs and what it saves at equal comfort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.functions.scalars import missing_if_nan
from tripflow.operators.ordered import attach


def discomfort(cabin: Column, cold_weight: float, setpoint: float = 22.0, band: float = 1.0) -> Column:
    """Kelvin outside the comfort band; the weight of cold has no default, it is a choice.  NULL without a measurement."""
    cold = F.greatest(F.lit(0.0), F.lit(setpoint - band) - cabin)
    warm = F.greatest(F.lit(0.0), cabin - F.lit(setpoint + band))
    return F.when(missing_if_nan(cabin).isNotNull(), cold_weight * cold + warm)


def outcome(df: DataFrame, keys: list[str], cabin: str, power: str, dt_s: float, cold_weight: float,
            setpoint: float = 22.0, band: float = 1.0) -> DataFrame:
    """Energy in Wh, discomfort in kelvin minutes, peak power and measured rows per key.

    Rows without a cabin temperature add no discomfort; ``scored_rows`` says how many have one, and without any the
    discomfort is NULL.
    """
    return df.groupBy(*keys).agg(
        (F.sum(power) * (dt_s / 3600.0)).alias("energy_wh"),
        (F.sum(discomfort(F.col(cabin), cold_weight, setpoint, band)) * (dt_s / 60.0)).alias("discomfort_kmin"),
        F.max(power).alias("peak_w"), F.count(missing_if_nan(F.col(cabin))).alias("scored_rows"))


def consumption_wh(df: DataFrame, keys: list[str], volts: str, amps: str) -> DataFrame:
    """Battery energy of one-second rows; NULL where a channel is absent from the whole trip."""
    p = F.sum(F.abs(F.coalesce(F.col(volts) * F.col(amps), F.lit(0.0)))) / 3600.0
    have = (F.count(volts) > 0) & (F.count(amps) > 0)
    return df.groupBy(*keys).agg(F.when(have, p).alias("consumption_wh"))


def head_rows(positioned: DataFrame, n: int, keys: list[str], pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """First n rows of every key that has them, and the keys that are too short."""
    size = positioned.groupBy(*keys).agg((F.max(pos) + 1).alias("rows"))
    long_enough = size.filter(F.col("rows") >= n).select(*keys)
    return attach(positioned.filter(F.col(pos) < n), long_enough, keys, "left_semi"), size.filter(F.col("rows") < n)


def frontier_energy(frontier: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Energy a frontier needs at a target discomfort, on the line between neighbouring points.

    NULL (``reachable`` false) where the target lies outside the swept points.  Points of equal
    discomfort follow each other by energy; a frontier has one point per swept weight.  A point without a
    discomfort (NULL, NaN) is none.
    """
    frontier = frontier.filter(missing_if_nan(F.col("discomfort_kmin")).isNotNull())
    w = Window.partitionBy(*keys).orderBy("discomfort_kmin", "energy_wh")
    pieces = frontier.select(*keys, F.col("discomfort_kmin").alias("d0"), F.col("energy_wh").alias("e0"),
                             F.lead("discomfort_kmin").over(w).alias("d1"), F.lead("energy_wh").over(w).alias("e1"))
    ends = pieces.filter("d1 IS NOT NULL OR e0 IS NOT NULL")
    t = F.col("target")
    share = (t - F.col("d0")) / F.nullif(F.col("d1") - F.col("d0"), F.lit(0.0))
    at = F.when(t == F.col("d1"), F.col("e1")).when(t == F.col("d0"), F.col("e0")).otherwise(
        F.col("e0") + (F.col("e1") - F.col("e0")) * share)
    hit = targets.join(ends, keys).filter((t >= F.col("d0")) & (t <= F.coalesce("d1", "d0")))
    # A target on a shared corner meets two pieces; the later one, as a search from the right does.
    found = hit.groupBy(*keys).agg(F.max_by(F.when(F.col("d1").isNull(), F.col("e0")).otherwise(at), F.struct("d0", "e0")).alias("energy_at_target"))
    return targets.join(found, keys, "left").withColumn("reachable", F.col("energy_at_target").isNotNull())


def saving(df: DataFrame, base: str, candidate: str) -> DataFrame:
    """Saved share of the base energy; NULL where the candidate has no value or the base is zero."""
    return df.withColumn("saving", F.when(F.col(base) > 0, 1.0 - F.col(candidate) / F.col(base)))


def saving_report(df: DataFrame) -> DataFrame:
    ok = F.col("reachable") & F.col("saving").isNotNull()
    v = F.when(ok, F.col("saving"))
    return df.agg(F.count(F.lit(1)).alias("trips"), F.count(v).alias("scored"), F.avg(v).alias("saving_mean"), F.stddev_samp(v).alias("saving_sd"))


def range_gain_km(saved_wh: Column, distance_km: Column, consumption: Column, scored_s: float, duration_min: Column) -> Column:
    """Kilometres the saved energy is worth on this trip; NULL unless distance and use are positive."""
    share = F.least(F.lit(1.0), scored_s / F.greatest(duration_min * 60.0, F.lit(1.0)))
    km = distance_km * share
    return F.when((km > 0) & (consumption > 0), saved_wh / (consumption / km))
