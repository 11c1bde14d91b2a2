"""Heat-balance regression on steady rows, with and without per-trip effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.functions.scalars import finite, kmh_to_ms, pearson
from tripflow.operators.ordered import Series, attach, gradient

# What counts as steady, heater efficiency, rows a trip needs, and the verdict.
SETPOINT_C, WARM_MARGIN_C, MAX_RATE_C_S, MIN_POWER_W, MIN_GAP_C = 22.0, 4.0, 0.005, 200.0, 5.0
ETA, MIN_ROWS = 0.96, 50
DETECT_SLOPE, DETECT_CORR, DETECT_SHARE = 0.5, 0.2, 0.7
FLAT_SD = 1e-6


def with_steady(df: DataFrame, s: Series, cabin: str = "cabin_temp_c", ambient: str = "amb_temp_c",
                speed_kmh: str = "velocity_kmh", power: str = "heat_power_req_w", setpoint: float = SETPOINT_C,
                margin: float = WARM_MARGIN_C, max_rate: float = MAX_RATE_C_S, min_power: float = MIN_POWER_W,
                min_gap: float = MIN_GAP_C, out: str = "steady") -> DataFrame:
    """Mark rows where the cabin is warm, hardly changes, the heater is on and there is heat to lose.

    All rows of a trip are unsteady if a channel is absent or has fewer than two real speeds.
    """
    need = (cabin, ambient, speed_kmh, power, s.time)
    if any(c not in df.columns for c in need):
        return df.withColumn(out, F.lit(False))
    enough = df.groupBy(*s.keys).agg(((F.count_if(finite(speed_kmh)) >= 2) & (F.count_if(finite(s.time)) >= 2)).alias("_enough"))
    sloped = attach(gradient(df, s, cabin, "_rate"), enough, list(s.keys))
    real = lambda c: F.when(finite(c), F.col(c))
    test = ((real(cabin) > setpoint - margin) & (F.abs(real("_rate")) < max_rate) & (real(power) > min_power)
            & (real(cabin) - real(ambient) > min_gap) & finite(speed_kmh) & F.col("_enough"))
    return sloped.withColumn(out, F.coalesce(test, F.lit(False))).drop("_rate", "_enough")


def heat_terms(df: DataFrame, cabin: str, ambient: str, speed_kmh: str, power: str, eta: float = ETA) -> DataFrame:
    """Regression columns: gap, speed * gap, supplied heat, speed."""
    gap, v = F.col(cabin) - F.col(ambient), kmh_to_ms(speed_kmh)
    return df.withColumns({"x1": gap, "x2": v * gap, "y": eta * F.col(power), "v": v})


def group_moments(df: DataFrame, key: str, min_rows: int = MIN_ROWS, x1: str = "x1", x2: str = "x2", y: str = "y",
                  v: str = "v") -> DataFrame:
    """One pass over the rows: size, means and covariances per group, and how y/x1 goes with v."""
    ratio = F.col(y) / F.nullif(F.col(x1), F.lit(0.0))
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{n}") for n, c in (("1", x1), ("2", x2), ("y", y))],
        F.var_pop(x1).alias("s11"), F.var_pop(x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"),
        F.covar_pop(x1, y).alias("s1y"), F.covar_pop(x2, y).alias("s2y"), F.max(v).alias("max_v"),
        F.stddev_pop(v).alias("sd_v"), F.stddev_pop(ratio).alias("sd_r"), pearson(v, ratio).alias("corr"),
        F.regr_slope(ratio, F.col(v)).alias("slope")).filter(F.col("n") >= min_rows)


def _solve(s11: Column, s12: Column, s22: Column, s1y: Column, s2y: Column) -> tuple[Column, Column]:
    det = F.nullif(s11 * s22 - s12 * s12, F.lit(0.0))
    return (s1y * s22 - s2y * s12) / det, (s2y * s11 - s1y * s12) / det


def _sum(c: str) -> Column:
    return F.sum(F.col("n") * F.col(c))


def _pooled() -> list[Column]:
    means = {k: _sum(f"m_{k}") / F.sum("n") for k in ("1", "2", "y")}

    def cov(within: str, a: str, b: str) -> Column:
        between = F.sum(F.col("n") * F.col(f"m_{a}") * F.col(f"m_{b}")) - F.sum("n") * means[a] * means[b]
        return _sum(within) + between
    b1, b2 = _solve(cov("s11", "1", "1"), cov("s12", "1", "2"), cov("s22", "2", "2"), cov("s1y", "1", "y"), cov("s2y", "2", "y"))
    return [b1.alias("b1"), b2.alias("b2"), (means["y"] - b1 * means["1"] - b2 * means["2"]).alias("b0"),
            F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.max("max_v").alias("max_v")]


def _within() -> list[Column]:
    b1, b2 = _solve(_sum("s11"), _sum("s12"), _sum("s22"), _sum("s1y"), _sum("s2y"))
    return [b1.alias("within_b1"), b2.alias("within_b2")]


def _correlation() -> list[Column]:
    varied = (F.col("sd_v") > FLAT_SD) & (F.col("sd_r") > FLAT_SD)
    return [F.avg(F.when(varied, F.col("corr"))).alias("corr"),
            F.coalesce(F.avg(F.when(varied, (F.col("slope") > 0).cast("int"))), F.lit(0.0)).alias("positive_share")]


def pooled_ols(moments: DataFrame) -> DataFrame:
    """y on x1, x2 and a constant over all rows of the groups, from their moments."""
    return moments.agg(*_pooled())


def within_ols(moments: DataFrame) -> DataFrame:
    """The same with one constant per group: only the spread inside groups counts."""
    return moments.agg(*_within())


def within_correlation(moments: DataFrame) -> DataFrame:
    """Mean correlation of v with y/x1 inside groups, and the share of groups with positive slope."""
    return moments.agg(*_correlation())


def loss_estimates(moments: DataFrame) -> DataFrame:
    """All estimators in one row, with the verdict whether loss depends on speed."""
    out = moments.agg(*_pooled(), *_within(), *_correlation())
    found = (F.col("within_b2") > DETECT_SLOPE) & (F.col("corr") > DETECT_CORR) & (F.col("positive_share") > DETECT_SHARE)
    return out.withColumn("detected", F.coalesce(found, F.lit(False)))
