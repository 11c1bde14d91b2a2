"""Fixed-length windows of a trip, by row position."""

from __future__ import annotations

from functools import reduce
from operator import or_


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.functions.scalars import kmh_to_ms, missing_if_nan
from tripflow.operators.ordered import Series, attach, with_position

# Scored length, stride, step and accepted share of missing rows.
HORIZON_S, STRIDE_S, STEP_S, MAX_GAP = 1200, 300, 1.0, 0.02
#: Delivery-air channels in order of preference.
VENT_CHANNELS = ("hx_out_c", "vent_ctr_r_c", "vent_ctr_l_c", "vent_right_c")


def model_inputs(df: DataFrame, optional: tuple[str, ...] = ("heat_power_req_w", "aircon_power_w", "amb_temp_c", "velocity_kmh"),
                 keys: tuple[str, ...] = ("trip",)) -> DataFrame:
    """Model channels ``p_heat_w, p_ac_w, amb_temp_c, speed_ms``.

    A channel a trip never recorded is an idle actuator and reads zero; a gap in a recorded channel
    stays a gap.
    """
    heat, ac, amb, speed = optional
    df = df.withColumns({c: F.lit(None).cast("double") for c in optional if c not in df.columns})
    seen = df.groupBy(*keys).agg(*[F.count(missing_if_nan(c)).alias(f"_n_{c}") for c in optional])
    out = attach(df, seen, list(keys))

    def channel(c: str) -> Column:
        return F.when(F.col(f"_n_{c}") == 0, F.lit(0.0)).otherwise(missing_if_nan(c))
    return out.withColumns({"p_heat_w": channel(heat), "p_ac_w": channel(ac), "amb_temp_c": channel(amb),
                            "speed_ms": kmh_to_ms(channel(speed))}).drop(*[f"_n_{c}" for c in optional])


def first_available(df: DataFrame, choices: tuple[str, ...], out: str, keys: tuple[str, ...] = ("trip",)) -> DataFrame:
    """Per trip the first of several channels it recorded; NULL for all unless every trip has one."""
    have = [c for c in choices if c in df.columns]
    if not have:
        return df.withColumn(out, F.lit(None).cast("double"))
    rank = F.coalesce(*[F.when(F.count(c) > 0, F.lit(i)) for i, c in enumerate(have)])
    picks = df.groupBy(*keys).agg(rank.alias("_pick"))
    every = picks.agg(F.bool_and(F.col("_pick").isNotNull()).alias("_every")).withColumn("_one", F.lit(1))
    chosen = F.coalesce(*[F.when(F.col("_pick") == i, F.col(c)) for i, c in enumerate(have)])
    usable = picks.withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one").drop("_one")   # one row
    return attach(df, usable, list(keys)).withColumn(out, F.when(F.col("_every"), chosen)).drop("_pick", "_every")


def cut_windows(df: DataFrame, s: Series, channels: list[str], steps: int, stride: int, burn_in: int = 0,
                anchor: str = "sliding", max_gap: float = MAX_GAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of every complete window whose channels are present often enough, first row included.

    A window is ``burn_in + steps`` consecutive rows; it starts every ``stride`` rows, or once at
    the first row for ``trip_start``.  The result has ``window_id``, ``step``, ``start_s`` and
    ``bad`` (some channel is missing in that row).  A row joins the few windows it falls into by
    arithmetic, and the work per window is keyed by (trip, window).
    """
    if anchor not in ("sliding", "trip_start"):
        raise ValueError("anchor must be 'sliding' or 'trip_start'")
    length, keys = steps + burn_in, list(s.keys)
    placed = with_position(df.select(*keys, s.time, *s.tie, *channels, *carry), s)
    pos = F.col("pos")
    newest = F.floor(pos / stride) if anchor == "sliding" else F.lit(0).cast("bigint")
    oldest = F.greatest(F.lit(0), F.floor((pos - length) / stride) + 1)
    placed = placed.filter(oldest <= newest)
    rows = placed.withColumn("window_id", F.explode(F.sequence(oldest, newest)))
    bad = reduce(or_, [missing_if_nan(c).isNull() for c in channels])
    rows = rows.withColumns({"step": (pos - F.col("window_id") * stride).cast("int"), "bad": bad}).drop("pos")
    w = Window.partitionBy(*keys, "window_id")
    is_first = F.col("step") == 0
    whole = rows.withColumns({
        "_n": F.count(F.lit(1)).over(w), "_bad": F.count_if("bad").over(w),
        "_bad0": F.max(F.when(is_first, F.col("bad"))).over(w), "start_s": F.max(F.when(is_first, F.col(s.time))).over(w)})
    kept = whole.filter((F.col("_n") == length) & (F.col("_bad") / length <= max_gap) & ~F.col("_bad0"))
    return kept.drop("_n", "_bad", "_bad0")


def fill_gaps(windows: DataFrame, channels: list[str], keys: tuple[str, ...] = ("trip",)) -> DataFrame:
    """Straight line over bad rows between the good rows around them; the last good row is held.

    All channels of a bad row are replaced, also those that are present in it.
    """
    by = [*keys, "window_id"]
    good = F.when(~F.col("bad"), F.struct("step", *channels))
    back = F.last(good, ignorenulls=True).over(Window.partitionBy(*by).orderBy("step"))
    ahead = F.last(good, ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc("step")))
    near = windows.withColumns({"_a": back, "_z": ahead})
    share = (F.col("step") - F.col("_a.step")) / (F.col("_z.step") - F.col("_a.step"))

    def filled(c: str) -> Column:
        line = F.col(f"_a.{c}") + (F.col(f"_z.{c}") - F.col(f"_a.{c}")) * share
        return F.when(~F.col("bad"), F.col(c)).when(F.col("_z").isNull(), F.col(f"_a.{c}")).otherwise(line)
    return near.withColumns({c: filled(c) for c in channels}).drop("_a", "_z", "bad")


def build_windows(df: DataFrame, s: Series, channels: list[str], horizon_s: float = HORIZON_S,
                  stride_s: float = STRIDE_S, dt_s: float = STEP_S, max_gap: float = MAX_GAP,
                  burn_in_s: float = 0, anchor: str = "sliding") -> DataFrame:
    """Cut and fill windows whose lengths are given in seconds."""
    to_rows = lambda sec: int(round(sec / dt_s))
    cut = cut_windows(df, s, channels, to_rows(horizon_s), max(1, to_rows(stride_s)), to_rows(burn_in_s), anchor, max_gap)
    return fill_gaps(cut, channels, s.keys)


def require_windows(windows: DataFrame) -> DataFrame:
    if not windows.take(1):
        raise ValueError("no window survived")
    return windows


def truncate(windows: DataFrame, horizon: int, burn_in: int = 0) -> DataFrame:
    """Shorter horizon; the burn-in rows stay."""
    return windows.filter(F.col("step") < burn_in + horizon)


def as_arrays(windows: DataFrame, channels: list[str], keys: tuple[str, ...] = ("trip",)) -> DataFrame:
    """One row per window with an array per channel in step order; windows are of bounded length."""
    packed = F.sort_array(F.collect_list(F.struct("step", *channels))).alias("_r")
    return (windows.groupBy(*keys, "window_id").agg(F.first("start_s").alias("start_s"), packed)
            .select(*keys, "window_id", "start_s", *[F.col(f"_r.{c}").alias(c) for c in channels]))


def history_mean(windows: DataFrame, value: str, steps: int, tau_s: float, dt_s: float, keys: tuple[str, ...] = ("trip",)) -> DataFrame:
    """Per window the last of its first ``steps`` values, and their mean weighted down by age with a time constant.

    Missing values carry no weight; a window without any gives NULL.
    """
    past = windows.filter(F.col("step") < steps)
    seen = F.col(value).isNotNull()
    weight = F.when(seen, F.exp((F.col("step") - (steps - 1)) * (dt_s / tau_s)))
    return past.groupBy(*keys, "window_id").agg(
        F.max_by(value, F.when(seen, F.col("step"))).alias("last_value"), (F.sum(weight * F.col(value)) / F.sum(weight)).alias("weighted_mean"))


def unexcited(windows: DataFrame, ac: str = "p_ac_w", speed: str = "speed_ms", ac_w: float = 50.0,
              min_share: float = 0.02, speed_ms: float = 20.0, min_fast: float = 0.15,
              keys: tuple[str, ...] = ("trip",)) -> DataFrame:
    """Which parameters the inputs cannot determine: shares of active rows, and the verdicts."""
    per = windows.groupBy(*keys, "window_id").agg(
        F.count_if(F.abs(F.col(ac)) > ac_w).alias("_on"), F.count(F.lit(1)).alias("_n"),
        F.avg((F.col(speed) > speed_ms).cast("int")).alias("_fast"))
    total = per.agg((F.sum("_on") / F.sum("_n")).alias("ac_share"), F.max("_fast").alias("fast_share"))
    return total.select("ac_share", "fast_share", (F.col("ac_share") < min_share).alias("cop_ac_frozen"),
                        (F.col("fast_share") < min_fast).alias("ua1_frozen"))


