"""Heater policies as columns of recorded telemetry, and first-order filters of a signal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.functions.scalars import clip, missing_if_nan
from tripflow.operators.ordered import Series, with_neighbours, with_position
from tripflow.operators.scan import CLAMPED_SUM, LINEAR, automaton, scan

# Set-point, band, heater maximum and gains of the plain controllers.
SETPOINT_C, BAND_C, MAX_W = 22.0, 1.0, 7000.0
KP_W_PER_K, KI_W_PER_KS, INTEGRAL_MAX_W = 800.0, 4.0, 4000.0


def recorded(heat: str = "heat_w") -> Column:
    """What the vehicle actually commanded."""
    return F.col(heat)


def thermostat(cabin: str = "cabin_c", setpoint: float = SETPOINT_C, band: float = BAND_C,
               power_w: float = MAX_W) -> Column:
    """Full power below the band, otherwise off."""
    return F.when(F.col(cabin) < setpoint - band, F.lit(power_w)).otherwise(F.lit(0.0))


def with_policies(df: DataFrame, **policies: Column) -> DataFrame:
    """Stateless policies side by side; a policy is any function that returns a Column."""
    return df.withColumns(policies)


def pi_policy(df: DataFrame, s: Series, cabin: str, carry: list[str], dt_s: float, out: str = "pi_w",
              setpoint: float = SETPOINT_C, kp: float = KP_W_PER_K, ki: float = KI_W_PER_KS,
              i_max: float = INTEGRAL_MAX_W, max_w: float = MAX_W, rows: int = 512, levels: int = 2) -> DataFrame:
    """Proportional-integral command along each trip, the integral kept inside its limits.

    A row without a cabin temperature leaves the integral as it is and has no command of its own (NULL).
    """
    error = setpoint - F.col("_t")
    placed = with_position(df, s).withColumn("_t", missing_if_nan(F.col(cabin)))
    carry_all = list(dict.fromkeys([*carry, "_t"]))
    stepped = scan(placed, list(s.keys), "pos", CLAMPED_SUM, (F.coalesce(error * (ki * dt_s), F.lit(0.0)), F.lit(-i_max), F.lit(i_max)),
                   0.0, "_i", carry_all, rows, levels)
    command = F.when(F.col("_t").isNotNull(), clip(kp * error + F.col("_i"), 0.0, max_w))
    return stepped.withColumn(out, command).drop("_t", "_i", "pos")


def finite_policy(df: DataFrame, s: Series, states: int, step: Callable[[int], Column], command: Callable[[Column], Column],
                  carry: list[str], out: str = "command_w", start: int = 0, rows: int = 512, levels: int = 2) -> DataFrame:
    """Any policy that remembers one of ``states`` states.

    ``step(i)`` gives the state after a row that finds state ``i``, as a Column of the row (NULL keeps the state);
    ``command(state)`` turns the state after the row into its command and may read the columns in ``carry``.  Rows become maps
    of all states, so a trip is worked on in blocks, whatever its length.
    """
    following = tuple(F.coalesce(step(i).cast("double"), F.lit(float(i))) for i in range(states))
    walked = scan(with_position(df, s), list(s.keys), "pos", automaton(states), following, float(start), "_state", carry, rows, levels)
    return walked.withColumn(out, command(F.col("_state").cast("int"))).drop("_state", "pos")


def hysteresis(df: DataFrame, s: Series, cabin: str, carry: list[str], out: str = "hysteresis_w", setpoint: float = SETPOINT_C,
               band: float = BAND_C, power_w: float = MAX_W, **kw) -> DataFrame:
    """Thermostat with a dead band: full power once the cabin is below the band until it is above it.

    Off before the first reading.  A row without a cabin temperature keeps the state and has no command of its own (NULL).
    """
    t = missing_if_nan(F.col(cabin))
    step = lambda i: F.when(t < setpoint - band, 1).when(t > setpoint + band, 0).otherwise(i)
    return finite_policy(df, s, 2, step, lambda on: F.when(missing_if_nan(F.col(cabin)).isNotNull(), on * F.lit(float(power_w))),
                         list(dict.fromkeys([*carry, cabin])), out, **kw)


def lag_filter(df: DataFrame, s: Series, value: str, tau_s: float, dt_s: float, carry: list[str],
               gain: float = 1.0, out: str = "lagged", rows: int = 512, levels: int = 2) -> DataFrame:
    """First-order lag of ``gain * value`` on an even grid, settled on the first sample.

    One fourth-order step with a linearly interpolated input is a linear map of the state, so the
    filter is a scan of linear maps.  A row without an input, or right after one, leaves the state as it is; before the
    first input the state is zero.
    """
    z = dt_s / tau_s
    decay = 1 - z + z ** 2 / 2 - z ** 3 / 6 + z ** 4 / 24
    w0 = z / 6 * (1 - z + z ** 2 / 2 - z ** 3 / 4)
    wm = z / 6 * (4 - 2 * z + z ** 2 / 2)
    w1 = z / 6
    near = with_neighbours(df.withColumn("_u", F.col(value) * gain), s, ["_u"], following=False)
    placed = with_position(near, s)
    u0, u1 = F.col("prev__u"), F.col("_u")
    first = F.col("pos") == 0
    offset = F.when(first, u1).otherwise(w0 * u0 + wm * (u0 + u1) / 2 + w1 * u1)
    slope = F.when(offset.isNull(), 1.0).when(first, 0.0).otherwise(decay)
    return scan(placed, list(s.keys), "pos", LINEAR, (slope, F.coalesce(offset, F.lit(0.0))),
                0.0, out, carry, rows, levels)
