"""Scalar functions on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_double(c: Column | str) -> Column:
    """Number if it parses, else NULL; NaN counts as missing."""
    v = col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def missing_if_nan(c: Column | str) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def finite(c: Column | str) -> Column:
    """True for a present, finite number; never NULL."""
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def stamp_day(c: Column | str) -> Column:
    """Day of a stamp that mixes ``-`` and ``_`` as delimiters; NULL where it has none."""
    day = F.regexp_extract(F.translate(col(c), "_", "-"), r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(day != "", day)


def payload_kg(c: Column | str) -> Column:
    """Added load noted as ``+ 80 kg``; zero where nothing is noted."""
    kg = F.regexp_extract(col(c), r"(?i)\+\s*(\d+)\s*kg", 1)
    return F.coalesce(kg.try_cast("double"), F.lit(0.0))


def notes_contain(c: Column | str, phrase: str) -> Column:
    """Case-insensitive mention of a phrase; a missing note mentions nothing."""
    return F.coalesce(F.lower(col(c)).contains(phrase.lower()), F.lit(False))


def round_to_step(c: Column | str, step: float) -> Column:
    """Nearest multiple of ``step``, halves to even."""
    return F.bround(col(c) / step) * step


def clip(c: Column | str, lo, hi) -> Column:
    """Value kept inside the limits; a missing value stays missing (greatest/least skip NULLs)."""
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def hinge(threshold: float, c: Column | str) -> Column:
    """How far a value lies below a threshold, zero above it."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.lit(threshold) - x))


def state_label(c: Column | str, threshold: float, active: str = "active", idle: str = "idle") -> Column:
    return F.when(col(c) > threshold, F.lit(active)).otherwise(F.lit(idle))


def duct_temperature(cabin_c: Column | str, heat_w: Column | str, flow_w_per_k: Column | str) -> Column:
    return col(cabin_c) + col(heat_w) / col(flow_w_per_k)


def kmh_to_ms(c: Column | str) -> Column:
    return col(c) / 3.6


def ms_to_kmh(c: Column | str) -> Column:
    return col(c) * 3.6


def run_name_parts(run: Column | str, codes: dict[str, float]) -> list[Column]:
    """Ambient set-point, strategy and bus out of ``<code>_<strategy>_<bus>``; an unknown code fails."""
    parts = F.split(col(run), "_")
    code = F.element_at(parts, 1)
    known = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in codes.items()])
    ok = known.isNotNull() & (F.size(parts) == 3)
    amb = F.when(ok, known).otherwise(F.raise_error(F.concat(F.lit("unknown run name: "), col(run))).cast("double"))
    return [amb.alias("amb_setpoint_c"), F.try_element_at(parts, F.lit(2)).alias("strategy"),
            F.try_element_at(parts, F.lit(3)).alias("bus")]


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation over rows where both are present; NULL, not an error, where one does not vary."""
    x = F.when(col(b).isNotNull(), col(a))
    y = F.when(col(a).isNotNull(), col(b))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def skill(model: Column, *baselines: Column) -> Column:
    """Share of the best baseline's error that the model removes; NULL where that error is zero."""
    best = F.least(*baselines) if len(baselines) > 1 else baselines[0]
    return F.when(best > 0, 1.0 - model / best)
