"""Direct multi-horizon forecasts: labels, lag features, binned quantiles, baselines, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripflow.operators.ordered import Series, attach, with_halo, with_position
from tripflow.operators.quantiles import exact_quantile, exact_quantiles, order_statistics
from tripflow.operators.scoring import conformal_rank

QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def with_future(df: DataFrame, tick: str, value: str, horizons: list[int], key: str = "trip") -> DataFrame:
    """One row per horizon with the value ``h`` ticks later; by clock, so gaps give no label.

    Each labelled row is sent back to the tick it is a label for, which keeps the join an equi-join.
    """
    label = df.select(key, F.col(tick).alias("_t"), F.col(value).alias("label"))
    back = label.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    back = back.select(key, (F.col("_t") - F.col("horizon")).alias(tick), "horizon", "label")
    return df.join(back, [key, tick])


def lag_features(df: DataFrame, s: Series, value: str, lags: tuple[int, ...] = (1, 2), mean_of: int = 3, rows: int = 8192) -> DataFrame:
    """Past values, their trailing mean and the elapsed clock; each block of rows borrows its past."""
    reach = max(*lags, mean_of - 1)
    start = df.groupBy(*s.keys).agg(F.min(s.time).alias("_t0"))
    lent = with_halo(with_position(df, s), rows, before=reach)
    w = Window.partitionBy(*s.keys, "_rows").orderBy("pos")
    added = {f"lag_{k}": F.lag(value, k).over(w) for k in lags}
    added[f"mean_{mean_of}"] = F.avg(value).over(w.rowsBetween(-(mean_of - 1), 0))
    return (attach(lent.withColumns(added).filter("_own").drop("_rows", "_own"), start, list(s.keys))
            .withColumn("elapsed_s", F.col(s.time) - F.col("_t0")).drop("_t0"))


def binned_quantiles(fit: DataFrame, keys: list[str], bins: str, label: str = "label", quantiles: dict[str, float] | None = None) -> DataFrame:
    """Empirical quantiles of the label per bin, with those of the key alone as fallback columns; one run for both."""
    quantiles = QUANTILES if quantiles is None else quantiles
    kind = fit.schema[bins].dataType
    level = lambda fine, of: F.struct(F.lit(fine).alias("_fine"), of.alias("_bin"))
    both = F.inline(F.array(level(True, F.coalesce(F.col(bins).cast("string"), F.lit(""))), level(False, F.lit(""))))
    found = exact_quantiles(fit.select(*keys, label, both), [*keys, "_fine", "_bin"], label, quantiles)
    every = Window.partitionBy(*keys)       # one row per bin and key
    found = found.withColumns({f"any_{n}": F.max(F.when(~F.col("_fine"), F.col(n))).over(every) for n in quantiles}).filter("_fine")
    return found.select(*keys, F.nullif("_bin", F.lit("")).cast(kind).alias(bins), *quantiles, *[f"any_{n}" for n in quantiles])


def forecast(rows: DataFrame, table: DataFrame, keys: list[str], bins: str, names: tuple[str, ...] = tuple(QUANTILES)) -> DataFrame:
    """Quantiles of each row's bin, or of the key where the bin was never seen in fitting."""
    fine = table.select(*keys, bins, *names)
    coarse = table.select(*keys, *[f"any_{n}" for n in names]).distinct()
    j = attach(attach(rows, fine, [*keys, bins], "left"), coarse, keys, "left")
    return j.withColumns({n: F.coalesce(n, f"any_{n}") for n in names}).drop(*[f"any_{n}" for n in names])


def warmup_curve(train: DataFrame, keys: list[str], bucket: str, value: str) -> DataFrame:
    """Median demand by elapsed time, from training trips."""
    return exact_quantile(train, [*keys, bucket], value, 0.5, "curve")


def skill(rows: DataFrame, keys: list[str], label: str, model: str, baselines: dict[str, str]) -> DataFrame:
    """Mean absolute errors of a forecast and of named baselines on the same rows, and the share of the best baseline's that is saved."""
    error = lambda c: F.avg(F.abs(F.col(label) - F.col(c)))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), error(model).alias("model"), *[error(c).alias(n) for n, c in baselines.items()])
    best = F.least(*baselines) if len(baselines) > 1 else F.col(*baselines)
    return out.withColumn("skill", 1 - F.col("model") / F.nullif(best, F.lit(0.0)))


def conformal_shift(calibration: DataFrame, keys: list[str], label: str = "label", lo: str = "p10", hi: str = "p90", miss: float = 0.2) -> DataFrame:
    """How far intervals must widen so that held-out trips are covered, with the finite-sample rank.

    NULL where the calibration rows are too few for any finite widening.
    """
    score = calibration.withColumn("_s", F.greatest(F.col(lo) - F.col(label), F.col(label) - F.col(hi)))
    return order_statistics(score, keys, "_s", {"shift": (1.0 - miss, lambda n: conformal_rank(n, miss) - 1)})


def widen(df: DataFrame, shift: DataFrame, keys: list[str], lo: str = "p10", hi: str = "p90") -> DataFrame:
    j = attach(df, shift, keys, "left")
    return j.withColumns({f"{lo}_wide": F.col(lo) - F.col("shift"), f"{hi}_wide": F.col(hi) + F.col("shift")})
