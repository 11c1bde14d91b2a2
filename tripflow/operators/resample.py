"""Block means and the effective size of a serially correlated sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tripflow.functions.scalars import finite
from tripflow.operators.ordered import Series, attach, with_halo, with_position
from tripflow.session import durable

STAGES = (64, 512, 4096)     # lags after which keys that have stopped are left out


def block_mean(df: DataFrame, period_s: float, values: list[str], keys: tuple[str, ...] = ("trip",),
               time: str = "time_s") -> DataFrame:
    """Mean of every value per clock block; an empty block gives no row, missing values are skipped."""
    if time not in df.columns:
        raise KeyError(f"a block mean needs the clock column {time!r}")
    bucket = F.floor(F.col(time) / F.lit(float(period_s)))
    return (df.groupBy(*keys, bucket.alias("_bucket")).agg(*[F.avg(v).alias(v) for v in values])
            .select(*keys, (F.col("_bucket") * F.lit(float(period_s))).alias(time), *values))


def lag_products(x: np.ndarray, own: int, first: int, until: int) -> np.ndarray:
    """Sum of x[i] * x[i + k] over the first ``own`` rows, for the lags k from ``first`` to before ``until`` that fit.

    Plain sums: whether a product is above zero ends a key's lags, so no transform may add noise of its own.
    """
    ends = [(k, max(min(own, len(x) - k), 0)) for k in range(first, min(until, len(x)))]
    return np.array([x[:m] @ x[k:k + m] for k, m in ends])


def _lag_sums(first: int, until: int):
    def sums(own: pd.Series, values: pd.Series) -> pd.Series:
        """Products with the lags of the block's own rows; the rows after them are lent."""
        return pd.Series([lag_products(np.asarray(x, float), int(n), first, until).tolist() for n, x in zip(own, values)])
    return F.pandas_udf(sums, "array<double>")


def effective_sample_size(df: DataFrame, s: Series, value: str, max_lag: int = 5000,
                          block_rows: int = 16_384) -> DataFrame:
    """Independent samples per key, n / (1 + 2 sum of autocorrelations up to the first one <= 0).

    Lags are worked off in ``STAGES``, each only for the keys whose sum has not stopped: most keys stop among the first lags,
    and only the others pay for far ones.  Lagged products are summed per block of rows (each block borrows the rows after it
    that the stage reaches), so a long trip is spread over tasks; what is ordered per trip is one row per lag.
    """
    (key,) = s.keys
    good = df.filter(finite(value)).select(key, s.time, *s.tie, F.col(value).cast("double").alias("x"))
    stats = good.groupBy(key).agg(F.avg("x").alias("_mean"), (F.min("x") == F.max("x")).alias("_flat"))
    centred = durable(attach(with_position(good, s), stats, [key])
                      .select(F.col(key).alias("trip"), "pos", (F.col("x") - F.col("_mean")).alias("x"), "_flat"), "centred")
    reach = F.least(F.lit(max_lag), F.col("n") - 1)
    sums = centred.groupBy("trip").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col("x")).alias("_var"), F.first("_flat").alias("_flat"))
    state = sums.select("trip", "n", "_var", F.lit(0.0).alias("_total"), ((F.col("_var") > 0) & ~F.col("_flat") & (reach > 1)).alias("_open"))
    first = 1
    for until in [*(k for k in STAGES if 1 < k < max_lag), max_lag]:
        seen = Observation()
        state = durable(state.observe(seen, F.count_if("_open").alias("open")), "lags")
        if not seen.get["open"]:
            return _sample_sizes(state, key)
        keys = state.filter("_open").select("trip", "n", "_var")
        blocks = (with_halo(attach(centred.drop("_flat"), keys.select("trip"), ["trip"], "left_semi"), block_rows, after=until).groupBy("trip", "_rows")
                  .agg(F.count_if("_own").alias("own"), F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")))
        products = (blocks.select("trip", F.posexplode(_lag_sums(first, until)("own", "v.x")).alias("_k", "product"))
                    .groupBy("trip", (F.col("_k") + first).alias("lag")).agg(F.sum("product").alias("product")))
        w = Window.partitionBy("trip").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
        rho = (products.join(keys, "trip").filter(F.col("lag") < reach).withColumn("rho", F.col("product") / F.col("_var"))
               .withColumn("_stop", F.max((F.col("rho") <= 0).cast("int")).over(w)))
        step = rho.groupBy("trip").agg(F.sum(F.when(F.col("_stop") == 0, F.col("rho"))).alias("_more"), F.max("_stop").alias("_stopped"))
        state = state.join(step, "trip", "left").select(
            "trip", "n", "_var", (F.col("_total") + F.coalesce("_more", F.lit(0.0))).alias("_total"),
            (F.col("_open") & (F.coalesce("_stopped", F.lit(0)) == 0) & (reach > until)).alias("_open"))
        first = until
    return _sample_sizes(state, key)


def _sample_sizes(state: DataFrame, key: str) -> DataFrame:
    return state.select(F.col("trip").alias(key), "n", (F.col("n") / (1.0 + 2.0 * F.col("_total"))).alias("n_eff"))
