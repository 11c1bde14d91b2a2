"""Scores of predictions over windows and rows: baselines, skill, losses, classification."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripflow.functions.scalars import skill

# Scored horizons, trial time constants, loss shape, activity threshold.
HORIZONS = (60, 300, 1200)
RELAXATION_TAUS = tuple(10 ** (1.5 + 3.0 * i / 24) for i in range(25))
HUBER_DELTA, VENT_WEIGHT, RANGE_WEIGHT = 1.0, 0.3, 0.05
ACTIVE_W = 120.0


def scored_horizons(asked: tuple[int, ...], length: int) -> list[int]:
    """Asked horizons that fit, plus the full length."""
    return sorted({h for h in asked if h <= length} | {length})


def rmse_by_horizon(df: DataFrame, error: Column, horizons: list[int], keys: tuple[str, ...] = (),
                    step: str = "step", out: str = "rmse") -> DataFrame:
    """Root mean squared error of the first h steps for every horizon, in one pass."""
    sq = error * error
    parts = [F.avg(F.when(F.col(step) < h, sq)).alias(f"_h{h}") for h in horizons]
    long = F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.sqrt(f"_h{h}").alias(out)) for h in horizons]))
    return df.groupBy(*keys).agg(*parts).select(*keys, long)


def with_start_value(windows: DataFrame, y: str, out: str = "y0", keys: tuple[str, ...] = ("trip",)) -> DataFrame:
    """Value at step 0 next to every step of its window (same partitioning as the windows)."""
    w = Window.partitionBy(*keys, "window_id")
    return windows.withColumn(out, F.max(F.when(F.col("step") == 0, F.col(y))).over(w))


def persistence_rmse(windows: DataFrame, y: str, horizons: list[int]) -> DataFrame:
    started = with_start_value(windows, y)
    return rmse_by_horizon(started, F.col("y0") - F.col(y), horizons, out="persistence")


def grid(spark: SparkSession, values: DataFrame | Iterable, name: str, kind: str) -> DataFrame:
    """A table of variants to score; a plain sequence becomes one."""
    if isinstance(values, DataFrame):
        return values.select(F.col(name).cast(kind)).distinct()
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}").distinct()


def step_moments(windows: DataFrame, y: str, ambient: str) -> DataFrame:
    """Per step the sums from which the relaxation error of every time constant follows.

    The error of a row is a + b * d with a = ambient - y, b = start - ambient and the decay d, which depends on step and time
    constant alone: its square is a quadratic in d with three sums per step as coefficients.
    """
    a, b = F.col(ambient) - F.col(y), F.col("y0") - F.col(ambient)
    whole = (a + b).isNotNull()
    sums = {"n": F.lit(1), "aa": a * a, "ab": a * b, "bb": b * b}
    started = with_start_value(windows, y)
    return started.groupBy("step").agg(*[F.sum(F.when(whole, v)).alias(f"_{k}") for k, v in sums.items()])


def relaxation_rmse(windows: DataFrame, y: str, ambient: str, horizons: DataFrame | Iterable[int], dt_s: float = 1.0,
                    taus: DataFrame | Iterable[float] = RELAXATION_TAUS) -> DataFrame:
    """Relaxation toward ambient: error per time constant (column ``tau_s``) and horizon (column ``horizon``).

    Both grids are tables of any size.  The rows of the windows are read once and aggregated per step; sums over the steps
    before each horizon are prefix sums of a table with one row per step and time constant.
    """
    spark = windows.sparkSession
    tried = step_moments(windows, y, ambient).withColumn("_one", F.lit(1))
    tried = tried.join(grid(spark, taus, "tau_s", "double").withColumn("_one", F.lit(1)), "_one")
    d = F.exp(-(F.col("step") * dt_s) / F.col("tau_s"))
    by_step = Window.partitionBy("tau_s").orderBy("step")
    upto = {"_sq": F.sum(F.col("_aa") + 2 * d * F.col("_ab") + d * d * F.col("_bb")).over(by_step), "_rows": F.sum("_n").over(by_step),
            "_next": F.coalesce(F.lead("step").over(by_step), F.lit(2 ** 31 - 1))}
    ends = grid(spark, horizons, "horizon", "int")
    met = tried.withColumns(upto).join(ends, (F.col("horizon") > F.col("step")) & (F.col("horizon") <= F.col("_next")))
    return met.select("tau_s", "horizon", F.sqrt(F.greatest(F.col("_sq"), F.lit(0.0)) / F.nullif(F.col("_rows"), F.lit(0))).alias("exponential"))


def baseline_rmse(windows: DataFrame, y: str, ambient: str, horizons: DataFrame | Iterable[int], dt_s: float = 1.0,
                  taus: DataFrame | Iterable[float] = RELAXATION_TAUS) -> DataFrame:
    """Both baselines in one pass: persistence is relaxation that never comes to anything."""
    spark = windows.sparkSession
    every = grid(spark, taus, "tau_s", "double").unionByName(grid(spark, [float("inf")], "tau_s", "double"))
    errors = relaxation_rmse(windows, y, ambient, horizons, dt_s, every)
    still = F.col("tau_s") == float("inf")
    return errors.groupBy("horizon").agg(F.max(F.when(still, F.col("exponential"))).alias("persistence"),
                                         F.min(F.when(~still, F.col("exponential"))).alias("exponential"))


def best_relaxation(per_tau: DataFrame) -> DataFrame:
    return per_tau.groupBy("horizon").agg(F.min("exponential").alias("exponential"),
                                          F.min_by("tau_s", "exponential").alias("tau_s"))


def window_scores(windows: DataFrame, error: Column, horizons: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """Error of given predictions (column ``model``) and windows scored, per key and horizon.

    ``windows`` holds one row per window and step; which model made the prediction is a key column or nothing at all.
    """
    scored = rmse_by_horizon(windows, error, horizons, keys, out="model")
    n = windows.filter("step = 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"))
    return scored.join(n, list(keys)) if keys else scored.withColumn("_one", F.lit(1)).join(F.broadcast(n.withColumn("_one", F.lit(1))), "_one").drop("_one")   # one row


def skill_table(model: DataFrame, baselines: DataFrame) -> DataFrame:
    """Horizon, the three errors, and the share of the better baseline's error that is removed."""
    return model.join(baselines, "horizon").select("horizon", "model", "persistence", "exponential",
                    skill(F.col("model"), F.col("persistence"), F.col("exponential")).alias("skill"))


def huber(error: Column, delta: float = HUBER_DELTA) -> Column:
    a = F.abs(error)
    return F.when(a <= delta, 0.5 * error * error).otherwise(delta * (a - 0.5 * delta))


def spread_over_folds(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of every metric over folds."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
                                      F.count("value").alias("folds"))


# ---- rows: actual against predicted ------------------------------------------------------------

def smape_term(actual: Column, predicted: Column) -> Column:
    """Symmetric error of one row in [0, 2]; zero where both are zero."""
    scale = F.abs(actual) + F.abs(predicted)
    return F.when(scale != 0, 2.0 * F.abs(predicted - actual) / scale).otherwise(F.lit(0.0))


def _r2(y: Column, e2: Column) -> Column:
    """1 - SSE/SST; the total comes from the population variance, which Spark merges stably."""
    total = F.var_pop(y) * F.count(y)
    return 1.0 - F.sum(e2) / F.when(total > 0, total)


def regression_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str, active_w: float = ACTIVE_W) -> DataFrame:
    """Errors of all rows and of the active ones, and how often idle is told from active."""
    y, p = F.col(actual), F.col(predicted)
    on = y > active_w
    only = lambda c: F.when(on, c)
    enough = lambda c: F.when(F.count_if(on) > 1, c)
    e, ae = (y - p) * (y - p), F.abs(y - p)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(on).alias("active_rows"), F.avg(ae).alias("mae"),
        F.avg(e).alias("mse"), F.sqrt(F.avg(e)).alias("rmse"), _r2(y, e).alias("r2"),
        (F.avg(smape_term(y, p)) * 100).alias("smape_pct"),
        enough(F.avg(only(ae))).alias("mae_active_only"), enough(_r2(only(y), only(e))).alias("r2_active_only"),
        enough(F.avg(only(smape_term(y, p))) * 100).alias("smape_active_only_pct"),
        F.avg(((y <= active_w) == (p <= active_w)).cast("int")).alias("idle_detection_accuracy"))


def confusion(df: DataFrame, keys: list[str], actual: Column, predicted: Column, labels: tuple[str, str] = ("idle", "active")) -> DataFrame:
    """All four cells per key, empty ones as zero."""
    cells = [(a, b) for a in (False, True) for b in (False, True)]
    counts = df.groupBy(*keys).agg(*[F.count_if((actual == a) & (predicted == b)).alias(f"_{int(a)}{int(b)}") for a, b in cells])
    rows = F.array(*[F.struct(F.lit(labels[a]).alias("actual"), F.lit(labels[b]).alias("predicted"),
                              F.col(f"_{int(a)}{int(b)}").alias("rows")) for a, b in cells])
    return counts.select(*keys, F.inline(rows))


def classification_scores(df: DataFrame, keys: list[str], actual: Column, predicted: Column) -> DataFrame:
    """Accuracy and F1 of the active class, of both classes averaged, and weighted by class size."""
    hit = lambda a, b: F.count_if((actual == a) & (predicted == b))
    c = df.groupBy(*keys).agg(hit(True, True).alias("tp"), hit(False, True).alias("fp"),
                              hit(True, False).alias("fn"), hit(False, False).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    f1 = lambda t, a, b: F.coalesce(2 * t / F.nullif(2 * t + a + b, F.lit(0)), F.lit(0.0))
    on, off, n = f1(tp, fp, fn), f1(tn, fn, fp), tp + fp + fn + tn
    return c.select(*keys, ((tp + tn) / n).alias("accuracy"), on.alias("f1_binary"), ((on + off) / 2).alias("f1_macro"),
                    ((on * (tp + fn) + off * (tn + fp)) / n).alias("f1_weighted"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins over the range of the data, the last one closed; empty bins are zero."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).withColumn("_one", F.lit(1))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) / bins
    binned = (df.filter(F.col(value).isNotNull()).withColumn("_one", F.lit(1)).join(F.broadcast(span), "_one")   # one row
              .groupBy(F.coalesce(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)), F.lit(0)).alias("bin"))
              .agg(F.count(F.lit(1)).alias("rows")))
    edges = span.select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return (edges.join(binned, "bin", "left")
            .select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("from_value"), F.coalesce("rows", F.lit(0)).alias("rows")))


# ---- quantile forecasts ------------------------------------------------------------------------

def pinball(actual: Column, predicted: Column, q: float | Column) -> Column:
    e = actual - predicted
    return F.greatest(q * e, (q - 1.0) * e)


def coverage(df: DataFrame, keys: list[str], actual: str, intervals: dict[str, tuple[str, str]]) -> DataFrame:
    """Share of rows inside each named interval, and its mean width, in one pass."""
    y = F.col(actual)
    parts = [c for name, (lo, hi) in intervals.items() for c in (
        F.avg(y.between(F.col(lo), F.col(hi)).cast("int")).alias(f"{name}_coverage"), F.avg(F.col(hi) - F.col(lo)).alias(f"{name}_width"))]
    return df.groupBy(*keys).agg(*parts)


def conformal_rank(n: Column, miss: float) -> Column:
    """One-based rank of the finite-sample quantile; beyond n there is no finite correction."""
    return F.ceil((n + 1) * (1.0 - miss))


