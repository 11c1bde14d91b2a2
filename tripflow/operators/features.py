"""Cleaning, derived features, selection, imputation and the two-stage model of the flat pipeline."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.functions.scalars import clip, finite, hinge, missing_if_nan, round_to_step, state_label
from tripflow.operators.ordered import attach
from tripflow.operators.quantiles import exact_quantile

# Target limits, activity threshold, completeness, selection and rounding.
CLIP_W, ACTIVE_W, STEP_W, PROBABILITY = (0.0, 7000.0), 120.0, 40.0, 0.5
ROW_SHARE, COLUMN_SHARE, TOP_N, MAX_CORR = 0.05, 0.10, 40, 0.993
# Derived differences as (name, minuend, subtrahend).
DIFFERENCES = (
    ("f_cabin_ambient_dt", "cabin temperature sensor c", "ambient temperature c"),
    ("f_coolant_req_dt", "requested coolant temperature c", "coolant temperature heatercore c"),
    ("f_hx_inlet_dt", "heat exchanger temperature c", "coolant temperature inlet c"),
    ("f_batt_ambient_dt", "battery temperature c", "ambient temperature c"),
    ("f_cabin_coolant_dt", "requested coolant temperature c", "cabin temperature sensor c"),
)
WARM_BELOW_C, BATTERY_COLD_BELOW_C, MOVING_KMH = 20.0, 15.0, 1.0


def clean_target(df: DataFrame, target: str = "target_w", limits: tuple[float, float] = CLIP_W, active_w: float = ACTIVE_W) -> DataFrame:
    """Clip, set idle readings to zero, drop rows without target."""
    held = clip(F.when(~F.isnan(target), F.col(target)), *limits)
    return df.withColumn(target, F.when(held <= active_w, F.lit(0.0)).otherwise(held)).filter(F.col(target).isNotNull())


def derived_features(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Add every derived feature whose inputs exist; infinities become missing.

    ``names`` maps the plain header keys to the columns of ``df`` where they differ.
    """
    at = lambda key: (names or {}).get(key, key)
    have = lambda *keys: all(at(k) in df.columns for k in keys)
    c = lambda key: F.col(f"`{at(key)}`")
    new: dict[str, Column] = {}
    if have("battery voltage v", "battery current a"):
        new["f_battery_power_w"] = c("battery voltage v") * c("battery current a")
    for name, a, b in DIFFERENCES:
        if have(a, b):
            new[name] = c(a) - c(b)
    if have("velocity km h"):
        new["f_velocity_sq"] = c("velocity km h") * c("velocity km h")
        new["f_is_moving"] = F.coalesce(c("velocity km h") > MOVING_KMH, F.lit(False)).cast("double")
    if have("ambient temperature c"):
        new["f_warmup_needed"] = hinge(WARM_BELOW_C, c("ambient temperature c"))
    if have("battery temperature c"):
        new["f_battery_cold"] = hinge(BATTERY_COLD_BELOW_C, c("battery temperature c"))
    return df.withColumns({n: F.when(finite(v), v) for n, v in new.items()})


def present_share(cols: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols]) / len(cols)


def complete_rows(df: DataFrame, cols: list[str], more_than: float = ROW_SHARE) -> DataFrame:
    return df.filter(present_share(cols) > more_than)


def column_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of present values per column, one row each, from a single aggregate."""
    shares = df.agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in cols])
    return shares.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("share")) for c in cols])))


def complete_columns(df: DataFrame, cols: list[str], at_least: float = COLUMN_SHARE) -> list[str]:
    return [r.feature for r in column_shares(df, cols).filter(F.col("share") >= at_least).collect()]    # one row per column


def _moments(df: DataFrame, cols: list[str], shift: list[float]) -> np.ndarray:
    """Over all pairs of columns where both are present: counts, sums and products, as five k x k tables, in one pass.

    Every task adds up its rows with matrix products; k * k numbers per task are all that leaves it.
    """
    k = len(cols)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((5, k, k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1) - shift
            here = np.isfinite(x)
            x, m = np.where(here, x, 0.0), here.astype(float)
            total += [m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, x.T @ x]
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["m"])

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(add_up, "m array<double>")
    cells = parts.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(5 * k * k)
    for r in cells.collect():       # five numbers per pair of columns
        out[r.i] = r.v
    return out.reshape(5, k, k)


def correlation_values(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, dict[str, bool]]:
    """Pairwise-complete correlations of columns (NaN where undefined), and which columns vary."""
    first = df.agg(*[F.avg(missing_if_nan(F.col(c).cast("double"))).alias(f"a{i}") for i, c in enumerate(cols)],
                   *[(F.min(missing_if_nan(F.col(c).cast("double"))) < F.max(missing_if_nan(F.col(c).cast("double")))).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    n, sx, sy, sxx, sxy = _moments(df, cols, [first[f"a{i}"] or 0.0 for i in range(len(cols))])
    with np.errstate(all="ignore"):
        cov, vx = sxy - sx * sy / n, sxx - sx * sx / n
        vy = vx.T
        flat = (vx <= 1e-12 * sxx) | (vy <= 1e-12 * sxx.T)
        r = np.where(flat | (n < 2), np.nan, cov / np.sqrt(vx * vy))
    return np.clip(r, -1.0, 1.0), {c: bool(first[f"v{i}"]) for i, c in enumerate(cols)}


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """All ordered pairs (a, b, r) over rows where both are present; undefined is NULL."""
    r, _ = correlation_values(df, cols)
    rows = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def top_mean_correlation(matrix: DataFrame, n: int = 15) -> DataFrame:
    return (matrix.groupBy("a").agg(F.avg(F.abs("r")).alias("mean_abs_r")).orderBy(F.desc("mean_abs_r"), "a").limit(n))


def select_features(df: DataFrame, cols: list[str], target: str, top_n: int = TOP_N, max_corr: float = MAX_CORR) -> DataFrame:
    """Top varying features by absolute correlation with the target (undefined counts as zero), marked ``kept`` unless an
    earlier one says the same.

    One pass over the rows gives all correlations; what reaches the driver is one number per pair of columns.
    """
    r, varies = correlation_values(df, [*cols, target])
    strength = {c: 0.0 if np.isnan(r[i, -1]) else float(abs(r[i, -1])) for i, c in enumerate(cols) if varies[c]}
    top = sorted(strength, key=lambda c: (-strength[c], c))[:top_n]
    at = {c: i for i, c in enumerate(cols)}
    rows = [(c, strength[c], rank, not any(abs(r[at[c], at[e]]) > max_corr for e in top[:rank])) for rank, c in enumerate(top)]
    return df.sparkSession.createDataFrame(rows, "feature string, abs_r double, rank int, kept boolean")


def fit_medians(train: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact medians of the training rows for all columns in the same passes; one number per column."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]))
    found = {r["column"]: r["m"] for r in exact_quantile(train.select(cells), ["column"], "value", 0.5, "m").collect()}
    return {c: found.get(c) for c in cols}


def impute(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items() if m is not None})


# ---- two-stage model ---------------------------------------------------------------------------

def fit_two_stage(train: DataFrame, features: list[str], target: str = "target_w", active_w: float = ACTIVE_W,
                  rounds: int = 20, depth: int = 5, seed: int = 42, validation: str | None = None):
    """Boosted trees: is the heater active, and how much does it draw (on a log scale) when it is.

    ``validation`` names a boolean column of rows that only decide when to stop.
    """
    labelled = train.withColumns({"_on": (F.col(target) > active_w).cast("double"), "_log": F.log1p(target)})
    extra = {"validationIndicatorCol": validation} if validation else {}
    shared = dict(featuresCol="_x", maxIter=rounds, maxDepth=depth, seed=seed, **extra)
    assemble = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    stage1 = GBTClassifier(labelCol="_on", predictionCol="_c", **shared)
    stage2 = GBTRegressor(labelCol="_log", predictionCol="_reg", **shared)
    first = Pipeline(stages=[assemble, stage1]).fit(labelled)
    second = Pipeline(stages=[assemble, stage2]).fit(labelled.filter("_on = 1"))
    return first, second


def hurdle(prob: Column, log_power: Column, threshold: float = PROBABILITY, step: float = STEP_W,
           limits: tuple[float, float] = CLIP_W) -> Column:
    """Zero unless probably active, else the power back from the log scale, on its step and in range."""
    raw = F.when(prob >= threshold, F.expm1(log_power)).otherwise(F.lit(0.0))
    return clip(round_to_step(raw, step), *limits)


def predict_two_stage(models, df: DataFrame, out: str = "predicted_w") -> DataFrame:
    first, second = models
    p1 = first.transform(df).drop("_x", "rawPrediction", "_c").withColumn("_p", vector_to_array("probability")[1]).drop("probability")
    return second.transform(p1).drop("_x").withColumn(out, hurdle(F.col("_p"), F.col("_reg"))).drop("_p", "_reg")


def importances(models, features: list[str], spark) -> DataFrame:
    """Importance of every feature in both stages; one row per feature."""
    c, r = (m.stages[-1].featureImportances.toArray() for m in models)
    rows = [(f, float(a), float(b)) for f, a, b in zip(features, c, r)]
    return spark.createDataFrame(rows, "feature string, classifier double, regressor double")


def prediction_table(df: DataFrame, keys: list[str], actual: str, predicted: str, active_w: float = ACTIVE_W) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return df.select(*keys, F.col(actual).alias("actual_w"), F.col(predicted).alias("predicted_w"), F.abs(e).alias("abs_error_w"),
                     e.alias("residual_w"), state_label(actual, active_w).alias("state"))


def group_statistics(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Mean, sample deviation and exact median of a value per group."""
    return exact_quantile(df, [key], value, 0.5, f"{out}_median", also={f"{out}_mean": F.avg, f"{out}_sd": F.stddev_samp})


def thin(positioned: DataFrame, keys: list[str], at_most: int = 3000, pos: str = "pos") -> DataFrame:
    """Every k-th row of keys with more than ``at_most`` rows, as for a plot."""
    size = positioned.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    k = F.when(F.col("_n") > at_most, F.floor(F.col("_n") / at_most)).otherwise(F.lit(1))
    return attach(positioned, size, keys).filter(F.col(pos) % k == 0).drop("_n")


def first_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the first n distinct keys."""
    keep = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(keep, key, "left_semi")


def best_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")
