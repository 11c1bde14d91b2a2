"""Queries for regression, features, metrics and the two-stage model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.functions.scalars import round_to_step, state_label
from tripflow.operators import features, ordered, regression, scoring
from tripflow.plans.registry import query
from tripflow.session import durable
from tripflow.sources.tables import SAMPLES_SQL, log_series, samples, table


# ---- regression --------------------------------------------------------------------------------

_STEADY = SAMPLES_SQL + """, near AS (
  SELECT *, time_s - lag(time_s) OVER w AS hs, lead(time_s) OVER w - time_s AS hd, lag(cabin_c) OVER w AS f0, lead(cabin_c) OVER w AS f1
  FROM samples WINDOW w AS (PARTITION BY trip ORDER BY time_s, seq)), rated AS (
  SELECT *, CASE WHEN hs IS NULL THEN (f1 - cabin_c) / hd WHEN hd IS NULL THEN (cabin_c - f0) / hs
    ELSE (hs * hs * f1 + (hd * hd - hs * hs) * cabin_c - hd * hd * f0) / (hs * hd * (hs + hd)) END AS rate FROM near), steady AS (
  SELECT *, coalesce(cabin_c > 5 AND abs(rate) < 0.0005 AND heat_w > 200 AND cabin_c - amb_c > 2, false) AS steady FROM rated)"""


def _steady(spark, sf):
    return regression.with_steady(samples(spark, sf), log_series(spark, sf), "cabin_c", "amb_c", "speed_kmh", "heat_w", setpoint=9.0,
                                  max_rate=0.0005, min_gap=2.0)


@query("steady_rows", f"WITH {_STEADY} SELECT trip, seq, steady FROM steady")
def steady_rows(spark, sf):
    return _steady(spark, sf).select("trip", "seq", "steady")


_TERMS = _STEADY + """, terms AS (
  SELECT trip, cabin_c - amb_c AS x1, speed_kmh / 3.6::DOUBLE * (cabin_c - amb_c) AS x2, 0.96::DOUBLE * heat_w AS y, speed_kmh / 3.6::DOUBLE AS v
  FROM steady WHERE steady), kept AS (SELECT * FROM terms WHERE trip IN (SELECT trip FROM terms GROUP BY trip HAVING count(*) >= 10))"""
_OLS = """SELECT (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2"""


@query("steady_loss_estimates", f"""WITH {_TERMS}, p AS (
  SELECT var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, count(*) AS n,
         max(v) AS max_v, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(DISTINCT trip) AS g FROM kept), pooled AS ({_OLS} FROM p), d AS (
  SELECT x1 - avg(x1) OVER t AS x1, x2 - avg(x2) OVER t AS x2, y - avg(y) OVER t AS y FROM kept WINDOW t AS (PARTITION BY trip)), q AS (
  SELECT sum(x1 * x1) AS s11, sum(x2 * x2) AS s22, sum(x1 * x2) AS s12, sum(x1 * y) AS c1, sum(x2 * y) AS c2 FROM d), within_ AS ({_OLS} FROM q), per AS (
  SELECT trip, corr(v, y / x1) AS r, regr_slope(y / x1, v) AS slope FROM kept GROUP BY trip HAVING stddev_pop(v) > 1e-6 AND stddev_pop(y / x1) > 1e-6), c AS (
  SELECT avg(r) AS r, avg((slope > 0)::INT) AS pos FROM per)
SELECT round(pooled.b1, 5) AS b1, round(pooled.b2, 5) AS b2, round(my - pooled.b1 * m1 - pooled.b2 * m2, 4) AS b0, n AS n_rows, g AS n_groups,
  round(max_v, 5) AS max_v, round(within_.b1, 5) AS within_b1, round(within_.b2, 5) AS within_b2, round(r, 6) AS corr, round(pos, 6) AS positive_share,
  within_.b2 > 0.5 AND r > 0.2 AND pos > 0.7 AS detected FROM p, pooled, within_, c""")
def steady_loss_estimates(spark, sf):
    terms = regression.heat_terms(_steady(spark, sf).filter("steady"), "cabin_c", "amb_c", "speed_kmh", "heat_w")
    out = regression.loss_estimates(regression.group_moments(terms, "trip", min_rows=10))
    r = lambda c, d: F.round(c, d).alias(c)
    return out.select(r("b1", 5), r("b2", 5), r("b0", 4), "n_rows", "n_groups", r("max_v", 5), r("within_b1", 5),
                      r("within_b2", 5), r("corr", 6), r("positive_share", 6), "detected")


_LINES_SQL = """lines AS (SELECT l_suppkey AS g, l_quantity AS x1, l_quantity * l_discount AS x2, l_extendedprice AS y, l_discount AS v FROM lineitem)"""


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x1"), (F.col("l_quantity") * F.col("l_discount")).alias("x2"),
        F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("v"))


@query("pooled_ols", f"""WITH {_LINES_SQL}, p AS (
  SELECT var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, count(*) AS n,
         avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(DISTINCT g) AS k FROM lines), b AS ({_OLS} FROM p)
SELECT round(b1, 5) AS b1, round(b2, 5) AS b2, round(my - b1 * m1 - b2 * m2, 4) AS b0, n AS n_rows, k AS n_groups FROM p, b""")
def pooled_ols(spark, sf):
    out = regression.pooled_ols(regression.group_moments(_lines(spark, sf), "g"))
    return out.select(F.round("b1", 5).alias("b1"), F.round("b2", 5).alias("b2"), F.round("b0", 4).alias("b0"), "n_rows", "n_groups")


@query("fixed_effects_ols", f"""WITH {_LINES_SQL}, d AS (
  SELECT x1 - avg(x1) OVER t AS x1, x2 - avg(x2) OVER t AS x2, y - avg(y) OVER t AS y FROM lines WINDOW t AS (PARTITION BY g)), q AS (
  SELECT sum(x1 * x1) AS s11, sum(x2 * x2) AS s22, sum(x1 * x2) AS s12, sum(x1 * y) AS c1, sum(x2 * y) AS c2 FROM d), b AS ({_OLS} FROM q)
SELECT round(b1, 5) AS within_b1, round(b2, 5) AS within_b2 FROM b""")
def fixed_effects_ols(spark, sf):
    out = regression.within_ols(regression.group_moments(_lines(spark, sf), "g"))
    return out.select(F.round("within_b1", 5).alias("within_b1"), F.round("within_b2", 5).alias("within_b2"))


@query("within_group_corr", f"""WITH {_LINES_SQL}, per AS (
  SELECT g, corr(v, y / x1) AS r, regr_slope(y / x1, v) AS slope FROM lines GROUP BY g)
SELECT round(avg(r), 6) AS corr, round(avg((slope > 0)::INT), 6) AS positive_share FROM per""")
def within_group_corr(spark, sf):
    out = regression.within_correlation(regression.group_moments(_lines(spark, sf), "g"))
    return out.select(F.round("corr", 6).alias("corr"), F.round("positive_share", 6).alias("positive_share"))


# ---- actual against predicted ------------------------------------------------------------------

#: Quantity times list price predicts the line price; scaled down to heater watts.
_PRED_SQL = """pred AS (
  SELECT l_suppkey AS trip, l_orderkey, l_linenumber, l_returnflag AS split,
    CASE WHEN least(7000.0::DOUBLE, l_extendedprice / 12) <= 400 THEN 0 ELSE least(7000.0::DOUBLE, l_extendedprice / 12) END AS actual_w,
    round_even(CASE WHEN l_quantity >= 4 THEN l_quantity * p_retailprice / 12 ELSE 0 END / 40.0::DOUBLE, 0) * 40 AS predicted_w
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_ACT = 400.0


def _pred(spark, sf):
    li = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    j = li.join(part, "l_partkey").withColumn("actual_w", F.col("l_extendedprice") / 12)
    j = features.clean_target(j, "actual_w", active_w=_ACT)
    guess = F.when(F.col("l_quantity") >= 4, F.col("l_quantity") * F.col("p_retailprice") / 12).otherwise(0.0)
    return j.select(F.col("l_suppkey").alias("trip"), "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("split"), "actual_w",
                    round_to_step(guess, 40.0).alias("predicted_w"))


@query("prediction_table", f"""WITH {_PRED_SQL}
SELECT trip, split, count(*) AS rows, round(sum(abs(actual_w - predicted_w)), 4) AS abs_error_w, round(sum(actual_w - predicted_w), 4) AS residual_w,
  count(*) FILTER (WHERE actual_w > {_ACT}) AS active FROM pred GROUP BY 1, 2""")
def prediction_table(spark, sf):
    t = features.prediction_table(_pred(spark, sf), ["trip", "split"], "actual_w", "predicted_w", _ACT)
    return t.groupBy("trip", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("abs_error_w"), 4).alias("abs_error_w"),
        F.round(F.sum("residual_w"), 4).alias("residual_w"), F.count_if(F.col("state") == "active").alias("active"))


_SM = "CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 2 * abs(p - y) / (abs(y) + abs(p)) END"


@query("regression_metrics", f"""WITH {_PRED_SQL}, z AS (SELECT split, actual_w AS y, predicted_w AS p FROM pred)
SELECT split, count(*) AS rows, count(*) FILTER (WHERE y > {_ACT}) AS active_rows, round(avg(abs(y - p)), 5) AS mae, round(avg((y - p) ** 2), 3) AS mse,
  round(sqrt(avg((y - p) ** 2)), 5) AS rmse, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(avg({_SM}) * 100, 5) AS smape_pct,
  round(avg(abs(y - p)) FILTER (WHERE y > {_ACT}), 5) AS mae_active_only,
  round(1 - sum((y - p) ** 2) FILTER (WHERE y > {_ACT}) / (var_pop(y) FILTER (WHERE y > {_ACT}) * count(*) FILTER (WHERE y > {_ACT})), 6) AS r2_active_only,
  round(avg({_SM}) FILTER (WHERE y > {_ACT}) * 100, 5) AS smape_active_only_pct,
  round(avg(((y <= {_ACT}) = (p <= {_ACT}))::INT), 6) AS idle_detection_accuracy FROM z GROUP BY split""")
def regression_metrics(spark, sf):
    m = scoring.regression_metrics(_pred(spark, sf), ["split"], "actual_w", "predicted_w", _ACT)
    digits = {"mae": 5, "mse": 3, "rmse": 5, "r2": 6, "smape_pct": 5, "mae_active_only": 5, "r2_active_only": 6,
              "smape_active_only_pct": 5, "idle_detection_accuracy": 6}
    return m.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("run_summary_document", f"""WITH {_PRED_SQL}, m AS (
  SELECT split, count(*) AS rows, round(avg(abs(actual_w - predicted_w)), 3) AS mae FROM pred GROUP BY 1)
SELECT (SELECT count(*) FROM pred) AS total_rows, string_agg(split || ':' || rows || ':' || mae, ';' ORDER BY rows DESC, split) AS metrics FROM m""")
def run_summary_document(spark, sf):
    from tripflow.sources.store import summary_document
    p = _pred(spark, sf)
    m = scoring.regression_metrics(p, ["split"], "actual_w", "predicted_w", _ACT).select("split", "rows", F.round("mae", 3).alias("mae"))
    doc = summary_document(m, total_rows=F.sum("rows"))
    back = doc.select(F.from_json("document", "total_rows bigint, metrics array<struct<split:string,rows:bigint,mae:double>>").alias("d")).select("d.*")
    ordered_rows = F.array_sort(F.transform("metrics", lambda r: F.struct((-r["rows"]).alias("n"), r["split"], r["rows"], r["mae"])))
    return back.select("total_rows", F.array_join(F.transform(ordered_rows, lambda r: F.concat_ws(":", r["split"], r["rows"], r["mae"])), ";").alias("metrics"))


@query("confusion_matrix", f"""WITH {_PRED_SQL}
SELECT s.split, a.label AS actual, p.label AS predicted, count(x.split) AS rows FROM (SELECT DISTINCT split FROM pred) s
CROSS JOIN (VALUES ('idle'), ('active')) a(label) CROSS JOIN (VALUES ('idle'), ('active')) p(label)
LEFT JOIN pred x ON x.split = s.split AND (x.actual_w > {_ACT}) = (a.label = 'active') AND (x.predicted_w > {_ACT}) = (p.label = 'active') GROUP BY 1, 2, 3""")
def confusion_matrix(spark, sf):
    return scoring.confusion(_pred(spark, sf), ["split"], F.col("actual_w") > _ACT, F.col("predicted_w") > _ACT)


@query("classification_scores", f"""WITH {_PRED_SQL}, c AS (
  SELECT split, count(*) FILTER (WHERE a AND p)::DOUBLE AS tp, count(*) FILTER (WHERE NOT a AND p)::DOUBLE AS fp, count(*) FILTER (WHERE a AND NOT p)::DOUBLE AS fn,
    count(*) FILTER (WHERE NOT a AND NOT p)::DOUBLE AS tn FROM (SELECT split, actual_w > {_ACT} AS a, predicted_w > {_ACT} AS p FROM pred) GROUP BY 1), f AS (
  SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f_on, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f_off FROM c)
SELECT split, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(f_on, 6) AS f1_binary, round((f_on + f_off) / 2, 6) AS f1_macro,
  round((f_on * (tp + fn) + f_off * (tn + fp)) / (tp + tn + fp + fn), 6) AS f1_weighted FROM f""")
def classification_scores(spark, sf):
    s = scoring.classification_scores(_pred(spark, sf), ["split"], F.col("actual_w") > _ACT, F.col("predicted_w") > _ACT)
    return s.withColumns({c: F.round(c, 6) for c in ("accuracy", "f1_binary", "f1_macro", "f1_weighted")})


@query("group_statistics", f"""WITH {_PRED_SQL}
SELECT trip, round(avg(actual_w), 4) AS power_mean, round(stddev_samp(actual_w), 4) AS power_sd, round(median(actual_w), 6) AS power_median
FROM pred GROUP BY trip""")
def group_statistics(spark, sf):
    g = features.group_statistics(_pred(spark, sf), "trip", "actual_w", "power")
    return g.select("trip", F.round("power_mean", 4).alias("power_mean"), F.round("power_sd", 4).alias("power_sd"), F.round("power_median", 6).alias("power_median"))


@query("error_histogram", f"""WITH {_PRED_SQL}, e AS (SELECT actual_w - predicted_w AS e FROM pred), s AS (SELECT min(e) AS lo, (max(e) - min(e)) / 60 AS w FROM e), h AS (
  SELECT least(floor((e - lo) / w)::BIGINT, 59) AS bin, count(*) AS rows FROM e, s GROUP BY 1)
SELECT b.bin, round(lo + b.bin * w, 6) AS from_value, coalesce(rows, 0) AS rows FROM (SELECT unnest(range(60)) AS bin) b CROSS JOIN s LEFT JOIN h USING (bin)""")
def error_histogram(spark, sf):
    e = _pred(spark, sf).select((F.col("actual_w") - F.col("predicted_w")).alias("e"))
    return scoring.histogram(e, "e", 60).withColumn("from_value", F.round("from_value", 6))


@query("class_share", f"""WITH {_PRED_SQL}
SELECT split, CASE WHEN actual_w > {_ACT} THEN 'active' ELSE 'idle' END AS state, count(*) AS rows FROM pred GROUP BY 1, 2""")
def class_share(spark, sf):
    return (_pred(spark, sf).withColumn("state", state_label("actual_w", _ACT)).groupBy("split", "state").agg(F.count(F.lit(1)).alias("rows")))


# ---- features ----------------------------------------------------------------------------------

_FEATURES = ["qty", "disc", "tax", "size", "list", "qty_twin", "flat", "sparse"]
_FEAT_SQL = """feat AS (SELECT l_extendedprice AS target_w, l_quantity AS qty, l_discount AS disc, l_tax AS tax, p_size::DOUBLE AS size, p_retailprice AS list,
  l_quantity * 2 + l_tax AS qty_twin, 1.0::DOUBLE AS flat, CASE WHEN l_linenumber = 1 AND l_discount > 0.05 THEN l_tax END AS sparse, l_returnflag AS split
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _feat(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("list"))
    return table(spark, sf, "lineitem").join(part, "l_partkey").select(
        F.col("l_extendedprice").alias("target_w"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), "size", "list",
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("qty_twin"), F.lit(1.0).alias("flat"),
        F.when((F.col("l_linenumber") == 1) & (F.col("l_discount") > 0.05), F.col("l_tax")).alias("sparse"), F.col("l_returnflag").alias("split"))


@query("column_completeness", f"WITH {_FEAT_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(count({c}) / count(*), 6) AS share FROM feat" for c in _FEATURES))
def column_completeness(spark, sf):
    return features.column_shares(_feat(spark, sf), _FEATURES).withColumn("share", F.round("share", 6))


@query("row_completeness", f"""WITH {SAMPLES_SQL}
SELECT trip, seq FROM samples WHERE (CASE WHEN heat_w IS NULL THEN 0 ELSE 1 END + CASE WHEN channel = 'view' THEN 0 ELSE 1 END) / 2.0 > 0.5""")
def row_completeness(spark, sf):
    s = samples(spark, sf).withColumn("c2", F.when(F.col("channel") != "view", F.col("cabin_c")))
    return features.complete_rows(s, ["heat_w", "c2"], 0.5).select("trip", "seq")


@query("clean_target", f"""WITH {SAMPLES_SQL}
SELECT seq, round(CASE WHEN least(heat_w, 7000.0::DOUBLE) <= 120 THEN 0 ELSE least(heat_w, 7000.0::DOUBLE) END, 6) AS target_w FROM samples WHERE heat_w IS NOT NULL""")
def clean_target(spark, sf):
    s = samples(spark, sf).select("seq", F.col("heat_w").alias("target_w"))
    return features.clean_target(s).select("seq", F.round("target_w", 6).alias("target_w"))


@query("derived_features", f"""WITH {SAMPLES_SQL}
SELECT seq, round(volts * amps, 6) AS f_battery_power_w, round(cabin_c - amb_c, 6) AS f_cabin_ambient_dt, round(speed_kmh * speed_kmh, 6) AS f_velocity_sq,
  (speed_kmh > 1)::INT::DOUBLE AS f_is_moving, round(greatest(0.0::DOUBLE, 20 - amb_c), 6) AS f_warmup_needed FROM samples""")
def derived_features(spark, sf):
    names = {"battery voltage v": "volts", "battery current a": "amps", "ambient temperature c": "amb_c",
             "cabin temperature sensor c": "cabin_c", "velocity km h": "speed_kmh"}
    new = ["f_battery_power_w", "f_cabin_ambient_dt", "f_velocity_sq", "f_is_moving", "f_warmup_needed"]
    return features.derived_features(samples(spark, sf), names).select("seq", *[F.round(c, 6).alias(c) for c in new])


@query("median_impute", f"""WITH {SAMPLES_SQL}, m AS (SELECT median(heat_w) AS m FROM samples WHERE trip % 3 <> 0)
SELECT seq, round(coalesce(heat_w, m), 6) AS heat_w FROM samples, m""")
def median_impute(spark, sf):
    s = samples(spark, sf)
    return features.impute(s, features.fit_medians(s.filter("trip % 3 <> 0"), ["heat_w"])).select("seq", F.round("heat_w", 6).alias("heat_w"))


@query("select_features", f"""WITH {_FEAT_SQL}, r AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS feature, coalesce(abs(corr({c}, target_w)), 0) AS abs_r FROM feat" for c in _FEATURES if c != "flat")}), k AS (
  SELECT *, row_number() OVER (ORDER BY abs_r DESC, feature) - 1 AS rank FROM r), twins AS (
  {' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM feat" for a in _FEATURES for b in _FEATURES if a != b and "flat" not in (a, b))})
SELECT feature, round(abs_r, 6) AS abs_r, rank::INT AS rank, NOT EXISTS (SELECT 1 FROM twins t JOIN k e ON e.feature = t.a WHERE t.b = k.feature AND e.rank < k.rank AND e.rank < 6 AND t.r > 0.993) AS kept
FROM k WHERE rank < 6""")
def select_features(spark, sf):
    return features.select_features(_feat(spark, sf), _FEATURES, "target_w", top_n=6).withColumn("abs_r", F.round("abs_r", 6))


def _r_sql(a: str, b: str) -> str:
    return f"CASE WHEN NOT isnan(corr({a}, {b})) THEN corr({a}, {b}) END"


@query("correlation_matrix", f"WITH {_FEAT_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round({_r_sql(a, b)}, 6) AS r FROM feat" for a in _FEATURES for b in _FEATURES))
def correlation_matrix(spark, sf):
    return features.correlation_matrix(_feat(spark, sf), _FEATURES).withColumn("r", F.round("r", 6))


@query("top_mean_correlation", f"""WITH {_FEAT_SQL}, m AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, abs({_r_sql(a, b)}) AS r FROM feat" for a in _FEATURES for b in _FEATURES)})
SELECT a, round(avg(r), 6) AS mean_abs_r FROM m GROUP BY a ORDER BY mean_abs_r DESC NULLS LAST, a LIMIT 3""")
def top_mean_correlation(spark, sf):
    m = features.correlation_matrix(_feat(spark, sf), _FEATURES)
    return features.top_mean_correlation(m, 3).withColumn("mean_abs_r", F.round("mean_abs_r", 6))


_HURDLE_SQL = """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN least(7000.0::DOUBLE, round_even((exp(ln(1 + (l_extendedprice + 0.001::DOUBLE) / 12)) - 1) / 40, 0) * 40) ELSE 0 END AS predicted_w FROM lineitem"""


@query("hurdle_prediction", _HURDLE_SQL)
def hurdle_prediction(spark, sf):
    li = table(spark, sf, "lineitem")
    p = features.hurdle(F.col("l_discount") * 10, F.log1p((F.col("l_extendedprice") + 0.001) / 12))
    return li.select("l_orderkey", "l_linenumber", p.alias("predicted_w"))


def _two_stage(spark, sf):
    df = features.clean_target(_feat(spark, sf).withColumn("target_w", F.col("qty") * 150 - 800))
    cols = ["qty", "disc", "tax", "size", "list"]
    # Every tree reads the rows again: written, or each would join them anew.
    df = durable(df.select("target_w", *cols, "split"), "two-stage-rows")
    models = features.fit_two_stage(df.filter("split <> 'R'").withColumn("stop", F.col("split") == "A"), cols, rounds=5, depth=4, validation="stop")
    return df, cols, models


@query("two_stage_model", f"""WITH {_FEAT_SQL}, t AS (SELECT split, CASE WHEN least(greatest(qty * 150 - 800, 0), 7000) <= 120 THEN 0 ELSE 1 END AS on_ FROM feat)
SELECT split, count(*) AS rows, sum(on_)::BIGINT AS active_rows, true AS on_grid, true AS better_than_mean FROM t GROUP BY 1""")
def two_stage_model(spark, sf):
    """Facts that SQL can state of a fitted model: rows, active rows, predictions on their grid, errors below the mean's."""
    df, _, models = _two_stage(spark, sf)
    p = durable(features.predict_two_stage(models, df).select("split", "target_w", "predicted_w"), "two-stage-predictions")
    grid = F.bool_and(p.predicted_w.between(0, 7000) & (F.abs(p.predicted_w - F.round(p.predicted_w / 40) * 40) < 1e-6) | (p.predicted_w == 7000))
    m = scoring.regression_metrics(p, ["split"], "target_w", "predicted_w").select("split", "rows", "active_rows", "mae")
    means = p.groupBy("split").agg(F.avg("target_w").alias("mean"), grid.alias("on_grid"))
    naive = p.join(means, "split").groupBy("split", "on_grid").agg(F.avg(F.abs(F.col("target_w") - F.col("mean"))).alias("naive"))
    return m.join(naive, "split").select("split", "rows", "active_rows", "on_grid", (F.col("mae") < F.col("naive")).alias("better_than_mean"))


@query("feature_importance", f"""WITH {_FEAT_SQL} SELECT unnest(['classifier', 'regressor']) AS stage, 5 AS features, 1.0::DOUBLE AS total, true AS in_range
FROM (SELECT count(*) AS n FROM feat) WHERE n > 0""")
def feature_importance(spark, sf):
    _, cols, models = _two_stage(spark, sf)
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("v")) for c in ("classifier", "regressor")]))
    return features.importances(models, cols, spark).select(each).groupBy("stage").agg(
        F.count("v").cast("int").alias("features"), F.round(F.sum("v"), 6).alias("total"), F.bool_and(F.col("v").between(0, 1)).alias("in_range"))


@query("thinned_rows", f"""WITH {SAMPLES_SQL}, p AS (
  SELECT trip, seq, row_number() OVER (PARTITION BY trip ORDER BY time_s, seq) - 1 AS pos, count(*) OVER (PARTITION BY trip) AS n FROM samples)
SELECT trip, seq FROM p WHERE pos % (CASE WHEN n > 20 THEN n // 20 ELSE 1 END) = 0""")
def thinned_rows(spark, sf):
    placed = ordered.with_position(samples(spark, sf).select("trip", "time_s", "seq"), log_series(spark, sf))
    return features.thin(placed, ["trip"], 20).select("trip", "seq")


@query("first_trips", f"""WITH {SAMPLES_SQL} SELECT trip, seq FROM samples WHERE trip IN (SELECT DISTINCT trip FROM samples ORDER BY trip LIMIT 3)""")
def first_trips(spark, sf):
    return features.first_keys(samples(spark, sf).select("trip", "seq"), "trip", 3)


@query("top_errors_per_trip", f"""WITH {_PRED_SQL}
SELECT trip, l_orderkey, l_linenumber, round(abs(actual_w - predicted_w), 5) AS abs_error_w FROM pred
QUALIFY row_number() OVER (PARTITION BY trip ORDER BY abs(actual_w - predicted_w) DESC, l_orderkey, l_linenumber) <= 3""")
def top_errors_per_trip(spark, sf):
    p = _pred(spark, sf).withColumn("abs_error_w", F.abs(F.col("actual_w") - F.col("predicted_w")))
    top = features.best_per_group(p, ["trip"], [F.desc("abs_error_w"), F.col("l_orderkey"), F.col("l_linenumber")], 3)
    return top.select("trip", "l_orderkey", "l_linenumber", F.round("abs_error_w", 5).alias("abs_error_w"))
