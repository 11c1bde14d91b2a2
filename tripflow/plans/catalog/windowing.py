"""Queries over fixed windows of the log: cutting, filling, baselines, given predictions; parameter tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripflow.functions.scalars import duct_temperature, kmh_to_ms
from tripflow.operators import parameters, scoring, windows
from tripflow.plans.registry import query
from tripflow.sources.tables import SAMPLES_SQL, log_series, samples, table

CHANNELS = ["y", "p_heat_w", "p_ac_w", "amb_temp_c", "speed_ms"]
STEPS, STRIDE, GAP = 16, 4, 0.2


def _inputs(spark, sf):
    s = samples(spark, sf)
    return s.select("trip", "time_s", "seq", F.col("cabin_c").alias("y"), F.col("heat_w").alias("p_heat_w"),
                    F.col("ac_w").alias("p_ac_w"), F.col("amb_c").alias("amb_temp_c"), kmh_to_ms("speed_kmh").alias("speed_ms"))


def _cut(spark, sf, **kw):
    return windows.cut_windows(_inputs(spark, sf), log_series(spark, sf), CHANNELS, STEPS, STRIDE, max_gap=GAP, **kw)


def _filled(spark, sf):
    return windows.fill_gaps(_cut(spark, sf), CHANNELS)


def _cut_sql(length: int, newest: str = "pos // 4") -> str:
    return SAMPLES_SQL + f""", placed AS (
  SELECT trip, time_s, cabin_c AS y, heat_w AS p_heat_w, ac_w AS p_ac_w, amb_c AS amb_temp_c, speed_kmh / 3.6::DOUBLE AS speed_ms,
         heat_w IS NULL AS bad, row_number() OVER (PARTITION BY trip ORDER BY time_s, seq) - 1 AS pos FROM samples), cells AS (
  SELECT *, unnest(range(greatest(0, floor((pos - {length}) / 4.0)::BIGINT + 1), {newest} + 1)) AS window_id FROM placed), stepped AS (
  SELECT *, (pos - window_id * 4)::INT AS step FROM cells), good AS (
  SELECT trip, window_id, min(time_s) AS start_s FROM stepped GROUP BY 1, 2
  HAVING count(*) = {length} AND avg(bad::INT) <= {GAP} AND NOT bool_or(bad AND step = 0)), cut AS MATERIALIZED (
  SELECT s.*, g.start_s FROM stepped s JOIN good g USING (trip, window_id))"""


_FILL = ", ".join(
    f"CASE WHEN NOT bad THEN {c} WHEN z IS NULL THEN a.{c} ELSE a.{c} + (z.{c} - a.{c}) * ((step - a.step)::DOUBLE / (z.step - a.step)) END AS {c}"
    for c in CHANNELS)
_PACK = "CASE WHEN NOT bad THEN {" + ", ".join(f"'{c}': {c}" for c in ["step", *CHANNELS]) + "} END"
FILLED_SQL = _cut_sql(STEPS) + f""", near AS (
  SELECT *, last_value({_PACK} IGNORE NULLS) OVER (PARTITION BY trip, window_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
         first_value({_PACK} IGNORE NULLS) OVER (PARTITION BY trip, window_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z
  FROM cut), filled AS MATERIALIZED (SELECT trip, window_id, start_s, step, {_FILL} FROM near)"""


@query("fixed_windows", f"""WITH {_cut_sql(STEPS)}
SELECT trip, window_id, step, round(start_s, 6) AS start_s, bad, round(y, 6) AS y FROM cut""")
def fixed_windows(spark, sf):
    return _cut(spark, sf).select("trip", "window_id", "step", F.round("start_s", 6).alias("start_s"), "bad", F.round("y", 6).alias("y"))


@query("trip_start_windows", f"""WITH {_cut_sql(20, '0')}
SELECT trip, window_id, count(*) AS simulated, count(*) FILTER (WHERE step >= 4) AS scored,
  count(*) FILTER (WHERE step < 4 + 8) AS truncated FROM cut GROUP BY 1, 2""")
def trip_start_windows(spark, sf):
    w = _cut(spark, sf, burn_in=4, anchor="trip_start")
    short = windows.truncate(w, 8, burn_in=4).groupBy("trip", "window_id").agg(F.count(F.lit(1)).alias("truncated"))
    whole = w.groupBy("trip", "window_id").agg(F.count(F.lit(1)).alias("simulated"), F.count_if(F.col("step") >= 4).alias("scored"))
    return whole.join(short, ["trip", "window_id"])


@query("gap_filled_windows", f"""WITH {FILLED_SQL}
SELECT trip, window_id, step, round(p_heat_w, 8) AS p_heat_w, round(y, 8) AS y, round(speed_ms, 8) AS speed_ms FROM filled""")
def gap_filled_windows(spark, sf):
    return _filled(spark, sf).select("trip", "window_id", "step", *[F.round(c, 8).alias(c) for c in ("p_heat_w", "y", "speed_ms")])


@query("absent_channel_is_zero", f"""WITH {SAMPLES_SQL}, days AS (
  SELECT *, concat_ws('#', trip, floor(time_s / 86400)::BIGINT) AS td FROM samples)
SELECT seq, round(CASE WHEN count(heat_w) OVER (PARTITION BY td) = 0 THEN 0 ELSE heat_w END, 6) AS p_heat_w,
  round(speed_kmh / 3.6::DOUBLE, 6) AS speed_ms, 0.0::DOUBLE AS p_ac_w FROM days""")
def absent_channel_is_zero(spark, sf):
    s = samples(spark, sf).withColumn("td", F.concat_ws("#", "trip", F.floor(F.col("time_s") / 86400)))
    out = windows.model_inputs(s, ("heat_w", "aircon_power_w", "amb_c", "speed_kmh"), ("td",))
    return out.select("seq", *[F.round(c, 6).alias(c) for c in ("p_heat_w", "speed_ms", "p_ac_w")])


@query("first_available_channel", f"""WITH {SAMPLES_SQL}, days AS (
  SELECT *, concat_ws('#', trip, floor(time_s / 432000)::BIGINT) AS td, CASE WHEN channel = 'view' THEN value END AS v1,
         CASE WHEN channel <> 'view' THEN value END AS v2 FROM (SELECT *, amps + 20 AS value FROM samples))
SELECT seq, round(CASE WHEN count(v1) OVER (PARTITION BY td) > 0 THEN v1 ELSE v2 END, 6) AS vent FROM days""")
def first_available_channel(spark, sf):
    value = F.col("amps") + 20
    s = samples(spark, sf).withColumns({
        "td": F.concat_ws("#", "trip", F.floor(F.col("time_s") / 432000)), "v1": F.when(F.col("channel") == "view", value),
        "v2": F.when(F.col("channel") != "view", value)})
    return windows.first_available(s, ("v1", "v2"), "vent", ("td",)).select("seq", F.round("vent", 6).alias("vent"))


@query("excitation_check", f"""WITH {FILLED_SQL}, per AS (
  SELECT trip, window_id, count(*) FILTER (WHERE abs(p_ac_w) > 50) AS n_on, count(*) AS n, avg((speed_ms > 20)::INT) AS fast
  FROM filled GROUP BY 1, 2), t AS (SELECT sum(n_on) / sum(n) AS a, max(fast) AS f FROM per)
SELECT round(a, 6) AS ac_share, round(f, 6) AS fast_share, a < 0.02 AS cop_ac_frozen, f < 0.15 AS ua1_frozen FROM t""")
def excitation_check(spark, sf):
    u = windows.unexcited(_filled(spark, sf))
    return u.withColumns({c: F.round(c, 6) for c in ("ac_share", "fast_share")})


_H = scoring.scored_horizons((4, 8, 1200), STEPS)
_HV = ", ".join(f"({h})" for h in _H)
_BASE = FILLED_SQL + f""", started AS (
  SELECT f.*, z.y AS y0 FROM filled f JOIN (SELECT trip, window_id, y FROM filled WHERE step = 0) z USING (trip, window_id)), pers AS (
  SELECT h.horizon::INT AS horizon, sqrt(avg((y0 - y) ** 2)) AS persistence FROM started JOIN (VALUES {_HV}) h(horizon) ON step < h.horizon GROUP BY 1), taus AS (
  SELECT 10 ** (1.5::DOUBLE + 3.0::DOUBLE * i / 24) AS tau_s FROM range(25) r(i)), relax AS (
  SELECT h.horizon::INT AS horizon, tau_s, sqrt(avg((amb_temp_c + (y0 - amb_temp_c) * exp(-(step * 60.0::DOUBLE) / tau_s) - y) ** 2)) AS exponential
  FROM started CROSS JOIN taus JOIN (VALUES {_HV}) h(horizon) ON step < h.horizon GROUP BY 1, 2), best AS (
  SELECT horizon, min(exponential) AS exponential, arg_min(tau_s, exponential) AS tau_s FROM relax GROUP BY 1)"""


@query("persistence_rmse", f"WITH {_BASE} SELECT horizon, round(persistence, 6) AS persistence FROM pers")
def persistence_rmse(spark, sf):
    p = scoring.persistence_rmse(_filled(spark, sf), "y", _H)
    return p.withColumn("persistence", F.round("persistence", 6))


@query("relaxation_rmse", f"WITH {_BASE} SELECT horizon, round(exponential, 6) AS exponential, round(tau_s, 4) AS tau_s FROM best")
def relaxation_rmse(spark, sf):
    r = scoring.best_relaxation(scoring.relaxation_rmse(_filled(spark, sf), "y", "amb_temp_c", _H, dt_s=60.0))
    return r.withColumns({"exponential": F.round("exponential", 6), "tau_s": F.round("tau_s", 4)})


# ---- given predictions over windows ----------------------------------------------------------------

#: A prediction that comes with the windows: the mean of the three values before (the value itself at the start).
_PRED = FILLED_SQL + """, pred AS (
  SELECT *, coalesce(avg(y) OVER (PARTITION BY trip, window_id ORDER BY step ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), y) AS t FROM filled)"""


def _predicted(spark, sf):
    before = Window.partitionBy("trip", "window_id").orderBy("step").rowsBetween(-3, -1)
    return _filled(spark, sf).withColumn("t", F.coalesce(F.avg("y").over(before), "y"))


def _error():
    return F.col("t") - F.col("y")


@query("window_score", f"""WITH {_PRED}
SELECT h.horizon::INT AS horizon, round(sqrt(avg((t - y) ** 2)), 6) AS model, count(DISTINCT (trip, window_id)) AS windows
FROM pred JOIN (VALUES {_HV}) h(horizon) ON step < h.horizon GROUP BY 1""")
def window_score(spark, sf):
    return scoring.window_scores(_predicted(spark, sf), _error(), _H).withColumn("model", F.round("model", 6))


@query("duct_temperature", f"WITH {_PRED} SELECT trip, window_id, step, round(t + p_heat_w / 70.0::DOUBLE, 5) AS duct_c FROM pred")
def duct_temperatures(spark, sf):
    duct = duct_temperature("t", "p_heat_w", F.lit(70.0))
    return _predicted(spark, sf).select("trip", "window_id", "step", F.round(duct, 5).alias("duct_c"))


@query("window_huber", f"""WITH {_PRED}
SELECT round(avg(CASE WHEN abs(t - y) <= 1 THEN (t - y) ** 2 / 2 ELSE abs(t - y) - 0.5::DOUBLE END)
  + 0.3::DOUBLE * avg(CASE WHEN abs(v) <= 1 THEN v ** 2 / 2 ELSE abs(v) - 0.5::DOUBLE END), 6) AS loss
FROM (SELECT t, y, t + p_heat_w / 70.0::DOUBLE - (y + 30) AS v FROM pred)""")
def window_huber(spark, sf):
    duct = duct_temperature("t", "p_heat_w", F.lit(70.0)) - (F.col("y") + 30)
    loss = F.avg(scoring.huber(_error())) + scoring.VENT_WEIGHT * F.avg(scoring.huber(duct))
    return _predicted(spark, sf).agg(F.round(loss, 6).alias("loss"))


@query("per_trip_rmse", f"""WITH {_PRED}
SELECT trip, round(sqrt(avg((t - y) ** 2)), 6) AS model, round(avg(abs(t - y)) FILTER (WHERE p_heat_w > 120), 6) AS active_mae
FROM pred WHERE step < 8 GROUP BY 1""")
def per_trip_rmse(spark, sf):
    p = _predicted(spark, sf).filter("step < 8")
    active = F.avg(F.when(F.col("p_heat_w") > scoring.ACTIVE_W, F.abs(_error())))
    scored = scoring.rmse_by_horizon(p, _error(), [8], ("trip",), out="model").select("trip", F.round("model", 6).alias("model"))
    return scored.join(p.groupBy("trip").agg(F.round(active, 6).alias("active_mae")), "trip")


@query("worst_trips", f"""WITH {_PRED}
SELECT trip, round(sqrt(avg((t - y) ** 2)), 6) AS model FROM pred WHERE step < 8 GROUP BY 1 ORDER BY model DESC, trip LIMIT 8""")
def worst_trips(spark, sf):
    scored = scoring.rmse_by_horizon(_predicted(spark, sf), _error(), [8], ("trip",), out="model")
    return scored.select("trip", F.round("model", 6).alias("model")).orderBy(F.desc("model"), "trip").limit(8)


@query("skill_by_horizon", f"""WITH {_BASE}, pred AS (
  SELECT *, coalesce(avg(y) OVER (PARTITION BY trip, window_id ORDER BY step ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), y) AS t FROM filled), mod AS (
  SELECT h.horizon::INT AS horizon, sqrt(avg((t - y) ** 2)) AS model FROM pred JOIN (VALUES {_HV}) h(horizon) ON step < h.horizon GROUP BY 1)
SELECT horizon, round(model, 6) AS model, round(persistence, 6) AS persistence, round(exponential, 6) AS exponential,
  round(1 - model / least(persistence, exponential), 6) AS skill FROM mod JOIN pers USING (horizon) JOIN best USING (horizon)""")
def skill_by_horizon(spark, sf):
    p = _predicted(spark, sf)
    t = scoring.skill_table(scoring.rmse_by_horizon(p, _error(), _H, out="model"), scoring.baseline_rmse(p, "y", "amb_temp_c", _H, 60.0))
    return t.withColumns({c: F.round(c, 6) for c in ("model", "persistence", "exponential", "skill")})


@query("history_state", f"""WITH {FILLED_SQL}
SELECT trip, window_id, round(arg_max(y, step), 5) AS last_value,
  round(sum(exp((step - 7) * 10.0::DOUBLE / 1800) * y) / sum(exp((step - 7) * 10.0::DOUBLE / 1800)), 5) AS weighted_mean
FROM filled WHERE step < 8 GROUP BY 1, 2""")
def history_state(spark, sf):
    h = windows.history_mean(_filled(spark, sf), "y", 8, 1800.0, 10.0)
    return h.withColumns({c: F.round(c, 5) for c in ("last_value", "weighted_mean")})


@query("fold_spread", f"""WITH {_PRED}, f AS (
  SELECT trip % 5 AS fold, sqrt(avg((t - y) ** 2)) AS rmse, avg(t - y) AS bias FROM pred GROUP BY 1)
SELECT 'rmse' AS metric, round(avg(rmse), 5) AS mean, round(stddev_samp(rmse), 5) AS sd, count(rmse) AS folds FROM f
UNION ALL SELECT 'bias', round(avg(bias), 5), round(stddev_samp(bias), 5), count(bias) FROM f""")
def fold_spread(spark, sf):
    per = _predicted(spark, sf).groupBy((F.col("trip") % 5).alias("fold")).agg(F.sqrt(F.avg(_error() * _error())).alias("rmse"), F.avg(_error()).alias("bias"))
    out = scoring.spread_over_folds(per, ["rmse", "bias"])
    return out.select("metric", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), "folds")


# ---- parameter tables: one set per part ----------------------------------------------------------

_SETS_SQL = """sets AS (SELECT p_partkey AS set_id, p_retailprice * 20 AS c_cab, p_size * 5.0::DOUBLE AS ua0, p_size / 25.0::DOUBLE AS eta,
  p_retailprice / 5 AS tau_mass FROM part), long AS (
  SELECT set_id, 'c_cab' AS name, c_cab AS value, 2.0e4 AS lo, 1.0e6 AS hi, 1.0e5 AS v0 FROM sets UNION ALL
  SELECT set_id, 'ua0', ua0, 10, 300, 55 FROM sets UNION ALL SELECT set_id, 'eta', eta, 0.3::DOUBLE, 1, 0.85::DOUBLE FROM sets UNION ALL
  SELECT set_id, 'tau_mass', tau_mass, 300, 7200, 1800 FROM sets)"""


def _sets(spark, sf):
    p = table(spark, sf, "part")
    wide = p.select(F.col("p_partkey").alias("set_id"), (F.col("p_retailprice") * 20).alias("c_cab"), (F.col("p_size") * 5.0).alias("ua0"),
                    (F.col("p_size") / 25.0).alias("eta"), (F.col("p_retailprice") / 5).alias("tau_mass"))
    return wide, parameters.long_parameters(wide, ["set_id"], ["c_cab", "ua0", "eta", "tau_mass"])


@query("implausible_parameters", f"WITH {_SETS_SQL} SELECT set_id, name, round(value, 6) AS value FROM long WHERE NOT (value BETWEEN lo AND hi)")
def implausible_parameters(spark, sf):
    return parameters.implausible(_sets(spark, sf)[1]).select("set_id", "name", F.round("value", 6).alias("value"))


@query("plausibility_penalty", f"""WITH {_SETS_SQL}
SELECT set_id, round(sum(greatest(ln(lo) - ln(value), 0) ** 2 + greatest(ln(value) - ln(hi), 0) ** 2), 6) AS penalty FROM long GROUP BY 1""")
def plausibility_penalty(spark, sf):
    return parameters.plausibility_penalty(_sets(spark, sf)[1], ["set_id"]).withColumn("penalty", F.round("penalty", 6))


@query("parameter_movement", f"""WITH {_SETS_SQL}
SELECT set_id, name, round(abs(value - v0) / v0, 6) AS moved, abs(value - v0) / v0 < 0.05 AS stuck FROM long""")
def parameter_movement(spark, sf):
    return parameters.movement(_sets(spark, sf)[1]).select("set_id", "name", F.round("moved", 6).alias("moved"), "stuck")


@query("holding_power", f"WITH {_SETS_SQL} SELECT set_id, round((ua0 + 2.0::DOUBLE * 10) * 22 / greatest(eta, 1e-6), 4) AS power_w FROM sets")
def holding_power(spark, sf):
    wide, _ = _sets(spark, sf)
    return wide.select("set_id", F.round(parameters.holding_power(F.col("ua0"), F.lit(2.0), F.col("eta"), speed_ms=10.0), 4).alias("power_w"))
