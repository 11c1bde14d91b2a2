"""Queries over policy outcomes, savings and quantile forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.operators import forecast, ordered, outcomes, policies, resample, scoring
from tripflow.plans import evaluation
from tripflow.plans.registry import query
from tripflow.session import durable
from tripflow.sources.tables import SAMPLES_SQL, log_series, samples, table

DAY = 86_400.0

# ---- outcomes ----------------------------------------------------------------------------------

_POL_SQL = SAMPLES_SQL + """, gappy AS (SELECT trip, heat_w, CASE WHEN channel <> 'view' THEN cabin_c END AS cabin_c FROM samples), pol AS (
  SELECT trip, 'recorded' AS policy, cabin_c, coalesce(heat_w, 0) AS p FROM gappy
  UNION ALL SELECT trip, 'thermostat', cabin_c, CASE WHEN cabin_c < 21 THEN 7000.0::DOUBLE ELSE 0 END FROM gappy), out_ AS (
  SELECT trip, policy, sum(p) * 10 / 3600 AS energy_wh, count(cabin_c) AS scored_rows,
         sum(CASE WHEN cabin_c IS NOT NULL THEN 2.0::DOUBLE * greatest(0.0::DOUBLE, 21 - cabin_c) + greatest(0.0::DOUBLE, cabin_c - 23) END) * 10 / 60 AS discomfort_kmin,
         max(p) AS peak_w FROM pol GROUP BY 1, 2)"""


def _outcomes(spark, sf):
    s = samples(spark, sf).withColumn("cabin_c", F.when(F.col("channel") != "view", F.col("cabin_c")))
    power = F.inline(F.array(F.struct(F.lit("recorded").alias("policy"), F.coalesce(policies.recorded(), F.lit(0.0)).alias("p")),
                             F.struct(F.lit("thermostat").alias("policy"), policies.thermostat().alias("p"))))
    return outcomes.outcome(s.select("trip", "cabin_c", power), ["trip", "policy"], "cabin_c", "p", 10.0, cold_weight=2.0)


@query("policy_outcome", f"WITH {_POL_SQL} SELECT trip, policy, round(energy_wh, 6) AS energy_wh, round(discomfort_kmin, 6) AS discomfort_kmin, round(peak_w, 6) AS peak_w, scored_rows FROM out_")
def policy_outcome(spark, sf):
    return _outcomes(spark, sf).select("trip", "policy", *[F.round(c, 6).alias(c) for c in ("energy_wh", "discomfort_kmin", "peak_w")], "scored_rows")


#: Frontier per supplier: line discounts are the swept points, target is the mean quantity of the supplier.
_FRONT_SQL = """front AS (SELECT l_suppkey AS trip, l_discount AS weight, avg(l_quantity) AS discomfort_kmin, avg(l_extendedprice) / 100 AS energy_wh
  FROM lineitem GROUP BY 1, 2), target AS (SELECT l_suppkey AS trip, avg(l_quantity) + (l_suppkey % 7 - 3) AS target, avg(l_extendedprice) / 90 AS base_wh, max(l_quantity) AS km FROM lineitem GROUP BY 1), seg AS (
  SELECT trip, discomfort_kmin AS d0, energy_wh AS e0, lead(discomfort_kmin) OVER w AS d1, lead(energy_wh) OVER w AS e1 FROM front
  WINDOW w AS (PARTITION BY trip ORDER BY discomfort_kmin, energy_wh)), hit AS (
  SELECT t.trip, e0 + (e1 - e0) * (target - d0) / (d1 - d0) AS e FROM target t JOIN seg s ON s.trip = t.trip AND target >= d0 AND target < d1), read AS (
  SELECT t.*, h.e AS energy_at_target, h.e IS NOT NULL AS reachable, CASE WHEN base_wh > 0 THEN 1 - h.e / base_wh END AS saving FROM target t LEFT JOIN hit h USING (trip))"""


def _savings(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "trip")
    front = li.groupBy("trip", "l_discount").agg(F.avg("l_quantity").alias("discomfort_kmin"), (F.avg("l_extendedprice") / 100).alias("energy_wh"))
    target = li.groupBy("trip").agg((F.avg("l_quantity") + (F.col("trip") % 7 - 3)).alias("target"), (F.avg("l_extendedprice") / 90).alias("base_wh"),
                                    F.max("l_quantity").alias("km"))
    return outcomes.saving(outcomes.frontier_energy(front, target, ["trip"]), "base_wh", "energy_at_target")


@query("iso_target_lookup", f"WITH {_FRONT_SQL} SELECT trip, round(target, 6) AS target, round(energy_at_target, 4) AS energy_at_target, reachable FROM read")
def iso_target_lookup(spark, sf):
    return _savings(spark, sf).select("trip", F.round("target", 6).alias("target"), F.round("energy_at_target", 4).alias("energy_at_target"), "reachable")


@query("equal_comfort_saving", f"WITH {_FRONT_SQL} SELECT trip, round(saving, 6) AS saving FROM read")
def equal_comfort_saving(spark, sf):
    return _savings(spark, sf).select("trip", F.round("saving", 6).alias("saving"))


@query("saving_report", f"""WITH {_FRONT_SQL} SELECT count(*) AS trips, count(saving) AS scored, round(avg(saving), 6) AS saving_mean, round(stddev_samp(saving), 6) AS saving_sd FROM read""")
def saving_report(spark, sf):
    return outcomes.saving_report(_savings(spark, sf)).withColumns({c: F.round(c, 6) for c in ("saving_mean", "saving_sd")})


@query("range_gain", f"""WITH {_FRONT_SQL}, k AS (SELECT *, km * least(1.0::DOUBLE, 1200 / greatest(target * 60, 1)) AS d FROM read)
SELECT trip, round(CASE WHEN d > 0 AND base_wh * 5 > 0 THEN (base_wh - energy_at_target) / (base_wh * 5 / d) END, 6) AS gain_km FROM k""")
def range_gain(spark, sf):
    s = _savings(spark, sf)
    gain = outcomes.range_gain_km(F.col("base_wh") - F.col("energy_at_target"), F.col("km"), F.col("base_wh") * 5, 1200.0, F.col("target"))
    return s.select("trip", F.round(gain, 6).alias("gain_km"))


@query("head_rows", f"""WITH {SAMPLES_SQL}, p AS (SELECT trip, row_number() OVER (PARTITION BY trip ORDER BY time_s, seq) AS r, count(*) OVER (PARTITION BY trip) AS n FROM samples)
SELECT trip, max(n) AS rows, count(*) FILTER (WHERE n >= 60) AS scored FROM p WHERE r <= 60 GROUP BY trip""")
def head_rows(spark, sf):
    placed = ordered.with_position(samples(spark, sf).select("trip", "time_s", "seq"), log_series(spark, sf))
    head, short = outcomes.head_rows(placed, 60, ["trip"])
    sizes = placed.groupBy("trip").agg((F.max("pos") + 1).alias("rows"))
    scored = head.groupBy("trip").agg(F.count(F.lit(1)).alias("scored")).join(sizes, "trip").select("trip", "rows", "scored")
    return scored.unionByName(short.select("trip", "rows", F.lit(0).cast("bigint").alias("scored")))


@query("consumption", f"""WITH {SAMPLES_SQL} SELECT trip, round(sum(abs(volts * amps)) / 3600, 6) AS consumption_wh FROM samples GROUP BY trip""")
def consumption(spark, sf):
    return outcomes.consumption_wh(samples(spark, sf), ["trip"], "volts", "amps").withColumn("consumption_wh", F.round("consumption_wh", 6))


@query("trip_enrichment", """SELECT o_orderkey AS trip, round(o_totalprice, 2) AS energy, c_mktsegment AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def trip_enrichment(spark, sf):
    meta = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    o = table(spark, sf, "orders").join(meta, "o_custkey", "left")
    return o.select(F.col("o_orderkey").alias("trip"), F.round("o_totalprice", 2).alias("energy"), "segment")


@query("union_details", f"""WITH {SAMPLES_SQL}
SELECT trip, 'heat' AS kind, count(heat_w) AS n, round(max(heat_w), 4) AS peak_w, NULL::DOUBLE AS top_speed FROM samples GROUP BY trip
UNION ALL SELECT trip, 'speed', count(speed_kmh), NULL, max(speed_kmh) FROM samples GROUP BY trip""")
def union_details(spark, sf):
    s = samples(spark, sf)
    heat = s.groupBy("trip").agg(F.count("heat_w").alias("n"), F.round(F.max("heat_w"), 4).alias("peak_w")).withColumn("kind", F.lit("heat"))
    speed = s.groupBy("trip").agg(F.count("speed_kmh").alias("n"), F.max("speed_kmh").alias("top_speed")).withColumn("kind", F.lit("speed"))
    return heat.unionByName(speed, allowMissingColumns=True)


# ---- forecasts ---------------------------------------------------------------------------------

_H = [1, 3, 7]
_GRID_SQL = SAMPLES_SQL + """, grid AS (
  SELECT trip, floor(time_s / 86400)::BIGINT AS day, avg(cabin_c * 20) AS p, min(floor(time_s / 86400)) OVER (PARTITION BY trip)::BIGINT AS day0
  FROM samples GROUP BY trip, floor(time_s / 86400)), labelled AS (
  SELECT a.trip, a.day, a.p, h.horizon, b.p AS label, CASE WHEN a.p < 150 THEN 0 WHEN a.p < 300 THEN 1 ELSE 2 END AS bin
  FROM grid a CROSS JOIN (VALUES (1), (3), (7)) h(horizon) JOIN grid b ON b.trip = a.trip AND b.day = a.day + h.horizon), roles AS (
  SELECT l.*, f.fold, CASE WHEN trip % 3 = f.fold THEN 'test' WHEN trip % 4 = 0 THEN 'calibrate' ELSE 'fit' END AS role
  FROM labelled l CROSS JOIN (VALUES (0), (1), (2)) f(fold))"""


def _grid(spark, sf):
    s = samples(spark, sf).select("trip", "time_s", (F.col("cabin_c") * 20).alias("p"))
    return resample.block_mean(s, DAY, ["p"]).withColumn("day", (F.col("time_s") / DAY).cast("bigint"))


def _roles(spark, sf):
    lab = forecast.with_future(_grid(spark, sf), "day", "p", _H)
    lab = lab.withColumn("bin", F.when(F.col("p") < 150, 0).when(F.col("p") < 300, 1).otherwise(2))
    every = lab.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return every.withColumn("role", F.when(F.col("trip") % 3 == F.col("fold"), "test").when(F.col("trip") % 4 == 0, "calibrate").otherwise("fit"))


@query("future_label", f"WITH {_GRID_SQL} SELECT trip, day, horizon, round(label, 6) AS label FROM labelled")
def future_label(spark, sf):
    lab = forecast.with_future(_grid(spark, sf), "day", "p", _H)
    return lab.select("trip", "day", "horizon", F.round("label", 6).alias("label"))


@query("lag_features", f"""WITH {SAMPLES_SQL}
SELECT trip, seq, round(lag(cabin_c, 1) OVER w, 6) AS lag_1, round(lag(cabin_c, 2) OVER w, 6) AS lag_2,
  round(avg(cabin_c) OVER (PARTITION BY trip ORDER BY time_s, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean_3,
  round(time_s - min(time_s) OVER (PARTITION BY trip), 6) AS elapsed_s FROM samples WINDOW w AS (PARTITION BY trip ORDER BY time_s, seq)""")
def lag_features(spark, sf):
    s = samples(spark, sf).select("trip", "time_s", "seq", "cabin_c")
    out = forecast.lag_features(s, log_series(spark, sf), "cabin_c")
    return out.select("trip", "seq", *[F.round(c, 6).alias(c) for c in ("lag_1", "lag_2", "mean_3")], F.round("elapsed_s", 6).alias("elapsed_s"))


@query("persistence_forecast", f"""WITH {_GRID_SQL}
SELECT horizon, round(avg(greatest(0.5::DOUBLE * (label - p), -0.5::DOUBLE * (label - p))), 6) AS pinball FROM labelled GROUP BY 1""")
def persistence_forecast(spark, sf):
    lab = forecast.with_future(_grid(spark, sf), "day", "p", _H)
    return lab.groupBy("horizon").agg(F.round(F.avg(scoring.pinball(F.col("label"), F.col("p"), 0.5)), 6).alias("pinball"))


_STARTED_SQL = """started AS (SELECT trip, day, day - day0 AS elapsed, p FROM grid), curve AS (
  SELECT f.fold, elapsed, median(p) AS curve FROM started CROSS JOIN (VALUES (0), (1), (2)) f(fold) WHERE trip % 3 <> f.fold GROUP BY 1, 2)"""


def _elapsed(spark, sf):
    """The daily grid with the days since the trip began."""
    g = _grid(spark, sf)
    return ordered.attach(g, g.groupBy("trip").agg(F.min("day").alias("day0")), ["trip"]).withColumn("elapsed", F.col("day") - F.col("day0"))


def _curve(spark, sf):
    every = _elapsed(spark, sf).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(2)))).filter("trip % 3 <> fold")
    return forecast.warmup_curve(every, ["fold"], "elapsed", "p")


@query("warmup_curve", f"WITH {_GRID_SQL}, {_STARTED_SQL} SELECT fold, elapsed, round(curve, 6) AS curve FROM curve")
def warmup_curve(spark, sf):
    return _curve(spark, sf).withColumn("curve", F.round("curve", 6))


_Q = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
_FC_SQL = _GRID_SQL + f""", fine AS (
  SELECT fold, horizon, bin, {', '.join(f'quantile_cont(label, {q}) AS {n}' for n, q in _Q.items())} FROM roles WHERE role = 'fit' GROUP BY 1, 2, 3), coarse AS (
  SELECT fold, horizon, {', '.join(f'quantile_cont(label, {q}) AS a_{n}' for n, q in _Q.items())} FROM roles WHERE role = 'fit' GROUP BY 1, 2), fc AS (
  SELECT r.*, {', '.join(f'coalesce({n}, a_{n}) AS {n}' for n in _Q)} FROM roles r LEFT JOIN fine USING (fold, horizon, bin) LEFT JOIN coarse USING (fold, horizon) WHERE role <> 'fit'), cal AS (
  SELECT fold, horizon, greatest(p10 - label, label - p90) AS s, row_number() OVER (PARTITION BY fold, horizon ORDER BY greatest(p10 - label, label - p90)) AS r,
         count(*) OVER (PARTITION BY fold, horizon) AS n FROM fc WHERE role = 'calibrate'), shift AS (
  SELECT fold, horizon, max(CASE WHEN r = ceil((n + 1) * 0.8::DOUBLE) THEN s END) AS shift FROM cal GROUP BY 1, 2)"""


def _forecast(spark, sf):
    r = durable(_roles(spark, sf), "forecast-rows")
    keys = ["fold", "horizon"]
    t = evaluation.fit_forecast(r.filter("role = 'fit'"), keys, "bin")
    return forecast.forecast(r.filter("role <> 'fit'"), t, keys, "bin")


@query("binned_quantiles", f"WITH {_FC_SQL} SELECT fold, horizon, bin, {', '.join(f'round({n}, 6) AS {n}' for n in _Q)} FROM fine")
def binned_quantiles(spark, sf):
    t = forecast.binned_quantiles(_roles(spark, sf).filter("role = 'fit'"), ["fold", "horizon"], "bin")
    return t.select("fold", "horizon", "bin", *[F.round(n, 6).alias(n) for n in _Q])


@query("pinball", f"WITH {_FC_SQL} " + " UNION ALL ".join(
    f"SELECT horizon, '{n}' AS quantile, round(avg(greatest({q}::DOUBLE * (label - {n}), ({q}::DOUBLE - 1) * (label - {n}))), 6) AS pinball FROM fc WHERE role = 'test' GROUP BY 1" for n, q in _Q.items()))
def pinball(spark, sf):
    f = _forecast(spark, sf).filter("role = 'test'")
    per = F.inline(F.array(*[F.struct(F.lit(n).alias("quantile"), scoring.pinball(F.col("label"), F.col(n), q).alias("l")) for n, q in _Q.items()]))
    return f.select("horizon", per).groupBy("horizon", "quantile").agg(F.round(F.avg("l"), 6).alias("pinball"))


@query("conformal_shift", f"WITH {_FC_SQL} SELECT fold, horizon, round(shift, 6) AS shift FROM shift")
def conformal_shift(spark, sf):
    cal = _forecast(spark, sf).filter("role = 'calibrate'")
    return forecast.conformal_shift(cal, ["fold", "horizon"]).withColumn("shift", F.round("shift", 6))


@query("conformal_coverage", f"""WITH {_FC_SQL}
SELECT horizon, round(avg((label BETWEEN p10 AND p90)::INT), 6) AS raw_coverage, round(avg((label BETWEEN p10 - shift AND p90 + shift)::INT), 6) AS coverage,
  round(avg(p90 - p10 + 2 * shift), 5) AS width FROM fc JOIN shift USING (fold, horizon) WHERE role = 'test' GROUP BY 1""")
def conformal_coverage(spark, sf):
    wide = evaluation.calibrated_forecast(_roles(spark, sf), ["fold", "horizon"], "bin")
    both = scoring.coverage(wide, ["horizon"], "label", {"raw": ("p10", "p90"), "conformal": ("p10_wide", "p90_wide")})
    return both.select("horizon", F.round("raw_coverage", 6).alias("raw_coverage"), F.round("conformal_coverage", 6).alias("coverage"),
                       F.round("conformal_width", 5).alias("width"))


@query("forecast_skill", f"""WITH {_FC_SQL}, {_STARTED_SQL}, scored AS (
  SELECT t.horizon, abs(label - p50) AS model, abs(label - t.p) AS persistence, abs(label - c.curve) AS warmup
  FROM fc t JOIN started s USING (trip, day) JOIN curve c ON c.fold = t.fold AND c.elapsed = s.elapsed + t.horizon WHERE t.role = 'test')
SELECT horizon, count(*) AS rows, round(avg(model), 5) AS model, round(avg(persistence), 5) AS persistence, round(avg(warmup), 5) AS warmup,
  round(1 - avg(model) / least(avg(persistence), avg(warmup)), 5) AS skill FROM scored GROUP BY 1""")
def forecast_skill(spark, sf):
    """Median forecast against the better of persistence and the warm-up curve, on test trips; both learned on training trips."""
    test = _forecast(spark, sf).filter("role = 'test'").join(_elapsed(spark, sf).select("trip", "day", "elapsed"), ["trip", "day"])
    test = test.withColumn("elapsed", F.col("elapsed") + F.col("horizon"))
    skill = forecast.skill(ordered.attach(test, _curve(spark, sf), ["fold", "elapsed"]), ["horizon"], "label", "p50", {"persistence": "p", "warmup": "curve"})
    return skill.select("horizon", "rows", *[F.round(c, 5).alias(c) for c in ("model", "persistence", "warmup", "skill")])
