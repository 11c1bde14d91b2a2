"""Queries over the sensor log: audit, range checks, resampling, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.operators import canonical, ordered, quality, resample
from tripflow.operators.quantiles import exact_quantile
from tripflow.plans.registry import query
from tripflow.sources.tables import (OVERVIEW_SQL, SAMPLES_SQL, TELEMETRY_SQL, log_series, overview, samples,
                                     table, telemetry)

SIGNALS = ["heat_w", "cabin_c", "amb_c", "speed_kmh", "ac_w", "volts", "amps"]


def _quality(spark, sf):
    return quality.quality_record(samples(spark, sf), log_series(spark, sf), "heat_w", SIGNALS)


_PRESENT = "list_filter([" + ", ".join(
    f"CASE WHEN count({c}) > 0 THEN '{c}' END" for c in ["time_s", *SIGNALS]) + "], lambda x: x IS NOT NULL)"
_KEPT = "heat_w IS NOT NULL AND heat_w <= 7000"
_CONSTANT = "list_filter([" + ", ".join(
    f"CASE WHEN count({c}) > 0 AND count(DISTINCT {c}) FILTER (WHERE {_KEPT}) <= 1 THEN '{c}' END"
    for c in ["time_s", *SIGNALS]) + "], lambda x: x IS NOT NULL)"
QUALITY_SQL = SAMPLES_SQL + f""", dts AS (
  SELECT trip, time_s - lag(time_s) OVER (PARTITION BY trip ORDER BY time_s, seq) AS dt FROM samples), ivals AS (
  SELECT trip, stddev_pop(dt) AS dt_sd_s, median(dt) AS dt_median_s FROM dts WHERE dt IS NOT NULL GROUP BY trip),
quality AS (
  SELECT s.*, i.dt_sd_s, i.dt_median_s, i.dt_sd_s > 1e-6 AS dt_irregular FROM (
    SELECT trip, count(*) AS n_rows_raw, count(*) FILTER (WHERE {_KEPT}) AS n_rows_out,
           max(heat_w) AS target_max_raw_w, count(*) FILTER (WHERE heat_w > 7000) AS n_target_over_rating,
           count(DISTINCT heat_w) <= 1 AS target_constant, {_PRESENT} AS present, {_CONSTANT} AS constant_columns,
           avg(CASE WHEN speed_kmh IS NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE {_KEPT}) AS missing_speed
    FROM samples GROUP BY trip) s LEFT JOIN ivals i USING (trip))"""


@query("trip_quality", f"""WITH {QUALITY_SQL}
SELECT trip, n_rows_raw, n_rows_out, round(target_max_raw_w, 6) AS target_max_raw_w, n_target_over_rating,
       target_constant, len(present) AS n_columns, substr(sha1(array_to_string(list_sort(present), ';')), 1, 6) AS schema_id,
       array_to_string(constant_columns, ',') AS constant_columns, round(missing_speed, 6) AS missing_speed,
       round(dt_sd_s, 3) AS dt_sd_s, round(dt_median_s, 7) AS dt_median_s, dt_irregular FROM quality""")
def trip_quality(spark, sf):
    q = _quality(spark, sf)
    return q.select("trip", "n_rows_raw", "n_rows_out", F.round("target_max_raw_w", 6).alias("target_max_raw_w"),
                    "n_target_over_rating", "target_constant", "n_columns", "schema_id",
                    F.concat_ws(",", "constant_columns").alias("constant_columns"),
                    F.round(F.col("frac_missing_by_column")["speed_kmh"], 6).alias("missing_speed"),
                    F.round("dt_sd_s", 3).alias("dt_sd_s"), F.round("dt_median_s", 7).alias("dt_median_s"),
                    "dt_irregular")


@query("range_clean", f"""WITH {SAMPLES_SQL}
SELECT trip, count(*) AS n_rows, count(*) FILTER (WHERE heat_w > 7000) AS n_over,
       count(*) FILTER (WHERE heat_w <= 7000) AS n_kept, max(heat_w) AS max_value FROM samples GROUP BY trip""")
def range_clean(spark, sf):
    return quality.range_counts(samples(spark, sf), ["trip"], "heat_w")


@query("range_clean_rows", f"""WITH {SAMPLES_SQL}
SELECT trip, seq, round(heat_w, 6) AS heat_w FROM samples WHERE heat_w <= 7000""")
def range_clean_rows(spark, sf):
    kept = quality.clean_range(samples(spark, sf), "heat_w")
    return kept.select("trip", "seq", F.round("heat_w", 6).alias("heat_w"))


@query("block_mean_resample", f"""WITH {SAMPLES_SQL}
SELECT trip, floor(time_s / 86400) * 86400.0::DOUBLE AS time_s, round(avg(heat_w), 8) AS heat_w,
       round(avg(cabin_c), 8) AS cabin_c FROM samples GROUP BY trip, floor(time_s / 86400)""")
def block_mean_resample(spark, sf):
    r = resample.block_mean(samples(spark, sf), 86_400.0, ["heat_w", "cabin_c"])
    return r.select("trip", "time_s", F.round("heat_w", 8).alias("heat_w"), F.round("cabin_c", 8).alias("cabin_c"))


@query("over_limit_top_trips", f"""WITH {SAMPLES_SQL}
SELECT trip, count(*) FILTER (WHERE heat_w > 7000) AS n_target_over_rating, max(heat_w) AS target_max_raw_w
FROM samples GROUP BY trip HAVING count(*) FILTER (WHERE heat_w > 7000) > 0
ORDER BY target_max_raw_w DESC, trip LIMIT 5""")
def over_limit_top_trips(spark, sf):
    counts = quality.range_counts(samples(spark, sf), ["trip"], "heat_w")
    return quality.over_limit_top(counts.withColumnsRenamed(
        {"n_over": "n_target_over_rating", "max_value": "target_max_raw_w"}))


@query("over_limit_summary", f"""WITH {SAMPLES_SQL}
SELECT sum(n)::BIGINT AS rows_over, count(*) FILTER (WHERE n > 0) AS trips_over FROM (
  SELECT trip, count(*) FILTER (WHERE heat_w > 7000) AS n FROM samples GROUP BY trip)""")
def over_limit_summary(spark, sf):
    counts = quality.range_counts(samples(spark, sf), ["trip"], "heat_w")
    return quality.over_limit_summary(counts.withColumnRenamed("n_over", "n_target_over_rating"))


@query("corpus_totals", f"""WITH {QUALITY_SQL}
SELECT count(*) AS trips, sum(n_rows_raw)::BIGINT AS rows_raw, sum(n_rows_out)::BIGINT AS rows_out,
       count(DISTINCT round(dt_median_s, 4)) AS periods FROM quality""")
def corpus_totals(spark, sf):
    t = quality.corpus_totals(_quality(spark, sf))
    return t.withColumn("periods", F.size("periods").cast("long"))


_DAY_SETS = f"""WITH {TELEMETRY_SQL}, sets AS (
  SELECT trip, floor(time_s / 86400)::BIGINT AS day, count(*) AS n_columns, list_sort(list(DISTINCT channel)) AS signals
  FROM telemetry GROUP BY 1, 2), ids AS (
  SELECT *, trip::VARCHAR || '#' || day::VARCHAR AS trip_day,
         substr(sha1(array_to_string(signals, ';')), 1, 6) AS schema_id FROM sets)"""


def _day_sets(spark, sf):
    t = telemetry(spark, sf).withColumn("day", F.floor(F.col("time_s") / 86400))
    sets = (t.groupBy("trip", "day").agg(F.count(F.lit(1)).alias("n_columns"),
                                         F.array_sort(F.collect_set("channel")).alias("signals")))
    return (sets.withColumn("schema_id", canonical.fingerprint(F.col("signals")))
            .withColumn("trip_day", F.concat_ws("#", "trip", "day")))


@query("schema_variants", _DAY_SETS + """
SELECT schema_id, count(*) AS trips, min(n_columns) AS lo, max(n_columns) AS hi,
       array_to_string(list_slice(list_sort(list(trip_day)), 1, 4), ',') AS head, greatest(count(*) - 4, 0) AS more
FROM ids GROUP BY schema_id""")
def schema_variants(spark, sf):
    v = quality.schema_variants(_day_sets(spark, sf), trip="trip_day")
    return v.withColumn("head", F.concat_ws(",", "head"))


@query("lost_signals", _DAY_SETS + """, richest AS (
  SELECT signals AS rich FROM (SELECT DISTINCT schema_id, signals FROM ids)
  ORDER BY len(signals) DESC, schema_id LIMIT 1)
SELECT trip_day, schema_id, array_to_string(list_sort(list_filter(rich, lambda s: NOT list_contains(signals, s))), ',') AS lost
FROM ids, richest""")
def lost_signals(spark, sf):
    sets = _day_sets(spark, sf)
    lost = canonical.lost_signals(sets, ["trip_day"])
    return lost.withColumn("lost", F.concat_ws(",", F.array_sort("lost")))


#: Three copies of one channel with gaps, undefined and infinite readings; some trips disagree on the second or third copy.
_APART = "coalesce(bool_or(CASE WHEN {0} = {1} THEN false WHEN isinf({1}) THEN true ELSE abs({0} - {1}) > 1e-8 + 1e-5 * abs({1}) END), false)"
_COPIES_SQL = TELEMETRY_SQL + f""", copies AS (
  SELECT trip, seq, CASE WHEN seq % 13 = 0 THEN 'inf'::DOUBLE WHEN seq % 11 = 0 THEN NULL WHEN channel <> 'view' THEN value END AS a,
         CASE WHEN seq % 13 = 0 THEN 'inf'::DOUBLE WHEN channel <> 'click' THEN CASE WHEN trip % 3 = 0 AND channel = 'error' THEN value + 1 ELSE value END END AS b,
         CASE WHEN seq % 13 = 0 THEN NULL WHEN trip % 5 = 0 AND channel = 'error' THEN value + 2 ELSE value END AS c
  FROM telemetry), second AS (
  SELECT trip, {_APART.format("a", "b")} AS bad1 FROM copies GROUP BY trip), two AS (
  SELECT *, CASE WHEN bad1 THEN a ELSE coalesce(a, b) END AS m FROM copies JOIN second USING (trip)), third AS (
  SELECT trip, {_APART.format("m", "c")} AS bad2 FROM two GROUP BY trip), merged_ AS (
  SELECT trip, seq, CASE WHEN bad2 THEN m ELSE coalesce(m, c) END AS x, CASE WHEN bad1 THEN b WHEN bad2 THEN c END AS x__2,
         concat_ws(',', CASE WHEN NOT bad1 THEN 'x' END, CASE WHEN NOT bad2 THEN 'x' END) AS merged,
         concat_ws(',', CASE WHEN bad1 THEN 'x' END, CASE WHEN bad2 THEN 'x' END) AS conflicting FROM two JOIN third USING (trip))"""


@query("merge_agreeing_columns", f"WITH {_COPIES_SQL} SELECT trip, seq, x, x__2, merged, conflicting FROM merged_")
def merge_agreeing_columns(spark, sf):
    t = telemetry(spark, sf)
    v, endless = F.col("value"), F.col("seq") % 13 == 0
    odd = lambda k, d: F.when((F.col("trip") % k == 0) & (F.col("channel") == "error"), v + d).otherwise(v)
    a = F.when(endless, float("inf")).when(F.col("seq") % 11 == 0, float("nan")).when(F.col("channel") != "view", v)
    b = F.when(endless, float("inf")).when(F.col("channel") != "click", odd(3, 1))
    copies = t.select("trip", "seq", a.alias("a"), b.alias("b"), F.when(~endless, odd(5, 2)).alias("c"))
    out = canonical.merge_copies(copies, ["trip"], {"x": ["a", "b", "c"]})
    return out.withColumns({c: F.concat_ws(",", c) for c in ("merged", "conflicting")})


@query("label_frequency", f"""WITH {_COPIES_SQL}
SELECT kind, label, count(*) AS trips FROM (
  SELECT DISTINCT trip, 'merged' AS kind, merged AS label FROM merged_ UNION ALL SELECT DISTINCT trip, 'conflicting', conflicting FROM merged_)
WHERE label <> '' GROUP BY 1, 2""")
def label_frequency(spark, sf):
    rows = merge_agreeing_columns(spark, sf)
    per_trip = rows.groupBy("trip").agg(F.first("merged").alias("merged"), F.first("conflicting").alias("conflicting"))
    one = lambda k: quality.label_frequency(per_trip, k).select(F.lit(k).alias("kind"), "label", "trips")
    return one("merged").unionByName(one("conflicting"))


_DAILY = TELEMETRY_SQL + """, daily AS (
  SELECT trip, floor(time_s / 86400)::BIGINT AS day, channel, count(DISTINCT value) AS n FROM telemetry GROUP BY 1, 2, 3)"""


@query("constant_channels_top", f"""WITH {_DAILY}
SELECT channel, count(*) AS trips FROM daily WHERE n <= 1 GROUP BY channel ORDER BY trips DESC, channel LIMIT 10""")
def constant_channels_top(spark, sf):
    t = telemetry(spark, sf).withColumn("day", F.floor(F.col("time_s") / 86400))
    flat = t.groupBy("trip", "day", "channel").agg((F.min("value") == F.max("value")).alias("flat")).filter("flat")
    lists = flat.groupBy("trip", "day").agg(F.collect_set("channel").alias("constant_columns"))
    return quality.constant_channel_counts(lists)


@query("idle_trips", f"""WITH {TELEMETRY_SQL}
SELECT concat_ws('#', trip, floor(time_s / 86400)::BIGINT) AS trip_day FROM telemetry
GROUP BY 1 HAVING count(DISTINCT value) <= 1""")
def idle_trips(spark, sf):
    t = telemetry(spark, sf).withColumn("trip_day", F.concat_ws("#", "trip", F.floor(F.col("time_s") / 86400)))
    q = t.groupBy("trip_day").agg(F.min("value").eqNullSafe(F.max("value")).alias("target_constant"))
    return quality.idle_trips(q, "trip_day")


@query("unit_scale", f"""WITH {SAMPLES_SQL}
SELECT trip, round(sum(ac_w * 1000), 3) AS aircon_power_w, round(sum(speed_kmh - 500), 3) AS coolant_flow_lph
FROM samples GROUP BY trip""")
def unit_scale(spark, sf):
    from tripflow.functions import signals as sig
    raw = samples(spark, sf).select("trip", F.col("ac_w").alias("aircon_power_w"), F.col("speed_kmh").alias("coolant_flow_lph"))
    out = sig.apply_units(raw, sig.SCALE, sig.OFFSET)
    return out.groupBy("trip").agg(*[F.round(F.sum(c), 3).alias(c) for c in ("aircon_power_w", "coolant_flow_lph")])


@query("unit_change", f"""WITH {SAMPLES_SQL}
SELECT trip, seq, round(speed_kmh / 3.6::DOUBLE, 6) AS speed_ms, round((speed_kmh / 3.6::DOUBLE) * 3.6::DOUBLE, 6) AS back_kmh
FROM samples""")
def unit_change(spark, sf):
    from tripflow.functions.scalars import kmh_to_ms, ms_to_kmh
    s = samples(spark, sf)
    return s.select("trip", "seq", F.round(kmh_to_ms("speed_kmh"), 6).alias("speed_ms"),
                    F.round(ms_to_kmh(kmh_to_ms("speed_kmh")), 6).alias("back_kmh"))


@query("sample_interval", f"""WITH {TELEMETRY_SQL}, d AS (
  SELECT trip, time_s - lag(time_s) OVER (PARTITION BY trip ORDER BY time_s, seq) AS dt FROM telemetry)
SELECT trip, round(stddev_pop(dt), 3) AS dt_sd_s, round(median(dt), 7) AS dt_median_s,
       stddev_pop(dt) > 1e-6 AS dt_irregular FROM d WHERE dt IS NOT NULL GROUP BY trip""")
def sample_interval(spark, sf):
    out = quality.sample_interval(telemetry(spark, sf), log_series(spark, sf))
    return out.select("trip", F.round("dt_sd_s", 3).alias("dt_sd_s"), F.round("dt_median_s", 7).alias("dt_median_s"),
                      "dt_irregular")


@query("row_position", f"""WITH {TELEMETRY_SQL}
SELECT trip, seq, row_number() OVER (PARTITION BY trip ORDER BY time_s, seq) - 1 AS pos FROM telemetry""")
def row_position(spark, sf):
    return ordered.with_position(telemetry(spark, sf), log_series(spark, sf)).select("trip", "seq", "pos")


@query("signal_gradient", f"""WITH {SAMPLES_SQL}, n AS (
  SELECT trip, seq, cabin_c AS f, time_s - lag(time_s) OVER w AS hs, lead(time_s) OVER w - time_s AS hd,
         lag(cabin_c) OVER w AS f0, lead(cabin_c) OVER w AS f1 FROM samples WINDOW w AS (PARTITION BY trip ORDER BY time_s, seq))
SELECT trip, seq, round(1e6 * CASE WHEN hs IS NULL THEN (f1 - f) / hd WHEN hd IS NULL THEN (f - f0) / hs
  ELSE (hs * hs * f1 + (hd * hd - hs * hs) * f - hd * hd * f0) / (hs * hd * (hs + hd)) END, 4) AS micro_rate FROM n""")
def signal_gradient(spark, sf):
    g = ordered.gradient(samples(spark, sf).select("trip", "seq", "time_s", "cabin_c"), log_series(spark, sf), "cabin_c", "rate")
    return g.select("trip", "seq", F.round(F.col("rate") * 1e6, 4).alias("micro_rate"))


@query("exact_median", f"""WITH {TELEMETRY_SQL}
SELECT trip, round(median(value), 6) AS median_value FROM telemetry GROUP BY trip""")
def exact_median(spark, sf):
    m = exact_quantile(telemetry(spark, sf), ["trip"], "value", 0.5, "median_value")
    return m.withColumn("median_value", F.round("median_value", 6))


@query("effective_sample_size", f"""WITH {TELEMETRY_SQL}, p AS (
  SELECT trip, row_number() OVER (PARTITION BY trip ORDER BY time_s, seq) AS r, count(*) OVER (PARTITION BY trip) AS n,
         value - avg(value) OVER (PARTITION BY trip) AS x FROM telemetry), v AS (
  SELECT trip, any_value(n) AS n, sum(x * x) AS var FROM p GROUP BY trip), lags AS (
  SELECT a.trip, b.r - a.r AS k, sum(a.x * b.x) AS prod FROM p a JOIN p b ON a.trip = b.trip AND b.r - a.r BETWEEN 1 AND 4999
  GROUP BY 1, 2), rho AS (
  SELECT l.trip, k, prod / var AS rho FROM lags l JOIN v USING (trip) WHERE k < least(5000, n - 1)), stop AS (
  SELECT trip, min(k) AS k0 FROM rho WHERE rho <= 0 GROUP BY trip), tot AS (
  SELECT r.trip, sum(rho) AS total FROM rho r LEFT JOIN stop s USING (trip) WHERE k0 IS NULL OR k < k0 GROUP BY r.trip)
SELECT v.trip, n, round(n / (1 + 2 * coalesce(total, 0)), 6) AS n_eff FROM v LEFT JOIN tot USING (trip)""")
def effective_sample_size(spark, sf):
    e = resample.effective_sample_size(telemetry(spark, sf), log_series(spark, sf), "value")
    return e.withColumn("n_eff", F.round("n_eff", 6))


@query("coverage_report", f"""WITH {OVERVIEW_SQL}, d AS (SELECT day, count(*) AS n FROM overview GROUP BY day)
SELECT (SELECT count(*) FROM overview) AS trips, (SELECT min(amb_start_c) FROM overview) AS ambient_min,
       (SELECT max(amb_start_c) FROM overview) AS ambient_max, (SELECT count(*) FROM overview WHERE warm_start) AS warm_starts,
       (SELECT count(*) FROM d) AS days, (SELECT count(*) FROM d WHERE n > 1) AS days_with_more,
       (SELECT count(DISTINCT warm_start) FROM overview) AS setpoints""")
def coverage_report(spark, sf):
    return quality.coverage(overview(spark, sf), setpoint="warm_start", ambient="amb_start_c")


@query("distinct_counts", """SELECT count(DISTINCT o_custkey) AS vehicles, count(DISTINCT o_orderdate) AS days,
  count(DISTINCT o_orderpriority) AS kinds FROM orders""")
def distinct_counts(spark, sf):
    o = table(spark, sf, "orders")
    return o.agg(F.count_distinct("o_custkey").alias("vehicles"), F.count_distinct("o_orderdate").alias("days"),
                 F.count_distinct("o_orderpriority").alias("kinds"))


@query("first_wins_dedup", """SELECT vehicle, day, trip, priority FROM (
  SELECT o_custkey AS vehicle, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS trip, o_orderpriority AS priority,
         row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_wins_dedup(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("vehicle"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_orderkey").alias("trip"), F.col("o_orderpriority").alias("priority"))
    return ordered.first_per_key(o, ["vehicle", "day"], ["trip"], ["trip", "priority"])


@query("whole_row_dedup", "SELECT DISTINCT l_suppkey, l_quantity, l_returnflag FROM lineitem")
def whole_row_dedup(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag").dropDuplicates()


@query("usable_trips", f"""WITH {SAMPLES_SQL}
SELECT trip, seq FROM samples WHERE trip IN (SELECT trip FROM samples WHERE heat_w > 6000)""")
def usable_trips(spark, sf):
    from tripflow.sources.store import usable_trips as keep
    s = samples(spark, sf).withColumn("hot", F.when(F.col("heat_w") > 6000, F.col("heat_w")))
    return keep(s, "hot").select("trip", "seq")
