"""Queries over recorded commands: policies, guards, slew limits, takeovers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.operators import guards, policies
from tripflow.plans.registry import query
from tripflow.sources.tables import SAMPLES_SQL, log_series, samples

DT, MAX_RATE = 10.0, 200.0


def _steps(spark, sf):
    return steps_of(samples(spark, sf))


def steps_of(s):
    """Samples with gaps in the cabin sensor and commands far outside the heater's range."""
    return s.select("trip", "time_s", "seq", (F.col("speed_kmh") / 3.6).alias("speed_ms"), "amb_c",
                    F.when(F.col("channel") != "view", F.col("cabin_c")).alias("cabin_c"),
                    F.when(F.col("channel") != "error", F.col("heat_w") * 2.0 - 100.0).alias("proposed"),
                    F.when(F.col("channel") == "view", 0.0).otherwise(F.col("amps") * 10.0).alias("backup"))


_STEPS = SAMPLES_SQL + """, steps AS (
  SELECT trip, time_s, seq, speed_kmh / 3.6::DOUBLE AS speed_ms, amb_c, CASE WHEN channel <> 'view' THEN cabin_c END AS cabin_c,
         CASE WHEN channel <> 'error' THEN heat_w * 2.0::DOUBLE - 100.0::DOUBLE END AS proposed,
         CASE WHEN channel = 'view' THEN 0.0::DOUBLE ELSE amps * 10.0::DOUBLE END AS backup,
         row_number() OVER (PARTITION BY trip ORDER BY time_s, seq) - 1 AS pos FROM samples)"""


@query("thermostat_policy", f"""WITH {_STEPS}
SELECT trip, seq, CASE WHEN cabin_c < 21 THEN 7000.0::DOUBLE ELSE 0.0::DOUBLE END AS thermostat_w, proposed AS recorded_w FROM steps""")
def thermostat_policy(spark, sf):
    out = policies.with_policies(_steps(spark, sf), thermostat_w=policies.thermostat(), recorded_w=policies.recorded("proposed"))
    return out.select("trip", "seq", "thermostat_w", "recorded_w")


@query("pi_policy", f"""WITH RECURSIVE {_STEPS}, walk AS (
  SELECT trip, seq, pos, 22.0::DOUBLE - cabin_c AS e,
         greatest(-4000.0::DOUBLE, least(4000.0::DOUBLE, coalesce((22.0::DOUBLE - cabin_c) * 40.0::DOUBLE, 0))) AS i
  FROM steps WHERE pos = 0
  UNION ALL
  SELECT s.trip, s.seq, s.pos, 22.0::DOUBLE - s.cabin_c,
         greatest(-4000.0::DOUBLE, least(4000.0::DOUBLE, w.i + coalesce((22.0::DOUBLE - s.cabin_c) * 40.0::DOUBLE, 0)))
  FROM walk w JOIN steps s ON s.trip = w.trip AND s.pos = w.pos + 1)
SELECT trip, seq, round(CASE WHEN e IS NOT NULL THEN greatest(0.0::DOUBLE, least(7000.0::DOUBLE, 800.0::DOUBLE * e + i)) END, 5) AS pi_w FROM walk""")
def pi_policy(spark, sf):
    out = policies.pi_policy(_steps(spark, sf), log_series(spark, sf), "cabin_c", ["seq"], DT)
    return out.select("trip", "seq", F.round("pi_w", 5).alias("pi_w"))


@query("hysteresis_policy", f"""WITH RECURSIVE {_STEPS}, walk AS (
  SELECT trip, seq, pos, cabin_c, CASE WHEN cabin_c < 15 THEN 1 ELSE 0 END AS hot FROM steps WHERE pos = 0
  UNION ALL
  SELECT s.trip, s.seq, s.pos, s.cabin_c, CASE WHEN s.cabin_c < 15 THEN 1 WHEN s.cabin_c > 35 THEN 0 ELSE w.hot END
  FROM walk w JOIN steps s ON s.trip = w.trip AND s.pos = w.pos + 1)
SELECT trip, seq, CASE WHEN cabin_c IS NOT NULL THEN hot * 7000.0::DOUBLE END AS hysteresis_w FROM walk""")
def hysteresis_policy(spark, sf):
    out = policies.hysteresis(_steps(spark, sf), log_series(spark, sf), "cabin_c", ["seq"], setpoint=25.0, band=10.0)
    return out.select("trip", "seq", "hysteresis_w")


@query("rate_limit", f"""WITH RECURSIVE {_STEPS}, walk AS (
  SELECT trip, seq, pos, coalesce(proposed, 0.0::DOUBLE) AS p, coalesce(proposed, 0.0::DOUBLE) AS a FROM steps WHERE pos = 0
  UNION ALL
  SELECT s.trip, s.seq, s.pos, coalesce(s.proposed, 0.0::DOUBLE),
         greatest(w.a - 500.0::DOUBLE, least(w.a + 500.0::DOUBLE, coalesce(s.proposed, 0.0::DOUBLE)))
  FROM walk w JOIN steps s ON s.trip = w.trip AND s.pos = w.pos + 1)
SELECT trip, seq, round(a, 5) AS applied_w, CASE WHEN abs(a - p) >= 1e-6 THEN 'rate limit' END AS reason FROM walk""")
def rate_limit(spark, sf):
    s = _steps(spark, sf).withColumn("proposed", F.coalesce("proposed", F.lit(0.0)))
    out = guards.rate_limit(s, log_series(spark, sf), "proposed", DT, ["seq", "proposed"], max_rate=50.0)
    return out.select("trip", "seq", F.round("applied_w", 5).alias("applied_w"),
                      guards.rate_reason(F.col("applied_w"), F.col("proposed")).alias("reason"))


@query("lag_filter", f"""WITH RECURSIVE {_STEPS}, walk AS (
  SELECT trip, seq, pos, coalesce(proposed, 0.0::DOUBLE) AS u, coalesce(proposed, 0.0::DOUBLE) AS q FROM steps WHERE pos = 0
  UNION ALL
  SELECT trip, seq, pos, u1, q + 10.0::DOUBLE / 6 * (k1 + 2 * k2 + 2 * k3 + (u1 - (q + 10.0::DOUBLE * k3)) / 45.0::DOUBLE) FROM (
    SELECT *, (um - (q + 5.0::DOUBLE * k2)) / 45.0::DOUBLE AS k3 FROM (
      SELECT *, (um - (q + 5.0::DOUBLE * k1)) / 45.0::DOUBLE AS k2 FROM (
        SELECT s.trip, s.seq, s.pos, coalesce(s.proposed, 0.0::DOUBLE) AS u1, w.q, (w.u - w.q) / 45.0::DOUBLE AS k1,
               (w.u + coalesce(s.proposed, 0.0::DOUBLE)) / 2 AS um
        FROM walk w JOIN steps s ON s.trip = w.trip AND s.pos = w.pos + 1))))
SELECT trip, seq, round(q, 5) AS lagged FROM walk""")
def lag_filter(spark, sf):
    s = _steps(spark, sf).withColumn("proposed", F.coalesce("proposed", F.lit(0.0)))
    out = policies.lag_filter(s, log_series(spark, sf), "proposed", 45.0, DT, ["seq"])
    return out.select("trip", "seq", F.round("lagged", 5).alias("lagged"))


_SITUATION = """CASE WHEN cabin_c IS NULL THEN 'implausible cabin sensor (None)'
    WHEN cabin_c < -40 OR cabin_c > 60 THEN 'implausible cabin sensor'
    WHEN amb_c < -10 OR amb_c > 15 THEN 'ambient ' || round_even(amb_c, 0)::INT || 'C outside identified envelope'
    WHEN speed_ms > 45 THEN 'speed ' || round_even(speed_ms, 0)::INT || ' m/s beyond identified envelope' END"""


def plain_reason():
    """Reason without the reading it quotes, whose digits differ between engines."""
    return F.trim(F.regexp_replace("reason", r"\([0-9.]+\)$", ""))


def situation():
    return [guards.sensor_valid("cabin_c"), guards.input_envelope("amb_c", "speed_ms")]


@query("row_guards", f"""WITH {_STEPS}
SELECT trip, seq, CASE WHEN proposed IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(7000.0::DOUBLE, proposed)) END AS clamped_w,
  CASE WHEN proposed IS NULL THEN 'non-finite action' WHEN proposed < 0 OR proposed > 7000 THEN 'actuator limit' END AS clamp_reason,
  {_SITUATION} AS fault FROM steps""")
def row_guards(spark, sf):
    s = _steps(spark, sf)
    clamp = guards.actuator_clamp()(F.col("proposed"))
    out = s.select("trip", "seq", clamp["value"].alias("clamped_w"), clamp["reason"].alias("clamp_reason"),
                   guards.first_fault(situation()).alias("reason"))
    return out.select("trip", "seq", "clamped_w", "clamp_reason", plain_reason().alias("fault"))


_SUPERVISED = f"""{_STEPS}, judged AS (
  SELECT *, {_SITUATION} AS fault FROM steps), sourced AS (
  SELECT *, CASE WHEN fault IS NOT NULL THEN backup ELSE proposed END AS src FROM judged), ready AS (
  SELECT *, fault IS NULL AND src IS NULL AS swap,
    greatest(0.0::DOUBLE, least(7000.0::DOUBLE, coalesce(CASE WHEN fault IS NULL AND src IS NULL THEN backup ELSE src END, 0.0::DOUBLE))) AS cmd,
    CASE WHEN src IS NULL THEN 'non-finite action' WHEN src < 0 OR src > 7000 THEN 'actuator limit' END AS amend FROM sourced), walk AS (
  SELECT trip, pos, cmd AS a FROM ready WHERE pos = 0
  UNION ALL
  SELECT r.trip, r.pos, greatest(w.a - 2000.0::DOUBLE, least(w.a + 2000.0::DOUBLE, r.cmd))
  FROM walk w JOIN ready r ON r.trip = w.trip AND r.pos = w.pos + 1), supervised AS (
  SELECT r.trip, r.seq, r.pos AS k, r.src AS proposed_w, w.a AS applied_w, (fault IS NOT NULL OR swap) AS fell_back,
    coalesce(fault, CASE WHEN swap THEN 'non-finite action' END, amend, CASE WHEN abs(w.a - r.cmd) >= 1e-6 THEN 'rate limit' END) AS reason
  FROM ready r JOIN walk w ON w.trip = r.trip AND w.pos = r.pos)"""


def _supervised(spark, sf):
    out = guards.supervise(_steps(spark, sf), log_series(spark, sf), "proposed", "backup", situation(), DT, ["seq"], max_rate=MAX_RATE)
    return out.withColumn("reason", plain_reason())


@query("takeover_log", f"""WITH RECURSIVE {_SUPERVISED}
SELECT trip, seq, k, round(proposed_w, 5) AS proposed_w, round(applied_w, 5) AS applied_w, fell_back, reason
FROM supervised WHERE fell_back OR reason IS NOT NULL""")
def takeover_log(spark, sf):
    return log_of(guards.takeovers(_supervised(spark, sf)))


def log_of(log):
    return log.select("trip", "seq", F.col("pos").alias("k"), F.round("proposed_w", 5).alias("proposed_w"),
                      F.round("applied_w", 5).alias("applied_w"), "fell_back", "reason")


@query("takeover_reasons", f"""WITH RECURSIVE {_SUPERVISED}
SELECT reason, count(*) AS steps FROM supervised WHERE fell_back OR reason IS NOT NULL GROUP BY reason""")
def takeover_reasons(spark, sf):
    return guards.takeover_reasons(guards.takeovers(_supervised(spark, sf)))


@query("takeover_summary", f"""WITH RECURSIVE {_SUPERVISED}
SELECT trip, count(*) AS n_steps, count(*) FILTER (WHERE fell_back) AS n_fallback,
  count(*) FILTER (WHERE NOT fell_back AND reason IS NOT NULL) AS n_amended FROM supervised GROUP BY trip""")
def takeover_summary(spark, sf):
    return guards.takeover_summary(_supervised(spark, sf), ["trip"])
