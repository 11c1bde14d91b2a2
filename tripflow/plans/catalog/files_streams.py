"""Queries that write files Spark derives from the log and read them back, and streams over the log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tripflow.functions import signals as sig
from tripflow.operators import guards, ordered
from tripflow.plans import ingest
from tripflow.plans.catalog import control
from tripflow.plans.registry import SQL, query
from tripflow.session import scratch
from tripflow.sources import delimited, simulation, store
from tripflow.sources.tables import SAMPLES_SQL, TELEMETRY_SQL, WEEK_S, log_series, samples, samples_of, telemetry, telemetry_of
from tripflow.streaming import online

# ---- files -------------------------------------------------------------------------------------


_FILE_SQL = "CASE WHEN channel = 'error' THEN 'comma' ELSE 'semicolon' END || (trip % 40)"


def _write_logs(spark, sf) -> str:
    """The log as delimited files of two dialects, forty each, with split, doubled, unknown and empty columns."""
    root = scratch(spark, "logs")
    s = samples(spark, sf)
    dialect = F.when(F.col("channel") == "error", "comma").otherwise("semicolon")
    raw = s.select(
        F.col("time_s").alias("Time [s]"), F.when(F.col("channel") != "view", F.col("speed_kmh")).alias("Velocity [km/h]"),
        F.when(F.col("channel") == "view", F.col("speed_kmh")).alias("Velocity [km/h]]]"),
        F.col("heat_w").alias("Requested Heating Power [W]"), (F.col("ac_w") / 1000).alias("AirCon Power [kW]"),
        F.col("cabin_c").alias("Cabin Temperature Sensor [°C]"), F.col("volts").alias("Mystery Channel [x]"),
        F.when(F.col("seq") == 0, F.lit(43650.0)).alias("Unnamed: 7"), F.lit(None).cast("double").alias("Unnamed: 8"),
        F.concat(dialect, F.col("trip") % 40).alias("file"))
    for sep, part in ((";", raw.filter("file LIKE 'semicolon%'")), (",", raw.filter("file LIKE 'comma%'"))):
        (part.repartition(8, "file").sortWithinPartitions("file").write.partitionBy("file").option("header", "true").option("sep", sep)
         .option("encoding", "ISO-8859-1").csv(f"{root}/{'semicolon' if sep == ';' else 'comma'}"))
    return root


@query("delimited_scan", f"""WITH {SAMPLES_SQL}
SELECT {_FILE_SQL} AS trip, time_s, speed_kmh AS velocity_kmh, heat_w AS heat_power_req_w, round(ac_w, 6) AS aircon_power_w, cabin_c AS cabin_temp_c
FROM samples""")
def delimited_scan(spark, sf):
    """Rows of every file under the stem of its name."""
    rows, _ = ingest.read_logs(spark, _write_logs(spark, sf))
    return rows.select("trip", "time_s", "velocity_kmh", "heat_power_req_w", F.round("aircon_power_w", 6).alias("aircon_power_w"), "cabin_temp_c")


@query("extra_field_classes", f"""WITH {SAMPLES_SQL}, files AS (
  SELECT {_FILE_SQL} AS trip, count(*) AS rows, count(volts) AS mystery, count(*) FILTER (WHERE seq = 0) AS stamped FROM samples GROUP BY 1),
fields AS (SELECT trip, rows, 6 AS position, 'Mystery Channel [x]' AS header, mystery AS present FROM files
  UNION ALL SELECT trip, rows, 7, 'Unnamed: 7', stamped FROM files UNION ALL SELECT trip, rows, 8, 'Unnamed: 8', 0 FROM files)
SELECT trip, rows, position, header, present, CASE WHEN header NOT LIKE 'Unnamed:%' THEN 'unmapped' WHEN present = 0 THEN 'trailing_empty'
  WHEN present <= greatest(1, floor(rows * 0.01)) THEN 'stray' ELSE 'unmapped' END AS kind FROM fields""")
def extra_field_classes(spark, sf):
    _, extras = ingest.read_logs(spark, _write_logs(spark, sf))
    return extras.select("trip", "rows", "position", "header", "present", "kind")


@query("load_report", """WITH n AS (SELECT user_id % 40 AS k, count(*) AS n, (SELECT count(*) / 40 FROM events) AS least FROM events GROUP BY 1)
SELECT 'trip=' || k AS file, n AS rows, ',' AS sep, 'cp1252' AS encoding, CASE WHEN n < floor(least) THEN 'too few rows' END AS error FROM n""")
def load_report(spark, sf):
    """One file per forty-fold of trips, all-blank records among the rows; files below the mean size are rejected."""
    root = scratch(spark, "report")
    s = samples(spark, sf).withColumn("k", F.col("trip") % 40)
    raw = s.select("k", F.col("time_s").cast("string").alias("Time [s]"), F.col("cabin_c").cast("string").alias("Cabin Temperature Sensor [°C]"))
    blank = raw.select("k").distinct().select("k", F.lit(None).cast("string").alias("Time [s]"), F.lit(None).cast("string").alias("Cabin Temperature Sensor [°C]"))
    (raw.unionByName(blank).withColumnRenamed("k", "trip").repartition(8, "trip").sortWithinPartitions("trip").write.partitionBy("trip")
     .option("header", "true").option("emptyValue", "").option("encoding", "ISO-8859-1").csv(root))
    return delimited.load_report(spark, root, min_rows=s.count() // 40)


_RUNS_SQL = SAMPLES_SQL + """, runs AS (SELECT CASE trip % 3 WHEN 0 THEN 'Neg10' WHEN 1 THEN '0' ELSE 'Pos10' END || '_' || channel || '_B' || (trip % 2) AS run,
  CASE trip % 3 WHEN 0 THEN -10.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END AS amb_setpoint_c, channel AS strategy, 'B' || (trip % 2) AS bus,
  seq::DOUBLE AS time_s, amb_c AS amb_temp_c, speed_kmh * 3.6::DOUBLE AS velocity_kmh, heat_w * 1000 AS heat_power_req_w FROM samples)"""


def _runs(spark, sf) -> str:
    """The log as simulation exports: three header lines, a doubled name, one file per run."""
    s = samples(spark, sf)
    code = F.when(F.col("trip") % 3 == 0, "Neg10").when(F.col("trip") % 3 == 1, "0").otherwise("Pos10")
    run = F.concat_ws("_", code, "channel", F.concat(F.lit("B"), (F.col("trip") % 2).cast("string")))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("seq", "amb_c", "speed_kmh", "heat_w")]
    rows = s.select(run.alias("run"), F.col("seq").alias("at"), F.concat_ws(";", *cells, F.lit("9")).alias("line"))
    heads = ["t;T;v;p;p2", ";Environment;Vehicle;Battery;Consumption", '"Time [s]";Ambient Temperature [C];Speed [m/s];Heating Power [kW];Heating Power [kW]']
    top = rows.select("run").distinct().select("run", F.posexplode(F.array(*[F.lit(h) for h in heads])).alias("at", "line"))
    root = scratch(spark, "runs")
    (rows.unionByName(top.withColumn("at", F.col("at").cast("long") - 3)).repartition(8, "run").sortWithinPartitions("run", "at")
     .select("run", "line").write.partitionBy("run").text(root))
    return root


@query("simulation_scan", f"""WITH {_RUNS_SQL}
SELECT run, amb_setpoint_c, strategy, bus, time_s, amb_temp_c, round(velocity_kmh, 6) AS velocity_kmh, round(heat_power_req_w, 4) AS heat_power_req_w FROM runs""")
def simulation_scan(spark, sf):
    out = simulation.read_runs(spark, _runs(spark, sf), "*.txt")
    return out.select("run", "amb_setpoint_c", "strategy", "bus", "time_s", "amb_temp_c", F.round("velocity_kmh", 6).alias("velocity_kmh"),
                      F.round("heat_power_req_w", 4).alias("heat_power_req_w"))


@query("simulation_ingest", f"WITH {_RUNS_SQL} SELECT run, count(*) AS rows, (SELECT count(DISTINCT run) FROM runs) AS runs FROM runs GROUP BY 1")
def simulation_ingest(spark, sf):
    out = scratch(spark, "store")
    n = simulation.ingest_runs(spark, _runs(spark, sf), out, "*.txt")
    return spark.read.parquet(out).groupBy(F.col("run").cast("string").alias("run")).agg(F.count(F.lit(1)).alias("rows")).withColumn("runs", F.lit(n).cast("long"))


@query("ingest_report", f"""WITH {SAMPLES_SQL} SELECT count(*) AS rows_raw, count(*) FILTER (WHERE heat_w <= 7000) AS rows_out, max(heat_w) AS target_max,
  'velocity_kmh' AS merged, 'Mystery Channel [x]' AS unmapped FROM samples""")
def ingest_report(spark, sf):
    report = ingest.quality_report(*ingest.read_logs(spark, _write_logs(spark, sf)), block_s=WEEK_S)
    return report.agg(F.sum("n_rows_raw").alias("rows_raw"), F.sum("n_rows_out").alias("rows_out"), F.max("target_max_raw_w").alias("target_max"),
                      F.concat_ws(";", F.collect_set(F.concat_ws(",", "merged_duplicate_columns"))).alias("merged"),
                      F.concat_ws(";", F.collect_set(F.concat_ws(",", "unmapped_columns"))).alias("unmapped"))


@query("store_roundtrip", f"""WITH {SAMPLES_SQL} SELECT channel, count(*) AS rows, round(sum(cabin_c), 4) AS cabin_c FROM samples WHERE channel <> 'error' GROUP BY channel""")
def store_roundtrip(spark, sf):
    path = scratch(spark, "store")
    store.write_trips(samples(spark, sf), path, key="channel")
    kept = store.usable_trips(spark.read.parquet(path), "heat_w", ("channel",))
    return kept.groupBy("channel").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("cabin_c"), 4).alias("cabin_c"))


@query("report_roundtrip", f"""WITH {TELEMETRY_SQL} SELECT trip::VARCHAR AS trip, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels, count(*)::VARCHAR AS rows
FROM telemetry GROUP BY trip""")
def report_roundtrip(spark, sf):
    path = scratch(spark, "report")
    t = telemetry(spark, sf).groupBy("trip").agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.count(F.lit(1)).alias("rows"),
                                                 F.map_from_arrays(F.collect_set("channel"), F.collect_set("channel")).alias("dropped"))
    store.write_report(t, path)
    return spark.read.option("header", "true").csv(path)


# ---- streams -----------------------------------------------------------------------------------


def _stream(spark, sf):
    """The log as a stream of files; the cast keeps the clock free of the session time zone."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return online.event_time(raw)


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("stream_resample", f"""WITH b AS (SELECT user_id AS trip, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)
SELECT trip, epoch_us(start) AS start_us, n, value FROM b WHERE start + INTERVAL 1 DAY <= {_CLOSED}""")
def stream_resample(spark, sf):
    s = _stream(spark, sf).withColumnRenamed("user_id", "trip")
    out = online.run_to_table(online.resample(s, "1 day", ["value"], ["trip"], "10 minutes"), "resample")
    return out.withColumn("value", F.round("value", 6))


@query("stream_dedup", "SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf):
    s = _stream(spark, sf)
    twice = s.unionByName(_stream(spark, sf))
    return online.run_to_table(online.drop_duplicates(twice, ["event_id"], "10 minutes"), "dedup").select("event_id", "user_id")


@query("stream_sessions", f"""WITH g AS (SELECT user_id AS trip, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events), s AS (
  SELECT *, sum(opens) OVER (PARTITION BY trip ORDER BY ts) AS sid FROM g), w AS (SELECT trip, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS z, count(*) AS n FROM s GROUP BY trip, sid)
SELECT trip, epoch_us(a) AS start_us, epoch_us(z) AS end_us, n FROM w WHERE z <= {_CLOSED}""")
def stream_sessions(spark, sf):
    s = _stream(spark, sf).withColumnRenamed("user_id", "trip")
    return online.run_to_table(online.sessions(s, "6 hours", ["trip"], "10 minutes"), "sessions")


@query("stream_guarded_commands", f"""WITH RECURSIVE {TELEMETRY_SQL}, r AS (
  SELECT trip, seq, value * 40 - 100.0::DOUBLE AS p, greatest(0.0::DOUBLE, least(7000.0::DOUBLE, value * 40 - 100)) AS c,
         row_number() OVER (PARTITION BY trip ORDER BY time_s, seq) AS k FROM telemetry), walk AS (
  SELECT trip, seq, k, p, c, c AS a FROM r WHERE k = 1
  UNION ALL SELECT r.trip, r.seq, r.k, r.p, r.c, greatest(w.a - 1000, least(w.a + 1000, r.c)) FROM walk w JOIN r ON r.trip = w.trip AND r.k = w.k + 1)
SELECT trip, seq, round(a, 5) AS applied_w, CASE WHEN p <> c THEN 'actuator limit' WHEN abs(a - c) >= 1e-6 THEN 'rate limit' END AS reason FROM walk""")
def stream_guarded_commands(spark, sf):
    s = _stream(spark, sf).select(F.col("user_id").alias("trip"), F.col("event_id").alias("seq"), (F.unix_micros("ts") / 1e6).alias("time_s"),
                                  (F.col("value") * 40 - 100).alias("proposed"))
    out = online.guarded_commands(s, ordered.Series(tie=("seq",), block_s=WEEK_S), "proposed", 10.0, ["seq"], max_rate=100.0)
    return out.select("trip", "seq", F.round("applied_w", 5).alias("applied_w"), "reason")


@query("tier_columns", f"""WITH {SAMPLES_SQL} SELECT trip, round(sum(speed_kmh), 3) AS velocity_kmh, round(sum(volts), 3) AS batt_voltage_v, round(sum(amps), 3) AS batt_current_a FROM samples GROUP BY trip""")
def tier_columns(spark, sf):
    s = samples(spark, sf).withColumnsRenamed({"speed_kmh": "velocity_kmh", "volts": "batt_voltage_v", "amps": "batt_current_a", "cabin_c": "cabin_temp_c",
                                               "heat_w": "heat_power_req_w", "ac_w": "aircon_power_w"})
    kept = sig.select_tiers(s, "vehicle")
    return kept.groupBy("trip").agg(*[F.round(F.sum(c), 3).alias(c) for c in kept.columns if c != "trip"])


def _replayed(spark, sf, by, run):
    """Three arrivals of the log by equal spans of a column, each written as many files and then run through the stream that
    goes on from the one before; the last result."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    parts, root = scratch(spark, "parts"), scratch(spark, "replay")
    span = events.agg(F.min(by).alias("a"), F.max(by).alias("z")).first()
    cuts = [span.a + (span.z - span.a) / 3, span.a + (span.z - span.a) * 2 / 3]
    out = None
    for at in (F.col(by) < cuts[0], (F.col(by) >= cuts[0]) & (F.col(by) < cuts[1]), F.col(by) >= cuts[1]):
        events.filter(at).write.mode("append").parquet(parts)
        out = run(spark.readStream.schema(events.schema).parquet(parts), root)
    return out


@query("stream_takeovers", SQL["takeover_log"])
def stream_takeovers(spark, sf):
    """The takeover log from a stream of three micro-batches, each a later part of the log."""
    def run(stream, root):
        steps = control.steps_of(samples_of(telemetry_of(stream)))
        return online.supervise(steps, ordered.Series(tie=("seq",), block_s=WEEK_S), "proposed", "backup", control.situation(), control.DT, [],
                                max_rate=control.MAX_RATE, root=root)
    return control.log_of(guards.takeovers(_replayed(spark, sf, "ts", run).withColumn("reason", control.plain_reason())))


@query("stream_late_rows", """WITH s AS (SELECT min(event_id) AS a, max(event_id) AS z FROM events), p AS (
  SELECT ts, CASE WHEN event_id < a + (z - a)::DOUBLE / 3 THEN 0 WHEN event_id < a + (z - a)::DOUBLE * 2 / 3 THEN 1 ELSE 2 END AS batch FROM events, s), b AS (
  SELECT batch, max(epoch_us(ts)) AS newest FROM p GROUP BY batch), m AS (
  SELECT x.batch, max(y.newest) - 600000000 AS mark FROM b x LEFT JOIN b y ON y.batch < x.batch GROUP BY x.batch)
SELECT p.batch, count(*) AS rows, count(*) FILTER (WHERE epoch_us(ts) < mark) AS late, any_value(mark) AS watermark_us
FROM p JOIN m USING (batch) GROUP BY p.batch""")
def stream_late_rows(spark, sf):
    """Events that arrive in the order of their numbers, not of their clocks."""
    return _replayed(spark, sf, "event_id", lambda stream, root: online.late_rows(stream, 600.0, root=root))


@query("stored_positions", f"""WITH {TELEMETRY_SQL}
SELECT trip, seq, row_number() OVER (PARTITION BY trip ORDER BY time_s, seq) - 1 AS pos FROM telemetry""")
def stored_positions(spark, sf):
    """Positions from a store bucketed by trip and block."""
    s, name = log_series(spark, sf), f"blocks_{uuid.uuid4().hex}"
    store.write_blocks(telemetry(spark, sf), name, scratch(spark, "blocks"), s)
    return ordered.with_position(*store.read_blocks(spark, name, s)).select("trip", "seq", "pos")
