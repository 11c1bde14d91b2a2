"""How the benchmark tables stand in for telemetry, with the same views as SQL text.

``events`` is the sensor log: a user is a vehicle trip, every event one sample.  ``orders`` is the
trip overview, ``lineitem`` the regression table, ``part`` the table of parameter sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.operators.ordered import Series

#: Zero of the log clock; a literal, so that seconds need no pass over the data.
CLOCK_ZERO = "2024-01-01 00:00:00"
#: One week of log: the time block the ordered operators use on this sparse log.
WEEK_S = 604_800.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long log: trip, time_s, seq, channel, value, props."""
    return telemetry_of(table(spark, sf_dir, "events"))


def telemetry_of(events: DataFrame) -> DataFrame:
    clock = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{CLOCK_ZERO}', ts) / 1e6D")
    return events.select(
        F.col("user_id").alias("trip"), clock.alias("time_s"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("channel"), "value", "props")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide log: one row per sample; the heater channel is missing on ``error`` rows."""
    return samples_of(telemetry(spark, sf_dir))


def samples_of(log: DataFrame) -> DataFrame:
    k = F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS double)")
    t = log.withColumn("k", k)
    return t.select(
        "trip", "time_s", "seq",
        F.when(F.col("channel") != "error", F.col("value") * 20.0).alias("heat_w"),
        (F.col("value") / 4.0).alias("cabin_c"),
        (F.col("k") / 4.0 - 5.0).alias("amb_c"),
        (F.col("k") * 2.0).alias("speed_kmh"),
        F.when(F.col("channel") == "click", F.col("value") * 10.0).otherwise(0.0).alias("ac_w"),
        (F.col("k") + 300.0).alias("volts"),
        (F.col("value") - 20.0).alias("amps"),
        "channel")


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip overview: one row per trip (order) of a vehicle (customer)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("vehicle"), F.col("o_orderkey").alias("trip"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM").alias("warm_start"),
        (F.col("o_totalprice") / 20000.0 - 5.0).alias("amb_start_c"))


def log_series(spark: SparkSession, sf_dir: str) -> Series:
    """Order of the log by clock and event number: weekly blocks, shorter for trips that are dense."""
    return Series(tie=("seq",), block_s=WEEK_S).fitted(telemetry(spark, sf_dir))


#: The same views for the SQL side.
TELEMETRY_SQL = f"""telemetry AS (
  SELECT user_id AS trip, date_diff('microsecond', TIMESTAMP '{CLOCK_ZERO}', ts)::DOUBLE / 1e6 AS time_s,
         event_id AS seq, event_type AS channel, value, props FROM events)"""
SAMPLES_SQL = TELEMETRY_SQL + """, samples AS (
  SELECT trip, time_s, seq,
         CASE WHEN channel <> 'error' THEN value * 20.0::DOUBLE END AS heat_w,
         value / 4.0::DOUBLE AS cabin_c, k / 4.0::DOUBLE - 5.0::DOUBLE AS amb_c,
         k * 2.0::DOUBLE AS speed_kmh,
         CASE WHEN channel = 'click' THEN value * 10.0::DOUBLE ELSE 0.0::DOUBLE END AS ac_w,
         k + 300.0::DOUBLE AS volts, value - 20.0::DOUBLE AS amps, channel
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM telemetry))"""
OVERVIEW_SQL = """overview AS (
  SELECT o_custkey AS vehicle, o_orderkey AS trip, strftime(o_orderdate, '%Y-%m-%d') AS day,
         o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS warm_start,
         o_totalprice / 20000.0::DOUBLE - 5.0::DOUBLE AS amb_start_c FROM orders)"""
