"""The canonical trip store, the trip overview, and report sinks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripflow.functions.scalars import lenient_double, notes_contain, payload_kg, stamp_day
from tripflow.operators.ordered import BLOCK, Series, attach, first_per_key

# Overview headers, the form of a trip id, the note of a warm start.
OVERVIEW_COLUMNS = {
    "Trip": "trip", "Date": "date", "Route/Area": "route", "Weather": "weather",
    "Battery Temperature (Start) [°C]": "batt_temp_start_c",
    "Battery Temperature (End)": "batt_temp_end_c",
    "Battery State of Charge (Start)": "soc_start", "Battery State of Charge (End)": "soc_end",
    "Ambient Temperature (Start) [°C]": "amb_temp_start_c",
    "Target Cabin Temperature": "cabin_setpoint_c", "Distance [km]": "distance_km",
    "Duration [min]": "duration_min", "Fan": "fan", "Note": "note",
}
TRIP_ID = r"(?i)^Trip[AB]\d+$"
WARM_NOTE = "directly after previous"
_TEXT = {"trip", "date", "route", "weather", "fan", "note"}


def is_trip_id(c: Column, pattern: str = TRIP_ID) -> Column:
    """Whole-value, case-insensitive match after trimming; NULL and blanks are no ids."""
    return F.coalesce(F.trim(c).rlike(pattern), F.lit(False))


def overview_table(raw: DataFrame, order: str | None = None, pattern: str = TRIP_ID) -> DataFrame:
    """Overview rows with canonical names, one per trip (the first), with day, payload and warm start.

    ``order`` is the column that holds the row order of the sheet; without it the sheet, a
    table of one row per trip, is taken in scan order.
    """
    seq = F.col(order) if order else F.monotonically_increasing_id()
    have = [F.col(f"`{h}`").cast("string").alias(c) if c in _TEXT else lenient_double(F.col(f"`{h}`")).alias(c)
            for h, c in OVERVIEW_COLUMNS.items() if h in raw.columns]
    lacking = [F.lit(None).cast("string" if c in _TEXT else "double").alias(c)
               for h, c in OVERVIEW_COLUMNS.items() if h not in raw.columns]
    named = raw.select(seq.alias("_seq"), *have, *lacking).withColumn("trip", F.trim("trip"))
    named = named.filter(is_trip_id(F.col("trip"), pattern))
    cols = [c for c in OVERVIEW_COLUMNS.values() if c != "trip"]
    one = first_per_key(named, ["trip"], ["_seq"], cols)
    return one.select("trip", *cols, stamp_day("date").alias("day"), payload_kg("note").alias("payload_kg"),
                      notes_contain("note", WARM_NOTE).alias("warm_start"))


def read_overview(spark: SparkSession, path: str) -> DataFrame:
    """Overview from a CSV or parquet export of the sheet."""
    if path.endswith(".parquet"):
        return overview_table(spark.read.parquet(path))
    return overview_table(spark.read.option("header", "true").csv(path))


def write_trips(df: DataFrame, path: str, key: str = "trip") -> None:
    """Store trips, rows of a trip side by side and in the order of the clock.

    The number of writers follows the data: adaptive execution merges small partitions and splits the one of a hot trip, each
    to about its advisory size.  Files are sorted, so row groups find a trip by their statistics.
    """
    order = [c for c in (key, "time_s") if c in df.columns]
    df.hint("rebalance", key).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_blocks(df: DataFrame, table: str, path: str, s: Series, buckets: int | None = None, rows: int = 4_000_000) -> None:
    """Store a series as a table bucketed by (key, time block) at ``path``, so that later work by block needs no shuffle.

    A hot trip lies in as many buckets as it has blocks.  Without ``buckets`` there is one for about ``rows`` rows, found by
    one count.  A column called like the block column is replaced.
    """
    n = buckets or 1 + df.count() // rows
    keys = s.block_keys
    (s.with_block(df).repartition(n, *keys).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(n, *keys).sortBy(*keys, s.time, *s.tie).saveAsTable(table))


def read_blocks(spark: SparkSession, table: str, s: Series) -> tuple[DataFrame, Series]:
    """The stored series, and ``s`` with the stored blocks instead of computed ones."""
    return spark.table(table), replace(s, block=F.col(BLOCK))


def usable_trips(trips: DataFrame, signal: str = "cabin_temp_c", keys: tuple[str, ...] = ("trip",)) -> DataFrame:
    """Only trips that carry a signal at all."""
    have = trips.groupBy(*keys).agg(F.count(signal).alias("_n")).filter("_n > 0").select(*keys)
    return attach(trips, have, list(keys), "left_semi")


def load_trips(spark: SparkSession, path: str, signal: str = "cabin_temp_c") -> DataFrame:
    """Read the store, keep the usable trips, and fail where there are none."""
    every = spark.read.parquet(path)
    trips = usable_trips(every, signal) if signal in every.columns else every.limit(0)
    if not trips.take(1):
        raise FileNotFoundError(f"no trip with {signal} under {path}")
    return trips


def flat_report(df: DataFrame) -> DataFrame:
    """Table form of nested records: lists become comma strings, maps are left out."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.concat_ws(",", F.col(f.name).cast("array<string>")).alias(f.name))
        elif not isinstance(f.dataType, T.MapType):
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_report(df: DataFrame, path: str) -> None:
    flat_report(df).write.mode("overwrite").option("header", "true").csv(path)


def summary_document(metrics: DataFrame, **scalars: Column) -> DataFrame:
    """One JSON document per run: scalar facts plus the list of metric rows (one per split)."""
    rows = F.sort_array(F.collect_list(F.struct(*metrics.columns))).alias("metrics")
    facts = [c.alias(n) for n, c in scalars.items()]
    return metrics.agg(*facts, rows).select(F.to_json(F.struct("*")).alias("document"))
