"""Simulation exports: three header lines, columns found by position in the third."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.functions import signals as sig
from tripflow.functions.scalars import ms_to_kmh, run_name_parts
from tripflow.sources import logscan, store

HEADER_LINES = 3


def read_runs(spark: SparkSession, folder: str, pattern: str = "*.csv",
              mapping: dict[str, str] | None = None, scale: dict[str, float] | None = None) -> DataFrame:
    """All runs of a folder as one table; signals a run lacks are NULL, and of repeated names the first wins.

    The header lines are the first three of a file, whatever is in them.
    """
    mapping = sig.simulated_map() if mapping is None else mapping
    logs = logscan.read(spark, folder, pattern, mapping, HEADER_LINES)
    out = logs.records.select(F.col("trip").alias("run"), *logs.depth)
    out = sig.apply_units(out, sig.SIMULATED_SCALE if scale is None else scale, {})
    if "speed_ms" in out.columns:
        out = out.withColumn("velocity_kmh", ms_to_kmh("speed_ms"))
    return out.select("*", *run_name_parts("run", sig.AMBIENT_CODES))


def ingest_runs(spark: SparkSession, folder: str, out: str, pattern: str = "*.csv") -> int:
    """Store the runs like trips and return how many there are."""
    store.write_trips(read_runs(spark, folder, pattern), out, key="run")
    return spark.read.parquet(out).select("run").distinct().count()
