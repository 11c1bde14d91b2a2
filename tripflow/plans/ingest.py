"""From a folder of raw logs to the trip store, the quality report and the audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.functions import signals as sig
from tripflow.operators import canonical, quality
from tripflow.operators.ordered import Series, attach
from tripflow.operators.resample import block_mean
from tripflow.operators.splits import sessions
from tripflow.sources import logscan, store


def read_logs(spark: SparkSession, folder: str, pattern: str = "*.csv", mapping: dict[str, str] | None = None,
              skip_unreadable: bool = False, min_rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """Canonical rows of all files, and their extra fields; every byte is parsed once, whatever the headers.

    All-blank records are dropped, and then files of fewer than ``min_rows`` rows are left out.
    """
    logs = logscan.read(spark, folder, pattern, sig.measured_map() if mapping is None else mapping, skip_unreadable=skip_unreadable)
    filled = logs.wide().dropna("all", subset=[c for cols in logs.copies.values() for c in cols])
    every = sig.apply_units(canonical.merge_copies(filled, ["trip"], logs.copies, logs.held), sig.SCALE, sig.OFFSET).drop("more")
    if min_rows:
        enough = every.groupBy("trip").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
        every = attach(every, enough.drop("_n"), ["trip"], "left_semi")
    return every, logs.extra_fields()


def quality_report(rows: DataFrame, extras: DataFrame, target: str = sig.TARGET, block_s: float = 3600.0) -> DataFrame:
    """One nested record per file: quality figures, header findings and extra fields."""
    notes = {"n_raw_columns", "header_signals", "merged", "conflicting"}
    signals = [c for c in rows.columns if c not in notes | {"trip", "time_s"}]
    record = quality.quality_record(rows, Series(block_s=block_s), target, signals).drop("schema_id", "n_columns")
    second = F.transform(F.first("conflicting"), lambda s: F.concat(s, F.lit("__2")))
    header = rows.groupBy("trip").agg(
        F.first("n_raw_columns").alias("n_raw_columns"), F.first("merged").alias("merged_duplicate_columns"),
        F.first("conflicting").alias("conflicting_duplicates"),
        canonical.fingerprint(F.concat(F.first("header_signals"), second)).alias("schema_id"),
        F.when(F.array_contains(F.first("header_signals"), target), F.array().cast("array<string>"))
        .otherwise(F.array(F.lit(target))).alias("missing_expected"))

    def listed(kind: str, label) -> object:
        picked = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("position", label.alias("label")))))
        return picked["label"].alias({"unmapped": "unmapped_columns", "trailing_empty": "trailing_empty_columns",
                                      "stray": "stray_field_columns"}[kind])
    counted = F.concat(F.col("header"), F.lit("("), F.col("present"), F.lit(")"))
    loose = extras.groupBy("trip").agg(listed("unmapped", F.col("header")), listed("trailing_empty", F.col("header")), listed("stray", counted))
    return record.join(header, "trip").join(loose, "trip", "left")


def ingest(spark: SparkSession, folder: str, out: str, period_s: float = 1.0, pattern: str = "*.csv",
           target: str = sig.TARGET, min_rows: int = 0) -> DataFrame:
    """Write ``out/trips`` (resampled store) and ``out/quality`` (nested) plus ``out/quality_csv``.

    Files of fewer than ``min_rows`` rows are in neither; ``delimited.load_report`` names them.
    """
    rows, extras = read_logs(spark, folder, pattern, min_rows=min_rows)
    quality_report(rows, extras, target).write.mode("overwrite").parquet(f"{out}/quality")
    report = spark.read.parquet(f"{out}/quality")
    store.write_report(report, f"{out}/quality_csv")
    clean = quality.clean_range(rows, target) if target in rows.columns else rows
    values = [c for c in rows.columns if c not in ("trip", "time_s", "n_raw_columns", "header_signals", "merged", "conflicting")]
    store.write_trips(block_mean(clean, period_s, values), f"{out}/trips")
    return report


def audit(report: DataFrame, overview: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table of the data-quality audit; each is lazy and small."""
    out = {
        "totals": quality.corpus_totals(report), "variants": quality.schema_variants(report, cols="n_raw_columns"),
        "idle": quality.idle_trips(report), "over_limit": quality.over_limit_summary(report),
        "over_limit_top": quality.over_limit_top(report), "constant": quality.constant_channel_counts(report),
        **{c: quality.label_frequency(report, c) for c in ("merged_duplicate_columns", "conflicting_duplicates", "unmapped_columns")},
        "trailing_empty": report.filter(F.size("trailing_empty_columns") > 0).agg(F.count(F.lit(1)).alias("trips")),
        "stray": report.filter(F.size("stray_field_columns") > 0).select("trip", "stray_field_columns"),
    }
    if overview is not None:
        out["coverage"] = quality.coverage(overview, sessions(overview))
    return out
