"""From raw header fields to canonical signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.functions.headers import header_key
from tripflow.functions.scalars import missing_if_nan
from tripflow.operators.ordered import attach

# Two readings agree within this absolute plus relative distance.
ABS_TOL, REL_TOL = 1e-8, 1e-5


def disagree(a: Column, b: Column) -> Column:
    """Both present and apart by more than the tolerance (relative to the second); NaN counts as missing, equal values agree."""
    a, b = missing_if_nan(a), missing_if_nan(b)
    apart = F.when(a.isNull() | (a == b), F.lit(False)).when(F.abs(b) == float("inf"), F.lit(True)).otherwise(F.abs(a - b) > ABS_TOL + REL_TOL * F.abs(b))
    return F.coalesce(apart, F.lit(False))


def merge_copies(df: DataFrame, keys: list[str], copies: dict[str, list[str]], held: Callable[[str, int], Column] | None = None) -> DataFrame:
    """Merge columns that carry one signal, per key, if they agree wherever both are present.

    ``copies`` maps a signal to its columns in file order.  A copy that disagrees stays apart as
    ``<signal>__2``; a further one that disagrees too is only recorded.  The verdict is one row per
    key, so merging costs a map-side aggregate and a join, never a gathered trip.  NaN is missing.  Adds ``merged``
    and ``conflicting`` (arrays of signal names, one entry per copy after the first).  ``held(signal, n)`` tells which rows' key
    has a copy number ``n`` (from 0) at all; without it every key has all of them.
    """
    df = df.withColumns({c: missing_if_nan(F.col(c)) for cols in copies.values() for c in cols})
    depth = max((len(c) for c in copies.values()), default=1)
    firsts = {s: F.col(cols[0]) for s, cols in copies.items()}
    out = df.withColumns({f"_m_{s}": c for s, c in firsts.items()}
                         | {f"_x_{s}": F.lit(None).cast("double") for s in copies}
                         | {"merged": F.array().cast("array<string>"),
                            "conflicting": F.array().cast("array<string>")})
    spare = {s: F.lit(False) for s in copies}
    for level in range(1, depth):
        here = [s for s, cols in copies.items() if len(cols) > level]
        verdict = out.groupBy(*keys).agg(
            *[F.bool_or(disagree(F.col(f"_m_{s}"), F.col(copies[s][level]))).alias(f"_bad{level}_{s}")
              for s in here],
            *[F.bool_or(held(s, level) if held else F.lit(True)).alias(f"_has{level}_{s}") for s in here])
        out = attach(out, verdict, keys)
        bad = {s: F.col(f"_bad{level}_{s}") for s in here}
        names = lambda yes: F.array_compact(F.array(
            *[F.when(bad[s] if yes else ~bad[s] & F.col(f"_has{level}_{s}"), F.lit(s)) for s in here]))
        out = out.withColumns(
            {f"_x_{s}": F.when(bad[s] & ~spare[s], F.col(copies[s][level])).otherwise(F.col(f"_x_{s}"))
             for s in here}
            | {f"_m_{s}": F.when(bad[s], F.col(f"_m_{s}"))
               .otherwise(F.coalesce(F.col(f"_m_{s}"), F.col(copies[s][level]))) for s in here}
            | {"merged": F.concat("merged", names(False)), "conflicting": F.concat("conflicting", names(True))})
        for s in here:
            spare[s] = spare[s] | bad[s]
    used = {c for cols in copies.values() for c in cols}
    keep = [c for c in df.columns if c not in used]
    dup = [s for s, cols in copies.items() if len(cols) > 1]
    return out.select(*keep, *[F.col(f"_m_{s}").alias(s) for s in copies],
                      *[F.col(f"_x_{s}").alias(f"{s}__2") for s in dup], "merged", "conflicting")


def fingerprint(names: Column) -> Column:
    """Six hex digits for a set of signal names, whatever their order and repeats."""
    return F.substring(F.sha1(F.array_join(F.array_sort(F.array_distinct(names)), ";")), 1, 6)


def signal_sets(long: DataFrame, keys: list[str], signal: str = "signal") -> DataFrame:
    """Signals and fingerprint per key of a long (key, signal) table; sets are schema-sized."""
    return (long.groupBy(*keys).agg(F.array_sort(F.collect_set(signal)).alias("signals"))
            .withColumn("schema_id", fingerprint(F.col("signals"))))


def lost_signals(sets: DataFrame, keys: list[str]) -> DataFrame:
    """What each key lacks of the richest signal set; ties go to the smallest fingerprint."""
    richest = sets.groupBy("schema_id").agg(F.first("signals").alias("signals")).agg(
        F.min_by("signals", F.struct(-F.size("signals"), "schema_id")).alias("_richest"))
    one = richest.withColumn("_one", F.lit(1))
    return (sets.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
            .select(*keys, "schema_id", F.array_except("_richest", "signals").alias("lost")))


def rename_signals(long: DataFrame, names: dict[str, str], header: str = "header", out: str = "signal") -> DataFrame:
    """Canonical name for every row of a long (header, value) table; unknown headers are dropped.

    ``names`` maps header keys to signals and has the size of a schema.
    """
    spark = long.sparkSession
    table = spark.createDataFrame(list(names.items()), f"_key string, {out} string")
    return long.withColumn("_key", header_key(F.col(header))).join(table, "_key").drop("_key")
