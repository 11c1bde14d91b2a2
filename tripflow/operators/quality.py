"""Range checks, per-trip quality records and the audit tables on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.operators.canonical import fingerprint
from tripflow.operators.ordered import Series, with_neighbours
from tripflow.operators.quantiles import exact_quantile
from tripflow.session import durable

HEATER_RATING_W = 7000.0      # fixed value: rating above which a request cannot be real
IRREGULAR_SD_S = 1e-6         # fixed value: spread of the sample interval that counts as irregular


def over_limit(c: Column, limit: float) -> Column:
    """True only for a real number above the limit: Spark sorts NaN above every number."""
    return F.coalesce((c > limit) & ~F.isnan(c), F.lit(False))


def clean_range(df: DataFrame, value: str, limit: float = HEATER_RATING_W) -> DataFrame:
    """Drop rows whose value is missing or cannot be real."""
    v = F.when(~over_limit(F.col(value), limit) & ~F.isnan(value), F.col(value))
    return df.withColumn(value, v).filter(F.col(value).isNotNull())


def range_counts(df: DataFrame, keys: list[str], value: str, limit: float = HEATER_RATING_W) -> DataFrame:
    over = over_limit(F.col(value), limit)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(over).alias("n_over"),
        F.count_if(F.col(value).isNotNull() & ~over).alias("n_kept"), F.max(value).alias("max_value"))


def sample_interval(df: DataFrame, s: Series) -> DataFrame:
    """Per key: median sample interval, its spread, and whether it is irregular.

    The intervals are written once; the passes of the quantile read them instead of opening the windows again.
    """
    dt = (with_neighbours(df.select(*s.keys, s.time, *s.tie), s, [s.time], following=False)
          .select(*s.keys, s.time, (F.col(s.time) - F.col(f"prev_{s.time}")).alias("dt")).filter("dt IS NOT NULL"))
    out = exact_quantile(durable(dt, "intervals"), list(s.keys), "dt", 0.5, "dt_median_s", also={"dt_sd_s": F.stddev_pop})
    return out.withColumn("dt_irregular", F.col("dt_sd_s") > IRREGULAR_SD_S)


def _constant(c: str, keep: Column) -> Column:
    """At most one distinct present value among the kept rows."""
    v = F.when(keep, F.col(c))
    return F.min(v).eqNullSafe(F.max(v))


def quality_record(df: DataFrame, s: Series, target: str, signals: list[str],
                   limit: float = HEATER_RATING_W) -> DataFrame:
    """One record per trip, from a single aggregate over the raw rows plus the interval table.

    Columns that are wholly NULL in a trip count as absent from it.  Constancy and missing shares
    look at the rows that survive the range check, as the stored trip does.
    """
    t = F.col(target)
    over = over_limit(t, limit)
    keep = t.isNotNull() & ~over
    cols = [s.time, *[c for c in signals if c != s.time]]
    present = F.array_compact(F.array(*[F.when(F.col(f"_n_{c}") > 0, F.lit(c)) for c in cols]))
    agg = df.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n_rows_raw"), F.count_if(keep).alias("n_rows_out"),
        F.max(t).alias("target_max_raw_w"), F.count_if(over).alias("n_target_over_rating"),
        F.min(t).eqNullSafe(F.max(t)).alias("target_constant"),
        *[F.count(c).alias(f"_n_{c}") for c in cols],
        *[F.count_if(F.col(c).isNull() & keep).alias(f"_m_{c}") for c in cols],
        *[_constant(c, keep).alias(f"_k_{c}") for c in cols])
    have = lambda c: F.col(f"_n_{c}") > 0
    share = F.map_from_entries(F.array_compact(F.array(*[
        F.when(have(c), F.struct(F.lit(c).alias("key"),
                                 (F.col(f"_m_{c}") / F.col("n_rows_out")).alias("value"))) for c in cols])))
    flat = agg.select(
        *s.keys, "n_rows_raw", "n_rows_out", "target_max_raw_w", "n_target_over_rating", "target_constant",
        F.size(present).alias("n_columns"), fingerprint(present).alias("schema_id"),
        F.array_compact(F.array(*[F.when(have(c) & F.col(f"_k_{c}"), F.lit(c)) for c in cols])).alias("constant_columns"),
        F.when(F.col("n_rows_out") > 0, share).alias("frac_missing_by_column"))
    return flat.join(sample_interval(df, s), list(s.keys), "left")


# ---- audit -----------------------------------------------------------------------------------

def corpus_totals(q: DataFrame) -> DataFrame:
    periods = F.array_sort(F.collect_set(F.round("dt_median_s", 4)))
    return q.agg(F.count(F.lit(1)).alias("trips"), F.sum("n_rows_raw").alias("rows_raw"),
                 F.sum("n_rows_out").alias("rows_out"), periods.alias("periods"))


def schema_variants(q: DataFrame, trip: str = "trip", cols: str = "n_columns", head: int = 4) -> DataFrame:
    """Trips per signal set with their column span, the first few trips and how many more there are.

    The first trips come from a bounded top-k, not from the list of all trips of a variant.
    """
    first = (q.select("schema_id", trip)
             .withColumn("_r", F.row_number().over(Window.partitionBy("schema_id").orderBy(trip)))
             .filter(F.col("_r") <= head)
             .groupBy("schema_id").agg(F.array_sort(F.collect_list(trip)).alias("head")))
    stats = q.groupBy("schema_id").agg(F.count(F.lit(1)).alias("trips"), F.min(cols).alias("lo"), F.max(cols).alias("hi"))
    return stats.join(first, "schema_id").withColumn("more", F.greatest(F.col("trips") - head, F.lit(0)))


def idle_trips(q: DataFrame, trip: str = "trip") -> DataFrame:
    return q.filter(F.coalesce("target_constant", F.lit(False))).select(trip)


def over_limit_summary(q: DataFrame) -> DataFrame:
    return q.agg(F.coalesce(F.sum("n_target_over_rating"), F.lit(0)).alias("rows_over"),
                 F.count_if(F.col("n_target_over_rating") > 0).alias("trips_over"))


def over_limit_top(q: DataFrame, n: int = 5, trip: str = "trip") -> DataFrame:
    return (q.filter("n_target_over_rating > 0").select(trip, "n_target_over_rating", "target_max_raw_w")
            .orderBy(F.desc("target_max_raw_w"), trip).limit(n))


def label_frequency(q: DataFrame, labels: str) -> DataFrame:
    """Trips per exact label list (the joined list is the key, not its members)."""
    return (q.withColumn("label", F.concat_ws(",", labels)).filter("label <> ''")
            .groupBy("label").agg(F.count(F.lit(1)).alias("trips")))


def constant_channel_counts(q: DataFrame, n: int | None = 10) -> DataFrame:
    out = (q.select(F.explode("constant_columns").alias("channel")).groupBy("channel")
           .agg(F.count(F.lit(1)).alias("trips")))
    return out if n is None else out.orderBy(F.desc("trips"), "channel").limit(n)


def coverage(overview: DataFrame, sessions: DataFrame | None = None, setpoint: str = "cabin_setpoint_c",
             ambient: str = "amb_temp_start_c", trip: str = "trip") -> DataFrame:
    """What the trips of an overview cover: set-points, ambient span, days, warm starts, sessions."""
    per_day = overview.groupBy("day").agg(F.count(trip).alias("n"))
    days = per_day.agg(F.count("day").alias("days"),
                       F.count_if((F.col("n") > 1) & F.col("day").isNotNull()).alias("days_with_more"))
    points = overview.groupBy(setpoint).agg(F.lit(1).alias("_")).agg(F.count(setpoint).alias("setpoints"))
    facts = overview.agg(F.count(F.lit(1)).alias("trips"), F.min(ambient).alias("ambient_min"),
                         F.max(ambient).alias("ambient_max"), F.count_if("warm_start").alias("warm_starts"))
    parts = [facts, days, points]
    if sessions is not None:
        parts.append(sessions.groupBy("session").agg(F.lit(1).alias("_")).agg(F.count("session").alias("sessions")))
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")     # one row each
    return out.drop("_one")
