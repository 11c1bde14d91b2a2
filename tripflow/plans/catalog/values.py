"""Queries for header keys, name resolution and scalar functions on values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.functions import headers, scalars
from tripflow.functions import signals as sig
from tripflow.operators import canonical
from tripflow.plans.registry import query
from tripflow.sources import store
from tripflow.sources.tables import TELEMETRY_SQL, table, telemetry


@query("header_keys", r"""SELECT page_id, lower(trim(regexp_replace(regexp_replace(url, '[°º\[\](){}/\\\-_.,;:+]', ' ', 'g'), '\s+', ' ', 'g'))) AS key FROM pages""")
def header_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", headers.header_key(F.col("url")).alias("key"))


@query("plain_keys", r"""SELECT page_id, trim(regexp_replace(replace(regexp_replace(lower(trim(url)), '[°\[\](){}/\\\-_.,;:]', ' ', 'g'), 'soc', ' state of charge '), '\s+', ' ', 'g')) AS key FROM pages""")
def plain_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", headers.plain_key(F.col("url")).alias("key"))


@query("numbered_names", """SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '__dup' || n END AS name FROM (
  SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)""")
def numbered_names(spark, sf):
    return headers.number_duplicates(table(spark, sf, "part"), ["p_brand"], "p_name", "p_partkey", "name").select("p_partkey", "name")


#: Header texts that stand for the channels of the log.
_HEADERS = {"click": "Heating Power LIN [W]", "view": "Requested Heating Power [W]", "purchase": "Heating Power CAN [kW]",
            "error": "Seat heating, total power", "signup": "Velocity [km/h]]]"}
_HEADER_SQL = "CASE channel " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _HEADERS.items()) + " END"
_SIGNAL_SQL = "CASE channel WHEN 'click' THEN 'heat_power_lin_w' WHEN 'view' THEN 'heat_power_req_w' WHEN 'purchase' THEN 'heat_power_can_w' WHEN 'signup' THEN 'velocity_kmh' END"


def _headed(spark, sf):
    named = F.coalesce(*[F.when(F.col("channel") == k, F.lit(v)) for k, v in _HEADERS.items()])
    return telemetry(spark, sf).withColumn("header", named)


@query("canonical_rename", f"""WITH {TELEMETRY_SQL} SELECT trip, seq, {_SIGNAL_SQL} AS signal FROM telemetry WHERE channel <> 'error'""")
def canonical_rename(spark, sf):
    return canonical.rename_signals(_headed(spark, sf), sig.measured_map()).select("trip", "seq", "signal")


@query("target_resolution", f"""WITH {TELEMETRY_SQL}, c AS (
  SELECT trip, floor(time_s / 86400)::BIGINT AS day, {_HEADER_SQL} AS header, CASE channel WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 5 WHEN 'error' THEN 9 END AS rank FROM telemetry)
SELECT trip, day, arg_min(header, rank) AS target, CASE WHEN arg_min(header, rank) LIKE '%kW%' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS factor
FROM c WHERE rank IS NOT NULL GROUP BY 1, 2""")
def target_resolution(spark, sf):
    key = headers.plain_key(F.col("header"))
    t = _headed(spark, sf).withColumns({"day": F.floor(F.col("time_s") / 86400), "rank": headers.target_rank(key)}).filter("rank IS NOT NULL")
    best = t.groupBy("trip", "day").agg(F.min_by("header", "rank").alias("target"))
    return best.withColumn("factor", F.when(headers.plain_key(F.col("target")).contains("kw"), 1000.0).otherwise(1.0))


@query("leakage_pruning", f"WITH {TELEMETRY_SQL} SELECT trip, seq FROM telemetry WHERE channel IN ('error', 'signup')")
def leakage_pruning(spark, sf):
    return _headed(spark, sf).filter(~headers.is_leaky(headers.plain_key(F.col("header")))).select("trip", "seq")


@query("lenient_numbers", """SELECT o_orderkey, round(try_cast(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice::VARCHAR END AS DOUBLE), 4) AS number FROM orders""")
def lenient_numbers(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.col("o_orderpriority")).when(k % 5 == 0, None).otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(scalars.lenient_double(text), 4).alias("number"))


_STAMP_SQL = "CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y_%m_%d_%H-%M-%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S') ELSE o_orderpriority END"
_NOTE_SQL = "CASE o_orderkey % 4 WHEN 0 THEN 'full car + ' || (o_orderkey % 90) || ' KG' WHEN 1 THEN 'Directly After Previous trip' WHEN 2 THEN NULL ELSE o_orderpriority END"


def _sheet(spark, sf):
    """Orders written down as the rows of an overview sheet, with blank and repeated trips."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    stamp = (F.when(k % 3 == 0, F.date_format(d, "yyyy_MM_dd_HH-mm-ss")).when(k % 3 == 1, F.date_format(d, "yyyy-MM-dd_HH-mm-ss"))
             .otherwise(F.col("o_orderpriority")))
    note = (F.when(k % 4 == 0, F.concat(F.lit("full car + "), (k % 90).cast("string"), F.lit(" KG")))
            .when(k % 4 == 1, F.lit("Directly After Previous trip")).when(k % 4 == 2, None).otherwise(F.col("o_orderpriority")))
    trip = F.when(k % 11 == 0, None).otherwise(F.concat(F.lit("  TripA"), F.floor(k / 2).cast("string"), F.lit(" ")))
    return table(spark, sf, "orders").select(k.alias("row"), trip.alias("Trip"), stamp.alias("Date"), note.alias("Note"),
                                             F.col("o_totalprice").cast("string").alias("Distance [km]"))


@query("stamp_days", f"SELECT o_orderkey, nullif(regexp_extract(replace({_STAMP_SQL}, '_', '-'), '^\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') AS day FROM orders")
def stamp_days(spark, sf):
    return _sheet(spark, sf).select(F.col("row").alias("o_orderkey"), scalars.stamp_day("Date").alias("day"))


@query("payload_notes", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 90)::DOUBLE ELSE 0.0::DOUBLE END AS payload_kg, o_orderkey % 4 = 1 AS warm_start FROM orders")
def payload_notes(spark, sf):
    return _sheet(spark, sf).select(F.col("row").alias("o_orderkey"), scalars.payload_kg("Note").alias("payload_kg"),
                                    scalars.notes_contain("Note", store.WARM_NOTE).alias("warm_start"))


@query("trip_overview", f"""WITH s AS (SELECT o_orderkey AS k, 'TripA' || (o_orderkey // 2) AS trip, {_STAMP_SQL} AS stamp, {_NOTE_SQL} AS note, o_totalprice AS km FROM orders WHERE o_orderkey % 11 <> 0)
SELECT trip, nullif(regexp_extract(replace(stamp, '_', '-'), '^\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') AS day, round(km, 4) AS distance_km,
  CASE WHEN k % 4 = 0 THEN (k % 90)::DOUBLE ELSE 0.0::DOUBLE END AS payload_kg, k % 4 = 1 AS warm_start, NULL::DOUBLE AS cabin_setpoint_c
FROM s QUALIFY row_number() OVER (PARTITION BY trip ORDER BY k) = 1""")
def trip_overview(spark, sf):
    o = store.overview_table(_sheet(spark, sf), order="row")
    return o.select("trip", "day", F.round("distance_km", 4).alias("distance_km"), "payload_kg", "warm_start", "cabin_setpoint_c")


@query("run_names", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN -10.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END AS amb_setpoint_c, o_orderstatus AS strategy, 'B' || (o_orderkey % 2) AS bus FROM orders""")
def run_names(spark, sf):
    k = F.col("o_orderkey")
    code = F.when(k % 3 == 0, "Neg10").when(k % 3 == 1, "0").otherwise("Pos10")
    named = table(spark, sf, "orders").withColumn("run", F.concat_ws("_", code, "o_orderstatus", F.concat(F.lit("B"), (k % 2).cast("string"))))
    return named.select("o_orderkey", *scalars.run_name_parts("run", sig.AMBIENT_CODES))


@query("round_to_step", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 40.0::DOUBLE, 0) * 40 AS stepped, round(ln(1 + l_extendedprice), 6) AS logged FROM lineitem")
def round_to_step(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalars.round_to_step("l_extendedprice", 40.0).alias("stepped"),
                                               F.round(F.log1p("l_extendedprice"), 6).alias("logged"))


@query("clipped_values", "SELECT s_suppkey, round(least(greatest(s_acctbal, 0), 7000), 4) AS clipped, round(greatest(0, 500 - s_acctbal), 4) AS short_of, s_acctbal > 120 AS active FROM supplier")
def clipped_values(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.round(scalars.clip("s_acctbal", 0.0, 7000.0), 4).alias("clipped"),
                                               F.round(scalars.hinge(500.0, "s_acctbal"), 4).alias("short_of"),
                                               (scalars.state_label("s_acctbal", 120.0) == "active").alias("active"))
