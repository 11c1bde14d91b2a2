"""Queries over the trip overview: sessions, folds, hold-outs, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.operators import splits
from tripflow.plans.registry import query
from tripflow.sources.store import is_trip_id
from tripflow.sources.tables import OVERVIEW_SQL, SAMPLES_SQL, overview, samples, table

_SESSIONS = OVERVIEW_SQL + """, marked AS (
  SELECT vehicle, trip, day, CASE WHEN lag(day) OVER w IS DISTINCT FROM day OR NOT warm_start THEN day || '#' || trip END AS label
  FROM overview WINDOW w AS (PARTITION BY vehicle ORDER BY trip)), sess AS (
  SELECT vehicle, trip, day, last_value(label IGNORE NULLS) OVER (PARTITION BY vehicle ORDER BY trip
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM marked)"""


@query("driving_sessions", f"WITH {_SESSIONS} SELECT vehicle, trip, day, session FROM sess")
def driving_sessions(spark, sf):
    return splits.sessions(overview(spark, sf), by=("vehicle",))


@query("session_count", f"""WITH {_SESSIONS}
SELECT count(DISTINCT session) AS sessions, count(*) AS trips FROM sess""")
def session_count(spark, sf):
    s = driving_sessions(spark, sf)
    return s.agg(F.count_distinct("session").alias("sessions"), F.count(F.lit(1)).alias("trips"))


@query("day_groups", """SELECT o_orderkey AS trip, strftime(o_orderdate, '%Y-%m-%d') AS "group" FROM orders""")
def day_groups(spark, sf):
    return splits.day_groups(overview(spark, sf))


_SIZES = OVERVIEW_SQL + """, sizes AS (SELECT day AS g, count(*) AS size FROM overview GROUP BY day)"""


@query("group_folds_dealt", f"""WITH {_SIZES}, r AS (
  SELECT g, size, row_number() OVER (ORDER BY size DESC, g) - 1 AS r FROM sizes)
SELECT g AS "group", size, (CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END)::INT AS fold FROM r""")
def group_folds_dealt(spark, sf):
    return splits.deal_folds(splits.group_sizes(splits.day_groups(overview(spark, sf))), 5)


_WALK = _SIZES + """, o AS (
  SELECT g, size, row_number() OVER (ORDER BY size DESC, g) AS r FROM sizes), walk AS (
  SELECT 0::BIGINT AS r, NULL::VARCHAR AS g, 0::BIGINT AS size, -1 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL
  SELECT o.r, o.g, o.size, (list_position(w.loads, list_min(w.loads)) - 1)::INT,
         list_transform(w.loads, lambda v, i: CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN v + o.size ELSE v END)
  FROM walk w JOIN o ON o.r = w.r + 1)"""


@query("group_folds_balanced", f"""WITH RECURSIVE {_WALK}
SELECT g AS "group", size, fold FROM walk WHERE r > 0""")
def group_folds_balanced(spark, sf):
    return splits.balance_folds(splits.group_sizes(splits.day_groups(overview(spark, sf))), 5)


_ROLES = _WALK + """, roles AS (
  SELECT f.fold::INT AS fold, o.trip, o.day AS grp, CASE WHEN f.fold = h.fold THEN 'test' ELSE 'train' END AS role
  FROM overview o JOIN walk h ON h.g = o.day CROSS JOIN (VALUES (0), (1), (2), (3), (4)) f(fold))"""


def _roles(spark, sf):
    labels = splits.day_groups(overview(spark, sf))
    return splits.fold_roles(labels, splits.balance_folds(splits.group_sizes(labels), 5), 5)


@query("fold_roles", f"WITH RECURSIVE {_ROLES} SELECT fold, role, count(*) AS trips, count(DISTINCT grp) AS groups FROM roles GROUP BY 1, 2")
def fold_roles(spark, sf):
    return _roles(spark, sf).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("trips"), F.count_distinct("group").alias("groups"))


@query("fold_overlap", f"""WITH RECURSIVE {_ROLES}
SELECT 'trips' AS what, count(*) AS shared FROM (SELECT fold, trip FROM roles WHERE role = 'train' INTERSECT
  SELECT fold, trip FROM roles WHERE role = 'test')
UNION ALL SELECT 'groups', count(*) FROM (SELECT fold, grp FROM roles WHERE role = 'train' INTERSECT
  SELECT fold, grp FROM roles WHERE role = 'test')""")
def fold_overlap(spark, sf):
    r = _roles(spark, sf)
    one = lambda w, c: splits.overlap(r, c).agg(F.count(F.lit(1)).alias("shared")).select(F.lit(w).alias("what"), "shared")
    return one("trips", "trip").unionByName(one("groups", "group"))


@query("holdout_partition", f"""WITH {SAMPLES_SQL}, cold AS (SELECT trip FROM samples GROUP BY trip HAVING min(amb_c) < -4.9)
SELECT CASE WHEN c.trip IS NULL THEN 'dev' ELSE 'cold' END AS part, s.trip, count(*) AS n FROM samples s LEFT JOIN cold c USING (trip)
GROUP BY 1, 2""")
def holdout_partition(spark, sf):
    s = samples(spark, sf)
    dev, cold = splits.holdout(s, splits.cold_trips(s, "amb_c", -4.9))
    mark = lambda d, p: d.groupBy("trip").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(p))
    return mark(dev, "dev").unionByName(mark(cold, "cold"))


@query("selected_trips", f"""WITH RECURSIVE {_ROLES}, keep AS (SELECT trip FROM roles WHERE fold = 0 AND role = 'test')
SELECT trip, day FROM overview WHERE trip IN (SELECT trip FROM keep)""")
def selected_trips(spark, sf):
    keep = _roles(spark, sf).filter("fold = 0 AND role = 'test'").select("trip")
    return overview(spark, sf).join(keep, "trip", "left_semi").select("trip", "day")


@query("group_labels", """SELECT o_orderkey AS trip, c_mktsegment AS "group" FROM orders JOIN customer ON c_custkey = o_custkey""")
def group_labels(spark, sf):
    trips = table(spark, sf, "orders").select(F.col("o_orderkey").alias("trip"), "o_custkey")
    seg = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("group"))
    return splits.checked_groups(trips, trips.join(seg, "o_custkey").select("trip", "group")).select("trip", "group")


@query("group_label_problems", """SELECT c_custkey AS trip, 'missing' AS problem FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT o_custkey, 'duplicate' FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def group_label_problems(spark, sf):
    trips = table(spark, sf, "customer").select(F.col("c_custkey").alias("trip"))
    groups = table(spark, sf, "orders").select(F.col("o_custkey").alias("trip"))
    return splits.group_problems(trips, groups)


@query("group_split_70_15_15", """WITH g AS (SELECT DISTINCT o_custkey AS g FROM orders), r AS (
  SELECT g, row_number() OVER (ORDER BY md5('42|' || g)) - 1 AS r, ceil(count(*) OVER () * 0.30) AS held FROM g)
SELECT g AS "group", CASE WHEN r < ceil(held * 0.5) THEN 'test' WHEN r < held THEN 'val' ELSE 'train' END AS split FROM r""")
def group_split(spark, sf):
    return splits.random_group_split(table(spark, sf, "orders").select(F.col("o_custkey").alias("group")))


@query("valid_ids", r"""SELECT o_orderkey AS trip, regexp_full_match(trim(label), '(?i)trip[ab]\d+') AS valid FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN ' ' || o_orderpriority
    ELSE ' tripB' || o_orderkey || ' ' END AS label FROM orders) WHERE regexp_full_match(trim(label), '(?i)trip[ab]\d+')""")
def valid_ids(spark, sf):
    k = F.col("o_orderkey")
    label = (F.when(k % 7 == 0, None).when(k % 5 == 0, F.concat(F.lit(" "), "o_orderpriority"))
             .otherwise(F.concat(F.lit(" tripB"), k.cast("string"), F.lit(" "))))
    t = table(spark, sf, "orders").select(k.alias("trip"), is_trip_id(label).alias("valid"))
    return t.filter("valid")
