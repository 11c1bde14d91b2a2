"""The driver contract, and streams against their batch operators."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tripflow.operators import guards, resample
from tripflow.operators.ordered import Series
from tripflow.plans import registry
from tripflow.streaming import online

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


def test_every_sql_has_its_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100
    own = set(registry.QUERIES)
    assert own <= set(s)


@needs_data
def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns[:3] == ["trip", "n_rows_raw", "n_rows_out"] and out.count() > 0


@pytest.fixture
def two_batches(spark, tmp_path):
    """Two files, read one per micro-batch; the second holds a late copy of a row."""
    rows = [(t, 6000.0 + 60.0 * i, 4000.0 * (i % 3) - 500.0) for i in range(12) for t in ("a", "b")]
    d = spark.createDataFrame(rows, "trip string, time_s double, proposed double").withColumn("ts", F.timestamp_seconds("time_s"))
    early, late = d.filter("time_s < 6400"), d.filter("time_s >= 6400 OR time_s = 6360")
    early.coalesce(1).write.parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return d, spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))


def test_stream_drops_copies(two_batches):
    d, s = two_batches
    out = online.run_to_table(online.drop_duplicates(s, ["trip", "time_s"], "1 hour"), "d")
    assert out.count() == d.count()


def test_stream_commands_equal_the_batch(spark, two_batches):
    d, s = two_batches
    keyed = online.drop_duplicates(s, ["trip", "time_s"], "1 hour")
    out = online.guarded_commands(keyed, Series(), "proposed", 10.0, [], max_rate=100.0)
    got = {(r.trip, r.time_s): r.applied_w for r in out.collect()}
    safe = d.withColumn("c", guards.actuator_clamp()(F.col("proposed"))["value"])
    want = {(r.trip, r.time_s): r.applied_w for r in guards.rate_limit(safe, Series(), "c", 10.0, ["time_s"], max_rate=100.0).collect()}
    assert got == want


def test_stream_resample_equals_the_batch_where_closed(two_batches):
    d, s = two_batches
    out = online.run_to_table(online.resample(s, "2 minutes", ["proposed"], ["trip"], "0 seconds"), "r")
    got = {(r.trip, r.start_us / 1e6): r.proposed for r in out.collect()}
    d = d.unionByName(d.filter("time_s = 6360"))
    want = {(r.trip, r.time_s): r.proposed for r in resample.block_mean(d, 120.0, ["proposed"]).collect()}
    assert got and all(want[k] == pytest.approx(v) for k, v in got.items())


def arrivals(spark, folder, parts):
    """Parts that arrive one after the other, each run through the stream as it comes."""
    for part in parts:
        part.write.mode("append").parquet(folder)
        yield spark.readStream.schema(part.schema).parquet(folder)


def test_late_commands_are_left_out_in_every_batch(spark, tmp_path):
    row = lambda t, c: ("a", float(t), float(c))
    parts = [spark.createDataFrame(r, "trip string, time_s double, proposed double") for r in (
        [row(10, 0), row(20, 5000)], [row(15, 7000), row(20, 7000), row(30, 5000)], [row(5, 1), row(40, 9000), row(50, 100)])]
    root = str(tmp_path / "run")
    for stream in arrivals(spark, str(tmp_path / "in"), parts):
        out = online.guarded_commands(stream, Series(), "proposed", 10.0, [], max_rate=100.0, root=root)
    assert [(r.time_s, r.applied_w) for r in out.orderBy("time_s").collect()] == [(10, 0), (20, 1000), (30, 2000), (40, 3000), (50, 2000)]


def test_late_rows_are_counted_per_batch(spark, tmp_path):
    stamp = lambda *s: spark.createDataFrame([(x,) for x in s], "s double").select(F.timestamp_seconds("s").alias("ts")).repartition(3)
    root, seen = str(tmp_path / "run"), []
    for stream in arrivals(spark, str(tmp_path / "in"), [stamp(100.0, 200.0, None), stamp(50.0, 139.9, 140.0, 260.0), stamp(None, 199.0, 200.0), stamp(199.0)]):
        seen = online.late_rows(stream, 60.0, root=root).orderBy("batch").collect()
    assert [tuple(r) for r in seen] == [(0, 3, 0, None), (1, 4, 2, 140_000_000), (2, 3, 1, 200_000_000), (3, 1, 1, 200_000_000)]


def _commands(batches):
    """A plain walk over batches: slew-limited commands; rows not newer than their key's last one are left out."""
    last, seen = {}, []
    for batch in batches:
        before = dict(last)
        for k, t, c in sorted(batch, key=lambda r: r[1]):
            if k in before and t <= before[k][1]:
                continue
            a = max(last[k][0] - 1000, min(last[k][0] + 1000, c)) if k in last else c
            last[k] = (a, t)
            seen.append((k, t, a))
    return sorted(seen)


BATCHES = [[("a", 10.0, 0.0), ("b", 10.0, 3000.0), ("a", 20.0, 4000.0)], [("a", 30.0, 4000.0)], [("b", 15.0, 0.0), ("a", 25.0, 0.0), ("c", 40.0, 500.0)],
           [("c", 50.0, 7000.0), ("a", 55.0, 0.0)], [("b", 60.0, 7000.0), ("c", 61.0, 0.0)]]


@pytest.mark.parametrize("every", [1, 2, 3, 16])
def test_stream_state_is_written_for_touched_keys_only(spark, tmp_path, every):
    parts = [spark.createDataFrame(r, "trip string, time_s double, proposed double") for r in BATCHES]
    root = str(tmp_path / "run")
    for stream in arrivals(spark, str(tmp_path / "in"), parts):
        out = online.guarded_commands(stream, Series(), "proposed", 10.0, [], max_rate=100.0, root=root, every=every)
    assert sorted((r.trip, r.time_s, r.applied_w) for r in out.collect()) == _commands(BATCHES)
    touched = [{r.trip for r in spark.read.parquet(f"{root}/state/changes/batch={i}").collect()} for i in range(5)]
    assert touched == [{"a", "b"}, {"a"}, {"b", "c"}, {"a", "c"}, {"b", "c"}]
    state = online.KeyedState(root, ("trip",), spark.read.parquet(f"{root}/state/changes/batch=0").schema, "_t", every)
    assert {r.trip: r._t for r in state.before(spark, 5).collect()} == {"a": 55.0, "b": 60.0, "c": 61.0}


@pytest.mark.parametrize("every", [2, 16])
def test_idle_keys_are_forgotten_alike_whenever_tables_are_made_whole(spark, tmp_path, every):
    parts = [spark.createDataFrame(r, "trip string, time_s double, proposed double") for r in BATCHES]
    root = str(tmp_path / "run")
    for stream in arrivals(spark, str(tmp_path / "in"), parts):
        out = online.guarded_commands(stream, Series(), "proposed", 10.0, [], max_rate=100.0, root=root, every=every, forget_s=18.0)
    got = sorted((r.trip, r.time_s, r.applied_w) for r in out.collect())
    # The watermarks are none, 2, 12, 22 and 37: b is forgotten before its rows at 15 and 60, which start anew; a and c never are.
    assert got == [("a", 10.0, 0.0), ("a", 20.0, 1000.0), ("a", 30.0, 2000.0), ("a", 55.0, 1000.0), ("b", 10.0, 3000.0), ("b", 15.0, 0.0),
                   ("b", 60.0, 7000.0), ("c", 40.0, 500.0), ("c", 50.0, 1500.0), ("c", 61.0, 500.0)]
