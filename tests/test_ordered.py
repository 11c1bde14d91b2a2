"""Ordered operators against plain pandas, with blocks small enough that every trip crosses them."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripflow.operators import ordered, policies, rank, resample, scan, slew, splits
from tripflow.operators.quantiles import exact_quantiles, order_statistics, place

S = ordered.Series(block_s=7.0)


@pytest.fixture(scope="module")
def log():
    """One trip holds most rows, as a hot key would; clocks are uneven."""
    rng = np.random.default_rng(3)
    parts = []
    for trip, n in (("hot", 400), ("b", 30), ("c", 1), ("d", 2)):
        t = np.cumsum(rng.uniform(0.2, 9.0, n)).round(3)
        parts.append(pd.DataFrame({"trip": trip, "time_s": t, "x": rng.normal(size=n).round(4)}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[pdf.index % 7 == 3, "x"] = None
    return pdf


@pytest.fixture(scope="module")
def df(spark, log):
    d = spark.createDataFrame(log.sample(frac=1, random_state=1))
    return d.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def pdf_of(d, *by):
    return d.toPandas().sort_values(list(by)).reset_index(drop=True)


def test_position_matches_cumcount(df, log):
    got = pdf_of(ordered.with_position(df, S), "trip", "time_s")
    want = log.sort_values(["trip", "time_s"]).groupby("trip").cumcount().to_numpy()
    assert (got["pos"].to_numpy() == want).all()


@pytest.mark.parametrize("hottest", [1, 10])
def test_dense_keys_get_shorter_blocks(spark, df, log, hottest):
    more = df.unionByName(df.filter("trip = 'b'").withColumn("trip", F.lit("b2")))
    s = ordered.Series(block_s=1e6).fitted(more, rows=20, hottest=hottest)
    sizes = {r.trip: (r.b, r.m) for r in s.with_block(more).groupBy("trip", ordered.BLOCK).count().groupBy("trip")
             .agg(F.count("*").alias("b"), F.max("count").alias("m")).collect()}
    assert sizes["hot"][0] >= 15 and sizes["hot"][1] < 60 and sizes["b"][0] >= 2 and sizes["c"] == (1, 1)
    got = pdf_of(ordered.with_position(df, s), "trip", "time_s")
    assert (got["pos"].to_numpy() == log.sort_values(["trip", "time_s"]).groupby("trip").cumcount().to_numpy()).all()
    assert ordered.Series(block_s=1e6).fitted(more, rows=1000).block is None


def test_attach_keeps_every_join_type(spark):
    d = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2)], "k string, v int")
    t = spark.createDataFrame([("a", 7), ("b", 8)], "k string, w int")
    assert ordered.attach(d, t, ["k"]).count() == 51 and ordered.attach(d, t, ["k"], "left").count() == 52
    assert ordered.attach(d, t, ["k"], "left_semi").count() == 51
    assert [r.k for r in ordered.attach(d, t, ["k"], "left_anti").collect()] == ["c"]


@pytest.mark.parametrize("most", [1000, 7])
def test_attach_repeats_only_rows_of_counted_hot_keys(spark, most):
    d = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2), (None, 3)], "k string, v int")
    t = spark.createDataFrame([("a", 7), ("b", 8)], "k string, w int")
    join = lambda how: ordered.attach_counted(d, t, ["k"], how, most)
    assert join("inner").count() == 51 and join("left").count() == 53 and join("left_semi").count() == 51
    assert sorted((r.k or "", r.w) for r in join("left").filter("k IS NULL OR k <> 'a'").collect()) == [("", None), ("b", 8), ("c", None)]
    assert ("explode(" in join("left")._jdf.queryExecution().optimizedPlan().toString()) == (most == 7)


def test_neighbours_keep_missing_values_missing(df, log):
    got = pdf_of(ordered.with_neighbours(df, S, ["x"]), "trip", "time_s")
    ref = log.sort_values(["trip", "time_s"]).groupby("trip")["x"]
    assert np.allclose(got["prev_x"].astype(float), ref.shift(1), equal_nan=True)
    assert np.allclose(got["next_x"].astype(float), ref.shift(-1), equal_nan=True)


def test_last_valid_crosses_blocks(df, log):
    got = pdf_of(ordered.with_last_valid(df, S, "x", "v"), "trip", "time_s")
    assert np.allclose(got["v"].astype(float), log.sort_values(["trip", "time_s"]).groupby("trip")["x"].ffill(), equal_nan=True)


def test_gradient_equals_numpy(df, log):
    full = df.withColumn("x", F.coalesce("x", F.lit(0.5)))
    got = pdf_of(ordered.gradient(full.filter("trip in ('hot', 'b', 'd')"), S, "x", "g"), "trip", "time_s")
    ref = log[log.trip != "c"].fillna({"x": 0.5}).sort_values(["trip", "time_s"])
    want = np.concatenate([np.gradient(g["x"], g["time_s"]) for _, g in ref.groupby("trip")])
    assert np.allclose(got["g"], want)


def test_halo_lends_exactly_the_border_rows(spark):
    d = spark.range(20).select(F.col("id").alias("pos"))
    out = ordered.with_halo(d, 8, before=2, after=1).toPandas()
    blocks = {b: (sorted(g.pos), sorted(g.pos[g._own])) for b, g in out.groupby("_rows")}
    assert blocks[1] == (list(range(6, 17)), list(range(8, 16)))
    assert sum(out._own) == 20


def test_first_per_key(spark):
    d = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, None)], "k string, o int, v string")
    assert {tuple(r) for r in ordered.first_per_key(d, ["k"], ["o"], ["v"]).collect()} == {("a", "x"), ("b", None)}


@pytest.mark.parametrize("rows,levels", [(4, 2), (16, 1), (512, 2), (3, 3)])
def test_scans_equal_the_plain_loop(df, rows, levels):
    full = df.withColumn("x", F.coalesce("x", F.lit(0.0)) * 30)
    got = pdf_of(policies.pi_policy(full, S, "x", ["time_s"], 1.0, i_max=50.0, ki=1.0, kp=2.0, max_w=100.0, rows=rows, levels=levels), "trip", "time_s")
    ref = pdf_of(full, "trip", "time_s")
    want = []
    for _, g in ref.groupby("trip"):
        i = 0.0
        for t in g["x"]:
            i = min(max(i + (22.0 - t), -50.0), 50.0)
            want.append(min(max(2.0 * (22.0 - t) + i, 0.0), 100.0))
    assert np.allclose(got["pi_w"], want)


def test_lag_filter_settles_on_a_constant(df):
    flat = df.withColumn("u", F.lit(6000.0))
    out = policies.lag_filter(flat, S, "u", 30.0, 1.0, ["time_s"], gain=0.8, rows=8).toPandas()
    assert np.allclose(out["lagged"], 4800.0)


@pytest.mark.parametrize("step", [0.05, 0.7, 50.0])
@pytest.mark.parametrize("rows", [3, 16, 4096])
def test_slew_equals_the_plain_loop(df, step, rows):
    full = df.withColumn("x", F.coalesce("x", F.lit(0.0)))
    got = pdf_of(slew.slew(full, S, "x", step, "a", ["time_s"], rows=rows), "trip", "time_s")
    want = []
    for _, g in pdf_of(full, "trip", "time_s").groupby("trip"):
        a = None
        for x in g["x"]:
            a = x if a is None else min(max(x, a - step), a + step)
            want.append(a)
    assert np.allclose(got["a"], want, atol=1e-9)


def test_slew_continues_from_an_earlier_command(spark):
    d = spark.createDataFrame([("a", 0.0, 10.0, 4.0), ("a", 1.0, 10.0, 4.0), ("b", 0.0, 10.0, None)], "trip string, time_s double, x double, last double")
    out = {(r.trip, r.pos): r.a for r in slew.slew(d, S, "x", 2.0, "a", [], previous="last").collect()}
    assert out == {("a", 0): 6.0, ("a", 1): 8.0, ("b", 0): 10.0}


def test_block_map_is_exact_for_any_start():
    rng = np.random.default_rng(0)
    for _ in range(100):
        r = rng.exponential(1000, rng.integers(1, 20)).round(1)
        xs, ys = slew.block_map(r, 500.0, 0.0, 10000.0)
        for x in rng.uniform(0, 10000, 10):
            y = x
            for q in r:
                y = min(max(q, y - 500.0), y + 500.0)
            assert abs(np.interp(x, xs, ys) - y) < 1e-6


def _loop(requests, step):
    out, a = [], None
    for x in requests:
        a = x if a is None else min(max(x, a - step), a + step)
        out.append(a)
    return out


def test_a_key_whose_thousand_blocks_all_remember(spark):
    rng = np.random.default_rng(5)
    t = np.arange(4000)
    x = (5000 + 4000 * np.sin(t / 300.0) + rng.normal(0, 50, len(t))).round(3)
    d = spark.createDataFrame([("a", float(i), float(v)) for i, v in zip(t, x)], "trip string, time_s double, x double")
    got = pdf_of(slew.slew(d, S, "x", 0.5, "a", ["time_s"], rows=4), "time_s")
    assert np.allclose(got["a"], _loop(x, 0.5), atol=1e-7)


def test_chains_in_two_levels(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for key in ("p", "q"):
        x = 3000.0
        for at in range(70):
            r = rng.uniform(0, 6000, 3).round(2)
            want[key, at] = x
            xs, ys = slew.block_map(r, 40.0, 0.0, 6000.0)
            up = [(a, b) for a, b, c in zip(xs, xs[1:], np.diff(ys)) if c > 0.5 * (b - a)]
            rows.append((key, at, ys[0], [a for a, _ in up], [b for _, b in up], 3000.0 if at == 0 else None))
            for q in r:
                x = min(max(q, x - 40.0), x + 40.0)
    d = spark.createDataFrame(rows, "k string, _at long, base double, ramp_from array<double>, ramp_to array<double>, first double")
    for span, levels in ((4, 2), (8, 1), (100, 0)):
        got = {(r.k, r._at): r.start for r in slew._chain(d, ["k"], span=span, levels=levels).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want), (span, levels)


@pytest.mark.parametrize("step", [0.5, 30.0, 400.0])
def test_composed_slew_maps_stay_small_and_exact(step):
    rng = np.random.default_rng(7)

    def ramps(requests):
        xs, ys = slew.block_map(requests, step, 0.0, 1000.0)
        up = [(a, b) for a, b, c in zip(xs, xs[1:], np.diff(ys)) if c > 0.5 * (b - a)]
        return ys[0], np.array([a for a, _ in up]), np.array([b for _, b in up])

    blocks = [rng.uniform(0, 1000, 5).round(2) for _ in range(200)]
    whole = ramps(blocks[0])
    for b in blocks[1:]:
        whole = slew.compose(whole, ramps(b))
    assert len(whole[1]) <= 1 + 1000 / (2 * step)
    for x in rng.uniform(0, 1000, 20):
        y = x
        for q in np.concatenate(blocks):
            y = min(max(q, y - step), y + step)
        assert abs(whole[0] + np.sum(np.clip(x, whole[1], whole[2]) - whole[1]) - y) < 1e-6


def test_linear_maps_compose(spark):
    d = spark.range(10).select(F.lit("a").alias("k"), F.col("id").alias("pos"))
    out = scan.scan(d, ["k"], "pos", scan.LINEAR, (F.lit(0.5), F.lit(1.0)), 0.0, "s", [], rows=3).orderBy("pos").toPandas()
    x, want = 0.0, []
    for _ in range(10):
        x = 0.5 * x + 1
        want.append(x)
    assert np.allclose(out["s"], want)


def test_block_mean_buckets(spark):
    d = spark.createDataFrame([("T", i * 0.1, float(i)) for i in range(20)], "trip string, time_s double, p double")
    out = resample.block_mean(d, 1.0, ["p"]).orderBy("time_s").collect()
    assert [(r.time_s, r.p) for r in out] == [(0.0, 4.5), (1.0, 14.5)]
    with pytest.raises(KeyError):
        resample.block_mean(d.drop("time_s"), 1.0, ["p"])


def ess(x, max_lag):
    x = x - x.mean()
    var, total, n = x @ x, 0.0, len(x)
    for k in range(1, min(max_lag, n - 1)):
        rho = (x[:-k] @ x[k:]) / var
        if rho <= 0:
            break
        total += rho
    return n / (1 + 2 * total)


def test_effective_sample_size_query_follows_long_correlations(spark, monkeypatch):
    from tripflow.plans.catalog import telemetry as catalog
    n = 300
    rows = [(1, float(i), float(np.sin(i / 40.0))) for i in range(n)]
    d = spark.createDataFrame(rows, "trip long, time_s double, value double")
    monkeypatch.setattr(catalog, "telemetry", lambda *_: d)
    monkeypatch.setattr(catalog, "log_series", lambda *_: ordered.Series(block_s=50.0))
    x = [r[2] for r in rows]
    mean = sum(x) / n
    x = [v - mean for v in x]
    total = 0.0
    for k in range(1, n - 1):
        rho = sum(a * b for a, b in zip(x, x[k:])) / sum(a * a for a in x)
        if rho <= 0:
            break
        total += rho
    (got,) = catalog.effective_sample_size(spark, "").collect()
    assert k > 16 and got.n == n and abs(got.n_eff - n / (1 + 2 * total)) < 1e-5


def test_effective_sample_size_of_noise_and_of_a_smooth_signal(spark):
    rng = np.random.default_rng(0)
    noise, smooth = rng.normal(size=3000), np.cumsum(rng.normal(size=3000))
    rows = pd.DataFrame({"trip": ["n"] * 3000 + ["s"] * 3000 + ["flat"] * 5 + ["two"] * 2, "time_s": [*range(3000)] * 2 + [*range(5)] + [0, 1],
                         "x": np.concatenate([noise, smooth, np.ones(5), [1.0, 2.0]])})
    d = spark.createDataFrame(rows).withColumn("time_s", F.col("time_s").cast("double"))
    out = {r.trip: r.n_eff for r in resample.effective_sample_size(d, ordered.Series(block_s=500.0), "x", max_lag=400, block_rows=700).collect()}
    assert out["n"] == pytest.approx(ess(noise, 400)) and out["n"] > 1500
    assert out["s"] == pytest.approx(ess(smooth, 400)) and out["s"] < 150
    assert out["flat"] == 5 and out["two"] == 2


@pytest.mark.parametrize("n", [1, 2, 5, 9000])
def test_exact_quantiles_of_any_size(spark, n):
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(size=n - n // 3), np.full(n // 3, 0.25)])
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "v": x}))
    got = exact_quantiles(d, ["k"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.97}).first()
    assert [got.lo, got.mid, got.hi] == pytest.approx(np.quantile(x, [0.1, 0.5, 0.97]).tolist())
    whole = exact_quantiles(d, [], "v", {"mid": 0.5}).first()
    assert whole.mid == pytest.approx(np.median(x))


def test_rank_beyond_the_group_is_null(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    out = order_statistics(d, [], "v", {"s": (0.8, lambda n: F.ceil((n + 1) * 0.95) - 1)}).first()
    assert out.s is None


def test_sessions_chain_breaks_and_unknown_days(spark):
    rows = [("TripB01", "d1", False), ("TripB02", "d1", True), ("TripB03", "d1", True), ("TripB04", "d2", True),
            ("TripB05", None, True), ("TripB06", None, True), ("TripB07", "d3", False)]
    d = spark.createDataFrame(rows, "trip string, day string, warm_start boolean")
    for rows in (100_000, 1, 2):
        got = {r.trip: r.session for r in splits.sessions(d, rows=rows).collect()}
        assert got["TripB01"] == got["TripB02"] == got["TripB03"] == "d1#TripB01"
        assert got["TripB04"] == "d2#TripB04" and got["TripB05"] != got["TripB06"]


def test_ranks_spread_whatever_the_labels_look_like(spark):
    rng = np.random.default_rng(5)
    labels = [f"the same twenty chars {i:07d}" for i in rng.permutation(50_000)] + [None]
    size = rng.integers(1, 4, len(labels))
    d = spark.createDataFrame([(x, int(n)) for x, n in zip(labels, size)], "label string, size int").repartition(9)
    want = {x: i for i, x in enumerate(sorted(labels, key=lambda x: x or ""))}
    assert {r.label: r.place for r in rank.ranked(d, ["label"], "place").collect()} == want
    got = rank.ranked(d, [F.col("label")], "place", ("size",))
    per, want = {}, {}
    for x, n in sorted(zip(labels, size), key=lambda r: r[0] or ""):
        want[x] = per[n] = per.get(n, -1) + 1
    assert {r.label: r.place for r in got.collect()} == want
    assert rank.ranked(d.limit(0), ["label"], "place", ("size",)).collect() == []


def test_places_keep_the_order_of_doubles(spark):
    rng = np.random.default_rng(5)
    powers = 2.0 ** np.arange(-1074, 1024)
    x = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), rng.normal(size=500), 10.0 ** rng.uniform(-300, 300, 500)])
    x = np.concatenate([x, -x, [0.0, np.inf, -np.inf]])
    got = spark.createDataFrame(pd.DataFrame({"v": x})).select("v", place(F.col("v")).alias("p")).toPandas().sort_values("v")
    assert (np.diff(got.p) >= 0).all()
    assert got.groupby("p").v.nunique().max() <= 4
    assert got.p.max() - got.p.min() < 2 ** 63
    nan, inf = (spark.range(1).select(place(F.lit(float(v)))).first()[0] for v in ("nan", "inf"))
    assert nan > inf == got.p.max()


@pytest.mark.parametrize("most", [4, 50, 20_000])
def test_brackets_are_narrowed_digit_by_digit(spark, most):
    rng = np.random.default_rng(6)
    groups = {"wide": 10.0 ** rng.uniform(-200, 200, 9000) * rng.choice([-1, 1], 9000), "flat": np.full(7000, 3.5),
              "ties": rng.integers(0, 3, 8000).astype(float), "far": np.concatenate([rng.normal(size=6000), [np.inf, -np.inf, 1e308]]),
              "near": 1 + rng.integers(0, 5000, 9000) * 2.0 ** -52, "one": np.array([7.0]), "two": np.array([-1.0, 5e-324])}
    d = spark.createDataFrame(pd.DataFrame([(k, float(v)) for k, x in groups.items() for v in x], columns=["k", "v"])).repartition(5)
    ranks = {"lo": (0.02, lambda n: (n - 1) * 0.02), "mid": (0.5, lambda n: (n - 1) * 0.5), "top": (1.0, lambda n: n - 1),
             "none": (1.0, lambda n: n + 1)}
    got = {r.k: r for r in order_statistics(d, ["k"], "v", ranks, most=most, also={"mean": F.count}).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        x = np.sort(x)
        for name, q in (("lo", 0.02), ("mid", 0.5)):
            r = (len(x) - 1) * q
            a, z = x[math.floor(r)], x[math.ceil(r)]
            assert got[k][name] == a + (z - a) * (r - math.floor(r)), (k, name)
        assert got[k].none is None and got[k]["mean"] == len(x)
        assert got[k].top == x[-1] or math.isinf(x[-1])


def test_quantiles_without_rows_and_with_brackets_too_large_to_send(spark, monkeypatch):
    from tripflow.operators import quantiles
    empty = spark.createDataFrame([], "k string, v double")
    assert exact_quantiles(empty, ["k"], "v", {"m": 0.5}).count() == 0
    monkeypatch.setattr(quantiles, "SMALL_TABLE", 0)
    x = np.random.default_rng(8).normal(size=6000)
    d = spark.createDataFrame(pd.DataFrame({"k": np.arange(6000) % 3, "v": x}))
    got = {r.k: r.m for r in exact_quantiles(d, ["k"], "v", {"m": 0.3}, most=4).collect()}
    assert got == pytest.approx({k: np.quantile(x[k::3], 0.3) for k in range(3)})


@pytest.mark.parametrize("hot", [1_000_000, 500])
def test_brackets_of_many_groups_are_shuffled_and_only_hot_groups_repeated(spark, monkeypatch, hot):
    from tripflow.operators import quantiles
    for name, n in (("SMALL_TABLE", 0), ("HOT", hot), ("TASK_ROWS", 300)):
        monkeypatch.setattr(quantiles, name, n, raising=False)
    x = np.random.default_rng(12).normal(size=4000)
    k = np.where(np.arange(4000) < 3000, 0, np.arange(4000) % 200)
    d = spark.createDataFrame(pd.DataFrame({"k": k, "v": x, "t": np.arange(4000)}))
    out = exact_quantiles(d, ["k"], "v", {"m": 0.5}, most=50)
    assert {r.k: r.m for r in out.collect()} == {int(i): np.median(x[k == i]) for i in np.unique(k)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("explode(" in plan.replace("explode(filter(", "")) == (hot == 500)
    sent = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert len(sent) == (hot == 500)


@pytest.mark.parametrize("name", ["sample_interval", "trip_quality", "corpus_totals"])
def test_quantiles_of_intervals_do_not_open_the_windows_again(spark, name):
    import __spark_entry__ as entry
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan


def test_group_statistics_of_many_groups_keep_their_brackets_off_the_tasks(spark, monkeypatch):
    from tripflow.operators import features, quantiles
    monkeypatch.setattr(quantiles, "SMALL_TABLE", 0)
    d = spark.range(900).select((F.col("id") % 90).alias("k"), F.col("id").cast("double").alias("v"))
    out = features.group_statistics(d, "k", "v", "p")
    assert {r.k: (r.p_median, r.p_mean) for r in out.collect()} == {i: (405.0 + i, 405.0 + i) for i in range(90)}
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("kept", [4_000_000, 1000])
def test_small_brackets_go_to_the_rows_only_where_few_rows_stay(spark, monkeypatch, kept):
    from tripflow.operators import quantiles
    monkeypatch.setattr(quantiles, "KEPT", kept, raising=False)
    d = spark.range(2000).select((F.col("id") % 40).alias("k"), F.col("id").cast("double").alias("v"))
    out = exact_quantiles(d, ["k"], "v", {"m": 0.5})
    assert {r.k: r.m for r in out.collect()} == {i: 980.0 + i for i in range(40)}
    assert ("BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString()) == (kept > 2000)


@pytest.mark.parametrize("rows,levels", [(4, 2), (7, 1), (512, 2)])
def test_policies_with_finite_memory_equal_a_plain_loop(spark, rows, levels):
    rng = np.random.default_rng(11)
    t = np.where(rng.random(300) < 0.1, np.nan, 22 + np.cumsum(rng.normal(0, 0.7, 300)) % 5 - 2.5)
    trips = np.array(["hot"] * 250 + ["b"] * 49 + ["c"])
    d = spark.createDataFrame(pd.DataFrame({"trip": trips, "time_s": np.arange(300.0), "t": t})).repartition(4)
    got = {r.time_s: r.hysteresis_w for r in policies.hysteresis(d, S, "t", ["time_s"], rows=rows, levels=levels).collect()}
    # A counter of three states that a missing reading resets.
    step = lambda i: F.when(F.col("t").isNull() | F.isnan("t"), 0).when(F.col("t") > 22, min(i + 1, 2))
    counted = policies.finite_policy(d, S, 3, step, lambda s: s * 10, ["time_s"], "c", start=1, rows=rows, levels=levels)
    counts = {r.time_s: r.c for r in counted.collect()}
    on, at, last = 0, 1, None
    for i in range(300):
        if trips[i] != last:
            on, at, last = 0, 1, trips[i]
        on = 1 if t[i] < 21 else 0 if t[i] > 23 else on
        at = 0 if np.isnan(t[i]) else min(at + 1, 2) if t[i] > 22 else at
        assert got[float(i)] == (None if np.isnan(t[i]) else 7000.0 * on)
        assert counts[float(i)] == 10 * at


def test_a_series_stored_by_block_is_read_without_a_shuffle(spark, tmp_path, log):
    from tripflow.sources import store
    d = spark.createDataFrame(log)
    store.write_blocks(d, "blocks_test", str(tmp_path / "b"), S, buckets=5)
    stored, s = store.read_blocks(spark, "blocks_test", S)
    try:
        inside = s.with_block(stored).withColumn("r", F.row_number().over(s.inside()))
        per_block = s.with_block(stored).groupBy(*s.block_keys).agg(F.count(F.lit(1)).alias("n"))
        for plan in (inside, per_block):
            assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        got = ordered.with_position(stored, s).select(*log.columns, "pos").toPandas()
        want = ordered.with_position(d, S).select(*log.columns, "pos").toPandas()
        order = ["trip", "time_s"]
        pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True))
        hot = stored.filter("trip = 'hot'").select(F.input_file_name().alias("f")).distinct().count()
        assert hot == 5
    finally:
        spark.sql("DROP TABLE blocks_test")


def test_the_store_splits_a_hot_trip_over_writers(spark, tmp_path):
    from tripflow.sources import store
    n = 300_000
    d = spark.range(n).select(F.when(F.col("id") < 0.9 * n, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("trip"),
                              F.rand(3).alias("time_s"), F.rand(4).alias("x"))
    was = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        store.write_trips(d, str(tmp_path / "s"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.exceptAll(d).count() == 0 and back.count() == n
    files = back.filter("trip = 'hot'").groupBy(F.input_file_name().alias("f")).count()
    assert files.count() > 1
    small = back.filter("trip = 't1'").select(F.input_file_name()).distinct().count()
    assert small == 1
