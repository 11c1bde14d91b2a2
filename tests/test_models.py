"""Windows, regression, folds, guards, forecasts: invariants and analytic results."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripflow.operators import features, forecast, guards, outcomes, parameters, regression, resample, scoring, splits, windows
from tripflow.operators.ordered import Series

S = Series(block_s=300.0)
CH = ["y", "p_heat_w", "p_ac_w", "amb_temp_c", "speed_ms"]


def trip(name, n, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"trip": name, "time_s": np.arange(n, dtype=float), "y": 5 + 15 * (1 - np.exp(-np.arange(n) / 400)),
                         "p_heat_w": rng.uniform(500, 4000, n), "p_ac_w": 0.0, "amb_temp_c": 2.0, "speed_ms": rng.uniform(0, 20, n)})


def frame(spark, *parts):
    d = spark.createDataFrame(pd.concat(parts, ignore_index=True))
    return d.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in CH})


def starts(w):
    return sorted((r.trip, r.start_s) for r in w.select("trip", "window_id", "start_s").distinct().collect())


def test_windows_stay_inside_trips(spark):
    w = windows.build_windows(frame(spark, trip("A", 900), trip("B", 500, 1), trip("C", 100, 2)), S, CH, 300, 300)
    assert starts(w) == [("A", 0.0), ("A", 300.0), ("A", 600.0), ("B", 0.0)]
    assert w.count() == 4 * 300


def test_gappy_windows_are_dropped_and_small_gaps_filled(spark):
    a = trip("A", 900)
    a.loc[300:480, "p_heat_w"] = np.nan
    b = trip("B", 300, 1)
    b.loc[0, "y"] = np.nan
    c = trip("C", 300, 2)
    c.loc[[10, 299], "p_heat_w"] = np.nan
    w = windows.build_windows(frame(spark, a, b, c), S, CH, 300, 300)
    assert starts(w) == [("A", 0.0), ("A", 600.0), ("C", 0.0)]
    got = w.filter("trip = 'C'").orderBy("step").toPandas()
    assert got["p_heat_w"][10] == pytest.approx((c.p_heat_w[9] + c.p_heat_w[11]) / 2)
    assert got["p_heat_w"][299] == c.p_heat_w[298] and got["y"][299] == c.y[298]


def test_burn_in_anchor_and_truncation(spark):
    d = frame(spark, trip("A", 1200), trip("S", 400, 1))
    w = windows.build_windows(d, S, CH, 600, 600, burn_in_s=200)
    assert w.filter("window_id = 0").count() == 800
    assert windows.truncate(w, 60, 200).count() == 260
    t = windows.build_windows(d, S, CH, 600, anchor="trip_start")
    assert starts(t) == [("A", 0.0)]
    with pytest.raises(ValueError, match="anchor"):
        windows.build_windows(d, S, CH, 600, anchor="middle")
    with pytest.raises(ValueError, match="no window"):
        windows.require_windows(windows.build_windows(d, S, CH, 5000))


def test_first_available_needs_every_trip(spark):
    d = spark.createDataFrame([("a", 1.0, None), ("a", None, 5.0), ("b", None, 2.0)], "trip string, u double, v double")
    assert {r.x for r in windows.first_available(d, ("u", "v"), "x").collect()} == {1.0, None, 2.0}
    more = d.unionByName(spark.createDataFrame([("c", None, None)], d.schema))
    assert {r.x for r in windows.first_available(more, ("u", "v"), "x").collect()} == {None}


def test_history_mean_weights_by_age(spark):
    rows = [("a", 0, i, None if i == 3 else float(i)) for i in range(6)] + [("b", 0, i, None) for i in range(6)]
    got = {r.trip: r for r in windows.history_mean(spark.createDataFrame(rows, "trip string, window_id long, step int, y double"), "y", 4, 2.0, 1.0).collect()}
    w = np.exp((np.arange(3) - 3) / 2.0)
    assert got["a"].last_value == 2.0 and got["a"].weighted_mean == pytest.approx((w * np.arange(3)).sum() / w.sum())
    assert got["b"].last_value is None and got["b"].weighted_mean is None


def test_parameter_tables(spark):
    d = spark.createDataFrame([("ok", 1e5, 55.0), ("bad", 900.0, float("nan"))], "s string, c_cab double, ua0 double")
    long = parameters.long_parameters(d, ["s"], ["c_cab", "ua0"])
    assert {(r.s, r.name) for r in parameters.implausible(long).collect()} == {("bad", "c_cab"), ("bad", "ua0")}
    pen = {r.s: r.penalty for r in parameters.plausibility_penalty(long.filter("name = 'c_cab'"), ["s"]).collect()}
    assert pen["ok"] == 0 and pen["bad"] == pytest.approx(math.log(2e4 / 900) ** 2)
    assert {r.name: r.stuck for r in parameters.movement(long.filter("s = 'ok'")).collect()} == {"c_cab": True, "ua0": True}


def test_long_time_constant_equals_persistence(spark):
    w = windows.build_windows(frame(spark, trip("A", 900)), S, CH, 300, 300)
    p = scoring.persistence_rmse(w, "y", [60, 300]).orderBy("horizon").collect()
    r = scoring.relaxation_rmse(w, "y", "amb_temp_c", [60, 300], taus=(1e12,)).orderBy("horizon").collect()
    assert [x.persistence for x in p] == pytest.approx([x.exponential for x in r], rel=1e-6)
    assert scoring.scored_horizons((60, 300, 1200), 900) == [60, 300, 900]


def test_relaxation_grids_equal_the_rows_one_by_one(spark):
    rng = np.random.default_rng(8)
    rows = [(f"T{k % 3}", k, i, float(20 + rng.normal()), float(rng.normal(4, 3)) if rng.random() > .05 else None) for k in range(40) for i in range(30 if k % 7 else 11)]
    w = spark.createDataFrame(rows, "trip string, window_id int, step int, y double, amb double")
    horizons = spark.createDataFrame([(h,) for h in (1, 2, 7, 11, 12, 30, 99, 7)], "horizon int")
    taus = spark.createDataFrame([(float(t),) for t in np.geomspace(5, 5000, 60)], "tau_s double")
    got = {(r.tau_s, r.horizon): r.exponential for r in scoring.relaxation_rmse(w, "y", "amb", horizons, 10.0, taus).collect()}
    assert len(got) == 60 * 7
    pdf = pd.DataFrame(rows, columns=["trip", "w", "step", "y", "amb"])
    pdf["y0"] = pdf.groupby(["trip", "w"]).y.transform("first")
    for (tau, h), value in got.items():
        p = pdf[pdf.step < h]
        e = p.amb + (p.y0 - p.amb) * np.exp(-p.step * 10.0 / tau) - p.y
        assert value == pytest.approx(np.sqrt((e ** 2).mean()), rel=1e-9)
    both = {r.horizon: r for r in scoring.baseline_rmse(w, "y", "amb", [1, 30], 10.0, taus).collect()}
    assert both[30].exponential == pytest.approx(min(v for (_, h), v in got.items() if h == 30)) and both[1].persistence == 0.0
    plan = scoring.relaxation_rmse(w, "y", "amb", horizons, 10.0, taus)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def steady(spark, slope):
    rng = np.random.default_rng(5)
    parts = []
    for i in range(6):
        n = 3000
        v, amb = rng.uniform(0, 30, n), rng.uniform(-2, 6)
        cab = np.full(n, 21.0) + rng.normal(0, 1e-4, n)
        p = ((60 + slope * v) * (cab - amb) + 40 * i) / 0.96
        parts.append(pd.DataFrame({"trip": f"T{i}", "time_s": np.arange(n, dtype=float), "cabin_temp_c": cab, "amb_temp_c": amb, "velocity_kmh": v * 3.6, "heat_power_req_w": p}))
    d = regression.with_steady(spark.createDataFrame(pd.concat(parts, ignore_index=True)), S)
    terms = regression.heat_terms(d.filter("steady"), "cabin_temp_c", "amb_temp_c", "velocity_kmh", "heat_power_req_w")
    return regression.loss_estimates(regression.group_moments(terms, "trip")).first()


def test_speed_dependent_loss_is_found_or_not(spark):
    r = steady(spark, 3.0)
    assert r.within_b2 == pytest.approx(3.0, abs=0.2) and r.detected and r.n_groups == 6
    r = steady(spark, 0.0)
    assert abs(r.within_b2) < 0.2 and not r.detected


def test_steady_needs_its_channels(spark):
    d = spark.createDataFrame([("t", 0.0, 21.0)], "trip string, time_s double, cabin_temp_c double")
    assert not regression.with_steady(d, S).first().steady
    one = spark.createDataFrame([("t", float(i), 21.0, 0.0, 5.0 if i == 0 else None, 900.0) for i in range(5)],
                                "trip string, time_s double, cabin_temp_c double, amb_temp_c double, velocity_kmh double, heat_power_req_w double")
    assert regression.with_steady(one, S).filter("steady").count() == 0


def test_constant_speed_gives_no_correlation_and_no_error(spark):
    d = spark.createDataFrame([("a", float(i), 2.0 * i, 1.0 + i, 7.0) for i in range(1, 60)], "trip string, x1 double, x2 double, y double, v double")
    r = regression.loss_estimates(regression.group_moments(d, "trip")).first()
    assert r["corr"] is None and not r.detected


def test_folds_are_disjoint_and_balanced(spark):
    labels = spark.createDataFrame([(i, f"d{i % 17}") for i in range(200)], "trip int, group string")
    sizes = splits.group_sizes(labels)
    for folds in (splits.deal_folds(sizes, 5), splits.balance_folds(sizes, 5)):
        roles = splits.fold_roles(labels, folds, 5)
        assert splits.overlap(roles, "trip").count() == 0 and splits.overlap(roles, "group").count() == 0
        assert folds.count() == 17 and roles.filter("role = 'test'").count() == 200
        load = [r.s for r in folds.groupBy("fold").agg(F.sum("size").alias("s")).collect()]
        assert max(load) - min(load) <= 13


def greedy(sizes, k):
    loads, out = [0] * k, {}
    for g, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        f = loads.index(min(loads))
        out[g], loads[f] = f, loads[f] + n
    return out


@pytest.mark.parametrize("k,n", [(5, 25_000), (3, 40), (1, 7), (7, 3)])
def test_greedy_folds_equal_the_plain_loop_at_any_number_of_groups(spark, k, n):
    rng = np.random.default_rng(n)
    sizes = [(f"g{i:06d}", int(s)) for i, s in enumerate(rng.choice([1, 2, 3, 5, 8, 40, 41, 1000], n, p=[.4, .2, .1, .1, .1, .05, .04, .01]))]
    d = spark.createDataFrame(pd.DataFrame(sizes, columns=["group", "size"]))
    got = {r.group: r.fold for r in splits.balance_folds(d, k).collect()}
    assert got == greedy(sizes, k)


def test_missing_cabin_is_no_comfort(spark):
    d = spark.createDataFrame([("a", None, 1.0), ("a", 10.0, 1.0), ("b", None, 5.0), ("c", float("nan"), 5.0)], "trip string, cab double, p double")
    got = {r.trip: r for r in outcomes.outcome(d, ["trip"], "cab", "p", 60.0, cold_weight=1.0).collect()}
    assert got["a"].discomfort_kmin == 11.0 and got["a"].scored_rows == 1
    assert got["b"].discomfort_kmin is None and got["c"].discomfort_kmin is None and got["c"].scored_rows == 0


def test_lag_products_of_a_range_of_lags():
    rng = np.random.default_rng(4)
    x = rng.normal(size=500)
    for own, first, until in ((500, 1, 64), (300, 64, 400), (300, 400, 900), (20, 1, 30), (500, 500, 600)):
        want = [sum(x[i] * x[i + k] for i in range(min(own, 500 - k))) for k in range(first, min(until, 500))]
        assert np.allclose(resample.lag_products(x, own, first, until), want)


def test_lags_are_worked_off_in_stages(spark, monkeypatch):
    rng = np.random.default_rng(9)
    series = {"short": rng.normal(size=400), "long": np.cumsum(rng.normal(size=900)), "ramp": np.arange(600.0),
              "two": np.array([1.0, 2.0]), "flat": np.ones(9)}
    d = spark.createDataFrame(pd.DataFrame([(k, float(i), v) for k, x in series.items() for i, v in enumerate(x)], columns=["trip", "time_s", "x"]))
    s = Series(block_s=200.0)
    whole = {r.trip: r.n_eff for r in resample.effective_sample_size(d, s, "x", max_lag=500, block_rows=300).collect()}
    monkeypatch.setattr(resample, "STAGES", (2, 9, 40, 333))
    staged = {r.trip: r.n_eff for r in resample.effective_sample_size(d, s, "x", max_lag=500, block_rows=70).collect()}
    for k, x in series.items():
        c = x - x.mean()
        total = 0.0
        for lag in range(1, min(500, len(x) - 1)):
            rho = c[:-lag] @ c[lag:] / (c @ c) if k != "flat" else 0.0
            if rho <= 0:
                break
            total += rho
        assert whole[k] == pytest.approx(len(x) / (1 + 2 * total)) and staged[k] == pytest.approx(whole[k])


def test_group_labels_are_checked(spark):
    trips = spark.createDataFrame([("a",), ("b",)], "trip string")
    good = spark.createDataFrame([("a", "g"), ("b", "h")], "trip string, group string")
    assert splits.checked_groups(trips, good).count() == 2
    for bad, msg in ((good.filter("trip = 'a'"), "no group label"), (good.unionByName(good), "duplicate trip")):
        with pytest.raises(Exception, match=msg):
            splits.checked_groups(trips, bad).collect()


def test_split_sizes_round_up(spark):
    g = spark.createDataFrame([(i,) for i in range(38)], "group int")
    n = {r.split: r["count"] for r in splits.random_group_split(g).groupBy("split").count().collect()}
    assert n == {"train": 26, "val": 6, "test": 6}


def control(spark, rows):
    return spark.createDataFrame([("t", float(i), *r) for i, r in enumerate(rows)],
                                 "trip string, time_s double, cab double, amb double, speed double, primary double, backup double")


SITUATION = [guards.sensor_valid("cab"), guards.input_envelope("amb", "speed")]


def test_guards(spark):
    nan = float("nan")
    d = spark.createDataFrame([(12000.0,), (-50.0,), (nan,), (None,), (900.0,)], "w double")
    v = [r.v for r in d.select(guards.actuator_clamp()(F.col("w")).alias("v")).collect()]
    assert [(x.value, x.reason, x.fault) for x in v] == [
        (7000.0, "actuator limit", False), (0.0, "actuator limit", False), (0.0, "non-finite action", True), (0.0, "non-finite action", True), (900.0, None, False)]
    s = control(spark, [(20.0, 40.0, 0.0, 1.0, 1.0), (20.0, 5.0, 61.1, 1.0, 1.0), (nan, 5.0, 0.0, 1.0, 1.0), (200.0, 5.0, 0.0, 1.0, 1.0), (None, 40.0, 0.0, 1.0, 1.0), (20.0, 5.0, 9.0, 1.0, 1.0)])
    why = [r.f for r in s.select(guards.first_fault(SITUATION).alias("f")).collect()]
    assert why[0] == "ambient 40C outside identified envelope" and why[1] == "speed 61 m/s beyond identified envelope"
    assert all(w.startswith("implausible cabin sensor") for w in why[2:5]) and why[5] is None


def test_dropout_hands_over_and_back(spark):
    rows = [(None if 20 <= i < 30 else 20.0, 5.0, 10.0, 1500.0, 700.0) for i in range(60)]
    out = guards.supervise(control(spark, rows), S, "primary", "backup", SITUATION, 10.0, [], rows=16)
    log = guards.takeovers(out).orderBy("pos").toPandas()
    assert log["pos"].tolist() == list(range(20, 30)) and log["fell_back"].all() and set(log["applied_w"]) == {700.0}
    s = guards.takeover_summary(out).first()
    assert (s.n_steps, s.n_fallback, s.n_amended) == (60, 10, 0)


def test_faulty_primary_is_contained(spark):
    rows = [(20.0, 5.0, 10.0, float("nan") if i % 5 == 0 else 40000.0 if i % 3 == 0 else 1500.0, 9000.0) for i in range(1, 50)]
    out = guards.supervise(control(spark, rows), S, "primary", "backup", SITUATION, 10.0, [], rows=8).toPandas()
    assert out["applied_w"].between(0, 7000).all()
    assert set(out[out.fell_back].reason) == {"non-finite action"} and set(out[~out.fell_back & out.reason.notna()].reason) == {"actuator limit"}
    nominal = guards.supervise(control(spark, [(20.0, 5.0, 10.0, 1500.0, 0.0)] * 20), S, "primary", "backup", SITUATION, 10.0, [])
    assert guards.takeovers(nominal).count() == 0


def test_frontier(spark):
    f = spark.createDataFrame([("a", 1.0, 100.0), ("a", 3.0, 60.0), ("a", 3.0, 50.0), ("a", 5.0, 40.0)], "trip string, discomfort_kmin double, energy_wh double")
    t = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "trip string, target double")
    at = lambda x: outcomes.frontier_energy(f, t.withColumn("target", F.lit(x)), ["trip"]).orderBy("trip").first()
    assert at(2.0).energy_at_target == 75.0 and at(4.0).energy_at_target == 50.0
    assert at(5.0).energy_at_target == 40.0 and at(1.0).energy_at_target == 100.0
    assert not at(6.0).reachable and not at(0.5).reachable
    one = f.limit(0).unionByName(spark.createDataFrame([("a", 2.0, 9.0)], f.schema))
    assert outcomes.frontier_energy(one, t, ["trip"]).filter("reachable").count() == 1


def test_frontier_points_without_discomfort_are_none(spark):
    nan = float("nan")
    f = spark.createDataFrame([("a", 1.0, 100.0), ("a", 3.0, 60.0), ("a", nan, 50.0), ("a", None, 40.0)], "trip string, discomfort_kmin double, energy_wh double")
    t = spark.createDataFrame([("a",)], "trip string")
    at = lambda x: outcomes.frontier_energy(f, t.withColumn("target", F.lit(x)), ["trip"]).first()
    assert at(2.0).energy_at_target == 80.0 and at(3.0).energy_at_target == 60.0
    assert not at(4.0).reachable and not at(nan).reachable and at(nan).energy_at_target is None


def test_metrics_edge_cases(spark):
    d = spark.createDataFrame([("x", 0.0, 0.0), ("x", 0.0, 0.0), ("y", 500.0, 480.0)], "split string, a double, p double")
    m = {r.split: r for r in scoring.regression_metrics(d, ["split"], "a", "p").collect()}
    assert m["x"].r2 is None and m["x"].smape_pct == 0 and m["y"].mae_active_only is None and m["x"].idle_detection_accuracy == 1
    h = scoring.histogram(d, "a", 5).orderBy("bin").collect()
    assert [r.rows for r in h] == [2, 0, 0, 0, 1]
    c = scoring.classification_scores(d, [], F.col("a") > 120, F.col("p") > 120).first()
    assert c.accuracy == c.f1_binary == c.f1_macro == c.f1_weighted == 1.0


def test_selection_drops_twins_and_constants(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    d = spark.createDataFrame(pd.DataFrame({"y": x + rng.normal(0, .1, 300), "x": x, "twin": 2 * x, "noise": rng.normal(size=300), "flat": 1.0}))
    got = {r.feature: r.kept for r in features.select_features(d, ["x", "twin", "noise", "flat"], "y").collect()}
    assert got == {"x": not got["twin"], "twin": not got["x"], "noise": True}
    assert set(features.complete_columns(d.withColumn("gone", F.lit(None).cast("double")), ["x", "gone"])) == {"x"}


def test_two_stage_model_learns_a_step(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, 600)
    d = spark.createDataFrame(pd.DataFrame({"x": x, "target_w": np.where(x > 0.5, 2000.0, 0.0)}))
    models = features.fit_two_stage(d, ["x"], rounds=3, depth=2)
    out = features.predict_two_stage(models, d)
    assert out.filter(F.abs(F.col("target_w") - F.col("predicted_w")) > 40).count() < 12
    assert features.importances(models, ["x"], spark).first().classifier == pytest.approx(1.0)


def test_two_stage_metrics_read_written_predictions(spark):
    import __spark_entry__ as entry
    plan = entry.queries()["two_stage_model"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF(" not in plan and "lineitem" not in plan and "l_partkey" not in plan


def test_labels_skip_gaps_and_intervals_cover(spark):
    d = spark.createDataFrame([("a", t, float(t)) for t in (0, 1, 2, 5)], "trip string, tick long, v double")
    assert {(r.tick, r.horizon, r.label) for r in forecast.with_future(d, "tick", "v", [1, 3]).collect()} == {(0, 1, 1.0), (1, 1, 2.0), (2, 3, 5.0)}
    rng = np.random.default_rng(4)
    n = 4000
    pdf = pd.DataFrame({"h": 1, "label": rng.normal(0, 3, n), "p10": -1.0, "p90": 1.0})
    rows = spark.createDataFrame(pdf)
    cal, test = rows.filter("label > -100").limit(n // 2), rows
    wide = forecast.widen(test, forecast.conformal_shift(cal, ["h"]), ["h"])
    c = scoring.coverage(wide, ["h"], "label", {"wide": ("p10_wide", "p90_wide")}).first()
    assert c.wide_coverage == pytest.approx(0.8, abs=0.03)


def test_thinning_and_heads(spark):
    d = spark.range(10).select(F.lit("a").alias("trip"), F.col("id").alias("pos"))
    assert sorted(r.pos for r in features.thin(d, ["trip"], 3).collect()) == [0, 3, 6, 9]
    head, short = outcomes.head_rows(d.unionByName(spark.createDataFrame([("b", 0)], d.schema)), 5, ["trip"])
    assert head.count() == 5 and [(r.trip, r.rows) for r in short.collect()] == [("b", 1)]
