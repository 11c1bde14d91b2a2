"""Raw files to canonical rows, quality records and audit tables."""

import pytest
from pyspark.sql import functions as F

from tripflow.functions import headers, scalars
from tripflow.functions import signals as sig
from tripflow.operators import canonical, quality
from tripflow.operators.ordered import Series
from tripflow.plans import ingest
from tripflow.sources import delimited, simulation, store

HEAD = "Time [s];Velocity [km/h];Velocity [km/h]]];Temperature Vent right [°C];Temperature Vent right [°C];Requested Heating Power [W];AirCon Power [kW];Coolant Volume Flow +500 [l/h];Odd One [x];"


def write(path, text, encoding="cp1252"):
    path.write_bytes(text.encode(encoding))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    rows = []
    for i in range(40):
        v = f"{i};;" if i % 2 else f";{i};"
        power = 8000 if i == 7 else "" if i == 8 else 1000 + i
        rows.append(f"{i / 10};{v}{i};{i + 5};{power};0.5;700;1;" + ("9" if i == 4 else ""))
    write(d / "TripB01.csv", "\n".join([HEAD, *rows]) + "\n")
    write(d / "TripA02.csv", "Time [s],Requested Heating Power [W]\n" + "\n".join(f"{i},0" for i in range(30)) + "\n")
    return str(d)


def test_header_keys():
    assert headers.header_key_of("Velocity [km/h]") == headers.header_key_of("Velocity [km/h]]]")
    assert headers.header_key_of("﻿Battery Temperature [°C]") == "battery temperature c"
    assert headers.header_key_of("Battery Temperature [�C]") == "battery temperature c"
    assert headers.plain_key_of("max. SoC [%)") == "max state of charge %"


def test_header_keys_as_columns_agree_with_names(spark):
    names = ["Velocity [km/h]]]", "﻿Time [s]", "max. SoC [%)", "  A--b ", "Coolant Volume Flow +500 [l/h]", "x y"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    got = d.select("n", headers.header_key(F.col("n")).alias("k"), headers.header_key(headers.compatibility_form("n")).alias("c"),
                   headers.plain_key(F.col("n")).alias("p")).collect()
    for r in got:
        assert r.k == r.c == headers.header_key_of(r.n)
        assert r.p == headers.plain_key_of(r.n)


def test_vocabulary_is_complete_and_tiers_are_honest():
    names = [s.canonical for s in sig.measured()]
    assert len(names) == len(set(names)) == 47 and all(s.tier in sig.TIERS for s in sig.measured())
    assert sig.measured_map()[headers.header_key_of("max. SoC [%)")] == "soc_max_pct"
    honest = sig.columns_in_tiers("upstream", "vehicle")
    assert "heater_current_a" not in honest and "velocity_kmh" in honest and honest.index("amb_temp_c") == 0
    with pytest.raises(ValueError):
        sig.key_map([sig.Signal("a", None, "X [y]"), sig.Signal("b", None, "x (y)")])


def test_duplicates_and_targets(spark):
    d = spark.createDataFrame([("f", i, n) for i, n in enumerate(["A [x]", "a x", "B", "A-x"])], "file string, at int, name string")
    got = headers.number_duplicates(d.withColumn("k", headers.plain_key(F.col("name"))), ["file"], "k", "at", "unique").orderBy("at").collect()
    assert [r.unique for r in got] == ["a x", "a x__dup2", "b", "a x__dup3"]
    t = spark.createDataFrame([(n,) for n in ("Heating Power CAN [kW]", "Requested Heating Power [W]", "Total Power of Seat Heating", "x")], "n string")
    rank = {r.n: r.r for r in t.select("n", headers.target_rank(headers.plain_key(F.col("n"))).alias("r")).collect()}
    assert rank["x"] is None and rank["Requested Heating Power [W]"] < rank["Total Power of Seat Heating"]
    assert rank["Requested Heating Power [W]"] < rank["Heating Power CAN [kW]"]


def test_leaky_names():
    assert headers.is_leaky_name("Heater Signal") and not headers.is_leaky_name("Velocity [km/h]")


def test_files_become_canonical_rows(spark, folder):
    rows, extras = ingest.read_logs(spark, folder)
    b = rows.filter("trip = 'TripB01'").orderBy("time_s").toPandas()
    assert len(b) == 40 and b["velocity_kmh"].tolist() == [float(i) for i in range(40)]
    assert b["vent_right_c__2"].tolist() == [i + 5.0 for i in range(40)]
    assert set(b["aircon_power_w"]) == {500.0} and set(b["coolant_flow_lph"]) == {200.0}
    assert b["merged"][0] == ["velocity_kmh"] and b["conflicting"][0] == ["vent_right_c"]
    kinds = {(r.header, r.kind, r.present) for r in extras.collect()}
    assert kinds == {("Odd One [x]", "unmapped", 40), ("Unnamed: 9", "stray", 1)}


def test_ingest_and_audit(spark, folder, tmp_path):
    report = ingest.ingest(spark, folder, str(tmp_path / "out"))
    r = {x.trip: x for x in report.collect()}
    b = r["TripB01"]
    assert (b.n_rows_raw, b.n_rows_out, b.n_target_over_rating, b.target_max_raw_w) == (40, 38, 1, 8000.0)
    assert b.dt_median_s == pytest.approx(0.1) and not b.dt_irregular and b.n_raw_columns == 10
    assert b.stray_field_columns == ["Unnamed: 9(1)"] and b.unmapped_columns == ["Odd One [x]"]
    assert set(b.constant_columns) == {"aircon_power_w", "coolant_flow_lph"}
    assert b.schema_id != r["TripA02"].schema_id and r["TripA02"].target_constant
    store_rows = store.load_trips(spark, str(tmp_path / "out/trips"), "vent_right_c")
    assert store_rows.select("trip").distinct().count() == 1 and store_rows.count() == 4
    with pytest.raises(FileNotFoundError):
        store.load_trips(spark, str(tmp_path / "out/trips"), "vent_right_c__none")
    flat = spark.read.option("header", "true").csv(str(tmp_path / "out/quality_csv"))
    assert "frac_missing_by_column" not in flat.columns
    assert {x.merged_duplicate_columns for x in flat.collect()} == {"velocity_kmh", None}
    tables = {k: v.collect() for k, v in ingest.audit(report).items()}
    assert tables["totals"][0].rows_raw == 70 and [x.trip for x in tables["idle"]] == ["TripA02"]
    assert tables["over_limit"][0].rows_over == 1 and len(tables["variants"]) == 2
    assert [(x.label, x.trips) for x in tables["unmapped_columns"]] == [("Odd One [x]", 1)]


def test_load_report_and_unreadable_files(spark, tmp_path):
    write(tmp_path / "good.csv", "a;b\n" + "1;2\n" * 250)
    write(tmp_path / "short.csv", "a,b\n1,2\n")
    write(tmp_path / "bad.csv", "nothing here\n1\n")
    got = {r.file: (r.rows, r.sep, r.error) for r in delimited.load_report(spark, str(tmp_path)).collect()}
    assert got == {"good.csv": (250, ";", None), "short.csv": (1, ",", "too few rows"), "bad.csv": (1, None, "unreadable")}
    with pytest.raises(ValueError, match="could not parse"):
        delimited.variants(spark, str(tmp_path))
    assert len(delimited.variants(spark, str(tmp_path), skip_unreadable=True)) == 2


def test_byte_order_mark_is_read_as_utf8(spark, tmp_path):
    write(tmp_path / "u.csv", "Time [s];Cabin Temperature Sensor [°C]\n0;20\n", "utf-8-sig")
    rows, _ = ingest.read_logs(spark, str(tmp_path))
    assert rows.first().cabin_temp_c == 20.0


def test_extra_field_classes(spark):
    rows = [("Unnamed: 23", 0, 2), ("Unnamed: 7", 2, 2), ("Unnamed: 7", 1, 500), ("Unnamed: 7", 500, 500), ("Named [x]", 0, 2), (" ", 5, 500)]
    d = spark.createDataFrame(rows, "h string, p long, n long")
    got = [r.k for r in d.select(delimited.extra_class(delimited.is_placeholder(F.col("h")), F.col("p"), F.col("n")).alias("k")).collect()]
    assert got == ["trailing_empty", "unmapped", "stray", "unmapped", "unmapped", "stray"]


def test_short_files_and_blank_records_are_left_out(folder, spark, tmp_path):
    write(tmp_path / "TripB01.csv", "Time [s],Ambient Temperature [°C]\n" + "".join(f"{i},1\n" for i in range(5)) + ",\n , \n")
    write(tmp_path / "TripB02.csv", "Time [s],Ambient Temperature [°C]\n1,1\n,\n,\n,\n,\n")
    rows, _ = ingest.read_logs(spark, str(tmp_path), min_rows=3)
    assert [(r.trip, r["count"]) for r in rows.groupBy("trip").count().collect()] == [("TripB01", 5)]
    report = {r.file: (r.rows, r.error) for r in delimited.load_report(spark, str(tmp_path), min_rows=3).collect()}
    assert report == {"TripB01.csv": (5, None), "TripB02.csv": (1, "too few rows")}


def test_ingest_leaves_short_files_out_of_store_and_report(folder, spark, tmp_path):
    every = ingest.ingest(spark, folder, str(tmp_path / "all"))
    rows = {r.trip: r.n_rows_raw for r in every.collect()}
    bar = max(rows.values())
    kept = ingest.ingest(spark, folder, str(tmp_path / "kept"), min_rows=bar)
    assert {r.trip for r in kept.collect()} == {t for t, n in rows.items() if n >= bar}
    assert {r.trip for r in spark.read.parquet(str(tmp_path / "kept/trips")).select("trip").distinct().collect()} <= {t for t, n in rows.items() if n >= bar}


def test_any_number_of_extra_fields_is_counted(spark, tmp_path):
    rows = ["1,2,3", "1,2,3,4,5,6,7,8,9,10", '1,2,3,"a,b",5,6,7,8,9,10,11']
    write(tmp_path / "TripB09.csv", "\n".join(["Time [s],Ambient Temperature [°C],Requested Heating Power [W]", *rows]) + "\n")
    _, extras = ingest.read_logs(spark, str(tmp_path))
    got = {r.position: (r.header, r.present) for r in extras.collect()}
    assert got == {p: (f"Unnamed: {p}", 1 if p in (3, 10) else 2) for p in range(3, 11)}


def test_a_long_header_is_read_whole(spark, tmp_path):
    names = ["Time [s]", *(f"Channel {i} " + "x" * 300 for i in range(1200)), "Requested Heating Power [W]"]
    write(tmp_path / "TripB10.csv", ",".join(names) + "\n" + ",".join(["1"] * len(names)) + "\n")
    (v,) = delimited.variants(spark, str(tmp_path))
    assert v.names == [n.strip() for n in names]


def test_three_copies_of_a_signal(spark):
    d = spark.createDataFrame([("t", 1.0, 9.0, 1.0), ("t", None, 2.0, 7.0), ("u", 1.0, None, 8.0), ("u", 2.0, 2.0, 8.0)],
                              "trip string, a double, b double, c double")
    out = canonical.merge_copies(d, ["trip"], {"x": ["a", "b", "c"]}).orderBy("trip", "x").collect()
    assert [(r.x, r.x__2) for r in out] == [(1.0, 9.0), (7.0, 2.0), (1.0, 8.0), (2.0, 8.0)]
    assert out[0].conflicting == ["x"] and out[0].merged == ["x"]
    assert out[2].merged == ["x"] and out[2].conflicting == ["x"]


def test_range_check_knows_nan(spark):
    d = spark.createDataFrame([("t", 8000.0), ("t", float("nan")), ("t", 5.0), ("t", None)], "trip string, p double")
    r = quality.range_counts(d, ["trip"], "p").first()
    assert r.n_over == 1
    assert [x.p for x in quality.clean_range(d, "p").collect()] == [5.0]


def test_fingerprint_ignores_order_and_repeats(spark):
    d = spark.createDataFrame([(["b", "a"],), (["a", "b", "a"],), (["a"],)], "n array<string>")
    ids = [r.f for r in d.select(canonical.fingerprint(F.col("n")).alias("f")).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 6


def test_overview_sheet(spark):
    rows = [("TripB01 ", "2019-12-07_13-21-14", 22.0, "2 persons + 80 kg"), (None, None, None, None), ("nan", None, None, None),
            ("TripB02", "2019_12_08_09-38-26", 22.0, "Directly after previous trip"), ("TripB01", "2020-01-01", 21.0, "later copy")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, Trip string, Date string, `Target Cabin Temperature` double, Note string")
    out = {r.trip: r for r in store.overview_table(d, order="i").collect()}
    assert set(out) == {"TripB01", "TripB02"}
    assert out["TripB01"].day == "2019-12-07" and out["TripB01"].payload_kg == 80.0 and not out["TripB01"].warm_start
    assert out["TripB02"].day == "2019-12-08" and out["TripB02"].warm_start and out["TripB02"].distance_km is None


def test_simulation_runs(spark, tmp_path):
    text = ("t;T;v;p;p2\n;Environment;Vehicle;Battery;Consumption\nTime [s];Ambient Temperature [C];Speed [m/s];Heating Power [kW];Heating Power [kW]\n"
            "0;-10;10;1.5;9\n1;-10;20;2;9\n")
    write(tmp_path / "Neg10_Charging_CAN.csv", text)
    write(tmp_path / "0_Plain_LIN.csv", text)
    out = simulation.read_runs(spark, str(tmp_path)).orderBy("run", "time_s").collect()
    assert len(out) == 4 and {r.run: r.amb_setpoint_c for r in out} == {"0_Plain_LIN": 0.0, "Neg10_Charging_CAN": -10.0}
    assert out[3].heat_power_req_w == 2000.0 and out[3].velocity_kmh == pytest.approx(72.0)
    assert (out[3].strategy, out[3].bus) == ("Charging", "CAN")
    assert simulation.ingest_runs(spark, str(tmp_path), str(tmp_path / "o")) == 2
    bad = spark.createDataFrame([("Hot_x_y",)], "run string").select(*scalars.run_name_parts("run", sig.AMBIENT_CODES))
    with pytest.raises(Exception, match="unknown run name"):
        bad.collect()


def test_quality_of_a_single_row_trip(spark):
    d = spark.createDataFrame([("t", 0.0, 1.0, None)], "trip string, time_s double, p double, q double")
    r = quality.quality_record(d, Series(), "p", ["p", "q"]).first()
    assert r.n_rows_out == 1 and r.dt_median_s is None and r.target_constant and r.constant_columns == ["time_s", "p"]


def test_an_endless_reading_beside_a_gap_is_no_conflict(spark):
    d = spark.createDataFrame([("t", None, float("inf")), ("t", 2.0, 2.0)], "trip string, a double, b double")
    out = canonical.merge_copies(d, ["trip"], {"x": ["a", "b"]}).collect()
    assert sorted(r.x for r in out) == [2.0, float("inf")] and {tuple(r.merged) for r in out} == {("x",)} and {len(r.conflicting) for r in out} == {0}
