"""Prepared dataset round trip (expectations of the reference's store test) and bookkeeping."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tracekit.operators import select as SE
from tracekit.plans import compare as CP
from tracekit.sources import store as ST


def _fixture(spark):
    laps = spark.createDataFrame(
        [("2024_italian_grand_prix_q", d, n, t, 26.0, 27.0, t - 53.0, "SOFT", 3.0, 1, team, "1", None, None)
         for d, team, laps_ in (("VER", "Red Bull", [(1, 81.0), (2, 80.0)]), ("LEC", "Ferrari", [(1, 80.5)]))
         for n, t in laps_], ST.LAPS)
    rows = []
    for d, speeds in (("VER", [300.0, 200.0, 310.0]), ("LEC", [298.0, 190.0, 305.0])):
        for lap in (1, 2):
            for i, x in enumerate([0.0, 50.0, 100.0]):
                rows.append(("2024_italian_grand_prix_q", d, lap, i, x, float(i) * (10 if d == "VER" else 11),
                             speeds[i], 0))
    samples = spark.createDataFrame(rows, "session_id string, driver string, lap_number int, sample_id long, "
                                          "Distance double, TimeSeconds double, Speed double, Brake int")
    req = spark.createDataFrame([("2024_italian_grand_prix_q", "VER", 1), ("2024_italian_grand_prix_q", "LEC", 2)],
                                "session_id string, Driver string, position int")
    return laps, samples, req


def test_round_trip(spark, tmp_path):
    laps, samples, req = _fixture(spark)
    fsel = SE.fastest_laps_selected(laps, req)
    idx = ST.lap_index_from_selection(SE.lap_metadata(fsel), SE.sector_table(fsel, laps))
    root = str(tmp_path / "prepared")
    ST.save_prepared(root, laps=laps, samples=samples, lap_index=idx, frequency_hz=10)
    back = ST.read_lap_index(spark, root)
    assert [r["driver"] for r in ST.prepared_drivers(back).orderBy("position").collect()] == ["VER", "LEC"]
    assert ST.contains_drivers(back, req).first()["contains"] is True
    more = req.unionByName(spark.createDataFrame([("2024_italian_grand_prix_q", "HAM", 3)], req.schema))
    assert ST.contains_drivers(back, more).first()["contains"] is False
    assert [r["Driver"] for r in ST.missing_drivers(back, more).collect()] == ["HAM"]
    out = CP.compare_prepared(back, ST.read_lap_samples(spark, root, back), req, points=3)
    delta = out["pairs"].orderBy("grid_index").collect()
    assert [r["DeltaSeconds"] for r in delta] == [0.0, 1.0, 2.0]
    assert [r["Driver"] for r in out["sectors"].orderBy("position").collect()] == ["VER", "LEC"]
    ST.save_prepared(root, laps=laps, samples=samples, lap_index=idx, frequency_hz=10, segments=True)
    again = CP.compare_prepared(back, ST.read_lap_samples(spark, root), req, points=3, segments=ST.read_segments(spark, root))
    assert sorted(again["pairs"].select(*out["pairs"].columns).collect()) == sorted(out["pairs"].collect())
    assert ST.read_laps(spark, root, ["2024_italian_grand_prix_q"]).count() == 3
    assert ST.read_laps(spark, root, ["nope"]).count() == 0
    assert ST.read_sessions(spark, root).first()["dataset_version"] == 1
    assert ST.read_corners(spark, root).count() == 0


def test_saving_keeps_other_sessions(spark, tmp_path):
    laps, samples, req = _fixture(spark)
    root = str(tmp_path / "p")
    idx = spark.createDataFrame([], ST.LAP_INDEX)
    ST.save_prepared(root, laps=laps, samples=samples, lap_index=idx)
    other = laps.withColumn("session_id", F.lit("2023_monza_r"))
    ST.save_prepared(root, laps=other, samples=samples.limit(0), lap_index=idx)
    assert ST.read_laps(spark, root).select("session_id").distinct().count() == 2


def test_manifest_json_and_version_gate(spark, tmp_path):
    m = {"dataset_version": 1, "generated_at": "2024-09-01T00:00:00+00:00",
         "request": {"year": 2024, "grand_prix": "Italian Grand Prix", "session_type": "Q"},
         "frequency_hz": 10,
         "laps": [{"driver": "LEC", "lap_number": 20, "lap_time_seconds": 79.461, "team": "Ferrari",
                   "compound": "SOFT", "stint": 5, "telemetry_file": "telemetry/LEC.csv",
                   "sector1": 26.5, "sector2": 27.0, "sector3": 25.961},
                  {"driver": "NOR", "lap_number": 19, "lap_time_seconds": 79.327, "team": "McLaren",
                   "compound": "SOFT", "stint": None, "telemetry_file": "telemetry/NOR.csv",
                   "sector1": None, "sector2": 27.1, "sector3": 25.8}]}
    good = tmp_path / "good"
    good.mkdir()
    (good / "manifest.json").write_text(json.dumps(m, indent=2))
    idx = ST.lap_index_from_manifests(spark, str(good)).orderBy("position").collect()
    assert [(r["session_id"], r["position"], r["driver"], r["stint"]) for r in idx] == [
        ("2024_italian_grand_prix_q", 1, "LEC", 5), ("2024_italian_grand_prix_q", 2, "NOR", None)]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "manifest.json").write_text(json.dumps(dict(m, dataset_version=2)))
    with pytest.raises(Exception, match="Unsupported"):
        ST.lap_index_from_manifests(spark, str(bad)).collect()


def test_manifests_that_cannot_be_read_contain_nothing(spark, tmp_path):
    good = {"dataset_version": 1, "laps": [{"driver": "A", "lap_number": 3}, {"driver": "B"}], "more": {"x": [1]}}
    text = json.dumps(good, indent=1)
    files = {"s1": text, "s2": text[:-20], "s3": json.dumps({**good, "dataset_version": 2}), "s4": "not json", "s5": "",
             "s6": json.dumps({"laps": good["laps"]}), "s7": json.dumps({"dataset_version": 1}), "s8": json.dumps({"dataset_version": 1, "laps": [{"driver": 44}]})}
    for s, body in files.items():
        (tmp_path / s).mkdir()
        (tmp_path / s / "manifest.json").write_text(body)
    found = ST.read_manifests(spark, str(tmp_path / "*" / "manifest.json"))
    got = {r.session_id: (r.status, r.drivers) for r in found.collect()}
    assert got == {"s1": ("ok", ["A", "B"]), "s2": ("unreadable", None), "s3": ("unsupported", None), "s4": ("unreadable", None),
                   "s6": ("unsupported", None), "s7": ("ok", []), "s8": ("ok", ["44"])}
    asked = [("s1", "A"), ("s1", "B"), ("s2", "A"), ("s3", "A"), ("s4", None), ("s5", "A"), ("s6", "A"), ("s7", None), ("s8", "44"), ("s9", "A")]
    answer = lambda rows: {r.session_id: r.contains for r in ST.manifests_contain(found, spark.createDataFrame(rows, "session_id string, Driver string")).collect()}
    assert answer(asked) == {f"s{i}": i in (1, 7, 8) for i in range(1, 10)}
    assert answer([("s1", "C"), ("s7", "A")]) == {"s1": False, "s7": False}


def test_season_events_fallback_and_resolve_source(spark):
    sched = spark.createDataFrame([(2024, 1, "Bahrain"), (2024, 2, " "), (2024, 3, None)],
                                  "year int, round int, event_name string")
    seasons = spark.createDataFrame([(2024,), (2031,)], "year int")
    out = ST.season_events(sched, seasons).collect()
    got = {(r["year"], r["position"]): r["event_name"] for r in out}
    assert got[(2024, 1)] == "Bahrain" and (2024, 2) not in got
    assert got[(2031, 1)] == "Australian Grand Prix" and len([k for k in got if k[0] == 2031]) == 33
    idx = spark.createDataFrame([("a", 1, "X", 1, 80.0, "T", "S", 1, 1.0, 1.0, 1.0)], ST.LAP_INDEX)
    req = spark.createDataFrame([("a", "X", 1), ("b", "Y", 1), ("c", "Z", 1)], "session_id string, Driver string, position int")
    live = spark.createDataFrame([("b",)], "session_id string")
    src = {r["session_id"]: r["data_source"] for r in ST.resolve_source(req, idx, live).collect()}
    assert src == {"a": "prepared", "b": "live", "c": "demo"}


def test_validate_and_summary(spark):
    laps = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", "X")], "session_id string, Driver string")
    samples = spark.createDataFrame([("a",)], "session_id string")
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "session_id string")
    v = {r["session_id"]: (r["is_valid"], r["reason"]) for r in ST.validate_sessions(req, laps, samples).collect()}
    assert v == {"a": (True, None), "b": (False, "no telemetry"), "c": (False, "no laps")}
    s = {r["session_id"]: (r["driver_count"], r["lap_count"], r["date"]) for r in ST.session_summary(laps).collect()}
    assert s == {"a": (2, 2, "unknown"), "b": (1, 1, "unknown")}


def test_export_csv_round_trip(spark, tmp_path):
    laps, _, _ = _fixture(spark)
    p = str(tmp_path / "laps_csv")
    ST.export_csv(laps, p)
    back = ST.read_csv(spark, p, ST.LAPS)
    assert sorted(back.collect()) == sorted(laps.collect())


def test_report_bundle(spark, tmp_path):
    laps, samples, req = _fixture(spark)
    cmp_ = CP.compare_fastest_laps(laps, samples, req, points=3)
    lap_samples = SE.selected_lap_samples(samples, SE.fastest_laps_selected(laps, req))
    paths = CP.build_report(cmp_, lap_samples, laps, str(tmp_path / "report"))
    assert set(paths) == {"channel_overlay", "lap_evolution", "insights", "delta", "sector_bars"}
    ins = spark.read.parquet(paths["insights"]).orderBy("Item").collect()
    assert ins[0]["Text"] == "VER owns the best selected lap by 0.500s over LEC."
    assert ins[-1]["Kind"] == "final_delta"
    assert spark.read.parquet(paths["delta"]).count() == 3
