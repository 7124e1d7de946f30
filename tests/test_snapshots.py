"""Versioned snapshots in hashed buckets: saves that replace, break off, collide; reads that see one state."""

import glob
import os
import zlib

import pytest
from pyspark.sql import functions as F

from tracekit.sources import snapshots as SN
from tracekit.sources import store as ST

ROWS = "session_id string, driver string, lap_number int, Distance double"


def rows(spark, sessions, laps=(1, 2), schema=ROWS):
    return spark.createDataFrame([(s, "A", n, float(x)) for s in sessions for n in laps for x in range(3)], schema)


def save(spark, root, sessions, **tables):
    names = spark.createDataFrame([(s,) for s in sessions], "session_id string")
    return SN.save(spark, root, {t: (df, ("driver", "lap_number", "Distance")) for t, df in tables.items()}, names, buckets=4)


def held(spark, root, table="samples", **options):
    snapshot = root if isinstance(root, SN.Snapshot) else SN.latest(spark, root)
    return sorted(tuple(r) for r in SN.read(spark, snapshot, table, **options).collect())


def test_sessions_are_replaced_and_others_kept(spark, tmp_path):
    root, sessions = str(tmp_path / "p"), [f"s{i}" for i in range(12)]
    first = save(spark, root, sessions, samples=rows(spark, sessions), laps=rows(spark, sessions))
    second = save(spark, root, ["s1", "s2"], samples=rows(spark, ["s1"], laps=(9,)))
    assert (first.number, second.number, SN.latest(spark, root).number) == (1, 2, 2)
    want = [(s, "A", n, float(x)) for s in sessions if s not in ("s1", "s2") for n in (1, 2) for x in range(3)]
    assert held(spark, root) == sorted(want + [("s1", "A", 9, float(x)) for x in range(3)])
    assert held(spark, root, "laps") == sorted(want)          # no rows of s1, s2 were given: none are left
    assert held(spark, first) == sorted(want + [(s, "A", n, float(x)) for s in ("s1", "s2") for n in (1, 2) for x in range(3)])


def test_a_session_prepared_again_leaves_nothing_stale(spark, tmp_path):
    """One selected lap and a corner first, then neither: nothing of the first save is read."""
    root = str(tmp_path / "p")
    laps = spark.createDataFrame([("17", "A", 1, 80.0, *[None] * 10), ("18", "A", 1, 80.0, *[None] * 10)], ST.LAPS)
    index = spark.createDataFrame([(s, 1, "A", 1, 80.0, "T", "C", 1, None, None, None) for s in ("17", "18")], ST.LAP_INDEX)
    corners = spark.createDataFrame([("17", 1, "A", 10.0), ("18", 1, "A", 10.0)], "session_id string, Number int, Letter string, Distance double")
    ST.save_prepared(root, laps=laps, samples=rows(spark, ["17", "18"]), lap_index=index, corners=corners)
    of17 = F.col("session_id") == "17"
    ST.save_prepared(root, laps=laps.where(of17), samples=rows(spark, ["17"]), lap_index=index.limit(0), corners=corners.limit(0))
    for read, n17 in ((ST.read_lap_index, 0), (ST.read_corners, 0), (ST.read_lap_samples, 0), (ST.read_sessions, 0), (ST.read_laps, 1)):
        found = read(spark, root)
        assert found.where(of17).count() == n17 and found.where("session_id = '18'").count() >= 1


@pytest.mark.parametrize("when", ["rows fail", "commit fails"])
def test_a_save_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch, when):
    root = str(tmp_path / "p")
    save(spark, root, ["a", "b"], samples=rows(spark, ["a", "b"]), laps=rows(spark, ["a", "b"]))
    before = held(spark, root), held(spark, root, "laps")
    new = rows(spark, ["a"], laps=(7,))
    if when == "rows fail":
        broken = new.withColumn("Distance", F.when(F.col("Distance") > 1, F.raise_error(F.lit("torn")).cast("double")).otherwise(F.col("Distance")))
    else:
        broken = new
        monkeypatch.setattr(SN, "_put", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(Exception, match="torn|gone"):
        save(spark, root, ["a"], samples=new, laps=broken)
    assert (held(spark, root), held(spark, root, "laps")) == before and SN.latest(spark, root).number == 1
    monkeypatch.undo()
    left = set(glob.glob(f"{root}/samples/*"))
    assert len(left) >= 1
    gone = SN.vacuum(spark, root)
    assert all(g.startswith(("samples/", "laps/")) for g in gone) and (held(spark, root), held(spark, root, "laps")) == before
    assert len(glob.glob(f"{root}/samples/*")) == len(glob.glob(f"{root}/laps/*")) == 1


def test_two_saves_from_one_state(spark, tmp_path, monkeypatch):
    """The save that ends second is refused; it would undo the first."""
    root = str(tmp_path / "p")
    base = save(spark, root, ["a"], samples=rows(spark, ["a"]))
    save(spark, root, ["b"], samples=rows(spark, ["b"]))
    monkeypatch.setattr(SN, "latest", lambda *a: base)
    with pytest.raises(SN.SaveConflict):
        save(spark, root, ["c"], samples=rows(spark, ["c"]))
    monkeypatch.undo()
    assert {r[0] for r in held(spark, root)} == {"a", "b"}


def test_a_set_number_of_files_and_buckets_pruned(spark, tmp_path):
    root, sessions = str(tmp_path / "p"), [f"session {i}" for i in range(200)]
    snapshot = save(spark, root, sessions, samples=rows(spark, sessions))
    assert len(glob.glob(f"{root}/samples/*/*/*.parquet")) <= 4 < len(sessions)
    some = ["session 3", "session 77", "none"]
    df = SN.read(spark, snapshot, "samples", sessions=some)
    opened = {os.path.dirname(f) for f in df.inputFiles()}
    assert {int(f.rpartition("=")[2]) for f in opened} == {zlib.crc32(s.encode()) % 4 for s in some}
    assert held(spark, root, sessions=some) == sorted(("session " + n, "A", lap, float(x)) for n in ("3", "77") for lap in (1, 2) for x in range(3))
    assert held(spark, root, sessions=[]) == []
    assert SN.buckets_of(sessions, 16) == {r[0] for r in spark.createDataFrame([(s,) for s in sessions], "session_id string").select(SN.bucket(16)).distinct().collect()}


def test_columns_that_come_later_and_columns_that_change(spark, tmp_path):
    root = str(tmp_path / "p")
    save(spark, root, ["a", "b"], samples=rows(spark, ["a", "b"]))
    save(spark, root, ["a"], samples=rows(spark, ["a"]).withColumn("Speed", F.lit(5)))
    assert {(r[0], r[4]) for r in held(spark, root)} == {("a", 5), ("b", None)}
    with pytest.raises(ValueError, match="can not become"):
        save(spark, root, ["a"], samples=rows(spark, ["a"]).withColumn("Distance", F.lit("x")))
    with pytest.raises(ValueError, match="bucket"):
        save(spark, root, ["a"], samples=rows(spark, ["a"]).withColumn("bucket", F.lit(1)))


def test_rows_of_other_sessions_are_refused_and_null_sessions_kept(spark, tmp_path):
    root = str(tmp_path / "p")
    with pytest.raises(ValueError, match="not being saved"):
        save(spark, root, ["a"], samples=rows(spark, ["a", "b", "c", "d", "e", "f"]))
    save(spark, root, [None, "a"], samples=rows(spark, [None, "a"]))
    save(spark, root, [None], samples=rows(spark, [None], laps=(5,)))
    assert {(r.session_id, r.lap_number) for r in SN.read(spark, SN.latest(spark, root), "samples").collect()} == {(None, 5), ("a", 1), ("a", 2)}


def test_nothing_saved(spark, tmp_path):
    root = str(tmp_path / "none")
    assert ST.read_laps(spark, root).count() == 0 and SN.latest(spark, root).number == 0
    save(spark, root, [], samples=rows(spark, []))
    assert held(spark, root) == []
