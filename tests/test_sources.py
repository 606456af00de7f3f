"""Binary readers against files made here."""

import numpy as np
import pytest

from nimbogrid.sources import grids, observations


def test_conventional_records_round_trip(spark, tmp_path):
    rows = [(2819, 135.0, 35.0, 850.0, 3.5, 1.0, 1, 0.0), (14593, 136.0, 36.0, 120.0, 101000.0, 100.0, 2, -60.0)]
    for endian in "><":
        (tmp_path / f"f{ord(endian)}.dat").write_bytes(observations.encode(rows, endian))
        got = observations.read_records(spark, str(tmp_path / f"f{ord(endian)}.dat"), endian=endian).orderBy("nth").collect()
        assert [r["elm"] for r in got] == [2819, 14593]
        assert [r["lev"] for r in got] == [85000.0, 120.0]


def test_radar_header_and_sets(spark, tmp_path):
    head = [(135.0,), (34.5,), (12.0,)]
    (tmp_path / "a.dat").write_bytes(observations.encode(head + [(4001, 135.1, 34.6, 500.0, 20.0, 5.0, 22)] * 3))
    (tmp_path / "b.dat").write_bytes(observations.encode(head))
    d = observations.read_records(spark, str(tmp_path / "a.dat"), "radar")
    assert d.count() == 3 and d.first()["meta"] == [135.0, 34.5, 12.0]
    both = observations.read_sets([d, observations.read_records(spark, str(tmp_path / "b.dat"), "radar"), d])
    assert sorted((r["set"], r["idx"]) for r in both.collect()) == [(s, n) for s in (1, 3) for n in (1, 2, 3)]


def test_broken_record_is_an_error():
    with pytest.raises(ValueError):
        observations.records(observations.encode([(1.0, 2.0)])[:-2] + b"\0\0\0\1")


def test_flat_binary(spark, tmp_path):
    spec = grids.FlatSpec(3, 2, [("t", 2), ("ps", 1)], missing=-9.99e33, y_reverse=True)
    a = np.arange(36, dtype="<f4")
    a[5] = -9.99e33
    (tmp_path / "g.bin").write_bytes(a.tobytes())
    d = grids.read_flat(spark, str(tmp_path / "g.bin"), spec)
    assert d.count() == 36 and d.filter("value is null").count() == 1
    row = d.filter("var = 'ps' and step = 2 and k = 1 and j = 2 and i = 1").first()
    assert row["value"] == 18 + 12
    assert grids.read_flat(spark, str(tmp_path / "g.bin"), spec, ["ps"]).count() == 12


def test_tiles_and_mosaic(spark):
    c = spark.createDataFrame([(0.0, 10.0, 0.0, 10.0), (20.0, 30.0, 0.0, 10.0)], "lon0 double, lon1 double, lat0 double, lat1 double")
    assert grids.tiles_in(c, 5, 12, 5, 6).count() == 1
    m = grids.mosaic(spark.createDataFrame([(1, 5.0), (2, -99.0)], "i int, value double"), -50.0, 36)
    assert sorted((r["i"], r["value"]) for r in m.collect()) == [(-35, 5.0), (-34, None), (1, 5.0), (2, None)]


def test_write_and_unpivot(spark, tmp_path):
    d = spark.createDataFrame([(1, 135.0, 35.0, 0.0, 280.0, None), (2, 135.0, 35.0, 4.0, 281.0, 1.0)], "id int, lon double, lat double, hour double, t double, u double")
    long = observations.decode_wide(d, ["id"], {"t": "T", "u": "U"}, {"t": 1.0, "u": 1.0}, (-3, 3), (130, 140, 30, 40))
    assert [(r["id"], r["elm"], r["dat"]) for r in long.collect()] == [(1, 3073, 280.0)]
    observations.write_observations(long, str(tmp_path / "o"), partition=["elm"])
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_ensemble_prunes_members_and_columns(spark, tmp_path):
    spark.createDataFrame([(m, k, float(m * k), 1.0) for m in (-2, -1, 1, 2) for k in range(5)], "member int, cell int, t double, u double").write.partitionBy("member").parquet(str(tmp_path / "e"))
    d = observations.read_ensemble(spark, str(tmp_path / "e"), ["cell", "t"], [1, 2])
    assert d.columns == ["member", "cell", "t"] and d.count() == 10 and observations.read_ensemble(spark, str(tmp_path / "e")).count() == 20
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<cell:int,t:double>" in plan and "PartitionFilters: [member" in plan
    for bad in (["cell", "q"], ["none"]):
        with pytest.raises(ValueError):
            observations.read_ensemble(spark, str(tmp_path / "e"), bad)
    spark.range(3).write.parquet(str(tmp_path / "f"))
    with pytest.raises(ValueError):
        observations.read_ensemble(spark, str(tmp_path / "f"))
