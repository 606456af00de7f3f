"""Scans by byte ranges: the same rows however files are cut, and large files in many pieces."""

import json

import numpy as np
import pyarrow as pa
import pytest

from nimbogrid.sources import grids, netcdf, observations, ranges


def rows(d):
    return sorted(map(str, d.collect()))


@pytest.mark.parametrize("kind", ["conventional", "radar"])
def test_records_in_pieces(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    head = [] if kind == "conventional" else [(135.0,), (34.5,), (12.0,)]
    width = 8 if kind == "conventional" else 7
    for name, n in (("a", 1000), ("b", 1), ("c", 0)):
        (tmp_path / f"{name}.dat").write_bytes(observations.encode(head + [(2819, *rng.normal(size=width - 1)) for _ in range(n)]))
    path = str(tmp_path / "*.dat")
    whole, cut = (observations.read_records(spark, path, kind, split=s) for s in (ranges.SPLIT, 3000))
    assert rows(whole) == rows(cut) and cut.count() == 1001
    assert cut.rdd.getNumPartitions() > 10 and sorted(r["nth"] for r in cut.filter("path LIKE '%a.dat'").collect()) == list(range(1000))


def test_a_file_of_3_gb_is_many_pieces_of_whole_records(tmp_path):
    width = 40
    path = tmp_path / "large.dat"
    path.write_bytes(observations.encode([[0.0] * 8]))
    n = 3 * 2**30 // width
    with path.open("r+b") as f:
        f.truncate(n * width)
    plan, read = observations._format("conventional", ">")
    with ranges.opened(f"file:{path}") as f:
        pieces = list(plan(f, n * width, ranges.SPLIT))
        assert len(pieces) == 49 and sum(p["to"] - p["from"] for p in pieces) == n * width and all((p["to"] - p["from"]) % width == 0 for p in pieces)
        batch = next(iter(read(f, "x", json.loads(json.dumps(pieces[0] | {"to": pieces[0]["from"] + width})))))
        assert batch.num_rows == 1
        with pytest.raises(ValueError):  # zeros are no records
            next(iter(read(f, "x", pieces[5])))


def test_broken_records_are_errors(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(observations.encode([[1.0] * 8] * 5)[:-4])
    with pytest.raises(Exception, match="broken record"):
        observations.read_records(spark, str(tmp_path / "a.dat")).collect()


@pytest.mark.parametrize("reverse", [False, True])
def test_flat_steps_levels_and_rows(spark, tmp_path, reverse):
    spec = grids.FlatSpec(5, 7, [("t", 3), ("ps", 1), ("q", 2)], missing=-9.99e33, y_reverse=reverse)
    v = np.arange(4 * spec.step_count(), dtype="<f4")
    v[17] = -9.99e33
    (tmp_path / "g.bin").write_bytes(v.tobytes())
    path = str(tmp_path / "g.bin")
    whole = grids.read_flat(spark, path, spec)
    assert rows(whole) == rows(grids.read_flat(spark, path, spec, split=64)) and whole.count() == len(v)
    a = v.reshape(4, 6, 7, 5)
    for r in whole.collect():
        level = {"t": 0, "ps": 3, "q": 4}[r["var"]] + r["k"] - 1
        want = a[r["step"] - 1, level, 7 - r["j"] if reverse else r["j"] - 1, r["i"] - 1]
        assert r["value"] == want or r["value"] is None and want == np.float32(-9.99e33)
    some = grids.read_flat(spark, path, spec, ["t", "q"], steps=(2, 3), levels=(2, 9), split=64)
    assert rows(some) == rows(whole.filter("var IN ('t', 'q') AND step BETWEEN 2 AND 3 AND k >= 2"))
    assert grids.read_flat(spark, path, spec, ["none"]).count() == 0


def test_only_chosen_bytes_are_read(tmp_path):
    spec = grids.FlatSpec(10, 10, [("a", 50), ("b", 1)])
    (tmp_path / "g.bin").write_bytes(np.zeros(3 * spec.step_count(), "<f4").tobytes())
    plan, read = grids._format(spec, ["b"], None, None, 10)
    seen = []

    class Watched:
        def __init__(self, file):
            self.file = file

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            seen.append(n)
            return self.file.read(n)

    with ranges.opened(str(tmp_path / "g.bin")) as f:
        for p in plan(f, f.size(), 1 << 20):
            assert sum(b.num_rows for b in read(Watched(f), "x", p)) == 300
    assert sum(seen) == 3 * 100 * 4


@pytest.mark.parametrize("unlimited", ["time", None])
def test_netcdf_in_pieces(spark, tmp_path, unlimited):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6, 4, 5)).astype("f4")
    v[1, 2, 3] = -99
    variables = {"time": (["time"], np.arange(6.0), {}), "x": (["x"], np.arange(5.0) * 2, {}), "v": (["time", "y", "x"], v, {"_FillValue": np.float32(-99), "scale_factor": 2.0, "units": "K"}), "n": (["time"], np.arange(6, dtype="i2"), {}), "f": (["y", "x"], v[0].astype("f8"), {})}
    (tmp_path / "a.nc").write_bytes(netcdf.encode([("time", 6), ("y", 4), ("x", 5)], variables, {}, unlimited))
    path = str(tmp_path / "a.nc")
    whole = netcdf.decode(spark.read.format("binaryFile").load(path))
    for d in (netcdf.read_netcdf(spark, path), netcdf.read_netcdf(spark, path, rows_at_once=7, split=50)):
        assert rows(d) == rows(whole)
    assert netcdf.read_netcdf(spark, path, split=50).rdd.getNumPartitions() > 5
    assert rows(netcdf.read_netcdf(spark, path, ["n", "v"], split=80)) == rows(whole.filter("var IN ('n', 'v')"))


def test_large_headers_and_large_records(tmp_path, monkeypatch):
    monkeypatch.setattr(netcdf, "GAP", 8)
    a = np.arange(3 * 40, dtype="f8").reshape(3, 40)
    raw = netcdf.encode([("t", 3), ("x", 40)], {"a": (["t", "x"], a, {}), "b": (["t"], np.arange(3.0), {})}, {"text": "x" * 300_000}, "t")
    f = pa.BufferReader(raw)
    head = netcdf.header_of(f)
    assert netcdf.values_between(f, head, "a", 35, 95).tolist() == a.ravel()[35:95].tolist() and netcdf.values_between(f, head, "b", 1, 3).tolist() == [1.0, 2.0]
    with pytest.raises(ValueError):
        netcdf.header_of(pa.BufferReader(raw[:200]))


def test_paths_that_only_spark_opens(spark, tmp_path, monkeypatch):
    (tmp_path / "a.dat").write_bytes(observations.encode([[1.0] * 8] * 50))
    want = rows(observations.read_records(spark, str(tmp_path / "a.dat")))
    assert not ranges.can_open("viewfs://store/a.dat") and ranges.can_open("file:/a.dat")
    monkeypatch.setattr(ranges, "can_open", lambda path: False)
    assert rows(observations.read_records(spark, str(tmp_path / "a.dat"))) == want
