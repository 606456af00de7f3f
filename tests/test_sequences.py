"""Series in numbered files: steps counted on, a lookup over the edge of two files, and the problems that are found."""

import numpy as np
import pytest

from nimbogrid.operators import external
from nimbogrid.sources import netcdf


def write(folder, name, times, nx=2, var="q"):
    value = np.add.outer(10.0 * np.array(times), np.arange(nx))
    content = netcdf.encode([("time", len(times)), ("x", nx)], {"time": (("time",), np.array(times, float), {}), var: (("time", "x"), value, {})})
    (folder / name).write_bytes(content)


def read(spark, folder):
    return netcdf.read_netcdf(spark, f"file://{folder}")


def test_steps_go_on_through_files(spark, tmp_path):
    for n, times in enumerate(([0.0, 1.0, 2.0], [3.0], [5.0, 6.0])):
        write(tmp_path, f"out_{n:05d}.nc", times)
    values = read(spark, tmp_path)
    rows = external.sequence(values, "q", ["x"]).collect()
    assert sorted((r["file"], r["step"], r["step_in_file"], r["time"]) for r in rows if r["x"] == 1) == [(0, 0, 0, 0.0), (0, 1, 1, 1.0), (0, 2, 2, 2.0), (1, 3, 0, 3.0), (2, 4, 0, 5.0), (2, 5, 1, 6.0)]
    assert all(r["value"] == 10 * r["time"] + r["x"] for r in rows) and len(rows) == 12
    assert external.sequence_problems(values, "q", ["x"]).count() == 0
    x = external.External()
    x.register("q", external.Source(external.sequence(values, "q", ["x"]), "series", ["x"], "value", width=2.0))
    targets = spark.createDataFrame([(0, 2.5), (1, 4.0), (1, 6.5)], "x long, time double")
    assert {(r["x"], r["time"]): r["q"] for r in x.lookup(targets, "q").collect()} == {(0, 2.5): pytest.approx(25.0), (1, 4.0): pytest.approx(41.0), (1, 6.5): None}


def test_problems_are_told(spark, tmp_path):
    write(tmp_path, "out_00001.nc", [0.0, 1.0])  # 0 is missing
    write(tmp_path, "out_00002.nc", [0.5])  # begins before the end of 1
    write(tmp_path, "out_00003.nc", [1.0, 2.0], nx=3)  # size; same time as before is allowed
    write(tmp_path, "out_00004.nc", [3.0], var="other")  # without the variable
    write(tmp_path, "out_00005.nc", [4.0])
    write(tmp_path, "b_5.nc", [4.0])
    write(tmp_path, "last.nc", [9.0])
    values = read(spark, tmp_path)
    found = sorted((r["path"].rsplit("/", 1)[1], r["problem"]) for r in external.sequence_problems(values, "q", ["x"]).collect())
    first, second = ("b_5.nc", "out_00005.nc")
    assert found == sorted([("out_00001.nc", "missing"), ("out_00002.nc", "earlier"), ("out_00003.nc", "size"), (first, "missing"), (second, "repeated"), ("last.nc", "unnumbered")])
    assert external.sequence(values.limit(0), "q", ["x"]).count() == external.sequence_problems(values.limit(0), "q", ["x"]).count() == 0
