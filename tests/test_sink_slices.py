"""The history sink's windows hold a slice of a key's samples, and its stream the samples' numbers only."""

import tracemalloc

import numpy as np
import pandas as pd

from nimbogrid.streaming import history_sink as hs


def test_windows_hold_slices(spark, monkeypatch):
    rows = [(k, s, float(s % 7)) for k in ("a", "b") for s in (1, 4, 5, 5000, 90000, 90001, 300000)]
    d = spark.createDataFrame(rows, "g string, step long, v double")
    sink, items = hs.Sink(last=400001, fail_unput=False), [hs.Item("v", 100000, "mean", "m"), hs.Item("v", 200000, "none", "n")]
    out = hs.history_rows(d, items, sink, ["g"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(_s" in plan and "[g#" in plan
    # Each window over samples is by slice: none is by key and item alone.
    assert not [line for line in plan.splitlines() if "lag(_s" in line and "_slice" not in line]
    got = {(r["g"], r["name"], r["step"]): r["value"] for r in out.collect()}
    steps = [s for _, s, _ in rows[:7]]
    first = [(s % 7, s - b) for b, s in zip([1, *steps[:-1]], steps, strict=False) if s <= 100001]
    for g in "ab":
        assert abs(got[g, "m", 100001] - sum(v * t for v, t in first) / sum(t for _, t in first)) < 1e-9
        assert got[g, "m", 200001] is None and got[g, "m", 300001] == 300000 % 7 and got[g, "n", 200001] == 90001 % 7


def test_stream_keeps_numbers():
    def batches():
        for n in range(40):
            yield pd.DataFrame({"g": [f"key {n} {k}" for k in range(10000)], "_s": np.arange(10000)[::-1] + n * 10000, "v": np.where(np.arange(10000) % 3 == 0, None, 1.0).astype(object)})

    tracemalloc.start()
    steps, values = hs._numbers(batches())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (steps == np.arange(400000)).all() and np.isnan(values).sum() == 40 * 3334
    assert peak < 400000 * 80
