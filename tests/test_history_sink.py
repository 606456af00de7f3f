"""The history sink: batch against a walk through the steps, streams against batch, restarts."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from nimbogrid.streaming import history as st
from nimbogrid.streaming import history_sink as hs

ITEMS = [hs.Item("v", 4, "mean", "a"), hs.Item("v", 3, "min", "b"), hs.Item("u", 5, "max", "c"), hs.Item("u", 2, "none", "d"), hs.Item("v", 1, "mean", "e")]


def walk(samples, items, sink, keys):
    """Every step of the run in turn: put what is there, then write what is due."""
    out = []
    for key in keys:
        for q in items:
            put = written = 1 - q.every if sink.step0 else 1
            held, empty, switched, file = [], True, 0, 0
            for step in range(1, sink.last + 1):
                if (key, step) in samples and not (q.op == "none" and step == put):
                    held = [] if empty else held
                    held.append((step - put, samples[key, step][q.variable]))
                    put, empty = step, False
                if step >= written + q.every:
                    if empty and sink.fail_unput and step > 1:
                        raise ValueError
                    values = [v for _, v in held]
                    if empty or step == 1 and q.op != "none" or q.op != "none" and None in values:
                        value = None
                    elif q.op == "mean":
                        value = sum(w * v for w, v in held) / sum(w for w, _ in held) if any(w for w, _ in held) else None
                    else:
                        value = {"min": min, "max": max, "none": lambda x: x[-1]}[q.op](values)
                    if step > sink.wait:
                        out.append((key, q.name, step, (written - 1) * sink.seconds, (step - 1) * sink.seconds, None if value is None else round(value, 9), file))
                    written, empty = step, True
                if sink.switch is not None and step - switched > sink.switch:
                    switched, file = step - 1, file + 1
    return sorted(map(str, out))


def data(seed, last, gaps):
    rng = random.Random(seed)
    return {(k, s): {"v": rng.choice([None, *[rng.uniform(-5, 5)] * 9]), "u": float(rng.randrange(50))} for k in "xyz" for s in range(1, last + 4) if rng.random() > gaps}


def rows(d):
    return sorted(str((r["key"], r["name"], r["step"], r["start"], r["end"], None if r["value"] is None else round(r["value"], 9), r["file"])) for r in d.collect())


SINKS = [hs.Sink(40, 10.0, fail_unput=False), hs.Sink(37, 0.5, wait=9, switch=6, step0=True, fail_unput=False), hs.Sink(31, 1.0, wait=3, switch=0, fail_unput=False), hs.Sink(30, 1.0, switch=1, step0=True, fail_unput=False), hs.Sink(3, fail_unput=False)]


@pytest.mark.parametrize("sink", SINKS)
@pytest.mark.parametrize("gaps", [0.0, 0.7])
def test_batch_walks_the_steps(spark, sink, gaps):
    held = data(1, sink.last, gaps)
    d = spark.createDataFrame([(k, s, x["v"], x["u"]) for (k, s), x in held.items()], "key string, step int, v double, u double").repartition(5)
    keys = {k for k, s in held if s <= sink.last}
    got = rows(hs.history_rows(d, ITEMS, sink, ["key"]))
    assert got == walk(held, ITEMS, sink, keys) and got


def test_unput_is_an_error_if_asked(spark):
    d = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0), ("x", 7, 3.0)], "key string, step int, v double")
    whole = hs.history_rows(d, [hs.Item("v", 6)], hs.Sink(8), ["key"])
    assert [r["step"] for r in whole.collect()] == [7]
    with pytest.raises(Exception, match="nothing was put"):
        hs.history_rows(d, [hs.Item("v", 2)], hs.Sink(8), ["key"]).collect()
    with pytest.raises(ValueError):
        hs.history_rows(d, [hs.Item("v", 2, "median")], hs.Sink(8), ["key"])


def stream_of(spark, folder):
    s = spark.readStream.schema("key string, step long, v double, u double, ts timestamp").parquet(str(folder))
    return s


@pytest.mark.parametrize("sink", SINKS[:3])
def test_stream_and_restart_give_the_rows_of_the_batch(spark, tmp_path, sink):
    """Three runs, each stopped and restarted from the checkpoint, with gaps that only timers close."""
    held = data(2, sink.last, 0.6)
    start = pd.Timestamp("2024-01-01", tz="UTC")
    table = spark.createDataFrame([(k, s, x["v"], x["u"], (start + pd.Timedelta(seconds=(s - 1) * sink.seconds)).to_pydatetime()) for (k, s), x in held.items()], "key string, step long, v double, u double, ts timestamp").cache()
    want = rows(hs.history_rows(table, ITEMS, sink, ["key"]))
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for n, (a, b) in enumerate([(0, 13), (13, 25), (25, 99)]):
        table.filter((F.col("step") > a) & (F.col("step") <= b)).coalesce(1).write.mode("append").parquet(folder)
        if n == 2:
            end = start + pd.Timedelta(seconds=sink.last * sink.seconds + 60)
            spark.createDataFrame([(None, None, None, None, end.to_pydatetime())], table.schema).write.mode("append").parquet(folder)
        st.run_to_end(hs.history_rows_stream(stream_of(spark, folder), ITEMS, sink, ["key"], "step", "ts", "2024-01-01"), out, state)
    assert rows(spark.read.parquet(out)) == want and want


def test_files_of_the_sink(spark, tmp_path):
    d = spark.createDataFrame([("x", s, float(s)) for s in range(1, 21)], "key string, step int, v double")
    hs.write_history(hs.history_rows(d, [hs.Item("v", 2)], hs.Sink(20, switch=8), ["key"]), str(tmp_path / "h"))
    back = spark.read.parquet(str(tmp_path / "h"))
    assert sorted((r["file"], r["step"]) for r in back.collect()) == [(0, 3), (0, 5), (0, 7), (0, 9), (1, 11), (1, 13), (1, 15), (1, 17), (2, 19)]
