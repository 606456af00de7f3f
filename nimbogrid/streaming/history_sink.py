"""The history sink: requested statistics of each interval, with a wait, file switches, an initial step and a policy for steps that were never put.

Steps are numbered from 1, the initial time; a request has an interval of ``every`` steps and is written at steps 1 + every, 1 + 2 * every and so on to the end of the run, and with
``step0`` at step 1 too. A sample at a step counts with the time since the sample before it (of its key, in whatever interval). The step at the end of an interval belongs to it. A
missing value makes its interval missing. What is written at steps up to ``wait`` is left out. Files change after every ``switch`` steps. An interval in which
nothing was put is missing, or with ``fail_unput`` an error. At step 1 only the last value (``none``) is written; statistics have had no interval and are missing.

:func:`history_rows` is the batch form: windows over slices of a key's samples for the time between them, one aggregation, and a left join with the steps that are to be
written. :func:`history_rows_stream` gives the same rows of a stream: a key's accumulators are its state, and event-time timers close
intervals that no further sample closes. Keys have one sample a step; a second one has no weight.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Item:
    """A requested output: a variable (a column) under a name, every so many steps; op is mean, min, max or none (the last value)."""

    variable: str
    every: int
    op: str = "mean"
    name: str | None = None


@dataclass(frozen=True)
class Sink:
    """last: the last step of the run; seconds: length of a step; wait and switch in steps."""

    last: int
    seconds: float = 1.0
    wait: int = 0
    switch: int | None = None
    step0: bool = False
    fail_unput: bool = True

    def first_put(self, every):
        """The step from which the time of the first sample counts."""
        return 1 - every if self.step0 else 1 + 0 * every

    def file_of(self, step):
        """Number of the file, from 0, that holds what is written at a step."""
        if self.switch is None:
            return 0 * step
        n = max(1, self.switch)
        # Without steps between, every step has a file of its own.
        return (step - 1) if self.switch == 0 else (step - 2 + n) // n - 1


UNPUT = "nothing was put in an interval that is to be written"


def _requested(samples: DataFrame, items: Sequence[Item], keep: Sequence[str]) -> DataFrame:
    """A row for each sample and item."""
    for q in items:
        if q.op not in ("mean", "min", "max", "none") or q.every < 1:
            raise ValueError(f"no such request: {q}")
    rows = F.array(*[F.struct(F.lit(q.name or q.variable).alias("name"), F.lit(q.op).alias("op"), F.lit(int(q.every)).cast("long").alias("every"), F.col(q.variable).cast("double").alias("v")) for q in items])
    return samples.select(*keep, F.explode(rows).alias("q")).select(*keep, "q.*")


def _file(sink: Sink, step: Column) -> Column:
    if sink.switch is None:
        return F.lit(0).cast("long")
    if sink.switch == 0:
        return step - 1
    return F.greatest(F.lit(0), F.floor((step - 2 + sink.switch) / F.lit(sink.switch)) - 1).cast("long")


#: Slices that the run is divided into: a key's samples of one slice are one window.
SLICES = 4096


def _with_last(samples: DataFrame, sink: Sink, keys: Sequence[str]) -> DataFrame:
    """samples with the step ``_last`` of the sample before each, of its key: the same for all items, so it is found before they are laid out.

    Only the table of slices, SLICES rows a key, is one window by key; it gives each slice the last step before it.
    """
    d = samples.withColumn("_slice", F.floor(F.col("_s") / max(1, sink.last // SLICES)))
    ends = d.groupBy(*keys, "_slice").agg(F.max("_s").alias("_end")).withColumn("_end", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_slice")))
    # Samples of a null key are kept.
    ends = ends.select(F.struct(*keys, "_slice").alias("_key"), "_end")
    inside = d.withColumn("_last", F.lag("_s").over(Window.partitionBy(*keys, "_slice").orderBy("_s"))).withColumn("_key", F.struct(*keys, "_slice"))
    return inside.join(ends, inside["_key"].eqNullSafe(ends["_key"])).withColumn("_last", F.coalesce("_last", "_end")).drop("_key", "_slice", "_end")


def history_rows(samples: DataFrame, items: Sequence[Item], sink: Sink, keys: Sequence[str], step: str = "step") -> DataFrame:
    """keys, name, step, start, end (seconds from the initial time), value, file of all that is written."""
    by = [*keys, "name", "op", "every"]
    rows = _requested(_with_last(samples.filter(F.col(step) <= sink.last).withColumn("_s", F.col(step).cast("long")), sink, keys), items, [*keys, "_s", "_last"])
    least = 0 if sink.step0 else 1
    # With no initial output the first step has no time before it: it has no weight, and is no last value.
    rows = rows.withColumn("dt", F.col("_s") - F.coalesce("_last", F.lit(1) - F.col("every") if sink.step0 else F.lit(1)))
    if not sink.step0:
        rows = rows.filter((F.col("op") != "none") | (F.col("_s") > 1))
    k = F.greatest(F.lit(least), F.expr("(_s - 2 + every) div every"))
    v = F.col("v")
    whole = F.count("v") == F.count(F.lit(1))
    found = rows.groupBy(*by, k.alias("k")).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.first("op") == "none", F.max(F.struct("_s", "v"))["v"]).when(whole, F.when(F.first("op") == "min", F.min(v)).when(F.first("op") == "max", F.max(v)).otherwise(F.try_divide(F.sum(v * F.col("dt")), F.sum("dt")))).alias("value"),
    )
    grid = rows.select(*by).distinct().withColumn("k", F.explode(F.expr(f"CASE WHEN ({sink.last} - 1) div every >= {least} THEN sequence({least}L, ({sink.last}L - 1) div every) END")))
    at = 1 + F.col("k") * F.col("every")
    none = F.col("n").isNull()
    value = F.when((at == 1) & (F.col("op") != "none"), None).otherwise(F.col("value"))
    if sink.fail_unput:
        value = F.when(none & (at > 1), F.raise_error(F.lit(UNPUT)).cast("double")).otherwise(value)
    second = lambda n: (F.col("k") - n) * F.col("every") * F.lit(float(sink.seconds))
    out = grid.join(found, [*by, "k"], "left").select(*keys, "name", at.alias("step"), second(1).alias("start"), second(0).alias("end"), value.alias("value"), _file(sink, at).alias("file"))
    return out.filter(F.col("step") > sink.wait)


STATE = "put long, written long, total double, time double, value double, missing boolean, empty boolean"


def _put(s: list, op: str, step: int, v: float | None) -> list:
    put, written, total, time, value, missing, empty = s
    if op == "none" and step == put:
        return s
    if empty:
        total, time, value, missing = 0.0, 0.0, None, False
    dt = step - put
    if op == "none":
        value, missing = v, v is None
    elif v is None:
        missing = True
    elif op == "mean":
        total += v * dt
    else:
        value = v if value is None else (min if op == "min" else max)(value, v)
    return [step, written, total, time + dt, value, missing, False]


def _written(s: list, op: str, at: int, sink: Sink) -> float | None:
    _, _, total, time, value, missing, empty = s
    if empty:
        if sink.fail_unput and at > 1:
            raise ValueError(UNPUT)
        return None
    if missing or at == 1 and op != "none":
        return None
    if op == "mean":
        return total / time if time else None
    return value


#: Samples that are Python objects at a time.
CHUNK = 100_000


def _numbers(batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """Steps, in order, and values of a key's batches, 16 bytes a sample: keys, names and times are let go with each batch."""
    steps, values = [np.empty(0, np.int64)], [np.empty(0)]
    for pdf in batches:
        known = pdf["_s"].notna().to_numpy()
        steps.append(pdf["_s"].to_numpy()[known].astype(np.int64))
        values.append(pdf["v"].to_numpy(float, na_value=np.nan)[known])
    steps, values = np.concatenate(steps), np.concatenate(values)
    order = np.argsort(steps, kind="stable")
    return steps[order], values[order]


def history_rows_stream(samples: DataFrame, items: Sequence[Item], sink: Sink, keys: Sequence[str], step: str, ts: str, start: str, delay: str = "0 seconds") -> DataFrame:
    """The rows of :func:`history_rows` of a stream. ts: the time of a sample, that of step 1 being ``start`` (UTC); later ones than ``delay`` are dropped.

    The stream's last intervals are written when its time has reached the end of the run (see ``history.closing``). Rows without a step only move time on.
    """
    kinds = dict(samples.dtypes)
    origin = int(pd.Timestamp(start, tz="UTC").value // 1000)
    micros = round(sink.seconds * 1e6)
    columns = [*keys, "name", "step", "start", "end", "value", "file"]
    rows = _requested(samples.withColumn("_s", F.col(step).cast("long")).withWatermark(ts, delay), items, [*keys, "_s", ts])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *own, name, op, every = key
        every = int(every)
        out: list[tuple] = []
        s = list(state.get) if state.exists else [int(sink.first_put(every)), int(sink.first_put(every)), 0.0, 0.0, None, False, True]

        def close(upto: int) -> None:
            """Writes all that is due at steps up to this one."""
            while s[1] + every <= min(upto, sink.last):
                at = s[1] + every
                value = _written(s, op, at, sink)
                if at > sink.wait:
                    out.append((*own, name, at, (s[1] - 1) * sink.seconds, (at - 1) * sink.seconds, value, int(sink.file_of(at))))
                s[1], s[6] = at, True

        watermark = state.getCurrentWatermarkMs() * 1000
        if state.hasTimedOut:
            close((watermark - origin) // micros + 1)
        else:
            steps, values = _numbers(batches)
            for a in range(0, len(steps), CHUNK):  # Python objects of a part at a time
                for at, v in zip(steps[a : a + CHUNK].tolist(), values[a : a + CHUNK].tolist(), strict=True):
                    if at <= sink.last:
                        close(at - 1)
                        s[:] = _put(s, op, at, None if v != v else v)
            if not len(steps) and not state.exists:
                return
        if s[1] + every <= sink.last:
            state.update(tuple(s))
            due = (origin + (s[1] + every - 1) * micros - 1) // 1000
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, due))
        elif state.exists:
            state.remove()
        if out:
            frame = pd.DataFrame(out, columns=columns)
            frame["value"] = frame["value"].astype(object).where(frame["value"].notna(), None)
            yield frame

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", name string, step long, start double, end double, value double, file long"
    return rows.groupBy(*keys, "name", "op", "every").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def write_history(rows: DataFrame, path: str) -> None:
    """One folder per file of the sink, sorted by name and step inside; a rerun replaces them all."""
    rows.sortWithinPartitions("name", "step").write.mode("overwrite").partitionBy("file").parquet(path)
