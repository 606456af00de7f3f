"""Streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.workdir import new_folder
from ..streaming import history as st
from ..streaming import history_sink as hs
from .registry import query
from .views import r


@query(
    "streaming_history",
    """WITH s AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS start, ts, (1 + user_id % 3)::DOUBLE AS dt, CASE WHEN event_id % 17 <> 0 THEN value END AS value FROM events)
SELECT event_type, epoch(start)::BIGINT AS start, round((sum(value * dt) / sum(CASE WHEN value IS NOT NULL THEN dt END))::DECIMAL(28, 7), 4)::DOUBLE AS mean, min(value) AS least, max(value) AS most, count(value) AS n FROM s
GROUP BY event_type, start""",
)
def streaming_history(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).parquet(f"{path}*")  # a pattern: a stream takes a folder or a pattern
    s = s.select("event_type", F.to_timestamp_ltz(F.col("ts").cast("string")).alias("ts"), (1 + F.col("user_id") % 3).cast("double").alias("dt"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"))
    folder = new_folder(spark)
    s = s.unionByName(st.closing(spark, f"{folder}/end", s, "ts", "2262-01-01"))
    st.run_to_end(st.history_stream(s, "ts", "6 hours", "0 seconds", ["event_type"], "value", "dt"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").filter("event_type IS NOT NULL").select("event_type", F.unix_seconds("start").alias("start"), r("mean", 4, 7).alias("mean"), "least", "most", "n")


HOUR, DAYS = 3600 * 10**6, 30
#: Steps of a microsecond over thirty days.
ITEMS = [hs.Item("v", 6 * HOUR, "mean", "mean6"), hs.Item("v", 5 * HOUR, "min", "min5"), hs.Item("v", 24 * HOUR, "max", "max24"), hs.Item("v", HOUR, "none", "last1")]
SINK = hs.Sink(last=DAYS * 24 * HOUR + 1, seconds=1e-6, wait=30 * HOUR, switch=48 * HOUR, fail_unput=False)
START = hs.Sink(last=DAYS * 24 * HOUR + 1, seconds=1e-6, step0=True, fail_unput=False)


def _sink_sql(sink: hs.Sink) -> str:
    items = ", ".join(f"('{q.name}', '{q.op}', {q.every})" for q in ITEMS)
    least, first = (0, "1 - every") if sink.step0 else (1, "1")
    file = f"greatest(0, (at_step - 2 + {sink.switch}) // {sink.switch} - 1)" if sink.switch else "0"
    return f"""WITH s AS (SELECT event_type, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') + 1 AS step, CASE WHEN event_id % 97 <> 0 THEN value END AS v FROM events),
q(name, op, every) AS (VALUES {items}),
x AS (SELECT s.*, name, op, every, step - coalesce(lag(step) OVER (PARTITION BY event_type, name ORDER BY step), {first}) AS dt, greatest({least}, (step - 2 + every) // every) AS k FROM s, q),
a AS (SELECT event_type, name, k, count(*) AS n, count(v) AS nv, sum(v * dt) / sum(dt) AS mean, min(v) AS least, max(v) AS most, list(v ORDER BY step)[-1] AS last FROM x WHERE op <> 'none' OR step > {1 - least} GROUP BY ALL),
g AS (SELECT t.event_type, q.*, unnest(range({least}, {sink.last - 1} // every + 1)) AS k FROM (SELECT DISTINCT event_type FROM s) t, q),
w AS (SELECT g.*, 1 + g.k * every AS at_step, CASE WHEN op = 'none' THEN last WHEN g.k = 0 OR nv < n THEN NULL WHEN op = 'mean' THEN mean WHEN op = 'min' THEN least ELSE most END AS value
  FROM g LEFT JOIN a ON a.event_type = g.event_type AND a.name = g.name AND a.k = g.k)
SELECT event_type, name, at_step::BIGINT AS step, round((k - 1) * every * 1e-6, 0)::BIGINT AS start, round(k * every * 1e-6, 0)::BIGINT AS "end", round(value::DECIMAL(28, 7), 4)::DOUBLE AS value, ({file})::BIGINT AS file FROM w WHERE at_step > {sink.wait}"""


def _written(rows):
    return rows.select("event_type", "name", "step", F.round("start").cast("long").alias("start"), F.round("end").cast("long").alias("end"), r("value", 4, 7).alias("value"), "file")


def _steps(events):
    ts = F.to_timestamp_ltz(F.col("ts").cast("string"))
    step = F.unix_micros(ts) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + 1
    return events.select("event_type", ts.alias("ts"), step.alias("step"), F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("v"))


@query("history_sink", _sink_sql(SINK))
def history_sink(spark, sf_dir):
    """Requests with a wait and files of two days."""
    return _written(hs.history_rows(_steps(spark.read.parquet(f"{sf_dir}/events.parquet")), ITEMS, SINK, ["event_type"]))


@query("history_sink_step0", _sink_sql(START))
def history_sink_step0(spark, sf_dir):
    """Requests that are written at the initial step too."""
    return _written(hs.history_rows(_steps(spark.read.parquet(f"{sf_dir}/events.parquet")), ITEMS, START, ["event_type"]))


@query("history_sink_stream", _sink_sql(SINK))
def history_sink_stream(spark, sf_dir):
    """The same by state and timers."""
    path = f"{sf_dir}/events.parquet"
    s = _steps(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"))
    folder = new_folder(spark)
    s = s.unionByName(st.closing(spark, f"{folder}/end", s, "ts", "2024-01-31 00:00:01"))
    st.run_to_end(hs.history_rows_stream(s, ITEMS, SINK, ["event_type"], "step", "ts", "2024-01-01"), f"{folder}/out", f"{folder}/state")
    return _written(spark.read.parquet(f"{folder}/out"))
