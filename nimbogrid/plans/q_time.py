"""Time averages, history, as-of interpolation, periodic series, calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reduce, timeops
from .registry import query
from .views import r, seconds_since, table, v_series


def _samples(spark, sf_dir):
    """Events as samples: t (s), hour interval, dt, and a value that one event in 17 lacks."""
    e = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', ts)") / F.lit(1e6)
    return e.select("event_id", "event_type", "ts", t.alias("_t"), (1 + F.col("user_id") % 3).cast("double").alias("dt"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"))


SAMPLES = """s AS (SELECT event_id, event_type, ts, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t, (1 + user_id % 3)::DOUBLE AS dt,
  CASE WHEN event_id % 17 <> 0 THEN value END AS value FROM events)"""


def _history(spark, sf_dir, op, skip):
    h = reduce.history(_samples(spark, sf_dir), F.floor(F.col("_t") / 21600), ["event_type"], "value", "dt", op, skip)
    return h.select("event_type", "interval", r("value", 4, 7).alias("value"))


for _op, _sql in (("mean", "sum(value * dt) / sum(CASE WHEN value IS NOT NULL THEN dt END)"), ("min", "min(value)"), ("max", "max(value)")):
    for _skip in (False, True):
        _name = f"history_{_op}_{'skip' if _skip else 'poison'}"
        _value = _sql if _skip else f"CASE WHEN count(value) = count(*) THEN {_sql} END"
        query(_name, f"WITH {SAMPLES} SELECT event_type, floor(t / 21600)::BIGINT AS interval, round(({_value})::DECIMAL(28, 7), 4)::DOUBLE AS value FROM s GROUP BY 1, 2")(
            lambda spark, sf_dir, op=_op, skip=_skip: _history(spark, sf_dir, op, skip)
        )


@query("history_last", f"WITH {SAMPLES} SELECT event_type, floor(t / 21600)::BIGINT AS interval, round(arg_max(value, (t, event_id)), 4) AS value FROM s WHERE value IS NOT NULL GROUP BY 1, 2")
def history_last(spark, sf_dir):
    s = _samples(spark, sf_dir).filter("value is not null").withColumn("_t2", F.floor(F.col("_t") / 21600)).withColumn("_t", F.struct("_t", "event_id"))
    return reduce.history(s, F.col("_t2"), ["event_type"], "value", "dt", "none", True).select("event_type", "interval", r("value").alias("value"))


@query(
    "time_average_number",
    """, s AS (SELECT row_number() OVER (ORDER BY day) AS step, CASE WHEN n % 5 <> 0 THEN total END AS total FROM v_series)
SELECT floor((step - 1) / 30.0)::BIGINT AS "group", round((coalesce(avg(total), 0))::DECIMAL(28, 7), 3)::DOUBLE AS total FROM s GROUP BY 1 HAVING max(step) = (floor((max(step) - 1) / 30.0) + 1) * 30""".lstrip(),
    "v_series",
)
def time_average_number(spark, sf_dir):
    s = timeops.row_numbers(v_series(spark, sf_dir), ["day"], F.year("day"), "step").withColumn("total", F.when(F.col("n") % 5 != 0, F.col("total")))
    return reduce.time_average(s, [], "step", "total", 30).select("group", r("total", 3, 7).alias("total"))


for _period in ("month", "year"):
    query(
        f"calendar_average_{_period}",
        f""", s AS (SELECT day, CASE WHEN n % 5 <> 0 THEN total END AS total FROM v_series)
SELECT date_trunc('{_period}', day)::DATE AS period, round((coalesce(avg(total), 0))::DECIMAL(28, 7), 3)::DOUBLE AS total FROM s GROUP BY 1""".lstrip(),
        "v_series",
    )(
        lambda spark, sf_dir, p=_period: reduce.calendar_average(v_series(spark, sf_dir).withColumn("total", F.when(F.col("n") % 5 != 0, F.col("total"))), [], "day", "total", p).select("period", r("total", 3, 7).alias("total"))
    )


@query(
    "asof_linear",
    """WITH src AS (SELECT event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t, avg(value) AS v FROM events GROUP BY 1, 2),
  seg AS (SELECT event_type, t, v, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM src WINDOW w AS (PARTITION BY event_type ORDER BY t)),
  tgt AS (SELECT event_type, h * 43200.0::DOUBLE AS t FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(range(-2, 64)) AS h))
  SELECT g.event_type, g.t, round(coalesce(e.v, s.v), 4) AS prev, round(coalesce(e.v, s.v2, f.v), 4) AS next, round(coalesce(e.v, CASE WHEN s.t2 IS NOT NULL THEN s.v + (g.t - s.t) / (s.t2 - s.t) * (s.v2 - s.v) END), 4) AS v
  FROM tgt g LEFT JOIN src e ON e.event_type = g.event_type AND e.t = g.t
  LEFT JOIN seg s ON e.t IS NULL AND s.event_type = g.event_type AND s.t < g.t AND (s.t2 > g.t OR s.t2 IS NULL)
  LEFT JOIN (SELECT event_type, min(t) AS t, arg_min(v, t) AS v FROM src GROUP BY 1) f ON f.event_type = g.event_type AND f.t > g.t""",
)
def asof_linear(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", seconds_since("ts", "2024-01-01").alias("t"), "value")
    src = e.groupBy("event_type", "t").agg(F.avg("value").alias("v"))
    tgt = e.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(-2), F.lit(63))).alias("h")).select("event_type", (F.col("h") * 43200.0).alias("t"))
    out = timeops.asof_linear(tgt, src, "t", "v", ["event_type"], width=86400.0)
    return out.select("event_type", "t", r("prev").alias("prev"), r("next").alias("next"), r("v").alias("v"))


@query(
    "periodic_series",
    """, p AS (SELECT (day + (y * 12) * INTERVAL 1 MONTH)::DATE AS day, total FROM v_series, (SELECT unnest([-1, 0, 1]) AS y))
SELECT year(day)::INT AS year, count(*) AS n, round((sum(total))::DECIMAL(28, 4), 1)::DOUBLE AS total FROM p GROUP BY 1""".lstrip(),
    "v_series",
)
def periodic_series(spark, sf_dir):
    p = timeops.periodic(v_series(spark, sf_dir), "day", [-1, 0, 1])
    return p.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("total"), 1, 4).alias("total"))


@query("scheduled_steps", "SELECT l_linenumber AS step, count(*) AS n FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY 1")
def scheduled_steps(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter(timeops.due(F.col("l_linenumber"), 3)).groupBy(F.col("l_linenumber").alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "calendar_parts",
    """SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::INT AS day_number, dayofyear(o_orderdate)::INT AS day_of_year, day(last_day(o_orderdate::DATE))::INT AS month_days,
  (year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0)) AS leap, (o_orderdate::DATE - DATE '1858-11-17')::INT AS mjd,
  ((year(o_orderdate) * 360 + (month(o_orderdate) - 1) * 30 + least(day(o_orderdate), 30) - 1))::INT AS day_360, strftime(o_orderdate, '%Y%m%d-%H%M%S') AS label FROM orders""",
)
def calendar_parts(spark, sf_dir):
    from ..functions import calendar as cal

    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    return o.select("o_orderkey", cal.day_number(d).alias("day_number"), cal.day_of_year(d).alias("day_of_year"), cal.month_days(d).alias("month_days"), cal.is_leap(d).alias("leap"), cal.modified_julian_day(d).alias("mjd"), cal.day_360(d).alias("day_360"), cal.label(d).alias("label"))


@query(
    "calendar_units",
    """WITH u AS (SELECT unnest(['msec', 'sec', 'min', 'hour', 'day', 'year?']) AS unit, unnest([2.0, 2.0, 2.0, 2.0, 2.0, 2.0])::DOUBLE AS n)
  SELECT unit, n * CASE unit WHEN 'msec' THEN 0.001 WHEN 'sec' THEN 1 WHEN 'min' THEN 60 WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 END AS seconds FROM u""",
)
def calendar_units(spark, sf_dir):
    from ..functions import calendar as cal

    u = spark.createDataFrame([(x, 2.0) for x in ("msec", "sec", "min", "hour", "day", "year?")], "unit string, n double")
    return u.select("unit", cal.to_seconds(F.col("n"), F.col("unit")).alias("seconds"))


@query(
    "utc_tai",
    """WITH leaps AS (SELECT unnest([DATE '1993-07-01', DATE '1994-07-01', DATE '1996-01-01', DATE '1997-07-01', DATE '1999-01-01', DATE '2006-01-01', DATE '2009-01-01', DATE '2012-07-01', DATE '2015-07-01', DATE '2017-01-01']) AS d)
  SELECT o_orderkey, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1993-01-01'))::DOUBLE / 1e6 + (SELECT count(*) FROM leaps WHERE d <= o_orderdate) AS tai93 FROM orders""",
)
def utc_tai(spark, sf_dir):
    from ..functions import calendar as cal

    return table(spark, sf_dir, "orders").select("o_orderkey", cal.utc_to_tai93(F.col("o_orderdate")).alias("tai93"))
