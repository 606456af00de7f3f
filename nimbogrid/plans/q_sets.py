"""Set operations on files of variables, comparison, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import setops
from .registry import query
from .views import r, table, v_cell


def _files(spark, sf_dir):
    """Two files of (var, step, value): events by type and hour of the first half and of the second half of the ids."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("var"), F.hour("ts").alias("step"), "value", "event_id")
    agg = lambda d: d.groupBy("var", "step").agg(F.sum("value").alias("value"))
    return agg(e.filter("event_id % 2 = 0")), agg(e.filter("event_id % 2 = 1"))


FILES = """WITH f AS (SELECT event_type AS var, hour(ts)::INT AS step, event_id % 2 AS file, sum(value) AS value FROM events GROUP BY 1, 2, 3) """


@query("file_concatenate", FILES + "SELECT var, (dense_rank() OVER (PARTITION BY var ORDER BY file, step))::INT AS step, round(value, 4) AS value FROM f")
def file_concatenate(spark, sf_dir):
    return setops.concatenate(_files(spark, sf_dir)).select("var", "step", r("value").alias("value"))


@query("file_select", FILES + "SELECT var, ((step - 3) // 2)::INT + 1 AS step, round(value, 4) AS value FROM f WHERE file = 0 AND var IN ('click', 'view') AND step BETWEEN 3 AND 15 AND (step - 3) % 2 = 0")
def file_select(spark, sf_dir):
    return setops.select_steps(_files(spark, sf_dir)[0], ["click", "view"], 3, 15, by=2).select("var", "step", r("value").alias("value"))


@query("file_difference", FILES + "SELECT a.var, a.step, round(a.value - b.value, 4) AS value FROM f a JOIN f b ON a.var = b.var AND a.step = b.step WHERE a.file = 0 AND b.file = 1")
def file_difference(spark, sf_dir):
    return setops.difference(*_files(spark, sf_dir), ["var", "step"], "value").select("var", "step", r("value").alias("value"))


@query(
    "file_compare",
    FILES + "SELECT coalesce(a.var, b.var) AS var, coalesce(a.step, b.step) AS step, round(abs(a.value - b.value), 3) AS diff FROM (SELECT * FROM f WHERE file = 0) a FULL JOIN (SELECT * FROM f WHERE file = 1 AND step <> 5) b ON a.var = b.var AND a.step = b.step WHERE a.value IS NULL OR b.value IS NULL OR abs(a.value - b.value) > 500",
)
def file_compare(spark, sf_dir):
    a, b = _files(spark, sf_dir)
    return setops.compare(a, b.filter("step != 5"), ["var", "step"], "value", 500.0).select("var", "step", r(F.abs(F.col("value") - F.col("other")), 3).alias("diff"))


@query("file_catalogue", FILES + "SELECT var, count(*) AS n, min(step) AS first, max(step) AS last FROM f WHERE file = 0 GROUP BY var")
def file_catalogue(spark, sf_dir):
    return setops.catalogue(_files(spark, sf_dir)[0])


@query("coordinate_check", "SELECT k, round(max(CASE WHEN abs(vr) < 1e-10 THEN abs(vr * 1.01 - vr) ELSE 2 * abs(vr * 1.01 - vr) / abs(vr * 1.01 + vr) END), 8) AS worst FROM v_cell GROUP BY k", "v_cell")
def coordinate_check(spark, sf_dir):
    v = F.col("vr")
    return v_cell(spark, sf_dir).groupBy("k").agg(r(F.max(setops.relative_difference(v * 1.01, v)), 8).alias("worst"))


@query(
    "range_validation",
    """SELECT 'z' AS var, count(*) FILTER (z NOT BETWEEN 1000 AND 50000) AS n_bad, min(z) AS least, max(z) AS most FROM v_cell
UNION ALL SELECT 'vr', count(*) FILTER (vr NOT BETWEEN 2 AND 49), min(vr), max(vr) FROM v_cell""",
    "v_cell",
)
def range_validation(spark, sf_dir):
    return setops.out_of_range(v_cell(spark, sf_dir), {"z": (1000.0, 50000.0), "vr": (2.0, 49.0)})


@query(
    "retile",
    ", g AS (SELECT i, j, round(avg(z), 4) AS z FROM v_cell GROUP BY i, j) SELECT i, j, z, ((j // 8) * 1000 + i // 5)::BIGINT AS tile FROM g".lstrip(),
    "v_cell",
)
def retile(spark, sf_dir):
    """Two overlapping tiles of a field, merged and laid out anew."""
    g = v_cell(spark, sf_dir).groupBy("i", "j").agg(r(F.avg("z")).alias("z"))
    return setops.retile(g.filter("i < 12").unionByName(g.filter("i >= 8")), [], "i", "j", 5, 8)


@query(
    "nesting_blend",
    """, g AS (SELECT i, j, avg(z) AS c, avg(vr) * 1000 AS p FROM v_cell GROUP BY i, j), w AS (SELECT *, greatest(0, least(1, (4 - least(i, 19 - i)) / 4.0::DOUBLE), least(1, (4 - least(j, 19 - j)) / 4.0::DOUBLE)) AS a FROM g)
SELECT i, j, round(((1 - a) * c + a * p)::DECIMAL(28, 7), 4)::DOUBLE AS z FROM w""".lstrip(),
    "v_cell",
)
def nesting_blend(spark, sf_dir):
    g = v_cell(spark, sf_dir).groupBy("i", "j").agg(F.avg("z").alias("c"), (F.avg("vr") * 1000).alias("p"))
    ramp = lambda c: F.least(F.lit(1.0), (4 - F.least(F.col(c), 19 - F.col(c))) / 4)
    return g.select("i", "j", r(setops.blend(F.col("c"), F.col("p"), F.greatest(F.lit(0.0), ramp("i"), ramp("j"))), 4, 7).alias("z"))


@query("unpivot_levels", "SELECT var, count(*) AS n, round(sum(value), 1) AS total FROM (SELECT unnest(['z', 'vr', 'err']) AS var, unnest([z, vr, CASE WHEN err > 0.02 THEN err END]) AS value FROM v_cell) WHERE value IS NOT NULL GROUP BY var", "v_cell")
def unpivot_levels(spark, sf_dir):
    c = v_cell(spark, sf_dir).withColumn("err", F.when(F.col("err") > 0.02, F.col("err")))
    return setops.unpivot(c, ["i"], ["z", "vr", "err"]).groupBy("var").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 1).alias("total"))


@query("sort_limit", "SELECT okey, z FROM v_cell ORDER BY z DESC, okey LIMIT 25", "v_cell")
def sort_limit(spark, sf_dir):
    """Partial sort: the greatest 25 values."""
    return v_cell(spark, sf_dir).select("okey", "z").orderBy(F.col("z").desc(), "okey").limit(25)


@query(
    "bucket_offsets",
    ", b AS (SELECT i, j, count(*) AS n FROM v_cell GROUP BY i, j) SELECT i, j, n, (coalesce(sum(n) OVER (ORDER BY j, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM b".lstrip(),
    "v_cell",
)
def bucket_offsets(spark, sf_dir):
    """Counts of buckets and their offsets in a counting sort."""
    from pyspark.sql import Window

    b = v_cell(spark, sf_dir).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("j", "i").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket of the mesh
    return b.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))
