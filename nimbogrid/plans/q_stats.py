"""Weighted, pairwise and level statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from .registry import query
from .views import r, table, v_cell, v_series

#: One z in 13 and one vr in 7 are taken as missing.
MISSING = """, c AS (SELECT i, j, k, ts, okey, err, tax, CASE WHEN okey % 13 <> 0 THEN z END AS z, CASE WHEN okey % 7 <> 0 THEN vr END AS vr FROM v_cell) """.lstrip()


def holed(spark, sf_dir):
    c = v_cell(spark, sf_dir)
    return c.withColumn("z", F.when(F.col("okey") % 13 != 0, F.col("z"))).withColumn("vr", F.when(F.col("okey") % 7 != 0, F.col("vr")))


@query("global_total_mean", "SELECT round(sum(z * (1 + err)), 2) AS total, round(sum(z * (1 + err)) / sum(1 + err), 4) AS mean FROM v_cell", "v_cell")
def global_total_mean(spark, sf_dir):
    a = 1 + F.col("err")
    return v_cell(spark, sf_dir).agg(r(F.sum(F.col("z") * a), 2).alias("total"), r(F.sum(F.col("z") * a) / F.sum(a)).alias("mean"))


@query(
    "level_mean_min_max",
    MISSING + "SELECT k, round(sum(z * (1 + err)) / sum(CASE WHEN z IS NOT NULL THEN 1 + err END), 4) AS mean, min(z) AS least, max(z) AS most FROM c GROUP BY k",
    "v_cell",
)
def level_mean_min_max(spark, sf_dir):
    c = holed(spark, sf_dir).withColumn("area", 1 + F.col("err"))
    return stats.level_means(c, "z", "area").select("k", r("mean").alias("mean"), "least", "most")


@query(
    "extreme_with_place",
    """SELECT * FROM (SELECT 'max' AS what, z, k, j, i, okey FROM v_cell ORDER BY z DESC, k, j, i, okey LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'min' AS what, z, k, j, i, okey FROM v_cell ORDER BY z, k, j, i, okey LIMIT 1)""",
    "v_cell",
)
def extreme_with_place(spark, sf_dir):
    c, place = v_cell(spark, sf_dir), ["k", "j", "i", "okey"]
    hi, lo = stats.extreme_at(c, "z", place), stats.extreme_at(c, "z", place, largest=False)
    return hi.select(F.lit("max").alias("what"), "*").unionByName(lo.select(F.lit("min").alias("what"), "*"))


@query("extreme_by_level", "SELECT k, z, j, i FROM (SELECT k, z, j, i, row_number() OVER (PARTITION BY k ORDER BY z DESC, j, i) AS n FROM v_cell) WHERE n = 1", "v_cell")
def extreme_by_level(spark, sf_dir):
    return stats.extreme_at(v_cell(spark, sf_dir), "z", ["j", "i"], ["k"]).select("k", "z", "j", "i")


@query(
    "moments",
    MISSING + "SELECT i, count(z) AS n, round(sum(z), 2) AS total, round(avg(z), 4) AS mean, round(var_samp(z), 0) AS variance, round(stddev_samp(z), 3) AS deviation FROM c GROUP BY i",
    "v_cell",
)
def moments(spark, sf_dir):
    g = holed(spark, sf_dir).groupBy("i")
    return g.agg(F.count("z").alias("n"), r(F.sum("z"), 2).alias("total"), r(F.avg("z")).alias("mean"), r(F.var_samp("z"), 0).alias("variance"), r(F.stddev_samp("z"), 3).alias("deviation"))


@query(
    "pair_statistics",
    MISSING
    + """SELECT j, count(*) FILTER (z IS NOT NULL AND vr IS NOT NULL) AS n, round(covar_samp(z, vr), 2) AS cov,
  round(covar_samp(z, vr) / (stddev_samp(z) * stddev_samp(vr)), 6) AS corr, round(covar_samp(z, vr) / (stddev_samp(z) * stddev_samp(vr)) * stddev_samp(z) / stddev_samp(vr), 3) AS slope FROM c GROUP BY j""",
    "v_cell",
)
def pair_statistics(spark, sf_dir):
    z, v = F.col("z"), F.col("vr")
    return holed(spark, sf_dir).groupBy("j").agg(
        stats.pair_count(z, v).alias("n"), r(stats.covariance(z, v), 2).alias("cov"), r(stats.correlation(z, v), 6).alias("corr"), r(stats.regression(z, v), 3).alias("slope")
    )


@query(
    "partial_correlation",
    """, p AS (SELECT k, covar_samp(z, vr) / (stddev_samp(z) * stddev_samp(vr)) AS a, covar_samp(z, tax) / (stddev_samp(z) * stddev_samp(tax)) AS b,
  covar_samp(vr, tax) / (stddev_samp(vr) * stddev_samp(tax)) AS c FROM v_cell GROUP BY k)
SELECT k, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS partial FROM p""".lstrip(),
    "v_cell",
)
def partial_correlation(spark, sf_dir):
    z, v, t = (F.col(c) for c in ("z", "vr", "tax"))
    p = v_cell(spark, sf_dir).groupBy("k").agg(stats.correlation(z, v).alias("a"), stats.correlation(z, t).alias("b"), stats.correlation(v, t).alias("c"))
    return p.select("k", r(stats.partial_correlation(F.col("a"), F.col("b"), F.col("c")), 6).alias("partial"))


@query(
    "lag_correlation",
    """, s AS (SELECT total, lead(n, 3) OVER (ORDER BY day) AS y FROM v_series)
SELECT count(y) AS n, round(covar_samp(total, y) / (stddev_samp(total) * stddev_samp(y)), 6) AS corr FROM s""".lstrip(),
    "v_series",
)
def lag_correlation(spark, sf_dir):
    s = stats.with_lag(v_series(spark, sf_dir), "day", "n", 3, bucket=F.year("day"))
    return s.agg(F.count("lagged").alias("n"), r(stats.correlation(F.col("total"), F.col("lagged")), 6).alias("corr"))


@query(
    "monitor_modes",
    """, s AS (SELECT day, total, row_number() OVER (ORDER BY day) AS nth, first_value(total) OVER (ORDER BY day) AS f FROM v_series)
SELECT day, round(total - f, 2) AS deviation, round((sum(CASE WHEN nth > 1 THEN total * 0.5 ELSE 0 END) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING))::DECIMAL(28, 4), 1)::DOUBLE AS integral FROM s""".lstrip(),
    "v_series",
)
def monitor_modes(spark, sf_dir):
    m = stats.monitor_modes(v_series(spark, sf_dir), "day", "total", F.lit(0.5), bucket=F.year("day"))
    return m.select("day", r("deviation", 2).alias("deviation"), r("integral", 1, 4).alias("integral"))


@query("vector_norms", "SELECT k, round(sqrt(sum(z * z)), 2) AS l2, round(sqrt(avg(vr * vr)), 5) AS rms, round(sum((z-30000)*(vr*1000-30000)) / sqrt(sum((z-30000)*(z-30000)) * sum((vr*1000-30000)*(vr*1000-30000))), 6) AS acc FROM v_cell GROUP BY k", "v_cell")
def vector_norms(spark, sf_dir):
    acc = stats.anomaly_correlation(F.col("z"), F.col("vr") * 1000, F.lit(30000))
    return v_cell(spark, sf_dir).groupBy("k").agg(r(stats.l2_norm(F.col("z")), 2).alias("l2"), r(stats.rms(F.col("vr")), 5).alias("rms"), r(acc, 6).alias("acc"))


@query("hash_accumulate", "SELECT event_type, round(sum(value), 3) AS value, count(*) AS n FROM events GROUP BY 1")
def hash_accumulate(spark, sf_dir):
    return stats.accumulate(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", r("value", 3).alias("value"), "n")


@query("distinct_positions", "SELECT count(DISTINCT (i, j)) AS cells, count(DISTINCT i) AS columns FROM v_cell", "v_cell")
def distinct_positions(spark, sf_dir):
    return v_cell(spark, sf_dir).agg(F.countDistinct("i", "j").alias("cells"), F.countDistinct("i").alias("columns"))


@query(
    "rank_statistics",
    """SELECT k, round(avg(z), 3) AS mean, max(z) AS most, (arg_max(okey, (z, -okey))) AS most_at, min(z) AS least, (arg_min(okey, (z, okey))) AS least_at FROM v_cell GROUP BY k""",
    "v_cell",
)
def rank_statistics(spark, sf_dir):
    s = stats.rank_spread(v_cell(spark, sf_dir), "k", "z", "okey")
    return s.select("k", r("mean", 3).alias("mean"), "most", "most_at", "least", "least_at")


@query(
    "masked_layer_reductions",
    "SELECT k, round(sum(z) FILTER (err > 0), 2) AS total, round(avg(z) FILTER (err > 0), 4) AS mean, max(z) FILTER (err > 0) AS most, min(z) FILTER (err > 0 AND z > 0) AS least_nonzero FROM v_cell GROUP BY k",
    "v_cell",
)
def masked_layer_reductions(spark, sf_dir):
    z = F.when(F.col("err") > 0, F.col("z"))
    return v_cell(spark, sf_dir).groupBy("k").agg(r(F.sum(z), 2).alias("total"), r(F.avg(z)).alias("mean"), F.max(z).alias("most"), F.min(F.when(z > 0, z)).alias("least_nonzero"))


@query(
    "budget_change",
    """, b AS (SELECT date_trunc('year', ts)::DATE AS step, sum(z * vr) AS energy, sum(z) AS mass FROM v_cell GROUP BY 1)
SELECT step, round(energy, 0) AS energy, round(mass, 1) AS mass, round(energy - lag(energy) OVER (ORDER BY step), 0) AS d_energy, round(mass - lag(mass) OVER (ORDER BY step), 1) AS d_mass FROM b""".lstrip(),
    "v_cell",
)
def budget_change(spark, sf_dir):
    from pyspark.sql import Window

    b = v_cell(spark, sf_dir).groupBy(F.trunc("ts", "year").alias("step")).agg(F.sum(F.col("z") * F.col("vr")).alias("e"), F.sum("z").alias("m"))
    w = Window.partitionBy(F.lit(0)).orderBy("step")  # one row per year
    return b.select("step", r("e", 0).alias("energy"), r("m", 1).alias("mass"), r(F.col("e") - F.lag("e").over(w), 0).alias("d_energy"), r(F.col("m") - F.lag("m").over(w), 1).alias("d_mass"))


@query("embed_missing", MISSING + "SELECT i, count(CASE WHEN vr IS NOT NULL THEN z END) AS n, round(sum(CASE WHEN vr IS NOT NULL THEN z END), 2) AS total FROM c GROUP BY i", "v_cell")
def embed_missing(spark, sf_dir):
    e = holed(spark, sf_dir).withColumn("e", stats.embed_missing(F.col("vr"), F.col("z")))
    return e.groupBy("i").agg(F.count("e").alias("n"), r(F.sum("e"), 2).alias("total"))
