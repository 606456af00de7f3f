"""Observation quality control and departure statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import qc, stats
from .registry import query
from .views import r, v_cell, v_ens_array, v_obs

SLOT, BASE = 86400.0, 1


def obs_with_qc(spark, sf_dir) -> DataFrame:
    """Observations with a code from five ordered rules; one value in 17 is taken as missing."""
    o = v_obs(spark, sf_dir).withColumn("dep", F.when(F.col("obs_id") % 17 != 0, F.col("dep")))
    rules = [
        (qc.out_of_time(F.col("dif"), SLOT, BASE, -9, 11), qc.OUT_OF_TIME),
        (F.col("typ") == 3, qc.NOT_USED),
        (F.col("dep").isNull(), qc.BAD_VALUE),
        (qc.gross_error(F.col("dep"), F.col("err"), F.when(F.col("elm") == "purchase", 2.0).otherwise(3.0)), qc.GROSS_ERROR),
    ]
    return o.withColumn("slot", qc.time_slot(F.col("dif"), SLOT, BASE)).withColumn("qc", qc.first_code(rules))


QC_SQL = """, o AS (SELECT obs_id, elm, typ, dif, dat, err, CASE WHEN obs_id % 17 <> 0 THEN dep END AS dep FROM v_obs),
s AS (SELECT *, (ceil(dif / 86400.0 - 0.5))::INT + 1 AS slot FROM o),
q AS (SELECT *, CASE WHEN slot < -9 OR slot > 11 THEN 97 WHEN typ = 3 THEN 90 WHEN dep IS NULL THEN 50
  WHEN abs(dep) > (CASE WHEN elm = 'purchase' THEN 2.0 ELSE 3.0 END) * err THEN 5 ELSE 0 END AS qc FROM s) """
QC_SQL = QC_SQL.lstrip()


@query("departure_statistics", QC_SQL + "SELECT elm, count(dep) AS n, round(avg(dep), 4) AS bias, round(sqrt(avg(dep * dep)), 4) AS rmse FROM q WHERE qc = 0 GROUP BY elm", "v_obs")
def departure_statistics(spark, sf_dir):
    return stats.departure_monitor(obs_with_qc(spark, sf_dir)).select("elm", "n", r("bias").alias("bias"), r("rmse").alias("rmse"))


@query(
    "departure_monitor_folded",
    QC_SQL
    + """, e AS (SELECT DISTINCT elm FROM v_obs UNION SELECT 'never_seen'),
  f AS (SELECT CASE WHEN elm = 'click' THEN 'view' ELSE elm END AS elm, dep FROM q WHERE qc = 0)
  SELECT e.elm, count(f.dep) AS n, round(avg(f.dep), 4) AS bias, round(sqrt(avg(f.dep * f.dep)), 4) AS rmse FROM e LEFT JOIN f USING (elm) GROUP BY e.elm""",
    "v_obs",
)
def departure_monitor_folded(spark, sf_dir):
    o = obs_with_qc(spark, sf_dir)
    elements = o.select("elm").distinct().union(spark.createDataFrame([("never_seen",)], "elm string"))
    return stats.departure_monitor(o, elements, {"click": "view"}).select("elm", "n", r("bias").alias("bias"), r("rmse").alias("rmse"))


@query("departure_merge", QC_SQL + "SELECT elm, count(*) AS n, round(avg(dep), 4) AS bias, round(sqrt(avg(dep * dep)), 4) AS rmse FROM q WHERE qc = 0 GROUP BY elm", "v_obs")
def departure_merge(spark, sf_dir):
    """Partial statistics by element and type, merged: equal to those over all rows."""
    parts = obs_with_qc(spark, sf_dir).filter("qc = 0").groupBy("elm", "typ").agg(F.count("dep").alias("n"), F.avg("dep").alias("bias"), F.sqrt(F.avg(F.col("dep") ** 2)).alias("rmse"))
    return stats.merge_departures(parts).select("elm", "n", r("bias").alias("bias"), r("rmse").alias("rmse"))


@query("qc_code_counts", QC_SQL + "SELECT qc, count(*) AS n FROM q GROUP BY qc", "v_obs")
def qc_code_counts(spark, sf_dir):
    return obs_with_qc(spark, sf_dir).groupBy("qc").agg(F.count(F.lit(1)).alias("n"))


@query("qc_slot_counts", QC_SQL + "SELECT slot, count(*) AS n, sum(CASE WHEN qc = 0 THEN 1 ELSE 0 END)::BIGINT AS n_good FROM q GROUP BY slot", "v_obs")
def qc_slot_counts(spark, sf_dir):
    return obs_with_qc(spark, sf_dir).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("qc") == 0, 1).otherwise(0)).alias("n_good"))


@query(
    "obs_counts_with_margins",
    QC_SQL + "SELECT typ, elm, count(*) AS n_all, sum(CASE WHEN qc = 0 THEN 1 ELSE 0 END)::BIGINT AS n_good FROM q GROUP BY CUBE (typ, elm)",
    "v_obs",
)
def obs_counts_with_margins(spark, sf_dir):
    return stats.cross_counts(obs_with_qc(spark, sf_dir))


@query(
    "obs_counts_pivot",
    "SELECT typ, count(*) FILTER (elm = 'click') AS click, count(*) FILTER (elm = 'view') AS view, count(*) FILTER (elm = 'purchase') AS purchase FROM v_obs GROUP BY typ",
    "v_obs",
)
def obs_counts_pivot(spark, sf_dir):
    o = v_obs(spark, sf_dir).groupBy("typ").pivot("elm", ["click", "view", "purchase"]).count()
    return o.select("typ", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("click", "view", "purchase")])


@query("element_sequence", "SELECT elm, (dense_rank() OVER (ORDER BY elm))::INT AS seq, count(*) AS n FROM v_obs GROUP BY elm", "v_obs")
def element_sequence(spark, sf_dir):
    """Element names mapped to sequential numbers through a small dimension table."""
    from ..functions.lookup import sequence_ids

    o = v_obs(spark, sf_dir)
    return o.join(sequence_ids(o, "elm"), "elm").groupBy("elm", "seq").agg(F.count(F.lit(1)).alias("n"))


@query(
    "domain_qc",
    """SELECT CASE WHEN x < 10 OR x > 90 OR y < 5 OR y > 95 THEN 98 WHEN lev < 5 THEN 20 WHEN lev > 45 THEN 21 ELSE 0 END AS qc, count(*) AS n, round(avg(dat), 4) AS mean FROM v_site GROUP BY 1""",
    "v_site",
)
def domain_qc(spark, sf_dir):
    from .views import v_site

    rules = [(qc.out_of_domain(F.col("x"), F.col("y"), 10, 90, 5, 95), qc.OUT_OF_DOMAIN), *qc.level_limits(F.col("lev"), 5, 45)]
    return v_site(spark, sf_dir).withColumn("qc", qc.first_code(rules)).groupBy("qc").agg(F.count(F.lit(1)).alias("n"), r(F.avg("dat")).alias("mean"))


@query(
    "member_vote",
    """, a AS (SELECT vec_id, elm, count(*) FILTER (x > 0.05) AS wet FROM v_ens GROUP BY vec_id, elm)
SELECT vec_id, wet::INT AS wet, CASE WHEN (CASE WHEN elm % 2 = 0 THEN wet < 4 ELSE 10 - wet < 5 END) THEN 12 ELSE 0 END AS qc FROM a""".lstrip(),
    "v_ens",
)
def member_vote(spark, sf_dir):
    e = v_ens_array(spark, sf_dir)
    fails = qc.vote_fails(F.col("ens"), F.col("elm") % 2 == 0, 0.05, 4, 5)
    return e.select("vec_id", qc.member_vote(F.col("ens"), 0.05).alias("wet"), qc.first_code([(fails, qc.MEMBER_VOTE)]).alias("qc"))


@query("index_thinning", "SELECT i, j, k, count(*) AS n FROM v_cell WHERE i % 4 = 0 AND j % 4 = 0 AND k % 2 = 0 GROUP BY i, j, k", "v_cell")
def index_thinning(spark, sf_dir):
    return v_cell(spark, sf_dir).filter(qc.thin(F.col("i"), F.col("j"), F.col("k"), 4, 2)).groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("n"))


@query(
    "used_types",
    "SELECT typ, typ IN (0, 2) AS used, count(*) AS n FROM v_obs GROUP BY 1, 2",
    "v_obs",
)
def used_types(spark, sf_dir):
    config = spark.createDataFrame([(0, True), (1, False), (2, True)], "typ long, used boolean")
    return qc.used_types(v_obs(spark, sf_dir), config).groupBy("typ", "used").agg(F.count(F.lit(1)).alias("n"))


@query(
    "radar_sample_qc",
    """, s AS (SELECT i, j, CASE WHEN okey % 1000 < 900 THEN greatest(z, 10000) END AS z2,
    CASE WHEN okey % 1000 < 900 AND z >= 20000 AND i >= 3 AND abs(vr) <= 45 THEN vr END AS v2 FROM v_cell)
    SELECT i, count(z2) AS nz, count(v2) AS nv, round(avg(z2), 3) AS z, round(avg(v2), 4) AS vr FROM s GROUP BY i""".lstrip(),
    "v_cell",
)
def radar_sample_qc(spark, sf_dir):
    z, v = qc.radar_sample(F.col("z"), F.col("vr"), F.col("okey") % 1000, 10000.0, 20000.0, 45.0, F.col("i"), 3)
    c = v_cell(spark, sf_dir).select("i", z.alias("z2"), v.alias("v2"))
    return c.groupBy("i").agg(F.count("z2").alias("nz"), F.count("v2").alias("nv"), r(F.avg("z2"), 3).alias("z"), r(F.avg("v2")).alias("vr"))


@query(
    "update_mask",
    "SELECT k, round(sum(CASE WHEN k < 2 THEN z ELSE vr END), 2) AS any_var, round(sum(CASE WHEN k < 2 OR k < 4 THEN z ELSE vr END), 2) AS moisture FROM v_cell GROUP BY k",
    "v_cell",
)
def update_mask(spark, sf_dir):
    k = F.col("k")
    a, b = (qc.update_mask(F.col("z"), F.col("vr"), k, 2.0, m, 4.0) for m in (False, True))
    return v_cell(spark, sf_dir).groupBy("k").agg(r(F.sum(a), 2).alias("any_var"), r(F.sum(b), 2).alias("moisture"))


_RADAR = """WITH s AS (SELECT p_partkey AS obs_id, p_size % 4 AS lev, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE (p_partkey * 37 % 600) / 10.0::DOUBLE END AS dat, 1 + (p_partkey % 3)::DOUBLE AS err,
  CASE WHEN p_partkey % 5 = 0 THEN 4002 WHEN p_partkey % 7 = 0 THEN 4004 ELSE 4001 END AS elm, 260 + p_size::DOUBLE AS tm, 90000 - 1000 * p_size::DOUBLE AS pm, p_partkey % (SELECT count(*) FROM embeddings) AS key FROM part),
 e AS (SELECT vec_id AS key, u.m AS member, 15 + 8 * embedding[u.m]::DOUBLE AS x, 0.004 + 0.001 * embedding[u.m + 10]::DOUBLE AS q FROM embeddings, (SELECT unnest(range(1, 11)) AS m) u),
 j AS (SELECT s.*, member, x, q, x - avg(x) OVER w AS dx, q - avg(q) OVER w AS dq FROM s JOIN e ON e.key = s.key WINDOW w AS (PARTITION BY obs_id)),
 b AS (SELECT lev, coalesce(sum(dx * dq) / nullif(sum(dq * dq), 0), 0) AS slope FROM j GROUP BY lev),
 k AS (SELECT j.*, 5 + slope * dq AS cold, dat > 15.000001::DOUBLE AS rain, elm IN (4001, 4004) AS ours, count(*) FILTER (x > 15.000001::DOUBLE) OVER (PARTITION BY obs_id) AS wet FROM j JOIN b ON b.lev = j.lev),
 m AS (SELECT *, CASE WHEN ours AND rain AND wet < 3 THEN cold ELSE x END AS y, coalesce(ours AND CASE WHEN rain THEN wet < 5 AND NOT wet < 3 ELSE wet < 2 END, false) AS poor FROM k),
 n AS (SELECT obs_id, any_value(elm) AS elm, any_value(dat) AS dat, any_value(err) AS err, bool_or(poor) AS poor, bool_or(ours) AS ours, bool_or(rain) AS rain, avg(y) AS my, stddev_samp(y) AS sy, avg(q) AS mq, stddev_samp(q) AS sq,
  any_value(611.2::DOUBLE * exp(17.67::DOUBLE * (tm - 273.15) / (tm - 273.15 + 243.5))) AS es, any_value(pm) AS pm FROM m GROUP BY obs_id),
 d AS (SELECT *, CASE WHEN NOT (dat IS NULL OR (ours AND NOT rain AND poor)) THEN dat - my END AS d0 FROM n),
 h AS (SELECT *, coalesce(ours AND d0 > 22, false) AS humid FROM d)
SELECT obs_id, CASE WHEN humid THEN 'humidity' ELSE 'value' END AS kind, round(CASE WHEN humid THEN 0.622 * es / (pm - es) - mq ELSE d0 END, 8) AS dep, round(CASE WHEN humid THEN sq WHEN d0 IS NOT NULL THEN sy END, 8) AS spread,
 CASE WHEN dat IS NULL THEN 50 WHEN NOT humid AND abs(d0) > 12 * err THEN 5 WHEN poor THEN 12 ELSE 0 END AS qc FROM h"""


@query("radar_variants", _RADAR)
def radar_variants(spark, sf_dir):
    """Reflectivities with additive perturbations, by the pooled slope of their level, where members are dry, and humidity in their place where the departure is large."""
    from ..operators import stats
    from .views import table

    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("key"), F.transform(F.slice("embedding", 1, 10), lambda v: 15 + 8 * v.cast("double")).alias("ens"), F.transform(F.slice("embedding", 11, 10), lambda v: 0.004 + 0.001 * v.cast("double")).alias("eqv")
    )
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(
        k.alias("obs_id"), (F.col("p_size") % 4).alias("lev"), F.when(k % 23 != 0, (k * 37 % 600) / 10).alias("dat"), (1 + k % 3).cast("double").alias("err"), F.when(k % 5 == 0, 4002).when(k % 7 == 0, 4004).otherwise(4001).alias("elm"),
        (260.0 + F.col("p_size")).alias("tm"), (90000.0 - 1000 * F.col("p_size")).alias("pm"), (k % e.count()).alias("key"),
    )
    obs = s.join(e, "key")
    each = obs.select("obs_id", "lev", F.explode(F.arrays_zip("ens", "eqv")).alias("p")).select("obs_id", "lev", F.col("p.ens").alias("x"), F.col("p.eqv").alias("q"))
    obs = qc.additive_perturbations(obs, stats.pooled_slope(each, ["obs_id"], ["lev"], "q", "x"), F.col("eqv"), ["lev"])
    out = qc.radar_departures(obs, 15.0, 5, 2, 12.0, (3, 5.0), 22.0)
    sd = F.sqrt(F.aggregate("pert", F.lit(0.0), lambda a, v: a + v * v) / (F.size("pert") - 1))
    return out.select("obs_id", "kind", r("dep", 8).alias("dep"), r(F.when(F.col("pert").isNotNull(), sd), 8).alias("spread"), "qc")
