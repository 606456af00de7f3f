"""Analysis by variable, adaptive inflation, impact tables, set operations on files, names and digits, NetCDF fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import ensemble as ens
from ..operators import setops
from ..sources import netcdf
from .q_ensemble import SINGLE, _local_pairs
from .registry import query
from .views import r, table, v_cell, v_ens_array, v_grid

#: Pairs of targets and near observations (q_ensemble._local_pairs), with departure d, error variance r over weight, and weight.
PAIRS = """, p AS (SELECT g.cell, s.obs_id, s.dat, s.ctype, 1 + (s.obs_id % 5) * 0.25 AS err, ((g.x - s.x)**2 + (g.y - s.y)**2) / 9.0 + ((g.lev - s.lev) / 20.0)**2 AS nd FROM v_grid g JOIN v_site s ON sqrt((g.x - s.x)**2 + (g.y - s.y)**2) <= 3.0 * 2 * sqrt(10.0::DOUBLE / 3.0::DOUBLE)),
 k AS (SELECT *, (dat - 1000) / 1000 AS d, exp(-0.5 * nd) AS weight, err * err / exp(-0.5 * nd) AS r FROM (SELECT *, row_number() OVER (PARTITION BY cell, ctype ORDER BY round(nd, 9), obs_id) AS o FROM p WHERE nd <= 40.0 / 3.0 + 1e-9) WHERE o <= 2),
 y AS (SELECT vec_id, member, x - avg(x) OVER (PARTITION BY vec_id) AS y FROM v_ens)""".lstrip()


@query(
    "adaptive_inflation",
    PAIRS
    + """, yy AS (SELECT vec_id, sum(y * y) / 9.0 AS yy FROM y GROUP BY vec_id), s AS (SELECT cell, sum(d * d / r) AS dd, sum(yy / r) AS p, sum(weight) AS w FROM k JOIN yy ON vec_id = k.obs_id % (SELECT count(*) FROM embeddings) GROUP BY cell),
 i AS (SELECT g.cell, 1 + (g.cell % 5) * 0.02 AS i, dd, p, w FROM v_grid g LEFT JOIN s ON s.cell = g.cell)
SELECT cell, round(CASE WHEN p > 0 THEN i + 0.0016 / (0.0016 + 2.0 / w * ((i * p + w) / p)**2) * ((dd - w) / p - i) ELSE i END, 7) AS inflation FROM i""",
    "v_grid v_site v_ens",
)
def adaptive_inflation(spark, sf_dir):
    prior = v_grid(spark, sf_dir).select("cell", (1 + (F.col("cell") % 5) * 0.02).alias("inflation"))
    return ens.adaptive_inflation(_local_pairs(spark, sf_dir), prior, 0.04).select("cell", r("inflation", 7).alias("inflation"))


@query(
    "analysis_by_variable",
    SINGLE
    + """, f AS (SELECT * FROM (VALUES ('t', 'click', 1.0), ('t', 'view', 1.0), ('u', 'click', 0.5), ('u', 'view', 1.0), ('q', 'click', 0.0), ('q', 'view', 0.25), ('s', 'click', 1.0), ('s', 'view', 1.0)) AS f(var, elm, factor)),
 z AS (SELECT q.*, v.var, v.gain, CASE WHEN vec_id % 2 = 0 THEN 'click' ELSE 'view' END AS elm, 1 + (vec_id % 3) * 0.1 AS rho FROM q, (VALUES ('t', 1.0), ('u', 2.0), ('q', -1.0), ('s', 0.5), ('w', 3.0)) AS v(var, gain)),
 c AS (SELECT z.*, coalesce(factor, 0)::DOUBLE AS factor, 9 / rho::DOUBLE AS c FROM z LEFT JOIN f ON f.var = z.var AND f.elm = z.elm)
SELECT vec_id, var, member, round(gain * CASE WHEN factor > 0 THEN m + yy * d / (0.5 / factor * c + yy) + 3.0::DOUBLE * y / sqrt(c + yy * factor / 0.5) ELSE m + sqrt(rho) * y END, 6) AS x FROM c""",
    "v_ens",
)
def analysis_by_variable(spark, sf_dir):
    """Five variables at every point, three kinds of localisation and inflation by point; one observation each, whose closed form is the oracle."""
    e = v_ens_array(spark, sf_dir)
    d, y = ens.observation_departure(F.col("elm") / 10, F.col("ens"))
    pairs = e.select(F.col("vec_id").alias("cell"), F.when(F.col("vec_id") % 2 == 0, "click").otherwise("view").alias("elm"), y.alias("y"), d.alias("d"), F.lit(0.5).alias("r"))
    gains = F.explode(F.create_map(*[F.lit(v) for kv in {"t": 1.0, "u": 2.0, "q": -1.0, "s": 0.5, "w": 3.0}.items() for v in kv])).alias("var", "gain")
    fields = e.select(F.col("vec_id").alias("cell"), "ens", gains).select("cell", "var", F.transform("ens", lambda v: v * F.col("gain")).alias("x"))
    factors = spark.createDataFrame(
        [("t", "click", 1.0), ("t", "view", 1.0), ("u", "click", 0.5), ("u", "view", 1.0), ("q", "click", 0.0), ("q", "view", 0.25), ("s", "click", 1.0), ("s", "view", 1.0)], "var string, elm string, factor double"
    )
    rho = e.select(F.col("vec_id").alias("cell"), (1 + (F.col("vec_id") % 3) * 0.1).alias("inflation"))
    out = ens.analyse_variables(pairs, fields, factors, inflation=rho)
    return out.select(F.col("cell").alias("vec_id"), "var", F.posexplode("x").alias("m", "x")).select("vec_id", "var", (F.col("m") + 1).cast("long").alias("member"), r("x", 6).alias("x"))


@query(
    "impact_by_type_and_region",
    PAIRS
    + """, e AS (SELECT k.obs_id, any_value(k.ctype) AS ctype, round(sum(d / r * a.y * b.y * (k.cell % 7 - 3) / 9.0), 9) AS impact FROM k JOIN y a ON a.vec_id = k.obs_id % (SELECT count(*) FROM embeddings) JOIN y b ON b.vec_id = k.cell AND b.member = a.member GROUP BY 1)
SELECT e.ctype, CASE WHEN s.x < 50 THEN 'west' ELSE 'east' END AS region, count(*) AS n, round(sum(impact), 6) AS total, round(avg(impact), 6) AS mean, round(avg((impact < 0)::INT), 6) AS good FROM e JOIN v_site s USING (obs_id) GROUP BY 1, 2""",
    "v_grid v_site v_ens",
)
def impact_by_type_and_region(spark, sf_dir):
    from .views import v_site

    f = v_ens_array(spark, sf_dir).select(F.col("vec_id").alias("cell"), ens.perturbations(F.col("ens")).alias("f")).withColumn("e", (F.col("cell") % 7 - 3).cast("double"))
    impact = ens.observation_impact(_local_pairs(spark, sf_dir).select("cell", "obs_id", "y", "d", "r"), f).withColumn("impact", F.round("impact", 9))
    obs = v_site(spark, sf_dir).select("obs_id", "ctype", F.when(F.col("x") < 50, "west").otherwise("east").alias("region"))
    t = ens.impact_table(impact.join(obs, "obs_id"), ["ctype", "region"])
    return t.select("ctype", "region", "n", r("total", 6).alias("total"), r("mean", 6).alias("mean"), r("good", 6).alias("good"))


_A = "SELECT l_partkey % 50 AS i, l_quantity AS v FROM lineitem WHERE l_returnflag = 'A'"
_B = "SELECT l_partkey % 50 AS i, l_quantity AS v FROM lineitem WHERE l_returnflag = 'R'"


def _two(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("i"), F.col("l_quantity").alias("v"), "l_returnflag")
    return (d.filter(F.col("l_returnflag") == x).drop("l_returnflag") for x in "AR")


@query("common_rows", f"({_A}) INTERSECT ({_B})")
def common_rows(spark, sf_dir):
    return setops.common_rows(*_two(spark, sf_dir))


@query("only_rows", f"({_A}) EXCEPT ALL ({_B})")
def only_rows(spark, sf_dir):
    return setops.only_rows(*_two(spark, sf_dir), every=True)


@query(
    "file_names",
    "SELECT event_id, 'anal/' || CASE WHEN event_id % 11 = 0 THEN 'mean' ELSE lpad((event_id % 50)::VARCHAR, 4, '0') END || '/init.d' || lpad((event_id % 7)::VARCHAR, 2, '0') || '.pe' || CASE WHEN event_id > 999999 THEN event_id::VARCHAR ELSE lpad(event_id::VARCHAR, 6, '0') END AS name FROM events",
)
def file_names(spark, sf_dir):
    """Placeholders of member, domain and process in a pattern of names."""
    e = table(spark, sf_dir, "events").select("event_id")
    name = text.fill(F.lit("anal/<member>/init.d<domain>.pe<process>"), {"<domain>": (F.col("event_id") % 7, 2), "<process>": (F.col("event_id"), 6)})
    member = text.member_name(F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 50))
    return e.select("event_id", F.replace(name, F.lit("<member>"), member).alias("name"))


@query("significant_digits", "SELECT event_id, CASE WHEN v = 0 THEN 0 ELSE round(v * pow(10, 4 - (floor(log10(abs(v))) + 1))) / pow(10, 4 - (floor(log10(abs(v))) + 1)) END AS v FROM (SELECT event_id, value * (event_id % 7 - 3) / 7.0::DOUBLE AS v FROM events)")
def significant_digits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") * (F.col("event_id") % 7 - 3) / 7).alias("v"))
    return e.select("event_id", text.significant(F.col("v"), 4).alias("v"))


@query("netcdf_fields", "SELECT k, i::BIGINT AS i, j::BIGINT AS j, round(avg(z), 3) AS z FROM v_cell GROUP BY k, i, j", "v_cell")
def netcdf_fields(spark, sf_dir):
    """Level means as a NetCDF file for each level, and back to rows."""
    cells = v_cell(spark, sf_dir).groupBy("k", "i", "j").agg(F.avg("z").alias("z"))
    files = netcdf.files_of(cells, "k", ["j", "i"], {"j": 20, "i": 20}, ["z"])
    rows = netcdf.variable(netcdf.decode(files.withColumnRenamed("file", "path"), ["z"]), "z", ["j", "i"]).filter(F.col("z").isNotNull())
    return rows.select(F.col("path").cast("int").alias("k"), "i", "j", r("z", 3).alias("z"))


@query("perturbed_members")
def perturbed_members(spark, sf_dir):
    """An initial ensemble of ten members; tests check that errors add up to zero and have the given deviation."""
    return ens.perturb(v_grid(spark, sf_dir), 10, {"lev": 0.5}, ["cell"], 3).select("cell", "member", r("lev", 6).alias("lev"))


@query(
    "rollup_counts",
    "SELECT elm, typ, count(*) AS n, grouping(elm, typ)::BIGINT AS level, round(quantile_cont(dat, 0.5), 6) AS median, round(quantile_cont(dat, 0.9), 6) AS high, count(DISTINCT obs_id % 100) AS kinds FROM v_obs GROUP BY ROLLUP (elm, typ)",
    "v_obs",
)
def rollup_counts(spark, sf_dir):
    """Counts, exact quantiles and distinct numbers by element and type, with subtotals."""
    from .views import v_obs

    o = v_obs(spark, sf_dir)
    return o.rollup("elm", "typ").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"), r(F.percentile("dat", F.lit(0.5)), 6).alias("median"), r(F.percentile("dat", F.lit(0.9)), 6).alias("high"), F.countDistinct(F.col("obs_id") % 100).alias("kinds")
    )


@query(
    "grouping_sets_counts",
    "SELECT elm, typ, count(*) AS n FROM v_obs GROUP BY GROUPING SETS ((elm), (typ), ())",
    "v_obs",
)
def grouping_sets_counts(spark, sf_dir):
    from .views import v_obs

    return v_obs(spark, sf_dir).groupingSets([["elm"], ["typ"], []], "elm", "typ").agg(F.count(F.lit(1)).alias("n"))


@query(
    "external_input",
    """WITH e AS (SELECT event_id, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS time, month(ts) AS mon FROM events),
 c AS (SELECT event_type, avg(value) AS base FROM events GROUP BY 1)
SELECT event_id, round(base, 6) AS base, mon * 10.0::DOUBLE AS climate, round(CASE WHEN p < 43200 THEN p / 43200 ELSE 2 - p / 43200 END, 6) AS daily
FROM (SELECT *, time - floor(time / 86400) * 86400 AS p FROM e) JOIN c USING (event_type)""",
)
def external_input(spark, sf_dir):
    """A constant by element, a monthly climate and a periodic daily wave, looked up for every event."""
    from ..operators.external import External, Source
    from .views import seconds_since

    e = table(spark, sf_dir, "events")
    t = e.select("event_id", "event_type", seconds_since("ts", "2024-01-01").alias("time"), F.month("ts").alias("mon"), F.lit(0).alias("all"))
    x = External()
    x.register("base", Source(e.groupBy("event_type").agg(F.avg("value").alias("v")), "constant", ["event_type"], "v"))
    x.register("climate", Source(spark.range(1, 13).select(F.lit(0).alias("all"), F.col("id").alias("month"), (F.col("id") * 10.0).alias("v")), "monthly", ["all"], "v"))
    x.register("daily", Source(spark.createDataFrame([(0.0, 0.0), (43200.0, 1.0)], "time double, v double"), "periodic", [], "v", period=86400.0, width=3600.0))
    t = x.lookup(x.lookup(x.lookup(t, "base"), "climate", month=F.col("mon")), "daily")
    return t.select("event_id", r("base", 6).alias("base"), "climate", r("daily", 6).alias("daily"))
