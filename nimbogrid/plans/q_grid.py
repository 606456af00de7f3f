"""Structured grids: nearest points by blocks, a parent model's fields on a child grid; quantiles with subtotals; series in numbered files."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import external, parent, stats, structured
from ..sources.workdir import new_folder
from .registry import query
from .views import r, table, v_cell, v_obs, v_site


@query(
    "structured_nearest",
    """WITH g AS (SELECT i, j, 1000 * i + (j - 20) * (j - 20) AS x, 700 * j + 3 * i * i AS y FROM (SELECT p_partkey % 50 AS i, p_partkey // 50 AS j FROM part)),
 t AS (SELECT c_custkey AS cell, c_custkey * 7919 % 50000 AS x, c_custkey * 104729 % 28000 AS y FROM customer),
 d AS (SELECT cell, i, j, (g.x - t.x) * (g.x - t.x) + (g.y - t.y) * (g.y - t.y) AS d FROM t, g),
 k AS (SELECT cell, rank, unnest(p) AS p FROM (SELECT cell, min({'d': d, 'i': i, 'j': j}, 4) AS l FROM d GROUP BY cell), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS rank, [l[rank]] AS p))
SELECT cell, p.i AS i, p.j AS j, rank::INT AS rank, round(sqrt(p.d), 6) AS dist FROM k""",
)
def structured_nearest(spark, sf_dir):
    """The four nearest points of a curved grid of parts for each customer."""
    i, j = (F.col("p_partkey") % 50).cast("long"), F.floor(F.col("p_partkey") / 50)
    g = table(spark, sf_dir, "part").select(i.alias("i"), j.alias("j"), (1000 * i + (j - 20) * (j - 20)).alias("x"), (700 * j + 3 * i * i).alias("y"))
    c = F.col("c_custkey").cast("long")
    t = table(spark, sf_dir, "customer").select("c_custkey", (c * 7919 % 50000).alias("x"), (c * 104729 % 28000).alias("y")).withColumnRenamed("c_custkey", "cell")
    return structured.nearest(t, g, 4).withColumn("dist", r("dist", 6))


@query(
    "parent_remap",
    """, g AS (SELECT i * 20 + j AS src, k, avg(z) * 0.01 + 5 AS t, avg(vr) AS q, k * 10 + (any_value(i) + any_value(j)) % 3 AS h FROM v_cell GROUP BY i, j, k),
 e AS (SELECT src, k, h, t, q, lead(k) OVER w AS k1, lead(h) OVER w AS h1, lead(t) OVER w AS t1, lead(q) OVER w AS q1 FROM g WINDOW w AS (PARTITION BY src ORDER BY h)),
 p AS (SELECT obs_id, x * 0.19 AS ri, y * 0.19 AS rj, 12 + lev::DOUBLE AS hh FROM v_site),
 c AS (SELECT obs_id, n AS "to", hh + 3.5 * n AS hh, (floor(ri)::INT + a) * 20 + floor(rj)::INT + b AS src, (CASE WHEN a = 1 THEN ri - floor(ri) ELSE 1 - (ri - floor(ri)) END) * (CASE WHEN b = 1 THEN rj - floor(rj) ELSE 1 - (rj - floor(rj)) END) AS w
  FROM p, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS n)),
 m AS (SELECT obs_id, "to", w, CASE WHEN hh = h THEN t ELSE t + (t1 - t) * (hh - h) / (h1 - h) END AS t, CASE WHEN hh = h THEN q ELSE q + (q1 - q) * (hh - h) / (h1 - h) END AS q FROM c JOIN e ON e.src = c.src AND w > 0 AND (hh >= h AND hh < h1 OR k1 IS NULL AND hh = h))
SELECT obs_id, "to", round((CASE WHEN sum(w) >= 1 - 1e-9 THEN sum(t * w) / sum(w) END)::DECIMAL(28, 7), 3)::DOUBLE AS t, round((CASE WHEN sum(w) >= 1 - 1e-9 THEN sum(q * w) / sum(w) END)::DECIMAL(28, 7), 3)::DOUBLE AS q FROM m GROUP BY obs_id, "to\"""",
    "v_cell v_site",
)
def parent_remap(spark, sf_dir):
    """Two variables of a sheared parent grid, renamed and in our units, at two heights over each site by one table of factors."""
    g = v_cell(spark, sf_dir).groupBy("i", "j", "k").agg((F.avg("z") * 0.01 + 5).alias("t"), F.avg("vr").alias("q"))
    g = g.select(parent.source_id(F.col("j"), F.col("i"), 20).alias("source"), "k", "t", "q", (F.col("k") * 10 + (F.col("i") + F.col("j")) % 3).cast("double").alias("h"))
    # Rows of the sheared grid are the columns of the cells: its first index is j.
    columns = spark.range(400).select((F.col("id") % 20).alias("i"), F.floor(F.col("id") / 20).alias("j"))
    columns = columns.select(F.col("j").alias("i"), F.col("i").alias("j"), (5.0 * F.col("i") + F.col("j")).alias("x"), (5.0 * F.col("j")).alias("y"))
    ri, rj = F.col("x") * 0.19, F.col("y") * 0.19
    sites = v_site(spark, sf_dir).select("obs_id", (5.0 * ri + rj).alias("x"), (5.0 * rj).alias("y"), (12 + F.col("lev").cast("double")).alias("at"))
    across = parent.bilinear_weights(sites, columns, 20, "obs_id", 8.0)
    levels = sites.select("obs_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("to"), "at").withColumn("at", F.col("at") + 3.5 * F.col("to"))
    out = parent.remap(across, levels, g, "h", ["t", "q"], "obs_id", "parent_" + uuid.uuid4().hex, f"{new_folder(spark)}/table", buckets=8)
    return out.select("obs_id", "to", r("t", 3, 7).alias("t"), r("q", 3, 7).alias("q"))


@query(
    "quantiles_with_subtotals",
    "SELECT elm, typ, count(dat) AS n, quantile_disc(dat, 0.1) AS low, quantile_disc(dat, 0.5) AS median, quantile_disc(dat, 0.99) AS high FROM v_obs GROUP BY GROUPING SETS ((elm, typ), (elm), ())",
    "v_obs",
)
def quantiles_with_subtotals(spark, sf_dir):
    """Exact quantiles by element and type, of elements and of all, with bounded memory."""
    o = v_obs(spark, sf_dir).select("elm", "typ", "dat")
    none = {"elm": F.lit(None).cast(o.schema["elm"].dataType), "typ": F.lit(None).cast(o.schema["typ"].dataType)}
    sets = F.array(*[F.struct(*[(F.col(c) if c in kept else none[c]).alias(c) for c in ("elm", "typ")]) for kept in (("elm", "typ"), ("elm",), ())])
    spread = o.select(F.explode(sets).alias("g"), "dat").select("g.elm", "g.typ", "dat")
    return stats.quantiles(spread, ["elm", "typ"], "dat", {"low": 0.1, "median": 0.5, "high": 0.99})


@query(
    "external_sequence",
    """WITH d AS (SELECT o_orderdate::DATE AS day, o_custkey % 3 AS region, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
 p AS (SELECT file, (file > coalesce(lag(file) OVER (ORDER BY file), -1) + 1)::BIGINT AS problems FROM (SELECT DISTINCT year(day) - 1992 AS file FROM d))
SELECT year(day) - 1992 AS file, dense_rank() OVER (ORDER BY day) - 1 AS step, dense_rank() OVER (PARTITION BY year(day) ORDER BY day) - 1 AS step_in_file,
 date_diff('day', DATE '1992-01-01', day)::DOUBLE AS time, region, round(v::DECIMAL(28, 7), 3)::DOUBLE AS value, problems FROM d JOIN p ON p.file = year(day) - 1992""",
)
def external_sequence(spark, sf_dir):
    """Mean prices by day and region, a file a year, as one series with steps counted through all files, and the number of problems of each file."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 3).cast("long").alias("region"), "o_totalprice")
    year = F.year("day")
    d = o.groupBy("day", "region").agg(F.avg("o_totalprice").alias("value"))
    step = F.dense_rank().over(Window.partitionBy(year).orderBy("day")) - 1  # one row per day and region of a year
    values = d.select(
        F.format_string("mean_%05d.nc", year - 1992).alias("path"), F.lit("price").alias("var"), F.array(step.cast("long"), F.col("region")).alias("index"),
        F.array(F.datediff("day", F.lit("1992-01-01").cast("date")).cast("double"), F.lit(None).cast("double")).alias("place"), "value",
    )
    bad = external.sequence_problems(values, "price", ["region"]).groupBy("file").agg(F.count(F.lit(1)).alias("problems"))
    return external.sequence(values, "price", ["region"]).join(bad, "file", "left").withColumn("problems", F.coalesce("problems", F.lit(0).cast("long"))).withColumn("value", r("value", 3, 7))
