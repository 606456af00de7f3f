"""Weights applied, vertical profiles, splines, spectral truncation."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import factors, joins, mesh, regrid, spectral, tridiagonal
from ..sources.workdir import new_folder
from .q_joins import KNN
from .registry import query
from .views import r, v_cell, v_grid, v_site

for _least in (0.5, 1.0):
    _tag = str(_least).replace(".", "")

    def _regrid(spark, sf_dir, least=_least):
        w = joins.nearest_weights(v_grid(spark, sf_dir), v_site(spark, sf_dir), 4, 2.0, 8.0)
        v = v_site(spark, sf_dir).select("obs_id", F.when(F.col("obs_id") % 5 != 0, F.col("dat")).alias("dat"))
        return regrid.apply_weights(w, v, ["cell"], "obs_id", "dat", least).select("cell", r("dat").alias("dat"))

    query(
        f"regrid_nearest_{_tag}",
        KNN
        + f""", n AS (SELECT cell, obs_id, CASE WHEN obs_id % 5 <> 0 THEN dat END AS dat, raw / sum(raw) OVER (PARTITION BY cell) AS w FROM w),
  a AS (SELECT cell, sum(CASE WHEN dat IS NOT NULL THEN w END) AS known, sum(dat * w) AS s FROM n GROUP BY cell) SELECT cell, round(CASE WHEN known >= {_least} - 1e-12 THEN s / known END, 4) AS dat FROM a""",
        "v_grid v_site",
    )(_regrid)


@query(
    "regrid_log",
    KNN + ", n AS (SELECT cell, dat, raw / sum(raw) OVER (PARTITION BY cell) AS w FROM w) SELECT cell, round(exp(sum(ln(dat) * w) / sum(w)), 4) AS dat FROM n GROUP BY cell",
    "v_grid v_site",
)
def regrid_log(spark, sf_dir):
    w = joins.nearest_weights(v_grid(spark, sf_dir), v_site(spark, sf_dir), 4, 2.0, 8.0)
    return regrid.apply_weights(w, v_site(spark, sf_dir), ["cell"], "obs_id", "dat", 0.999, log=True).select("cell", r("dat").alias("dat"))


@query(
    "regrid_lonlat",
    """, g AS (SELECT ix, iy, ix * 10.0::DOUBLE AS x, iy * 10.0::DOUBLE AS y FROM (SELECT unnest(range(0, 11)) AS ix), (SELECT unnest(range(0, 11)) AS iy)),
 p AS (SELECT ix, iy, s.obs_id, s.dat, sqrt((g.x - s.x)**2 + (g.y - s.y)**2) AS d FROM g JOIN v_site s ON sqrt((g.x - s.x)**2 + (g.y - s.y)**2) <= 15),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY d, obs_id) AS o FROM p) WHERE o <= 3),
 w AS (SELECT *, CASE WHEN min(d) OVER (PARTITION BY ix, iy) = 0 THEN CASE WHEN d = 0 AND o = 1 THEN 1.0 ELSE 0.0 END ELSE 1.0 / d END AS raw FROM k)
SELECT ix, iy, round(sum(dat * raw) / sum(raw), 4) AS dat FROM w GROUP BY ix, iy""".lstrip(),
    "v_site",
)
def regrid_lonlat(spark, sf_dir):
    g = regrid.lonlat_axis(spark, 0, 100, 0, 100, 10).withColumn("cell", F.col("iy") * 1000 + F.col("ix"))
    w = joins.nearest_weights(g, v_site(spark, sf_dir), 3, 1.0, 15.0)
    out = regrid.apply_weights(w, v_site(spark, sf_dir), ["cell"], "obs_id", "dat", 0.999)
    return out.select((F.col("cell") % 1000).alias("ix"), F.floor(F.col("cell") / 1000).alias("iy"), r("dat").alias("dat"))


@query(
    "remap_table",
    """, t AS (SELECT i AS source, i // 4 AS target, 0.25::DOUBLE AS w FROM (SELECT DISTINCT i FROM v_cell)), g AS (SELECT i AS source, k, avg(z) AS z FROM v_cell GROUP BY i, k)
SELECT k, target::BIGINT AS target, round(sum(z * w), 4) AS z FROM g JOIN t USING (source) GROUP BY 1, 2""".lstrip(),
    "v_cell",
)
def remap_table(spark, sf_dir):
    g = v_cell(spark, sf_dir).groupBy(F.col("i").alias("source"), "k").agg(F.avg("z").alias("z"))
    t = g.select("source").distinct().select("source", F.floor(F.col("source") / 4).alias("target"), F.lit(0.25).alias("w"))
    return regrid.remap(t, g, "source", "target", "z", ["k"]).withColumn("z", r("z"))


@query(
    "quadratic_levels",
    """, l AS (SELECT i, k::DOUBLE AS k, avg(z) AS z FROM v_cell GROUP BY i, k), n AS (SELECT i, k, lag(z) OVER w AS a, z AS b, lead(z) OVER w AS c FROM l WINDOW w AS (PARTITION BY i ORDER BY k))
SELECT i, k, round(-0.105 * a + 0.91 * b + 0.195 * c, 3) AS z FROM n WHERE a IS NOT NULL AND c IS NOT NULL""".lstrip(),
    "v_cell",
)
def quadratic_levels(spark, sf_dir):
    """Parabola through three levels one apart, at 0.3 above the middle: weights -0.105, 0.91, 0.195."""
    levels = v_cell(spark, sf_dir).groupBy("i", F.col("k").cast("double").alias("k")).agg(F.avg("z").alias("z"))
    return regrid.quadratic(levels, ["i"], "k", "z", F.col("k") + 0.3).select("i", "k", r("z", 3).alias("z"))


@query("vertical_spline")
def vertical_spline(spark, sf_dir):
    """Cubic splines need a solve per column; compared in tests with values of the closed system."""
    levels = v_cell(spark, sf_dir).groupBy("i", "j", (F.col("k") * 10.0).alias("lev")).agg(F.avg("z").alias("z"))
    return regrid.vertical_spline(levels, ["i", "j"], "lev", "z", [5.0, 10.0, 33.0, 70.0, 90.0]).withColumn("z", r("z"))


@query("akima_midpoints")
def akima_midpoints(spark, sf_dir):
    """Local splines at the middle of every interval; compared in tests with a direct evaluation."""
    levels = v_cell(spark, sf_dir).groupBy("i", F.col("k").cast("double").alias("k")).agg(F.avg("z").alias("z"))
    return regrid.akima(levels, ["i"], "k", "z", 0.5).select("i", "at", r("z").alias("z"))


@query(
    "dft_lowpass",
    """, g AS (SELECT i, j, avg(z) AS z FROM v_cell GROUP BY i, j), w AS (SELECT unnest(range(0, 4)) AS q),
 s AS (SELECT j, q, sum(z * cos(2 * pi() * q * i / 20)) AS a, sum(z * sin(2 * pi() * q * i / 20)) AS b FROM g, w GROUP BY j, q)
SELECT p.i, j, round(sum((CASE WHEN q = 0 THEN 0.05 ELSE 0.1 END)::DOUBLE * (a * cos(2 * pi() * q * p.i / 20) + b * sin(2 * pi() * q * p.i / 20))), 3) AS z FROM s, (SELECT unnest(range(0, 20))::INT AS i) p GROUP BY 1, 2""".lstrip(),
    "v_cell",
)
def dft_lowpass(spark, sf_dir):
    g = v_cell(spark, sf_dir).groupBy("i", "j").agg(F.avg("z").alias("z"))
    return regrid.dft_lowpass(g, "i", "j", "z", 20, 3).withColumn("z", r("z", 3))


@query(
    "dft_lowpass_2d",
    """, g AS (SELECT i, j, avg(z) AS z FROM v_cell GROUP BY i, j), w AS (SELECT unnest(range(0, 4)) AS q),
 s AS (SELECT j, q, sum(z * cos(2 * pi() * q * i / 20)) AS a, sum(z * sin(2 * pi() * q * i / 20)) AS b FROM g, w GROUP BY j, q),
 h AS (SELECT p.i, j, sum((CASE WHEN q = 0 THEN 0.05 ELSE 0.1 END)::DOUBLE * (a * cos(2 * pi() * q * p.i / 20) + b * sin(2 * pi() * q * p.i / 20))) AS z FROM s, (SELECT unnest(range(0, 20))::INT AS i) p GROUP BY 1, 2),
 t AS (SELECT i, q, sum(z * cos(2 * pi() * q * j / 20)) AS a, sum(z * sin(2 * pi() * q * j / 20)) AS b FROM h, w WHERE q <= 2 GROUP BY i, q)
SELECT i, p.j, round(sum((CASE WHEN q = 0 THEN 0.05 ELSE 0.1 END)::DOUBLE * (a * cos(2 * pi() * q * p.j / 20) + b * sin(2 * pi() * q * p.j / 20))), 3) AS z FROM t, (SELECT unnest(range(0, 20))::INT AS j) p GROUP BY 1, 2""".lstrip(),
    "v_cell",
)
def dft_lowpass_2d(spark, sf_dir):
    g = v_cell(spark, sf_dir).groupBy("i", "j").agg(F.avg("z").alias("z"))
    return regrid.dft_lowpass_2d(g, "i", "j", "z", 20, 20, 3, 2).withColumn("z", r("z", 3))


@query(
    "trilinear",
    """, g AS (SELECT i, j, k, avg(z) AS z FROM v_cell GROUP BY i, j, k), p AS (SELECT obs_id, x * 0.19 AS ri, y * 0.19 AS rj, 1 + (lev % 6) * 1.1::DOUBLE AS rk FROM v_site),
 c AS (SELECT obs_id, floor(ri)::INT + a AS i, floor(rj)::INT + b AS j, floor(rk)::INT + d AS k, (CASE WHEN a = 1 THEN ri - floor(ri) ELSE 1 - (ri - floor(ri)) END) * (CASE WHEN b = 1 THEN rj - floor(rj) ELSE 1 - (rj - floor(rj)) END) * (CASE WHEN d = 1 THEN rk - floor(rk) ELSE 1 - (rk - floor(rk)) END) AS w
  FROM p, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS d))
SELECT obs_id, round((CASE WHEN count(z) = count(*) THEN sum(z * w) END)::DECIMAL(28, 7), 4)::DOUBLE AS z FROM c LEFT JOIN g USING (i, j, k) WHERE w > 0 GROUP BY obs_id""".lstrip(),
    "v_cell v_site",
)
def trilinear(spark, sf_dir):
    """Values of a grid of three dimensions at fractional indexes."""
    g = v_cell(spark, sf_dir).groupBy("i", "j", "k").agg(F.avg("z").alias("z"))
    p = v_site(spark, sf_dir).select("obs_id", (F.col("x") * 0.19).alias("ri"), (F.col("y") * 0.19).alias("rj"), (1 + (F.col("lev") % 6) * 1.1).alias("rk"))
    return regrid.trilinear(p, g, "ri", "rj", "rk", "i", "j", "k", "z", "obs_id").withColumn("z", r("z", 4, 7))


@query(
    "curvilinear_index",
    ", q AS (SELECT obs_id, (x * 1.6 + y * 0.4 - 2) / 10 AS u, (y * 1.2 - x * 0.3 - 1) / 10 AS v FROM v_site) SELECT obs_id, round(u, 6) AS ri, round(v, 6) AS rj FROM q WHERE u >= 0 AND u <= 20 AND v >= 0 AND v <= 20".lstrip(),
    "v_site",
)
def curvilinear_index(spark, sf_dir):
    """Places of a sheared grid, whose index is known in closed form: 1.6 x + 0.4 y = 10 i + 2, -0.3 x + 1.2 y = 10 j + 1."""
    n = spark.range(21 * 21).select((F.col("id") % 21).alias("i"), F.floor(F.col("id") / 21).alias("j"))
    a, b, det = F.col("i") * 10.0 + 2, F.col("j") * 10.0 + 1, 1.6 * 1.2 + 0.4 * 0.3
    grid = n.select("i", "j", ((1.2 * a - 0.4 * b) / det).alias("gx"), ((0.3 * a + 1.6 * b) / det).alias("gy"))
    found = regrid.curvilinear_index(v_site(spark, sf_dir), grid, "obs_id", "x", "y", "i", "j", 10.0)
    return found.select("obs_id", r("ri", 6).alias("ri"), r("rj", 6).alias("rj"))


@query(
    "pressure_levels",
    """, l AS (SELECT i, j, -ln(1000.0::DOUBLE - k * 100) AS lev, avg(z) AS z FROM v_cell GROUP BY i, j, k), t AS (SELECT DISTINCT i, j, unnest([850.0, 500.0, 250.0])::DOUBLE AS p FROM v_cell),
 s AS (SELECT *, lead(lev) OVER (PARTITION BY i, j ORDER BY lev) AS l2, lead(z) OVER (PARTITION BY i, j ORDER BY lev) AS z2, row_number() OVER (PARTITION BY i, j ORDER BY lev) AS o FROM l)
SELECT t.i, t.j, p, round((CASE WHEN -ln(p) < lev OR (l2 IS NULL AND -ln(p) > lev) THEN NULL WHEN l2 IS NULL THEN z ELSE z + (-ln(p) - lev) / (l2 - lev) * (z2 - z) END)::DECIMAL(28, 7), 4)::DOUBLE AS z FROM t JOIN s USING (i, j)
WHERE (-ln(p) >= lev AND (l2 IS NULL OR -ln(p) < l2)) OR (o = 1 AND -ln(p) < lev)""".lstrip(),
    "v_cell",
)
def pressure_levels(spark, sf_dir):
    """To pressure levels on a -ln p axis, without extrapolation."""
    levels = v_cell(spark, sf_dir).groupBy("i", "j", (-F.log(1000.0 - F.col("k") * 100)).alias("lev")).agg(F.avg("z").alias("z"))
    targets = levels.select("i", "j").distinct().withColumn("p", F.explode(F.array(*[F.lit(x) for x in (850.0, 500.0, 250.0)]))).withColumn("t", -F.log("p"))
    return joins.bracket(targets, levels, ["i", "j"], "t", "lev", "z", False).select("i", "j", "p", r("z", 4, 7).alias("z"))


_WAVE = "(2 * pi() * (l * (i + {a}) / 20.0::DOUBLE + m * (j + {b}) / 20.0::DOUBLE))"
_AT_U, _AT_V = _WAVE.format(a="0.5", b="0.0"), _WAVE.format(a="0.0", b="0.5")


@query(
    "divergence_free",
    f""", g AS (SELECT i, j, avg(z) / 1000 AS u, avg(vr) AS v FROM v_cell GROUP BY i, j), w AS (SELECT * FROM (SELECT unnest(range(0, 5)) AS l), (SELECT unnest(range(-3, 4)) AS m)),
 s AS (SELECT l, m, sum(u * cos({_AT_U})) AS ur, -sum(u * sin({_AT_U})) AS ui, sum(v * cos({_AT_V})) AS vr, -sum(v * sin({_AT_V})) AS vi FROM g, w GROUP BY l, m),
 t AS (SELECT *, coalesce((l * ur + m * vr) / nullif(l * l + m * m, 0), 0) AS tr, coalesce((l * ui + m * vi) / nullif(l * l + m * m, 0), 0) AS ti FROM s),
 p AS (SELECT * FROM (SELECT unnest(range(0, 20)) AS i), (SELECT unnest(range(0, 20)) AS j))
SELECT i, j, round(sum(CASE WHEN l = 0 THEN 1 ELSE 2 END * ((ur - l * tr) * cos({_AT_U}) - (ui - l * ti) * sin({_AT_U}))) / 400, 6) AS u,
 round(sum(CASE WHEN l = 0 THEN 1 ELSE 2 END * ((vr - m * tr) * cos({_AT_V}) - (vi - m * ti) * sin({_AT_V}))) / 400, 6) AS v FROM t, p GROUP BY i, j""".lstrip(),
    "v_cell",
)
def divergence_free(spark, sf_dir):
    g = v_cell(spark, sf_dir).groupBy("i", "j").agg((F.avg("z") / 1000).alias("u"), F.avg("vr").alias("v"))
    return spectral.divergence_free(g, "i", "j", "u", "v", 20, 20, 4, 3).select("i", "j", r("u", 6).alias("u"), r("v", 6).alias("v"))


_MESH = """, n AS (SELECT s_suppkey AS id, ceil(sqrt((SELECT count(*) FROM supplier)))::BIGINT AS side, s_acctbal AS v FROM supplier),
 q AS (SELECT id, side, v, -70 + 140.0::DOUBLE * (id % side) / side + 3 * ((id // side) % 2) AS lon, -60 + 120.0::DOUBLE * (id // side) / side AS lat FROM n),
 x AS (SELECT id, side, v, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM q),
 t AS (SELECT 2 * id + k AS tri, id + k AS a, id + 1 + k * side AS b, id + side AS c FROM q, (SELECT unnest([0, 1]) AS k) WHERE id % side < side - 1),
 c AS (SELECT tri, t.a, t.b, t.c, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM t JOIN x p ON p.id = t.a JOIN x q ON q.id = t.b JOIN x r ON r.id = t.c),
 o AS (SELECT obs_id, cos(radians(lat)) * cos(radians(lon)) AS px, cos(radians(lat)) * sin(radians(lon)) AS py, sin(radians(lat)) AS pz FROM (SELECT obs_id, -80 + 1.5::DOUBLE * v_site.x AS lon, -65 + 1.2::DOUBLE * v_site.y AS lat FROM v_site)),
 w AS (SELECT obs_id, tri, a, b, c, (px * (by_ * cz - bz * cy) - py * (bx * cz - bz * cx) + pz * (bx * cy - by_ * cx)) / d AS wa, (ax * (py * cz - pz * cy) - ay * (px * cz - pz * cx) + az * (px * cy - py * cx)) / d AS wb,
  (ax * (by_ * pz - bz * py) - ay * (bx * pz - bz * px) + az * (bx * py - by_ * px)) / d AS wc FROM o, (SELECT *, ax * (by_ * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by_ * cx) AS d FROM c)),
 m AS (SELECT *, wa + wb + wc AS s FROM w WHERE wa + wb + wc > 0 AND least(wa, wb, wc) >= -1e-12 * (wa + wb + wc) QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY tri) = 1)""".lstrip()


def _mesh(spark, sf_dir):
    """(points, triangles, nodes): suppliers as the nodes of a mesh, parts as points."""
    from .views import table

    s = table(spark, sf_dir, "supplier")
    side = math.ceil(math.sqrt(s.count()))
    row, at = F.expr(f"s_suppkey div {side}"), F.col("s_suppkey") % side
    nodes = s.select(F.col("s_suppkey").alias("node"), (-70 + 140.0 * at / side + 3 * (row % 2)).alias("lon"), (-60 + 120.0 * row / side).alias("lat"), F.col("s_acctbal").alias("v"))
    i = F.col("node")
    triangles = nodes.filter(i % side < side - 1).select(i.alias("i"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(
        (2 * F.col("i") + F.col("k")).alias("tri"), (F.col("i") + F.col("k")).alias("a"), (F.col("i") + 1 + F.col("k") * side).alias("b"), (F.col("i") + side).alias("c")
    )
    points = v_site(spark, sf_dir).select("obs_id", (-80 + 1.5 * F.col("x")).alias("lon"), (-65 + 1.2 * F.col("y")).alias("lat"))
    return points, triangles, nodes


@query("mesh_weights", _MESH + " SELECT obs_id, tri, round(wa / s, 7) AS wa, round(wb / s, 7) AS wb, round(wc / s, 7) AS wc FROM m", "v_site")
def mesh_weights(spark, sf_dir):
    """Points in a mesh of spherical triangles of the suppliers, with their weights."""
    points, triangles, nodes = _mesh(spark, sf_dir)
    found = mesh.locate(points, triangles, nodes.drop("v"), "obs_id")
    return found.select("obs_id", "tri", *[r(w, 7).alias(w) for w in ("wa", "wb", "wc")])


@query(
    "mesh_remap",
    _MESH + " SELECT obs_id, round(((wa * p.v + wb * q.v + wc * r.v) / s)::DECIMAL(28, 7), 3)::DOUBLE AS v FROM m JOIN n p ON p.id = m.a JOIN n q ON q.id = m.b JOIN n r ON r.id = m.c",
    "v_site",
)
def mesh_remap(spark, sf_dir):
    """The mesh's values at the points, by a weight table."""
    points, triangles, nodes = _mesh(spark, sf_dir)
    weights = mesh.weight_table(mesh.locate(points, triangles, nodes.drop("v"), "obs_id"), "obs_id", "obs_id", "node")
    return regrid.remap(weights, nodes.select("node", "v"), "node", "obs_id", "v").select("obs_id", r("v", 3, 7).alias("v"))


@query(
    "factors_3d",
    """, g AS (SELECT i * 20 + j AS src, k, avg(z) AS z, k * 10 + (any_value(i) + any_value(j)) % 3 AS h FROM v_cell GROUP BY i, j, k),
 e AS (SELECT src, k, h, z, lead(k) OVER w AS k1, lead(h) OVER w AS h1, lead(z) OVER w AS z1 FROM g WINDOW w AS (PARTITION BY src ORDER BY h)),
 p AS (SELECT obs_id, x * 0.19 AS ri, y * 0.19 AS rj, 12 + lev::DOUBLE AS hh FROM v_site),
 c AS (SELECT obs_id, t, hh + 3.5 * t AS hh, (floor(ri)::INT + a) * 20 + floor(rj)::INT + b AS src, (CASE WHEN a = 1 THEN ri - floor(ri) ELSE 1 - (ri - floor(ri)) END) * (CASE WHEN b = 1 THEN rj - floor(rj) ELSE 1 - (rj - floor(rj)) END) AS w
  FROM p, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS t)),
 m AS (SELECT obs_id, t, w, CASE WHEN hh = h THEN z ELSE z + (z1 - z) * (hh - h) / (h1 - h) END AS v FROM c JOIN e ON e.src = c.src AND w > 0 AND (hh >= h AND hh < h1 OR k1 IS NULL AND hh = h))
SELECT obs_id, t, round((CASE WHEN sum(w) >= 1 - 1e-9 THEN sum(v * w) / sum(w) END)::DECIMAL(28, 7), 3)::DOUBLE AS z FROM m GROUP BY obs_id, t""".lstrip(),
    "v_cell v_site",
)
def factors_3d(spark, sf_dir):
    """Two heights over each site, by a stored table of bilinear weights and level brackets."""
    g = v_cell(spark, sf_dir).groupBy("i", "j", "k").agg(F.avg("z").alias("z")).select((F.col("i") * 20 + F.col("j")).alias("src"), "k", "z", (F.col("k") * 10 + (F.col("i") + F.col("j")) % 3).cast("double").alias("h"))
    p = v_site(spark, sf_dir).select("obs_id", (F.col("x") * 0.19).alias("ri"), (F.col("y") * 0.19).alias("rj"), (12 + F.col("lev").cast("double")).alias("at"))
    fi, fj = F.floor("ri"), F.floor("rj")
    a, b = F.col("ri") - fi, F.col("rj") - fj
    four = F.array(*[F.struct(((fi + x) * 20 + fj + y).cast("int").alias("src"), ((a if x else 1 - a) * (b if y else 1 - b)).alias("w")) for x in (0, 1) for y in (0, 1)])
    across = p.select("obs_id", F.explode(four).alias("c")).select("obs_id", "c.src", "c.w").filter("w > 0")
    targets = p.select("obs_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("t"), "at").withColumn("at", F.col("at") + 3.5 * F.col("t"))
    name = "factors_" + uuid.uuid4().hex
    factors.store(factors.factors(across, targets, g.select("src", "k", "h"), "obs_id", "src", "k", "h", "at", "t"), name, f"{new_folder(spark)}/table", "src", "k", 8)
    return factors.apply(spark, name, g.select("src", "k", "z"), "obs_id", "t", "src", "k", ["z"]).select("obs_id", "t", r("z", 3, 7).alias("z"))


@query(
    "implicit_diffusion",
    """, l AS (SELECT i, j, k FROM (SELECT DISTINCT i, j FROM v_cell), (SELECT unnest(range(0, 7)) AS k)), g AS (SELECT i, j, k - 1 AS k, avg(z) / 1000 AS t FROM v_cell GROUP BY i, j, k),
 f AS (SELECT l.*, coalesce(t, 0) AS t FROM l LEFT JOIN g ON g.i = l.i AND g.j = l.j AND g.k = l.k), w AS (SELECT unnest(range(0, 7)) AS q),
 s AS (SELECT i, j, q, sum(t * cos(pi() * q * (k + 0.5::DOUBLE) / 7)) * CASE WHEN q = 0 THEN 1 ELSE 2 END / 7 / (1 + 2 * 1.7::DOUBLE * (1 - cos(pi() * q / 7))) AS a FROM f, w GROUP BY i, j, q)
SELECT s.i, s.j, k::BIGINT AS k, round(sum(a * cos(pi() * q * (k + 0.5::DOUBLE) / 7)), 6) AS t FROM s, (SELECT unnest(range(0, 7)) AS k) GROUP BY s.i, s.j, k""".lstrip(),
    "v_cell",
)
def implicit_diffusion(spark, sf_dir):
    """One implicit step of diffusion along each column, in blocks of four levels; the cosine series is its closed form."""
    cells = v_cell(spark, sf_dir)
    line = cells.select("i", "j").distinct().select("i", "j", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    t = cells.groupBy("i", "j", (F.col("k") - 1).cast("int").alias("k")).agg((F.avg("z") / 1000).alias("t"))
    k, kappa = F.col("k"), 1.7
    ends = F.when(k.isin(0, 6), 1).otherwise(2)
    rows = line.join(t, ["i", "j", "k"], "left").select("i", "j", k.cast("long").alias("k"), F.lit(-kappa).alias("low"), (1 + kappa * ends).alias("mid"), F.lit(-kappa).alias("high"), F.coalesce("t", F.lit(0.0)).alias("rhs"))
    return tridiagonal.solve(rows, ["i", "j"], "k", 7, block=4).select("i", "j", "k", r("x", 6).alias("t"))
