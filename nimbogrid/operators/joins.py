"""Joins by place: bucketed neighbourhood search, top k, nearest neighbours, level brackets.

Searches work on places, not on rows: targets that lie at one place share one search, and of sources that no order but that of their numbers tells apart only the first k
can be among a target's k best. What is joined grows with the places in use, not with the product of the rows at them; the result is that of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Truncation of the Gaussian localisation: the weight is zero beyond this many standard deviations.
CUTOFF = 2.0 * math.sqrt(10.0 / 3.0)


def bucket_join(left: DataFrame, right: DataFrame, radius: float, on: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Pairs within radius in the plane (boundary included), with their distance in ``dist``.

    Both sides are put into square buckets as wide as the radius. The left side, which should be the smaller, is sent to
    the nine buckets around it; an equi-join on the bucket and an exact test follow. A right row has one bucket, so no
    pair is found twice. Columns of the right side other than keys must have names of their own, but for x and y.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    a = left.withColumn("_o", near).withColumn("_bx", cell(x) + F.col("_o.a")).withColumn("_by", cell(y) + F.col("_o.b")).drop("_o")
    b = right.withColumn("_bx", cell(x)).withColumn("_by", cell(y)).withColumnRenamed(x, "_x2").withColumnRenamed(y, "_y2")
    d = F.sqrt((F.col(x) - F.col("_x2")) ** 2 + (F.col(y) - F.col("_y2")) ** 2)
    return a.join(b, [*on, "_bx", "_by"]).withColumn("dist", d).filter(F.col("dist") <= radius).drop("_bx", "_by", "_x2", "_y2")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; order must end in a column that breaks ties. Each task keeps k rows a group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def localisation(dist_h: Column, sigma_h: Column | float, dist_v: Column | None = None, sigma_v: Column | float = 1.0) -> tuple[Column, Column]:
    """(normalised distance squared, weight); the weight is null beyond the cutoff, whose boundary is inside."""
    nd = (dist_h / sigma_h) ** 2
    if dist_v is not None:
        nd = nd + (dist_v / sigma_v) ** 2
    return nd, F.when(nd <= CUTOFF**2 + 1e-9, F.exp(-0.5 * nd))


def nearest(targets: DataFrame, source: DataFrame, k: int, limit: float, x: str = "x", y: str = "y", target: str = "cell", row: str = "obs_id") -> DataFrame:
    """(target, columns of source but x and y, dist, rank): the k nearest source points of each target within limit, equal distances by row."""
    t = targets.select(target, x, y)
    some = top_k(source, [x, y], [F.col(row)], k, "_first").drop("_first")
    order = [F.col("dist"), F.col(row)]
    best = top_k(bucket_join(t.select(x, y).distinct(), some, limit, x=x, y=y), [x, y], order, k, "_best").drop("_best")
    return top_k(t.join(best, [x, y]).drop(x, y), [target], order, k)


def local_observations(cells: DataFrame, obs: DataFrame, sigma_h: float, sigma_v: float, k: int, group: str = "ctype", criterion: int = 1) -> DataFrame:
    """For each cell (cell, x, y, lev) and group the k best observations (obs_id, x, y, lev, err, group) within the cutoff.

    criterion 1: smallest distance; 2: greatest weight, which is the smallest distance at nine digits, so that equal distances are equal however they round;
    3: smallest error variance over weight. Ties by obs_id.
    """
    place, same = ["x", "y", "lev"], ["x", "y", "_olev", group, *(["err"] if criterion == 3 else [])]
    o = top_k(obs.withColumnRenamed("lev", "_olev"), same, [F.col("obs_id")], k, "_first").drop("_first")
    near = _weighted(bucket_join(cells.select(*place).distinct(), o, sigma_h * CUTOFF), sigma_h, sigma_v)
    by = [{1: F.col("nd"), 2: F.round("nd", 9), 3: F.col("err") * F.col("err") / F.col("weight")}[criterion], F.col("obs_id")]
    best = top_k(near, [*place, group], by, k, "_best").drop("_best")
    return top_k(cells.join(best, place).select(*cells.columns, *(c for c in best.columns if c not in place)), ["cell", group], by, k)


def local_classes(cells: DataFrame, obs: DataFrame, sigma_h: float, sigma_v: float, classes: Sequence[str]) -> DataFrame:
    """(x, y, lev, classes, n, dist, nd, weight): of all observations within the cutoff of each place of cells, how many of one class and place there are, and their weight."""
    o = obs.groupBy("x", "y", F.col("lev").alias("_olev"), *classes).agg(F.count(F.lit(1)).alias("n"))
    return _weighted(bucket_join(cells.select("x", "y", "lev").distinct(), o, sigma_h * CUTOFF), sigma_h, sigma_v)


def _weighted(near: DataFrame, sigma_h: float, sigma_v: float) -> DataFrame:
    """Pairs within the cutoff, with normalised distance squared and weight."""
    nd, w = localisation(F.col("dist"), sigma_h, F.col("lev") - F.col("_olev"), sigma_v)
    return near.withColumn("nd", nd).withColumn("weight", w).filter(F.col("weight").isNotNull()).drop("_olev")


def variable_weights(pairs: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Multiplies localisation weights by a small table of factors by variable and class; a factor of zero drops the pair."""
    return pairs.join(table, list(on)).filter(F.col("factor") > 0).withColumn("weight", F.col("weight") * F.col("factor"))


def nearest_weights(targets: DataFrame, source: DataFrame, k: int, power: float, limit: float, x: str = "x", y: str = "y", target: str = "cell", row: str = "obs_id") -> DataFrame:
    """(target, row, dist, w) for the k nearest source points within limit; weights 1/d**power add up to 1, an exact hit has all the weight."""
    return inverse_distance(nearest(targets, source.select(row, x, y), k, limit, x, y, target, row), target, power)


def inverse_distance(near: DataFrame, target: str, power: float) -> DataFrame:
    """Pairs (target, dist, rank) with weights w = 1/d**power that add up to 1 for each target; an exact hit has all the weight."""
    own = Window.partitionBy(target)
    raw = F.when(F.min("dist").over(own) == 0, F.when((F.col("dist") == 0) & (F.col("rank") == 1), 1.0).otherwise(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col("dist") ** power))
    return near.withColumn("_w", raw).withColumn("w", F.col("_w") / F.sum("_w").over(own)).drop("_w")


def great_circle_join(targets: DataFrame, source: DataFrame, radius_m: float, earth: float = 6.37122e6) -> DataFrame:
    """Pairs of points (lon, lat in degrees) within radius_m on the sphere, with dist in metres.

    Buckets are bands of latitude and, in each band, of longitude as wide as the radius at the band's edge nearest to a
    pole; near the poles one bucket goes all round. Longitudes wrap.
    """
    step = math.degrees(radius_m / earth)
    band = lambda lat: F.floor((lat + 90) / step)

    def columns(b: Column) -> Column:
        """Number of longitude buckets of a band."""
        edge = F.greatest(F.abs(b * step - 90), F.abs((b + 1) * step - 90)) + step
        return F.when(edge >= 90, 1).otherwise(F.greatest(F.lit(1), F.floor(F.cos(F.radians(F.least(edge, F.lit(89.999)))) * 360 / step)))

    b = source.withColumn("_b", band(F.col("lat"))).withColumnRenamed("lat", "_lat2").withColumnRenamed("lon", "_lon2")
    b = b.withColumn("_c", F.floor(F.pmod(F.col("_lon2"), F.lit(360.0)) / 360 * columns(F.col("_b"))))
    a = targets.withColumn("_b", F.explode(F.array(*[band(F.col("lat")) + o for o in (-1, 0, 1)])))
    n = columns(F.col("_b"))
    at = F.floor(F.pmod(F.col("lon"), F.lit(360.0)) / 360 * n)
    a = a.withColumn("_c", F.explode(F.array_distinct(F.array(*[F.pmod(at + o, n) for o in (-1, 0, 1)]))))
    half = lambda v: F.sin(F.radians(v) / 2) ** 2
    h = half(F.col("lat") - F.col("_lat2")) + F.cos(F.radians("lat")) * F.cos(F.radians("_lat2")) * half(F.col("lon") - F.col("_lon2"))
    d = 2 * earth * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
    return a.join(b, ["_b", "_c"]).withColumn("dist", d).filter(F.col("dist") <= radius_m).drop("_b", "_c", "_lat2", "_lon2")


def bracket(targets: DataFrame, levels: DataFrame, column: Sequence[str], target: str, level: str, value: str, clamp: bool) -> DataFrame:
    """Linear value at ``target`` between a column's levels: lower level included, upper excluded, the top one included.

    Outside the levels the end value (clamp) or missing. Levels of each column are joined as intervals; only interval and target of
    the same column meet.
    """
    w = Window.partitionBy(*column).orderBy(level)
    ends = levels.filter(F.col(value).isNotNull()).select(*column, F.col(level).alias("_l"), F.col(value).alias("_v"))
    ends = ends.withColumn("_l2", F.lead("_l").over(Window.partitionBy(*column).orderBy("_l"))).withColumn("_v2", F.lead("_v").over(Window.partitionBy(*column).orderBy("_l"))).withColumn("_first", F.row_number().over(Window.partitionBy(*column).orderBy("_l")) == 1)
    del w
    t = F.col(target)
    inside = (t >= F.col("_l")) & (F.col("_l2").isNull() | (t < F.col("_l2")))
    hit = targets.join(ends, list(column)).filter(inside | (F.col("_first") & (t < F.col("_l"))))
    top = F.col("_l2").isNull()
    below = t < F.col("_l")
    outside = below | (top & (t > F.col("_l")))
    a = F.try_divide(t - F.col("_l"), F.col("_l2") - F.col("_l"))
    out = F.when(outside, F.col("_v") if clamp else F.lit(None)).when(top, F.col("_v")).otherwise((1 - a) * F.col("_v") + a * F.col("_v2"))
    return hit.withColumn(value, out).drop("_l", "_v", "_l2", "_v2", "_first")


def corners(points: DataFrame, grid: DataFrame, ri: str, rj: str, i: str, j: str, value: str, row: str) -> DataFrame:
    """Bilinear value at fractional grid indexes: four corners by equi-join. Missing where a corner with weight is."""
    fi, fj = F.floor(F.col(ri)), F.floor(F.col(rj))
    a, b = F.col(ri) - fi, F.col(rj) - fj
    four = F.array(*[F.struct((fi + p).alias("i"), (fj + q).alias("j"), ((a if p else 1 - a) * (b if q else 1 - b)).alias("w")) for p in (0, 1) for q in (0, 1)])
    spread = points.select(row, F.explode(four).alias("c")).select(row, F.col("c.i").alias(i), F.col("c.j").alias(j), F.col("c.w").alias("w")).filter("w > 0")
    met = spread.join(grid.select(F.col(i).cast("long").alias(i), F.col(j).cast("long").alias(j), value), [i, j], "left")
    return met.groupBy(row).agg(F.when(F.count(value) == F.count(F.lit(1)), F.sum(F.col(value) * F.col("w"))).alias(value))


def overlap(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes (id_a, ax0, ax1, ay0, ay1) and (id_b, bx0, ...) that overlap; buckets of the given size, each pair once."""

    def spread(df: DataFrame, p: str) -> DataFrame:
        rng = lambda c: F.sequence(F.floor(F.col(f"{p}{c}0") / size), F.floor(F.col(f"{p}{c}1") / size))
        return df.withColumn("_bx", F.explode(rng("x"))).withColumn("_by", F.explode(rng("y")))

    met = spread(a, "a").join(spread(b, "b"), ["_bx", "_by"])
    met = met.filter("ax0 <= bx1 and bx0 <= ax1 and ay0 <= by1 and by0 <= ay1")
    # A pair is reported in the first bucket that the two boxes share.
    first = (F.col("_bx") == F.floor(F.greatest("ax0", "bx0") / size)) & (F.col("_by") == F.floor(F.greatest("ay0", "by0") / size))
    return met.filter(first).drop("_bx", "_by")
