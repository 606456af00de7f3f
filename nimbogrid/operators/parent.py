"""Fields of a parent model on a child grid: one table of interpolation factors for many variables.

The chain: variables by our names (``external.parent_fields``), horizontal weights of parent columns for each child point, brackets of levels round the heights of the child's levels in these
columns, a stored table of both, and all fields through it in one pass. Fields at the surface go through the horizontal weights alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import rotate
from . import factors, regrid, structured

#: A fractional index so near a whole one is that one.
ON_LINE = 1e-9


def source_id(i: Column, j: Column, ni: int) -> Column:
    """The number of a parent column (i, j), i from 0 to ni - 1."""
    return j.cast("long") * ni + i.cast("long")


def bilinear_weights(child: DataFrame, columns: DataFrame, ni: int, target: str, size: float, x: str = "x", y: str = "y", i: str = "i", j: str = "j") -> DataFrame:
    """(target, source, w): bilinear weights of the four parent columns round each child point; none for a point outside of the parent grid.

    child: (target, x, y); columns: (i, j, x, y), a curvilinear grid. Linear fields of x and y are exact.
    """
    at = regrid.curvilinear_index(child.select(target, x, y), columns.select(i, j, F.col(x).alias("gx"), F.col(y).alias("gy")), target, x, y, i, j, size)
    snapped = {c: F.when(F.abs(F.col(c) - F.round(c)) < ON_LINE, F.round(c)).otherwise(F.col(c)) for c in ("ri", "rj")}
    at = at.withColumns(snapped)
    fi, fj = F.floor("ri"), F.floor("rj")
    a, b = F.col("ri") - fi, F.col("rj") - fj
    four = F.array(*[F.struct(source_id(fi + p, fj + q, ni).alias("source"), ((a if p else 1 - a) * (b if q else 1 - b)).alias("w")) for p in (0, 1) for q in (0, 1)])
    return at.select(target, F.explode(four).alias("c")).select(target, "c.source", "c.w").filter("w > 0")


def distance_weights(child: DataFrame, columns: DataFrame, ni: int, target: str, k: int, power: float = 1.0, axes: Sequence[str] = ("x", "y"), i: str = "i", j: str = "j", limit: float | None = None) -> DataFrame:
    """(target, source, w): inverse distances to the k nearest parent columns, outside of the parent grid too."""
    near = structured.nearest_weights(child, columns, k, power, target, i, j, axes, limit)
    return near.select(target, source_id(F.col(i), F.col(j), ni).alias("source"), "w").filter("w > 0")


def remap(
    horizontal: DataFrame, child_levels: DataFrame, parent: DataFrame, height: str, fields: Sequence[str], target: str, name: str, path: str, level: str = "k", to: str = "to", at: str = "at",
    keys: Sequence[str] = (), wind: tuple[str, str] | None = None, turn: DataFrame | None = None, clamp: bool = False, least: float = 1.0, buckets: int = 200,
) -> DataFrame:
    """(keys, target, to, fields) on the child's levels.

    horizontal: (target, source, w); child_levels: (target, to, at), heights of the child's levels; parent: (keys, source, level, height, fields), where keys are for example times; a column's
    heights are those of its row with the smallest keys. The table of factors is stored as ``name`` at ``path`` for further fields (``factors.apply``). Outside of a
    column's heights a target has no row, or with clamp the nearest level's value. Missing values do not count; a field is missing where known weights add up to less than ``least``.
    wind: the two components that point east and north; turned to the child's axes by turn (target, cos, sin), one row for each target,
    with the angle that ``rotate`` takes from the axes to east and north.
    """
    first = F.min(F.struct(*keys, height)).alias("m")
    heights = parent.groupBy("source", level).agg(first).select("source", level, F.col(f"m.{height}").alias(height))
    table = factors.factors(horizontal, child_levels, heights, target, "source", level, height, at, to, clamp)
    factors.store(table, name, path, "source", level, buckets)
    out = factors.apply(parent.sparkSession, name, parent.select(*keys, "source", level, *fields), target, to, "source", level, fields, keys, least)
    if wind is None:
        return out
    u, v = rotate(F.col(wind[0]), F.col(wind[1]), F.col("cos"), -F.col("sin"))
    return out.join(turn.select(target, "cos", "sin"), target).withColumns({wind[0]: u, wind[1]: v}).select(*keys, target, to, *fields)


def remap_surface(horizontal: DataFrame, parent: DataFrame, fields: Sequence[str], target: str, keys: Sequence[str] = (), mask: Column | None = None, least: float = 0.0) -> DataFrame:
    """(keys, target, fields): fields without levels. Parent columns outside of the mask, as those of land for sea temperatures, and missing values do not count.

    A field is missing where the weights of what counts add up to no more than ``least``.
    """
    value = lambda f: F.col(f) if mask is None else F.when(mask, F.col(f))
    met = parent.select(*keys, "source", *[value(f).alias(f) for f in fields]).join(horizontal, "source")
    known = [F.sum(F.when(F.col(f).isNotNull(), F.col("w"))) for f in fields]
    return met.groupBy(*keys, target).agg(*[F.when(n > least, F.sum(F.col(f) * F.col("w")) / n).alias(f) for f, n in zip(fields, known, strict=True)])
