"""Points in meshes of spherical triangles: location, barycentric weights, and icosahedral meshes.

Triangles are indexed by cubes in space, not by longitude and latitude, so that poles and the date line are nothing special. A triangle lies in a ball round its
centre; cubes have sides of 1 / 2**level, and its level is the deepest whose cubes are as wide as the ball, so that it has at most eight cubes whatever
its size. A point has one cube at each level that is in use. Triangles and points meet by an equi-join on cubes, and an exact test follows: a refined
region costs no more than a coarse one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A point so little outside of a triangle (in barycentric weights) counts as inside.
EDGE = 1e-12
AXES = "xyz"


def unit_vector(lon: Column, lat: Column) -> list[Column]:
    """x, y, z of a place in degrees on the unit sphere."""
    a, b = F.radians(lon), F.radians(lat)
    return [F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)]


def _det(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def corners_of(triangles: DataFrame, nodes: DataFrame) -> DataFrame:
    """triangles (tri, a, b, c: nodes) with the places ax, ay, az, bx, ... of their corners; nodes: (node, lon, lat)."""
    places = nodes.select("node", *[v.alias(k) for k, v in zip(AXES, unit_vector(F.col("lon"), F.col("lat")), strict=True)])
    out = triangles.select("tri", "a", "b", "c")
    for n in "abc":
        out = out.join(places.select(F.col("node").alias(n), *[F.col(k).alias(f"{n}{k}") for k in AXES]), n)
    return out


def indexed(corners: DataFrame) -> DataFrame:
    """corners with level, cube_x, cube_y, cube_z: a row for each cube that a triangle's ball touches."""
    at = {n: [F.col(f"{n}{k}") for k in AXES] for n in "abc"}
    middle = [at["a"][k] + at["b"][k] + at["c"][k] for k in range(3)]
    size = F.sqrt(sum(m * m for m in middle))
    centre = [m / size for m in middle]
    radius = F.greatest(*[F.sqrt(sum((at[n][k] - centre[k]) ** 2 for k in range(3))) for n in "abc"]) + 1e-9
    d = corners.withColumns({"_r": radius, **{f"_m{k}": centre[n] for n, k in enumerate(AXES)}})
    # The ball's diameter is no longer than a side, so it touches two cubes along an axis at most.
    d = d.withColumn("level", F.floor(-F.log2(2 * F.col("_r"))).cast("int"))
    side = F.pow(F.lit(2.0), -F.col("level"))
    for k in AXES:
        d = d.withColumn(f"cube_{k}", F.explode(F.sequence(F.floor((F.col(f"_m{k}") - F.col("_r")) / side), F.floor((F.col(f"_m{k}") + F.col("_r")) / side))))
    return d.drop("_r", *[f"_m{k}" for k in AXES])


def locate(points: DataFrame, triangles: DataFrame, nodes: DataFrame, row: str = "cell") -> DataFrame:
    """(row, tri, a, b, c, wa, wb, wc): the triangle that each point (row, lon, lat) lies in, and the weights of its corners, which add up to 1.

    The weights are those at which the line from the sphere's centre through the point meets the plane of the corners. On an edge or a corner the triangle with the smallest number is taken. A
    point outside of all triangles has no row. Triangles must be smaller than a half sphere; their corners may go round either way. Points at one place are located once.
    """
    cubes = indexed(corners_of(triangles, nodes))
    ends = cubes.agg(F.min("level"), F.max("level")).first()
    place = ["lon", "lat"]
    p = points.select(*place).distinct().select(*place, *[v.alias(f"p{k}") for k, v in zip(AXES, unit_vector(F.col("lon"), F.col("lat")), strict=True)])
    if ends[0] is None:
        levels = F.array().cast("array<int>")
    else:
        levels = F.sequence(F.lit(ends[0]), F.lit(ends[1]))
    p = p.withColumn("level", F.explode(levels))
    for k in AXES:
        p = p.withColumn(f"cube_{k}", F.floor(F.col(f"p{k}") * F.pow(F.lit(2.0), F.col("level"))))
    met = p.join(cubes, ["level", *[f"cube_{k}" for k in AXES]])
    v = {n: [F.col(f"{n}{k}") for k in AXES] for n in "abcp"}
    whole = _det(v["a"], v["b"], v["c"])
    raw = {"a": _det(v["p"], v["b"], v["c"]), "b": _det(v["a"], v["p"], v["c"]), "c": _det(v["a"], v["b"], v["p"])}
    met = met.withColumns({f"_{n}": F.try_divide(d, whole) for n, d in raw.items()})
    total = F.col("_a") + F.col("_b") + F.col("_c")
    inside = met.filter((total > 0) & (F.least("_a", "_b", "_c") >= -EDGE * total))
    best = F.min(F.struct("tri", "a", "b", "c", *[(F.col(f"_{n}") / total).alias(f"w{n}") for n in "abc"]))
    found = inside.groupBy(*place).agg(best.alias("m"))
    return points.select(row, *place).join(found, place).groupBy(row).agg(F.min("m").alias("m")).select(row, "m.*")


def weight_table(located: DataFrame, row: str = "cell", target: str = "target", source: str = "source") -> DataFrame:
    """(target, source, w) of :func:`locate`'s rows, as ``regrid.remap`` takes them."""
    each = F.array(*[F.struct(F.col(n).alias("source"), F.col(f"w{n}").alias("w")) for n in "abc"])
    return located.select(F.col(row).alias(target), F.explode(each).alias("e")).select(target, F.col("e.source").alias(source), F.col("e.w").alias("w"))


def _corners() -> tuple[np.ndarray, np.ndarray]:
    """Corners and faces of an icosahedron with a corner at each pole."""
    ring = math.degrees(math.atan(0.5))
    places = [(0.0, 90.0), *[(72.0 * k, ring) for k in range(5)], *[(36 + 72.0 * k, -ring) for k in range(5)], (0.0, -90.0)]
    a, b = np.radians(np.array(places)).T
    corners = np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=1)
    faces = []
    for k in range(5):
        n = (k + 1) % 5
        faces += [(0, 1 + k, 1 + n), (1 + k, 6 + k, 1 + n), (1 + n, 6 + k, 6 + n), (11, 6 + n, 6 + k)]
    return corners, np.array(faces)


def icosahedral(spark, parts: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, triangles) of an icosahedron whose faces are cut into parts * parts triangles each, pushed out to the sphere.

    A task makes one row of triangles of a face at a time from its number, so that a mesh of any size is made where it is used. Nodes that faces share have one name:
    their integer coordinates with respect to the icosahedron's corners.
    """
    corners, faces = _corners()

    def node(face: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names and places of nodes (i, j) of a face, at corner weights (parts - i - j, i, j) / parts."""
        weights = np.stack([parts - i - j, i, j], axis=1)
        order = np.argsort(faces[face])
        own, w = faces[face][order], weights[:, order]
        # On an edge or a corner only the corners with a weight count, so that faces agree.
        code = np.zeros(len(i), np.int64)
        for k in range(3):
            code = np.where(w[:, k] > 0, (code * 13 + own[k] + 1), code)
        first = np.where((w > 0).sum(axis=1) == 1, 0, np.where(w[:, 0] > 0, w[:, 0], w[:, 1]))
        second = np.where((w > 0).all(axis=1), w[:, 1], 0)
        name = (code * (parts + 1) + first) * (parts + 1) + second
        p = weights @ corners[faces[face]]
        p = p / np.linalg.norm(p, axis=1, keepdims=True)
        return name, np.degrees(np.stack([np.arctan2(p[:, 1], p[:, 0]), np.arcsin(np.clip(p[:, 2], -1, 1))], axis=1))

    def rows(batches):
        for pdf in batches:
            for n in pdf["id"]:
                face, i = divmod(int(n), parts)
                j = np.arange(parts - i)
                tri = [[(i, j), (i + 1, j), (i, j + 1)], [(i + 1, j[:-1]), (i + 1, j[:-1] + 1), (i, j[:-1] + 1)]]
                for kind, three in enumerate(tri):
                    got = [node(face, np.full(len(y), x), y) for x, y in three]
                    if not len(got[0][0]):
                        continue
                    frame = {"tri": (int(n) * parts + three[0][1]) * 2 + kind}
                    for name, (own, place) in zip("abc", got, strict=True):
                        frame |= {name: own, f"{name}lon": place[:, 0], f"{name}lat": place[:, 1]}
                    yield pd.DataFrame(frame)

    ddl = "tri long, " + ", ".join(f"{n} long, {n}lon double, {n}lat double" for n in "abc")
    made = spark.range(20 * parts).mapInPandas(rows, ddl)
    triangles = made.select("tri", *"abc")
    each = F.explode(F.array(*[F.struct(F.col(n).alias("node"), F.col(f"{n}lon").alias("lon"), F.col(f"{n}lat").alias("lat")) for n in "abc"]))
    nodes = made.select(each.alias("n")).select("n.*").groupBy("node").agg(F.min(F.struct("lon", "lat")).alias("p")).select("node", "p.lon", "p.lat")
    return nodes, triangles
