"""Nearest points of a structured grid (i, j), by a pyramid of blocks with bounding boxes.

Neighbouring indexes lie near each other, so that a block of ``fan`` by ``fan`` of them has a small box, and so have blocks of blocks. Runs of neighbouring targets go down the pyramid: of the
nodes that it still holds a run keeps those whose nearest corner is not further from its box than what surely holds k points, the least distance within which the farthest corners of nodes
with k points lie; a run that holds many is divided. Each step is an equi-join on the node. Boxes take any number of coordinates, so that points on a sphere go by ``sphere``.

Comparisons are of squared distances. Rounding keeps the order of differences, squares and sums, so that a box is never further away than a point in it, and the result is
that of a comparison with every point, ties by (i, j) included. No radius has to be known beforehand.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workdir import new_folder
from .joins import inverse_distance
from .mesh import unit_vector


def sphere(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points with columns sx, sy, sz on the unit sphere, from degrees: order by chords is order by great circles."""
    return points.withColumns(dict(zip(("sx", "sy", "sz"), unit_vector(F.col(lon), F.col(lat)), strict=True)))


def _box(axes: Sequence[str], low: dict[str, Column], high: dict[str, Column]) -> list[Column]:
    return [*(F.min(low[a]).alias(f"lo_{a}") for a in axes), *(F.max(high[a]).alias(f"hi_{a}") for a in axes)]


def blocks(grid: DataFrame, i: str, j: str, axes: Sequence[str], fan: int) -> DataFrame:
    """(bi, bj, n, lo_*, hi_*, points): blocks of fan x fan indexes with their points; points without coordinates are in none."""
    here = F.struct(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), *[F.col(a).cast("double").alias(a) for a in axes])
    known = grid.dropna(subset=[i, j, *axes]).select(F.floor(F.col(i) / fan).alias("bi"), F.floor(F.col(j) / fan).alias("bj"), here.alias("p"))
    own = {a: F.col(f"p.{a}") for a in axes}
    return known.groupBy("bi", "bj").agg(F.count(F.lit(1)).alias("n"), *_box(axes, own, own), F.collect_list("p").alias("points"))


def _above(nodes: DataFrame, axes: Sequence[str], fan: int) -> DataFrame:
    """The next level: nodes with the boxes of their children, at most fan x fan."""
    ends = [f"{e}_{a}" for e in ("lo", "hi") for a in axes]
    up = nodes.select(F.floor(F.col("bi") / fan).alias("pi"), F.floor(F.col("bj") / fan).alias("pj"), "n", *ends, F.struct("bi", "bj", "n", *ends).alias("child"))
    box = _box(axes, {a: F.col(f"lo_{a}") for a in axes}, {a: F.col(f"hi_{a}") for a in axes})
    return up.groupBy("pi", "pj").agg(F.sum("n").alias("n"), *box, F.collect_list("child").alias("children")).withColumnsRenamed({"pi": "bi", "pj": "bj"})


def _square(parts: Sequence[np.ndarray]) -> np.ndarray:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return total


def _columns(rows: pa.ChunkedArray, names: Sequence[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The lengths of the lists of rows, and the columns of their structs, one after the other."""
    flat = rows.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    fields = flat.flatten()
    return pc.list_value_length(flat).to_numpy(zero_copy_only=False).astype(np.int64), {c: fields.field(c).to_numpy(zero_copy_only=False) for c in names}


def _places(blob: bytes, axes: Sequence[str]) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(-1, len(axes))


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    return np.arange(int(count.sum())) + np.repeat(start - np.cumsum(count) + count, count)


def _reach(far: np.ndarray, n: np.ndarray, group: np.ndarray, groups: int, k: int) -> np.ndarray:
    """For each group the least squared distance within which the farthest corners of nodes with k points lie; all nodes where they have fewer."""
    order = np.lexsort((far, group))
    group, far, total = group[order], far[order], np.cumsum(n[order])
    cut = np.searchsorted(group, np.arange(groups + 1))
    own = total - np.r_[0, total][cut[:-1]][group]
    out = np.full(groups, np.inf)
    last = cut[1:] > cut[:-1]
    out[last] = far[cut[1:][last] - 1]
    enough = np.flatnonzero(own >= k)
    which, first = np.unique(group[enough], return_index=True)
    out[which] = far[enough[first]]
    return out


def _pruned(own: np.ndarray, spans: np.ndarray, group: np.ndarray, node: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, limit: float, most: int):
    """(spans, group, node): runs of places, and the nodes that may hold one of the k nearest points of one of a run's places.

    A run whose box holds more than ``most`` nodes is divided, unless its box is so small against the distance of its nearest points that its parts would hold as many.
    """
    ends, out = np.r_[own, own[-1:]], []
    while len(group):
        box = spans.ravel()
        least, greatest = np.minimum.reduceat(ends, box)[::2], np.maximum.reduceat(ends, box)[::2]
        one, other = low[node] - greatest[group], least[group] - high[node]
        near, far = _square(np.maximum(np.maximum(one, other), 0.0).T), _square(np.maximum(-one, -other).T)
        reach = np.minimum(_reach(far, n[node], group, len(spans), k), limit)
        stay = ~(near > reach[group])
        group, node = group[stay], node[stay]
        held = np.bincount(group, minlength=len(spans))
        again = (held > most) & (spans[:, 1] - spans[:, 0] > 1) & ~(64 * _square((greatest - least).T) < reach)
        place = np.cumsum(~again & (held > 0)) - 1
        done = ~again[group]
        out.append((spans[~again & (held > 0)], place[group[done]], node[done]))
        group, node = group[~done], node[~done]
        place = np.cumsum(again) - 1
        group, node = np.r_[2 * place[group], 2 * place[group] + 1], np.r_[node, node]
        start, end = spans[again].T
        middle = (start + end) // 2
        spans = np.stack([start, middle, middle, end], axis=1).reshape(-1, 2)
    first = np.cumsum([0, *(len(s) for s, _, _ in out)])
    empty = [(np.empty((0, 2), np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
    s, g, m = zip(*(out or empty), strict=True)
    return np.concatenate(s), np.concatenate([a + f for a, f in zip(g, first, strict=False)]), np.concatenate(m)


#: Nodes of the top level, at most, that are sent to all tasks; places of a bundle.
TOP, BUNDLE = 64, 1024
HELD = "own binary, spans binary, nodes array<struct<bi:bigint,bj:bigint,runs:binary>>"


def _held(own: np.ndarray, spans: np.ndarray, group: np.ndarray, bi: np.ndarray, bj: np.ndarray) -> tuple:
    """A bundle's row: its places, its runs, and each node with the runs that hold it; bi, bj are those of each pair."""
    order = np.lexsort((group, bj, bi))
    group, bi, bj = group[order], bi[order], bj[order]
    cut = np.flatnonzero(np.r_[True, (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
    nodes = [{"bi": int(bi[a]), "bj": int(bj[a]), "runs": group[a:b].tobytes()} for a, b in zip(cut, np.r_[cut[1:], len(group)], strict=True)]
    return own.tobytes(), spans.tobytes(), nodes


_TYPES = [pa.binary(), pa.binary(), pa.list_(pa.struct([("bi", pa.int64()), ("bj", pa.int64()), ("runs", pa.binary())]))]


def _batch(rows: list[tuple], more: Sequence[tuple[str, pa.Array]] = ()) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * 3
    made = {c: pa.array(v, t) for c, v, t in zip(("own", "spans", "nodes"), columns, _TYPES, strict=True)}
    return pa.table({**dict(more), **made})


def _along_curve(axes: Sequence[str], low: Sequence[float], high: Sequence[float]):
    """Adds z, the place on a curve that keeps neighbours together: the interleaved bits of the coordinates."""

    def run(batches):
        bits = 62 // len(axes)
        for batch in batches:
            z = np.zeros(batch.num_rows, np.int64)
            with np.errstate(all="ignore"):
                at = [(batch.column(f"_{a}").to_numpy() - x) / (y - x) * (1 << bits) for a, x, y in zip(axes, low, high, strict=True)]
            at = [np.clip(np.nan_to_num(v), 0, (1 << bits) - 1).astype(np.int64) for v in at]
            for bit in reversed(range(bits)):
                for v in at:
                    z = z << 1 | v >> bit & 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], [*batch.schema.names, "z"])

    return run


def _bundles(axes: Sequence[str], top: dict[str, np.ndarray], k: int, limit: float, most: int):
    """Bundles of neighbouring places with the nodes of the top level that they hold."""

    def run(batches):
        low, high = (np.stack([top[f"{e}_{a}"] for a in axes], axis=1) for e in ("lo", "hi"))
        for batch in batches:
            places, rows = np.stack([batch.column(f"_{a}").to_numpy() for a in axes], axis=1), []
            for at in range(0, len(places), BUNDLE):
                own = places[at : at + BUNDLE]
                node = np.arange(len(low))
                spans, group, node = _pruned(own, np.array([[0, len(own)]]), np.zeros(len(low), np.int64), node, top["n"], low, high, k, limit, most)
                if len(group):
                    rows.append(_held(own, spans, group, top["bi"][node], top["bj"][node]))
            yield from _batch(rows).to_batches()

    return run


def _met(table: pa.Table, below: str, names: Sequence[str], axes: Sequence[str]):
    """(own, spans, group, child, columns of the children) of a bundle: a pair for each run and child of a node that it holds."""
    nodes = table.filter(pc.is_valid(table.column("runs")))
    bundle = table.filter(pc.is_valid(table.column("own"))).to_pylist()[0]
    size, children = _columns(nodes.column(below), names)
    runs = [np.frombuffer(x.as_py(), np.int64) for x in nodes.column("runs")]
    holders = np.array([len(x) for x in runs], np.int64)
    start, many = np.repeat(np.cumsum(size) - size, holders), np.repeat(size, holders)
    group = np.repeat(np.concatenate([*runs, np.empty(0, np.int64)]), many)
    return _places(bundle["own"], axes), np.frombuffer(bundle["spans"], np.int64).reshape(-1, 2), group, _runs(start, many), children


def _step(axes: Sequence[str], k: int, limit: float, most: int):
    """A bundle with the children that it holds, from the children of the nodes that it held."""

    def run(table: pa.Table) -> pa.Table:
        own, spans, group, child, c = _met(table, "children", ["bi", "bj", "n", *[f"{e}_{a}" for e in ("lo", "hi") for a in axes]], axes)
        low, high = (np.stack([c[f"{e}_{a}"] for a in axes], axis=1) for e in ("lo", "hi"))
        spans, group, child = _pruned(own, spans, group, child, c["n"], low, high, k, limit, most)
        rows = [_held(own, spans, group, c["bi"][child], c["bj"][child])] if len(group) else []
        return _batch(rows, [("gid", table.column("gid").combine_chunks().slice(0, len(rows)))])

    return run


def _best(axes: Sequence[str], k: int, limit: float, i: str, j: str, pairs: int = 1 << 21):
    """The k nearest points of each place of a bundle: each run is compared with the points of its blocks."""

    def run(table: pa.Table) -> pa.Table:
        own, spans, group, point, p = _met(table, "points", ["i", "j", *axes], axes)
        order = np.lexsort((p["j"][point], p["i"][point], group))
        group, point = group[order], point[order]
        cut, out = np.searchsorted(group, np.arange(len(spans) + 1)), []
        for g, (a, b) in enumerate(spans.tolist()):
            near = point[cut[g] : cut[g + 1]]
            some = max(1, pairs // max(1, len(near)))
            for at in range(a, b if len(near) else a, some):
                part = own[at : min(b, at + some)]
                d = _square([p[c][near] - part[:, n, None] for n, c in enumerate(axes)])
                least = np.partition(d, k - 1, axis=1)[:, k - 1, None] if d.shape[1] > k else np.inf
                row, col = np.nonzero(~(d > least) & ~(d > limit))
                found = d[row, col]
                first = np.lexsort((col, found, row))
                row, col, found = row[first], col[first], found[first]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                out.append(tuple(v[rank < k] for v in (at + row, near[col], np.sqrt(found), rank + 1)))
        place, at, dist, rank = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.empty(0, t) for t in (int, int, float, int))
        columns = {f"_{a}": own[place, n] for n, a in enumerate(axes)} | {i: p["i"][at], j: p["j"][at], "dist": dist, "rank": rank.astype(np.int32)}
        return pa.table({c: pa.array(v) for c, v in columns.items()})

    return run


def nearest(targets: DataFrame, grid: DataFrame, k: int, target: str = "cell", i: str = "i", j: str = "j", axes: Sequence[str] = ("x", "y"), limit: float | None = None, fan: int = 8) -> DataFrame:
    """(target, i, j, dist, rank): the k nearest grid points of each target, no further than limit; equal distances by i, then j.

    targets: (target, axes), one row each; grid: (i, j, axes), of any shape and with holes. A target without coordinates has no row; a grid of fewer than k points gives all of them.
    Targets at one place are searched for once. Places are sorted along a curve, and bundles of ``BUNDLE`` neighbours go down together, divided into runs that hold a few nodes each: a bundle's
    task holds its places and the children of its nodes. Many bundles at one block make a skewed key of the join, which adaptive execution splits; the block's side is one row of
    fan x fan points.
    """
    if k < 1 or not 2 <= fan <= 8:
        raise ValueError("k must be at least 1, fan 2 to 8")
    spark, folder = grid.sparkSession, new_folder(grid.sparkSession)

    def kept(df: DataFrame, name: str | int) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    levels = [kept(blocks(grid, i, j, axes, fan), 0)]
    while levels[-1].count() > TOP:
        levels.append(kept(_above(levels[-1], axes, fan), len(levels)))
    numbers = ["bi", "bj", "n", *[f"{e}_{a}" for e in ("lo", "hi") for a in axes]]
    rows = levels[-1].select(*numbers).limit(TOP).collect()
    top = {c: np.array([row[c] for row in rows], np.float64 if c[:3] in ("lo_", "hi_") else np.int64) for c in numbers}
    square, most = np.inf if limit is None else float(limit) ** 2, 16 + 4 * k // fan**2

    place = [f"_{a}" for a in axes]
    known = targets.dropna(subset=[target, *axes]).select(target, *[F.col(a).cast("double").alias(f"_{a}") for a in axes])
    places = kept(known.select(*place).distinct(), "places")
    ends = places.agg(F.count(F.lit(1)), *[f(a) for f in (F.min, F.max) for a in place]).first()
    low, high = ([float(v or 0) for v in ends[1 + n * len(axes) : 1 + (n + 1) * len(axes)]] for n in (0, 1))
    parts = max(1, -(-ends[0] // (64 * BUNDLE)), min(-(-ends[0] // (8 * BUNDLE)), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    along = places.mapInArrow(_along_curve(axes, low, high), ", ".join([*(f"`{a}` double" for a in place), "z long"]))
    bundles = along.repartitionByRange(parts, "z").sortWithinPartitions("z").mapInArrow(_bundles(axes, top, k, square, most), HELD)
    held = kept(bundles.withColumn("gid", F.monotonically_increasing_id()), "held")

    def met(level: DataFrame, below: str):
        """Bundles with what lies below the nodes that they hold, in one group each."""
        nodes = held.select("gid", F.explode("nodes").alias("m")).select("gid", F.col("m.bi").alias("bi"), F.col("m.bj").alias("bj"), F.col("m.runs").alias("runs"))
        nodes = nodes.join(level.select("bi", "bj", below), ["bi", "bj"]).select("gid", "runs", below)
        return nodes.unionByName(held.select("gid", "own", "spans"), allowMissingColumns=True).repartition(parts, "gid").groupBy("gid")

    for n, level in reversed(list(enumerate(levels))[1:]):
        held = kept(met(level, "children").applyInArrow(_step(axes, k, square, most), f"gid long, {HELD}"), f"held{n}")
    best = met(levels[0], "points").applyInArrow(_best(axes, k, square, i, j), f"{', '.join(f'`{a}` double' for a in place)}, `{i}` long, `{j}` long, dist double, rank int")
    return known.join(best, place).select(target, i, j, "dist", "rank")


def nearest_weights(targets: DataFrame, grid: DataFrame, k: int, power: float, target: str = "cell", i: str = "i", j: str = "j", axes: Sequence[str] = ("x", "y"), limit: float | None = None, fan: int = 8) -> DataFrame:
    """(target, i, j, dist, rank, w): weights 1/d**power of the k nearest grid points add up to 1; an exact hit has all the weight."""
    return inverse_distance(nearest(targets, grid, k, target, i, j, axes, limit, fan), target, power)
