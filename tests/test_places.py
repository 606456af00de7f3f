"""Searches work on places: rows that lie at one place do not multiply, and the result is that of all pairs."""

import math
import random

import pytest
from compare import connect, same

from nimbogrid.operators import joins
from nimbogrid.plans import ORACLES, QUERIES

PLACES = [(0.0, 0.0, 25.0), (3.0, 4.0, 25.0), (6.5, 1.0, 20.0)]


@pytest.fixture
def made(monkeypatch):
    """Pairs that the joins by place have made."""
    pairs = []
    for name in ("bucket_join", "great_circle_join", "overlap"):

        def counted(*args, own=getattr(joins, name), **kwargs):
            out = own(*args, **kwargs)
            pairs.append(out.count())
            return out

        monkeypatch.setattr(joins, name, counted)
    return pairs


def rows(spark):
    rng = random.Random(5)
    targets = [(n, *PLACES[n % 3]) for n in range(200)]
    source = [(n, *rng.choice(PLACES)[:2], float(rng.choice([20, 25])), "ab"[n % 2], 1 + n % 5 * 0.25) for n in range(500)]
    return targets, source, spark.createDataFrame(targets, "cell long, x double, y double, lev double"), spark.createDataFrame(source, "obs_id long, x double, y double, lev double, ctype string, err double")


def test_nearest(spark, made):
    targets, source, t, s = rows(spark)
    got = sorted((r["cell"], r["rank"], r["obs_id"], r["dist"]) for r in joins.nearest_weights(t, s, 4, 2.0, 6.0).collect())
    want = []
    for cell, x, y, _ in targets:
        near = sorted((d, o[0]) for o in source if (d := math.hypot(x - o[1], y - o[2])) <= 6.0)[:4]
        want += [(cell, k + 1, o, d) for k, (d, o) in enumerate(near)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert sum(made) <= 3 * 3 * 4


@pytest.mark.parametrize("criterion", [1, 2, 3])
def test_local_observations(spark, made, criterion):
    targets, source, t, s = rows(spark)
    got = sorted((r["cell"], r["ctype"], r["rank"], r["obs_id"]) for r in joins.local_observations(t, s, 3.0, 20.0, 2, criterion=criterion).collect())
    want = []
    for cell, x, y, lev in targets:
        for kind in "ab":
            near = []
            for o in source:
                nd = (math.hypot(x - o[1], y - o[2]) / 3) ** 2 + ((lev - o[3]) / 20) ** 2
                if o[4] == kind and nd <= joins.CUTOFF**2 + 1e-9:
                    near.append((round(o[5] ** 2 * math.exp(nd / 2) if criterion == 3 else nd, 9), o[0]))
            want += [(cell, kind, k + 1, o) for k, (_, o) in enumerate(sorted(near)[:2])]
    assert got == sorted(want)
    assert sum(made) <= 3 * 3 * 2 * 2 * 5 * 2


@pytest.mark.parametrize("name", ["neighbourhood_join", "nearest_distance", "great_circle_join", "box_overlap", "variable_localisation", "local_observations_1", "covariance_localised_single"])
def test_copies_do_not_multiply(spark, sf, tmp_path, made, name):
    """Twenty copies of parts and suppliers with shifted keys, at the same places: no more pairs than places have, and the SQL's result."""
    for table, key in (("part", "p_partkey"), ("supplier", "s_suppkey")):
        d = spark.read.parquet(f"{sf}/{table}.parquet").crossJoin(spark.range(20))
        d.withColumn(key, d[key] + 1000 * d["id"]).drop("id").coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    (tmp_path / "embeddings.parquet").symlink_to(f"{sf}/embeddings.parquet")
    con = connect(sf)
    for table in ("part", "supplier"):
        con.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    QUERIES[name](spark, sf).count()
    once = sum(made)
    made.clear()
    same(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])
    assert sum(made) <= 3 * 8 * once


def test_points_at_one_place_are_located_once(spark):
    from nimbogrid.operators import mesh

    nodes, triangles = mesh.icosahedral(spark, 2)
    points = spark.createDataFrame([(n, 10.0 + n % 2, 20.0) for n in range(500)], "cell long, lon double, lat double")
    out = mesh.locate(points, triangles, nodes)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Places are made distinct below the join with cubes.
    assert "Aggregate [lon#" in plan[plan.index("cube_x") :]
    rows = {r["cell"]: (r["tri"], r["wa"]) for r in out.collect()}
    assert len(rows) == 500 and len(set(rows.values())) == 2 and rows[0] == rows[498] and rows[1] == rows[499]


def test_equal_distances_are_ties(spark):
    """Places whose distances are equal but for rounding: by weight, the smaller number comes first."""
    here = [(1, 0.0, 0.0, 25.0)]
    source = [(n, x, y, 25.0, "a", 1.0) for n, (x, y) in enumerate([(0.5, 0.0), (0.3, 0.4), (0.4, 0.3), (0.0, 0.5), (0.1 + 0.2, 0.4), (0.7 - 0.2 - 1e-16, 0.0)])]
    t, s = spark.createDataFrame(here, "cell long, x double, y double, lev double"), spark.createDataFrame(source, "obs_id long, x double, y double, lev double, ctype string, err double")
    got = [r["obs_id"] for r in joins.local_observations(t, s, 3.0, 20.0, 6, criterion=2).orderBy("rank").collect()]
    assert got == list(range(6))
