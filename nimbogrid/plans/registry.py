"""The table of named queries and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: The views of views.py as DuckDB common table expressions.
VIEWS = {
    "v_obs": """v_obs AS (SELECT event_id AS obs_id, event_type AS elm, user_id % 4 AS typ,
      (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-16')) / 1e6 AS dif, value AS dat,
      0.25 * avg(value) OVER (PARTITION BY event_type) AS err, value - avg(value) OVER (PARTITION BY event_type) AS dep FROM events)""",
    "v_cell": """v_cell AS (SELECT (l_partkey % 20)::INT AS i, (l_suppkey % 20)::INT AS j, l_linenumber AS k, l_extendedprice AS z,
      l_quantity AS vr, l_discount AS err, l_tax AS tax, l_shipdate AS ts, l_orderkey AS okey FROM lineitem)""",
    "v_site": """v_site AS (SELECT p_partkey AS obs_id, (p_partkey * 7919 % 1000) / 10.0::DOUBLE AS x, (p_partkey * 104729 % 1000) / 10.0::DOUBLE AS y,
      p_size AS lev, p_retailprice AS dat, p_brand AS ctype FROM part)""",
    "v_grid": """v_grid AS (SELECT s_suppkey AS cell, (s_suppkey * 6151 % 1000) / 10.0::DOUBLE AS x, (s_suppkey * 3079 % 1000) / 10.0::DOUBLE AS y, 25.0::DOUBLE AS lev FROM supplier)""",
    "v_ens": """v_ens AS (SELECT vec_id, label AS elm, u.m AS member, embedding[u.m]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 11)) AS m) u)""",
    "v_series": """v_series AS (SELECT date_trunc('day', o_orderdate)::DATE AS day, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1)""",
}


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a function (spark, sf_dir) -> DataFrame; sql may use the named views and starts with SELECT or further CTEs after a comma."""

    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            used = ", ".join(VIEWS[v] for v in views.split())
            body = sql.strip()
            if used:
                body = f"WITH {used} {body}"
            ORACLES[name] = body
        return f

    return wrap
