"""Results as Parquet tables: observation-space values, departures, monitor and history tables, superobservations.

Every sink writes what a rerun would write again: a folder is replaced, or, with mode append, a new part added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats


def write_observation_space(values: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Observation-space values (set, idx, qc, val, ensval array), one folder per set, sorted by idx inside, so that a lookup by (set, idx) reads few row groups.

    Ranges of (set, idx) are dealt to all tasks: a large set is written by many of them, each a file of consecutive numbers.
    """
    values.repartitionByRange("set", "idx").sortWithinPartitions("set", "idx").write.mode(mode).partitionBy("set").parquet(path)


def write_departures(obs: DataFrame, path: str, kind: str, mode: str = "overwrite") -> None:
    """Departures with their observation, one folder per element; kind (background or analysis) is a column."""
    wanted = ["elm", "typ", "lon", "lat", "lev", "dat", "err", "qc", "dep"]
    obs.select(*[c for c in wanted if c in obs.columns], F.lit(kind).alias("kind")).write.mode(mode).partitionBy("elm").parquet(path)


def write_by_rank(values: DataFrame, path: str, rank: str = "rank", mode: str = "overwrite") -> None:
    """One folder per rank of the domain decomposition."""
    values.write.mode(mode).partitionBy(rank).parquet(path)


def monitor_table(obs: DataFrame, keys: Sequence[str] = ("elm",)) -> DataFrame:
    """Bias, rmse and number of good departures by keys, and all observations: what a monitor file holds."""
    dep = F.when(F.col("qc") == 0, F.col("dep"))
    return obs.groupBy(*keys).agg(F.avg(dep).alias("bias"), stats.rms(dep).alias("rmse"), F.count(dep).alias("n_good"), F.count(F.lit(1)).alias("n_all"))


def write_monitor(table: DataFrame, path: str, step: int | None = None) -> None:
    """A monitor table; with a step one folder per step is replaced, so that a rerun of a step writes it again and leaves the others."""
    if step is None:
        table.write.mode("overwrite").parquet(path)
    else:
        table.write.mode("overwrite").parquet(f"{path}/step={int(step)}")


def write_counts(obs: DataFrame, path: str) -> None:
    """Counts by type and element with margins, before and after quality control."""
    stats.cross_counts(obs).write.mode("overwrite").parquet(path)


def write_superobs(obs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Superobservations (i, j, k and their values), sorted by place inside each part."""
    obs.sortWithinPartitions("k", "j", "i").write.mode(mode).parquet(path)


def write_members(state: DataFrame, path: str, keys: Sequence[str], variables: Sequence[str], members: str = "member") -> None:
    """Restart fields: the members, and their mean and spread as members -1 and -2, one folder each."""
    mean = state.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in variables]).withColumn(members, F.lit(-1))
    spread = state.groupBy(*keys).agg(*[F.stddev_samp(v).alias(v) for v in variables]).withColumn(members, F.lit(-2))
    cols = [members, *keys, *variables]
    state.select(*cols).unionByName(mean.select(*cols)).unionByName(spread.select(*cols)).write.mode("overwrite").partitionBy(members).parquet(path)
