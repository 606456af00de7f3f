"""Interpolation factors in three dimensions, made once and applied to any number of fields.

A table has a row for each target point, target level and source value that it needs, with its weight: the horizontal weight of a source column times the weight of one of
the two levels of that column round the target's height. Stored in buckets of its source values (column and level), it is joined with fields without being shuffled again: only a
field's values move, to the buckets of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def level_factors(pairs: DataFrame, heights: DataFrame, source: str, level: str, height: str, at: str, clamp: bool = False) -> DataFrame:
    """pairs with columns level and f: the levels round each pair's height ``at`` in its source column, with linear weights.

    pairs: (..., source, at); heights: (source, level, height), heights of a column in rising order of levels. Below the first and above the last level the nearest
    one has all the weight (clamp), or the pair has no row. A height on a level takes that level alone.
    """
    w = Window.partitionBy(source).orderBy(height)
    ends = heights.filter(F.col(height).isNotNull()).select(
        source, F.col(level).alias("_k0"), F.col(height).alias("_h0"), F.lead(level).over(w).alias("_k1"), F.lead(height).over(w).alias("_h1"), (F.row_number().over(w) == 1).alias("_first"),
    )
    h = F.col(at)
    last = F.col("_k1").isNull()
    within = (h >= F.col("_h0")) & (h < F.col("_h1")) | last & (h == F.col("_h0"))
    keep = within | (F.col("_first") & (h < F.col("_h0")) | last & (h > F.col("_h0"))) if clamp else within
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(h - F.col("_h0"), F.col("_h1") - F.col("_h0")), F.lit(0.0))))
    two = F.array(F.struct(F.col("_k0").alias("k"), (1 - part).alias("f")), F.struct(F.coalesce("_k1", "_k0").alias("k"), part.alias("f")))
    return pairs.join(ends, source).filter(keep).select(*pairs.columns, F.explode(two).alias("_e")).select(*pairs.columns, F.col("_e.k").alias(level), F.col("_e.f").alias("f")).filter("f > 0")


def factors(horizontal: DataFrame, targets: DataFrame, heights: DataFrame, target: str, source: str, level: str, height: str, at: str = "at", to: str = "to", clamp: bool = False) -> DataFrame:
    """(target, to, source, level, w): the table of :mod:`factors`.

    horizontal: (target, source, w), as of ``joins.nearest_weights`` or ``mesh.weight_table``; targets: (target, to, at), the levels of each target point and their heights;
    heights: (source, level, height). Where a source column does not reach a height the weights of that target level add up to less than 1.
    """
    pairs = horizontal.select(target, source, F.col("w").alias("_w")).join(targets.select(target, to, at), target)
    out = level_factors(pairs, heights, source, level, height, at, clamp)
    return out.select(target, to, source, level, (F.col("_w") * F.col("f")).alias("w"))


def store(table: DataFrame, name: str, path: str, source: str, level: str, buckets: int) -> None:
    """Stores a table in buckets of its source values, sorted inside, under a name of the session's catalogue."""
    table.repartition(buckets, source, level).write.mode("overwrite").format("parquet").bucketBy(buckets, source, level).sortBy(source, level).option("path", path).saveAsTable(name)


def apply(spark: SparkSession, name: str, values: DataFrame, target: str, to: str, source: str, level: str, fields: Sequence[str], keys: Sequence[str] = (), least: float = 1.0) -> DataFrame:
    """(keys, target, to, fields): values (keys, source, level, fields) at the targets of a stored table, all fields in one pass.

    A field is missing where the weights of its known values add up to less than ``least``; missing values do not count. The stored table is read by buckets; only values
    are sent to them, and the sums are combined before they go to their targets.
    """
    table = spark.table(name)
    met = _met(values, table, source, level)
    known = [F.sum(F.when(F.col(f).isNotNull(), F.col("w"))) for f in fields]
    sums = [F.when(k >= least - 1e-9, F.sum(F.col(f) * F.col("w")) / k).alias(f) for f, k in zip(fields, known, strict=True)]
    return met.groupBy(*keys, target, to).agg(*sums)


def _met(values: DataFrame, table: DataFrame, source: str, level: str) -> DataFrame:
    """Rows of the table with their values. A merge join: a broadcast of a small field would do, but the table's buckets make it needless for one of any size."""
    return values.join(table.hint("merge"), [source, level])
