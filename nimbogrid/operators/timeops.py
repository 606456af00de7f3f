"""As-of lookup, interpolation in time, periodic series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_numbers(df: DataFrame, order: Sequence[str], bucket: Column, name: str = "nth") -> DataFrame:
    """Numbers all rows from 1 in an order, with one task per bucket. bucket must not fall as the order rises.

    Rows are counted by bucket first; only the table of counts, a row for each bucket, is summed up in one window.
    """
    d = df.withColumn("_b", bucket)
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    inside = d.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return inside.join(starts, "_b").withColumn(name, F.col("_s") + F.col("_n")).drop("_b", "_s", "_n")


def asof_linear(targets: DataFrame, source: DataFrame, time: str, value: str, keys: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """Adds prev, next and the value interpolated in time to each target; null where a side is missing.

    Source and targets are merged; a window carries the last known sample forward, and one in the opposite order the next one back, each in one pass. Of several
    samples at a time the greatest value is the one before and the least the one after. time is a number. With ``width`` long series are divided into buckets of that
    width, so that one key may be of any length: each bucket gets the last sample before it and the first after it.
    """
    spark_keys = [F.col(k) for k in keys]
    s = source.filter(F.col(value).isNotNull()).select(*keys, F.col(time).alias("_t"), F.col(value).alias("_v"))
    t = targets.withColumn("_t", F.col(time)).withColumn("_row", F.lit(1))
    if width is None:
        parts = spark_keys or [F.lit(0)]
    else:
        # For every bucket with samples, its first and last; windows over these, one row per bucket.
        b = F.floor(F.col("_t") / width)
        s, t = s.withColumn("_b", b), t.withColumn("_b", b)
        ends = s.groupBy(*keys, "_b").agg(F.min(F.struct("_t", "_v")).alias("lo"), F.max(F.struct("_t", "_v")).alias("hi"))
        buckets = t.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "full")
        w = Window.partitionBy(*spark_keys or [F.lit(0)])
        # The frame that grows is the cheap one, in either order: Spark goes through one that shrinks anew for each row.
        passed = lambda end, order: F.last(end, True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        carried = buckets.select(*keys, "_b", passed("hi", F.col("_b").asc()).alias("p"), passed("lo", F.col("_b").desc()).alias("n"))
        extra = carried.select(*keys, "_b", F.explode(F.array("p", "n")).alias("e")).filter("e is not null").select(*keys, F.col("e._t").alias("_t"), F.col("e._v").alias("_v"), "_b")
        s = s.unionByName(extra)
        parts = [*spark_keys, F.col("_b")]
    both = t.unionByName(s.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*parts)
    known = F.when(F.col("_row") == 0, F.struct("_t", "_v"))
    passed = lambda *order: F.last(known, True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_p", passed("_t", "_row", "_v")).withColumn("_n", passed(F.desc("_t"), F.desc("_row"), F.desc("_v")))
    # A sample at the target's own time stands before it in the first order, and is its next one too.
    out = out.withColumn("_n", F.when(F.col("_p._t") == F.col("_t"), F.col("_p")).otherwise(F.col("_n")))
    span = F.col("_n._t") - F.col("_p._t")
    a = F.when(span == 0, 0.0).otherwise(F.try_divide(F.col("_t") - F.col("_p._t"), span))
    out = out.filter("_row = 1").withColumn("prev", F.col("_p._v")).withColumn("next", F.col("_n._v")).withColumn(value, (1 - a) * F.col("_p._v") + a * F.col("_n._v"))
    return out.select(*targets.columns, "prev", "next", value)


def periodic(source: DataFrame, date: str, years: Sequence[int]) -> DataFrame:
    """Repeats a series shifted by whole years, so that it can be looked up beyond its ends."""
    shifts = F.explode(F.array(*[F.lit(12 * y) for y in years])).alias("_m")
    return source.select("*", shifts).withColumn(date, F.add_months(F.col(date), F.col("_m"))).drop("_m")


def due(step, interval: int):
    """Whether a process with this step interval runs at a step."""
    return F.pmod(step, F.lit(interval)) == 0
