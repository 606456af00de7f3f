"""Statistics that know about missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeops import row_numbers


def departure_monitor(obs: DataFrame, elements: DataFrame | None = None, fold: dict[str, str] | None = None) -> DataFrame:
    """n, bias and rmse of dep for each element over the rows with qc = 0.

    fold renames elements first. With elements (one row per element) those without any row appear with n = 0 and nulls.
    """
    elm = F.col("elm")
    for a, b in (fold or {}).items():
        elm = F.when(F.col("elm") == a, F.lit(b)).otherwise(elm)
    out = obs.filter("qc = 0").groupBy(elm.alias("elm")).agg(F.count("dep").alias("n"), F.avg("dep").alias("bias"), F.sqrt(F.avg(F.col("dep") ** 2)).alias("rmse"))
    if elements is None:
        return out
    return elements.select("elm").distinct().join(out, "elm", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def merge_departures(parts: DataFrame) -> DataFrame:
    """Final n, bias, rmse from partial rows (elm, n, bias, rmse)."""
    n = F.sum("n")
    bias, square = F.sum(F.col("n") * F.col("bias")), F.sum(F.col("n") * F.col("rmse") ** 2)
    return parts.groupBy("elm").agg(n.alias("n"), F.try_divide(bias, n).alias("bias"), F.sqrt(F.try_divide(square, n)).alias("rmse"))


def weighted_mean(value: Column, weight: Column, least: float = 0.0) -> Column:
    """Mean of the values that are not missing; missing when their weight does not exceed least."""
    w = F.sum(F.when(value.isNotNull(), weight))
    return F.when(w > least, F.sum(value * weight) / w)


def level_means(cells: DataFrame, value: str, weight: str, level: str = "k") -> DataFrame:
    return cells.groupBy(level).agg(weighted_mean(F.col(value), F.col(weight)).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def extreme_at(df: DataFrame, value: str, place: Sequence[str], keys: Sequence[str] = (), largest: bool = True) -> DataFrame:
    """The extreme of value with its place; of ties the first by place. One aggregation, combined before the shuffle."""
    sign = F.col(value) if largest else -F.col(value)
    # min over (−value, place): the struct orders by value first, then by place.
    best = F.min(F.struct((-sign).alias("s"), *place))
    out = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("b"))
    v = -F.col("b.s") if largest else F.col("b.s")
    return out.select(*keys, v.alias(value), *[F.col(f"b.{p}").alias(p) for p in place])


def covariance(x: Column, y: Column) -> Column:
    """N - 1 covariance over the rows that have both; null for fewer than two."""
    return F.covar_samp(x, y)


def correlation(x: Column, y: Column) -> Column:
    """Pairwise covariance over each column's own deviation: with missing values this is not corr()."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def regression(x: Column, y: Column) -> Column:
    """Slope of x on y: correlation times the ratio of deviations."""
    return correlation(x, y) * F.try_divide(F.stddev_samp(x), F.stddev_samp(y))


def partial_correlation(r12: Column, r13: Column, r23: Column) -> Column:
    """Correlation of 1 and 2 without 3; missing when any is missing or not below 1."""
    fine = (F.abs(r12) < 1) & (F.abs(r13) < 1) & (F.abs(r23) < 1)
    return F.when(fine, (r12 - r13 * r23) / F.sqrt((1 - r13 * r13) * (1 - r23 * r23)))


def with_lag(df: DataFrame, order: str, value: str, lag: int, keys: Sequence[str] = (), name: str = "lagged", bucket: Column | None = None) -> DataFrame:
    """Adds the value ``lag`` rows later (earlier if negative); missing at the edge.

    With keys by a window over each key's rows. A series without keys takes a bucket, which does not fall as the order rises: rows are
    numbered bucket by bucket and joined on their numbers.
    """
    if bucket is None:
        w = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(order)
        return df.withColumn(name, F.lead(value, lag).over(w) if lag >= 0 else F.lag(value, -lag).over(w))
    numbered = row_numbers(df, [order], bucket, "_nth")
    later = numbered.select((F.col("_nth") - lag).alias("_nth"), F.col(value).alias(name))
    return numbered.join(later, "_nth", "left").drop("_nth")


def monitor_modes(series: DataFrame, order: str, value: str, dt: Column, keys: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """value, deviation from the first, and the time integral of value as a tendency, to which the first row adds 0.

    With a bucket, which does not fall as the order rises, a window holds one bucket of a key; the buckets' sums are carried on.
    """
    b = F.lit(0) if bucket is None else bucket
    s = series.withColumn("_b", b).withColumn("_d", dt)
    add = F.sum(F.col(value) * F.col("_d"))
    sums = s.groupBy(*keys, "_b").agg(add.alias("_sum"), F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"), F.col("_d").alias("d"))).alias("_lo"))
    over = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("_b")  # one row per bucket
    first = F.first("_lo").over(over.rowsBetween(Window.unboundedPreceding, 0))
    carried = sums.select(*keys, "_b", first.alias("_first"), F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    own = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = s.join(carried, [*keys, "_b"])
    through = F.col("_before") + F.sum(F.col(value) * F.col("_d")).over(own) - F.col("_first.v") * F.col("_first.d")
    return out.withColumn("deviation", F.col(value) - F.col("_first.v")).withColumn("integral", through).select(*series.columns, "deviation", "integral")


def cross_counts(obs: DataFrame, rows: str = "typ", cols: str = "elm") -> DataFrame:
    """Counts by two keys with margins (null is 'all'), before and after quality control."""
    return obs.cube(rows, cols).agg(F.count(F.lit(1)).alias("n_all"), F.sum(F.when(F.col("qc") == 0, 1).otherwise(0)).alias("n_good"))


def l2_norm(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def anomaly_correlation(x: Column, y: Column, clim: Column) -> Column:
    """Correlation of two fields' departures from a climate, not centred."""
    a, b = x - clim, y - clim
    return F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b)))


def embed_missing(mask_from: Column, value: Column) -> Column:
    """value, missing where mask_from is."""
    return F.when(mask_from.isNotNull(), value)


def pair_count(x: Column, y: Column) -> Column:
    return F.count(F.when(x.isNotNull() & y.isNotNull(), 1))


def pooled_slope(members: DataFrame, cell: Sequence[str], keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope of y on x pooled over cells and members: sum of products over sum of squares of departures from cell means; 0 without variance."""
    mean = members.groupBy(*cell, *keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    d = members.join(mean, [*cell, *keys])
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    return d.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(dx * dy), F.sum(dx * dx)), F.lit(0.0)).alias("slope"))


def accumulate(df: DataFrame, key: str, value: str) -> DataFrame:
    """Running value and count for each key, as a hash table keeps them."""
    return df.groupBy(key).agg(F.sum(value).alias("value"), F.count(F.lit(1)).alias("n"))


def rank_spread(df: DataFrame, key: str, value: str, rank: str) -> DataFrame:
    """Average, greatest and least value for each key, with the ranks of the latter two (the smallest of ties)."""
    return df.groupBy(key).agg(
        F.avg(value).alias("mean"), F.max(value).alias("most"), F.max(F.struct(F.col(value), (-F.col(rank)).alias("r"))).alias("hi"),
        F.min(value).alias("least"), F.min(F.struct(F.col(value), F.col(rank).alias("r"))).alias("lo"),
    ).select(key, "mean", "most", (-F.col("hi.r")).alias("most_at"), "least", F.col("lo.r").alias("least_at"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], bins: int = 1024, passes: int = 3) -> DataFrame:
    """(keys, n, a column for each fraction): exact quantiles of each key's values, the least value with at least that share of them at or below it.

    No task holds a key's values. Each pass counts the values between two bounds in ``bins`` equal bins, combined before the shuffle, and goes on with the ends of the bin that the
    rank falls in; what is left after the last is a bins**passes-th of the range, of which a task sees each value once, with its count. df is read passes + 2 times.
    Missing values and NaN don't count; keys may be null; a key without values has n 0 and nulls. Infinite values are an error of the caller.
    """
    number = F.col(value).cast("double")
    rows = df.select(*keys, F.when(~F.isnan(number), number).alias("_v"))
    whole = rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # Of n values the one with this number, from 1.
    rank = lambda f: F.greatest(F.lit(1).cast("long"), F.col("n") - F.floor(F.col("n") - F.lit(float(f)) * F.col("n")))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(f).alias("rank")) for name, f in fractions.items()]))
    open_ = whole.filter("n > 0").select(*keys, "_lo", "_hi", each.alias("_f")).select(*keys, "_lo", "_hi", F.col("_f.name").alias("_name"), F.col("_f.rank").alias("_rank"))

    def within(bounds: DataFrame) -> DataFrame:
        """Values between the bounds of their key's fractions."""
        b = bounds.withColumnsRenamed({k: f"_key{n}" for n, k in enumerate(keys)})
        on = F.lit(True)
        for n, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_key{n}"))
        return rows.join(b, on & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).drop(*[f"_key{n}" for n in range(len(keys))])

    def holding(counted: DataFrame, order: str) -> DataFrame:
        """Of counted rows of each key and fraction the one that the rank falls in."""
        through = F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        return counted.withColumn("_through", through).filter((F.col("_through") >= F.col("_rank")) & (F.col("_through") - F.col("_c") < F.col("_rank")))

    for _ in range(passes):
        # Monotonic in the value, rounding included, so that the values of a bin are those between its least and greatest.
        at = F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * bins)
        counted = within(open_).groupBy(*keys, "_name", "_rank", at.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        open_ = holding(counted, "_bin").select(*keys, "_lo", "_hi", "_name", (F.col("_rank") - F.col("_through") + F.col("_c")).alias("_rank"))
    found = holding(within(open_).groupBy(*keys, "_name", "_rank", "_v").agg(F.count(F.lit(1)).alias("_c")), "_v").select(*keys, "_name", "_v", F.lit(None).cast("long").alias("_n"))
    counts = whole.select(*keys, F.lit(None).cast("string").alias("_name"), F.lit(None).cast("double").alias("_v"), F.col("n").alias("_n"))
    return found.unionByName(counts).groupBy(*keys).agg(F.max("_n").alias("n"), *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in fractions])
