"""Union, selection, difference and re-tiling of files of variables by step; comparison and validation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def concatenate(files: Sequence[DataFrame], var: str = "var", step: str = "step") -> DataFrame:
    """All files one after the other; each variable's steps are renumbered from 1 in order of file and step."""
    tagged = [f.withColumn("_file", F.lit(n)) for n, f in enumerate(files)]
    every = fold(lambda a, b: a.unionByName(b), tagged)
    steps = every.select(var, "_file", step).distinct()
    numbered = steps.withColumn("_new", F.row_number().over(Window.partitionBy(var).orderBy("_file", step)))  # one row per step
    return every.join(numbered, [var, "_file", step]).withColumn(step, F.col("_new")).drop("_new", "_file")


def select_steps(df: DataFrame, names: Sequence[str], first: int, last: int, var: str = "var", step: str = "step", by: int = 1) -> DataFrame:
    """The named variables at steps first, first + by, ... last, renumbered from 1."""
    kept = df.filter(F.col(var).isin(list(names)) & F.col(step).between(first, last) & (F.pmod(F.col(step) - first, F.lit(by)) == 0))
    return kept.withColumn(step, ((F.col(step) - first) / by).cast("int") + 1)


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """a - b where both are; keys that only one has are dropped."""
    return a.join(b.withColumnRenamed(value, "_b"), list(keys)).withColumn(value, F.col(value) - F.col("_b")).drop("_b")


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Rows that differ by more than tolerance, or that only one side has."""
    both = a.withColumn("_ina", F.lit(1)).join(b.withColumnRenamed(value, "other").withColumn("_inb", F.lit(1)), list(keys), "full")
    bad = F.col("_ina").isNull() | F.col("_inb").isNull() | (F.col(value).isNull() != F.col("other").isNull()) | (F.abs(F.col(value) - F.col("other")) > tolerance)
    return both.filter(bad).drop("_ina", "_inb")


def relative_difference(a: Column, b: Column, small: float = 1e-10) -> Column:
    """2 |a - b| / |a + b|; the absolute difference where b is about zero."""
    return F.when(F.abs(b) < small, F.abs(a - b)).otherwise(F.try_divide(2 * F.abs(a - b), F.abs(a + b)))


def out_of_range(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """For each variable (column): how many values lie outside its bounds, and the extremes."""
    parts = []
    for c, (low, high) in bounds.items():
        parts.append(F.struct(F.lit(c).alias("var"), F.count(F.when(~F.col(c).between(low, high), 1)).alias("n_bad"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most")))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def catalogue(df: DataFrame, var: str = "var", step: str = "step") -> DataFrame:
    """Variables with their number of rows and steps."""
    return df.groupBy(var).agg(F.count(F.lit(1)).alias("n"), F.min(step).alias("first"), F.max(step).alias("last"))


def retile(df: DataFrame, keys: Sequence[str], i: str, j: str, ni: int, nj: int) -> DataFrame:
    """One row per cell of tiles that overlap in their halo, with the tile of a new layout. Copies of a cell must be equal: it is an error if they are not."""
    rest = [c for c in df.columns if c not in (*keys, i, j)]
    copies = df.groupBy(*keys, i, j).agg(F.min(F.struct(*rest)).alias("_lo"), F.max(F.struct(*rest)).alias("_hi"))
    same = F.assert_true(F.col("_lo").eqNullSafe(F.col("_hi")), F.lit("copies of a cell differ"))
    one = copies.filter(same.isNull()).select(*keys, i, j, *[F.col(f"_lo.{c}").alias(c) for c in rest])
    return one.withColumn("tile", F.floor(F.col(j) / nj) * 1000 + F.floor(F.col(i) / ni))


def blend(child: Column, parent: Column, weight: Column) -> Column:
    """(1 - weight) child + weight parent."""
    return (1 - weight) * child + weight * parent


def unpivot(df: DataFrame, keys: Sequence[str], values: Sequence[str], var: str = "var", value: str = "value") -> DataFrame:
    """One row per key and variable; missing values give none."""
    return df.unpivot(list(keys), list(values), var, value).filter(F.col(value).isNotNull())


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both files have; missing values are equal."""
    return a.intersect(b.select(*a.columns))


def only_rows(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    """Distinct rows of a that b has not; with every, as many copies as a has more than b."""
    return a.exceptAll(b.select(*a.columns)) if every else a.subtract(b.select(*a.columns))
