"""External input: named tables that are looked up in time, constant, monthly or as a series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import timeops


@dataclass(frozen=True)
class Source:
    """data has the key columns, the value, and for ``monthly`` a month (1 to 12), for ``series`` and ``periodic`` a time in seconds."""

    data: DataFrame
    kind: str
    keys: Sequence[str]
    value: str
    time: str = "time"
    width: float | None = None
    period: float | None = None


@dataclass
class External:
    """Registered sources by name; a name is registered once."""

    sources: dict[str, Source] = field(default_factory=dict)

    def register(self, name: str, source: Source) -> None:
        if name in self.sources:
            raise ValueError(f"{name} is registered already")
        if source.kind not in ("constant", "monthly", "series", "periodic"):
            raise ValueError(f"unknown kind {source.kind}")
        self.sources[name] = source

    def lookup(self, targets: DataFrame, name: str, time: str = "time", month: Column | None = None) -> DataFrame:
        """targets with a column ``name``: null where the source has nothing for a key, or a series does not reach the time.

        constant and monthly sources are joined by key, series interpolated between the samples before and after. A periodic series is
        laid out three times, a period apart, after targets are brought into its first period.
        """
        s = self.sources[name]
        if s.kind == "constant":
            return targets.join(s.data.select(*s.keys, F.col(s.value).alias(name)), list(s.keys), "left")
        if s.kind == "monthly":
            own = s.data.select(*s.keys, F.col("month").alias("_month"), F.col(s.value).alias(name))
            return targets.withColumn("_month", month).join(own, [*s.keys, "_month"], "left").drop("_month")
        data, at = s.data.select(*s.keys, F.col(s.time).cast("double").alias("_at"), F.col(s.value).alias("_value")), F.col(time).cast("double")
        if s.kind == "periodic":
            data = data.withColumn("_at", F.explode(F.array(*[F.pmod(F.col("_at"), F.lit(s.period)) + n * s.period for n in (-1, 0, 1)])))
            at = F.pmod(at, F.lit(s.period))
        out = timeops.asof_linear(targets.withColumn("_at", at), data, "_at", "_value", list(s.keys), s.width)
        return out.withColumn(name, F.col("_value")).select(*targets.columns, name)


#: Names of the files of a sequence end in a number.
NUMBER = r"_([0-9]+)(?:\.[^./]*)?$"


def _files(values: DataFrame, var: str, axes: int, number: str) -> DataFrame:
    """One row per file that has the variable: (path, file, steps, sizes, first, last)."""
    own = values.filter((F.col("var") == var) & (F.size("index") == axes + 1))
    sizes = F.array(*[(F.max(F.get("index", F.lit(n + 1))) + 1).cast("long") for n in range(axes)]) if axes else F.array().cast("array<bigint>")
    at = F.get("place", F.lit(0))
    file = F.regexp_extract("path", number, 1)
    return own.groupBy("path").agg((F.max(F.get("index", F.lit(0))) + 1).cast("long").alias("steps"), sizes.alias("sizes"), F.min(at).alias("first"), F.max(at).alias("last")).withColumn("file", F.when(file != "", file.cast("long")))


def sequence(values: DataFrame, var: str, axes: Sequence[str], number: str = NUMBER) -> DataFrame:
    """(file, step, step_in_file, time, axes, value): a variable whose steps go on through numbered files, as a series for ``Source``.

    values: the table of netcdf.read_netcdf; the first dimension is time, its coordinate a number. A file's steps are counted on from the last of the file before it. Files are put in order by
    one row each. Files whose names have no number, and files without the variable, add nothing; ``sequence_problems`` tells of them.
    """
    files = _files(values, var, len(axes), number).filter("file is not null")
    before = Window.orderBy("file", "path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = files.select("path", "file", F.coalesce(F.sum("steps").over(before), F.lit(0).cast("long")).alias("_offset"))
    own = values.filter((F.col("var") == var) & (F.size("index") == len(axes) + 1)).join(offsets, "path")
    step = F.get("index", F.lit(0)).cast("long")
    return own.select("file", (F.col("_offset") + step).alias("step"), step.alias("step_in_file"), F.get("place", F.lit(0)).alias("time"), *[F.get("index", F.lit(n + 1)).alias(a) for n, a in enumerate(axes)], "value")


def sequence_problems(values: DataFrame, var: str, axes: Sequence[str], number: str = NUMBER) -> DataFrame:
    """(path, file, problem), no row for a sound sequence: ``unnumbered``; ``missing`` where numbers before it are, from 0 on; ``repeated`` number; ``size`` other than that of the first file;
    ``earlier`` where a file begins before the end of the file before it."""
    files = _files(values, var, len(axes), number)
    w = Window.orderBy("file", "path")  # one row per file
    prev, first = F.lag("file").over(w), F.first("sizes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = files.filter("file is not null").select(
        "path", "file",
        F.array_compact(F.array(
            F.when(F.col("file") > F.coalesce(prev, F.lit(-1)) + 1, "missing"), F.when(F.col("file") == prev, "repeated"), F.when(F.col("sizes") != first, "size"),
            F.when(F.col("first") < F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)), "earlier"),
        )).alias("all"),
    )
    lost = files.filter("file is null").select("path", "file", F.array(F.lit("unnumbered")).alias("all"))
    return numbered.unionByName(lost).select("path", "file", F.explode("all").alias("problem"))


def parent_fields(values: DataFrame, names: dict[str, tuple[str, float, float]], axes: Sequence[str]) -> DataFrame:
    """Fields of a parent model by our names: one row per place with a column per variable, values scaled and shifted into our units.

    values: the table of netcdf.read_netcdf; names: {our name: (its name, factor, offset)}; axes: names of the dimensions. A variable that has fewer
    dimensions than axes, as one at the surface, must be read on its own.
    """
    wanted = {theirs: ours for ours, (theirs, _, _) in names.items()}
    number = F.col("value")
    for theirs, ours in wanted.items():
        number = F.when(F.col("var") == theirs, F.col("value") * names[ours][1] + names[ours][2]).otherwise(number)
    kept = values.filter(F.col("var").isin(list(wanted)) & (F.size("index") == len(axes)))
    place = [F.get("index", F.lit(n)).alias(a) for n, a in enumerate(axes)]
    # One value for each place and variable: max picks it.
    return kept.select("path", *place, "var", number.alias("v")).groupBy("path", *axes).agg(*[F.max(F.when(F.col("var") == theirs, F.col("v"))).alias(ours) for theirs, ours in wanted.items()])
