"""Gridded binaries: flat multi-variable files described by a spec, and tiles of a mosaic."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import CHUNK, SPLIT, read_exactly, scan

#: Number types of flat binaries.
TYPES = {"int1": "i1", "int2": "i2", "int4": "i4", "int8": "i8", "real4": "f4", "real8": "f8"}


@dataclass(frozen=True)
class FlatSpec:
    """Layout of a flat binary: per step and variable, levels of ny rows of nx numbers. variables: (name, levels)."""

    nx: int
    ny: int
    variables: Sequence[tuple[str, int]]
    kind: str = "real4"
    endian: str = "<"
    y_reverse: bool = False
    missing: float | None = None

    def step_count(self) -> int:
        return sum(n for _, n in self.variables) * self.nx * self.ny


def parse_ctl(lines: Sequence[str]) -> tuple[FlatSpec, dict]:
    """(spec, rest) of a grid descriptor: dset, undef, xdef, ydef, zdef, tdef, options and a list of variables with their levels (0 is one).

    rest has dset, and for each axis its number and, of a linear one, start and step.
    """
    rest: dict = {}
    variables: list[tuple[str, int]] = []
    missing, options, inside = None, [], False
    for line in lines:
        w = line.split()
        if not w or line.startswith("*"):
            continue
        key = w[0].lower()
        if key == "vars":
            inside = True
        elif key == "endvars":
            inside = False
        elif inside:
            variables.append((w[0].split("=")[0], max(1, int(w[1].split(",")[0]))))
        elif key == "dset":
            rest["dset"] = w[1]
        elif key == "undef":
            missing = float(w[1])
        elif key == "options":
            options = [x.lower() for x in w[1:]]
        elif key in ("xdef", "ydef", "zdef", "tdef"):
            rest[key[0]] = (int(w[1]), *(float(x) for x in w[3:5])) if w[2].lower() == "linear" and key != "tdef" else (int(w[1]), *w[3:])
    spec = FlatSpec(rest["x"][0], rest["y"][0], tuple(variables), endian=">" if "big_endian" in options else "<", y_reverse="yrev" in options, missing=missing)
    return spec, rest


def read_described(spark: SparkSession, ctl: str, names: Sequence[str] | None = None) -> DataFrame:
    """The flat binary that a descriptor stands for (see parse_ctl); ``^`` at its start is the descriptor's folder."""
    spec, rest = parse_ctl([r[0] for r in spark.read.text(ctl, wholetext=True).collect()][0].splitlines())  # one small file
    path = rest["dset"]
    return read_flat(spark, f"{ctl.rsplit('/', 1)[0]}/{path[1:]}" if path.startswith("^") else path, spec, names)


def _format(spec: FlatSpec, names: Sequence[str] | None, steps: tuple[int, int] | None, levels: tuple[int, int] | None, lines: int):
    size = np.dtype(TYPES[spec.kind]).itemsize
    blocks = -(-spec.ny // lines)
    # The levels that are wanted of each step, with the number before them in the step: (variable, level from 1, values before).
    held, before = [], 0
    for name, n in spec.variables:
        held += [(name, k + 1, before + k * spec.nx * spec.ny) for k in range(n) if (names is None or name in names) and (levels is None or levels[0] <= k + 1 <= levels[1])]
        before += n * spec.nx * spec.ny

    def plan(file, length, split):
        last = length // (size * spec.step_count())
        first, last = (max(1, steps[0]), min(last, steps[1])) if steps else (1, last)
        units = max(0, last - first + 1) * len(held) * blocks
        step = max(1, split // (lines * spec.nx * size))
        for a in range(0, units, step):
            yield {"first": first, "from": a, "to": min(a + step, units)}

    def read(file, path, piece):
        for u in range(piece["from"], piece["to"]):
            step, (name, k, at) = piece["first"] + u // (len(held) * blocks), held[u // blocks % len(held)]
            j = u % blocks * lines
            n = min(lines, spec.ny - j)
            v = np.frombuffer(read_exactly(file, size * ((step - 1) * spec.step_count() + at + j * spec.nx), size * n * spec.nx), spec.endian + TYPES[spec.kind]).astype(float)
            row = np.repeat(np.arange(j, j + n), spec.nx)
            missing = np.isnan(v) if spec.missing is None else np.isnan(v) | (np.abs(v - spec.missing) <= abs(spec.missing) * 1e-6)
            fixed = lambda x, m=len(v): np.full(m, x, np.int32)
            yield pa.RecordBatch.from_pydict({
                "path": [path] * len(v), "var": [name] * len(v), "step": fixed(step), "k": fixed(k), "j": ((spec.ny - row if spec.y_reverse else row + 1)).astype(np.int32),
                "i": np.tile(np.arange(1, spec.nx + 1, dtype=np.int32), n), "value": pa.array(v, mask=missing),
            })

    return plan, read


def read_flat(spark: SparkSession, path: str, spec: FlatSpec, names: Sequence[str] | None = None, steps: tuple[int, int] | None = None, levels: tuple[int, int] | None = None, split: int = SPLIT) -> DataFrame:
    """(path, var, step, k, j, i, value) of flat binaries; the missing value becomes null.

    names, steps and levels (first and last, from 1) choose what is read: the bytes of other variables, steps and levels are skipped. A file is read by as many
    tasks as it has ``split`` bytes, some rows of a level at a time.
    """
    lines = max(1, min(spec.ny, CHUNK // (spec.nx * 8)))
    return scan(spark, path, *_format(spec, names, steps, levels, lines), "path string, var string, step int, k int, j int, i int, value double", split)


def tiles_in(catalogue: DataFrame, lon0: float, lon1: float, lat0: float, lat1: float) -> DataFrame:
    """Tiles (lon0, lon1, lat0, lat1 columns) that overlap a domain; a range predicate that reaches the scan."""
    return catalogue.filter((F.col("lon0") <= lon1) & (F.col("lon1") >= lon0) & (F.col("lat0") <= lat1) & (F.col("lat1") >= lat0))


def mosaic(samples: DataFrame, least: float, columns: int) -> DataFrame:
    """Values below ``least`` become missing; columns repeat one turn to the west, so that domains may cross the seam."""
    clean = samples.withColumn("value", F.when(F.col("value") >= least, F.col("value")))
    return clean.unionByName(clean.withColumn("i", F.col("i") - columns))


def write_restart(state: DataFrame, path: str) -> None:
    """One folder per member."""
    state.write.mode("overwrite").partitionBy("member").parquet(path)
