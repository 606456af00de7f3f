"""Observation files: sequential records of single-precision numbers, and Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import CHUNK, SPLIT, read_exactly, scan

#: Element numbers.
ELEMENTS = {"U": 2819, "V": 2820, "T": 3073, "TV": 3074, "Q": 3330, "RH": 3331, "PS": 14593, "REF": 4001, "VR": 4002, "RE0": 4004}
#: Elements whose level is a pressure, in hPa in files.
PRESSURE_LEVEL = ("U", "V", "T", "TV", "Q", "RH")
COLUMNS = ("elm", "lon", "lat", "lev", "dat", "err", "typ", "dif")
SCHEMA = "path string, nth long, elm int, lon double, lat double, lev double, dat double, err double, typ int, dif double, meta array<double>"
RADAR_TYPE = 22


def records(raw: bytes, endian: str = ">") -> list[np.ndarray]:
    """The single-precision records of a sequential unformatted file, each between two byte counts, as arrays of rows of one length.

    Runs of records of one size are read at once: marks and bodies as a table of words.
    """
    out, at = [], 0
    while at + 8 <= len(raw):
        n = int(np.frombuffer(raw, f"{endian}i4", 1, at)[0])
        if n < 0 or n % 4 or at + 8 + n > len(raw):
            raise ValueError(f"broken record at byte {at}")
        width = n // 4 + 2
        most = (len(raw) - at) // (4 * width)
        marks = np.frombuffer(raw, f"{endian}i4", most * width, at).reshape(most, width)[:, [0, -1]]
        good = (marks == n).all(axis=1)
        run = most if good.all() else int(np.argmin(good))
        if not run:
            raise ValueError(f"broken record at byte {at}")
        out.append(np.frombuffer(raw, f"{endian}f4", run * width, at).reshape(run, width)[:, 1:-1])
        at += run * width * 4
    if at != len(raw):
        raise ValueError(f"broken record at byte {at}")
    return out


def encode(rows: Sequence[Sequence[float]], endian: str = ">") -> bytes:
    """Rows as such a file."""
    parts = []
    for row in rows:
        body = np.asarray(row, f"{endian}f4").tobytes()
        mark = np.array([len(body)], f"{endian}i4").tobytes()
        parts += [mark, body, mark]
    return b"".join(parts)


def _body(file: pa.NativeFile, length: int, kind: str, endian: str) -> tuple[list[float] | None, int, int]:
    """(numbers of a radar file's three header records, byte where rows begin, bytes of a row with its marks)."""
    meta, at = None, 0
    if kind == "radar":
        meta = []
        for _ in range(3):
            n = int(np.frombuffer(read_exactly(file, at, 4), f"{endian}i4")[0])
            meta.append(float(np.frombuffer(read_exactly(file, at + 4, 4), f"{endian}f4")[0]))
            at += n + 8
    width = int(np.frombuffer(read_exactly(file, at, 4), f"{endian}i4")[0]) + 8 if at < length else 8
    if width < 8 or width % 4 or (length - at) % width:
        raise ValueError(f"broken record behind byte {at}")
    return meta, at, width


def _format(kind: str, endian: str):
    def plan(file, length, split):
        meta, body, width = _body(file, length, kind, endian)
        step = max(1, split // width) * width
        for a in range(body, length, step):
            yield {"meta": meta, "first": (a - body) // width, "width": width, "from": a, "to": min(a + step, length)}

    def read(file, path, piece):
        width, nth = piece["width"], piece["first"]
        chunk = max(1, CHUNK // width) * width
        for a in range(piece["from"], piece["to"], chunk):
            table = np.frombuffer(read_exactly(file, a, min(chunk, piece["to"] - a)), f"{endian}i4").reshape(-1, width // 4)
            if (table[:, [0, -1]] != width - 8).any():
                raise ValueError(f"broken record behind byte {a}")
            v = table[:, 1:-1].view(f"{endian}f4").astype(float)
            if kind == "radar" and v.shape[1] == len(COLUMNS) - 1:
                v = np.c_[v, np.zeros(len(v))]
            columns = {"path": [path] * len(v), "nth": np.arange(nth, nth + len(v))} | {c: np.ascontiguousarray(v[:, k]) for k, c in enumerate(COLUMNS)}
            columns |= {c: columns[c].astype(np.int32) for c in ("elm", "typ")} | {"meta": pa.array([piece["meta"]] * len(v), pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(columns)
            nth += len(v)

    return plan, read


def read_records(spark: SparkSession, path: str, kind: str = "conventional", endian: str = ">", split: int = SPLIT) -> DataFrame:
    """Observations of all files at path. kind: conventional (8 columns, pressure levels to Pa) or radar (3 header records, 7 or 8 columns).

    The rows of a file have one length; a file is read by as many tasks as it has ``split`` bytes.
    """
    if kind not in ("conventional", "radar"):
        raise ValueError("kind must be conventional or radar")
    d = scan(spark, path, *_format(kind, endian), SCHEMA, split)
    if kind == "conventional":
        d = d.withColumn("lev", F.when(F.col("elm").isin([ELEMENTS[e] for e in PRESSURE_LEVEL]), F.col("lev") * 100).otherwise(F.col("lev")))
    return d


def read_sets(inputs: Sequence[DataFrame]) -> DataFrame:
    """Several inputs as one table: ``set`` numbers the input from 1, ``idx`` the rows of each from 1 in order of path and place."""
    tagged = [d.withColumn("set", F.lit(n)) for n, d in enumerate(inputs, 1)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    # Offsets of files first, so that no window holds more than the files of a set.
    counts = every.groupBy("set", "path").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("set").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("set", "path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return every.join(offsets, ["set", "path"]).withColumn("idx", F.col("_o") + F.col("nth") + 1).drop("_o")


def write_observations(obs: DataFrame, path: str, mode: str = "overwrite", drop_missing: bool = True, partition: Sequence[str] = ()) -> None:
    """Parquet; rows without a value are left out if asked. Levels stay in Pa."""
    out = obs.filter(F.col("dat").isNotNull()) if drop_missing else obs
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def read_ensemble(spark: SparkSession, path: str, columns: Sequence[str] | None = None, members: Sequence[int] | None = None, member: str = "member") -> DataFrame:
    """A table with one folder per member (member=1, member=2, ...), as one scan that prunes members and columns.

    columns: those that every member must have, which alone are read; a missing one, or a table that has no member folders, is an error. members: those to read.
    """
    d = spark.read.parquet(path)
    lost = [c for c in [member, *(columns or [])] if c not in d.columns]
    if lost:
        raise ValueError(f"no such columns at {path}: {', '.join(lost)}")
    if members is not None:
        d = d.filter(F.col(member).isin(list(members)))
    return d.select(member, *[c for c in columns if c != member]) if columns is not None else d


def decode_wide(reports: DataFrame, keys: Sequence[str], values: dict[str, str], errors: dict[str, float], hours: tuple[float, float], box: tuple[float, float, float, float]) -> DataFrame:
    """One row per element of wide reports: inside the open box of lon and lat, time in (from, to] hours, missing values dropped."""
    lon0, lon1, lat0, lat1 = box
    kept = reports.filter((F.col("lon") > lon0) & (F.col("lon") < lon1) & (F.col("lat") > lat0) & (F.col("lat") < lat1) & (F.col("hour") > hours[0]) & (F.col("hour") <= hours[1]))
    long = kept.unpivot([*keys, "lon", "lat", "hour"], list(values), "name", "dat").filter(F.col("dat").isNotNull())
    number, err = F.lit(None).cast("int"), F.lit(None).cast("double")
    for column, element in values.items():
        number = F.when(F.col("name") == column, ELEMENTS[element]).otherwise(number)
        err = F.when(F.col("name") == column, errors[column]).otherwise(err)
    return long.withColumn("elm", number).withColumn("err", err).drop("name")


def rain_error(value, share: float, least: float):
    """Error of a rain rate: a share of it, but at least so much."""
    return F.greatest(value * share, F.lit(least))
