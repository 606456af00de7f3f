"""Diagnostic files of an assimilation: groups of observations behind headers, as rows of observations.

A file is a sequence of records, each between two byte counts: a date, then for every group a header (kind, three characters; bytes of a name; numbers n of an
observation; number of observations; process) and a body: all names, then n single-precision numbers for every observation. A task finds the groups from
their headers, without reading bodies, and cuts them into ranges of observations: a group of any size is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .observations import ELEMENTS
from .ranges import SPLIT, read_exactly, scan

#: Elements of the kinds of groups that are observations here.
KINDS = {" uv": "U", "  t": "T", "  q": "Q", " ps": "PS"}
#: Report types of each platform number, first those in use, then those not used.
PLATFORMS = {
    1: ([120, 132, 220, 221, 232], [122, 222]),
    2: ([133, 233], []),
    3: ([130, 131, 135, 230, 231, 235], [134, 234]),
    4: ([241, 242, 243, 245, 246, 250, 251, 252, 253, 254, 257, 258, 259], [240, 244, 247, 248, 249, 255, 256]),
    5: ([223, 228, 229], [227]),
    6: ([224], []),
    8: ([181, 183, 187, 281, 284, 287], []),
    9: ([180, 182, 280, 282], []),
    10: ([], [191]),
    11: ([150, 152, 283], []),
    12: ([], [111, 210]),
    13: ([286], []),
    14: ([], [151, *range(156, 176)]),
    15: ([285], []),
    16: ([], [188, 288]),
    17: ([153], []),
    18: ([126], []),
    19: ([289], []),
    20: ([290], []),
}
#: Platform of other report types; the smallest inverse error and the quality marks that pass.
OTHER, LEAST_INVERSE, MARKS = 25, 1.0e-7, (0, 2)
SCHEMA = "path string, date int, group int, nth long, kind string, station string, numbers array<float>"


def _mark(file: pa.NativeFile, at: int, endian: str) -> int:
    return int(np.frombuffer(read_exactly(file, at, 4), f"{endian}i4")[0])


def _format(endian: str, most: int):
    def plan(file, length, split):
        date, at, group = _mark(file, 4, endian), 12, 0
        while at < length:
            if _mark(file, at, endian) != 19:
                raise ValueError(f"no header at byte {at}")
            head = read_exactly(file, at + 4, 19)
            name, numbers, n, _ = (int(x) for x in np.frombuffer(head, f"{endian}i4", 4, 3))
            body = at + 27
            size = n * (name + 4 * numbers)
            if _mark(file, body, endian) != size or _mark(file, body + 4 + size, endian) != size:
                raise ValueError(f"broken body at byte {body}")
            step = max(1, split // max(1, name + 4 * numbers))
            for a in range(0, n, step):
                yield {"date": date, "group": group, "kind": head[:3].decode("ascii"), "name": name, "numbers": numbers, "n": n, "at": body + 4, "from": a, "to": min(a + step, n)}
            at, group = body + size + 8, group + 1

    def read(file, path, piece):
        name, numbers = piece["name"], piece["numbers"]
        for a in range(piece["from"], piece["to"], most):
            n = min(most, piece["to"] - a)
            names = read_exactly(file, piece["at"] + a * name, n * name)
            values = np.frombuffer(read_exactly(file, piece["at"] + piece["n"] * name + 4 * a * numbers, 4 * n * numbers), f"{endian}f4").astype(np.float32)
            fixed = lambda x, k, n=n: pa.array([x] * n, k)
            yield pa.RecordBatch.from_arrays(
                [
                    fixed(path, pa.string()), fixed(piece["date"], pa.int32()), fixed(piece["group"], pa.int32()), pa.array(np.arange(a, a + n), pa.int64()), fixed(piece["kind"], pa.string()),
                    pa.array([names[k * name : (k + 1) * name].decode("latin-1").rstrip() for k in range(n)]), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * numbers), pa.array(values)),
                ],
                ["path", "date", "group", "nth", "kind", "station", "numbers"],
            )

    return plan, read


def read_diag(spark: SparkSession, path: str, endian: str = "<", split: int = SPLIT, rows_at_once: int = 50_000) -> DataFrame:
    """(path, date, group, nth, kind, station, numbers) of the observations of all files at path, groups and observations numbered from 0."""
    return scan(spark, path, *_format(endian, rows_at_once), SCHEMA, split)


def encode(date: int, groups: Sequence[tuple[str, Sequence[str], np.ndarray]], endian: str = "<", name: int = 8) -> bytes:
    """Such a file. groups: (kind, names, numbers of each observation)."""
    mark = lambda n: np.array([n], f"{endian}i4").tobytes()
    record = lambda body: mark(len(body)) + body + mark(len(body))
    out = record(mark(date))
    for kind, names, numbers in groups:
        a = np.asarray(numbers, f"{endian}f4")
        out += record(kind.encode().ljust(3)[:3] + mark(name) + mark(a.shape[1]) + mark(len(names)) + mark(0))
        out += record(b"".join(n.encode().ljust(name)[:name] for n in names) + a.tobytes())
    return out


def platform(report: Column) -> tuple[Column, Column]:
    """(platform number, whether it is used) of report types."""
    number, used = F.lit(OTHER), F.lit(True)
    for p, (good, bad) in PLATFORMS.items():
        number = F.when(report.isin(good + bad), p).otherwise(number)
        if bad:
            used = used & ~report.isin(bad)
    return number, used


def diag_observations(rows: DataFrame) -> DataFrame:
    """Observations of :func:`read_diag`'s rows: elm, lon, lat, lev, dat, err, typ, dif, hx, used, with path, group, nth and station.

    Kinds other than KINDS are left out; a wind gives a row for each component. The level is the pressure in hPa, of a surface pressure the station's height. hx is the observation minus
    its departure, of a surface pressure in Pa. An observation is not used when its inverse error is too small (its error is then 1e10), its platform isn't in use or
    its quality mark is out of bounds.
    """
    v = lambda n: F.get("numbers", F.lit(n - 1)).cast("double")
    number, in_use = platform(F.round(v(1)).cast("int"))
    inverse, mark, ps = v(16), F.round(v(9)), F.col("kind") == " ps"
    used = in_use & (inverse >= LEAST_INVERSE) & mark.between(*MARKS)
    component = lambda elm, a, b: F.struct(elm.alias("elm"), v(a).alias("dat"), (v(a) - v(b)).alias("hx"))
    first = F.lit(None).cast("int")
    for kind, element in KINDS.items():
        first = F.when(F.col("kind") == kind, ELEMENTS[element]).otherwise(first)
    each = F.when(F.col("kind") == " uv", F.array(component(first, 17, 18), component(F.lit(ELEMENTS["V"]), 20, 21))).otherwise(F.array(component(first, 17, 18)))
    out = rows.filter(F.col("kind").isin(list(KINDS))).select("*", F.explode(each).alias("o"))
    return out.select(
        "path", "group", "nth", "station", "o.elm", v(4).alias("lon"), v(3).alias("lat"), F.when(ps, v(5)).otherwise(v(6)).alias("lev"), "o.dat",
        F.when(inverse < LEAST_INVERSE, 1.0e10).otherwise(F.try_divide(F.lit(1.0), inverse)).alias("err"), number.alias("typ"), v(8).alias("dif"), F.when(ps, F.col("o.hx") * 100).otherwise(F.col("o.hx")).alias("hx"), used.alias("used"),
    )


def diag_counts(observations: DataFrame) -> DataFrame:
    """Numbers of observations by element and platform, all and used."""
    return observations.groupBy("elm", "typ").agg(F.count(F.lit(1)).alias("n_all"), F.sum(F.col("used").cast("long")).alias("n_used"))
