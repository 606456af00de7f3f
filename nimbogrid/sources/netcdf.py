"""NetCDF classic files (CDF-1, CDF-2 and CDF-5) as tables of values, and tables as such files.

A variable becomes one row per value, with its indexes (from 0) in the order of its dimensions and, where dimensions have
coordinate variables, their values; what equals ``_FillValue`` or ``missing_value`` is null, ``scale_factor`` and ``add_offset`` are
applied. Executors read the files; the driver sees none of them. Files of the HDF5-based format are not read: an error says so.

Files at a path are read by byte ranges (:mod:`.ranges`): a large one by many tasks, and of each only the variables that are asked for. Files in a column of a
table (:func:`decode`) and files that are written are one task's work each, as process files of a decomposed domain are.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import CHUNK, SPLIT, read_exactly, scan

#: Fixed values of the format: number types by code.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_CODES = {"int16": 3, "int32": 4, "float32": 5, "float64": 6}
#: Fixed values of the format: tags of its lists.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
#: Records of fewer bytes are read together with what lies between them.
GAP = 64 << 10


class Header:
    """Dimensions, attributes and variables of a file: dims [(name, size)], attributes {name: value}, variables {name: (dims, attributes, type, offset)}."""

    def __init__(self, raw: bytes, size: int | None = None):
        self.raw, self.at = raw, 4
        if raw[:3] != b"CDF" or raw[3:4] not in (b"\1", b"\2", b"\5"):
            raise ValueError("not a classic NetCDF file" + (" but an HDF5 one" if raw[:4] == b"\x89HDF" else ""))
        self.version = raw[3]
        self.records = self._count()
        self.dims = [(self._name(), self._count()) for _ in range(self._list(DIMENSION))]
        self.attributes = self._attributes()
        self.variables = {}
        for _ in range(self._list(VARIABLE)):
            name = self._name()
            dims = [self._count() for _ in range(self._count())]
            attributes, kind = self._attributes(), self._int()
            self._count()  # its size, which follows from its shape
            self.variables[name] = (dims, attributes, TYPES[kind], self._take(">i4" if self.version == 1 else ">i8"))
        records = [self.row_bytes(v) for v in self.variables if self.is_record(v)]
        # A single record variable is not padded.
        self.record_bytes = records[0] if len(records) == 1 else sum(-(-n // 4) * 4 for n in records)
        if self.records < 0 and self.record_bytes:
            # A file that is still written: as many records as it has bytes for.
            self.records = ((len(raw) if size is None else size) - min(v[3] for n, v in self.variables.items() if self.is_record(n))) // self.record_bytes

    def _take(self, kind: str) -> int:
        v = int(np.frombuffer(self.raw, kind, 1, self.at)[0])
        self.at += int(kind[-1])
        return v

    def _int(self) -> int:
        return self._take(">i4")

    def _count(self) -> int:
        return self._take(">i8" if self.version == 5 else ">i4")

    def _bytes(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        if len(out) != n:
            raise ValueError("the header ends early")
        self.at += -(-n // 4) * 4
        return out

    def _name(self) -> str:
        return self._bytes(self._count()).decode()

    def _list(self, tag: int) -> int:
        found, n = self._int(), self._count()
        if found not in (0, tag):
            raise ValueError("broken NetCDF header")
        return n

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list(ATTRIBUTE)):
            name, kind = self._name(), TYPES[self._int()]
            n = self._count()
            body = self._bytes(n * np.dtype(kind).itemsize)
            out[name] = body.decode("utf-8", "replace") if kind == "S1" else np.frombuffer(body, kind)
        return out

    def is_record(self, name: str) -> bool:
        dims = self.variables[name][0]
        return bool(dims) and self.dims[dims[0]][1] == 0

    def shape(self, name: str) -> tuple[int, ...]:
        return tuple(self.dims[d][1] or self.records for d in self.variables[name][0])

    def row_bytes(self, name: str) -> int:
        dims, _, kind, _ = self.variables[name]
        return int(np.prod([self.dims[d][1] for d in dims[self.is_record(name) :]], dtype=np.int64)) * np.dtype(kind).itemsize

    def values(self, name: str) -> np.ndarray:
        """The variable as numbers, missing ones nan."""
        _, _, kind, offset = self.variables[name]
        if kind == "S1":
            raise ValueError(f"{name} holds text")
        shape, n = self.shape(name), self.row_bytes(name)
        if self.is_record(name):
            size = np.dtype(kind).itemsize
            a = np.ndarray((shape[0], n // size), kind, self.raw, offset, (self.record_bytes, size)) if shape[0] else np.empty(0, kind)
        else:
            a = np.frombuffer(self.raw, kind, n // np.dtype(kind).itemsize, offset)
        return self.scaled(name, a).reshape(shape)

    def scaled(self, name: str, stored: np.ndarray) -> np.ndarray:
        """Numbers of a variable as stored, with missing ones nan, scale and offset applied."""
        attributes, out = self.variables[name][1], stored.astype(float)
        for key in ("_FillValue", "missing_value"):
            if key in attributes and not isinstance(attributes[key], str):
                out = np.where(out == float(attributes[key][0]), np.nan, out)
        number = lambda key, other: float(attributes[key][0]) if key in attributes else other
        return out * number("scale_factor", 1.0) + number("add_offset", 0.0)


def _coordinate(head: Header, dim: int) -> np.ndarray | None:
    name = head.dims[dim][0]
    if name in head.variables and head.variables[name][0] == [dim] and head.variables[name][2] != "S1":
        return head.values(name)
    return None


def _rows(names: Sequence[str] | None, most: int):
    def run(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                head = Header(bytes(raw))
                for name in head.variables if names is None else [n for n in names if n in head.variables]:
                    dims, attributes, kind, _ = head.variables[name]
                    if kind == "S1":
                        continue
                    v = head.values(name)
                    flat, axes = v.ravel(), [_coordinate(head, d) for d in dims]
                    for a in range(0, len(flat), most):
                        at = np.unravel_index(np.arange(a, min(a + most, len(flat))), v.shape) if v.ndim else ()
                        own = flat[a : a + most]
                        index = np.stack(at, axis=1).astype(np.int64) if v.ndim else np.empty((len(own), 0), np.int64)
                        place = np.full(index.shape, np.nan)
                        for n, x in enumerate(axes):
                            if x is not None:
                                place[:, n] = x[index[:, n]]
                        d = pd.DataFrame({"path": path, "var": name, "index": list(index), "place": list(place), "value": own, "unit": str(attributes.get("units", ""))})
                        d["value"] = d["value"].astype(object).where(~np.isnan(own), None)
                        yield d

    return run


def header_of(file: pa.NativeFile) -> Header:
    """The header of a file that can be sought in, from as many bytes as it has."""
    n, size = 1 << 16, file.size()
    while True:
        try:
            return Header(read_exactly(file, 0, min(n, size)), size)
        except (ValueError, IndexError):
            if n >= size or file.size() < 4 or read_exactly(file, 0, 3) != b"CDF":
                raise
            n *= 8


def values_between(file: pa.NativeFile, head: Header, name: str, a: int, b: int) -> np.ndarray:
    """Values a .. b - 1 of a variable in the order of its dimensions, missing ones nan; only their bytes are read, or records with gaps where these are small."""
    _, attributes, kind, offset = head.variables[name]
    size = np.dtype(kind).itemsize
    if not head.is_record(name):
        return head.scaled(name, np.frombuffer(read_exactly(file, offset + a * size, (b - a) * size), kind))
    own = head.row_bytes(name) // size
    out = []
    while a < b:
        r, c = divmod(a, own)
        whole = (b - a) // own if c == 0 else 0
        if whole and own * size < GAP:
            # Many small records: read at once with what lies between them.
            n = min(whole, max(1, CHUNK // head.record_bytes))
            raw = read_exactly(file, offset + r * head.record_bytes, (n - 1) * head.record_bytes + own * size)
            out.append(np.ndarray((n, own), kind, raw, 0, (head.record_bytes, size)).ravel())
            a += n * own
        else:
            n = min(own - c, b - a)
            out.append(np.frombuffer(read_exactly(file, offset + r * head.record_bytes + c * size, n * size), kind))
            a += n
    return head.scaled(name, np.concatenate(out) if out else np.empty(0, kind))


def _format(names: Sequence[str] | None, most: int):
    def plan(file, length, split):
        head, pieces, held = header_of(file), [], 0
        for name in head.variables if names is None else [n for n in names if n in head.variables]:
            kind = head.variables[name][2]
            total, size = int(np.prod(head.shape(name), dtype=np.int64)), np.dtype(kind).itemsize
            a = 0
            while kind != "S1" and a < total:
                b = min(total, a + max(1, (split - held) // size))
                pieces.append([name, a, b])
                held, a = held + (b - a) * size, b
                if held >= split:
                    yield {"pieces": pieces}
                    pieces, held = [], 0
        if pieces:
            yield {"pieces": pieces}

    def read(file, path, piece):
        head, axes = header_of(file), {}
        for name, first, last in piece["pieces"]:
            dims, attributes = head.variables[name][:2]
            for d in dims:
                if d not in axes:
                    own = head.dims[d][0]
                    held = own in head.variables and head.variables[own][0] == [d] and head.variables[own][2] != "S1"
                    axes[d] = values_between(file, head, own, 0, int(np.prod(head.shape(own)))) if held else None
            shape = head.shape(name)
            for a in range(first, last, most):
                b = min(last, a + most)
                v = values_between(file, head, name, a, b)
                index = np.stack(np.unravel_index(np.arange(a, b), shape), axis=1).astype(np.int64) if shape else np.empty((1, 0), np.int64)
                place = np.full(index.shape, np.nan)
                for n, d in enumerate(dims):
                    if axes[d] is not None:
                        place[:, n] = axes[d][index[:, n]]
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * index.shape[1])
                yield pa.RecordBatch.from_pydict({
                    "path": [path] * len(v), "var": [name] * len(v), "index": pa.ListArray.from_arrays(ends, pa.array(index.ravel(), pa.int64())),
                    "place": pa.ListArray.from_arrays(ends, pa.array(place.ravel(), pa.float64(), mask=np.isnan(place.ravel()))), "value": pa.array(v, pa.float64(), mask=np.isnan(v)), "unit": [str(attributes.get("units", ""))] * len(v),
                })

    return plan, read


def read_netcdf(spark: SparkSession, path: str, names: Sequence[str] | None = None, rows_at_once: int = 200_000, split: int = SPLIT) -> DataFrame:
    """(path, var, index, place, value, unit) of the numbers of files: all variables, or the named ones. place has the coordinates, null where a dimension has none.

    A file is read by as many tasks as it has ``split`` bytes; each reads the header, the coordinates and its own ranges, and nothing of other variables.
    """
    return scan(spark, path, *_format(names, rows_at_once), "path string, var string, index array<long>, place array<double>, value double, unit string", split)


def decode(files: DataFrame, names: Sequence[str] | None = None, rows_at_once: int = 200_000) -> DataFrame:
    """The table of read_netcdf from files (path, content)."""
    rows = files.select("path", "content").mapInPandas(_rows(names, rows_at_once), "path string, var string, index array<long>, place array<double>, value double, unit string")
    return rows.withColumn("place", F.transform("place", lambda v: F.when(~F.isnan(v), v)))


CATALOGUE = (("path", pa.string()), ("var", pa.string()), ("dims", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("unit", pa.string()))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue: (path, var, dims, sizes, unit) of each variable of files."""

    def plan(file, length, split):
        yield {}

    def read(file, path, piece):
        head = header_of(file)
        out = [(path, n, [head.dims[d][0] for d in v[0]], list(head.shape(n)), str(v[1].get("units", ""))) for n, v in head.variables.items()]
        yield pa.RecordBatch.from_pydict({c: pa.array([x[k] for x in out], kind) for k, (c, kind) in enumerate(CATALOGUE)})

    return scan(spark, path, plan, read, "path string, var string, dims array<string>, sizes array<long>, unit string")


def variable(table: DataFrame, name: str, axes: Sequence[str], coordinates: bool = False) -> DataFrame:
    """One variable of read_netcdf's table with a column per dimension: indexes, or coordinates."""
    source = "place" if coordinates else "index"
    return table.filter(F.col("var") == name).select("path", *[F.get(source, F.lit(n)).alias(a) for n, a in enumerate(axes)], F.col("value").alias(name))


def radar_observations(table: DataFrame, elements: dict[str, int], errors: dict[str, float], typ: int = 22) -> DataFrame:
    """Radar observations of a file whose variables lie over (time, z, lat, lon) coordinates: one row per value that is not missing."""
    kept = table.filter(F.col("var").isin(list(elements)) & F.col("value").isNotNull() & (F.size("place") == 4))
    number, err = F.lit(None).cast("int"), F.lit(None).cast("double")
    for name, e in elements.items():
        number, err = F.when(F.col("var") == name, e).otherwise(number), F.when(F.col("var") == name, errors[name]).otherwise(err)
    at = lambda n: F.get("place", F.lit(n))
    return kept.select("path", number.alias("elm"), at(3).alias("lon"), at(2).alias("lat"), at(1).alias("lev"), F.col("value").alias("dat"), err.alias("err"), F.lit(typ).alias("typ"), at(0).alias("dif"))


def encode(dims: Sequence[tuple[str, int]], variables: dict[str, tuple[Sequence[str], np.ndarray, dict]], attributes: dict | None = None, unlimited: str | None = None) -> bytes:
    """A CDF-2 file. variables: {name: (names of dimensions, numbers, attributes)}; the unlimited dimension comes first in those that have it."""
    order = [n for n, _ in dims]
    size = dict(dims)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(">i", len(s.encode())) + pad(s.encode())

    def attribute_list(held: dict) -> bytes:
        if not held:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", ATTRIBUTE, len(held))
        for name, value in held.items():
            if isinstance(value, str):
                out += text(name) + struct.pack(">ii", 2, len(value.encode())) + pad(value.encode())
            else:
                a = np.atleast_1d(np.asarray(value))
                code = _CODES[str(a.dtype)] if str(a.dtype) in _CODES else 6
                out += text(name) + struct.pack(">ii", code, len(a)) + pad(a.astype(TYPES[code]).tobytes())
        return out

    bodies, kinds = {}, {}
    for name, (_, a, _) in variables.items():
        kinds[name] = _CODES[str(a.dtype)]
        bodies[name] = np.ascontiguousarray(a.astype(TYPES[kinds[name]]))
    record = {n: bool(unlimited and v[0] and v[0][0] == unlimited) for n, v in variables.items()}
    row = {n: b.nbytes // max(1, len(b)) if record[n] else b.nbytes for n, b in bodies.items()}
    step = {n: row[n] if record[n] and sum(record.values()) == 1 else -(-row[n] // 4) * 4 for n in bodies}

    def header(offset: dict) -> bytes:
        out = b"CDF\2" + struct.pack(">i", size[unlimited] if unlimited else 0)
        out += struct.pack(">ii", DIMENSION if dims else 0, len(dims)) + b"".join(text(n) + struct.pack(">i", 0 if n == unlimited else s) for n, s in dims)
        out += attribute_list(attributes or {}) + struct.pack(">ii", VARIABLE if variables else 0, len(variables))
        for name, (own, _, held) in variables.items():
            out += text(name) + struct.pack(">i", len(own)) + b"".join(struct.pack(">i", order.index(d)) for d in own)
            out += attribute_list(held) + struct.pack(">iiq", kinds[name], -(-row[name] // 4) * 4, offset[name])
        return out

    at, offset = len(header(dict.fromkeys(variables, 0))), {}
    for name in [n for n in variables if not record[n]]:
        offset[name], at = at, at + step[name]
    for name in [n for n in variables if record[n]]:
        offset[name], at = at, at + step[name]
    out = header(offset) + b"".join(pad(bodies[n].tobytes()) for n in variables if not record[n])
    for k in range(size[unlimited] if unlimited else 0):
        for name in [n for n in variables if record[n]]:
            body = bodies[name][k : k + 1].tobytes()
            out += body + b"\0" * (step[name] - len(body))
    return out


def files_of(fields: DataFrame, file: str, axes: Sequence[str], sizes: dict[str, int], names: Sequence[str], fill: float = -9.99e33) -> DataFrame:
    """(file, content): a NetCDF file for each value of ``file``, of the named columns of fields over the axes (indexes from 0).

    One group, a file, is one task's work. content goes into any table or, row by row, to where files are wanted.
    """
    dims = [(a, sizes[a]) for a in axes]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = tuple(pdf[a].to_numpy(int) for a in axes)
        variables = {}
        for n in names:
            v = np.full([s for _, s in dims], fill)
            own = pdf[n].to_numpy(float, na_value=np.nan)
            v[at] = np.where(np.isnan(own), fill, own)
            variables[n] = (list(axes), v, {"_FillValue": fill})
        return pd.DataFrame({"file": [str(pdf[file].iloc[0])], "content": [encode(dims, variables)]})

    return fields.select(file, *axes, *names).groupBy(file).applyInPandas(run, "file string, content binary")
