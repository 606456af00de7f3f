"""Scans of binary files by byte ranges: a large file is read by many tasks, each a few megabytes at a time.

A format says how a file is cut (``plan``) and how a piece is read (``read``); both get a file that can be sought in. Files are listed by Spark without their contents,
cut by tasks that read no more than their headers, and the pieces are dealt evenly to as many tasks as there are ``split`` bytes. A piece is a range of whole records, so that no
task needs its neighbours.

Pieces are opened by Arrow's file systems (local and shared folders, HDFS, object stores). A path of another kind, which only Spark can open, is read by whole files, of
2 GB at most, through the same two functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a task's pieces, of what it reads at a time, and pieces of one message between tasks.
SPLIT, CHUNK = 64 << 20, 4 << 20


def opened(path: str) -> pa.NativeFile:
    """A file by its address as Spark gives it."""
    system, inside = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
    return system.open_input_file(inside)


def can_open(path: str) -> bool:
    try:
        fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def read_exactly(file: pa.NativeFile, at: int, n: int) -> bytes:
    file.seek(at)
    out = file.read(n)
    if len(out) != n:
        raise ValueError(f"the file ends at byte {at + len(out)}, not {at + n}")
    return out


def scan(spark: SparkSession, path: str, plan: Callable[[pa.NativeFile, int, int], Iterator[dict]], read: Callable[[pa.NativeFile, str, dict], Iterator[pa.RecordBatch]], ddl: str, split: int = SPLIT) -> DataFrame:
    """The rows (ddl) of all files at path. plan(file, length, split) gives pieces as plain dicts; read(file, path, piece) the rows of one."""
    listed = spark.read.format("binaryFile").load(path)
    found = listed.agg(F.coalesce(F.sum("length"), F.lit(0)), F.min("path")).first()
    if found[1] is not None and not can_open(found[1]):

        def whole(batches):
            for batch in batches:
                for p, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    file = pa.BufferReader(content.as_buffer())
                    for piece in plan(file, file.size(), split):
                        yield from read(file, p, piece)

        return listed.select("path", "content").mapInArrow(whole, ddl)

    def cut(batches):
        for batch in batches:
            for p, n in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with opened(p) as file:
                    pieces = [json.dumps(x) for x in plan(file, n, split)]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(pieces), pa.string()), pa.array(pieces, pa.string())], ["path", "piece"])

    def rows(batches):
        for batch in batches:
            for p, piece in zip(batch.column("path").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                with opened(p) as file:
                    yield from read(file, p, json.loads(piece))

    pieces = listed.select("path", "length").mapInArrow(cut, "path string, piece string")
    return pieces.repartition(max(1, -(-int(found[0]) // split))).mapInArrow(rows, ddl)
