"""Removal of covered byte ranges from texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that ranges [start, end) cover; ranges that touch or overlap are one run."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.r_[True, start[1:] > reach[:-1]]
    return start[first], reach[np.r_[np.flatnonzero(first)[1:] - 1, len(start) - 1]]


#: Rows of a batch, at most; batches are cut by bytes too (see number_batches).
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
RANGE = np.dtype([("uid", "<i8"), ("start", "<i8"), ("end", "<i8")])
PACKED = pa.schema([("batch", pa.int64()), ("ranges", pa.binary())])


def _number(batches):
    from pyspark import TaskContext

    number, rows, size = TaskContext.get().partitionId() << 23, 0, 0
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).tolist()
        uid = []
        for n in lengths:
            if rows == BATCH_ROWS or rows and size + n > BATCH_BYTES:
                number, rows, size = number + 1, 0, 0
            uid.append(number * BATCH_ROWS + rows)
            rows, size = rows + 1, size + n
        yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), *batch.columns, pa.array(lengths, pa.int64())], ["uid", "doc_id", "text", "n_bytes"])


def number_batches(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id, text, n_bytes of each row, saved. uid is the row's own; rows with the same uid div BATCH_ROWS are a batch.

    A batch is of consecutive rows of one task, at most BATCH_ROWS and, but for a longer single text, BATCH_BYTES. The
    numbers are stored with the rows, so that they stay the same however often and by however many cores the table is read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return scratch.save(plain.mapInArrow(_number, "uid long, doc_id long, text string, n_bytes long"), "zstd")


def total_bytes(numbered: DataFrame) -> int:
    return numbered.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]


def packed(lost: np.ndarray) -> pa.RecordBatch:
    """Ranges (RANGE records) merged into runs, one packed row for each batch of documents."""
    lost = lost[np.lexsort((lost["start"], lost["uid"]))]
    uid, start, reach = lost["uid"], lost["start"], lost["end"].copy()
    if len(lost):
        # Runs inside each document: ends are made to rise over documents by steps larger than any text.
        step = int(reach.max()) + 2
        nth = np.cumsum(np.r_[0, uid[1:] != uid[:-1]]) * step
        start, reach = start + nth, np.maximum.accumulate(reach + nth)
        first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
        last = np.r_[first[1:] - 1, len(lost) - 1]
        out = np.empty(len(first), RANGE)
        out["uid"], out["start"], out["end"] = uid[first], start[first] - nth[first], reach[last] - nth[first]
        lost = out
    batch = lost["uid"] // BATCH_ROWS
    cut = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]]) if len(lost) else np.empty(0, int)
    blobs = [lost[a:b].tobytes() for a, b in zip(cut, np.r_[cut[1:], len(lost)][: len(cut)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(batch[cut], pa.int64()), pa.array(blobs, pa.binary())], schema=PACKED)


def _cut(keep_text: bool):
    def run(key, docs, ranges):
        lost = np.frombuffer(b"".join(ranges.column("ranges").to_pylist()), RANGE)
        lost = lost[np.argsort(lost["uid"], kind="stable")]
        rows = []
        for uid, doc, text in zip(*(docs.column(c) for c in ("uid", "doc_id", "text")), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            own = lost[np.searchsorted(lost["uid"], uid.as_py(), "left") : np.searchsorted(lost["uid"], uid.as_py(), "right")]
            a, b = runs(own["start"], own["end"])
            if len(a):
                at = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[i:j] for i, j in zip(at[::2], at[1::2], strict=True))
            else:
                kept = raw
            rows.append((doc.as_py(), len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] if keep_text else [])))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * (5 + keep_text)
        kinds = [pa.int64()] * 4 + [pa.string()] * (1 + keep_text)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if keep_text else [])])

    return run


def cut_ranges(docs: DataFrame, ranges: DataFrame, keep_text: bool) -> DataFrame:
    """docs (uid, doc_id, text) without the byte ranges that ranges (batch, packed RANGE records) has for them."""
    batched = docs.select("uid", "doc_id", "text", F.expr(f"uid div {BATCH_ROWS}").alias("batch"))
    return batched.groupBy("batch").cogroup(ranges.groupBy("batch")).applyInArrow(_cut(keep_text), CUT + (", text string" if keep_text else ""))
