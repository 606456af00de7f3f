"""Spectral projection of horizontal vectors on doubly periodic, staggered grids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a complex vector: real and imaginary parts of both components.
PARTS = ("ur", "ui", "vr", "vi")


def _rows(batch: pa.RecordBatch, axis: str, n: int, names: Sequence[str]) -> np.ndarray:
    """(rows, n, names) of a list column of structs (axis, names...); places without a value are zero."""
    lists = batch.column("line")
    own = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    out = np.zeros((batch.num_rows, n, len(names)))
    for k, name in enumerate(names):
        out[own, flat.field(axis).to_numpy(zero_copy_only=False), k] = np.nan_to_num(flat.field(name).to_numpy(zero_copy_only=False).astype(float))
    return out


def _spread(batch: pa.RecordBatch, keep: Sequence[str], axis: str, at: np.ndarray, values: np.ndarray, names: Sequence[str]) -> pa.RecordBatch:
    """A row for each place of each of the batch's rows; values: (rows, places, names)."""
    n = len(at)
    rows = pa.array(np.repeat(np.arange(batch.num_rows), n))
    columns = [batch.column(c).take(rows) for c in keep] + [pa.array(np.tile(at, batch.num_rows), pa.int64())]
    return pa.RecordBatch.from_arrays(columns + [pa.array(np.ascontiguousarray(values[:, :, k]).ravel()) for k in range(len(names))], [*keep, axis, *names])


def _lines(df: DataFrame, by: Sequence[str], axis: str, names: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.collect_list(F.struct(F.col(axis).alias(axis), *names)).alias("line"))


def divergence_free(cells: DataFrame, i: str, j: str, u: str, v: str, ni: int, nj: int, most_i: int, most_j: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, j, u, v) without horizontal divergence, of wavenumbers up to most_i and most_j.

    cells: a grid 0 .. ni - 1, 0 .. nj - 1 whose u lies half a cell further along i and whose v half a cell further along j; a missing value counts as zero. Wavenumbers are taken on
    the plane of indexes (both axes have the length of a turn), means stay as they are. Of each pair of wavenumbers (l, m) the part along (l, m) is taken off both components together:
    (u, v) - (l, m) (l u + m v) / (l l + m m).

    A line of the grid is one array. Lines become spectra along i, these meet by wavenumber, get their spectra along j, are projected and go back along j, and
    meet again by line: three shuffles, the inner two of which carry only the wavenumbers that are kept.
    """
    if not (0 <= 2 * most_i < ni and 0 <= 2 * most_j < nj):
        raise ValueError("wavenumbers must lie below half the number of points")
    kinds = dict(cells.dtypes)
    keep = ", ".join(f"{k} {kinds[k]}" for k in keys) + (", " if keys else "")
    x, y = 2 * np.pi * np.arange(ni) / ni, 2 * np.pi * np.arange(nj) / nj
    ls, ms = np.arange(most_i + 1), np.arange(-most_j, most_j + 1)
    # Waves at the places of u and of v.
    along = [np.exp(-1j * np.outer(x + s, ls)) for s in (np.pi / ni, 0.0)]
    across = [np.exp(-1j * np.outer(y + s, ms)) for s in (0.0, np.pi / nj)]
    share = np.where(ls == 0, 1.0, 2.0) / (ni * nj)
    parts = ", ".join(f"{p} double" for p in PARTS)

    def forward(batches):
        for batch in batches:
            f = _rows(batch, "_i", ni, ("u", "v"))
            c = [f[:, :, n] @ along[n] for n in range(2)]
            yield _spread(batch, [*keys, "_j"], "_l", ls, np.stack([c[0].real, c[0].imag, c[1].real, c[1].imag], axis=2), PARTS)

    def project(batches):
        for batch in batches:
            f = _rows(batch, "_j", nj, PARTS)
            a, b = ((f[:, :, 2 * n] + 1j * f[:, :, 2 * n + 1]) @ across[n] for n in range(2))
            wave = batch.column("_l").to_numpy()[:, None].astype(float)
            size = wave**2 + ms[None, :] ** 2
            off = np.where(size > 0, (wave * a + ms * b) / np.where(size > 0, size, 1.0), 0.0)
            a, b = (a - wave * off) @ across[0].conj().T, (b - ms * off) @ across[1].conj().T
            yield _spread(batch, [*keys, "_l"], "_j", np.arange(nj), np.stack([a.real, a.imag, b.real, b.imag], axis=2), PARTS)

    def back(batches):
        for batch in batches:
            f = _rows(batch, "_l", most_i + 1, PARTS)
            out = [((f[:, :, 2 * n] + 1j * f[:, :, 2 * n + 1]) * share @ along[n].conj().T).real for n in range(2)]
            yield _spread(batch, [*keys, "_j"], "_i", np.arange(ni), np.stack(out, axis=2), ("u", "v"))

    plain = cells.select(*keys, F.col(i).cast("long").alias("_i"), F.col(j).cast("long").alias("_j"), F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v"))
    waves = _lines(plain, [*keys, "_j"], "_i", ["u", "v"]).mapInArrow(forward, f"{keep}_j long, _l long, {parts}")
    free = _lines(waves, [*keys, "_l"], "_j", PARTS).mapInArrow(project, f"{keep}_l long, _j long, {parts}")
    out = _lines(free, [*keys, "_j"], "_l", PARTS).mapInArrow(back, f"{keep}_j long, _i long, u double, v double")
    return out.select(*keys, F.col("_i").alias(i), F.col("_j").alias(j), F.col("u").alias(u), F.col("v").alias(v))
