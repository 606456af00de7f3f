"""Words, lines and byte classes of Arrow text columns, read straight from their buffers.

A slab is a run of rows whose texts hold about ``SLAB`` bytes together; a longer text has a slab of its own, so that memory is bounded by
the larger of the two. Offsets are in the slab's UTF-8 bytes. Nulls are empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import Prefix

SLAB = 4 << 20
#: Bytes that are compared at a time when equal hashes are verified.
COMPARED = 1 << 20


def byte_class(characters: str) -> np.ndarray:
    """Whether each byte value is one of the (ASCII) characters."""
    return np.isin(np.arange(256), np.frombuffer(characters.encode(), np.uint8))


SPACE = byte_class(" \t\n\v\f\r")
CAPITAL = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Bytes that are letters: ASCII letters, and every byte of other characters.
LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
#: Bytes with which a code point begins.
LEAD = (np.arange(256) & 0xC0) != 0x80


def slabs(batch: pa.RecordBatch, column: str, most: int = SLAB):
    """(rows of the batch, their texts as bytes, offsets of the texts) for each slab; the arrays are views of Arrow's buffers."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.empty(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield batch.slice(a, b - a), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def upto(flags: np.ndarray) -> np.ndarray:
    """Prefix sums: how many flags are set before each place, and at the end."""
    out = np.zeros(len(flags) + 1, np.uint32 if len(flags) < 1 << 32 else np.uint64)
    np.cumsum(flags, out=out[1:], dtype=out.dtype)
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags set in each range [start, end), from prefix sums."""
    return sums[end].astype(np.int64) - sums[start].astype(np.int64)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return between(upto(flags), offsets[:-1], offsets[1:])


def words(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the longest runs of bytes that are inside; no run crosses the end of a text."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    held = offsets[1:] > offsets[:-1]
    begins, ends = offsets[:-1][held], offsets[1:][held] - 1
    first[begins] |= inside[begins]
    last[ends] |= inside[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""(start, end, text) of the lines of each text, cut at \n; an empty text is one empty line."""
    cut = np.flatnonzero(raw == 10)
    own = np.repeat(np.arange(len(offsets) - 1), 1 + np.diff(np.searchsorted(cut, offsets)))
    return np.sort(np.r_[offsets[:-1], cut + 1]), np.sort(np.r_[cut, offsets[1:]]), own


def within(start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Whether each of size bytes is in one of the ranges, which do not overlap."""
    edge = np.zeros(size + 1, np.int8)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def codes(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each of consecutive strings, equal for equal strings only, and the distinct strings in the order of their numbers."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    strings = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    found = strings.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def windows(code: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """A number for the window of ``width`` words from each word on, equal for equal windows only; -1 where a text ends first."""
    n = max(0, len(code) - width + 1)
    out, size = code[:n].astype(np.int64), int(code.max(initial=0)) + 1
    for k in range(1, width):
        out = out * size + code[k : n + k]
        if k < width - 1 and size ** (k + 2) >= 1 << 63:
            out = np.unique(out, return_inverse=True)[1]
    full = np.full(len(code), -1, np.int64)
    full[:n] = np.where(text[:n] == text[width - 1 :], out, -1)
    return full


def _differ(raw: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes at a and at b differ, for each of many."""
    out, ends = np.zeros(len(a), bool), np.cumsum(n)
    x = 0
    while x < len(a):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + COMPARED, "right")))
        step = np.arange(int(n[x:y].sum())) - np.repeat(np.cumsum(n[x:y]) - n[x:y], n[x:y])
        bad = raw[np.repeat(a[x:y], n[x:y]) + step] != raw[np.repeat(b[x:y], n[x:y]) + step]
        if bad.any():
            out[x + np.repeat(np.arange(y - x), n[x:y])[bad]] = True
        x = y
    return out


def distinct_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, texts: int, hashes=None) -> np.ndarray:
    """Number of different words of each text: its words' hashes are sorted, and neighbours with one hash are compared by their bytes.

    Where neighbours with one hash differ (a collision), the words with that hash are counted as strings. hashes: for tests.
    """
    out = np.bincount(text, minlength=texts)
    h = Prefix(raw).slices(start, end) if hashes is None else hashes
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    a, b = order[:-1][same], order[1:][same]
    out -= np.bincount(text[a], minlength=texts)
    size = end - start
    wrong = size[a] != size[b]
    wrong[~wrong] = _differ(raw, start[a[~wrong]], start[b[~wrong]], size[a[~wrong]])
    if wrong.any():
        run = np.cumsum(np.r_[True, ~same])
        for r in np.unique(run[:-1][same][wrong]).tolist():
            group = order[np.searchsorted(run, r, "left") : np.searchsorted(run, r, "right")]
            out[text[group[0]]] += len({raw[s:e].tobytes() for s, e in zip(start[group], end[group], strict=True)}) - 1
    return out
