"""Removal of repeated byte strings, by suffix arrays over classes of contexts.

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller doc_id, or same document at an
earlier place) is removed; strings never cross documents and are judged on the input.

A corpus is too large for one suffix array, and need not be one: equal strings are brought together first. In
each string of ``length`` bytes the ``GRAM``-byte gram with the smallest hash, leftmost of equal ones, is its anchor. Equal
strings have equal anchors at equal offsets, so each string belongs to the class of its anchor's hash, and no string
equals one of another class. Neighbouring strings share their anchor: what an anchor stands for is one context of
``length`` to 2 * length - GRAM bytes.

1. The hashes of anchors are counted over all documents; a class that occurs once holds no repeated string.
2. A hot class, whose anchor many batches of documents have, has a different context in every document where the passage
   begins and ends. The hashes of its strings are counted in turn, and its contexts cut down to the strings that occur again (which loses
   nothing): what is left of the edges is the same everywhere.
3. The contexts of the classes are gathered by class. Equal contexts are one text with a first place.
4. Where a class has several texts, what none of the others shares is cut off (by hashes, which loses nothing), and texts
   that are now equal become one; then
   the suffix array of the rest is built by grouping Lyndon prefixes (suffix_sort.py). Runs of suffixes that share ``length``
   bytes are the repeated strings, each with its first place; all other occurrences are removed.

So equal contexts meet by value, which is the combining before and after the shuffle, and the suffix array decides where contexts differ.

Scale: grams are counted by hash, one entry for each batch of documents that has it, packed; contexts that are not the
first in their batch are decided on the spot, only the first travel. So a passage that a third of all documents share
reaches its group once a batch, and beyond ``SALTED`` batches in two steps, through groups salted by batch. Groups are as many as hold about
``GROUP_BYTES``. The hashes of hot anchors are sent to all executors where they are at most ``HOT_SENT``, and joined by batch otherwise.
The texts are shuffled twice: to meet the counts, and to meet their ranges.

Defined results: null and empty texts come out empty. A null doc_id is ordered first. Documents with the same
doc_id are ordered as they are numbered. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, groups_for
from .covered import BATCH_ROWS, PACKED, RANGE, cut_ranges, number_batches, packed, total_bytes
from .hashing import BASES, Prefix, mix, slabs
from .substring_dedup import FIRST_ID
from .suffix_sort import suffix_array

GRAM = 32
#: Bytes of a group; batches that make a class hot (or one of 1,024, where that is more); hashes that are sent to all; batches without salt.
GROUP_BYTES, HOT, HOT_SENT, SALTED = 4 << 20, 512, 1 << 20, 4096


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, anchor, first, last) of each anchor: the strings that start at first..last have it. Offsets are in the text."""
    wide = length - GRAM + 1  # grams in a string
    none = np.empty(0, np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    if len(raw) < length:
        return none, none.astype(np.uint64), none, none, none
    ends = np.cumsum(size)
    at = np.arange(len(raw) - GRAM + 1)
    h = Prefix(raw).slices(at, at + GRAM)
    # Smallest hash in each window, and its leftmost place, as one number with the place in its low bits: windows of doubling width.
    # Hashes are compared by the bits that are left; among equal ones the leftmost counts, in all equal strings alike.
    bits = np.uint64(max(1, (len(h) - 1).bit_length()))
    low, width = h >> bits << bits | at.astype(np.uint64), 1
    while width < wide:
        step = min(width, wide - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), size)[: len(low)]
    inside = np.arange(len(low)) + length <= ends[doc]
    start = np.flatnonzero(inside)
    if not len(start):
        return none, none.astype(np.uint64), none, none, none
    p, d = place[start], doc[start]
    edge = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])])
    first, last = start[edge], start[np.r_[edge[1:] - 1, len(start) - 1]]
    base = (ends - size)[d[edge]]
    return d[edge], h[p[edge]], p[edge] - base, first - base, last - base


def _raws(column, a: int, b: int) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column[a:b]]


def _held(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of x is in the sorted numbers known."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _listed(hashes: np.ndarray, number: int, parts: int) -> list[tuple]:
    """(part, batch, those that repeat, those that do not) of the hashes of one batch."""
    h, times = np.unique(hashes, return_counts=True)
    part = (mix(h) % np.uint64(parts)).astype(np.int64)
    rows = []
    for q in np.unique(part).tolist():
        mine = part == q
        rows.append((q, number, h[mine & (times > 1)].tobytes(), h[mine & (times == 1)].tobytes()))
    return rows


COUNTED = "part int, batch long, often binary, once binary"


def _count(parts: int, length: int, hot: np.ndarray | None = None):
    """For each batch and part: the distinct hashes, those that repeat in the batch and those that do not, of anchors or, where hot ones are given, of their strings."""

    def hashes(texts: list[bytes]) -> np.ndarray:
        if hot is None:
            return anchors(texts, length)[1]
        return _hot_strings(texts, length, hot)[-1]

    def run(batches):
        for batch in batches:
            number = batch.column("uid").to_numpy() // BATCH_ROWS
            texts = batch.column("text").to_pylist()
            for n in np.unique(number).tolist():
                own = [texts[i] for i in np.flatnonzero(number == n)]
                found = [hashes(_raws(own, a, b)) for a, b in slabs(own, 1 << 20)]
                rows = _listed(np.concatenate([np.empty(0, np.uint64), *found]), n, parts)
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "batch", "often", "once"])

    return run


def _count_by_batch(parts: int, length: int):
    """As _count, with the hot anchors of each batch joined to it."""

    def run(key, docs, lists):
        hot = np.unique(np.frombuffer(b"".join(lists.column("hashes").to_pylist()), np.uint64))
        out = list(_count(parts, length, hot)(docs.select(["uid", "text"]).to_batches())) if len(hot) else []
        return pa.Table.from_batches(out, pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("often", pa.binary()), ("once", pa.binary())]))

    return run


def _hot_strings(texts: list[bytes], length: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each string in a context of a hot anchor: (context, its text, anchor's hash, anchor, start, hash of string, class and place in it)."""
    d, h, p, lo, hi = anchors(texts, length)
    mine = np.flatnonzero(_held(hot, h))
    n = (hi - lo + 1)[mine]
    context = np.repeat(np.arange(len(mine)), n)
    own = mine[context]
    at = lo[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    size = np.array([len(t) for t in texts], np.int64)
    start = (np.cumsum(size) - size)[d[own]] + at
    strings = Prefix(np.frombuffer(b"".join(texts), np.uint8), BASES[1]).slices(start, start + length) if len(own) else np.empty(0, np.uint64)
    # With the anchor's hash and place: only strings of the same class can be equal.
    return context, d[own], h[own], p[own], at, mix(strings ^ h[own]) + (p[own] - at).astype(np.uint64)


#: What a list of hashes is of: anchors that occur again, hot ones among them, strings of hot ones that occur again; all hot anchors of a group, for no batch.
AGAIN, HOT_ANCHORS, STRINGS, ALL_HOT = 0, 1, 2, 3


def _repeated(kind: int, most_batches: int):
    def run(table: pa.Table) -> pa.Table:
        """For each batch, its hashes that occur again, there or in another batch, and those that more than most_batches have."""
        batch = table.column("batch").to_pylist()
        blobs = [np.frombuffer((a.as_py() or b"") + (b.as_py() or b""), np.uint64) for a, b in zip(table.column("often"), table.column("once"), strict=True)]
        h, batches = np.unique(np.concatenate(blobs), return_counts=True)
        local = np.unique(np.concatenate([np.frombuffer(a.as_py() or b"", np.uint64) for a in table.column("often")]))
        wanted = [(kind, h[(batches > 1) | _held(local, h)])]
        if kind == AGAIN:
            wanted.append((HOT_ANCHORS, h[batches > most_batches]))
        out = [(n, k, b[_held(again, b)].tobytes()) for k, again in wanted if len(again) for n, b in zip(batch, blobs, strict=True)]
        out = [r for r in out if r[2]] + [(None, ALL_HOT, again.tobytes()) for k, again in wanted if k == HOT_ANCHORS and len(again)]
        return pa.table({"batch": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([r[1] for r in out], pa.int32()), "hashes": pa.array([r[2] for r in out], pa.binary())})

    return run


LISTS = "batch long, kind int, hashes binary"


_CONTEXT_TYPES = [("part", pa.int32()), ("salt", pa.int32()), ("hash", pa.int64()), ("shift", pa.int32()), ("context", pa.binary()), ("doc", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("ranges", pa.binary())]
CONTEXTS = "part int, salt int, hash long, shift int, context binary, doc long, uid long, start long, ranges binary"


def _context_table(rows: list[tuple], lost: list[tuple[int, int, int]], parts: int, salt: int) -> pa.Table:
    gone = packed(np.array(lost, RANGE) if lost else np.empty(0, RANGE))
    rows = rows + [(int(u) % parts, salt, None, None, None, None, int(u), None, r) for u, r in zip(gone.column("batch").to_pylist(), gone.column("ranges").to_pylist(), strict=True)]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_CONTEXT_TYPES)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(cols, _CONTEXT_TYPES, strict=True)], names=[n for n, _ in _CONTEXT_TYPES])


def _contexts(parts: int, salts: int, length: int):
    """The first place of each distinct context of a batch's repeated classes, and what the others lose."""

    def run(key, docs, lists):
        order = np.lexsort((docs.column("uid").to_numpy(), docs.column("doc_id").to_numpy()))
        docs = docs.take(pa.array(order))
        texts, ids, uids = docs.column("text").to_pylist(), docs.column("doc_id").to_numpy(), docs.column("uid").to_numpy()
        kinds = lists.column("kind").to_numpy()
        known, hot, strings = (np.unique(np.frombuffer(b"".join(lists.filter(pa.array(kinds == k)).column("hashes").to_pylist()), np.uint64)) for k in (AGAIN, HOT_ANCHORS, STRINGS))
        first: dict[tuple, tuple] = {}
        lost: list[tuple[int, int, int]] = []

        def meet(i: int, x: int, y: int, z: int, context: bytes) -> None:
            # Documents come in order, and places in a document too: what is there already is earlier.
            if first.setdefault((x, y - z, context), (i, z)) != (i, z):
                lost.append((int(uids[i]), z, z + len(context)))

        if len(known):
            cold = known[~_held(hot, known)]
            for a, b in slabs(texts, 1 << 20):
                raws = _raws(texts, a, b)
                d, h, p, lo, hi = anchors(raws, length)
                keep = np.flatnonzero(_held(cold, h))
                for i, x, y, z, w in zip(d[keep].tolist(), h[keep].tolist(), p[keep].tolist(), lo[keep].tolist(), hi[keep].tolist(), strict=True):
                    meet(a + i, x, y, z, raws[i][z : w + length])
                if len(hot) and len(strings):
                    c, d, h, p, at, own = _hot_strings(raws, length, hot)
                    again = np.flatnonzero(_held(strings, own))
                    # Runs of strings that occur again, inside one context.
                    edge = np.flatnonzero(np.r_[True, (np.diff(again) != 1) | (np.diff(c[again]) != 0), True]) if len(again) else np.zeros(1, int)
                    u, v = again[edge[:-1]], again[edge[1:] - 1]
                    for i, x, y, z, w in zip(d[u].tolist(), h[u].tolist(), p[u].tolist(), at[u].tolist(), at[v].tolist(), strict=True):
                        meet(a + i, x, y, z, raws[i][z : w + length])
        salt = int(mix(np.array([key[0].as_py()], np.int64).view(np.uint64))[0] % np.uint64(salts))
        rows = [(int(mix(np.array([x], np.uint64))[0] % np.uint64(parts)), salt, x - (1 << 64) if x >> 63 else x, s, c, int(ids[i]), int(uids[i]), z, None) for (x, s, c), (i, z) in first.items()]
        return _context_table(rows, lost, parts, salt)

    return run


def _combine(parts: int):
    """The first of equal contexts of a salted group, for the group itself."""

    def run(table: pa.Table) -> pa.Table:
        passed = table.filter(pc.is_valid(table.column("ranges")))
        t = table.filter(pc.is_valid(table.column("context")))
        h, doc, uid, start, shift, part = (t.column(c).to_numpy() for c in ("hash", "doc", "uid", "start", "shift", "part"))
        contexts, first, lost = t.column("context").to_pylist(), {}, []
        for i in np.lexsort((start, uid, doc)).tolist():
            if first.setdefault((h[i], shift[i], contexts[i]), i) != i:
                lost.append((int(uid[i]), int(start[i]), int(start[i]) + len(contexts[i])))
        rows = [(int(part[i]), 0, int(h[i]), int(shift[i]), contexts[i], int(doc[i]), int(uid[i]), int(start[i]), None) for i in first.values()]
        return pa.concat_tables([passed, _context_table(rows, lost, parts, 0)])

    return run


def repeated_strings(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Groups of (text, start) of equal strings of ``length`` bytes in several texts, by one suffix array over all of them."""
    size = np.array([len(t) for t in texts])
    line = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    base = np.r_[0, np.cumsum(size + 1)[:-1]]
    line[base + size] = 0  # ends of texts
    order = suffix_array(line)
    text = np.searchsorted(base, order, "right") - 1
    whole = order + length <= (base + size)[text]
    # A suffix that is too short to hold a string parts no run of equal ones: it would sort before all of them.
    order, text = order[whole], text[whole]
    if len(order) < 2:
        return []
    windows = np.lib.stride_tricks.sliding_window_view(line.astype(np.uint16), length)
    same = np.zeros(len(order) - 1, bool)
    for a in range(0, len(same), 100_000):
        same[a : a + 100_000] = (windows[order[a : a + 100_000]][: len(same[a : a + 100_000])] == windows[order[a + 1 : a + 100_001]]).all(axis=1)
    edge = np.flatnonzero(np.r_[True, ~same, True])
    return [np.stack([text[a:b], order[a:b] - base[text[a:b]]], axis=1) for a, b in zip(edge[:-1], edge[1:], strict=True) if b - a > 1]


#: Strings whose hashes are held at a time.
STRINGS_HELD = 4_000_000


def shared_parts(classes: list[int], shifts: list[int], contexts: list[bytes], length: int, most: int = STRINGS_HELD) -> list[tuple[int, int] | None]:
    """For each context the strings (first, last) outside of which it has none in common with another context of its class.

    Found by hashes of (class, place relative to the anchor, string): a clash keeps a string that could go, which loses
    nothing. None where a context shares no string. Beyond ``most`` strings hashes are made again for each of several
    ranges of hashes, contexts some at a time, so that memory does not grow with a class but for two numbers a context.
    """
    size = np.array([len(c) for c in contexts], np.int64)
    count = size - length + 1
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    rounds = -(-total // most)
    bits = np.uint64(max(1, total - 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    cuts = np.unique(np.searchsorted(ends, np.arange(1, rounds) * most).tolist() + [0, len(contexts)]).astype(int)
    lowest, highest = np.full(len(contexts), np.iinfo(np.int64).max), np.full(len(contexts), -1, np.int64)
    for r in range(rounds):
        keys = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = np.repeat(np.arange(a, b), count[a:b])
            n = np.arange(ends[a] - count[a], ends[b - 1])
            at = n - (ends - count)[own]
            start = (np.cumsum(size[a:b]) - size[a:b])[own - a] + at
            h = Prefix(np.frombuffer(b"".join(contexts[a:b]), np.uint8)).slices(start, start + length)
            group = np.array(classes[a:b], np.uint64)[own - a] << np.uint64(9) | (np.array(shifts[a:b])[own - a] - at).astype(np.uint64)
            key = mix(h + mix(group))
            part = key & ~low | n.astype(np.uint64)
            keys.append(part[key % np.uint64(rounds) == r] if rounds > 1 else part)
        key = np.concatenate(keys)
        key.sort()
        same = np.flatnonzero((key[1:] >> bits) == (key[:-1] >> bits))
        hit = np.unique((key[np.r_[same, same + 1]] & low).astype(np.int64))
        own = np.searchsorted(ends, hit, "right")
        at = hit - (ends - count)[own]
        np.minimum.at(lowest, own, at)
        np.maximum.at(highest, own, at)
    return [(x, y) if y >= 0 else None for x, y in zip(lowest.tolist(), highest.tolist(), strict=True)]


#: Bytes of contexts that are compared at a time.
SLAB = 4 << 20


def _decide(length: int):
    def run(table):
        gone = table.filter(pc.is_valid(table.column("ranges")))
        gone = pa.table([gone.column("uid"), gone.column("ranges")], schema=PACKED)
        t = table.filter(pc.is_valid(table.column("context")))
        h, doc, uid, start, shift = (t.column(c).to_numpy() for c in ("hash", "doc", "uid", "start", "shift"))
        order = np.lexsort((start, uid, doc, h))
        contexts = t.column("context").to_pylist()
        cut = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(order) else np.empty(0, int)
        lost: list[tuple[int, int, int]] = []
        several: list[list[int]] = []
        waiting = 0

        def sort_out() -> None:
            """The repeated strings of classes with several texts."""
            members = [i for own in several for i in own]
            if members:
                parts = shared_parts([n for n, own in enumerate(several) for _ in own], [int(shift[i]) for i in members], [contexts[i] for i in members], length)
                at = 0
                for own in several:
                    shared: dict[tuple, tuple] = {}
                    for i, p in zip(own, parts[at : at + len(own)], strict=True):
                        if p and shared.setdefault((shift[i] - p[0], contexts[i][p[0] : p[1] + length]), (i, p[0]))[0] != i:
                            lost.append((uid[i], start[i] + p[0], start[i] + p[1] + length))
                    at += len(own)
                    if len(shared) < 2:
                        continue
                    kept = list(shared.values())
                    for group in repeated_strings([c for _, c in shared], length):
                        places = sorted((doc[kept[k][0]], uid[kept[k][0]], start[kept[k][0]] + kept[k][1] + o) for k, o in group.tolist())
                        lost.extend((u, o, o + length) for _, u, o in places[1:])
            several.clear()

        for a, b in zip(cut, np.r_[cut[1:], len(order)][: len(cut)], strict=True):
            if b - a == 1:
                continue
            own, first = order[a:b].tolist(), {}
            for i in own:  # by place: the first of equal contexts stays to be compared
                if first.setdefault((shift[i], contexts[i]), i) != i:
                    lost.append((uid[i], start[i], start[i] + len(contexts[i])))
            if len(first) > 1:
                several.append(list(first.values()))
                waiting += sum(len(contexts[i]) for i in first.values())
                if waiting > SLAB:
                    sort_out()
                    waiting = 0
        sort_out()
        ranges = packed(np.array(lost, RANGE) if lost else np.empty(0, RANGE))
        return pa.concat_tables([gone, pa.Table.from_batches([ranges])])

    return run


def suffix_dedup(docs: DataFrame, length: int = 100, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs, and with keep_text the text that is left."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    plain = number_batches(docs, scratch, id_col, text_col)
    size, batches = total_bytes(plain), plain.select(F.expr(f"uid div {BATCH_ROWS}")).distinct().count()
    # Contexts are about twice as long as what they are of, hashes of anchors a quarter.
    parts, salts = groups_for(spark, 2 * size, GROUP_BYTES), -(-batches // SALTED) or 1
    few = groups_for(spark, size // 4, GROUP_BYTES)
    counted = plain.select("uid", "text").mapInArrow(_count(few, length), COUNTED)
    lists = scratch.save(counted.groupBy("part").applyInArrow(_repeated(AGAIN, max(HOT, batches // 1024)), LISTS))
    by_batch = plain.select("uid", F.coalesce("doc_id", F.lit(FIRST_ID)).alias("doc_id"), "text", F.expr(f"uid div {BATCH_ROWS}").alias("batch")).groupBy("batch")
    found = lists.filter(F.col("kind") == ALL_HOT).select("hashes")
    n_hot = found.agg(F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0)) / 8).first()[0]
    if n_hot:
        if n_hot <= HOT_SENT:
            hot = np.sort(np.frombuffer(b"".join(r[0] for r in found.collect()), np.uint64))
            strings = plain.select("uid", "text").mapInArrow(_count(few, length, hot), COUNTED)
        else:
            strings = by_batch.cogroup(lists.filter(F.col("kind") == HOT_ANCHORS).groupBy("batch")).applyInArrow(_count_by_batch(few, length), COUNTED)
        lists = lists.unionByName(scratch.save(strings.groupBy("part").applyInArrow(_repeated(STRINGS, 0), LISTS)))
    contexts = by_batch.cogroup(lists.filter("batch IS NOT NULL").groupBy("batch")).applyInArrow(_contexts(parts, salts, length), CONTEXTS)
    if salts > 1:
        contexts = contexts.groupBy("part", "salt").applyInArrow(_combine(parts), CONTEXTS)
    ranges = scratch.save(contexts.groupBy("part").applyInArrow(_decide(length), "batch long, ranges binary"))
    return cut_ranges(plain, ranges, keep_text)


def op3(spark, sf_dir):
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
