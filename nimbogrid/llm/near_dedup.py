"""Near duplicates at an exact similarity of word shingles, found by SimHash and, where that does not reach, by bands of minimum hashes.

A text is the set of its shingles of ``words`` words (lower case, cut at white space), as 64-bit hashes. Two texts are near
when the Jaccard similarity of their whole sets is ``similarity`` or more. Candidates are of two kinds. The SimHash
fingerprints of their sets differ in ``BITS`` or fewer bits: these are found by ball hashing (``simhash_dedup``), which
loses no pair of them. Fingerprints of texts at 0.8 differ in some ten bits, which ball hashing cannot afford; so candidates are also
texts that agree in one of ``BANDS`` bands of ``ROWS`` minimum hashes: at similarity s a pair is missed there with
probability (1 - s**ROWS)**BANDS, 0.00003 at 0.8, and less above. Each candidate pair that is still whole is verified on the sets.

Of two near texts the later goes (by the order of the table). What goes is compared no further, so that of all that stay no
two candidates are near, and each text that went is linked to an earlier one that stays by a chain of verified pairs.

Scale: texts of one slab are compared on the spot, so that a large group of copies leaves each slab as a few. Only the
fingerprints and the keys of the bands of what is left are shuffled, packed; then the sets of texts that share a key with another, once for each
such key; keys that the same texts share count as one. Of the texts that share a key only those are compared that share one of their rarest shingles too, and whose sizes
allow the similarity: ten thousand texts round one boilerplate cost no comparison. Groups are as many as the data need; the texts of one key are in one task.

Defined results: null, empty and blank texts are near one another. A text of fewer words than a shingle is one shingle.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import Scratch, groups_for, unused
from .hashing import Prefix, mix, slabs
from .simhash_dedup import majority, shared_keys

BANDS, ROWS, BITS = 20, 4, 4
#: Bytes of text whose sets a group holds.
GROUP_BYTES = 16 << 20
_RNG = np.random.Generator(np.random.PCG64(20240801))
_SEEDS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
RECORD = np.dtype([("key", "<u8"), ("uid", "<i8")])


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of the shingles of one text, sorted."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside))
    ws, we = edge[::2], edge[1::2]
    if not len(ws):
        return np.zeros(1, np.uint64)
    width = min(words, len(ws))
    at = np.arange(len(ws) - width + 1)
    # A word is hashed by XXH3: a polynomial over its bytes could be made to collide by the word's form.
    code, names = scan.codes(raw[inside[1:-1].astype(bool)], we - ws)
    word = np.array([xxhash.xxh3_64_intdigest(x) for x in names.to_pylist()], np.uint64)[code]
    return np.unique(Prefix(word).slices(at, at + width))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The key of each band."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for a in range(0, len(shingles), 4096):
        np.minimum(least, ((shingles[a : a + 4096] ^ _SEEDS[:, None]) * _FACTORS[:, None]).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def near(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each of others has the similarity to one."""
    size = np.array([len(x) for x in others])
    line = np.concatenate(others)
    found = one[np.minimum(np.searchsorted(one, line), len(one) - 1)] == line
    both = np.add.reduceat(found.astype(np.int64), np.r_[0, np.cumsum(size)[:-1]])
    return both >= similarity * (size + len(one) - both) - 1e-9


def later_by_rare_shingles(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Of sets in order, whether each is near an earlier one that stays; only sets that share a rare shingle are compared.

    Shingles are ordered by how many of the sets have them. Two sets of the similarity share one of the rarest n - ceil(similarity * n) + 1 of either, so that what all
    of them have in common, such as boilerplate, brings no two together.
    """
    size = np.array([len(x) for x in sets])
    own, line = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    _, token, many = np.unique(line, return_inverse=True, return_counts=True)
    order = np.lexsort((token, many[token], own))
    place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    rare = place < np.repeat(size - np.ceil(similarity * size - 1e-6).astype(int) + 1, size)
    own, token = own[order][rare], token[order][rare]
    # A shingle that is among the rarest of one set only brings none together.
    met = np.bincount(token, minlength=len(many))[token] > 1
    own, token = own[met], token[met]
    cut = np.searchsorted(own, np.arange(len(sets) + 1))
    gone, held = np.zeros(len(sets), bool), {}
    for n in np.unique(own).tolist():
        tokens = token[cut[n] : cut[n + 1]].tolist()
        others = sorted({k for t in tokens for k in held.get(t, ())})
        others = [k for k in others if similarity * max(size[k], size[n]) <= min(size[k], size[n]) + 1e-6]
        gone[n] = bool(others) and near(sets[n], [sets[k] for k in others], similarity).any()
        if not gone[n]:
            for t in tokens:
                held.setdefault(t, []).append(n)
    return gone


def later_copies(keys: np.ndarray, members: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Of texts in order, whether each is near an earlier one that shares a key with it; keys[k] is a key of text members[k]."""
    gone = np.zeros(len(sets), bool)
    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, int)
    for g in np.flatnonzero(np.diff(cut) > 1).tolist():
        alive = members[cut[g] : cut[g + 1]]
        alive = alive[~gone[alive]]
        if len(alive) > 1:
            gone[alive[later_by_rare_shingles([sets[k] for k in alive.tolist()], similarity)]] = True
    return gone


def _deal_keys(parts: int, words: int, similarity: float):
    def run(batches):
        for batch in batches:
            uid, texts = batch.column("uid").to_numpy(), batch.column("text").to_pylist()
            for a, b in slabs(texts, 4 << 20):
                sets = [shingle_set(t, words) for t in texts[a:b]]
                keys = np.array([band_keys(s) for s in sets])
                gone = later_copies(keys.ravel(), np.repeat(np.arange(b - a), BANDS), sets, similarity)
                rows = [(int(u) % parts, int(u), None, None) for u in uid[a:b][gone]]
                rows += [(int(uid[n]) % parts, int(uid[n]), majority(sets[n - a]), None) for n in (a + np.flatnonzero(~gone)).tolist()]
                t = np.empty(int((~gone).sum()) * BANDS, RECORD)
                t["key"], t["uid"] = keys[~gone].ravel(), np.repeat(uid[a:b][~gone], BANDS)
                part = (t["key"] % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                t, part = t[order], part[order]
                cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                rows += [(int(part[x]), None, None, t[x:y].tobytes()) for x, y in zip(cut, np.r_[cut[1:], len(t)], strict=True)]
                part, who, fp, records = zip(*rows, strict=True)
                fp = pa.array(fp, pa.uint64()).view(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(who, pa.int64()), fp, pa.array(records, pa.binary())], ["part", "uid", "fp", "records"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """(uid, key) of keys that more than one text has, and (uid, fp) of all texts that have not gone; a text that has gone has neither.

    The key is now a hash of who has it, so that bands with the same texts become one.
    """
    t = np.frombuffer(b"".join(x.as_py() for x in table.column("records") if x.is_valid), RECORD)
    _, at, n = np.unique(t["key"], return_inverse=True, return_counts=True)
    who = np.zeros(len(n), np.uint64)
    np.add.at(who, at, mix(t["uid"].astype(np.uint64) + np.uint64(1)))
    shared = n[at] > 1
    own = table.select(["uid", "fp"]).filter(table.column("uid").is_valid())
    keys = pa.array(who[at][shared].view(np.int64))
    n, k = own.num_rows, len(keys)
    columns = {"uid": [*own.column("uid").chunks, pa.array(t["uid"][shared])], "key": [pa.nulls(n, pa.int64()), keys], "fp": [*own.column("fp").chunks, pa.nulls(k, pa.int64())]}
    return pa.table({c: pa.chunked_array(v, pa.int64()).combine_chunks() for c, v in columns.items()})


def _deal_sets(parts: int, words: int):
    def run(batches):
        for batch in batches:
            uid, texts, own = batch.column("uid").to_numpy(), batch.column("text").to_pylist(), batch.column("keys").to_pylist()
            for a, b in slabs(texts, 1 << 20):
                held: dict = {}
                for i in range(a, b):
                    shingles, to = shingle_set(texts[i], words), {}
                    for k in own[i]:
                        to.setdefault(k % parts, []).append(k)
                    for part, keys in to.items():
                        held.setdefault(part, []).append((int(uid[i]), keys, shingles))
                cols = [[], [], [], [], []]
                for part, rows in held.items():
                    keys = np.array([(k & (2**64 - 1), u) for u, ks, _ in rows for k in ks], np.uint64)
                    t = np.empty(len(keys), RECORD)
                    t["key"], t["uid"] = keys[:, 0], keys[:, 1]
                    for c, v in zip(cols, (part, t.tobytes(), np.array([r[0] for r in rows]).tobytes(), np.array([len(r[2]) for r in rows]).tobytes(), np.concatenate([r[2] for r in rows]).tobytes()), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), *[pa.binary()] * 4), strict=True)], ["part", "records", "uids", "sizes", "sets"])

    return run


def _verify(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        t, uid = (np.frombuffer(b"".join(table.column(c).to_pylist()), d) for c, d in (("records", RECORD), ("uids", np.int64)))
        sets = []
        for blob, sizes in zip(table.column("sets"), table.column("sizes"), strict=True):
            line, n = np.frombuffer(blob.as_buffer(), np.uint64), np.frombuffer(sizes.as_buffer(), np.int64)
            sets += np.split(line, np.cumsum(n)[:-1])
        order = np.argsort(uid)
        place = np.searchsorted(uid[order], t["uid"])
        gone = later_copies(t["key"], place, [sets[k] for k in order.tolist()], similarity)
        return pa.table({"uid": pa.array(uid[order][gone], pa.int64())})

    return run


def near_copies(plain: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """uid of each row of plain (uid, text) that is near an earlier one."""
    scratch = Scratch(plain.sparkSession)
    # A set is about as long as its text; keys are less.
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = groups_for(plain.sparkSession, size, GROUP_BYTES)
    dealt = plain.mapInArrow(_deal_keys(parts, words, similarity), "part int, uid long, fp long, records binary")
    shared = scratch.save(dealt.groupBy("part").applyInArrow(_shared, "uid long, key long, fp long"))
    prints = shared_keys(shared.filter("fp IS NOT NULL").select("uid", "fp"), scratch, BITS)
    keyed = shared.filter("key IS NOT NULL").select("uid", "key").unionByName(prints).groupBy("uid").agg(F.collect_set("key").alias("keys"))
    sets = plain.join(keyed, "uid").select("uid", "text", "keys").mapInArrow(_deal_sets(parts, words), "part int, records binary, uids binary, sizes binary, sets binary")
    lost = sets.groupBy("part").applyInArrow(_verify(similarity), "uid long")
    return scratch.save(shared.filter("key IS NULL AND fp IS NULL").select("uid").unionByName(lost).distinct())


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are near no earlier one. The rows are numbered once, in a saved copy."""
    scratch, uid = Scratch(docs.sparkSession), unused(docs, "row")
    rows = scratch.numbered(docs, uid)
    gone = near_copies(rows.select(F.col(uid).alias("uid"), F.col(text_col).cast("string").alias("text")), words, similarity)
    return rows.join(gone.withColumnRenamed("uid", uid), uid, "left_anti").select(*(f"`{c}`" for c in docs.columns))
