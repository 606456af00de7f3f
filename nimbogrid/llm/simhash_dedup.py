"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most r bits if and only if some value lies within r/2 bits of
both. So each distinct fingerprint stands for all its variants within r/2 flipped bits (2,081 for r = 4), and
fingerprints that share a variant are linked: both lie within r/2 of it, hence within r of each other.

The shuffle is on variants, but a variant need not travel by itself. Variants are dealt out by a linear
function of their bits, their syndrome (the first six bits are the Hamming code's), and the syndrome of a
variant is that of the fingerprint XOR that of the flipped bits. A fingerprint is sent once to each syndrome that
any of its variants has, packed with others of its task, and the receiver makes just the variants of that syndrome.
Up to ``max_per_task`` distinct fingerprints there are 64 syndromes of 33 variants each (more where the session has more
shuffle partitions and there is work for them), so a fingerprint crosses the network 64 times instead of 2,081; beyond it the syndromes get longer until each has at most that many
fingerprints, and the cost tends to one packed value per variant, which is what the method costs.

In a task the variants are sorted, and each run of equal ones gives links from its first to its other members (a run
of size n gives n - 1 links, not all pairs; they connect the same documents). Each link is verified by counting
differing bits. What is connected within a task is sent on as stars round the least fingerprint. Links are made distinct, and components found over fingerprints, not over documents, so that copies
of one text cost nothing here.

Defined results: null and empty texts have fingerprint zero and are linked like any other. Rows are kept one for
one, repeated rows too. A null doc_id counts as no candidate for component_id unless the whole component has none.
An empty table gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, unused
from .components import components

INDEX_BITS = 24


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of the word shingles of one text."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    if len(w) <= words:
        h = [xxhash.xxh64_intdigest(line, 42)]
    else:
        size = np.fromiter(map(len, w), np.int64, len(w))
        end = np.cumsum(size + 1) - 1
        hash64 = xxhash.xxh64_intdigest
        h = [hash64(line[a:b], 42) for a, b in zip((end - size)[: 1 - words].tolist(), end[words - 1 :].tolist(), strict=True)]
    return majority(h)


def majority(h) -> int:
    """The bits that are set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):  # bounded memory for very long texts
        part = np.array(h[at : at + 65536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return run


def flips(radius: int) -> np.ndarray:
    """All 64-bit masks with at most radius bits set."""
    return np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(64), k)], dtype=np.uint64)


class Syndromes:
    """A linear map from 64 bits to ``bits`` bits: XOR of one column for each bit set."""

    def __init__(self, bits: int, skip: int = 0):
        rng = np.random.Generator(np.random.PCG64(20240613))
        column = np.arange(64, dtype=np.uint64) | (rng.integers(0, 1 << 40, 64, dtype=np.uint64) << np.uint64(6))
        self.columns = (column >> np.uint64(skip)) & np.uint64((1 << bits) - 1)
        tables = np.zeros((8, 256), np.uint64)
        for byte in range(8):
            for v in range(256):
                for i in range(8):
                    if v >> i & 1:
                        tables[byte, v] ^= self.columns[8 * byte + i]
        self.tables = tables

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.uint64)
        for byte in range(8):
            out ^= self.tables[byte][((x >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.intp)]
        return out


def _deal(bits: int, radius: int):
    """Packed fingerprints for each syndrome that one of their variants has."""

    def run(batches):
        syndrome = Syndromes(bits)
        of_mask = syndrome(flips(radius))
        kinds = np.unique(of_mask)
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(x):
                continue
            if len(kinds) == 1 << bits:  # every fingerprint has variants of every syndrome
                blob = x.tobytes()
                for rho in range(1 << bits):
                    yield pa.RecordBatch.from_arrays([pa.array([rho], pa.int64()), pa.array([blob], pa.binary())], ["rho", "fps"])
                continue
            for at in range(0, len(x), 4096):
                part = x[at : at + 4096]
                rho = (syndrome(part)[:, None] ^ kinds[None, :]).ravel()
                order = np.argsort(rho, kind="stable")
                rho, own = rho[order], np.repeat(part, len(kinds))[order]
                cut = np.flatnonzero(np.r_[True, rho[1:] != rho[:-1]])
                blobs = [own[a:b].tobytes() for a, b in zip(cut, np.r_[cut[1:], len(own)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rho[cut].astype(np.int64)), pa.array(blobs, pa.binary())], ["rho", "fps"])

    return run


def _linked(x: np.ndarray, index: np.ndarray, variant: np.ndarray, limit: int) -> np.ndarray:
    """Links (packed pairs of indexes) among fingerprints that share a variant."""
    low = np.uint64((1 << INDEX_BITS) - 1)
    packed = (variant * np.uint64(0x9E3779B97F4A7C15)) & ~low | index
    packed.sort()
    head = packed >> np.uint64(INDEX_BITS)
    same = np.flatnonzero(head[1:] == head[:-1])
    if not len(same):
        return np.empty(0, np.uint64)
    at = np.unique(np.r_[same, same + 1])
    run, member = head[at], (packed[at] & low).astype(np.int64)
    out = []
    while len(run) > 1:  # again for what a clash of the 40-bit prefixes has put beside a stranger
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        lead = np.repeat(member[first], np.diff(np.r_[first, len(run)]))
        near = np.bitwise_count(x[lead] ^ x[member]) <= limit
        take = near & (lead != member)
        out.append((np.minimum(lead, member)[take].astype(np.uint64) << np.uint64(INDEX_BITS)) | np.maximum(lead, member)[take].astype(np.uint64))
        run, member = run[~near], member[~near]
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def meet(x: np.ndarray, rho: int, bits: int, radius: int, limit: int, chunk: int = 4_000_000) -> np.ndarray:
    """Links that connect all distinct fingerprints x with common variants of syndrome rho, as an (n, 2) array of fingerprints.

    They are stars round the least fingerprint of each part that is connected here, so that other syndromes mostly
    find the same ones and a dense group of n gives about n links in all.
    """
    if len(x) >> INDEX_BITS:
        raise ValueError("too many fingerprints for one syndrome; lower max_per_task")
    masks, syndrome = flips(radius), Syndromes(bits)
    of_mask, of_x = syndrome(masks), syndrome(x)
    per = max(1, len(x) * len(masks) >> bits)
    fine = max(0, (per // chunk).bit_length())  # the variants are made and sorted in 2**fine parts
    finer = Syndromes(fine, skip=bits) if fine else None
    mask_part, x_part = (finer(masks), finer(x)) if fine else (np.zeros(len(masks), np.uint64), np.zeros(len(x), np.uint64))
    groups: dict = {}
    order = np.lexsort((x_part, of_x))
    cut = np.flatnonzero(np.r_[True, (of_x[order][1:] != of_x[order][:-1]) | (x_part[order][1:] != x_part[order][:-1])]) if len(x) else []
    for a, b in zip(cut, [*cut[1:], len(x)], strict=True):
        own = order[a:b]
        groups[int(of_x[own[0]]), int(x_part[own[0]])] = own
    by_mask: dict = {}
    for m, s, p in zip(masks, of_mask.tolist(), mask_part.tolist(), strict=True):
        by_mask.setdefault((s, p), []).append(m)
    links = []
    for part in range(1 << fine):
        variants, indexes = [], []
        for (s, p), own in groups.items():
            if ms := by_mask.get((s ^ rho, p ^ part)):
                variants.append((x[own][:, None] ^ np.array(ms, np.uint64)[None, :]).ravel())
                indexes.append(np.repeat(own.astype(np.uint64), len(ms)))
        if variants:
            links.append(_linked(x, np.concatenate(indexes), np.concatenate(variants), limit))
    found = np.unique(np.concatenate(links)) if links else np.empty(0, np.uint64)
    low = np.uint64((1 << INDEX_BITS) - 1)
    return _stars(x, (found >> np.uint64(INDEX_BITS)).astype(np.intp), (found & low).astype(np.intp))


def _stars(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The links x[a] - x[b] as stars: each linked value with the least one that it is connected to."""
    nodes = np.unique(np.r_[a, b])
    nodes = nodes[np.argsort(x[nodes], kind="stable")] if len(nodes) else nodes
    place = np.empty(int(nodes.max(initial=-1)) + 1, np.intp)
    place[nodes] = np.arange(len(nodes))
    a, b = place[a], place[b]
    label, before = np.arange(len(nodes)), None
    while before is None or not np.array_equal(label, before):
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([x[nodes[label[leaf]]], x[nodes[leaf]]], axis=1)


def _meet(bits: int, radius: int, limit: int):
    def run(key, table):
        x = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("fps")])
        pairs = meet(x, key[0].as_py(), bits, radius, limit).view(np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def near_links(distinct: DataFrame, scratch: Scratch, limit: int = 4, max_per_task: int = 1 << 23) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints (column fp) at limit or fewer differing bits."""
    if limit % 2:
        raise ValueError("the limit must be even: half of it is flipped on each side")
    n, variants, bits = distinct.count(), len(flips(limit // 2)), 6
    while 1 << bits < partitions(distinct.sparkSession) and n * variants >> bits > 1 << 22:
        bits += 1  # as many tasks as the cluster is set to, as long as each has some work
    if n > max_per_task:
        while n * variants >> bits > max_per_task:
            bits += 1
    dealt = distinct.select("fp").mapInArrow(_deal(bits, limit // 2), "rho long, fps binary")
    links = dealt.groupBy("rho").applyInArrow(_meet(bits, limit // 2, limit), "a long, b long")
    return scratch.save(links.distinct())


def shared_keys(prints: DataFrame, scratch: Scratch, limit: int = 4) -> DataFrame:
    """(uid, key) from fingerprints (uid, fp): any two rows whose fingerprints differ in limit or fewer bits have a key in common.

    Keys are the centres of the stars of ``near_links`` (two such fingerprints are in one star of the syndrome of a variant that they share) and the
    fingerprints that more than one row has. Keys of the same rows count as one.
    """
    distinct = scratch.save(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    links = near_links(distinct, scratch, limit)
    centre = F.col("a").alias("key")
    of = links.select(F.col("b").alias("fp"), centre).unionByName(links.select(F.col("a").alias("fp"), centre)).unionByName(distinct.filter("n > 1").select("fp", F.col("fp").alias("key")))
    keyed = scratch.save(prints.join(of.distinct(), "fp").select("uid", "key"))
    who = keyed.groupBy("key").agg(F.expr("bit_xor(xxhash64(uid))").alias("who"))
    return scratch.save(keyed.join(who, "key").select("uid", F.col("who").alias("key")).distinct())


def simhash_groups(docs: DataFrame, words: int = 4, limit: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = scratch.save(plain.mapInArrow(_fingerprints(words), "doc_id long, fp long"))
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(near_links(distinct, scratch, limit), scratch)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = scratch.save(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, words: int = 4, limit: int = 4, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that come first in their near-duplicate group. The rows are numbered once, in a saved copy."""
    uid = unused(docs, "row")
    rows = Scratch(docs.sparkSession).numbered(docs, uid)
    groups = simhash_groups(rows, words, limit, uid, text_col)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(uid))
    return rows.join(gone, uid, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def op2(spark, sf_dir):
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
