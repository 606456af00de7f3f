"""Benchmark decontamination by SimHash of item-sized windows.

Each benchmark item and each window of a document that has as many words as the item gets two 64-bit SimHashes of its
shingles of ``SHINGLE`` words, from two hashes. Fingerprints are compared with the items of the same size only, through four blocks of
sixteen bits: two fingerprints within ``RADIUS`` bits agree up to RADIUS // 4 = 3 bits in some block, so that looking up the items
near the window's own value of each block misses none of them; of unrelated pairs one in 24 is looked at. What is within the
radius in either fingerprint is verified: the exact weighted Jaccard similarity of the two
multisets of shingles (sum of the lesser counts over sum of the greater counts), on the words themselves, must
be at least ``similarity``.

At similarity 0.8 fingerprints differ in about 9.7 bits of 64 (standard deviation 2.9): two windows in 100 at the very threshold
lie beyond 15 bits in one fingerprint, one in 2,000 in both, and fewer above it (measured: tests/llm/test_contracts.py).

A document with fewer shingles than an item is one window as a whole for that item. Pairs of such that share a shingle and whose
sizes allow the similarity are verified without fingerprints.

Windows that share no shingle with any item of their size have similarity 0 and are left out before any SimHash is
made; that loses nothing.

Scale: one pass over the texts without a shuffle. The index of the items is all that is sent to the executors. Items
are taken in blocks of at most ``block_bytes`` of text, a pass each whose result is saved, so that the driver, the plan and the executors hold
one block at a time, however large the benchmark.

Words are runs of letters and digits, lower case. Defined results: null, empty and wordless documents and items
match nothing. An item of fewer words than a shingle is one shingle. Of one document and item the window with the
greatest similarity is reported, the first of equal ones, by bytes of the original text. Repeated rows are reported each, a null doc_id
too; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .hashing import Prefix, mix, slabs, words

SHINGLE, RADIUS, BLOCKS = 5, 15, 4
#: What makes another hash of a shingle.
OTHER = np.uint64(0xA0761D6478BD642F)
#: Windows whose fingerprints are made at a time.
AT_A_TIME = 20_000


def _lower(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    return raw


def simhashes(h: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window h[start : start + size] of shingle hashes."""
    need = np.zeros(len(h) + 1, np.int32)
    np.add.at(need, start, 1)
    np.add.at(need, start + size, -1)
    used = np.flatnonzero(np.cumsum(need[:-1]) > 0)
    place = np.zeros(len(h) + 1, np.int64)
    place[used] = np.arange(len(used))
    bits = np.unpackbits(h[used].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(used) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    ones = sums[place[start] + size] - sums[place[start]]
    return np.packbits(ones * 2 > size, axis=1, bitorder="little").view("<u8").ravel()


class Size:
    """The items of one number of shingles, by one fingerprint."""

    def __init__(self, width: int, shingles: int, items: list[int], prints: np.ndarray):
        self.width, self.shingles, self.items, self.prints = width, shingles, np.array(items), prints
        self.blocks = prints.view("<u2").reshape(-1, BLOCKS)

    def _near(self, block: int, values: np.ndarray, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(value, item) of all pairs that differ in at most RADIUS // BLOCKS bits of the block."""
        own = self.blocks[:, block]
        step, out = max(1, at_once // len(own)), []
        for a in range(0, len(values), step):
            v, i = np.nonzero(np.bitwise_count(values[a : a + step, None] ^ own[None, :]) <= RADIUS // BLOCKS)
            out.append((v + a, i))
        return np.concatenate([v for v, _ in out]), np.concatenate([i for _, i in out])

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item of this size) of all pairs within the radius."""
        found = [np.empty(0, np.int64)]
        for b in range(BLOCKS):
            # The items near each distinct value of the block, then those of each window by its value.
            values, own = np.unique(prints.view("<u2").reshape(-1, BLOCKS)[:, b], return_inverse=True)
            v, i = self._near(b, values)
            many = np.bincount(v, minlength=len(values))
            first = np.cumsum(many) - many
            w = np.repeat(np.arange(len(prints)), many[own])
            item = i[np.arange(len(w)) - np.repeat(np.cumsum(many[own]) - many[own], many[own]) + np.repeat(first[own], many[own])]
            close = np.bitwise_count(prints[w] ^ self.prints[item]) <= RADIUS
            found.append(w[close] * len(self.items) + item[close])
        pair = np.unique(np.concatenate(found))
        return pair // len(self.items), pair % len(self.items)


class Sizes:
    """The items of one number of shingles, by both fingerprints."""

    def __init__(self, width: int, shingles: int, items: list[int], hashes: list[np.ndarray]):
        self.width, self.shingles, self.items = width, shingles, np.array(items)
        own = lambda h: np.concatenate([simhashes(x, np.zeros(1, np.int64), shingles) for x in h])
        self.first, self.second = Size(width, shingles, items, own(hashes)), Size(width, shingles, items, own([mix(x ^ OTHER) for x in hashes]))

    def candidates(self, h: np.ndarray, other: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item of this size) within the radius in either fingerprint; h and other are the two hashes of the shingles."""
        pairs = [g.candidates(simhashes(x, start, self.shingles)) for g, x in ((self.first, h), (self.second, other))]
        pair = np.unique(np.concatenate([w * len(self.items) + i for w, i in pairs]))
        return pair // len(self.items), pair % len(self.items)


class Index:
    """What executors need of a block of benchmark items (id, text)."""

    def __init__(self, items: list[tuple]):
        self.ids, self.counts, by_size, shingles, owners = [], [], {}, {}, {}
        for item, text in items:
            raw = _lower(text)
            ws, we = words(raw)
            if not len(ws):
                continue
            width = min(SHINGLE, len(ws))
            h = _shingle_hashes(raw, ws, we, width)
            n = len(self.ids)
            self.ids.append(item)
            self.counts.append(Counter(_shingles(raw, ws, we, 0, len(h), width)))
            by_size.setdefault((width, len(h)), []).append((n, h))
            shingles.setdefault(width, []).append((h, len(h)))
            owners.setdefault(width, []).append(np.full(len(h), n))
        self.sizes = {(w, s): Sizes(w, s, [n for n, _ in x], [h for _, h in x]) for (w, s), x in sorted(by_size.items())}
        # For each width: the distinct shingle hashes, and which sizes have them.
        self.seeds, self.owners, self.most = {}, {}, {}
        self.shingles = np.array([c.total() for c in self.counts])
        for width, rows in shingles.items():
            h, s = np.concatenate([r[0] for r in rows]), np.concatenate([np.full(len(r[0]), r[1]) for r in rows])
            pairs = np.unique(np.rec.fromarrays([h, s], names="h,s"))
            self.seeds[width] = (np.unique(h), pairs)
            order = np.argsort(h, kind="stable")
            self.owners[width], self.most[width] = (h[order], np.concatenate(owners[width])[order]), int(s.max())
        self.sieve = {w: self._sieve(keys) for w, (keys, _) in self.seeds.items()}

    @staticmethod
    def _sieve(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[(keys & np.uint64((1 << 20) - 1)).astype(np.intp)] = True
        return out

    def longer(self, h: np.ndarray, width: int, similarity: float) -> list[int]:
        """Items of more shingles than the document h that share one with it, and not of too many for the similarity."""
        maybe = h[self.sieve[width][(h & np.uint64((1 << 20) - 1)).astype(np.intp)]]
        keys, own = self.owners[width]
        lo, hi = np.searchsorted(keys, maybe, "left"), np.searchsorted(keys, maybe, "right")
        items = np.unique(np.concatenate([own[:0], *(own[a:b] for a, b in zip(lo, hi, strict=True))]))
        s = self.shingles[items]
        return items[(s > len(h)) & (len(h) / s >= similarity)].tolist()

    def windows(self, h: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> dict[int, np.ndarray]:
        """By number of shingles: starts of the windows, inside one document, that share a shingle with an item of that size.

        first and last: for each shingle, the first of its document and the one after its document's last.
        """
        maybe = np.flatnonzero(self.sieve[width][(h & np.uint64((1 << 20) - 1)).astype(np.intp)])
        keys, pairs = self.seeds[width]
        at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
        q = maybe[keys[at] == h[maybe]]
        if not len(q):
            return {}
        lo, hi = np.searchsorted(pairs["h"], h[q], "left"), np.searchsorted(pairs["h"], h[q], "right")
        own = np.repeat(q, hi - lo)
        size = pairs["s"][np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])]
        out = {}
        for s in np.unique(size).tolist():
            seeds = np.unique(own[size == s])
            a, b = np.maximum(first[seeds], seeds - s + 1), np.minimum(last[seeds] - s, seeds) + 1
            seeds, a, b = seeds[b > a], a[b > a], b[b > a]
            if len(a):
                out[s] = np.unique(np.concatenate([np.arange(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
        return out


def _shingle_hashes(raw: np.ndarray, ws: np.ndarray, we: np.ndarray, width: int) -> np.ndarray:
    at = np.arange(len(ws) - width + 1)
    return Prefix(Prefix(raw).slices(ws, we)).slices(at, at + width)


def _shingles(raw: np.ndarray, ws: np.ndarray, we: np.ndarray, start: int, n: int, width: int) -> list[bytes]:
    w = [raw[a:b].tobytes() for a, b in zip(ws[start : start + n + width - 1].tolist(), we[start : start + n + width - 1].tolist(), strict=True)]
    return [b" ".join(w[i : i + width]) for i in range(n)]


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (a.total() + b.total() - both)


def matches(texts: list[str | None], index: Index, similarity: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first byte, byte after the last) of the best window of each pair."""
    best: dict[tuple[int, int], tuple] = {}
    out: list[tuple[int, int, float, int, int]] = []
    for a, b in slabs(texts, 1 << 20):
        raws = [_lower(t) for t in texts[a:b]]
        gap = np.array([32], np.uint8)
        raw = np.concatenate([x for r in raws for x in (r, gap)])
        base = np.cumsum([0, *(len(r) + 1 for r in raws)])
        ws, we = words(raw)

        def place(d: int, w0: int, w1: int) -> tuple[int, int]:
            """Bytes of the original text from word w0 to word w1. Lower case may be longer, but has the same words."""
            if texts[a + d].isascii():
                return int(ws[w0] - base[d]), int(we[w1] - base[d])
            first, last = words(np.frombuffer(texts[a + d].encode("utf-8", "surrogatepass"), np.uint8))
            return int(first[w0 - starts[d]]), int(last[w1 - starts[d]])

        word_hash = Prefix(raw).slices(ws, we)
        line, doc = Prefix(word_hash), np.searchsorted(base, ws, "right") - 1
        starts, ends = np.searchsorted(doc, np.arange(b - a), "left"), np.searchsorted(doc, np.arange(b - a), "right")
        for width in index.seeds:
            if len(ws) < width:
                continue
            at = np.arange(len(ws) - width + 1)
            h = line.slices(at, at + width)
            own = doc[: len(h)]
            last = np.maximum(ends[own] - width + 1, 0)
            inside = at < last  # not across documents
            h = np.where(inside, h, np.uint64(0))
            other = mix(h ^ OTHER)
            for shingles, where in index.windows(h, starts[own], last, width).items():
                group = index.sizes[width, shingles]
                for c in range(0, len(where), AT_A_TIME):
                    part = where[c : c + AT_A_TIME]
                    w, i = group.candidates(h, other, part)
                    kept: tuple[int, Counter] = (-1, Counter())
                    for x, n in zip(part[w].tolist(), group.items[i].tolist(), strict=True):
                        if kept[0] != x:
                            kept = (x, Counter(_shingles(raw, ws, we, x, shingles, width)))
                        s = weighted_similarity(index.counts[n], kept[1])
                        key = (a + int(doc[x]), n)
                        if s >= similarity and (key not in best or best[key][0] < s):
                            best[key] = (s, int(doc[x]), x, x + shingles + width - 2)
            size = ends - starts - width + 1
            for x in np.flatnonzero((size > 0) & (size < index.most[width])).tolist():
                at, m = int(starts[x]), int(size[x])
                for n in index.longer(h[at : at + m], width, similarity):
                    s = weighted_similarity(index.counts[n], Counter(_shingles(raw, ws, we, at, m, width)))
                    if s >= similarity:
                        best[a + x, n] = (s, x, at, int(ends[x]) - 1)
        out += [(d, n, s, *place(*at)) for (d, n), (s, *at) in sorted(best.items())]
        best.clear()
    return out


def _find(index: Index, similarity: float, id_type):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = matches(texts, index, similarity)
            doc = batch.column("doc_id").take(pa.array([m[0] for m in found], pa.int64()))
            cols = [pa.array([index.ids[m[1]] for m in found], id_type)] + [pa.array([m[k] for m in found], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
            yield pa.RecordBatch.from_arrays([doc, *cols], ["doc_id", "item_id", "similarity", "start", "end"])

    return run


def _keep(index: Index, similarity: float, text: str):
    def run(batches):
        for batch in batches:
            found = {m[0] for m in matches(batch.column(text).to_pylist(), index, similarity)}
            yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)], pa.bool_()))

    return run


def indexes(benchmark: DataFrame, block_bytes: int = 8 << 20) -> Iterator[tuple[Index, bool]]:
    """Indexes of blocks of items (item_id, text) of about block_bytes of text, one made at a time, and whether it is the only one."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        index = Index([tuple(r) for r in block.orderBy("item_id", "text").collect()])
        if index.ids:
            yield index, blocks == 1


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, similarity, start, end of every pair of a document and an item that has a window at similarity or more."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = benchmark.schema["item_id"].dataType
    schema = f"doc_id long, item_id {kind.simpleString()}, similarity double, start long, end long"
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, scratch = None, None
    for index, only in indexes(benchmark, block_bytes):
        found = plain.mapInArrow(_find(index, similarity, to_arrow_type(kind)), schema)
        if not only:
            scratch = scratch or Scratch(docs.sparkSession)
            found = scratch.save(found)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, with all their columns, that match no benchmark item."""
    scratch = None
    for index, only in indexes(benchmark, block_bytes):
        kept = docs.mapInArrow(_keep(index, similarity, text_col), docs.schema)
        if not only:
            scratch = scratch or Scratch(docs.sparkSession)
            kept = scratch.save(kept)
        docs = kept
    return docs


def op6(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs.select("doc_id", "text"), items)


#: Only words whose shingle an item has are kept (seed); windows are made only where enough of them lie together (near).
OP6_SQL = r"""
WITH it AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(5, len(ws)) AS k, len(ws) - least(5, len(ws)) + 1 AS s FROM it WHERE len(ws) > 0),
ic AS (SELECT item_id, k, s, sh, count(*) AS c FROM (SELECT item_id, k, s, array_to_string(ws[q : q + k - 1], ' ') AS sh FROM (SELECT *, unnest(range(1, s + 1)) AS q FROM i)) GROUP BY ALL),
t AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS tok FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}]+') AS l FROM documents)),
o AS (SELECT *, sum(strlen(tok)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS upto, regexp_matches(tok, '^[0-9A-Za-z\x{80}-\x{10FFFF}]') AS word FROM t),
w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, lower(tok) AS tok, upto - strlen(tok) AS a, upto AS b FROM o WHERE word),
d AS (SELECT doc_id, n AS p, count(*) OVER (PARTITION BY doc_id) AS m, tok AS t0, lead(tok, 1) OVER v AS t1, lead(tok, 2) OVER v AS t2, lead(tok, 3) OVER v AS t3, lead(tok, 4) OVER v AS t4 FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY n)),
ds AS (SELECT doc_id, m, k, p, concat_ws(' ', t0, CASE WHEN k > 1 THEN t1 END, CASE WHEN k > 2 THEN t2 END, CASE WHEN k > 3 THEN t3 END, CASE WHEN k > 4 THEN t4 END) AS sh FROM d, (SELECT DISTINCT k FROM i) WHERE p <= m - k + 1),
seed AS (SELECT doc_id, item_id, ic.k, s, ic.sh, c, p, m - ic.k + 1 AS ms, least(s, m - ic.k + 1) AS len FROM ds JOIN ic ON ds.k = ic.k AND ds.sh = ic.sh),
near AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id ORDER BY p RANGE BETWEEN len - 1 PRECEDING AND len - 1 FOLLOWING) AS together FROM seed),
win AS (SELECT DISTINCT doc_id, item_id, k, s, len, unnest(range(greatest(1, p - len + 1), least(p, ms - len + 1) + 1)) AS x FROM near WHERE together * 1.8 >= 0.8 * (s + len) - 0.001),
spread AS (SELECT *, unnest(range(x, x + len)) AS q FROM win),
hit AS (SELECT v.doc_id, v.item_id, v.k, v.s, v.len, x, sh, least(count(*), any_value(c)) AS c FROM spread v JOIN seed ON seed.doc_id = v.doc_id AND seed.item_id = v.item_id AND p = q GROUP BY ALL),
sim AS (SELECT doc_id, item_id, k, s, len, x, sum(c) AS common FROM hit GROUP BY ALL),
best AS (SELECT *, common::DOUBLE / (s + len - common)::DOUBLE AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common DESC, x) AS nth FROM sim)
SELECT best.doc_id, item_id, similarity, f.a::BIGINT AS start, l.b::BIGINT AS "end" FROM best JOIN w f ON f.doc_id = best.doc_id AND f.n = x JOIN w l ON l.doc_id = best.doc_id AND l.n = x + len + k - 2
WHERE nth = 1 AND similarity >= 0.8
"""
