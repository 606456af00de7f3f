"""Substring deduplication by sliding spans of sentences.

A text is cut after every run of ``ENDS`` characters into sentences; clauses count, so that a passage put into the middle
of a sentence is found from its next clause on. From each sentence that has a word, the span
is the shortest run of consecutive sentences with at least ``least_sentences`` sentences that have words and at
least ``least_words`` words. With ``short_words`` more is added: the shortest run of at least that many words is a span too where it
has fewer sentences, and so is the whole of a text of fewer than ``least_sentences`` sentences (before cuts at words) and at least that many words;
the shortest runs that end with the last sentence are spans, so that nothing of a copy is left over at its end, and what has no word before the first or after the last sentence goes with it;
``MARKS`` beyond ASCII end sentences as well; and a sentence of more than ``LONG`` words, as in text without any marks, is
also cut after every word whose length in bytes and last byte (in lower case) add up to 3 modulo 4, so that its pieces depend on the words
and not on where it begins. Spans are equal when their words are (lower case, everything but letters and digits
ignored). All spans of all documents are hashed (128 bits of XXH3, no polynomial, so that no text can be made to collide by its form) and joined; the first occurrence, by doc_id and position,
stays, and every sentence covered by any other occurrence is removed. Spans are judged on the input.

Scale: an occurrence that is not the first in its own slab of texts cannot be the first of all, so it is decided on
the spot; only the first of each slab is shuffled, packed, by a hash of the span, into as many groups as hold about
``GROUP_BYTES``. A span that a third of all documents share reaches its group once per slab; beyond ``SLABS`` slabs the groups are
salted by slab, and only the first of each salted group goes on to the group itself. The texts are shuffled once, to meet their ranges.

Defined results: null and empty texts come out empty. Text before the first and after the last sentence mark is a
sentence too. A null doc_id is ordered first. Repeated rows are documents of their own; the one numbered first keeps its
text. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import Scratch, groups_for
from .covered import PACKED, RANGE, cut_ranges, number_batches, packed, total_bytes
from .hashing import mix, slabs, words

#: What ends a sentence here; clauses count as sentences, so that a passage put into the middle of one is found.
ENDS = ".!?,;:|\n"
#: Sentence and clause marks beyond ASCII that count with short_words, as a mark of the same length.
MARKS = {c.encode(): b"." * len(c.encode()) for c in "。！？；，、：｡､．…।॥۔؟،؛։።፣჻‼⁇⁈⁉"}
_END = np.isin(np.arange(256), np.frombuffer(ENDS.encode(), np.uint8))
#: Words of a span of fewer sentences, in the query; words of a sentence that is cut at words.
SHORT_WORDS, LONG = 16, 40
#: Characters of a slab; bytes of the records of a group; slabs without salt.
SLAB, GROUP_BYTES, SLABS = 4 << 20, 16 << 20, 4096
RECORD = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("uid", "<i8"), ("start", "<i8"), ("end", "<i8")])
FIRST_ID = -(2**63)


def spans(text: str | None, least_sentences: int, least_words: int, short_words: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, start, end) of each span of one text; offsets are in its UTF-8 bytes."""
    none = np.empty(0, np.int64)
    plain = (text or "").encode("utf-8", "surrogatepass")
    if short_words and not plain.isascii():
        for mark, dots in MARKS.items():
            plain = plain.replace(mark, dots)
    raw = np.frombuffer(plain, np.uint8)
    if not len(raw):
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    lower = raw | (np.uint8(32) * ((raw >= 65) & (raw <= 90)).astype(np.uint8))
    ws, we = words(lower)
    mark = _END[raw]
    after = np.flatnonzero(mark[:-1] & ~mark[1:]) + 1
    starts = np.r_[0, after]
    if short_words and len(ws):
        own = np.searchsorted(starts, ws, "right") - 1
        cut = (np.bincount(own)[own] > LONG)[:-1] & (own[1:] == own[:-1]) & ((we - ws + lower[we - 1])[:-1] % 4 == 3)
        starts = np.sort(np.r_[starts, ws[1:][cut]])
        uncut = len(np.unique(own))
    ends = np.r_[starts[1:], len(raw)]
    # Words of each sentence; those without words join no span of their own.
    upto = np.searchsorted(ws, ends, side="left")
    before = np.searchsorted(ws, starts, side="left")
    has = np.flatnonzero(upto > before)
    if not len(has) or not short_words and len(has) < least_sentences:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    w0, w1 = before[has], upto[has]
    first = np.arange(len(has))
    last = np.maximum(first + least_sentences - 1, np.searchsorted(w1, w0 + least_words, side="left"))
    if short_words:
        short = np.searchsorted(w1, w0 + short_words, side="left")
        # Runs of fewer sentences; the others are spans already.
        own = short < first + least_sentences - 1
        first, last = np.r_[first, first[own]], np.r_[last, short[own]]
        end, words_to_end = len(has) - 1, w1[-1] - w0
        tails = [min(int(np.flatnonzero(words_to_end >= least_words)[-1]), end - least_sentences + 1)] if words_to_end[0] >= least_words and end >= least_sentences - 1 else []
        if words_to_end[0] >= short_words:
            shortest = int(np.flatnonzero(words_to_end >= short_words)[-1])
            tails += [shortest] * (shortest > end - least_sentences + 1) + [0] * (uncut < least_sentences)
        first, last = np.unique(np.stack([np.r_[first, np.array(tails, np.int64)], np.r_[last, np.full(len(tails), end)]]), axis=1)
    first, last = first[last < len(has)], last[last < len(has)]
    h1, h2 = _span_hashes(lower, ws, we, w0[first], w1[last])
    start, end = starts[has[first]], ends[has[last]]
    if short_words:
        # What has no word before the first and after the last sentence that has goes with it.
        start, end = np.where(first == 0, 0, start), np.where(last == len(has) - 1, len(raw), end)
    return h1, h2, start, end


def _span_hashes(lower: np.ndarray, ws: np.ndarray, we: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of XXH3 of the words w0 .. w1 - 1 of each span, each word by 128 bits of its own."""
    code, names = scan.codes(lower[scan.within(ws, we, len(lower))], we - ws)
    word = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in names.to_pylist()), "V16")[code]
    line = memoryview(word.tobytes())
    spans = b"".join([xxhash.xxh3_128_digest(line[a:b]) for a, b in zip((16 * w0).tolist(), (16 * w1).tolist(), strict=True)])
    return tuple(np.frombuffer(spans, "<u8").reshape(-1, 2).T)


def _first_of_each(t: np.ndarray) -> np.ndarray:
    """Of records, whether each is the first with its hashes by (doc, uid, start)."""
    order = np.lexsort((t["start"], t["uid"], t["doc"], t["h2"], t["h1"]))
    s = t[order]
    first = np.r_[True, (s["h1"][1:] != s["h1"][:-1]) | (s["h2"][1:] != s["h2"][:-1])] if len(s) else np.empty(0, bool)
    out = np.empty(len(t), bool)
    out[order] = first
    return out


def _lost(t: np.ndarray) -> pa.RecordBatch:
    out = np.empty(len(t), RANGE)
    for c in RANGE.names:
        out[c] = t[c]
    return packed(out)


def _emit(parts: int, salts: int, least_sentences: int, least_words: int, short_words: int | None):
    def run(batches):
        for batch in batches:
            uid, doc = batch.column("uid").to_numpy(), batch.column("doc_id").to_numpy(zero_copy_only=False)
            texts = batch.column("text").to_pylist()
            for a, b in slabs(texts, SLAB):
                found = []
                for i in range(a, b):
                    h1, h2, s, e = spans(texts[i], least_sentences, least_words, short_words)
                    t = np.empty(len(s), RECORD)
                    t["h1"], t["h2"], t["doc"], t["uid"], t["start"], t["end"] = h1, h2, doc[i], uid[i], s, e
                    found.append(t)
                t = np.concatenate(found)
                first = _first_of_each(t)
                salt = int(mix(uid[a : a + 1].astype(np.uint64))[0] % np.uint64(salts))
                yield _dealt(t[first], t[~first], parts, salt)

    return run


DEALT = [("part", pa.int32()), ("salt", pa.int32()), ("batch", pa.int64()), ("records", pa.binary()), ("ranges", pa.binary())]
DEALT_DDL = "part int, salt int, batch long, records binary, ranges binary"


def _dealt(firsts: np.ndarray, others: np.ndarray, parts: int, salt: int) -> pa.RecordBatch:
    """Records that may be the first of all, packed by part, and the ranges that the others lose."""
    gone = _lost(others)
    rows = [(int(u) % parts, salt, int(u), None, r) for u, r in zip(gone.column("batch").to_pylist(), gone.column("ranges").to_pylist(), strict=True)]
    part = (mix(firsts["h1"]) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    t, part = firsts[order], part[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(t) else np.empty(0, int)
    rows += [(int(part[x]), salt, None, t[x:y].tobytes(), None) for x, y in zip(cut, np.r_[cut[1:], len(t)][: len(cut)], strict=True)]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(DEALT)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, DEALT, strict=True)], [n for n, _ in DEALT])


def _records(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """The records of a group, and its ranges as they came."""
    blobs = [x.as_py() for x in table.column("records") if x.is_valid]
    return np.frombuffer(b"".join(blobs), RECORD), table.filter(pc.is_valid(table.column("ranges")))


def _combine(parts: int):
    """The first records of a salted group, for the group itself."""

    def run(table: pa.Table) -> pa.Table:
        t, passed = _records(table)
        first = _first_of_each(t)
        return pa.concat_tables([passed, pa.Table.from_batches([_dealt(t[first], t[~first], parts, 0)])])

    return run


def _decide(table: pa.Table) -> pa.Table:
    t, passed = _records(table)
    lost = _lost(t[~_first_of_each(t)])
    return pa.concat_tables([passed.select(["batch", "ranges"]).cast(PACKED), pa.Table.from_batches([lost])])


def substring_dedup(docs: DataFrame, least_sentences: int = 3, least_words: int = 16, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text", short_words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs, and with keep_text the text that is left."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    plain = number_batches(docs, scratch, id_col, text_col)
    size = total_bytes(plain)
    # A record is about as long as the text that it stands for.
    parts, salts = groups_for(spark, size, GROUP_BYTES), -(-size // (SLAB * SLABS)) or 1
    keyed = plain.select("uid", F.coalesce("doc_id", F.lit(FIRST_ID)).alias("doc_id"), "text")
    dealt = keyed.mapInArrow(_emit(parts, salts, least_sentences, least_words, short_words), DEALT_DDL)
    if salts > 1:
        dealt = dealt.groupBy("part", "salt").applyInArrow(_combine(parts), DEALT_DDL)
    ranges = scratch.save(dealt.groupBy("part").applyInArrow(_decide, "batch long, ranges binary"))
    return cut_ranges(plain, ranges, keep_text)


def op9(spark, sf_dir):
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), short_words=SHORT_WORDS)


_MARKS = "".join(m.decode() for m in MARKS)
OP9_SQL = (
    r"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ENDS]*[ENDS]+|[^ENDS]+') AS units FROM documents),
u0 AS (SELECT doc_id, unnest(range(1, len(units) + 1)) AS pos, unnest(units) AS unit FROM l),
n0 AS (SELECT *, len(regexp_extract_all(translate(unit, 'MARKS', 'DOTS'), '[WORD]+')) AS words FROM u0),
tk AS (SELECT doc_id, pos, unnest(range(1, len(toks) + 1)) AS k, unnest(toks) AS tok FROM (SELECT *, regexp_extract_all(unit, '^[^WORD]+|[WORD]+[^WORD]*') AS toks FROM n0 WHERE words > 40)),
tl AS (SELECT *, regexp_extract(translate(tok, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[WORD]+') AS word FROM tk),
tc AS (SELECT *, coalesce(sum((word <> '' AND (strlen(word) + ('0x' || right('0' || hex(word), 2))::INT) % 4 = 3)::INT) OVER (PARTITION BY doc_id, pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sub FROM tl),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) AS pos, unit FROM (
  SELECT doc_id, pos, 0 AS sub, unit FROM n0 WHERE words <= 40 UNION ALL SELECT doc_id, pos, sub, string_agg(tok, '' ORDER BY k) FROM tc GROUP BY doc_id, pos, sub)),
w AS (SELECT doc_id, pos, regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZMARKS', 'abcdefghijklmnopqrstuvwxyzDOTS'), '[WORD]+') AS ws FROM u),
h AS (SELECT doc_id, pos, ws, row_number() OVER o AS n, sum(len(ws)) OVER o AS upto, count(*) OVER (PARTITION BY doc_id) AS m, sum(len(ws)) OVER (PARTITION BY doc_id) AS words
  FROM w WHERE len(ws) > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
b AS (SELECT a.doc_id, a.n, a.m, b.n AS enough FROM h a ASOF JOIN h b ON a.doc_id = b.doc_id AND a.upto - len(a.ws) + 16 <= b.upto),
t AS (SELECT doc_id, m, max(n) AS n FROM h WHERE words - upto + len(ws) >= 16 GROUP BY doc_id, m),
q AS (SELECT doc_id, count(*) FILTER (words > 0) AS sentences FROM n0 GROUP BY doc_id),
e AS (SELECT doc_id, n, greatest(n + 2, enough) AS upto FROM b WHERE greatest(n + 2, enough) <= m UNION SELECT doc_id, n, enough FROM b
  UNION SELECT doc_id, n, m FROM t UNION SELECT doc_id, least(n, m - 2), m FROM t WHERE m > 2
  UNION SELECT DISTINCT h.doc_id, 1, m FROM h JOIN q ON q.doc_id = h.doc_id WHERE sentences < 3 AND words >= 16),
s AS (SELECT e.doc_id, CASE WHEN e.n = 1 THEN 0 ELSE min(c.pos) END AS pos, CASE WHEN e.upto = max(c.m) THEN 1000000000 ELSE max(c.pos) END AS last, string_agg(array_to_string(c.ws, ' '), ' ' ORDER BY c.n) AS span
  FROM e JOIN h c ON c.doc_id = e.doc_id AND c.n BETWEEN e.n AND e.upto GROUP BY e.doc_id, e.n, e.upto),
r AS (SELECT *, row_number() OVER (PARTITION BY span ORDER BY doc_id, pos) AS nth FROM s),
gone AS (SELECT DISTINCT u.doc_id, u.pos FROM r JOIN u ON u.doc_id = r.doc_id AND u.pos BETWEEN r.pos AND r.last WHERE nth > 1),
f AS (SELECT u.doc_id, u.pos, unit, gone.pos IS NOT NULL AS lost FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.pos = u.pos),
g AS (SELECT *, lost AND NOT coalesce(lag(lost) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM f)
SELECT d.doc_id, coalesce(sum(strlen(unit)), 0)::BIGINT AS n_bytes, coalesce(sum(CASE WHEN lost THEN strlen(unit) END), 0)::BIGINT AS n_removed, count(*) FILTER (opens) AS n_spans,
  sha256(coalesce(string_agg(unit, '' ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256 FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id
"""
    .replace("ENDS", ENDS.replace("\n", r"\n") + _MARKS).replace("MARKS", _MARKS).replace("DOTS", "." * len(_MARKS)).replace("WORD", r"0-9A-Za-z\x{80}-\x{10FFFF}")
)
