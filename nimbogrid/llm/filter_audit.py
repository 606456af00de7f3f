r"""How filters interact: what each removes, alone and in any order.

Every document gets a mask of the filters that it fails; masks are counted by part, and all orders are worked out from the counts, at most 32 a part.
The five filters, by letter: A too few words; B too few different words; C too many capitals; D holds a symbol; E equal to the text of a smaller doc_id.

A to D come from one scan of Arrow's buffers: byte classes mark words, capitals and symbols, prefix sums count them by text, and the sorted hashes of
a text's words, verified by their bytes, give the number of different words. E compares texts by value: the texts are grouped, each with its smallest doc_id; a
128-bit hash only carries that doc_id back to the documents, after it has been checked that no two of the distinct texts have one hash (should two
ever have, it is done again under another seed).

Of filters that a document fails, each comes first in equally many orders: of the n! orders of n filters one of k failed ones is first in n! / k. So the sum over
all orders of what a filter removes (``shapley``) is the sum of n! / k over the documents that fail it, a whole number.

Scale: the texts cross the network once, combined before the shuffle, so that a text shared by a third of all rows arrives once per task. The scan has
no shuffle. Documents are joined by doc_id with their labels and by hash with their text's smallest doc_id, in plain sort-merge joins whose hot keys
adaptive execution splits; after that there are only counts by part and mask.

Defined results: a null text is empty, a null part the empty string. A document with a null doc_id never fails E and is no text's first. Of rows with one doc_id and one
text none is later than the other. A document counts as good (toxic) when any label row of its doc_id says so. An empty table gives no parts and no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import Scratch

FILTERS = "ABCDE"
SYMBOL = scan.byte_class("#$%&*|")
SCANNED = "doc_id long, part string, h1 long, h2 long, mask int"


def masks(raw: np.ndarray, offsets: np.ndarray, least_words: int = 50, least_distinct: int = 65, most_capitals: int = 5) -> np.ndarray:
    """Bits 1, 2, 4, 8 of each text of a slab: whether it fails A, B, C, D. The last two are per cent of words and of code points."""
    start, end, text = scan.words(~scan.SPACE[raw], offsets)
    texts = len(offsets) - 1
    n = np.bincount(text, minlength=texts)
    different = scan.distinct_words(raw, start, end, text, texts)
    points, capitals, symbols = (scan.per_text(kind[raw], offsets) for kind in (scan.LEAD, scan.CAPITAL, SYMBOL))
    return (n < least_words) + 2 * (100 * different < least_distinct * n) + 4 * (100 * capitals > most_capitals * points) + 8 * (symbols > 0)


def _scan(limits: tuple):
    def run(batches):
        for batch in batches:
            for rows, raw, offsets in scan.slabs(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "part", "h1", "h2")), pa.array(masks(raw, offsets, *limits), pa.int32())], ["doc_id", "part", "h1", "h2", "mask"])

    return run


def failures(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", least_words: int = 50, least_distinct: int = 65, most_capitals: int = 5) -> DataFrame:
    """doc_id, part, mask of each row of docs: bit 2**k is set when the k-th of FILTERS fails."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    seed = 0
    while True:
        route = [F.xxhash64(F.lit(2 * seed), "text").alias("h1"), F.xxhash64("text", F.lit(2 * seed + 1)).alias("h2")]
        firsts = scratch.save(plain.groupBy("text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).select(*route, "first", "n"))
        if firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").isEmpty():
            break
        scratch.drop(firsts)
        seed += 1
    scanned = plain.select("doc_id", "part", *route, "text").mapInArrow(_scan((least_words, least_distinct, most_capitals)), SCANNED)
    copies = firsts.filter("n > 1").select("h1", "h2", "first")
    later = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return scanned.join(copies, ["h1", "h2"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(later, F.lit(16)).otherwise(F.lit(0))).alias("mask"))


def audit(failed: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What every order of the filters does in each part of failed (doc_id, part, mask): a row per part, filter_order and step.

    labels (doc_id, quality, toxic): documents with quality 1 are good, with toxic 1 toxic. Of a part there are at most 2**n counts.
    """
    n = len(filters)
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = failed.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("docs"), F.count(F.when(F.col("good") == 1, 1)).alias("good"), F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic")
    )
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("held"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = held.select("part", "held", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    before = sum((F.when(F.instr(earlier, f) > 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(filters)), F.lit(0))
    own = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    rows = steps.select("part", "filter_order", "step", "held", before.alias("before"), own.alias("own"))
    shares = F.array(*[F.lit(0 if k == 0 else math.factorial(n) // k).cast("long") for k in range(n + 1)])

    def total(what, condition):
        chosen = F.filter("held", lambda x: condition(x["mask"]))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda acc, x: acc + what(x))

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    docs = lambda x: x["docs"]
    return rows.select(
        "part", "filter_order", "step", total(docs, lambda m: ~fails(m) & ~gone(m)).alias("kept"), total(docs, here).alias("removed"), total(docs, lambda m: fails(m) & gone(m)).alias("redundant"),
        total(docs, lambda m: m == F.col("own")).alias("unique_fails"), total(lambda x: x["good"], here).alias("good_lost"), total(lambda x: x["toxic"], here).alias("toxic_lost"),
        total(lambda x: x["docs"] * F.get(shares, F.bit_count(x["mask"])), fails).alias("shapley"),
    )


def op13(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(failures(docs.select("doc_id", "text", "source"), Scratch(spark)), labels)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END) AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS docs, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
  list_sum([1 << (ascii(x) - 65) for x in string_split(filter_order, '')[1:step - 1]]) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step::INT AS step, own, coalesce(sum(docs) FILTER (mask & (own | coalesce(before, 0)) = 0), 0)::BIGINT AS kept,
  coalesce(sum(docs) FILTER (mask & own <> 0 AND mask & coalesce(before, 0) = 0), 0)::BIGINT AS removed, coalesce(sum(docs) FILTER (mask & own <> 0 AND mask & coalesce(before, 0) <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(docs) FILTER (mask = own), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (mask & own <> 0 AND mask & coalesce(before, 0) = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & coalesce(before, 0) = 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
