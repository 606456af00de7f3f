"""Sharding by sampled splitters (DataFrame functions only).

Records are ordered by the key (64-bit hash of the text, doc_id, row number): equal texts lie side by side,
and a group of copies of any size can still be divided, since no two records have the same key. A sample
of keys, each record drawn with a probability in proportion to its size, gives quantile boundaries; records go
to the range their key falls in. A range that comes out overfull is subdivided by splitters sampled
inside it, until none is. Prefix sums over the ranges' exact totals then place each record on one line of bytes
that is cut into shards of equal length, so that two shards differ by about one record.

Law ``bytes``: each shard holds the records whose middle byte lies in its equal part of the line.

Scale: the texts are read once, into a narrow table of some 40 bytes a row. The driver gets the sample and one row
for each range, both bounded by parameters; the number of ranges grows with the number of records up to ``max_ranges``.

Defined results: null text has no bytes (size 1, crc32 of nothing); a null doc_id comes first among
equal texts; repeated rows are told apart by their place in the narrow table. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

KEY = T.StructType([T.StructField("k", T.LongType()), T.StructField("d", T.LongType()), T.StructField("u", T.LongType())])


def _literal(bounds: list[tuple[int, int, int]]) -> Column:
    """Sorted boundaries as an array literal of key structs."""
    return F.from_json(F.lit("[" + ",".join('{"k":%d,"d":%d,"u":%d}' % b for b in bounds) + "]"), T.ArrayType(KEY))


def _range_of(key: Column, bounds: list[tuple[int, int, int]]) -> Column:
    """Number of boundaries not above key, by binary search inside one expression."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = _literal(bounds)

    def step(at: Column, s: Column) -> Column:
        fits = at + s <= len(bounds)
        return F.when(fits & (F.get(table, at + s - 1) <= key), at + s).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _sample(rows: DataFrame, key: Column, rate: float, seed: int) -> list[tuple[int, int, int]]:
    """Keys of a sample in which a record has the chance min(1, size * rate)."""
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "k", "d", "u"), 11) / float(1 << 53)) < F.col("size") * rate
    return sorted((r[0]["k"], r[0]["d"], r[0]["u"]) for r in rows.filter(draw).select(key).collect())


def _quantiles(sample: list, parts: int) -> list:
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def shard_documents(
    docs: DataFrame, shards: int = 16, ranges_per_shard: int = 16, rows_per_range: int = 1_000_000, max_ranges: int = 32768, draws_per_range: int = 16, overfull: float = 3.0, max_rounds: int = 8
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (columns doc_id, text)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = scratch.save(
        docs.select(
            "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.monotonically_increasing_id().alias("u"),
        )
    )
    key = F.struct("k", "d", "u")
    rows, total = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = min(max_ranges, max(shards * ranges_per_shard, -(-rows // rows_per_range)))
    bounds = _quantiles(_sample(narrow, key, wanted * draws_per_range / max(1, total), 0), wanted)
    for again in range(1, max_rounds + 1):
        ranged = narrow.withColumn("range", _range_of(key, bounds))
        sums = {r["range"]: (r["bytes"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
        full = {r: b for r, (b, n) in sums.items() if n > 1 and b > overfull * total / wanted}
        if not full:
            break
        # Subdivide the overfull ranges only: a denser sample inside them.
        inside = ranged.filter(F.col("range").isin(sorted(full)))
        finer = _sample(inside, key, wanted * draws_per_range * 4**again / max(1, total), again)
        add: set = set()
        for r in full:
            own = [x for x in finer if bisect_right(bounds, x) == r]
            add |= set(_quantiles(own, 1 + int(2 * full[r] * wanted // max(1, total))))
        bounds = sorted({*bounds, *add})
    offsets, at_byte, at_row = [], 0, 0
    for r in range(len(bounds) + 1):
        offsets.append((r, at_byte, at_row))
        at_byte, at_row = at_byte + sums.get(r, (0, 0))[0], at_row + sums.get(r, (0, 0))[1]
    heads = spark.createDataFrame(offsets, "range int, byte0 long, row0 long")  # one row per range, at most max_ranges and what overfull ranges add
    order = Window.partitionBy("range").orderBy("k", "d", "u")
    line = (
        ranged.withColumn("through", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(heads), "range")
        .withColumn("middle", F.col("byte0") + F.col("through") - F.expr("(size + 1) div 2"))
        .withColumn("row", F.col("row0") + F.col("nth") - 1)
    )
    # decimal: the product may pass 64 bits
    shard = F.least(F.lit(shards - 1), F.floor(F.col("middle").cast("decimal(38,0)") * shards / F.lit(max(1, total))).cast("int"))
    placed = scratch.save(line.select("doc_id", "size", "text_crc32", shard.alias("shard"), "row"))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4(spark, sf_dir):
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
