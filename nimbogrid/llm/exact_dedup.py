"""Exact deduplication by deterministic block naming (DataFrame functions only).

The normalised text of a row (white space ``[\\x20\\x09-\\x0D]`` deleted, as UTF-8) is cut into blocks of a
fixed number of bytes. The distinct blocks are sorted and numbered; then adjacent names are paired, the
distinct pairs are sorted and numbered in turn, and so on until every document has one name. Two documents
get the same (level, name) if and only if their normalised texts are the same bytes: names are given to
contents, not to hashes. A 128-bit hash only routes a block to its name; that no two of the distinct blocks have one
hash is checked over the whole table, and should two ever have, all of it is done again under another seed.

Scale: the contents cross the network once, combined before the shuffle, so a block shared by a third of
all rows arrives once per map task. Every other shuffle carries 64-bit names. The joins on names are plain
sort-merge joins, so that adaptive execution splits the partitions of hot names.

Defined results: null text counts as empty; an empty text is a text like any other, equal to other empty
ones. A null ``doc_id`` is ordered after all others. Of fully repeated rows one is kept. An empty table gives
an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unused

SPACES = r"[\x20\x09-\x0D]+"
#: Nearly all texts are longer, so that they are named by pairs.
BLOCK_BYTES = 512


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def _last_block(raw: Column, block_bytes: int) -> Column:
    """Number of the last block, from 0; an empty text has one empty block."""
    return F.greatest(F.lit(0), F.floor((F.octet_length(raw) - 1) / F.lit(block_bytes))).cast("int")


def _block(raw: Column, number: Column, block_bytes: int) -> Column:
    return F.substring(raw, number * F.lit(block_bytes) + 1, F.lit(block_bytes))


def _route(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("h1"), F.xxhash64(block, F.lit(2 * seed + 1)).alias("h2"))


def _sorted_names(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers distinct keys by their order inside each hash partition: one number per key, none twice."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(rows: DataFrame, scratch: Scratch, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(heads, names) of rows (uid, doc_id, text): heads has uid, doc_id, n_chars and text_sha256 of each; names has uid, level, name."""
    if block_bytes < 1:
        raise ValueError("block_bytes must be positive")
    plain = rows.withColumn("text", F.coalesce("text", F.lit("")))
    seed = 0
    while True:
        cut = plain.select("uid", "doc_id", F.length("text").alias("n_chars"), normalised(F.col("text")).alias("norm"))
        cut = cut.withColumn("raw", F.col("norm").cast("binary"))
        numbers = F.sequence(F.lit(0), _last_block(F.col("raw"), block_bytes))
        heads = scratch.save(
            cut.select(
                "uid", "doc_id", "n_chars", F.sha2("raw", 256).alias("text_sha256"),
                F.transform(numbers, lambda i: _route(_block(F.col("raw"), i, block_bytes), seed)).alias("keys"),
            )
        )
        # The distinct blocks are grouped by their bytes and sorted into integer names; only the name and the hash are kept.
        # Numbers are exploded, not blocks: an array of blocks would be made a second time by the filter that an explode brings.
        contents = cut.select("raw", F.explode(numbers).alias("i")).select(_block(F.col("raw"), F.col("i"), block_bytes).alias("block")).distinct()
        names = scratch.save(_sorted_names(contents, ["block"]).select(_route(F.col("block"), seed).alias("k"), "name").select("k.*", "name"))
        if names.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            break
        scratch.drop(heads, names)
        seed += 1
    spread = heads.select("uid", F.size("keys").alias("width"), F.posexplode("keys").alias("pos", "k")).select("uid", "width", "pos", "k.*")
    named = spread.join(names.select("h1", "h2", "name"), ["h1", "h2"]).select("uid", "width", "pos", "name")
    widest = heads.agg(F.coalesce(F.max(F.size("keys")), F.lit(1))).first()[0]
    done, level = None, 0
    while True:
        here = scratch.save(named)
        found = here.filter("width = 1").select("uid", F.lit(level).alias("level"), "name")
        done = found if done is None else done.unionByName(found)
        if widest == 1:
            return heads.drop("keys"), done
        pairs = here.filter("width > 1").groupBy("uid", "width", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pair_names = scratch.save(_sorted_names(pairs.groupBy("a", "b").agg(F.lit(0).alias("one")).drop("one"), ["a", "b"]))
        named = pairs.join(pair_names, ["a", "b"]).select("uid", F.expr("(width + 1) div 2").cast("int").alias("width"), "pos", "name")
        widest, level = (widest + 1) // 2, level + 1


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Rows are in one group when their texts are equal without white space. The row with the most code points in
    its original text stays, then the one with the smallest doc_id.
    """
    # Numbered as they are read, once: only the saved heads are joined by number.
    plain = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _decided(plain, Scratch(docs.sparkSession), block_bytes).drop("uid")


def keep_distinct(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay. The rows are numbered once, in a saved copy."""
    scratch, uid = Scratch(docs.sparkSession), unused(docs, "row")
    rows = scratch.numbered(docs, uid)
    plain = rows.select(F.col(uid).alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = _decided(plain, scratch, block_bytes).filter(~F.col("kept")).select(F.col("uid").alias(uid))
    return rows.join(gone, uid, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def _decided(plain: DataFrame, scratch: Scratch, block_bytes: int) -> DataFrame:
    heads, names = identities(plain, scratch, block_bytes)
    rows = heads.join(names, "uid")
    # bitwise_not turns the order of integers round without overflow.
    best = F.max(F.struct("n_chars", F.bitwise_not(F.col("doc_id").cast("long")).alias("d"), F.bitwise_not("uid").alias("u"), "doc_id", "uid"))
    groups = rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    groups = groups.select("level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"))
    return rows.join(groups, ["level", "name"]).select(
        "uid", "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256", "n_chars"
    )


def op8(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
