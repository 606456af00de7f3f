"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the docs of
the next one. All but the last return the columns of ``documents``.

Defined results: further columns, whatever their names, go through all stages but the last, whose columns are its own. Rows are told apart by numbers of
their own, never by doc_id: a null doc_id stays null, and of fully repeated rows one is left after exact dedup. A document whose text is null, empty or
without a letter goes in the language stage. An empty table gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nimbogrid.llm import decontamination, exact_dedup, language_id, near_dedup, packing
from nimbogrid.llm.common import Scratch


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; learned from the labels of rows that op1 may learn from."""
    labelled = docs.filter(~language_id.held_out()).select("doc_id", "text", "lang")
    return language_id.keep_identified(docs, labelled)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_distinct(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near no earlier one: candidates by SimHash and by bands of minimum hashes, similarity of five-word shingles 0.8 or more."""
    return near_dedup.keep_one_of_each(docs, words=5, similarity=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the networks nor the hashes of these stages; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
