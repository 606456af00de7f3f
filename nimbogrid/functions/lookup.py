"""Small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequence_ids(df: DataFrame, key: str, name: str = "seq") -> DataFrame:
    """The distinct values of a low-cardinality key, numbered from 1 in order."""
    # The window is over distinct keys only.
    return df.select(key).distinct().withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)))


def case_map(key, mapping: dict, default=None):
    """Looks a column up in a literal mapping."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))
