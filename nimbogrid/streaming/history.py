"""History intervals and quality control on streams, beside the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import qc


def history_stream(samples: DataFrame, ts: str, interval: str, delay: str, keys: list[str], value: str, dt: str) -> DataFrame:
    """Weighted mean, least and greatest value of closed intervals of a stream; a missing sample does not count.

    Samples that come later than ``delay`` after the newest are dropped; an interval is emitted once, when it is closed.
    """
    v, w = F.col(value), F.col(dt)
    g = samples.withWatermark(ts, delay).groupBy(F.window(ts, interval), *keys)
    out = g.agg(F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.count(v).alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "mean", "least", "most", "n")


def qc_stream(obs: DataFrame, factor: float = 3.0) -> DataFrame:
    """Row-local checks of a stream of observations: the same rules as in batch."""
    rules = [(F.col("dep").isNull(), qc.BAD_VALUE), (qc.gross_error(F.col("dep"), F.col("err"), factor), qc.GROSS_ERROR)]
    return obs.withColumn("qc", qc.first_code(rules))


def closing(spark: SparkSession, folder: str, stream: DataFrame, ts: str, end: str) -> DataFrame:
    """A stream of one row that is later than all others, to be added to one that has ended: the watermark passes its last interval, which is then emitted too.

    The row's other columns are null. Its own interval is never closed.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    row = spark.range(1).select(*[F.to_timestamp_ltz(F.lit(end)).alias(c) if c == ts else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    row.write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(stream.schema).parquet(folder)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes all that the source has and stops; restarts go on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
