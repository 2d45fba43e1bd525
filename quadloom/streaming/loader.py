"""Continuous loading of N-Quads files with Structured Streaming.

Parsing is stateless, so each micro-batch is the batch loader's plan. Repeats inside a batch are removed before
it is appended, those across batches at the next compaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadloom.sources import ntriples, quads


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Quads (g, s, p, o) of N-Quads files that appear in a folder."""
    lines = spark.readStream.schema("value string").format("text").load(path).select("value", F.col("_metadata.file_path").alias("file"))
    return ntriples.parse(lines, "value", "file")[0]


def append(source: DataFrame, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a stream of quads to a store, each micro-batch as a set. A batch that is tried again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        quads.typed(quads.dedup(batch)).sortWithinPartitions("p", "o_num", "o", "s").write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/batch={number}")

    out = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Writes the set of all batches as one store."""
    quads.write(spark.read.parquet(store).drop("batch"), target)
