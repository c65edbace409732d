"""Evidence as a stream: appended idempotently, so a replay leaves the same graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from latticework.plans.graph import EDGE, EVIDENCE_SCHEMA, Graph, conform, graph_from


def evidence_stream(spark: SparkSession, path: str, *, max_files: int = 100) -> DataFrame:
    """New evidence files of a folder, with the fixed schema."""
    return spark.readStream.schema(EVIDENCE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def append(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch to its own folder; a batch that is replayed replaces itself, and evidence is a set anyway."""

    def put(batch: DataFrame, number: int) -> None:
        conform(batch).distinct().write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def graph_at(spark: SparkSession, target: str) -> Graph:
    """The graph of all batches so far."""
    return graph_from(spark.read.schema(EVIDENCE_SCHEMA).parquet(target))


def edge_counts_by_window(stream: DataFrame, *, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, origin, target, kind, n): edges seen in each tumbling window; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *EDGE).agg(F.count(F.lit(1)).alias("n"))
