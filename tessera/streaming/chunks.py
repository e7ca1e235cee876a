"""Chunking a stream of documents: each micro-batch is a table, so the batch plan runs on it as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.segment import SegmentEngine


def chunk_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, engine: SegmentEngine | None = None) -> StreamingQuery:
    """Parquet files that arrive in `source` to chunks in `sink`; ends when all that is there is done.

    A batch is written to a folder of its own number, so a batch that is run again replaces itself.
    """
    engine = engine or SegmentEngine()
    docs = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        engine.chunk(batch.select("doc_id", "text")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
