"""The fixed blocks over a stream of documents: stateless, the same plan as over a table. Vocabularies are fitted in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from penprint.config import ENGLISH, PreprocessingConfig
from penprint.plans import blocks as B
from penprint.plans.view import document_view


def stream_documents(spark: SparkSession, path: str, schema: str, files_each: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def stream_features(docs: DataFrame, blocks: Sequence[B.Block], config: PreprocessingConfig = ENGLISH, **columns) -> DataFrame:
    """Long features of streamed documents."""
    return B.long(document_view(docs, config, **columns), blocks)


def write_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet; each document's features are written exactly once, also after a restart from ``checkpoint``."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
