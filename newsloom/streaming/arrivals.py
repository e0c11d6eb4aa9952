"""Articles that keep arriving: the stateless stages on a stream, each id once.

The batch stages up to sentences are row-wise, so they run on a stream as they are; only the removal of repeated
deliveries keeps state, bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators import segment

SCHEMA = "id string, date date, type string, headline string, paragraphs array<string>, ingested_at timestamp"


def arriving(spark: SparkSession, path: str, late: str = "90 days", files_per_trigger: int = 1_000) -> DataFrame:
    """Articles of parquet files as they come, the first delivery of each id within the watermark."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.where("id is not null").withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["id"])


def sentence_stream(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the sentences of arriving articles, then stops when all files there are have been read."""
    sents = segment.sentences(arriving(spark, path))
    return sents.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
