"""The extractor on a stream of pages.

Features look at a page's other blocks through windows that aren't over time, which
a streaming plan doesn't allow. Pages are independent, so each micro-batch is
extracted as a table of its own. Raw blocks alone need no such window and stream
directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators import parse
from gleaner.operators.model import Extractor


def page_stream(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A stream of Parquet pages (page_id, url, html) arriving in a folder."""
    reader = spark.readStream.schema("page_id long, url string, html string")
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def raw_block_stream(pages: DataFrame) -> DataFrame:
    """Raw blocks of a stream of pages; stateless."""
    return parse.raw_blocks(pages)


def extract_stream(pages: DataFrame, output: str, checkpoint: str, extractor: Extractor | None = None) -> StreamingQuery:
    """Starts writing (page_id, content) to ``output``; handles what is there, then ends.

    A batch has a folder of its own that a repeated batch replaces, so each page is
    written once however often a batch is tried.
    """
    extractor = extractor or Extractor()

    def write(batch: DataFrame, number: int) -> None:
        extractor.extract(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
