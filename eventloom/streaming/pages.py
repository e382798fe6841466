"""Pages as a stream: clean, trim and chunk each page as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators.pagetext import chunk_text, clean_pages, trim_boilerplate


def stream_pages(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks of arriving pages. Stateless: works in append mode without a watermark."""
    return chunk_text(trim_boilerplate(clean_pages(pages), registry))


def write_chunks(chunks: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append chunks to a table; the file sink and the checkpoint make restarts exact."""
    return (
        chunks.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
