"""An append path for postings: documents arrive as a stream, their postings are written by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fennwick.functions import text as T
from fennwick.operators.chunk_index import build_index


def stream_postings(chunks: DataFrame, out: str, checkpoint: str, segmenter: T.Segmenter = T.word_runs) -> StreamingQuery:
    """Write each batch of a stream of chunks (chunk_id, title, text) as a segment of the index in ``out``.

    A batch is written to the folder of its number, so a batch that is tried again replaces itself. ``ChunkIndex.load`` reads
    all segments as one index, with the statistics of them all; ``merge_indexes`` makes one of many. Null texts and titles are
    empty; a batch without any text is an empty segment; a chunk_id that comes again is a second chunk.
    """

    def write(batch: DataFrame, number: int) -> None:
        build_index(batch, segmenter=segmenter).save(f"{out}/segment={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and value by window and type, with a watermark for late rows; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
