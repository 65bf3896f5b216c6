"""The chunk index build: articles to chunks, directory chunks, filters, distinct texts, index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fennwick.functions import cleaning as L
from fennwick.functions import text as T
from fennwick.operators import chunking as K
from fennwick.operators.chunk_index import ChunkIndex, build_index
from fennwick.plans.catalog_build import number_rows


def build_chunks(articles: DataFrame, theme: str = "", size: int = K.CHUNK, edits: DataFrame | None = None) -> DataFrame:
    """(chunk_id, title, text) of ``articles`` (doc, text): sections where there are any, windows elsewhere.

    Chunks of little value go, then all but the first of equal texts. chunk_id follows doc, section and part.
    """
    sections = K.parse_sections(articles)
    cut = K.chunk_sections(sections, size)
    plain = articles.join(sections.select("doc").distinct(), "doc", "left_anti")
    windows = K.chunk_windows(plain, size).select("doc", F.col("start").cast("long").alias("seq"), F.lit(0).alias("part"), F.lit(theme).alias("title"), "text")
    chunks = cut.select("doc", F.col("seq").cast("long").alias("seq"), "part", "title", "text").unionByName(windows)
    if theme:
        made = K.directory_chunks(K.character_directory(sections), theme, edits)
        chunks = chunks.unionByName(made.select(F.lit(None).cast(dict(chunks.dtypes)["doc"]).alias("doc"), F.lit(0).cast("long").alias("seq"), F.col("title").contains("萌点").cast("int").alias("part"), "title", "text"))
    worth = chunks.where(~L.low_value(F.col("text"), F.col("title")) & L.readable(F.col("text")))
    kept = K.first_of_equal(worth.withColumn("late", F.col("doc").isNull()), ["late", "doc", "seq", "part"])
    # Numbered, not hashed: 64 bits would clash among some 1e9 chunks and join the postings of two.
    placed = kept.withColumn("_doc", F.col("doc")).withColumn("_seq", F.col("seq")).withColumn("_no", F.col("part"))
    return number_rows(placed, ("late", "_doc", "_seq", "_no"), "chunk_id").select("chunk_id", "title", "text", "doc", "seq", "part")


def build_chunk_index(articles: DataFrame, theme: str = "", size: int = K.CHUNK, edits: DataFrame | None = None, segmenter: T.Segmenter = T.word_runs) -> ChunkIndex:
    """The index of ``articles``; raises if no chunk is left."""
    index = build_index(build_chunks(articles, theme, size, edits), [theme] if theme else [], segmenter)
    if index.chunks.isEmpty():
        raise ValueError("no chunk is left of these articles")
    return index
