"""Postings in blocks: one row for some 128 chunks of a term, with what bounds their scores.

A block holds its first chunk and the gaps from each chunk to the next, small numbers where a term is common, and counts
and lengths as lists; the file format packs them into as many bits as their few distinct values need. Its greatest counts and least lengths bound the weight
that the term gives any of its chunks, whatever the corpus' averages are; so blocks stay as they are when indexes are merged.
``decoded`` gives the plain postings back by column functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128
#: Weights of a term are told apart in steps of 1 / STEPS where blocks are chosen; they stay under 8.
STEPS = 16
LISTS = ("text_tf", "title_tf", "text_len", "title_len")
SCHEMA = "term string, first_id long, n int, gaps array<long>, text_tf array<int>, title_tf array<int>, text_len array<int>, title_len array<int>, top_text_tf int, low_text_len int, top_title_tf int, low_title_len int"
LIST_SCHEMA = "term string, first_id long, ids array<long>, text_tf array<int>, title_tf array<int>, text_len array<int>, title_len array<int>"
#: Terms of chunks that a task holds at once, and rows of lists that it hands on at once.
HELD, LIST_ROWS = 1 << 21, 1 << 14
#: The codec that packs best beside the format's own encodings.
PACKED = {"compression": "zstd"}


def term_lists(tokens: DataFrame, size: int = BLOCK) -> DataFrame:
    """(term, first_id, ids and ``LISTS``) of ``tokens`` (chunk_id, text_len, title_len, a, b): the terms of texts and titles.

    Each task turns some thousand chunks at a time into short lists, so few rows are sorted afterwards. A chunk_id must not
    come twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += sum(len(batch.column(c).flatten()) for c in ("a", "b"))
            if n >= HELD:
                yield from _listed(pa.Table.from_batches(held).combine_chunks(), size)
                held, n = [], 0
        if n:
            yield from _listed(pa.Table.from_batches(held).combine_chunks(), size)

    return tokens.select("chunk_id", "text_len", "title_len", "a", "b").mapInArrow(run, LIST_SCHEMA)


def _listed(table: pa.Table, size: int) -> Iterator[pa.RecordBatch]:
    n, words = table.num_rows, [table.column(c).combine_chunks() for c in ("a", "b")]
    places = [np.repeat(np.arange(n), w.value_lengths().to_numpy(zero_copy_only=False)) for w in words]
    terms = pa.concat_arrays([w.flatten() for w in words]).dictionary_encode()
    titled = np.repeat([0, 1], [len(x) for x in places])
    keys = np.sort((terms.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.concatenate(places)) * 2 + titled)
    starts = np.flatnonzero(np.diff(keys >> 1, prepend=-1))
    in_title = np.add.reduceat(keys & 1, starts)
    codes, at = np.divmod(keys[starts] >> 1, n)
    column = lambda c: table.column(c).to_numpy()[at]
    lists = [column("chunk_id"), np.diff(starts, append=len(keys)) - in_title, in_title, column("text_len"), column("title_len")]
    cuts = _starts(codes, size)
    for low in range(0, len(cuts), LIST_ROWS):
        some = cuts[low : low + LIST_ROWS]
        end = cuts[low + LIST_ROWS] if low + LIST_ROWS < len(cuts) else len(codes)
        bounds = pa.array(np.append(some, end) - some[0], pa.int32())
        parts = [pa.ListArray.from_arrays(bounds, pa.array(v[some[0] : end], pa.int32() if k else pa.int64())) for k, v in enumerate(lists)]
        yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(codes[some])), pa.array(lists[0][some], pa.int64()), *parts], names=[c.split()[0] for c in LIST_SCHEMA.split(", ")])


def _starts(codes: np.ndarray, size: int) -> np.ndarray:
    """Where runs of equal codes begin, and every ``size``-th place in them."""
    runs = np.flatnonzero(np.diff(codes, prepend=-1))
    return np.flatnonzero((np.arange(len(codes)) - np.repeat(runs, np.diff(runs, append=len(codes)))) % size == 0)


def cut_blocks(postings: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of ``postings`` (term, chunk_id, text_tf, title_tf, text_len, title_len)."""
    return merged_lists(postings.select("term", F.col("chunk_id").alias("first_id"), F.array("chunk_id").alias("ids"), *[F.array(F.col(c).cast("int")).alias(c) for c in LISTS]), size)


def merged_lists(lists: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of lists as ``term_lists`` gives them.

    Ranges of (term, first_id) are sorted and cut one after the other, so a term of any frequency is spread over tasks.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            done, left = _cut(batch, left, size, False)
            if done is not None:
                yield done
        if left is not None:
            yield _cut(None, left, size, True)[0]

    order = ["term", "first_id"]
    return lists.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, SCHEMA)


def _cut(batch: pa.RecordBatch | None, left: tuple | None, size: int, last: bool) -> tuple[pa.RecordBatch | None, tuple | None]:
    """Blocks of sorted lists after what was ``left`` (term, ids and ``LISTS``), and the postings that a later batch may go on with."""
    names, columns, sizes = [pa.array([left[0]] if left else [], pa.string())], [[c] if left else [] for c in (left[1] if left else [None] * 5)], [[len(left[1][0])] if left else []]
    if batch is not None:
        names.append(batch.column("term").cast(pa.string()))
        sizes.append(batch.column("ids").value_lengths().to_numpy(zero_copy_only=False))
        for column, c in zip(columns, ("ids", *LISTS)):
            column.append(batch.column(c).flatten().to_numpy(zero_copy_only=False))
    terms = pa.concat_arrays(names).dictionary_encode()
    codes = np.repeat(terms.indices.to_numpy(zero_copy_only=False), np.concatenate(sizes).astype(np.int64))
    if not len(codes):
        return None, None
    columns = [np.concatenate(c) for c in columns]
    if np.any((np.diff(columns[0]) < 0) & (np.diff(codes) == 0)):  # lists of chunks that lay among each other
        order = np.lexsort((columns[0], codes))
        codes, columns = codes[order], [c[order] for c in columns]
    starts, n = _starts(codes, size), len(codes)
    keep = n if last else int(starts[-1])  # the last block may not be full yet
    rest = None if last else (terms.dictionary[int(codes[-1])].as_py(), [c[keep:] for c in columns])
    starts = starts[starts < keep]
    if not len(starts):
        return None, rest
    ids, lists = columns[0], dict(zip(LISTS, columns[1:]))
    bounds = np.append(starts, keep)
    places = pa.array(bounds, pa.int32())
    as_list = lambda values: pa.ListArray.from_arrays(places, pa.array(values[:keep].astype(np.int32)))
    inner = np.ones(keep, bool)
    inner[starts] = False  # a block's first chunk has no gap before it
    gaps = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.diff(bounds) - 1)), pa.int32()), pa.array(np.diff(ids[:keep], prepend=0)[inner]))
    most, least = (lambda c: np.maximum.reduceat(lists[c][:keep], starts)), (lambda c: np.minimum.reduceat(lists[c][:keep], starts))
    rows = [
        terms.dictionary.take(pa.array(codes[starts])), pa.array(ids[starts]), pa.array(np.diff(bounds).astype(np.int32)), gaps, *[as_list(lists[c]) for c in LISTS],
        *[pa.array(v.astype(np.int32)) for v in (most("text_tf"), least("text_len"), most("title_tf"), least("title_len"))],
    ]
    return pa.RecordBatch.from_arrays(rows, names=[c.split()[0] for c in SCHEMA.split(", ")]), rest


def decoded(blocks: DataFrame) -> DataFrame:
    """(term, chunk_id, text_tf, title_tf, text_len, title_len) of blocks."""
    ids = F.expr("aggregate(gaps, array(first_id), (ids, gap) -> array_append(ids, ids[size(ids) - 1] + gap))")
    rows = blocks.select("term", ids.alias("chunk_id"), *LISTS).select("term", F.inline(F.arrays_zip("chunk_id", *LISTS)))
    return rows.select("term", "chunk_id", *[F.col(c).cast("long").alias(c) for c in ("text_tf", "title_tf")], "text_len", "title_len")


def by_bound(blocks: DataFrame, bound: Column) -> DataFrame:
    """Blocks as they are stored: by term, each term's from the greatest bound down, in files by ranges of both."""
    rows = blocks.withColumn("bound", bound)
    return rows.repartitionByRange("term", F.col("bound").desc()).sortWithinPartitions("term", F.col("bound").desc(), "first_id")


def level_of(bound: Column) -> Column:
    return F.floor(bound * STEPS).cast("int")


def levels(blocks: DataFrame) -> DataFrame:
    """(term, df, levels): how many postings of a term lie in blocks of each level, in some 130 levels at most."""
    steps = blocks.groupBy("term", level_of(F.col("bound")).alias("level")).agg(F.sum("n").alias("n"))
    return steps.groupBy("term").agg(F.sum("n").alias("df"), F.collect_list(F.struct("level", "n")).alias("levels"))
