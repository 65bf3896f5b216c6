"""Hierarchical packing into several context sizes.

A document is tokenized and routed to the smallest tier that holds it; longer ones first give full windows of the
largest tier. Tiers are packed from the longest down: a window takes one document of its tier, then the longest
shorter ones that fit its gap; where none fits, one is cut to fill the gap and its rest is routed again. So every
window is full and no tier needs padding. What is left at the end of a group of documents, less than a window, is its
tail. The tails of all groups and tasks are laid end to end and cut into windows of the largest tier, so that the whole
table, however it is partitioned, has one padded window at most.

Windows are dealt to step groups, the longest first, each to the group with the fewest tokens so far. As tiers divide each
other and a step, no group gets more than ``step_tokens`` tokens, all have the same within one window, and windows of every
tier, and with them the work of attention, are shared out evenly.

A task packs the documents it reads, in groups of bounded size; texts are not shuffled. The pieces are written to the
shared folder, tails with their token ids; sequence numbers and the places of tails follow from one row of totals per task.
``op10_packing`` deals a table of fewer than ``LEAST_PARTS`` partitions by hash to that many first, in an order of its own,
so that a small file keeps more than one core busy; that number is fixed, and the packing the same on any number of cores.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fennwick.llm.common import bound_batches, materialize, small_table, table, utf8
from fennwick.llm.tokens import CACHE_WORDS, default_vocabulary, encoder, passing_encoder

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 32_768
END_ID = 1
#: A task packs its documents in groups of so many tokens; bounds its memory.
GROUP_TOKENS = 4_000_000
#: A table of fewer partitions is dealt to so many.
LEAST_PARTS = 16


class Pool:
    """Pieces (doc, start) by length, with the longest not above and the shortest not below a bound in one step."""

    def __init__(self, longest: int):
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.mask = 0

    def add(self, length: int, doc: int, start: int) -> None:
        self.by_length[length].append((doc, start))
        self.mask |= 1 << length

    def at_most(self, length: int) -> int:
        return (self.mask & ((2 << length) - 1)).bit_length() - 1 if self.mask & ((2 << length) - 1) else 0

    def above(self, length: int) -> int:
        over = self.mask >> (length + 1) << (length + 1)
        return (over & -over).bit_length() - 1 if over else 0

    def take(self, length: int) -> tuple[int, int]:
        piece = self.by_length[length].pop()
        if not self.by_length[length]:
            self.mask &= ~(1 << length)
        return piece


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, pieces (doc, start, length)) of documents of the given lengths.

    All windows but the last hold exactly as many tokens as their tier; the last has the largest tier and may be short.
    """
    largest, pool, windows = tiers[-1], Pool(tiers[-1]), []
    for doc in range(len(lengths) - 1, -1, -1):
        start, left = 0, lengths[doc]
        while left >= largest:
            windows.append((largest, [(doc, start, largest)]))
            start, left = start + largest, left - largest
        if left:
            pool.add(left, doc, start)
    tail: list[tuple[int, int, int]] = []
    for tier in reversed(tiers):
        floor = tier // 2 if tier != tiers[0] else 0
        while (length := pool.at_most(tier)) > floor:
            pieces, gap = [(*pool.take(length), length)], tier - length
            while gap:
                if fits := pool.at_most(gap):
                    pieces.append((*pool.take(fits), fits))
                    gap -= fits
                elif longer := pool.above(gap):
                    doc, start = pool.take(longer)
                    pieces.append((doc, start, gap))
                    pool.add(longer - gap, doc, start + gap)
                    gap = 0
                else:
                    break
            if gap:
                tail.extend(pieces)
            else:
                windows.append((tier, pieces))
    rest: list[tuple[int, int, int]] = []
    room = largest
    for doc, start, length in tail:  # less than one window is left in the pool when a gap stays open
        while length >= room:
            windows.append((largest, [*rest, (doc, start, room)]))
            start, length, rest, room = start + room, length - room, [], largest
        if length:
            rest.append((doc, start, length))
            room -= length
    if rest:
        windows.append((largest, rest))
    return windows


def balance(windows: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """The step group of each window, given their tiers: as few groups as hold them, even in tokens and in tiers."""
    loads = [(0, g) for g in range(-(-sum(windows) // step_tokens))]
    out = [0] * len(windows)
    for w in sorted(range(len(windows)), key=lambda w: -windows[w]):
        tokens, out[w] = loads[0]
        heapq.heapreplace(loads, (tokens + windows[w], out[w]))
    return out


def pack_documents(docs: DataFrame, vocabulary: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text: str = "text", with_ids: bool = False, cache_words: int = CACHE_WORDS, stay: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    ``cache_words`` bounds what a worker remembers of words, which lasts from task to task if it is to ``stay``. A step must
    be a multiple of every tier. How documents share windows depends on the files' splits, their tokens don't; all windows but one are full. ``with_ids`` adds the piece's
    ids as little-endian unsigned 32-bit integers. Null and empty texts are the end id alone; repeated rows are packed
    each, null ids too; an empty table gives no rows; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    largest = tiers[-1]
    names = ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "seq", "offset", "tier", "step", "ids"]
    schema = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, seq long, offset long, tier int, step long, ids binary"
    kinds = [pa.int32(), *[pa.int64()] * 7, pa.int32(), pa.int64(), pa.binary()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        seq, steps, over, held, ids, bodies = 0, 0, 0, 0, [], []

        def close() -> pa.RecordBatch:
            nonlocal seq, steps, over, held, ids, bodies
            rows, windows = [], pack([len(b) // 4 for b in bodies], tiers)
            tail = windows.pop()[1] if windows and sum(n for _, _, n in windows[-1][1]) < windows[-1][0] else []
            groups = balance([tier for tier, _ in windows], step_tokens)
            for (tier, pieces), group in zip(windows, groups):
                offset = 0
                for doc, start, length in pieces:
                    piece = bodies[doc][4 * start : 4 * (start + length)]
                    rows.append((part, ids[doc], start, length, zlib.crc32(piece), len(bodies[doc]) // 4, seq, offset, tier, steps + group, piece if with_ids else None))
                    offset += length
                seq += 1
            for doc, start, length in tail:  # seq is null: placed once all tails are known
                rows.append((part, ids[doc], start, length, None, len(bodies[doc]) // 4, None, over, largest, None, bodies[doc][4 * start : 4 * (start + length)]))
                over += length
            steps, held, ids, bodies = steps + max(groups, default=-1) + 1, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        with nullcontext(encoder(vocabulary, cache_words)) if stay else passing_encoder(vocabulary, cache_words) as words:
            for batch in batches:
                for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                    done = words.encode(body.as_py()) + end
                    ids.append(doc_id)
                    bodies.append(done)
                    held += len(done) // 4
                    if held >= group_tokens:
                        yield close()
            if ids:
                yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text).alias("body"))
    pieces = materialize(rows.mapInArrow(write, schema), "packed")
    ends = pieces.groupBy("part").agg(F.max("seq").alias("seq"), F.max("step").alias("step"), F.max(F.when(F.col("seq").isNull(), F.col("offset") + F.col("length"))).alias("over"))
    base, s, t, o = {"part": [], "_seq": [], "_step": [], "_over": []}, 0, 0, 0
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # a row for each task
        for column, value in zip(base.values(), (r["part"], s, t, o)):
            column.append(value)
        s, t, o = s + (-1 if r["seq"] is None else r["seq"]) + 1, t + (-1 if r["step"] is None else r["step"]) + 1, o + (r["over"] or 0)
    firsts = small_table(docs.sparkSession, base, "part int, _seq long, _step long, _over long")
    numbered = pieces.join(F.broadcast(firsts), "part")  # as many rows as tasks
    kept = ["ids"] if with_ids else []
    fixed = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = numbered.where("seq is not null").select(*fixed, (F.col("seq") + F.col("_seq")).alias("sequence_id"), "offset", "tier", (F.col("step") + F.col("_step")).alias("step_group"), *kept)
    at = numbered.where("seq is null").withColumn("at", F.col("_over") + F.col("offset"))
    cut = at.select("*", F.explode(F.expr(f"sequence(at div {largest}, (at + length - 1) div {largest})")).alias("window"))
    cut = cut.withColumn("low", F.greatest("at", F.col("window") * largest)).withColumn("n", F.least(F.col("at") + F.col("length"), (F.col("window") + 1) * largest) - F.col("low"))
    cut = cut.withColumn("piece", F.col("ids").substr((4 * (F.col("low") - F.col("at")) + 1).cast("int"), (4 * F.col("n")).cast("int")))
    tails = cut.select(
        "doc_id", (F.col("start") + F.col("low") - F.col("at")).alias("start"), F.col("n").alias("length"), F.crc32("piece").alias("ids_crc32"), "doc_tokens", (F.lit(s) + F.col("window")).alias("sequence_id"),
        (F.col("low") - F.col("window") * largest).alias("offset"), "tier", (F.lit(t) + F.floor(F.col("window") / (step_tokens // largest))).alias("step_group"), *([F.col("piece").alias("ids")] if with_ids else []),
    )
    return full.unionByName(tails)


def dealt(docs: DataFrame, least: int = LEAST_PARTS) -> DataFrame:
    """A scan's rows as they lie or, from fewer than ``least`` partitions, dealt by hash to so many, in a fixed order."""
    if docs.rdd.getNumPartitions() >= least:
        return docs
    key = F.xxhash64("doc_id", "text")
    return docs.repartition(least, key).sortWithinPartitions(key)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), default_vocabulary())
