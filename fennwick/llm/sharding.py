"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``slots`` equal arcs of the 64-bit hash space. Each shard owns ``vnodes`` points on it, and a key belongs
to the next point clockwise. A shard that is full passes its overflow on, still clockwise, to the next point whose
shard has room. Only the number of rows per slot reaches the driver (``slots`` numbers, whatever the size of the
input); there the walk around the ring turns slots into segments, and each row finds its segment by its rank in its
slot. Shuffles carry a few numbers per row, never the text. Rows that are equal in key, size and checksum are one row with
a count until the end, and a slot is ranked in ``SUBS`` parts by the texts' checksums, so that a key with very many rows
is not one task's work.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fennwick.llm.common import materialize, utf8

SLOT_BITS = 14
VNODES = 64
#: Parts of a slot by the highest bits of the text's checksum, and equal rows that one row is unfolded into at once.
SUB_BITS = 4
CHUNK = 1 << 16


def ring_points(shards: int, vnodes: int = VNODES, slot_bits: int = SLOT_BITS) -> list[tuple[int, int]]:
    """(slot, shard) of each virtual node, clockwise. A shard's points don't depend on how many shards there are."""
    points = []
    for shard in range(shards):
        for v in range(vnodes):
            h = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big")
            points.append((h, shard))
    points.sort()
    return [(h >> (64 - slot_bits), shard) for h, shard in points]


def capacities(total: int, shards: int, epsilon: float = 0.0) -> list[int]:
    """Most rows of each shard. With ``epsilon`` 0 they add up to ``total``, so counts are at most one apart."""
    if epsilon > 0:
        return [math.ceil((1 + epsilon) * total / shards)] * shards
    low, more = divmod(total, shards)
    return [low + (s < more) for s in range(shards)]


def walk_ring(counts: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments (slot, first rank, end rank, shard, first place in the shard) of the bounded-load walk.

    At each point the rows of its own arc come first, then what earlier points passed on, oldest first.
    """
    room, load = list(room), [0] * len(room)
    own: list[list[tuple[int, int, int]]] = [[] for _ in points]
    k = 0
    for slot in sorted(counts):
        while k < len(points) and points[k][0] < slot:
            k += 1
        own[k % len(points)].append((slot, 0, counts[slot]))
    carried: deque[tuple[int, int, int]] = deque()
    segments = []
    for turn in range(3):
        for (_, shard), mine in zip(points, own):
            waiting = deque(mine if turn == 0 else ())
            waiting.extend(carried)
            carried = deque()
            while waiting:
                slot, a, b = waiting.popleft()
                take = min(b - a, room[shard])
                if take:
                    segments.append((slot, a, a + take, shard, load[shard]))
                    room[shard] -= take
                    load[shard] += take
                if a + take < b:
                    carried.append((slot, a + take, b))
                    if not room[shard]:
                        carried.extend(waiting)
                        break
        if not carried:
            return segments
    raise ValueError("the shards' capacities are less than the rows")


def slot_of(key: Column, slot_bits: int = SLOT_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - slot_bits).cast("int")


def assign_shards(docs: DataFrame, shards: int = 40, epsilon: float = 0.0, vnodes: int = VNODES, slot_bits: int = SLOT_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot) of every row of ``docs``.

    Null text counts as empty; a null key hashes like any other value. Within a slot rows lie by checksum, then by key and
    size; fully equal rows are interchangeable. An empty table gives no rows. Other columns of ``docs`` are not read, so
    their names can't clash.
    """
    spark = docs.sparkSession
    body = utf8(text)
    rows = docs.select(
        F.col(key).alias("doc_id"), slot_of(F.col(key), slot_bits).cast("long").alias("_slot"), F.xxhash64(F.col(key)).alias("_hash"),
        (F.octet_length(body) + F.lit(16)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
    ).withColumn("_sub", F.shiftright("text_crc32", 32 - SUB_BITS))
    parts = materialize(rows.groupBy("_slot", "_sub").agg(F.count("*").alias("_m")), "shard-parts")
    counts = {r["_slot"]: r["m"] for r in parts.groupBy("_slot").agg(F.sum("_m").alias("m")).collect()}  # 2**slot_bits rows at most
    total = sum(counts.values())
    segments = walk_ring(counts, ring_points(shards, vnodes, slot_bits), capacities(total, shards, epsilon)) if total else []
    plan = spark.createDataFrame(pd.DataFrame(segments, columns=["_slot", "_from", "_to", "shard", "_first"]).astype("int64"), "_slot long, _from long, _to long, shard long, _first long")
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("_slot", "_sub", F.coalesce(F.sum("_m").over(so_far(Window.partitionBy("_slot").orderBy("_sub"))), F.lit(0)).alias("_base"))
    same = rows.groupBy("_slot", "_sub", "_hash", "doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    order = so_far(Window.partitionBy("_slot", "_sub").orderBy("text_crc32", "_hash", "doc_id", "size"))
    ranked = same.withColumn("_at", F.coalesce(F.sum("_n").over(order), F.lit(0))).join(bases, ["_slot", "_sub"]).withColumn("_rank", F.col("_base") + F.col("_at"))
    # The plan has at most 2**slot_bits rows plus a few per virtual node, at any size of the input.
    met = ranked.join(F.broadcast(plan), "_slot").where((F.col("_rank") < F.col("_to")) & (F.col("_rank") + F.col("_n") > F.col("_from")))
    low, high = F.greatest("_rank", "_from"), F.least(F.col("_rank") + F.col("_n"), F.col("_to"))
    out = ["doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard")]
    placed = materialize(met.select(*out, (F.col("_first") + low - F.col("_from")).alias("_a"), (F.col("_first") + high - F.col("_from")).alias("_b")), "shard-runs")
    single = placed.where(F.col("_b") - F.col("_a") == 1).select("doc_id", "size", "text_crc32", "shard", F.col("_a").alias("slot"))
    runs = placed.where(F.col("_b") - F.col("_a") > 1).withColumn("_c", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1, F.lit(CHUNK).cast("long")))).repartition("_c", "doc_id")
    many = runs.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(F.col("_c"), F.least(F.col("_c") + CHUNK, F.col("_b")) - 1)).alias("slot"))
    return single.unionByName(many)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into 40 shards whose counts are at most one apart (law ``rows``)."""
    from fennwick.llm.common import table

    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
