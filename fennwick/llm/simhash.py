"""SimHash near-duplicates: a grid join over segment popcounts, verified by exact Hamming distance.

A fingerprint is cut into 32 segments of two bits. Its embedding holds each segment's number of set bits (0, 1 or 2)
in unary, again as 64 bits, so the Manhattan distance of two embeddings is the popcount of their exclusive or. It never
exceeds the Hamming distance of the fingerprints. Embeddings at Manhattan distance 2 or less agree on six of eight
8-bit blocks at least, which gives 28 projected grids: only fingerprints that share a cell of one are compared, first by
Manhattan distance, then exactly. A cell fixes 24 segments, which fingerprints of even bits share with a probability of
(3/8)^24 = 6e-11, so cells stay small up to some 1e12 distinct fingerprints.

Equal fingerprints are one node. A cell of more than ``DENSE`` nodes, as near copies by the thousand make them, is not
expanded into pairs: there each node gives its 64 one-bit neighbours and itself as midpoints, and nodes that share a
midpoint are linked to the smallest of them. Any two fingerprints at distance 2 or less share a midpoint, and any two that
share one are that close, so the components are the same as from all pairs, from 65 rows a node.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennwick.llm.common import bound_batches, materialize, table, utf8
from fennwick.llm.components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Blocks of an embedding; all but ``MAX_BITS`` of them agree in a grid.
BLOCKS = 8
DENSE = 64
#: Shingle hashes whose bits are counted at once; bounds the memory of a very long text.
CHUNK = 1 << 16


def shingle_hashes(body: bytes, k: int = SHINGLE) -> list[int]:
    """XXH64 of each word shingle of a text, repeats included. Words part at ASCII white space, A-Z are lowered."""
    words = body.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(line, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())]


def fingerprint(body: bytes, k: int = SHINGLE) -> int:
    """The 64-bit SimHash as an unsigned integer: a bit is set if it is set in over half the shingle hashes."""
    return majority(shingle_hashes(body, k))


def majority(hashes: list[int] | np.ndarray) -> int:
    """The number whose bits are set in over half of ``hashes``; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        block = np.array(hashes[at : at + CHUNK], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(docs: DataFrame, text: str = "text") -> Column:
    """Each row's fingerprint as a signed long. Null text has no words: fingerprint zero."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(bodies: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(b) for b in bodies], dtype=np.uint64).view(np.int64))

    return of(utf8(text))


def embedding(fp: Column) -> Column:
    """Unary popcounts of the two-bit segments: the low bit says one or more, the high bit says two."""
    odd = F.lit(0x5555555555555555)
    half = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(odd), 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fp``, enough to give the components of all links."""
    if max_bits != 2:
        raise ValueError("the grids are laid out for a distance of 2")
    masks = [sum(0xFF << (8 * i) for i in kept) for kept in combinations(range(BLOCKS), BLOCKS - max_bits)]
    grids = F.array(*[F.struct(F.lit(g).alias("grid"), F.col("u").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("cell")) for g, m in enumerate(masks)])
    cells = nodes.select("fp", embedding(F.col("fp")).alias("u")).select("fp", "u", F.explode(grids).alias("c")).select("fp", "u", "c.grid", "c.cell")
    # Written, so that the join deals both sides itself and can split a cell with many fingerprints.
    sizes = materialize(cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    shared = materialize(cells.join(sizes, ["grid", "cell"]), "simhash-cells")

    light = shared.where(F.col("n") <= dense)
    one = light.select("grid", "cell", F.col("fp").alias("a"), F.col("u").alias("ua"))
    two = light.select("grid", "cell", F.col("fp").alias("b"), F.col("u").alias("ub"))
    near = one.join(two, ["grid", "cell"]).where("a < b")
    near = near.where(F.bit_count(F.col("ua").bitwiseXOR(F.col("ub"))) <= max_bits).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)

    crowd = shared.where(F.col("n") > dense).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)])
    middles = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    least = materialize(middles.groupBy("middle").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1"), "simhash-middles")
    star = middles.join(least, "middle").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.select("a", "b").union(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the smallest doc_id whose fingerprint can be reached by links of 2 or fewer differing bits; null
    ids are passed over, and it is null only if all ids of a component are. Repeated rows come back as often as they
    are there. An empty table gives no rows; other columns are not read.
    """
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint_of(docs, text).alias("fp")), "simhash-fps")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(links(nodes))
    linked = materialize(nodes.join(labels.select(F.col("node").alias("fp"), "root"), "fp"), "simhash-linked")
    best = linked.groupBy("root").agg(F.min("least").alias("best"))
    joined = linked.join(best, "root").select("fp", "best")
    classes = nodes.join(joined, "fp", "left").select("fp", F.coalesce("best", "least").alias("component_id"))
    # Written, so that the rows of one text with very many copies can be split among tasks.
    return rows.join(materialize(classes, "simhash-classes"), "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def first_of(docs: DataFrame, rows: DataFrame, labels: DataFrame, node: str = "fp") -> DataFrame:
    """One row of ``docs`` for each component of nodes, with all columns: the smallest doc_id, then the smallest text hash.

    ``rows`` holds each row's doc_id, thash and node, ``labels`` the (node, root) of linked nodes. Rows that are equal in
    id and text are one row afterwards (the smallest by all columns). Components without any id keep their smallest
    text hash.
    """
    key, body = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash"), F.xxhash64(F.col("text"))
    nodes = rows.groupBy(node).agg(F.min(key).alias("first"))
    rooted = nodes.join(labels.select(F.col("node").alias(node), "root"), node, "left").select("first", F.coalesce("root", node).alias("root"))
    winners = rooted.groupBy("root").agg(F.min("first").alias("w")).select("w.doc_id", "w.thash")
    counts = rows.groupBy("doc_id", "thash").agg(F.count("*").alias("copies"))
    chosen = winners.alias("w").join(counts.alias("c"), F.col("w.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("w.thash") == F.col("c.thash"))).select(F.col("w.doc_id").alias("_id"), F.col("w.thash").alias("_thash"), "copies")
    chosen = materialize(chosen, "simhash-chosen")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id"), body.alias("thash"))  # so that no other column's name matters
    picked = packed.join(chosen, packed["doc_id"].eqNullSafe(F.col("_id")) & (packed["thash"] == F.col("_thash")))
    single = picked.where("copies = 1").select("row.*")
    if chosen.where("copies > 1").isEmpty():  # no row of the table is there twice, so the second read is not needed
        return single
    return single.unionByName(picked.where("copies > 1").groupBy("_id", "_thash").agg(F.min("row").alias("row")).select("row.*"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of op2's links, with all columns."""
    rows = materialize(docs.select("doc_id", F.xxhash64(F.col("text")).alias("thash"), fingerprint_of(docs).alias("fp")), "simhash-rows")
    return first_of(docs, rows, connected_components(links(rows.select("fp").distinct())))
