"""Near copies by the Jaccard similarity of word shingles: SimHash, then shared prefixes for candidates, exact similarity for links.

``keep_one`` begins with the SimHash join: each set's fingerprint is the majority of its shingles' hashes, and fingerprints
that ``simhash.links`` joins by its grids of segment popcounts (2 bits or fewer apart) name candidates, as do equal ones. At a similarity
of 0.8 fingerprints are 9.7 bits apart on average, which no grid of 64 bits can join, so further candidates come from
prefixes. The pairs of both are compared together, each once, and their links make components in one pass of star steps.

A text is the set of its five-word shingles; equal sets are one node. All shingles have one order, and a set of n gives its
first n - ceil(0.8 n) + 1 of them as cells. Sets of similarity 0.8 have 0.8 n shingles in common at least, for either's n, so
less than that is left behind either prefix and the first common shingle lies in both: nodes that share a cell are
candidates, and no pair is missed, by no chance. Candidates are linked only if their sets' exact similarity is 0.8 or more.
Any order would do. Shingles that are frequent in a sample come last, the others by their hashes, so cells are small. Cells
that the same nodes share are one cell.

Few candidates need their sets for that: a node's shingles fall into ``SEGMENTS`` segments, of whose counts it keeps the
parities. Each shingle by which two sets differ changes one parity, so the differing parities are a lower bound of
the differing shingles, which at a similarity of 0.8 are a ninth of both sets at most.

Cells of ``DENSE`` nodes or fewer are expanded into pairs. In a larger cell all nodes are compared with one pivot, then
with 64, 4,096, ... pivots, but only across components, and only nodes that a bound leaves: let u be the shingles that a
node shares with no other node of a large cell, and s its others. Two sets differ in u + u' + |s - s'| shingles at least, and
at a similarity of 0.8 in a ninth of both at most. Buckets of (u, s) are compared first, so that copies with many changes
of their own are told to be far from all others without being paired with them. The first pivot is the node with the
least u, which is nearest to what the cell's nodes have in common. A cell is done when no node is left that could be
linked to another component; the last round has every such node as a pivot. So no candidate pair that could join two
components is passed over.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennwick.llm.common import bit_test, bound_batches, materialize, utf8
from fennwick.llm.components import connected_components
from fennwick.llm.simhash import first_of, links, majority, shingle_hashes
from fennwick.tables import discard, shuffles_cleaned

SHINGLE = 5
SIMILARITY = 0.8
#: Texts that frequent shingles are looked for in, how many of them hold one at least, and how many shingles come last at most. No result depends on these.
SAMPLE, OFTEN, MOST = 16_000, 3, 1 << 15
DENSE = 16
GROWTH = 64
#: Width of the buckets of the bound.
BUCKET = 4
SEGMENTS = 1024


def shingle_set(body: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    return np.unique(np.array(shingle_hashes(body, shingle), dtype="<u8"))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of MurmurHash3, so that the high bits depend on all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def prefix_cells(common: np.ndarray, similarity: float = SIMILARITY) -> Callable[[np.ndarray], np.ndarray]:
    """A set's cells: its first shingles in the order of all, in which ``common`` ones (mixed, sorted) come last."""

    def of(shingles: np.ndarray) -> np.ndarray:
        hashed = np.sort(mixed(shingles))
        if len(common):
            last = common[np.minimum(np.searchsorted(common, hashed), len(common) - 1)] == hashed
            hashed = np.concatenate([hashed[~last], hashed[last]])
        return hashed[: len(hashed) - math.ceil(similarity * len(hashed) - 1e-9) + 1].view(np.int64)

    return of


def common_shingles(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """The mixed hashes, sorted, of the shingles that ``OFTEN`` texts or more hold of some ``SAMPLE`` distinct ones, ``MOST`` of them at most."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(mixed(shingle_set(body.as_py(), shingle)).view(np.int64))], names=["shingle"])

    every = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select(utf8("text").alias("body")).distinct()
    held = sample.mapInArrow(unfold, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = held.orderBy(F.col("n").desc(), "shingle").limit(MOST).select("shingle").toArrow()  # at most MOST numbers, whatever the table's size
    return np.sort(np.asarray(found.column(0).to_numpy(), dtype=np.int64).view(np.uint64))


def fold_bands(rows: np.ndarray) -> np.ndarray:
    """One cell for each row of an array (bands, values), with the band mixed in."""
    cell = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for r in range(rows.shape[1]):
        cell = mixed(cell * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, r])
    return cell.view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """The parities of the shingles' counts in each segment, 64 in a number."""
    odd = np.bincount((shingles % np.uint64(SEGMENTS)).astype(np.int64), minlength=SEGMENTS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _differ(a: str, b: str) -> Column:
    """In how many parities two columns differ."""
    one = lambda i: F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i))))
    return reduce(lambda x, y: x + y, [one(i) for i in range(SEGMENTS // 64)])


def sketch_of(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, cells_of: Callable[[np.ndarray], np.ndarray] = prefix_cells(np.array([], np.uint64)), fingerprints: bool = False) -> Column:
    """struct(node, size, cells, bits) of each row: a hash of its shingle set, the set's size, its cells and parities; with
    ``fingerprints`` its SimHash ``fp`` too.

    No words, no cells.
    """
    bound_batches(docs.sparkSession)

    @F.pandas_udf("node long, size int, cells array<long>, bits array<long>" + ", fp long" * fingerprints)
    def of(bodies: pd.Series) -> pd.DataFrame:
        import xxhash

        sets = [shingle_set(b, shingle) for b in bodies]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
        found = pd.DataFrame({"node": node, "size": [len(s) for s in sets], "cells": [cells_of(s) if len(s) else [] for s in sets], "bits": [parities(s) for s in sets]})
        return found.assign(fp=np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)) if fingerprints else found

    return of(utf8(text))


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, shingles) of ``nodes`` (node, first), each read from the row that ``first`` names."""

    @F.pandas_udf("binary")
    def of(bodies: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(b, shingle).tobytes() for b in bodies])

    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("thash"), "text")
    named = nodes.select("node", F.col("first.doc_id").alias("_id"), F.col("first.thash").alias("_thash"))
    found = rows.join(named, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["thash"] == F.col("_thash"))).select("node", "text")
    return materialize(found.dropDuplicates(["node"]).select("node", of(utf8("text")).alias("shingles")), "minhash-sets")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingle sets are so similar, exactly."""

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> bool:
            p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(p, q, assume_unique=True))
            return both >= similarity * (len(p) + len(q) - both) - 1e-9

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)

    sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return materialize(sides.where(close("sa", "sb")).select("a", "b"), "minhash-links")


def near_fingerprints(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) of the ``nodes`` (node, size, bits, fp) whose SimHashes are equal or linked, unless a bound says that they are apart."""
    least = materialize(nodes.groupBy("fp").agg(F.min("node").alias("low")), "minhash-fps")
    equal = nodes.join(least, "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    joined = links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b")
    pairs = equal.union(joined.select(F.least("x", "y"), F.greatest("x", "y")))
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("size").alias(f"s{x}"), F.col("bits").alias(f"bits_{x}")), x)
    return materialize(pairs.where(alike(similarity)).select("a", "b").distinct(), "minhash-near")


def components(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, dense: int = DENSE, near: DataFrame | None = None) -> DataFrame:
    """(node, root) of the ``nodes`` (node, size, cells, bits, first) that have a similar one; the root is the least reachable.

    ``near`` (a, b) are candidates besides those of the cells; a pair that both name is compared once.
    """
    shared = met_cells(nodes)
    light, crowd = shared.where(F.col("n") <= dense), shared.where(F.col("n") > dense)
    one, two = (light.select("cell", F.col("node").alias(x), F.col("size").alias(f"s{x}")) for x in "ab")
    pairs = materialize(one.join(two, "cell").where("a < b").where(_sizes(similarity)).select("a", "b", "sa", "sb").distinct(), "minhash-sized")
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("bits").alias(f"bits_{x}")), x)
    pairs = pairs.where(alike(similarity)).select("a", "b")
    if near is not None:
        pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(pairs)
    pairs = materialize(pairs.distinct(), "minhash-pairs")
    held = crowd.select("node").union(pairs.select(F.explode(F.array("a", "b"))))
    named = materialize(nodes.join(held.distinct(), "node").select("node", "first"), "minhash-named")
    wanted = bit_test(named.select(F.col("first.thash").alias("key")))  # so that few other texts are dealt
    sets = sets_of(docs.where(wanted(F.xxhash64("text"))), named)
    found = similar_pairs(pairs, sets, similarity)
    roots = resolve(crowd.join(nodes.select("node", "bits"), "node"), connected_components(found), sets, similarity)
    discard(sets, shared)
    return roots


def met_cells(nodes: DataFrame) -> DataFrame:
    """(cell, node, size, n) of the cells that n nodes share, two or more; of cells that the same nodes share, the least."""
    cells = nodes.select("node", "size", F.explode("cells").alias("cell"))
    who = [F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")]
    sizes = materialize(cells.groupBy("cell").agg(F.count("*").alias("n"), *who).where("n > 1"), "minhash-sizes")
    single = materialize(sizes.groupBy("n", "x", "y").agg(F.min("cell").alias("cell")).select("cell", "n"), "minhash-single")
    return materialize(cells.join(single, "cell"), "minhash-met")


def shared_cells(nodes: DataFrame) -> DataFrame:
    """(cell, node, size, n, bits) of the cells that n nodes share, two or more."""
    cells = nodes.select("node", "size", F.explode("cells").alias("cell"))
    sizes = materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "minhash-sizes")
    met_twice = materialize(cells.join(sizes, "cell"), "minhash-met")
    return materialize(met_twice.join(nodes.select("node", "bits"), "node"), "minhash-cells")


def _sizes(similarity: float) -> Column:
    return F.least("sa", "sb") >= F.lit(similarity) * F.greatest("sa", "sb") - 1e-9


def alike(similarity: float) -> Column:
    """Whether two nodes of sizes sa, sb and parities bits_a, bits_b may be so similar."""
    return _sizes(similarity) & (_differ("bits_a", "bits_b") <= (F.col("sa") + F.col("sb")) * _apart(similarity) + 1e-9)


def resolve(crowd: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``roots`` with all links within the cells of ``crowd``: stars around one node a cell, then around 64, 4,096, ... of them.

    Only nodes of different components are compared, and only where the bounds leave a link possible.
    """
    crowd = crowd.withColumn("rank", F.pmod(F.xxhash64("node", "cell"), F.lit(1 << 30)) * F.col("n") / F.lit(float(1 << 30)))
    crowd = materialize(crowd.join(_own(sets, crowd), "node").withColumn("s", F.col("size") - F.col("u")), "minhash-crowd")
    before, pivots, alive = 0, 1, _alive(crowd, roots, similarity)
    while not alive.isEmpty():
        # The node of the least u is a pivot in any case; ranks below ``before`` were pivots in an earlier round.
        if not before:
            first = alive.groupBy("cell").agg(F.min(F.struct("u", "node")).alias("f")).select("cell", F.col("f.node").alias("node"))
            chosen = alive.join(first, ["cell", "node"])
        else:
            chosen = alive.where((F.col("rank") >= (before if before > 1 else 0)) & (F.col("rank") < pivots))
        mid = materialize(chosen.select("cell", *[F.col(c).alias(f"{c}_p") for c in ("node", "size", "u", "s", "root", "bits")]), "minhash-pivots")
        most = (F.col("size") + F.col("size_p")) * _apart(similarity) + 1e-9
        close = (F.col("u") + F.col("u_p") + F.abs(F.col("s") - F.col("s_p")) <= most) & (_differ("bits", "bits_p") <= most)
        met = alive.join(mid, "cell").where((F.col("root") != F.col("root_p")) & close)
        pairs = materialize(met.select(F.least("node", "node_p").alias("a"), F.greatest("node", "node_p").alias("b")).distinct(), "minhash-pairs")
        more, left = similar_pairs(pairs, sets, similarity), alive.where(F.col("n") > pivots)
        if more.isEmpty():
            alive = left
        else:
            roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
            alive = _alive(left.drop("root"), roots, similarity)
        before, pivots = pivots, pivots * GROWTH
    return roots


def _alive(crowd: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``crowd``, with their component's root, that may be similar to a node of another component in their cell."""
    bucket = [F.floor(F.col(c) / BUCKET).cast("int").alias(f"{c}b") for c in "us"]
    rooted = materialize(crowd.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")).select("*", *bucket), "minhash-rooted")
    others = _near_buckets(rooted, similarity)
    apart = rooted.join(others, ["cell", "ub", "sb"]).where("low <> root or high <> root")
    return materialize(apart.drop("ub", "sb", "low", "high"), "minhash-alive")


def _apart(similarity: float) -> float:
    """The share of two sets' sizes by which they differ at most."""
    return (1 - similarity) / (1 + similarity)


def _own(sets: DataFrame, crowd: DataFrame) -> DataFrame:
    """(node, u) of the nodes of ``crowd``: how many shingles of each no other of them has."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                shingles = np.frombuffer(body.as_py(), "<u8").view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shingles), node)), pa.array(shingles)], names=["node", "shingle"])

    nodes = crowd.select("node").distinct()
    rows = sets.join(nodes, "node").select("node", "shingles").mapInArrow(unfold, "node long, shingle long")
    single = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("u"))
    return nodes.join(single, "node", "left").select("node", F.coalesce("u", F.lit(0)).cast("int").alias("u"))


def _near_buckets(rooted: DataFrame, similarity: float) -> DataFrame:
    """(cell, ub, sb, low, high): for each bucket of a cell the range of roots of all buckets that it may be similar to.

    Buckets without a node of another component between them are left out.
    """
    held = rooted.groupBy("cell", "ub", "sb").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("size").alias("most"))
    one = held.select("cell", F.col("ub").alias("ua"), F.col("sb").alias("sa"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.col("most").alias("most_a"))
    two = held.select("cell", F.col("ub").alias("vb"), F.col("sb").alias("tb"), "low", "high", "most")
    gap = F.greatest((F.abs(F.col("sa") - F.col("tb")) - 1) * BUCKET + 1, F.lit(0))
    least = (F.col("ua") + F.col("vb")) * BUCKET + F.when(F.col("sa") == F.col("tb"), 0).otherwise(gap)
    mixed = ~((F.col("low_a") == F.col("high_a")) & (F.col("low") == F.col("high")) & (F.col("low_a") == F.col("low")))
    may = least <= (F.col("most_a") + F.col("most")) * _apart(similarity) + 1e-9
    near = one.join(two, "cell").where(may & mixed)
    return near.groupBy("cell", F.col("ua").alias("ub"), F.col("sa").alias("sb")).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, dense: int = DENSE) -> DataFrame:
    """One row of each group of near copies, with all columns, by the order of ``simhash.first_of``."""
    body = F.xxhash64(F.col("text"))
    with shuffles_cleaned(docs.sparkSession):
        cells_of = prefix_cells(common_shingles(docs), similarity)
        rows = materialize(docs.select("doc_id", body.alias("thash"), sketch_of(docs, cells_of=cells_of, fingerprints=True).alias("k")).select("doc_id", "thash", "k.*"), "minhash-rows")
        key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash")
        nodes = materialize(rows.groupBy("node").agg(F.min(key).alias("first"), F.first("size").alias("size"), F.first("cells").alias("cells"), F.first("bits").alias("bits"), F.first("fp").alias("fp")), "minhash-nodes")
        labels = components(docs, nodes, similarity, dense, near_fingerprints(nodes, similarity))
    return first_of(docs, rows.drop("cells", "bits"), labels, "node")
