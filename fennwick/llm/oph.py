"""Near copies by one-permutation hashing: one hash of each shingle fills all bins, densification the empty ones.

A text is the set of its word shingles. One hash deals each shingle to one of ``BINS`` bins, which keeps the least hash that
falls into it; so a set is hashed once, not once a bin. A bin without a shingle takes the value of another: it asks the
bins in an order of its own, the same for all texts, until it comes to one that holds a shingle. Which bin that is depends
on the set alone, so two texts' bins agree with a probability of their Jaccard similarity, filled or empty.

``BANDS`` bands of ``ROWS`` bins each are a text's buckets. A pair of similarity 0.85 shares none with a probability of
3e-7, a closer one with a smaller one. Texts of one set are one node. In a bucket of n nodes one is the centre, and the n - 1
pairs with it are the candidates, whatever n is: a star. Pairs of which sizes and segment parities already say that they are
too far apart are dropped, the others are linked if their whole sets are so similar.

A star alone would lose the links between two nodes of which neither is linked to the centre. So the buckets that still
hold nodes of several components, which few do, go through ``minhash.resolve``: stars around further centres, only across
components and only where bounds leave a link possible, until no bucket is left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fennwick.llm import minhash
from fennwick.llm.common import materialize, table
from fennwick.llm.components import connected_components

BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
_MUL, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: The order in which each bin asks the others.
_ORDER = np.argsort(np.random.default_rng(11).random((BINS, BINS)), axis=1)


def bins(shingles: np.ndarray) -> np.ndarray:
    """The least hash in each bin, empty ones densified. One shingle is needed at least."""
    hashed = np.sort(minhash.mixed(minhash.mixed(shingles * _MUL + _ADD)))
    at = ((hashed >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)  # rises with the hash
    held, first = np.unique(at, return_index=True)
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[held], filled[held] = hashed[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _ORDER[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def buckets(shingles: np.ndarray) -> np.ndarray:
    """One cell for each band of bins."""
    return minhash.fold_bands(bins(shingles).reshape(BANDS, ROWS))


def star_components(docs: DataFrame, nodes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(node, root) of the ``nodes`` (node, size, cells, bits, first) that have a similar one; the root is the least reachable."""
    shared = minhash.shared_cells(nodes)
    sets = minhash.sets_of(docs, nodes.join(shared.select("node").distinct(), "node"), shingle)
    centres = materialize(shared.groupBy("cell").agg(F.min(F.struct("node", "size", "bits")).alias("c")).select("cell", F.col("c.node").alias("b"), F.col("c.size").alias("sb"), F.col("c.bits").alias("bits_b")), "oph-centres")
    rays = shared.select("cell", F.col("node").alias("a"), F.col("size").alias("sa"), F.col("bits").alias("bits_a")).join(centres, "cell").where("a <> b")
    pairs = materialize(rays.where(minhash.alike(similarity)).select("a", "b").distinct(), "oph-stars")
    roots = connected_components(minhash.similar_pairs(pairs, sets, similarity))
    rooted = materialize(shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "oph-rooted")
    mixed = materialize(rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell"), "oph-mixed")
    return minhash.resolve(rooted.join(mixed, "cell").drop("root"), roots, sets, similarity)


def near_duplicates(docs: DataFrame, similarity: float = minhash.SIMILARITY, shingle: int = minhash.SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    A row's set is that of its distinct word shingles; fewer words are one shingle, a null or blank text has none and is linked
    with nothing. Rows whose sets are so similar are linked; component_id is the smallest doc_id that links reach, the row's
    own included. Null ids are passed over there: component_id is null only if a component has no id, and such rows are not
    kept. Repeated rows come back as often as they are there; very long texts are read whole; an empty table gives no rows;
    other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    sketch = minhash.sketch_of(docs, "text", shingle, buckets)
    rows = materialize(docs.select("doc_id", F.xxhash64("text").alias("thash"), sketch.alias("k")).select("doc_id", "thash", "k.*"), "oph-rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash")
    nodes = rows.where("size > 0").groupBy("node").agg(F.min(key).alias("first"), *[F.first(c).alias(c) for c in ("size", "cells", "bits")])
    nodes = materialize(nodes, "oph-nodes")
    labels = star_components(docs, nodes, similarity, shingle)
    linked = materialize(nodes.join(labels, "node").select("node", "root", F.col("first.doc_id").alias("least")), "oph-linked")
    best = linked.groupBy("root").agg(F.min("least").alias("best"))
    classes = nodes.select("node", F.col("first.doc_id").alias("least")).join(linked.join(best, "root").select("node", "best"), "node", "left")
    # Written, so that the rows of one text with very many copies can be split among tasks.
    classes = materialize(classes.select("node", F.coalesce("best", "least").alias("component_id")), "oph-classes")
    some = rows.where("size > 0").select("node", "doc_id", "size").join(classes, "node").select("doc_id", "size", "component_id")
    every = some.unionAll(rows.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    """Class of every document by three-word shingles at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), similarity=0.85, shingle=3)


#: Exact similarities of all pairs with a common shingle, and what links reach.
SQL = r"""
with recursive words as (
  select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select k, doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from words),
shingles as (select k, len(s) as n, unnest(s) as g from sets),
common as (select a.k as a, b.k as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as n_both from shingles a join shingles b on a.g = b.g and a.k < b.k group by a.k, b.k),
links as (select a, b from common where 100 * n_both >= 85 * (na + nb - n_both)),
ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from ways union select r.a, w.b from reach r join ways w on w.a = r.b),
least as (select r.a as k, min(s.doc_id) as least from reach r join sets s on s.k = r.b group by r.a)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(least(s.doc_id, l.least), s.doc_id) as component_id, s.doc_id = coalesce(least(s.doc_id, l.least), s.doc_id) as kept
from sets s left join least l on s.k = l.k
"""
