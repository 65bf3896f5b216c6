"""The SimHash join of the pipeline's near-duplicate stage."""

import corpus_pipeline as P
from fennwick.llm import minhash
from tests.llm.test_minhash import brute, copies


def test_stage_begins_with_the_simhash_join(spark, monkeypatch):
    """Its links are those of all pairs of fingerprints up to two bits apart, and without any band they alone make components."""
    texts = copies()
    base = " ".join(f"v{i}" for i in range(2000))
    texts |= {900: base, 901: base + " more", 902: "less " + base}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    near, whole = [], minhash.near_fingerprints
    monkeypatch.setattr(minhash, "near_fingerprints", lambda *a: near.append((a[0], whole(*a))) or near[-1][1])
    assert {r["doc_id"] for r in P.near_dedup_stage(spark, docs, "").collect()} == brute(texts)
    nodes, pairs = near[0][0].collect(), {(r["a"], r["b"]) for r in near[0][1].collect()}
    fps = {r["node"]: r["fp"] & (2**64 - 1) for r in nodes}
    close = {(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2}
    ids = {r["first"]["doc_id"]: r["node"] for r in nodes}
    assert pairs and pairs <= close and any(ids[900] in p for p in pairs)


def test_candidates_of_both_joins_are_compared_once(spark, monkeypatch):
    """One comparison of sets and one pass of star steps for both joins, with the groups of brute force."""
    texts = copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    passes, compared, whole, similar = [], [], minhash.connected_components, minhash.similar_pairs
    monkeypatch.setattr(minhash, "connected_components", lambda e: passes.append(1) or whole(e))
    monkeypatch.setattr(minhash, "similar_pairs", lambda p, *a: compared.append(p) or similar(p, *a))
    monkeypatch.setattr(minhash, "resolve", lambda crowd, roots, *a: roots)
    minhash.keep_one(docs).collect()
    assert len(passes) == len(compared) == 1 and compared[0].count() == compared[0].distinct().count() > 0
