"""The pipeline's stages, each against a plain statement of what it does."""

from collections import Counter

import corpus_pipeline as P
from fennwick.llm import decontam
from tests.llm.test_minhash import brute

DATA = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = P.quality_stage(spark, docs, DATA).cache()
    assert kept.columns == docs.columns and 0.75 * docs.count() < kept.count() < docs.count()
    unique = P.near_dedup_stage(spark, kept, DATA).cache()
    # A stage on word shingles takes five words and a similarity of 0.8; op2's three words and two bits bind its query only.
    assert {r["doc_id"] for r in unique.collect()} == brute({r["doc_id"]: r["text"] for r in kept.collect()}) and unique.columns == docs.columns
    clean = P.decontamination_stage(spark, unique, DATA).cache()
    items = [decontam.normalise(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in unique.collect() if any(i in decontam.normalise(r["text"]) for i in items)}
    assert leaks and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in unique.collect()} - leaks
    safe = P.pii_stage(spark, clean, DATA).cache()
    assert safe.columns == docs.columns and Counter(r["doc_id"] for r in safe.collect()) == Counter(r["doc_id"] for r in clean.collect())
    packed = P.packing_stage(spark, safe, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in safe.collect()}
    # How a document is cut depends on the files it is read from, its tokens don't.
    tokens = lambda df: {(r["doc_id"], r["doc_tokens"]) for r in df.select("doc_id", "doc_tokens").distinct().collect()}
    assert tokens(P.run(spark, DATA)) == tokens(packed)


def test_stages_on_awkward_rows(spark, awkward, none):
    """Nulls, empty, blank, long and repeated texts, repeated ids, columns of any name, and an empty table."""
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    everything = ids(awkward)
    for _, stage in P.STAGES[:4]:
        out, empty = stage(spark, awkward, DATA), stage(spark, none, DATA)
        assert out.columns == awkward.columns and not ids(out) - everything and empty.columns == none.columns and empty.collect() == []
    assert ids(P.near_dedup_stage(spark, awkward, DATA)) == Counter([None, 1, 2, 6, 7])
    assert ids(P.decontamination_stage(spark, awkward, DATA)) == everything
    safe = P.pii_stage(spark, awkward, DATA)
    assert ids(safe) == everything and "a@b.co" not in safe.where("doc_id = 6").first()["text"]
    assert [r["text"] for r in safe.where("doc_id in (2, 3)").orderBy("doc_id").collect()] == [None, ""]
    packed = P.packing_stage(spark, awkward, DATA)
    assert Counter(r["doc_id"] for r in packed.where("start = 0").collect()) == everything and P.packing_stage(spark, none, DATA).collect() == []
