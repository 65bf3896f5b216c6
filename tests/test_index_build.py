"""The build's lists of chunks, and how often ranking and matching read and deal what they need."""

import random

from pyspark.sql import functions as F

from fennwick.operators import chunk_index as X
from fennwick.operators import posting_blocks as B

LENGTHS = ("term", "chunk_id", *B.LISTS)


def chunks(n=300):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    return [(7 * i, rnd.choice(words), " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(n)]


def rows(df):
    return sorted(tuple(r[c] for c in LENGTHS) for r in df.collect())


def test_lists_of_chunks_hold_the_postings(spark, monkeypatch):
    """Lists of a few chunks each, of chunks that lie in no order; few rows are dealt, whole terms come of them."""
    monkeypatch.setattr(B, "HELD", 500)
    monkeypatch.setattr(B, "LIST_ROWS", 7)
    df = spark.createDataFrame(chunks(), "chunk_id long, title string, text string").repartition(3)
    tokens = X._tokens(df, X.T.word_runs).select("*", *X._lengths())
    want = rows(X._postings(tokens))
    for size in (4, 128):
        lists = B.term_lists(tokens, size)
        assert lists.agg(F.max(F.size("ids"))).first()[0] <= size
        cut = B.merged_lists(lists, size)
        assert rows(B.decoded(cut)) == want and cut.agg(F.max("n")).first()[0] <= size
    assert 3 * B.term_lists(tokens).count() < len(want)


def test_stored_index_of_repeated_ids(spark, tmp_path):
    """Rows of one id add up to one posting of a term, as in an index that is not stored; no chunk at all is an index too."""
    df = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x"), (2, "b", "x")], "chunk_id long, title string, text string")
    plain = X.build_index(df)
    stored = X.build_index(df).save(str(tmp_path / "i"))
    key = lambda index: sorted((r["term"], r["chunk_id"], r["text_tf"]) for r in index.postings.collect())
    assert key(stored) == key(plain)
    assert X.build_index(df.where("false")).save(str(tmp_path / "none")).postings.collect() == []


def test_ranking_reads_what_is_scored_once(spark):
    scored = spark.createDataFrame([(i, f"src{i % 4} / 用语与梗", "x" * 40, float(i % 10)) for i in range(60)], "chunk_id long, title string, text string, score double")
    for pin, flat, want in (("src1|src3", "ab", [9, 19, 29, 39, 8]), (None, "src2", [9, 19, 29, 39, 49])):
        ranked = X.rank_chunks(scored, X.QueryPlan(["ab"], flat, [], False, pin, None, 5, 300))
        assert ranked._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
        got = [r["chunk_id"] for r in ranked.orderBy("rank").collect()]
        if pin:
            fits = sorted((i for i in range(60) if i % 4 in (1, 3)), key=lambda i: (-(i % 10), i))
            first = sorted((i for r in (1, 3) for i in [j for j in fits if j % 4 == r][:2]), key=lambda i: (-(i % 10), i))
            rest = sorted((i for i in range(60) if i not in first), key=lambda i: (-(i % 10), i))
            want = (first + rest)[:5]
        assert got == want


def test_matching_deals_postings_not_pairs(spark, tmp_path):
    """Postings of a stored index are dealt by chunk once, however many queries want them."""
    df = spark.createDataFrame(chunks(), "chunk_id long, title string, text string")
    spark.createDataFrame([(q, f"w{(q * k) % 40}") for q in range(1, 20) for k in (1, 2)], "query_id int, term string").write.parquet(str(tmp_path / "q"))
    wanted = spark.read.parquet(str(tmp_path / "q"))
    stored = X.build_index(df).save(str(tmp_path / "i"))
    found, plain = X.match_terms(stored, wanted), X.match_terms(X.build_index(df), wanted)
    key = lambda m: sorted((r["query_id"], r["chunk_id"], round(r["base"], 9), r["matched"], r["in_title"]) for r in m.collect())
    assert "hashpartitioning(chunk_id" in found._jdf.queryExecution().executedPlan().toString() and key(found) == key(plain)
