"""The stored index: pruned search against scoring everything, blocks against plain postings, segments against one build."""

import random

import pytest
from pyspark.sql import functions as F

from fennwick.functions import text as T
from fennwick.operators import chunk_index as X
from fennwick.operators import posting_blocks as B
from fennwick.operators import pruned
from fennwick.operators import title_index as I

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    made = []
    for i in range(1500):
        words = [WORDS[min(59, int(rnd.expovariate(0.12)))] for _ in range(rnd.choice((3, 20, 90)))]
        made.append((10 * i + rnd.randint(0, 9), rnd.choice(("w1 w5", "alpha / 基本信息", "be-ta / 基本信息 / w3", "gamma / 用语与梗", f"t{i % 50}", "", None)), " ".join(words)))
    return [*made, (99_999, "x", ""), (99_998, None, None)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    made = X.build_index(spark.createDataFrame(rows, "chunk_id long, title string, text string"), ["gamma"])
    stored = made.save(str(tmp_path_factory.mktemp("index")))
    held = [spark.createDataFrame(df.collect(), df.schema) for df in (made.chunks, made.postings, made.terms, made.stats)]  # so that they are computed once
    return X.ChunkIndex(*held, themes=made.themes), stored


@pytest.mark.parametrize("first, most", [(1 << 15, 2048), (64, 40)])
def test_pruned_search_gives_the_full_searchs_rows(spark, index, monkeypatch, first, most):
    plain, stored = index
    monkeypatch.setattr(pruned, "FIRST", first)
    monkeypatch.setattr(pruned, "MOST", most)
    for query, k in (("w0 w1 w40", 6), ("w33 w0", 1), ("w50 zzz w2", 6), ("gamma 梗", 3), ("be ta", 3), ("w3 是什么", 4), ("zzz", 2), ("w1 w2 w3 w4 w5 w6", 1)):
        want, got = ([tuple(r) for r in X.search(i, query, top_k=k).collect()] for i in (plain, stored))
        assert got == want, (query, k)


def test_texts_are_read_by_ids(index):
    scored, _ = pruned.candidates(index[1], X.QueryPlan(["w33"], "w33", [], False, None, None, 3, 300))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "GreaterThanOrEqual(chunk_id" in plan and "LessThanOrEqual(chunk_id" in plan


def test_few_blocks_are_read(spark, index, monkeypatch):
    """With a small first round a rare and a common word need a part of the common one's postings."""
    seen = []
    whole = pruned._round
    monkeypatch.setattr(pruned, "FIRST", 64)
    monkeypatch.setattr(pruned, "_round", lambda *a: seen.append(a[4]) or whole(*a))
    X.search(index[1], "w33 w0", top_k=1).collect()
    assert seen and seen[-1]  # unread blocks are left


def test_blocks_hold_every_posting(spark, index):
    plain, stored = index
    columns = ("term", "chunk_id", "text_tf", "title_tf", "text_len", "title_len")
    want = sorted(tuple(r[c] for c in columns) for r in plain.postings.collect())
    assert sorted(tuple(r[c] for c in columns) for r in stored.postings.collect()) == want
    for size in (1, 7, 128):
        cut = B.cut_blocks(plain.postings, size)
        assert sorted(tuple(r[c] for c in columns) for r in B.decoded(cut).collect()) == want and cut.agg(F.max("n")).first()[0] <= size
    bad = stored.blocks.where("top_text_tf <> array_max(text_tf) or low_text_len <> array_min(text_len) or n <> size(gaps) + 1 or n <> size(text_tf) or exists(gaps, g -> g <= 0)")
    assert bad.isEmpty()


def test_segments_and_merged_index_equal_one_build(spark, rows, index, tmp_path):
    frame = spark.createDataFrame(rows, "chunk_id long, title string, text string")
    for k in range(3):
        X.build_index(frame.where(F.col("chunk_id") % 3 == k), ["gamma"]).save(f"{tmp_path}/all/segment={k}")
        frame.where(F.col("chunk_id") % 3 == k).count()
    together = X.ChunkIndex.load(spark, f"{tmp_path}/all")
    merged = X.merge_indexes(spark, [f"{tmp_path}/all/segment={k}" for k in range(3)], f"{tmp_path}/merged")
    one = index[1]
    key = lambda i: {r["term"]: (r["df"], round(r["idf"], 9)) for r in i.terms.collect()}
    assert key(together) == key(merged) == key(one) and together.numbers == merged.numbers == one.numbers and merged.themes == ["gamma"]
    for query in ("w1 w5", "gamma 梗", "alpha", "w33 w0"):
        want = sorted((r["title"], r["text"], r["score"]) for r in X.search(one, query, top_k=5).where("rank = 1").collect())
        assert [tuple(r[1:]) for r in X.search(together, query, top_k=5).where("rank = 1").collect()] == want
        assert sorted(r["score"] for r in X.search(merged, query, top_k=5).collect()) == sorted(r["score"] for r in X.search(one, query, top_k=5).collect())


def test_grams_find_what_is_near(spark):
    rnd = random.Random(4)
    titles = list({"".join(rnd.choices("abcdef / 萌", k=rnd.randint(1, 14))) for _ in range(300)})
    table = I.title_table(spark.createDataFrame(list(enumerate(titles)), "chunk_id long, title string"))
    words = ["".join(rnd.choices("abcdef萌", k=rnd.randint(2, 4))) for _ in range(30)]
    held = {(r["key"], r["hash"]) for r in I.holding(I.gram_table(table), {w: I.pairs_of(w) for w in words}).collect()}
    near = table.select("hash", F.explode(F.filter(F.array(*map(F.lit, words)), lambda w: T.near_in_order(w, F.col("title")))).alias("w")).collect()
    assert near and {(r["w"], r["hash"]) for r in near} <= held


def test_an_empty_index(spark, tmp_path):
    index = X.build_index(spark.createDataFrame([], "chunk_id long, title string, text string")).save(str(tmp_path / "none"))
    assert X.search(index, "w1").collect() == [] and index.numbers["n"] == 0
