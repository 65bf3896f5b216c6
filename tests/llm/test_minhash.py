"""The pipeline's near-duplicate stage against brute force over five-word shingle sets."""

import random

import numpy as np

import corpus_pipeline as P
from fennwick.llm import minhash

WORDS = [f"w{i}" for i in range(500)]


def brute(texts):
    """Smallest id of each component of pairs with a similarity of 0.8 or more, by all pairs."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    root = {d: d for d in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(d) for d in ids}


def copies():
    rnd = random.Random(4)
    texts = []
    for size in (60, 3, 1, 2):
        base = rnd.choices(WORDS, k=120)
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(120)] = rnd.choice(WORDS)
            texts.append(" ".join(words))
    return dict(enumerate([*texts, "", None, "one", "one two", "ONE  two", "one two three four five"]))


def test_stage_resolves_near_copies(spark):
    texts = copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts)
    assert {r["doc_id"] for r in P.near_dedup_stage(spark, docs, "").collect()} == want
    assert {r["doc_id"] for r in minhash.keep_one(docs, dense=2).collect()} == want


def test_awkward_rows(awkward, none):
    kept = minhash.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 6, 7]
    assert minhash.keep_one(none).collect() == []


def test_crowds_with_many_changes_of_their_own(spark):
    """A large group in which some copies are near all, some near a few and some near none; with and without the original."""
    rnd = random.Random(8)
    for original in (True, False):
        base, texts = rnd.choices(WORDS, k=90), []
        for i in range(220):
            words = list(base)
            for _ in range(i % 7 if original else 1 + i % 5):
                words[rnd.randrange(90)] = f"z{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
        for i in range(40):  # copies of copies share their changes
            words = texts[rnd.randrange(220)].split()
            words[rnd.randrange(90)] = f"y{i}"
            texts.append(" ".join(words))
        texts = dict(enumerate(texts))
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        want = brute(texts)
        assert 1 < len(want) < 200 and {r["doc_id"] for r in minhash.keep_one(docs, dense=8).collect()} == want


def test_no_pair_is_missed_by_chance(spark):
    """A text and a copy that lacks, for each of 32 bands of 5 least hashes, a word of the shingle that gives one of them.

    Banded MinHash calls them no candidates, and their fingerprints are not within two bits; their similarity is over 0.8.
    """
    draw = np.random.default_rng(42)
    mul, add = draw.integers(0, 1 << 63, 160, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, 160, dtype=np.uint64)
    words = [f"w{i}" for i in range(2000)]
    shingles = np.array(minhash.shingle_hashes(" ".join(words).encode(), 5), np.uint64)
    rows = minhash.mixed(shingles[:, None] * mul + add).argmin(axis=0).reshape(32, 5)
    gone = {int(at) + 2 for at in rows[:, 0]}
    texts = {1: " ".join(words), 2: " ".join(w for i, w in enumerate(words) if i not in gone), 3: "other words " * 9}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert brute(texts) == {1, 3} and {r["doc_id"] for r in P.near_dedup_stage(spark, docs, "").collect()} == {1, 3}


def test_prefixes_of_similar_sets_meet():
    """At a similarity of 0.8 or more, down to the shingle, whichever shingles come last."""
    draw = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 9, 10, 41, 100):
        for _ in range(40):
            a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
            cut = int(draw.integers(0, n // 5 + 1))
            b = np.unique(np.concatenate([a[cut:], draw.integers(0, 1 << 63, int(draw.integers(0, n // 5 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            of = minhash.prefix_cells(np.sort(minhash.mixed(draw.permutation(a)[: int(draw.integers(0, n + 1))])))
            assert both < 0.8 * (len(a) + len(b) - both) - 1e-9 or len(np.intersect1d(of(a), of(b)))
