"""One-permutation hashing against brute force over whole shingle sets, and on awkward rows."""

import random
from collections import Counter

import duckdb
import numpy as np

from fennwick.llm import minhash, oph

WORDS = [f"w{i}" for i in range(400)]


def brute(texts, shingle, percent):
    sets = {}
    for d, t in texts.items():
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def copies(seed, sizes, most):
    rnd, texts = random.Random(seed), []
    for size in sizes:
        base = rnd.choices(WORDS, k=rnd.choice((8, 40, 150)))
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.randint(0, most)):
                words[rnd.randrange(len(words))] = rnd.choice(WORDS)
            texts.append(" ".join(words))
    rnd.shuffle(texts)
    return dict(enumerate([*texts, "", None, " \n\t", "one", "ONE", "one two", "one  two", "one two three", "One two\tthree", "one two three four"]))


def test_components_against_all_pairs(spark):
    for seed, sizes, most in ((1, (80, 5, 3, 2, 2, 1, 1), 3), (2, [2] * 60, 6), (3, (150, 150), 9)):
        texts = copies(seed, sizes, most)
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        for shingle, percent in ((3, 85), (5, 80)):
            want = brute(texts, shingle, percent)
            found = {r["doc_id"]: r for r in oph.near_duplicates(docs, percent / 100, shingle).collect()}
            assert {d: (r["n_shingles"], r["component_id"]) for d, r in found.items()} == want
            assert all(r["kept"] == (d == want[d][1]) for d, r in found.items())


def test_query_matches_sql(spark, data):
    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from '{data}/documents.parquet'")
        want = c.execute(oph.SQL).fetchall()
    names = ("doc_id", "n_shingles", "component_id", "kept")
    assert Counter(want) == Counter(tuple(r[n] for n in names) for r in oph.op11_minhash(spark, data).collect())


def test_awkward_rows(awkward, none):
    rows = oph.near_duplicates(awkward).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in awkward.collect())
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows} >= {(1, 1, True), (5, 1, False), (2, 2, True), (3, 3, True), (4, 4, True), (None, None, False)}
    assert oph.near_duplicates(none).collect() == []


def test_bins_agree_as_often_as_sets_do():
    """Filled and densified bins: the share of equal ones is the similarity, for sets far smaller and far larger than the bins."""
    rng = np.random.default_rng(3)
    for size in (7, 40, 200, 2000):
        shares, alike = [], []
        for _ in range(300):
            both, own = rng.integers(0, 1 << 63, size, dtype=np.uint64), rng.integers(0, 1 << 63, 2 * max(1, size // 12), dtype=np.uint64)
            half = len(own) // 2
            a, b = np.union1d(both, own[:half]), np.union1d(both, own[half:])
            shares.append((oph.bins(a) == oph.bins(b)).mean())
            alike.append(size / (size + len(own)))
        assert abs(np.mean(shares) - np.mean(alike)) < 0.02
    assert len(set(oph.bins(np.array([5], np.uint64)).tolist())) == 1 and len(oph.buckets(np.array([5], np.uint64))) == oph.BANDS


def test_a_star_has_a_pair_less_than_nodes(spark):
    """Centres bound the candidates: n nodes of one cell give n - 1 pairs."""
    assert minhash.DENSE < 40
    base = " ".join(WORDS[:120])
    docs = spark.createDataFrame([(i, f"{base} own{i}") for i in range(40)], "doc_id long, text string")
    rows = docs.select("doc_id", minhash.sketch_of(docs, "text", 3, oph.buckets).alias("k")).select("doc_id", "k.*")
    shared = minhash.shared_cells(rows)
    cells = Counter(r["cell"] for r in shared.collect())
    assert cells and max(cells.values()) == 40 and {r["component_id"] for r in oph.near_duplicates(docs, 0.85, 3).collect()} == {0}
