"""The word graph against a plain statement of the best path, and on awkward rows."""

import math
import random
import re

from fennwick.operators import word_graph as G


def plain(text, freq, search=True):
    total = math.log(sum(freq.values())) if freq else 0.0
    out = []
    for run in re.findall(r"[一-鿿]+|[^\W_一-鿿]+", text.lower()):
        if not "一" <= run[0] <= "鿿":
            out.append(run)
            continue
        n, best = len(run), [(0.0, 0)] * (len(run) + 1)
        for i in range(n - 1, -1, -1):
            best[i] = max((math.log(freq.get(run[i:j]) or 1) - total + best[j][0], j) for j in range(i + 1, n + 1) if j == i + 1 or freq.get(run[i:j]))
        i = 0
        while i < n:
            word = run[i : best[i][1]]
            for size in (2, 3) if search else ():
                out += [word[k : k + size] for k in range(len(word) - size + 1) if len(word) > size and freq.get(word[k : k + size])]
            out.append(word)
            i = best[i][1]
    return out


def test_paths_against_a_plain_statement(spark):
    rnd = random.Random(3)
    letters = "天地玄黄宇宙洪荒"
    for size in (0, 30, 120):
        freq = {"".join(rnd.choices(letters, k=rnd.randint(1, 5))): rnd.randint(1, 500) for _ in range(size)}
        texts = ["".join(rnd.choices(letters + "ab1 ，。", k=rnd.randint(0, 40))) for _ in range(80)] + ["天地" * 60, "ABC 天地abc"]
        words = spark.createDataFrame([(w, f) for w, f in freq.items()] + [("宇宙", 0), ("", 5), (None, 3)], "term string, freq long")
        frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        for search in (True, False):
            found = {r["id"]: r["terms"] for r in G.segment(frame, words, search=search).collect()}
            assert found == {k: plain(t, freq, search) for k, t in enumerate(texts)}


def test_awkward_rows(spark):
    words = spark.createDataFrame([("天地", 3), ("天地", 4)], "term string, freq long")
    rows = spark.createDataFrame([(1, None), (1, ""), (1, "天地天"), (None, "天地"), (2, "，。")], "id long, text string")
    found = sorted(((r["id"], r["terms"]) for r in G.segment(rows, words).collect()), key=str)
    assert found == [(1, ["天地", "天"]), (1, []), (1, []), (2, []), (None, ["天地"])]
    assert G.segment(rows.limit(0), words).collect() == []
