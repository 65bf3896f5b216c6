"""The join by names against all pairs, and on awkward rows."""

import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd

from fennwick.llm import name_join as J


def osa(a, b):
    rows = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            ways = [rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1])]
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                ways.append(rows[i - 2][j - 2] + 1)
            rows[i][j] = min(ways)
    return rows[-1][-1]


def brute(left, right, most):
    found = defaultdict(list)
    for rid, name in set(right):
        for lid, other in left:
            if name and other and (d := osa(other, name)) <= most:
                found[rid, d].append(lid)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return {(r, d, len(ids), least(ids), sum(zlib.crc32(str(i).encode()) for i in ids if i is not None)) for (r, d), ids in found.items()}


def test_distances_against_the_whole_matrix():
    rnd = random.Random(1)
    a, b = ([("".join(rnd.choices("aéb日", k=rnd.choice((rnd.randint(0, 8), rnd.randint(0, 40)))))) for _ in range(3000)] for _ in range(2))
    for i in range(1000, 3000):
        chars = list(a[i])
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randint(0, len(chars))
            chars[k : k + rnd.randint(0, 2)] = rnd.choices("aéb", k=rnd.randint(0, 2))
        b[i] = "".join(chars)
    for most in (0, 1, 2):
        assert J.distances(pd.Series(a), pd.Series(b), most).tolist() == [min(osa(x, y), most + 1) for x, y in zip(a, b)]


def test_a_name_gives_each_string_once():
    for name in ("", "a", "ab", "aab", "abcd"):
        strings = {name}
        for _ in range(2):
            strings |= {s[:i] + s[i + 1 :] for s in strings for i in range(len(s))}
        assert name == "" or len(set(J.deletions([name])[0].tolist())) == len(strings)
    assert set(J.deletions(["abcd"])[0].tolist()) & set(J.deletions(["abdc"])[0].tolist())


def test_join_against_all_pairs(spark):
    rnd = random.Random(5)
    names = ["".join(rnd.choices("ab é", k=rnd.randint(1, 7))) for _ in range(120)] + [None, "", " ", "x" * 127, "x" * 128, "x" * 129 + "y", "x" * 131, "z" * 5000, "z" * 4999 + "y", "q" + "z" * 5000]
    left = [(i % 150, rnd.choice(names)) for i in range(400)] + [(None, "ab"), (7, None), (9, "z" * 5000), (9, "z" * 5000)] + [(k, "hot") for k in range(1000, 1300)]
    right = [(i % 90, rnd.choice(names)) for i in range(100)] + [(500, "hto"), (500, "hto"), (None, "ab"), (501, None), (502, "z" * 4998), (503, "x" * 130)]
    left, right = [r for r in left if not r[1] or len(r[1]) < 1000 or r[0] == 9], [r for r in right if not r[1] or len(r[1]) < 1000 or r[0] == 502]
    frames = [spark.createDataFrame([(*r, "x") for r in rows], "id long, name string, distance string") for rows in (left, right)]
    want = brute([r for r in left if r[1] and len(r[1]) < 1000], [r for r in right if r[1] and len(r[1]) < 1000], 2) | {(502, 2, sum(r[0] == 9 and len(r[1]) == 5000 for r in left), 9, zlib.crc32(b"9") * sum(r[0] == 9 and len(r[1]) == 5000 for r in left))}
    assert {tuple(r) for r in J.join_by_name(*frames).select("right_id", "distance", "n_left", "first_left_id", "left_crc").collect()} == want
    assert {tuple(r) for r in J.join_by_name(*frames, distance=1).collect() if r["right_id"] != 502} == brute([r for r in left if r[1] and len(r[1]) < 1000], [r for r in right if r[1] and len(r[1]) < 1000], 1)


def test_empty_tables(spark):
    none, some = (spark.createDataFrame(rows, "id long, name string") for rows in ([], [(1, "a"), (2, None), (3, "")]))
    assert J.join_by_name(none, some).collect() == [] == J.join_by_name(some, none).collect() == J.join_by_name(none, none).collect()


def test_misspelling(spark):
    rows = [(k, n) for k in (*range(60), None) for n in ("abcdef", "é日", "x", "", None)]
    for r in spark.createDataFrame(rows, "k long, n string").select("k", "n", J.misspelt(J.F.col("n"), J.F.col("k")).alias("m")).collect():
        want, h = r["n"], zlib.crc32(str(r["k"]).encode()) if r["k"] is not None else 1
        if want and len(want) >= 2 and h % 2 == 0:
            i = h % (len(want) - 1)
            want = want[:i] + want[i + 1] + want[i] + want[i + 2 :]
        assert r["m"] == want


def test_query_matches_sql_and_broadcasts_nothing(spark, data):
    found = J.op13_names(spark, data)
    with duckdb.connect() as c:
        for t in ("clients", "vendors"):
            c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
        want = c.execute(J.SQL).fetchall()
    names = ("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc")
    assert sorted(want) == sorted(tuple(r[n] for n in names) for r in found.collect()) and want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
