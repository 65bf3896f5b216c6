"""Repair of conversations against all cheapest edit sequences, and on awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from fennwick.llm import conversations as C

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    """By the statement alone: rows (turn, role, text) of one conversation in order; all audits by a search over suffixes."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    roles = [r for _, r, _ in rows]
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {(len(rows), e): [] for e in ("", "s", "u", "a")}
    memo = {}

    def go(i, end, inserts):
        """(cost, audit, repaired) from row i on."""
        if (i, end, inserts) in memo:
            return memo[i, end, inserts]
        ways = [(0, "", ())] if i == len(rows) and end in ("", "a") else []
        if inserts < 3:
            for c, role in (("u", "user"), ("a", "assistant")):
                if (end, c) in legal:
                    cost, audit, out = go(i, c, inserts + 1)
                    ways.append((cost + 3, "I" + audit, ((role, ""), *out)))
        if i < len(rows):
            cost, audit, out = go(i + 1, end, 0)
            ways.append((cost + 4, "D" + audit, out))
            if faults[i] not in "bd":
                more = 3 * (faults[i] == "t")
                for letter, role, price in (("K", roles[i], 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if (end, role[:1]) in legal:
                        cost, audit, out = go(i + 1, role[:1], 0)
                        ways.append((cost + price + more, letter + audit, ((role, rows[i][2]), *out)))
        memo[i, end, inserts] = min(ways) if ways else (10**9, "", ())
        return memo[i, end, inserts]

    assert best
    cost, audit, out = go(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, SHA("\n".join(f"{r}:{t}" for r, t in out)))


def made(seed, sizes):
    rnd, rows = random.Random(seed), []
    for conv, size in enumerate(sizes):
        turn = 0
        for k in range(size):
            turn += rnd.choice((1, 1, 1, 2, 3))
            text = rnd.choice(("Yes.", "No!", "", " \n", "cut off", f"Some words {rnd.randrange(9)}?", "é. \t", "x.\n "))
            rows.append((conv, None if rnd.random() < 0.03 and not k else turn, rnd.choice(("user", "assistant", "user", "assistant", "system", "tool", "", "agent")), text))
    return rows


def of(rows):
    convs = defaultdict(list)
    for conv, *row in rows:
        convs[conv].append(tuple(row))
    return {c: plain(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0))) for c, r in convs.items()}


def test_audits_are_the_least_of_all_cheapest(spark):
    rows = made(1, [random.Random(3).randint(1, 12) for _ in range(150)] + [60, 90])
    want = of(rows)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(3)
    for size in (1024, 1, 4):
        found = {r[0]: tuple(r[1:]) for r in C.summaries(C.repair(frame, block_rows=size)).collect()}
        assert found == want


def test_chained_blocks_give_the_whole_conversations_distances():
    rnd = random.Random(6)
    for _ in range(60):
        n = rnd.randint(1, 30)
        initials, faults = [rnd.choice("suax") for _ in range(n)], "".join(rnd.choice("bdt---") for _ in range(n))
        whole = C.distances(initials, faults, C.ENDING)
        ends, at = C.ENDING, n
        while at:
            start = max(0, at - rnd.randint(1, 7))
            part = C.distances(initials[start:at], faults[start:at], ends)
            assert part[:4] == whole[4 * start : 4 * start + 4]
            ends, at = part[:4], start


def test_messages(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "user", "Hi."), (1, 4, "user", "Hi."), (1, 5, "assistant", "Well"), (2, 1, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = C.messages(C.repair(frame)).orderBy("conv_id", "part", "no", "k").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in found] == [(1, "system", "Be kind."), (1, "user", "Hi."), (1, "assistant", "Well"), (2, "user", ""), (2, "assistant", "Yes.")]


def test_awkward_rows(spark):
    rows = [(None, 1, "user", "A."), (None, None, None, None), (7, None, None, "x" * 300_000 + "."), (8, 1, "user", "Same."), (8, 1, "user", "Same."), (8, 1, "user", "Same."), (9, 3, "", ""), (9, 3, None, None)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, state int")
    reads = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert {r[0]: tuple(r[1:]) for r in C.summaries(C.repair(frame)).collect()} == of(reads)
    assert C.summaries(C.repair(frame.limit(0))).collect() == [] == C.messages(C.repair(frame.limit(0))).collect()


def test_damage(spark):
    rows = [(c, t, "assistant", f"A{t}. b!") for c in (1, 2, None) for t in (*range(60), None)]
    found = defaultdict(list)
    for r in C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        found[r["conv_id"], r["turn"]].append((r["role"], r["text"]))
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {0: [], 1: [(role, "")], 2: [(role, text.replace(".", "").replace("!", ""))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(code, [(role, text)])
        assert found[c, t] == want


def test_query_matches_sql(spark, data):
    with duckdb.connect() as c:
        c.execute(f"create view conversations as select * from '{data}/conversations.parquet'")
        want = c.execute(C.SQL).fetchall()
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert sorted(want) == sorted(tuple(r[n] for n in names) for r in C.op12_repair(spark, data).collect()) and want
