"""Repair of conversations by least-cost edits: Dial's bucket queue, and a walk along tight arcs.

A conversation's rows in order should have the role initials ``(s?(ua)+)?``. An edit keeps a row (K, cost 0), gives it the
role that is due (R, 3), deletes it (D, 4; the only one for blank and duplicate rows) or inserts an empty row of that role
(I, 3); a truncated row that stays costs 3 more. A node is a place between rows with what the repaired rows end with so far:
nothing, s, u or a. Arcs cost 6 at most, so the distances to the end are found with a queue of few buckets. The audit
is read off them: from the first place on, the least letter among the arcs that distances show to be tight. In each node
a letter is one arc, and equally cheap audits are never prefixes of each other, so this is the least audit.

Rows are dealt by ranges of (conv_id, turn, role, text's hash), so that a conversation, however long, is spread over as many
tasks as its rows need. A task cuts its rows into blocks of ``BLOCK_ROWS`` rows or ``BLOCK_CHARS`` characters. A conversation
that starts and ends within one task, in one block, is repaired at once. The others' blocks go on together:
repeats are found by (conv_id, role, text) over all blocks; each block's least costs between its four first and four last
nodes are summed from the last block to the first, which gives each block the distances at its end; with them each block
finds its own distances, and for each first node its audit and its last node; these are chained from the first block to the
last. The two chains pass over one narrow row a block, in order, and hold nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennwick.llm.common import bound_batches, materialize, table

BLOCK_ROWS = 1024
BLOCK_CHARS = 1 << 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What the repaired rows end with, and for each such state the state and role that an inserted or re-roled row gives.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
DUE, ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
#: From which states a row of each initial may be kept, and the state it gives.
KEPT = {"s": ((NOTHING,), SYSTEM), "u": ((NOTHING, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
BEFORE = ((), (), (NOTHING, SYSTEM, ASSISTANT), (USER,))
#: The distances at the end of a conversation, which may end with nothing or an assistant's row.
ENDING = [0, 2 * INSERT, INSERT, 0]
FAR = 1 << 60
LARGEST_ARC = max(DELETE, REROLE + TRUNCATED)
BLANK, DUPLICATE, CUT, FINE = "b", "d", "t", "-"
WHITE = " \t\n\x0b\f\r"


def distances(initials: list[str], faults: str, ends: list[int]) -> list[int]:
    """The least cost from each node (place, state), at 4 * place + state, to the end; ``ends`` are those of the last place.

    Dial's queue: a node waits in the bucket of its distance, and as no arc is longer than the largest, a ring of few buckets
    holds all that wait.
    """
    n, low = len(faults), min(ends)
    out, done = [FAR] * (4 * n + 4), bytearray(4 * n + 4)
    size = LARGEST_ARC + 1 + max(d for d in ends if d < FAR) - low
    ring, waiting, now = [[] for _ in range(size)], 0, low

    def reach(node: int, d: int) -> None:
        nonlocal waiting
        if d < out[node]:
            out[node] = d
            ring[d % size].append(node)
            waiting += 1

    for state, d in enumerate(ends):
        if d < FAR:
            reach(4 * n + state, d)
    while waiting:
        while ring[now % size]:
            node = ring[now % size].pop()
            waiting -= 1
            if done[node]:
                continue
            done[node] = 1
            place, state = node >> 2, node & 3
            if place < n:  # at the last place these arcs are the next block's, or ENDING has them
                for q in BEFORE[state]:
                    reach(4 * place + q, now + INSERT)
            if place:
                at, fault = 4 * place - 4, faults[place - 1]
                reach(at + state, now + DELETE)
                if fault not in "bd":
                    more = now + (TRUNCATED if fault == CUT else 0)
                    origins, given = KEPT.get(initials[place - 1], ((), -1))
                    if given == state:
                        for q in origins:
                            reach(at + q, more + KEEP)
                    for q in BEFORE[state]:
                        reach(at + q, more + REROLE)
        now += 1
    return out


def walk(initials: list[str], faults: str, dist: list[int], state: int, last: bool) -> tuple[str, int]:
    """The least audit along tight arcs from the first place in ``state``, and the state at the end."""
    n, place, audit = len(faults), 0, []
    while True:
        here = dist[4 * place + state]
        if place == n:
            while last and state not in (NOTHING, ASSISTANT):
                audit.append("I")
                state = DUE[state]
            return "".join(audit), state
        fault, after = faults[place], 4 * place + 4
        more = TRUNCATED if fault == CUT else 0
        if here == dist[after + state] + DELETE:
            audit.append("D")
            place += 1
        elif here == dist[4 * place + DUE[state]] + INSERT:
            audit.append("I")
            state = DUE[state]
        else:
            origins, given = KEPT.get(initials[place], ((), -1))
            if fault not in "bd" and state in origins and here == dist[after + given] + more + KEEP:
                audit.append("K")
                state = given
            else:
                audit.append("R")
                state = DUE[state]
            place += 1


def apply(roles: list[str], texts: list[str], audit: str, state: int) -> tuple[list[str], list[str]]:
    """The repaired rows that an audit makes of a block's rows, from ``state`` on."""
    place, out_roles, out_texts = 0, [], []
    for edit in audit:
        if edit == "K":
            out_roles.append(roles[place])
            out_texts.append(texts[place])
            state = KEPT[roles[place][:1]][1]
        elif edit != "D":
            out_roles.append(ROLE[state])
            out_texts.append("" if edit == "I" else texts[place])
            state = DUE[state]
        place += edit != "I"
    return out_roles, out_texts


def cost_of(audit: str, faults: str) -> int:
    place, total = 0, 0
    for edit in audit:
        total += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if edit in "KR" and faults[place] == CUT else 0)
        place += edit != "I"
    return total


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


BLOCK = ["conv_id", "part", "no", "closed", "faults", "low", "high", "turns", "first", "last", "audit", "illegal", "roles", "texts"]
NARROW = "part int, no int, closed boolean, faults string, low long, high long, turns long, first string, last string, audit string"


def fault_of(text: Column) -> Column:
    """b for a blank text, t for one that ends without a sentence mark, - for others; repeats are told later."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)


def with_repeats(faults: str, repeats) -> str:
    out = list(faults)
    for k in repeats:
        out[k] = BLANK if out[k] == BLANK else DUPLICATE
    return "".join(out)


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of ``rows`` (conv_id, turn, role, text, fault), in order by (part, no); closed ones are repaired."""
    bound_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, runs, whole, out = TaskContext.get().partitionId(), 0, 0, True, []
        conv, held, chars, kinds = object(), [], 0, None

        def close(ends: bool) -> None:
            """ends: the conversation ends here, within this task."""
            nonlocal no, held, chars, whole
            roles, texts, turns = [r[1] for r in held], [r[2] for r in held], [r[0] for r in held if r[0] is not None]
            initials, faults, audit, closed = [r[:1] for r in roles], "".join(r[3] for r in held), None, ends and whole and runs > 1
            if closed:
                seen, repeats = set(), []
                for k, pair in enumerate(zip(roles, texts)):
                    if pair in seen:
                        repeats.append(k)
                    seen.add(pair)
                faults = with_repeats(faults, repeats)
                audit, _ = walk(initials, faults, distances(initials, faults, ENDING), NOTHING, True)
                roles, texts = apply(roles, texts, audit, NOTHING)
            out.append((conv, part, no, closed, faults, min(turns, default=None), max(turns, default=None), len(set(turns)), initials[0], initials[-1], audit, illegal_pairs(initials), roles, texts))
            no, held, chars, whole = no + 1, [], 0, False

        def flush() -> pa.RecordBatch:
            done, out[:] = list(zip(*out)), []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, kinds)], names=BLOCK)

        for batch in batches:
            kinds = [batch.schema.types[0], pa.int32(), pa.int32(), pa.bool_(), pa.string(), *[pa.int64()] * 3, *[pa.string()] * 3, pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != conv:
                    if held:
                        close(True)
                    conv, whole, runs = key, True, runs + 1
                elif len(held) >= block_rows or chars >= block_chars:
                    close(False)
                held.append(row)
                chars += len(row[2])
            if out:
                yield flush()
        if held:
            close(False)
            yield flush()

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cast = dealt.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "fault")
    found = cast.mapInArrow(cut, f"conv_id {kind}, {NARROW}, illegal long, roles array<string>, texts array<string>")
    return materialize(found, "conversation-blocks")


def _in_order(rows: DataFrame, back: bool = False) -> DataFrame:
    """Rows of one conversation in one task, in the order of their blocks or against it."""
    way = (lambda c: F.col(c).desc()) if back else F.col
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", way("part"), way("no"))


def _join(rows: DataFrame, others: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(others, ["part", "no"], how)  # unique over all conversations


def repair_open(found: DataFrame) -> DataFrame:
    """Repaired blocks of conversations of several blocks or tasks, with columns as those of closed ones."""
    kind, places = found.schema["conv_id"].dataType.simpleString(), F.struct("part", "no", "k")
    many = found.where(~F.col("closed"))
    pairs = many.select("conv_id", "part", "no", F.posexplode(F.arrays_zip("roles", "texts")).alias("k", "pair"))
    keyed = pairs.select("conv_id", F.sha2(F.concat(F.length("pair.roles").cast("string"), F.lit(":"), "pair.roles", "pair.texts"), 256).alias("digest"), places.alias("place"))
    keyed = materialize(keyed, "conversation-keys")
    firsts = materialize(keyed.groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1"), "conversation-firsts")
    met = keyed.join(firsts.withColumnsRenamed({"conv_id": "c", "digest": "d"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    repeats = met.where("place <> first").groupBy("place.part", "place.no").agg(F.collect_list("place.k").alias("repeats"))  # a block's rows at most

    @F.pandas_udf("string")
    def faults_of(faults: pd.Series, repeats: pd.Series) -> pd.Series:
        return pd.Series([with_repeats(f, r if r is not None else ()) for f, r in zip(faults, repeats)])

    initials = F.transform("roles", lambda r: r.substr(1, 1)).alias("initials")
    narrow = _join(many.select("conv_id", "part", "no", "faults", initials), repeats, "left")
    narrow = materialize(narrow.select("conv_id", "part", "no", "initials", faults_of("faults", "repeats").alias("faults")), "conversation-narrow")

    @F.pandas_udf("array<long>")
    def crossing(initials: pd.Series, faults: pd.Series) -> pd.Series:
        out = []
        for i, f in zip(initials, faults):
            to = [distances(list(i), f, [0 if q == end else FAR for q in range(4)]) for end in range(4)]
            out.append([to[end][state] for state in range(4) for end in range(4)])
        return pd.Series(out)

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ends = object(), ENDING
        for batch in batches:
            out = []
            for key, part, no, costs in zip(*(c.to_pylist() for c in batch.columns)):
                last = key != conv
                ends = ENDING if last else ends
                out.append((part, no, ends, last))
                conv, ends = key, [min(costs[4 * q + e] + ends[e] for e in range(4)) for q in range(4)]
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "no", "ends", "last_block"), r)) for r in out], pa.schema([("part", pa.int32()), ("no", pa.int32()), ("ends", pa.list_(pa.int64())), ("last_block", pa.bool_())]))

    costs = materialize(narrow.select("conv_id", "part", "no", crossing("initials", "faults").alias("costs")), "conversation-costs")
    ends = materialize(_in_order(costs, back=True).mapInArrow(backward, "part int, no int, ends array<long>, last_block boolean"), "conversation-ends")

    @F.pandas_udf("states array<int>, audits array<string>")
    def from_each(initials: pd.Series, faults: pd.Series, ends: pd.Series, last: pd.Series) -> pd.DataFrame:
        out = []
        for i, f, e, z in zip(initials, faults, ends, last):
            dist = distances(list(i), f, [int(d) for d in e])
            out.append([walk(list(i), f, dist, state, z) for state in range(4)])
        return pd.DataFrame({"states": [[s for _, s in o] for o in out], "audits": [[a for a, _ in o] for o in out]})

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), NOTHING
        for batch in batches:
            out = []
            for key, part, no, states in zip(*(c.to_pylist() for c in batch.columns)):
                state = NOTHING if key != conv else state
                out.append((part, no, state))
                conv, state = key, states[state]
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "no", "state"), r)) for r in out], pa.schema([("part", pa.int32()), ("no", pa.int32()), ("state", pa.int32())]))

    ways = materialize(_join(narrow, ends).select("conv_id", "part", "no", "faults", from_each("initials", "faults", "ends", "last_block").alias("w")).select("conv_id", "part", "no", "faults", "w.*"), "conversation-ways")
    states = materialize(_in_order(ways.select("conv_id", "part", "no", "states")).mapInArrow(forward, "part int, no int, state int"), "conversation-states")
    taken = _join(ways, states).select("part", "no", "faults", F.get("audits", F.col("state")).alias("audit"), "state")

    @F.pandas_udf("roles array<string>, texts array<string>")
    def repaired(roles: pd.Series, texts: pd.Series, audit: pd.Series, state: pd.Series) -> pd.DataFrame:
        done = [apply(list(r), list(t), a, s) for r, t, a, s in zip(roles, texts, audit, state)]
        return pd.DataFrame({"roles": [r for r, _ in done], "texts": [t for _, t in done]})

    whole = _join(many.drop("faults", "audit"), taken)
    return whole.select("conv_id", "part", "no", "closed", "faults", "low", "high", "turns", "first", "last", "audit", "illegal", repaired("roles", "texts", "audit", "state").alias("m")).select("*", "m.roles", "m.texts").drop("m")


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Repaired blocks of the conversations in ``rows`` (conv_id, turn, role, text); ``messages`` and ``summaries`` read them.

    Rows are taken by turn, null ones first, ties by role and a hash of the text. Null roles and texts read as one space, a null
    conv_id is a conversation of its own. Roles count by their first character, others than s, u and a can't be kept. Very
    long texts and conversations are taken whole; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce("text", F.lit(" "))
    read = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), fault_of(text).alias("fault"))
    found = blocks(read, block_rows, block_chars)
    return found.where("closed").unionByName(materialize(repair_open(found), "conversation-open"))


def messages(repaired: DataFrame) -> DataFrame:
    """(conv_id, part, no, k, role, text): the repaired rows, in order by (part, no, k) within a conversation."""
    rows = repaired.select("conv_id", "part", "no", F.posexplode(F.arrays_zip("roles", "texts")).alias("k", "m"))
    return rows.select("conv_id", "part", "no", "k", F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summaries(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    A digest goes through a conversation's rows in order, so the blocks of one conversation pass through one task, one
    after the other; it holds one block, the digest's state and the audit, which is the result itself.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, total, out, kinds = None, None, [], None

        def close() -> None:
            gaps = total["high"] - total["low"] + 1 - total["turns"] if total["turns"] else 0
            out.append((conv, gaps, total["b"], total["d"], total["t"], total["illegal"], total["cost"], "".join(total["audit"]), total["sha"].hexdigest()))

        def flush() -> pa.RecordBatch:
            done, out[:] = list(zip(*out)), []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, kinds)], names=["conv_id", *(c.split()[0] for c in COUNTS.split(", "))])

        for batch in batches:
            kinds = [batch.schema.types[0], *[pa.int64()] * 6, pa.string(), pa.string()]
            for key, faults, low, high, turns, first, last, audit, illegal, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                if total is None or key != conv:
                    if total is not None:
                        close()
                    conv, total = key, {"b": 0, "d": 0, "t": 0, "illegal": 0, "cost": 0, "turns": 0, "low": None, "high": None, "last": None, "audit": [], "sha": hashlib.sha256(), "begun": False}
                for f in "bdt":
                    total[f] += faults.count(f)
                total["illegal"] += illegal + (total["last"] is not None and total["last"] + first not in ("su", "ua", "au"))
                total["turns"] += turns - (low is not None and low == total["high"])  # a turn that two blocks share
                total["low"] = low if total["low"] is None else total["low"]
                total["high"] = total["high"] if high is None else high
                total["cost"] += cost_of(audit, faults)
                total["last"] = last
                total["audit"].append(audit)
                for role, text in zip(roles, texts):
                    total["sha"].update(f"{chr(10) * total['begun']}{role}:{text}".encode("utf-8", "surrogatepass"))
                    total["begun"] = True
            if out:
                yield flush()
        if total is not None:
            close()
            yield flush()

    columns = ["conv_id", "faults", "low", "high", "turns", "first", "last", "audit", "illegal", "roles", "texts"]
    schema = f"conv_id {kind}, {COUNTS}"
    single = repaired.where("closed").select(*columns).mapInArrow(add, schema)
    return single.unionAll(_in_order(repaired.where(~F.col("closed"))).select(*columns).mapInArrow(add, schema))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with nulls as one space and the faults that the crc32 of ``conv_id:turn`` gives."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")), F.lit(20))
    coded = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return coded.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op12_repair(spark, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after the damage."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = materialize(summaries(repair(damaged(rows))), "conversation-summaries")
    every = rows.groupBy("conv_id").agg(F.count("*").alias("rows")).select("conv_id")
    joined = every.join(found.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: The cheapest suffix from each state as cost, in nine digits, and audit: the least string is the cheapest and ASCII-least.
_FAR = "'900000000'"
_ADD = "(lpad((substr({0}, 1, 9)::int + {1})::varchar, 9, '0') || '{2}' || substr({0}, 10))"
_CRC = "xor(4294967295, list_reduce(list_transform(string_split({0}, ''), lambda x: unicode(x)::bigint), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295::bigint))"


def _step(state: int) -> str:
    """SQL for the least suffix from a state over one row (r[1] its initial, r[2] its fault), but for insertions; b has the suffixes after it."""
    keep, rerole = (" + 3 * (r[2] = 't')::int" for _ in range(2))
    kept = [f"when r[1] = '{i}' then {_ADD.format(f'b[{given + 1}]', '0' + keep, 'K')}" for i, (origins, given) in KEPT.items() if state in origins]
    stay = f"case when r[2] in ('b', 'd') then {_FAR} {' '.join(kept)} else {_FAR} end"
    role = f"case when r[2] in ('b', 'd') then {_FAR} else {_ADD.format(f'b[{DUE[state] + 1}]', '3' + rerole, 'R')} end"
    return f"least({_ADD.format(f'b[{state + 1}]', 4, 'D')}, {stay}, {role})"


_INSERT = "[" + ", ".join(f"least(n[{q + 1}], {_ADD.format(f'n[{DUE[q] + 1}]', 3, 'I')})" for q in range(4)) + "]"
SQL = f"""
with bytes as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n)) as crc),
coded as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  {_CRC.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as code from conversations, bytes),
damaged as (select conv_id, turn, case when code = 4 then 'user' else role end as role, case code when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
  unnest(case when code = 3 then [0, 1] else [0] end) as copy from coded where code <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k from damaged),
marked as (select *, role[1:1] as initial, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by conv_id, role, text order by k) > 1 then 'd'
  when regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') then 't' else '-' end as fault,
  lag(role[1:1]) over (partition by conv_id order by k) as before from placed),
counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
  count(*) filter (fault = 't') as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal,
  list_reduce(list(['' || initial, fault, '', ''] order by k desc), lambda b, r:
    list_transform([[{", ".join(_step(q) for q in range(4))}]], lambda n: list_transform([{_INSERT}], lambda n: {_INSERT})[1])[1],
    ['000000000', '000000006II', '000000003I', '000000000']) as best from marked group by conv_id),
audits as (select *, substr(best[1], 1, 9)::bigint as cost, substr(best[1], 10) as audit from counted),
edits as (select conv_id, unnest(string_split(audit, '')) as e, unnest(range(1, len(audit) + 1)) as pos from audits where audit <> ''),
aligned as (select *, sum((e <> 'I')::int) over w as k, sum((e <> 'D')::int) over w as place from edits window w as (partition by conv_id order by pos)),
merged as (select a.*, m.role, m.text, m.initial from aligned a left join marked m on a.conv_id is not distinct from m.conv_id and a.k = m.k and a.e <> 'I'),
led as (select *, max((e = 'K' and place = 1 and initial = 's')::int) over (partition by conv_id) as lead_s from merged where e <> 'D'),
repaired as (select conv_id, sha256(string_agg(case when e = 'K' then role when (place - lead_s) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end, chr(10) order by pos)) as sha from led group by conv_id)
select c.conv_id, coalesce(a.gaps, 0)::bigint as gaps, coalesce(a.blank, 0) as blank, coalesce(a.duplicate, 0) as duplicate, coalesce(a.truncated, 0) as truncated, coalesce(a.illegal, 0) as illegal,
  coalesce(a.cost, 0) as cost, coalesce(a.audit, '') as audit, coalesce(r.sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join audits a on c.conv_id is not distinct from a.conv_id left join repaired r on c.conv_id is not distinct from r.conv_id
"""
