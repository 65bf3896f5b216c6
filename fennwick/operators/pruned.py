"""Search of a stored index by bounds: few blocks of postings and few texts are read, and the result is that of a full search.

1. The query's terms give their frequencies and how many of their postings lie at each level of weight: one small read.
2. Rounds read blocks by falling bound, across all terms, a round sixteen times as many postings as the one before. What has
   been read of a chunk bounds its score from below; with what the unread blocks of its other terms, its text and its title
   can add at most, from above. Rounds end when a chunk of unread blocks alone can't reach the k-th best lower bound, and few
   enough chunks can.
3. Those chunks' rows are read by ranges of their ids, which reach the scan, and scored from their texts and titles.

Where too many chunks stay in reach after all blocks are read, there is no pruning to be had, and the caller scores all.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennwick.functions import text as T
from fennwick.operators import chunk_index as X
from fennwick.operators import posting_blocks as B
from fennwick.operators import title_index as I

#: Postings of the first round, and by what a round grows.
FIRST, GROWTH = 1 << 15, 16
#: Chunks whose rows are read at most; ids of so many go to the driver.
MOST = 2048
#: Titles that a pin or a profile names at most, of which chunks are read by title.
TITLES = 256
#: Ranges of ids in a filter.
RANGES = 48
SLACK = 0.002


def candidates(index: X.ChunkIndex, plan: X.QueryPlan) -> tuple[DataFrame | None, bool]:
    """(chunk_id, title, text, score) of all chunks that may be among the best or are named by a pin or profile, and whether
    there is a profile; None where there is no bound to prune by."""
    with ThreadPoolExecutor(3) as pool:  # three small reads at once
        found = pool.submit(lambda: {r["term"]: r for r in index.terms.where(F.col("term").isin(*plan.terms)).collect()})
        near = pool.submit(_near, index, plan)
        named = pool.submit(_named, index, plan)
        found, near, named = found.result(), near.result(), named.result()
    if named is None:
        return None, True
    near = {t: most if most > X.NEAR_SCORE * X.CHARS_FACTOR or t not in found else 0.0 for t, most in near.items()}  # all characters count for unknown terms alone
    n = index.numbers["n"]
    idf = {t: math.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5)) for t, r in found.items()}
    ids = _survivors(index, plan, found, idf, near) if found else []
    if ids is None:
        return None, True
    wanted = _ids_filter(ids)
    for r in named:
        wanted = wanted | ((F.col("title") == r["title"]) & F.col("chunk_id").between(r["first_id"], r["last_id"]))
    return score_rows(index.chunks.where(wanted), index, plan, idf, near), bool(named) and not plan.pin


def _near(index: X.ChunkIndex, plan: X.QueryPlan) -> dict[str, float]:
    """What a title may add for each term at most: by characters near each other, or all of them, in any one title."""
    words = [t for t in plan.terms if len(t) >= 2]
    wanted = {f"p{t}": I.pairs_of(t) for t in words} | {f"c{t}": sorted(set(t)) for t in words}
    keys = {r["key"] for r in I.holding(index.grams, wanted).select("key").distinct().collect()} if words else set()
    return {t: X.NEAR_SCORE * X.NEAR_FACTOR if f"p{t}" in keys else X.NEAR_SCORE * X.CHARS_FACTOR if f"c{t}" in keys else 0.0 for t in words}


def _named(index: X.ChunkIndex, plan: X.QueryPlan) -> list | None:
    """The titles of the pin or the profile; None for more than ``TITLES``."""
    if plan.pin:
        rows = I.pinned_titles(index.titles, index.grams, plan.pin, plan.pin_theme)
    elif len(flat := X.without_separators(plan.flat)) >= 2:
        rows = I.profile_titles(index.titles, flat, X.PROFILE_SECTION)
    else:
        return []
    rows = rows.groupBy("title").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))  # over segments
    found = rows.limit(TITLES + 1).collect()
    return found if len(found) <= TITLES else None


def _survivors(index: X.ChunkIndex, plan: X.QueryPlan, found: dict, idf: dict[str, float], near: dict[str, float]) -> list[int] | None:
    """The ids of all chunks that may be among the best ``top_k``; None if they are too many."""
    k, n_terms = max(1, plan.top_k), len(plan.terms)
    most = float(sum(share for _, share in X._bonuses(plan)))
    over, lift = (X.OVERVIEW_BOOST if plan.overview else 1.0), sum(near.values())
    # (greatest weight, term, level, postings), from the greatest down. A level's blocks weigh less than its upper end.
    steps = sorted(((idf[t] * (lv["level"] + 1) / B.STEPS, t, lv["level"], lv["n"]) for t, r in found.items() for lv in r["levels"]), reverse=True)
    budget, taken, read, lowest = FIRST, 0, 0, {}
    while True:
        began = taken
        while taken < len(steps) and (taken == began or read + steps[taken][3] <= budget):
            _, t, level, n = steps[taken]
            lowest[t], read, taken = level, read + n, taken + 1
        rest = {}  # what an unread block of each term weighs at most
        for weight, t, _, _ in steps[taken:]:
            rest.setdefault(t, weight)
        ids, floor, whole = _round(index, plan, idf, lowest, rest, lift, most, over, k)
        unseen = _reach(sum(rest.values()), len(rest), len(rest) == n_terms, n_terms, most, over, lift) if rest else -1.0
        if whole and (not rest or (floor is not None and unseen + SLACK < floor)):
            return ids
        if taken == len(steps):
            return None
        budget *= GROWTH


def _reach(base: float, matched: int, every: bool, n_terms: int, most: float, over: float, lift: float) -> float:
    s = base * (X.COVERAGE[0] + X.COVERAGE[1] * matched / n_terms) * (X.TITLE_ALL if every else 1.0)
    return (s + most * max(s, 1.0)) * over + lift


def _round(index: X.ChunkIndex, plan: X.QueryPlan, idf: dict[str, float], lowest: dict[str, int], rest: dict[str, float], lift: float, most: float, over: float, k: int) -> tuple[list[int], float | None, bool]:
    """Ids of the chunks in the blocks read that may be among the best, the k-th best lower bound, and whether these are all of them."""
    n_terms = F.lit(len(plan.terms))
    chosen = " OR ".join(f"(term = {T.quoted([t])} AND bound >= {level / B.STEPS!r}D)" for t, level in lowest.items())
    value = lambda d: f"CASE term {' '.join(f'WHEN {T.quoted([t])} THEN {x!r}D' for t, x in d.items())} END"
    unread = value({t: rest.get(t, 0.0) for t in idf})
    weight = f"IF(text_tf > 0, {_weight('text_tf', 'text_len', index.numbers['avg_len'])}, 0D) + IF(title_tf > 0, {X.TITLE_BOOST}D * {_weight('title_tf', 'title_len', index.numbers['avg_title_len'])}, 0D)"
    met = B.decoded(index.blocks.where(chosen)).groupBy("chunk_id").agg(
        F.expr(f"sum({value(idf)} * ({weight}))").alias("base"), F.count("*").alias("matched"), F.expr("count_if(title_tf > 0)").alias("in_title"), F.expr(f"sum({unread})").alias("known"), F.expr(f"count_if({unread} > 0)").alias("open"),
    )
    low = X.covered(F.col("base"), F.col("matched"), F.col("in_title"), n_terms)
    left, more = F.greatest(F.lit(sum(rest.values())) - F.col("known"), F.lit(0.0)), F.lit(len(rest)) - F.col("open")
    s = X.covered(F.col("base") + left, F.col("matched") + more, F.col("in_title") + more, n_terms)
    high = (s + most * F.greatest(s, F.lit(1.0))) * over + lift
    top = met.select("chunk_id", low.alias("low"), high.alias("high")).orderBy(F.col("high").desc()).limit(MOST + 1).collect()
    lows = sorted((r["low"] for r in top), reverse=True)
    floor = lows[k - 1] if len(lows) >= k else None
    ids = [r["chunk_id"] for r in top if floor is None or r["high"] + SLACK >= floor]
    return ids, floor, len(ids) <= MOST


def _ids_filter(ids: list[int]) -> Column:
    """Chunks of these ids, by their ranges, which the scan can skip row groups by."""
    if not ids:
        return F.lit(False)
    ids = sorted(ids)
    gaps = sorted(range(1, len(ids)), key=lambda i: ids[i] - ids[i - 1], reverse=True)[: RANGES - 1]
    cuts = [0, *sorted(gaps), len(ids)]
    ranges = " OR ".join(f"chunk_id BETWEEN {ids[a]} AND {ids[b - 1]}" for a, b in zip(cuts, cuts[1:]))
    return F.expr(f"({ranges}) AND chunk_id IN ({', '.join(map(str, ids))})")


def _weight(tf: str, length: str, average: float | None) -> str:
    """``chunk_index``'s weight of a term, as SQL: one text is parsed faster than its many parts are put together."""
    return f"({tf} * {X.K1 + 1}D / ({tf} + {X.K1}D * ({1 - X.LENGTH_SHARE}D + {X.LENGTH_SHARE}D * {length} / {max(float(average or 0), 1e-6)!r}D)))"


def score_rows(rows: DataFrame, index: X.ChunkIndex, plan: X.QueryPlan, idf: dict[str, float], near: dict[str, float]) -> DataFrame:
    """(chunk_id, title, text, score) of ``rows`` of the index's chunks with a positive score, from their texts and titles alone."""
    cut = lambda c: T.tokenize(F.col(c), segmenter=index.segmenter).alias(c[:2])
    terms = sorted(idf)
    held = rows.select("chunk_id", "title", "text", "text_len", "title_len", F.struct(cut("text"), cut("title")).alias("_t"))
    counts = ", ".join(f"size(filter(t.{c}, x -> x = {T.quoted([t])})) AS _{c}{k}" for k, t in enumerate(terms) for c in ("te", "ti"))
    # Generated, so that no filter on what is counted is moved below and cuts the text again for each of its terms.
    counted = held.select("chunk_id", "title", "text", "text_len", "title_len", F.expr(f"inline(transform(array(_t), t -> struct(0 AS _{', ' * bool(terms)}{counts})))"))
    numbers = index.numbers
    parts = [f"{idf[t]!r}D * (IF(_te{k} > 0, {_weight(f'_te{k}', 'text_len', numbers['avg_len'])}, 0D) + IF(_ti{k} > 0, {X.TITLE_BOOST}D * {_weight(f'_ti{k}', 'title_len', numbers['avg_title_len'])}, 0D))" for k, t in enumerate(terms)]
    both = lambda test: " + ".join([f"int({test.format(k=k)})" for k in range(len(terms))]) or "0"
    lift = F.lit(0.0)
    for t in (t for t, most in near.items() if most > 0):  # no title adds anything for the others
        extra = F.when(T.near_in_order(F.lit(t), F.col("title")), X.NEAR_SCORE * X.NEAR_FACTOR)
        if t not in idf:
            extra = extra.when(F.forall(F.array(*[F.lit(c) for c in t]), lambda c: F.col("title").contains(c)), X.NEAR_SCORE * X.CHARS_FACTOR)
        titled = F.col(f"_ti{terms.index(t)}") > 0 if t in idf else F.lit(False)
        lift = lift + F.when(~titled, extra.otherwise(0.0)).otherwise(0.0)
    over = F.when(F.col("title").rlike("|".join(T.OVERVIEW_SECTIONS)), X.OVERVIEW_BOOST).otherwise(1.0) if plan.overview else F.lit(1.0)
    bonus = F.lit(0.0)
    for piece, share in X._bonuses(plan):
        bonus = bonus + F.when(F.lower("text").contains(piece), share).otherwise(0.0)
    base = F.expr(" + ".join(parts) or "0D").alias("_base")
    summed = counted.select("chunk_id", "title", "text", base, F.expr(both("_te{k} > 0 OR _ti{k} > 0")).alias("_m"), F.expr(both("_ti{k} > 0")).alias("_n"), lift.alias("_lift"), over.alias("_over"), bonus.alias("_bonus")).where("_m > 0")
    s = X.covered(F.col("_base"), F.col("_m"), F.col("_n"), F.lit(len(plan.terms)))
    score = F.round((s + F.col("_bonus") * F.greatest(s, F.lit(1.0))) * F.col("_over") + F.col("_lift"), 3)
    return summed.select("chunk_id", "title", "text", score.alias("score")).where("score > 0")
