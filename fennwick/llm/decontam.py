"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with white space runs as one space. An item of m characters may be met with up to
e = floor(``rate`` * m) edits. Cut into e + 1 pieces, at least one piece is then met exactly, so every piece of every
item goes into one automaton, each document is read through it once, and where a piece is met the item is verified by
Myers' bit-parallel distance against the window in which it could lie. Items are held in blocks of bounded size.

One rule holds for items of all lengths. With ``whole_words``, the default, an item is held where a stretch of whole words
is within its budget: neither end of the stretch may lie between two letters or digits. Without, any stretch counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennwick.llm.common import bound_batches, materialize, spread, table

RATE = 0.05
#: Characters of the items of one block; a block is sent to every worker, where its automaton takes some 64 bytes a character.
BLOCK_CHARS = 2_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces_of(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece) of the e + 1 pieces, of lengths at most one apart."""
    n = int(rate * len(item)) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def scores(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> Iterator[int]:
    """The least edit distance of a pattern of m characters to the stretches that end at each character of ``text``.

    ``anchored``: to the one that begins with the text.
    """
    full, top, first = (1 << m) - 1, 1 << (m - 1), int(anchored)
    pv, mv, score = full, 0, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1 | first) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        yield score


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of m characters to any stretch of ``text``, and the end of the first such stretch."""
    best, end = m, 0
    for j, score in enumerate(scores(masks, m, text)):
        if score < best:
            best, end = score, j + 1
    return best, end


def between_words(text: str, at: int) -> bool:
    """Whether a place in a text does not lie between two letters or digits."""
    return at <= 0 or at >= len(text) or not (text[at - 1].isalnum() and text[at].isalnum())


def whole_stretch(item: str, masks: dict[str, int], text: str, a: int, b: int, budget: int) -> tuple[int, int]:
    """Least distance of an item to a stretch of whole words in ``text[a:b]``, and its end; above the budget if there is none.

    Where a stretch of any kind may end, whole or not, the item is compared backwards from there, so that each start's
    distance is known.
    """
    best, end, back = budget + 1, 0, None
    for j, score in enumerate(scores(masks, len(item), text[a:b])):
        e = a + j + 1
        if score >= best or not between_words(text, e):
            continue
        back = back or masks_of(item[::-1])
        low = max(0, e - len(item) - budget)
        for n, distance in enumerate(scores(back, len(item), text[low:e][::-1], True)):
            if distance < best and between_words(text, e - n - 1):
                best, end = distance, e
    return best, end


class Matcher:
    """Automaton of a block's pieces; built once in each worker."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, whole_words: bool = True):
        import ahocorasick

        self.items, self.rate, self.whole_words, self.masks = [], rate, whole_words, {}
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            clean = normalise(text)
            if not clean:
                continue
            for offset, piece in pieces_of(clean, rate):
                places.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, clean, int(rate * len(clean))))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of each item met in a text: the least distance, and where that stretch ends."""
        clean = normalise(text)
        best: dict[int, tuple[int, int]] = {}
        tried: dict[int, tuple[int, int]] = {}
        for last, (size, found) in () if self.empty else self.automaton.iter(clean):
            for k, offset in found:
                item_id, item, budget = self.items[k]
                if best.get(item_id, (1, 0))[0] == 0:
                    continue
                begin = last + 1 - size - offset
                end = begin + len(item)
                if begin >= 0 and clean.startswith(item, begin) and (not self.whole_words or between_words(clean, begin) and between_words(clean, end)):
                    best[item_id] = (0, end)
                    continue
                if not budget:
                    continue
                a, b = max(0, begin - budget), begin + len(item) + budget
                if k in tried and tried[k][0] <= a and b <= tried[k][1]:
                    continue  # a window read before holds this one
                if k not in self.masks:  # made where an item is first verified, as most never are
                    self.masks[k] = masks_of(item)
                if self.whole_words:
                    distance, end = whole_stretch(item, self.masks[k], clean, a, b, budget)
                else:
                    distance, end = myers(self.masks[k], len(item), clean[a:b])
                    end += a
                tried[k] = (a, b)
                if distance <= budget and distance < best.get(item_id, (budget + 1, 0))[0]:
                    best[item_id] = (distance, end)
        return sorted((i, d, e) for i, (d, e) in best.items())


def blocks_of(items: DataFrame, id_col: str, text: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of bounded size, one at a time. Null ids and texts are passed over, repeated rows are one."""
    rows = items.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t")).distinct()
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-size // block_chars))
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield sorted((r["i"], r["t"]) for r in block.collect())


def contamination(docs: DataFrame, items: list[tuple[int, str]], rate: float = RATE, text: str = "text", whole_words: bool = True) -> Column:
    """array(struct(item_id, distance, end)) of each row of ``docs``: the items of a block that its whole text holds.

    ``end`` counts characters of the normalised text. Null and empty texts hold none.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((items, rate, whole_words))  # at most BLOCK_CHARS characters
    own: dict = {}

    @F.pandas_udf("array<struct<item_id:long,distance:int,end:int>>")
    def of(texts: pd.Series) -> pd.Series:
        if "matcher" not in own:
            own["matcher"] = Matcher(*held.value)
        find = own["matcher"].find
        return pd.Series([[{"item_id": i, "distance": d, "end": e} for i, d, e in find(t)] for t in texts])

    return of(F.col(text))


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, whole_words: bool = True) -> DataFrame:
    """(doc_id, item_id, distance, end) of every document and benchmark item that it holds.

    Of several stretches the nearest counts, then the one found first. Repeated rows repeat, null ids too; null and empty texts and
    items hold nothing; very long texts are read whole; without documents or items there are no rows; other columns are not read.
    """
    out = None
    for items in blocks_of(benchmark, "item_id", "text"):
        part = docs.select("doc_id", F.explode(contamination(docs, items, rate, whole_words=whole_words)).alias("m")).select("doc_id", "m.item_id", "m.distance", "m.end")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; same columns.

    What one block leaves is written before the next, so that a worker never holds the automata of two.
    """
    for k, items in enumerate(blocks_of(benchmark, "item_id", "text", block_chars)):
        docs = materialize(docs, "uncontaminated") if k else docs
        docs = docs.where(F.size(contamination(docs, items, rate)) == 0)
    return docs


def op7_decontam(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items, over whole tables."""
    return find_contamination(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
