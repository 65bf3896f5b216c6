"""Segmentation by the most probable path through the graph of known words, without any Python in the tasks.

The edges of a run of characters are its pieces that a table of words and frequencies knows, found by a join of pieces with
the table, and its single characters. A fold over the places from the last to the first keeps the best sum of logarithms
from each place on and the length of its first word; a fold forward takes the words. Equal runs are one, wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennwick.functions.text import let
from fennwick.tables import materialize

#: What is cut by the graph, and what is a term as it stands.
HAN, PLAIN = r"[\x{4E00}-\x{9FFF}]+", r"[\p{L}\p{N}]+"
#: Characters of a known word at most; longer words are never met.
LONGEST = 16


def edges_of(runs: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(run, graph): for each place of a run its edges (len, weight, known), in order of places."""
    known = words.where("freq > 0 and term <> ''").groupBy(F.lower("term").alias("piece")).agg(F.sum("freq").alias("freq"))
    known = known.where(F.length("piece") <= longest)
    total = known.agg(F.coalesce(F.log(F.sum("freq").cast("double")), F.lit(0.0)).alias("total"))
    at = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    pieces = at.select("run", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("at") + 1))).alias("len")).select("run", "at", "len", F.expr("substring(run, at, len)").alias("piece"))
    met = pieces.join(known, "piece", "left").where("freq is not null or len = 1").crossJoin(F.broadcast(total))  # one row
    edge = F.struct("len", (F.log(F.coalesce("freq", F.lit(1)).cast("double")) - F.col("total")).alias("weight"), F.col("freq").isNotNull().alias("known"))
    places = met.groupBy("run", "at").agg(F.array_sort(F.collect_list(edge)).alias("edges"))  # ``longest`` edges at most
    return places.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "edges"))), lambda p: p["edges"]).alias("graph"))


def best_path(graph: Column) -> Column:
    """The length of the first word of the best path from each place; of equal paths that with the longer first word."""

    def back(acc: Column, edges: Column) -> Column:
        ways = F.transform(edges, lambda e: F.struct((e["weight"] + F.get(acc["sums"], e["len"] - 1)).alias("sum"), e["len"].alias("len")))
        return let(F.array_max(ways), lambda best: F.struct(F.concat(F.array(best["sum"]), acc["sums"]).alias("sums"), F.concat(F.array(best["len"]), acc["lens"]).alias("lens")))

    start = F.struct(F.array(F.lit(0.0)).alias("sums"), F.array().cast("array<int>").alias("lens"))
    return F.aggregate(F.reverse(graph), start, back, lambda acc: acc["lens"])


def words_along(run: Column, lens: Column, graph: Column, search: bool = True) -> Column:
    """The words of the best path; with ``search`` the known pairs and triples inside a longer word come before it."""

    def step(acc: Column, i: Column) -> Column:
        new = F.array(F.struct(i.alias("at"), F.get(lens, i - 1).alias("len")))
        return F.when(i == acc["next"], F.struct((i + F.get(lens, i - 1)).alias("next"), F.concat(acc["out"], new).alias("out"))).otherwise(acc)

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,len:int>>").alias("out"))
    taken = F.aggregate(F.sequence(F.lit(1), F.length(run)), start, step, lambda acc: acc["out"])

    def told(w: Column) -> Column:
        whole = F.array(F.substring(run, w["at"], w["len"]))
        if not search:
            return whole

        def inside(size: int) -> Column:
            starts = F.filter(F.sequence(w["at"], w["at"] + w["len"] - 1), lambda i: (i + size <= w["at"] + w["len"]) & F.exists(F.get(graph, i - 1), lambda e: e["known"] & (e["len"] == size)))
            return F.when(w["len"] > size, F.transform(starts, lambda i: F.substring(run, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

        return F.concat(inside(2), inside(3), whole)

    return F.flatten(F.transform(taken, told))


def segment(texts: DataFrame, words: DataFrame, pattern: str = HAN, search: bool = True, longest: int = LONGEST) -> DataFrame:
    """(id, terms) of ``texts`` (id, text) by ``words`` (term, freq): what ``pattern`` matches is cut by the graph, other
    runs of letters and digits are terms as they stand. Texts are lowered.

    A null or empty text has no terms; ids that come again give a row each time; words without a positive frequency are
    passed over, of a word that comes again the frequencies add up; no words at all leave single characters.
    """
    # Numbered by place in the input, so that equal ids stay apart; written, so that the numbers are the same when read twice.
    held = materialize(texts.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("t")).withColumn("_row", F.monotonically_increasing_id()), "word-graph-texts")
    parts = held.select("_row", F.posexplode(F.regexp_extract_all("t", F.lit(f"{pattern}|(?:(?!{pattern}){PLAIN[:-1]})+"), F.lit(0))).alias("k", "run"))
    cut = parts.withColumn("_cut", F.col("run").rlike(f"^{pattern}$"))
    graph = edges_of(cut.where("_cut").select("run").distinct(), words, longest)
    known = materialize(graph.select("run", words_along(F.col("run"), best_path(F.col("graph")), F.col("graph"), search).alias("words")), "word-graph-words")
    told = cut.where("_cut").join(known, "run").select("_row", "k", "words").unionAll(cut.where("not _cut").select("_row", "k", F.array("run").alias("words")))
    rows = told.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "words"))), lambda p: p["words"])).alias("terms"))  # one text's words
    return held.join(rows, "_row", "left").select("id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
