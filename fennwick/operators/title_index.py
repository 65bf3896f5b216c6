"""A dictionary of distinct titles, and the titles that hold a character or two characters near each other in order.

Whether a term's characters can follow each other in any title, which titles a pin names and whether there is a profile of
a name are looked up here; no chunk's title is read for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fennwick.functions import text as T

SEPARATORS = r"(?U)[\s·・\-—]+"


def title_table(chunks: DataFrame) -> DataFrame:
    """(title, hash, name, section, first_id, last_id, n) of the distinct titles of ``chunks`` (chunk_id, title).

    ``name`` is the first part without separators, ``section`` the second part. The ids bound where a title's chunks lie.
    """
    parts = F.split("title", " / ")
    found = chunks.groupBy("title").agg(F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"), F.count("*").alias("n"))
    return found.select("title", F.xxhash64("title").alias("hash"), F.regexp_replace(parts[0], SEPARATORS, "").alias("name"), F.get(parts, F.lit(1)).alias("section"), "first_id", "last_id", "n")


def gram_table(titles: DataFrame, gap: int = T.GAP) -> DataFrame:
    """(gram, hash): each title's characters, and its pairs of characters at most ``gap`` places apart in order."""
    n = F.length("title")
    one = lambda i: F.substring(F.col("title"), i, F.lit(1))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array(one(i)), F.transform(F.filter(F.sequence(i + 1, i + gap), lambda j: j <= n), lambda j: F.concat(one(i), one(j))))))
    return titles.where(n > 0).select("hash", F.explode(F.array_distinct(grams)).alias("gram"))


def pairs_of(word: str) -> list[str]:
    return sorted({word[i : i + 2] for i in range(len(word) - 1)})


def holding(grams: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """(key, hash): the titles that hold all grams of a key of ``wanted``; few keys of one query."""
    wanted = {key: sorted(set(gs)) for key, gs in wanted.items() if gs}
    if not wanted:
        return grams.select(F.lit("").alias("key"), "hash").where("false")
    every = sorted({g for gs in wanted.values() for g in gs})
    met = grams.where(F.expr(f"gram IN ({T.quoted(every)})")).groupBy("hash").agg(F.collect_set("gram").alias("met"))  # of the query's grams
    keys = ", ".join(f"IF(size(array_intersect(met, array({T.quoted(gs)}))) = {len(gs)}, {T.quoted([key])}, NULL)" for key, gs in wanted.items())
    return met.select("hash", F.explode(F.expr(f"filter(array({keys}), k -> k IS NOT NULL)")).alias("key")).select("key", "hash")


def pinned_titles(titles: DataFrame, grams: DataFrame, pin: str, theme: str | None) -> DataFrame:
    """(title, first_id, last_id) of the titles that a pin's words, parted by ``|``, stand in, and the theme, if any."""
    found = holding(grams, {word: pairs_of(word) for word in pin.split("|")}).select("hash").distinct()
    fits = F.col("title").rlike(pin)
    if theme:
        fits = fits & T.squeeze(F.lower("title")).contains(theme)
    return titles.join(found, "hash", "left_semi").where(fits).select("title", "first_id", "last_id")


def profile_titles(titles: DataFrame, name: str, section: str) -> DataFrame:
    """(title, first_id, last_id) of the titles whose first part is ``name``, separators aside, and whose second is ``section``."""
    return titles.where((F.col("name") == name) & (F.col("section") == section)).select("title", "first_id", "last_id")
