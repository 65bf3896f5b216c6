"""Layout of scraped articles: windows over an article's lines tidy headers, fields, blank lines and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fennwick.functions import cleaning as L
from fennwick.functions.text import strip

# Residue of rendering that is removed from lines, and lines that are nothing else.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
INVISIBLE = r"[​-‏‪-‮﻿]"
FOOTNOTE = r"\[\d+\]"
TEMPLATE = r"\{\{[^{}]{0,40}\}\}"
QUOTES = "^[\"“”‘’']+$"
WIDGET = "^(?:展开|折叠|待补充|（待补充）|暂无|来历)$"
PLAYER, PLAYER_CHARS = "宽屏模式|显示视频|点击展开|点击折叠", 20
DOUBLED = r"^(.{2,8})\1$"
#: Bytes of text whose lines one task sorts; long articles stay whole.
TASK_BYTES = 16 << 20


def undouble(value: Column) -> Column:
    """Half of a value that is the same 2 to 8 characters twice, spaces aside; any other as it is."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    return F.when(bare.rlike(DOUBLED), F.regexp_replace(bare, DOUBLED, "$1")).otherwise(value)


def tidy_lines(lines: DataFrame) -> DataFrame:
    """(doc, pos, line) of (doc, pos, raw): lines without residue, empty if blank, null if nothing but residue.

    A projection for each step, as a later one names the result of the one before it many times.
    """
    bare, whole = F.col("bare"), F.col("whole")
    marks = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("raw"), INVISIBLE, ""), FOOTNOTE, ""), TEMPLATE, "")
    out = lines.select("doc", "pos", strip(F.col("raw")).alias("raw")).select("doc", "pos", "raw", F.replace(marks, F.lit("\xa0"), F.lit(" ")).alias("bare"))
    edges = F.regexp_replace(F.regexp_replace(bare, r"(?U)^\s*(?:/\s*)+|(?:\s*/)+\s*$", ""), r"(?U)(?:\s*/\s*){2,}", " / ")
    out = out.select("doc", "pos", "raw", strip(F.when(bare.contains("/"), edges).otherwise(bare)).alias("bare"))
    gone = (bare == "") | bare.rlike(QUOTES) | bare.rlike(WIDGET) | bare.rlike(L.DECORATION) | bare.rlike(L.POINTER) | ((F.length(bare) <= PLAYER_CHARS) & bare.rlike(PLAYER))
    short = F.length(bare) <= 16
    out = out.select("doc", "pos", F.when(F.col("raw") == "", "").when(~gone, F.when(short, F.regexp_replace(bare, DOUBLED, "$1")).otherwise(bare)).alias("whole"))
    key = F.substring_index(whole, "：", 1)
    field = key.isin(*L.INFOBOX_KEYS) & whole.rlike("^[^：]{1,8}：.")
    value = F.regexp_replace(strip(F.regexp_replace(whole, "^[^：]*：", "")), r"(?U)^[-－—]\s*", "")
    return out.select("doc", "pos", F.when(field, F.concat(key, F.lit("："), undouble(value))).otherwise(whole).alias("line"))


def normalise_articles(articles: DataFrame) -> DataFrame:
    """(doc, text) of ``articles`` (doc, text), a row for each; ``doc`` must tell articles apart.

    Headers that share a line part. In 基本信息 a key line and the value lines after it become ``key：v v``, and blank
    lines go. A section of notes or links goes, and all that follows it until the next 【】. Headers without content
    before the next header of their level or above go. Runs of blank lines become one, repeats of the line before go.
    Null and empty texts give one line end. One shuffle, to as many tasks as the texts' bytes ask for: all windows run over
    an article at a time. The texts are read once more for their size.
    """
    split = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), L.MERGED_HEADERS, "$1\n"), LINE_ENDS)
    order = Window.partitionBy("doc").orderBy("pos")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    size = articles.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(articles.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    lines, line = tidy_lines(articles.select("doc", F.posexplode(split).alias("pos", "raw"))).repartition(tasks, "doc"), F.col("line")
    lines = lines.withColumn("level", L.header_level(line))
    opens = F.coalesce(F.col("level") <= 2, F.lit(False))
    lines = lines.withColumn("box", F.coalesce(F.last(F.when(F.col("level") == 1, L.header_text(line) == L.INFOBOX_SECTION), True).over(so_far), F.lit(False)))
    # Notes began at or after the last 【】, if there was one; the same window as above, so lines are not sorted anew.
    last_of = lambda c: F.last(F.when(c, F.col("pos")), True).over(so_far)
    notes = last_of(opens & L.header_text(line).rlike(L.BOILERPLATE_SECTION)) >= F.coalesce(last_of(F.col("level") == 1), F.lit(0))
    lines = lines.withColumn("notes", F.coalesce(notes, F.lit(False)))

    inside = F.col("box") & ~F.col("notes") & (line != "") & ~opens
    mark = F.when(opens, "end").when(inside & line.isin(*L.INFOBOX_TITLES), None).when(inside & line.isin(*L.INFOBOX_KEYS), "key").when(inside & line.contains("。"), "end")
    lines = lines.withColumn("mark", mark)
    lines = lines.withColumn("open", F.last("mark", True).over(so_far) == "key").withColumn("key_pos", F.last(F.when(F.col("mark") == "key", F.col("pos")), True).over(so_far))
    heading = inside & line.isin(*L.INFOBOX_TITLES)
    value = F.coalesce(F.col("open") & F.col("mark").isNull() & inside & ~heading, F.lit(False))
    shown = F.when(line == "", ~F.col("box")).otherwise(~F.col("notes") & ~heading)
    lines = lines.withColumn("value", value).withColumn("at", F.when(value, F.col("key_pos")).otherwise(F.col("pos")))
    lines = lines.withColumn("shown", F.coalesce(shown & ~F.col("value"), F.lit(False)))
    fields = lines.groupBy("doc", "at").agg(
        F.max(F.when(F.col("shown"), line)).alias("line"), F.max(F.when(F.col("shown"), F.col("level"))).alias("level"), F.max(F.col("mark") == "key").alias("key"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("value"), F.struct("pos", "line")))), lambda x: x["line"]), " ").alias("values"),
    ).withColumnRenamed("at", "pos")
    told = F.when(F.col("key") & (F.col("values") != ""), F.concat("line", F.lit("："), undouble(F.col("values")))).otherwise(line)
    fields = fields.select("doc", "pos", told.alias("line"), "level")

    last_shown = F.last("line", True).over(before)
    fields = fields.withColumn("line", F.when((line == "") & (F.coalesce(last_shown, F.lit("")) == ""), None).otherwise(line))
    kept = drop_empty_sections(fields)
    content = F.last(F.when(line != "", line), True).over(before)
    told_once = F.when((line == "") | ~line.eqNullSafe(content), line)
    out = kept.withColumn("line", told_once).groupBy("doc").agg(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("pos", "line")))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda x: x["line"]), "\n")
    return out.select("doc", F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit("\n")).alias("text"))


def drop_empty_sections(lines: DataFrame) -> DataFrame:
    """``lines`` (doc, pos, line, level) with null for each header that no content follows.

    Content is a line that is no header and not blank; it must come before the next header of the same level or above.
    Lines are read from the last to the first, so that every window grows by one row at a time.
    """
    after = Window.partitionBy("doc").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    content = F.last(F.when(F.col("level").isNull() & (F.col("line") != ""), F.col("pos")), True).over(after)
    found = lines.withColumn("_content", content)
    bound = F.lit(None).cast("int")
    for level in (1, 2, 3):
        found = found.withColumn(f"_{level}", F.last(F.when(F.col("level") <= level, F.col("pos")), True).over(after))
        bound = F.when(F.col("level") == level, F.col(f"_{level}")).otherwise(bound)
    empty = F.col("level").isNotNull() & (F.col("_content").isNull() | F.coalesce(bound < F.col("_content"), F.lit(False)))
    return found.withColumn("line", F.when(~empty, F.col("line"))).select("doc", "pos", "line", "level")
