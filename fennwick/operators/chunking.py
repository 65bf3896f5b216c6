"""Articles to sections to chunks: windows over lines for headers and fields, folds for packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fennwick.functions import cleaning as L
from fennwick.functions.entities import unescape
from fennwick.functions.text import squeeze, strip

# Fixed values of the packing.
CHUNK, CHUNK_MOST, TAIL, OVERLAP = 600, 1200, 60, 100
TINY_SECTION = 60


def parse_sections(articles: DataFrame) -> DataFrame:
    """(doc, seq, title, paragraphs) of ``articles`` (doc, text).

    The first line with content is the chapter if it looks like a title; 【】, 〔〕 and 〖〗 lines open sections of three
    levels. In 基本信息 a key line and its value lines become ``key：v、v``. Sections of notes and links are dropped, and
    with them all that follows until the next 【】. A third-level section under 60 characters joins the one before it.
    Articles without such marks give no rows: ``chunk_windows`` is for them. Windows run over one article at a time.
    """
    split = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), L.MERGED_HEADERS, "$1\n"), r"\r\n|\r|\n")
    order = Window.partitionBy("doc").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = articles.where(F.col("text").rlike("[【〔〖]")).select("doc", F.posexplode(split).alias("pos", "raw")).withColumn("line", strip(F.col("raw")))
    lines = lines.withColumn("blank", F.col("line") == "").withColumn("deco", ~F.col("blank") & F.col("line").rlike(L.DECORATION))
    first = F.sum((~F.col("blank") & ~F.col("deco")).cast("int")).over(so_far)
    lines = lines.withColumn("chap", (first == 1) & ~F.col("blank") & ~F.col("deco") & L.is_chapter_header(F.col("line")))
    lines = lines.withColumn("level", F.when(F.col("chap") | F.col("blank") | F.col("deco"), F.lit(None)).otherwise(L.header_level(F.col("line"))))
    lines = lines.withColumn("name", F.when(F.col("level").isNotNull(), L.header_text(F.col("line"))))
    lines = lines.withColumn("seq", F.count("level").over(so_far)).withColumn("top", F.count(F.when(F.col("level") == 1, 1)).over(so_far))
    in_top = Window.partitionBy("doc", "top").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("chapter", F.last(F.when(F.col("chap"), F.col("line")), True).over(so_far))
    lines = lines.withColumn("section", F.last(F.when(F.col("level") == 1, F.col("name")), True).over(in_top))
    lines = lines.withColumn("sub_no", F.count(F.when(F.col("level") == 2, 1)).over(in_top))
    in_sub = Window.partitionBy("doc", "top", "sub_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("sub", F.last(F.when(F.col("level") == 2, F.col("name")), True).over(in_sub)).withColumn("term", F.last(F.when(F.col("level") == 3, F.col("name")), True).over(in_sub))
    lines = lines.withColumn("dropped", F.coalesce(F.max(F.col("name").rlike(L.BOILERPLATE_SECTION)).over(in_top), F.lit(False)))
    body = lines.where(~F.col("chap"))
    body = body.withColumn("marked", F.max(F.col("level").isNotNull()).over(Window.partitionBy("doc"))).where("marked")
    body = body.withColumn("plain", L.unstyled(F.col("line"))).withColumn("bare", L.unmarked(F.col("plain")))
    body = body.withColumn("text", F.when(F.col("level").isNull() & ~F.col("blank") & ~F.col("deco"), L.folded(F.col("plain"), F.col("bare"))))
    box = F.coalesce(F.col("section") == L.INFOBOX_SECTION, F.lit(False))
    mark = (
        F.when(F.col("level").isNotNull() | F.col("deco"), "end").when(box & F.col("text").isin(*L.INFOBOX_TITLES), "end").when(box & F.col("text").isin(*L.INFOBOX_KEYS), "key").when(box & F.col("text").contains("。"), "end")
    )
    body = body.withColumn("mark", mark).withColumn("state", F.last("mark", True).over(so_far))
    is_value = (F.col("state") == "key") & F.col("mark").isNull() & (F.coalesce("text", F.lit("")) != "")
    breaks = F.col("mark").isNotNull() | (F.col("blank") & (F.coalesce("state", F.lit("end")) != "key"))
    body = body.withColumn("value", F.coalesce(is_value, F.lit(False))).withColumn("para", F.sum(breaks.cast("int")).over(so_far))
    keep = (F.col("text") != "") & ~F.col("dropped") & ~(box & F.col("text").isin(*L.INFOBOX_TITLES)) & (F.col("value") | (F.coalesce(F.col("mark"), F.lit("")) == "key") | L.readable(F.col("text")))
    parts = body.where(keep).groupBy("doc", "seq", "para").agg(
        F.max("chapter").alias("chapter"), F.max("section").alias("section"), F.max("sub").alias("sub"), F.max("term").alias("term"),
        F.max(F.when(F.col("mark") == "key", F.col("text"))).alias("key"),
        F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.col("mark"), F.lit("")) != "key", F.struct("pos", "text")))), lambda x: x["text"]).alias("lines"),
    )
    text = F.when(F.col("key").isNotNull(), F.concat(F.col("key"), F.lit("："), F.array_join("lines", "、"))).otherwise(F.array_join("lines", "\n"))
    sections = parts.withColumn("p", text).groupBy("doc", "seq").agg(
        F.first("chapter").alias("chapter"), F.first("section").alias("section"), F.first("sub").alias("sub"), F.first("term").alias("term"),
        F.transform(F.array_sort(F.collect_list(F.struct("para", "p"))), lambda x: x["p"]).alias("paragraphs"),
    )
    full = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    title = F.concat_ws(" / ", full("chapter"), full("section"), full("sub"), full("term"))
    size = F.aggregate("paragraphs", F.lit(0), lambda a, p: a + F.length(p))
    by_doc = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    small = F.col("term").isNotNull() & (size < TINY_SECTION)
    homed = sections.withColumn("title", F.when(title == "", "前言").otherwise(title)).withColumn("small", small)
    homed = homed.withColumn("home", F.coalesce(F.last(F.when(~F.col("small"), F.col("seq")), True).over(by_doc), F.first("seq").over(by_doc)))
    joins = F.col("home") != F.col("seq")
    told = F.when(joins, F.transform("paragraphs", lambda p, i: F.when(i == 0, F.concat(F.col("term"), F.lit("："), p)).otherwise(p))).otherwise(F.col("paragraphs"))
    marked = homed.withColumn("told", told)
    merged = marked.groupBy("doc", "home").agg(F.min_by("title", "seq").alias("title"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "told"))), lambda x: x["told"])).alias("paragraphs"), F.max(F.col("seq")).alias("last"))
    return merged.select("doc", F.col("home").alias("seq"), "title", "paragraphs")


def split_paragraph(text: Column, size: int = CHUNK) -> Column:
    """Pieces of a long paragraph: whole sentences packed up to ``size``, longer sentences cut hard."""
    sentences = F.regexp_extract_all(text, F.lit("[^。！？；\n]+[。！？；\n]?"), F.lit(0))
    cut = F.flatten(F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int")), lambda i: F.substring(s, i * size + 1, F.lit(size)))))
    return pack_pieces(cut, size, "")


def pack_pieces(pieces: Column, size: int, glue: str) -> Column:
    """Pieces in order, joined by ``glue`` as long as they stay within ``size``."""
    zero = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["cur"] == "") | (F.length(acc["cur"]) + len(glue) + F.length(p) <= size)
        joined = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit(glue), p))
        return F.struct(F.when(fits, joined).otherwise(p).alias("cur"), F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))).alias("out"))

    return F.aggregate(pieces, zero, step, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))


def chunk_sections(sections: DataFrame, size: int = CHUNK) -> DataFrame:
    """(doc, seq, part, title, text): paragraphs of a section packed to ``size``; a short tail joins the chunk before it."""
    pieces = F.flatten(F.transform("paragraphs", lambda p: F.when(F.length(p) > CHUNK_MOST, split_paragraph(p, size)).otherwise(F.array(p))))
    packed = sections.withColumn("c", pack_pieces(pieces, size, "\n"))
    n = F.size("c")
    last, before = F.get("c", n - 1), F.get("c", n - 2)
    merge = (n >= 2) & (F.length(last) < TAIL) & (F.length(before) + 1 + F.length(last) <= CHUNK_MOST)
    tail = F.when(merge, F.concat(F.slice("c", F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(F.concat(before, F.lit("\n"), last)))).otherwise(F.col("c"))
    return packed.select("doc", "seq", F.posexplode(tail).alias("part", "text"), "title").select("doc", "seq", "part", "title", "text")


def chunk_windows(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc, start, text): windows over the text with runs of blank lines squeezed; blank windows are dropped."""
    step = size - overlap
    squeezed = docs.select("doc", strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"\n{3,}", "\n\n")).alias("t")).where("t <> ''")
    # A text becomes blocks of one step each, once; a window is a block and the beginning of what follows, so that no window
    # is counted off from the start of the text and none carries it whole.
    blocks = squeezed.select("doc", F.length("t").alias("n"), F.regexp_extract_all("t", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("b"))
    more = -(-overlap // step)

    def window(b: Column) -> Column:
        return F.transform(b, lambda _, i: F.struct((i * step).cast("int").alias("start"), F.substring(F.array_join(F.slice(b, i + 1, F.lit(1 + more)), ""), 1, size).alias("w")))

    held = F.get(F.transform(F.array("b"), window), F.lit(0))  # the blocks are looked up in one place
    windows = blocks.select("doc", "n", F.explode(held).alias("x")).where((F.col("x.start") == 0) | (F.col("x.start") + overlap < F.col("n")))
    return windows.select("doc", F.col("x.start").alias("start"), strip(F.col("x.w")).alias("text")).where("text <> ''")


def first_of_equal(rows: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """One row of each text, white space aside: the first in order. A partial aggregate, so hot texts don't meet in one task."""
    cols = rows.columns
    rest = F.struct(*order, *[c for c in cols if c not in order])
    return rows.groupBy(F.md5(squeeze(F.col(text))).alias("_key")).agg(F.min(rest).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in cols])


def character_directory(sections: DataFrame) -> DataFrame:
    """(doc, name, line): each character page's name with its charm points, hair and eyes."""
    parts = F.split("title", " / ")
    info = sections.where(F.element_at(parts, -1) == L.INFOBOX_SECTION).select("doc", "seq", parts[0].alias("name"), F.explode("paragraphs").alias("p")).select("doc", "seq", "name", F.explode(F.split("p", "\n")).alias("line"))
    found = lambda key: F.max(F.when(F.col("line").startswith(f"{key}："), strip(F.regexp_replace("line", f"^{key}：", "")))).alias(key)
    rows = info.groupBy("doc").agg(F.min_by("name", "seq").alias("name"), found("萌点"), found("发色"), found("瞳色")).where("name <> '' and `萌点` <> ''")
    look = F.when(F.coalesce("发色", F.lit("")).eqNullSafe("") & F.coalesce("瞳色", F.lit("")).eqNullSafe(""), "").otherwise(F.concat(F.lit("（"), F.coalesce("发色", F.lit("")), F.lit("·"), F.coalesce("瞳色", F.lit("")), F.lit("）")))
    return rows.select("doc", "name", F.col("萌点").alias("charms"), F.concat("name", F.lit("："), "萌点", look).alias("line"))


# Elements and paths that follow a character's name in a roster.
ROSTER_SECTION = "【登场角色】"
ELEMENTS_FIRST = "物理|火|冰|雷|风|量子|虚数"
ELEMENTS = "物理|火|冰|雷|风|量子|虚数|以太|烈霜|霜烈|电|玄炎"
PATHS_LATE = "强攻|击破|异常|防护|支援"
PATHS = "毁灭|巡猎|智识|同谐|虚无|存护|记忆|欢愉|强攻|击破|异常|防护|支援"


def playable_names(articles: DataFrame) -> DataFrame:
    """Distinct (allowed) names in the roster sections of ``articles`` (doc, text).

    A line names a character if an element follows after a space, if the next line begins with ``CV：``, or if
    ``/ CV：`` and a path follow on the line itself. Lines that begin with 〔 or CV name none.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    lines = articles.select("doc", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("pos", "raw")).withColumn("line", strip(F.col("raw")))
    lines = lines.withColumn("next", F.coalesce(F.lead("line").over(order), F.lit("")))
    section = F.last(F.when(F.col("line").startswith("【"), F.col("line")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    line = F.col("line")
    rows = lines.withColumn("section", section).where((F.col("section") == ROSTER_SECTION) & ~line.rlike("^(?:【|〔|CV)") & (line != ""))
    spaced = F.regexp_extract(line, rf"^(\S{{1,12}}) (?:{ELEMENTS_FIRST})", 1)
    alone = strip(F.regexp_replace(line, rf"(?:{ELEMENTS})?(?:{PATHS})$", ""))
    beside = F.regexp_extract(line, rf"^(\S{{1,20}}?)(?:{ELEMENTS})?(?:{PATHS_LATE}) / CV：", 1)
    name = F.when(spaced != "", spaced).when(F.col("next").startswith("CV："), alone).otherwise(beside)
    return rows.select(unescape(name).alias("allowed")).where("allowed <> ''").distinct()


#: Base of the hashes of pieces, modulo 2**64.
PIECE_BASE = 0x9E3779B97F4A7C15


def piece_hashes(names: DataFrame, lengths: list[int]) -> DataFrame:
    """(name, size, hash) of the pieces of ``names`` that have one of the ``lengths``; a piece that comes again is one row.

    A hash is a polynomial in the code points, so that all pieces of a length come from prefix sums: a name of n code points
    costs n steps for each length, however long the pieces are.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                points = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
                n = len(points)
                powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, PIECE_BASE, np.uint64)]), dtype=np.uint64)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(points * powers[:n], dtype=np.uint64)])
                found = {size: np.unique((sums[size:] - sums[: n + 1 - size]) * powers[n - np.arange(n + 1 - size)]) for size in lengths if size <= n}
                # Brought to one power, so that a piece has the same hash wherever it stands; the power depends on the name.
                back = pow(PIECE_BASE, -n, 1 << 64)
                for size, hashes in found.items():
                    hashes = (hashes * np.uint64(back)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(hashes), pa.string()), pa.array(np.full(len(hashes), size, np.int32)), pa.array(hashes)], names=["name", "size", "hash"])

    return names.select("name").mapInArrow(cut, "name string, size int, hash long")


def playable(directory: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose name is, holds or is held by an allowed name.

    Each side's names give the hashes of their pieces, but only of the lengths that names of the other side have; pieces and
    names are joined by hash and length, and each pair that meets is verified. No list is sent to all tasks, and no pair
    is tried in vain. Null and empty names are never kept; a row that is there twice is kept twice.
    """
    short = lambda d, c: d.where(F.col(c).isNotNull() & (F.col(c) != "")).select(F.col(c).alias("name")).distinct()
    names, goods = short(directory, "name"), short(allowed, "allowed")
    sizes = lambda d: sorted(r["n"] for r in d.select(F.length("name").alias("n")).distinct().collect())  # noqa: E731  as many as there are lengths

    def holding(whole: DataFrame, parts: DataFrame) -> DataFrame:
        """(whole, part): names of one side that hold one of the other."""
        lengths = sizes(parts)
        ends = piece_hashes(parts, lengths).where(F.col("size") == F.length("name")).withColumnRenamed("name", "part")
        met = piece_hashes(whole, lengths).withColumnRenamed("name", "whole").join(ends, ["size", "hash"])
        return met.where(F.col("whole").contains(F.col("part"))).select("whole", "part")

    kept = holding(names, goods).select(F.col("whole").alias("name")).union(holding(goods, names).select("part")).distinct()
    return directory.join(kept, "name", "left_semi").select(*directory.columns)


def directory_chunks(directory: DataFrame, theme: str, edits: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(title, text) of a theme's roster and charm points, newest pages first; none for less than two characters."""
    dated = directory.join(edits, "doc", "left") if edits is not None else directory.withColumn("lastmod", F.lit(""))
    rows = F.sort_array(F.collect_list(F.struct(F.coalesce("lastmod", F.lit("")).alias("d"), (-F.col("doc").cast("double")).alias("o"), "name", "line")), asc=False)
    one = dated.agg(rows.alias("r")).where(F.size("r") >= 2)  # one theme's characters
    tags = directory.select(F.explode(F.split("charms", "、")).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag").limit(most).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "tag"))), lambda x: x["tag"]), "、").alias("tags"))
    both = one.crossJoin(tags)  # one row each
    roster = both.select(F.lit(f"{theme} / 登场角色一览").alias("title"), F.array_join(F.transform("r", lambda x: x["name"]), "、").alias("text"))
    charms = both.select(F.lit(f"{theme} / 角色萌点一览").alias("title"), F.concat(F.lit("常见萌点："), "tags", F.lit("\n"), F.array_join(F.slice(F.transform("r", lambda x: x["line"]), 1, most), "\n")).alias("text"))
    return roster.unionByName(charms)
