"""Column functions of the catalog: infobox fields, names, dates, thresholds and display lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fennwick.functions.text import strip

# Infobox keys whose values are names, besides keys that end in 名.
NAME_KEYS = ("罗马字", "罗马音", "原名", "简称", "缩写", "俗称", "通称", "别称")
CHINESE_NAME_KEYS = ("简体中文名", "中文名")
KIND_LABELS = {"subject": "条目", "character": "角色", "person": "人物"}
SUBJECT_TYPES = {"book": 1, "anime": 2, "music": 3, "game": 4, "real": 6}
TYPE_LABELS = {1: "书籍", 2: "动画", 3: "音乐", 4: "游戏", 6: "三次元"}
GAME = 4
DATE_LABEL = "发行日期："
GENERIC_NAMES = "知识库|资料库|百科|合集|大全"


def theme_of_source(name: Column) -> Column:
    """The theme that a source file's name gives: its stem without generic words and the marks around them."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(strip(stem), GENERIC_NAMES, ""), "^[ \\-_、，]+|[ \\-_、，]+$", "")


def season_line(order: Column, name: Column, date: Column, score: Column, favorite: Column, extra: Column) -> Column:
    """An entry of a season's list: its place and name with date, score and favorites, then its other parts; empty ones are left out."""
    part = lambda label, c, there: F.when(there, F.concat(F.lit(f"{label} "), c.cast("string")))
    meta = F.concat_ws(" | ", part("开播", date, F.coalesce(date, F.lit("")) != ""), part("评分", score, score > 0), part("追番", favorite, favorite > 0))
    head = F.concat(F.lit("【"), order.cast("string"), F.lit("】"), name, F.lit("（"), meta, F.lit("）"))
    return F.concat_ws("\n", head, F.nullif(F.coalesce(extra, F.lit("")), F.lit("")))


def browse_head(count: Column, tag: str = "", keyword: str = "", kind: str = "动画", year_from: int = 0, min_score: float = 0, sort: str = "score") -> Column:
    """The line above a list of works: what it is sorted by and the conditions that were set."""
    by = {"score": "评分", "favorite": "追番人数", "date": "开播时间"}.get(sort, "评分")
    set_to = [f"标签「{tag}」" if tag else "", f"关键词「{keyword}」" if keyword else "", kind, f"{year_from} 年起" if year_from else "", f"评分 ≥{min_score}" if min_score else ""]
    named = "、".join(filter(None, set_to))
    return F.concat(F.lit(f"按{by}排序，符合条件（{named}）的作品共 "), count.cast("string"), F.lit(" 条："))


def browse_line(order: Column, title: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("【"), order.cast("string"), F.lit("】"), title), text)


def sum_values(counts: Column) -> Column:
    """Sum of a map's values; null maps and values count as nothing."""
    return F.coalesce(F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v.cast("long"), F.lit(0))), F.lit(0).cast("long"))


def infobox_fields(raw: Column) -> Column:
    """array(struct(k, v)) of a wiki infobox: ``|key=value`` blocks, lines of a value joined by 、, brackets removed."""
    body = F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"^\{\{[^\n]*\n?", "")
    body = F.regexp_replace(body, r"(?U)[}\s]+$", "")
    bare = lambda x: strip(F.regexp_replace(x, r"[{}\[\]]", ""))
    blocks = F.filter(F.slice(F.split(body, r"\|"), 2, 1 << 20), lambda b: b.contains("="))

    def pair(b: Column) -> Column:
        lines = F.transform(F.split(F.regexp_replace(b, "(?s)^[^=]*=", ""), r"\r?\n"), bare)
        return F.struct(bare(F.substring_index(b, "=", 1)).alias("k"), F.array_join(F.filter(lines, lambda x: x != ""), "、").alias("v"))

    return F.filter(F.transform(blocks, pair), lambda p: (p["k"] != "") & (p["v"] != ""))


def infobox_text(raw: Column) -> Column:
    return F.array_join(F.transform(infobox_fields(raw), lambda p: F.concat(p["k"], F.lit("："), p["v"])), " / ")


def alias_text(raw: Column) -> Column:
    names = F.filter(infobox_fields(raw), lambda p: p["k"].endswith("名") | p["k"].isin(*NAME_KEYS))
    return F.array_join(F.transform(names, lambda p: p["v"]), "、")


def chinese_name(raw: Column) -> Column:
    """The value of the first of the Chinese name keys that has one, else the empty string."""
    found = [F.nullif(strip(F.regexp_extract(F.coalesce(raw, F.lit("")), rf"{k}\s*=[ \t]*([^\r\n|}}]*)", 1)), F.lit("")) for k in CHINESE_NAME_KEYS]
    return F.coalesce(*found, F.lit(""))


def display_name(name: Column, name_cn: Column, infobox: Column) -> Column:
    full = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(full(name_cn), full(chinese_name(infobox)), full(name), F.lit(""))


def search_name(name: Column, display: Column) -> Column:
    name = strip(F.coalesce(name, F.lit("")))
    return F.when((name != "") & (name != display), F.concat_ws(" ", display, name)).otherwise(display)


def parse_date(value: Column) -> Column:
    """A date of the form YYYY-MM-DD at the start of a string; anything else, and dates that don't exist, are null."""
    head = F.substring(value, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def year_requirement(date: Column, base: int, oldest: int, oldest_year: int, this_year: int) -> Column:
    """A threshold that falls from ``oldest`` in ``oldest_year`` to ``base`` this year, rounded half to even."""
    year = F.year(date)
    line = F.bround(oldest - (oldest - base) * ((year - oldest_year) / (this_year - oldest_year)), 0).cast("long") if this_year > oldest_year else F.lit(base)
    return F.when(date.isNull(), base).when(year <= oldest_year, oldest).when(year >= this_year, base).otherwise(line)


def is_new(date: Column, favorites: Column, today: str, new_months: int, horizon_days: int = 1095) -> Column:
    """Out within ``new_months`` times 30 days, or announced for the next ``horizon_days`` and wanted by someone."""
    now = F.lit(today).cast("date")
    ahead = (date <= F.date_add(now, horizon_days)) & (favorites > 0)
    return F.coalesce(F.when(date > now, ahead).otherwise(date >= F.date_sub(now, 30 * new_months)), F.lit(False))


def tags_text(tags: Column) -> Column:
    names = F.transform(F.coalesce(tags, F.array().cast("array<struct<name:string>>")), lambda t: strip(F.coalesce(t["name"], F.lit(""))))
    return F.array_join(F.filter(names, lambda n: n != ""), "、")


def extra_text(kind: Column, type_label: Column, date: Column, platform: Column, subject_type: Column, score: Column, rank: Column, tags: Column, career: Column) -> Column:
    """The line of optional parts of an entry, joined by slashes; games have no platform, persons have careers."""
    full = lambda c: F.nullif(c, F.lit(""))
    works = F.concat_ws(
        " / ",
        full(F.when(type_label.isNotNull(), F.concat(F.lit("类型："), type_label))),
        full(F.when(F.coalesce(date, F.lit("")) != "", F.concat(F.lit(DATE_LABEL), date))),
        full(F.when((subject_type != GAME) & (F.coalesce(platform, F.lit("")) != ""), F.concat(F.lit("平台："), platform))),
        full(F.when(score > 0, F.concat(F.lit("评分："), score.cast("string")))),
        full(F.when(rank > 0, F.concat(F.lit("排名："), rank.cast("string")))),
        full(F.when(tags != "", F.concat(F.lit("标签："), tags))),
    )
    people = F.when(F.size(F.coalesce(career, F.array().cast("array<string>"))) > 0, F.concat(F.lit("职业："), F.array_join(career, "、"))).otherwise("")
    return F.when(kind == "subject", works).when(kind == "person", people).otherwise("")


def season_extra(extra: Column, limit: int = 120) -> Column:
    """An entry's line without its leading type and date and its first score."""
    out = F.regexp_replace(F.coalesce(extra, F.lit("")), r"^类型：[^/]*/?\s*", "")
    out = F.regexp_replace(out, rf"^{DATE_LABEL}[^/]*/?\s*", "")
    return F.substring(F.regexp_replace(out, r"^(.*?)评分：[^/]*/?\s*", "$1"), 1, limit)


def compose(limit: int, *parts: Column) -> Column:
    """Parts that aren't empty, one a line; what is longer than ``limit`` is cut and marked."""
    text = F.concat_ws("\n", *[F.nullif(F.coalesce(p, F.lit("")), F.lit("")) for p in parts])
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(F.substring(text, 1, limit), r"(?U)\s+$", ""), F.lit("…"))).otherwise(text)


def result_title(kind: Column, source_id: Column, name: Column) -> Column:
    label = F.coalesce(F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair])[kind], kind)
    return F.concat(label, F.lit("#"), source_id.cast("string"), F.lit(" "), name)


def quarter(year: int, month: int, today: tuple[int, int]) -> tuple[int, int, list[str]]:
    """(year, first month, its three YYYY-MM) of the season that holds a month; zeros mean today."""
    year = min(2100, max(1900, year or today[0]))
    first = (min(12, max(1, month or today[1])) - 1) // 3 * 3 + 1
    return year, first, [f"{year:04d}-{m:02d}" for m in range(first, first + 3)]
