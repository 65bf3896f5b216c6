"""Column functions that clean lines of articles and judge their content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fennwick.functions.text import strip

# Marks of layout, header brackets and residue of rendering.
DECORATION = r"^[ 　═━─–—―＝=﹏＿~＊*#·•●○■□▪▫▬▭▮▯║╔╗╚╝▓░▸►▶▷◆◇★☆✦✧┃│┌┐└┘├┤┬┴┼╭╮╯╰▁▂▃▄▅▆▇█|｜+＋]+$"
HEADERS = {1: r"^【([^【】]{1,30})】$", 2: r"^〔([^〔〕]{1,30})〕$", 3: r"^〖([^〖〗]{1,30})〗$"}
MERGED_HEADERS = r"([【〔〖][^【】〔〖〗]{1,30}[】〕〗])(?=[【〔〖][^【】〔〖〗]{1,30}[】〕〗])"
BOILERPLATE_SECTION = r"注释|外部链接|参考资料|参考链接|相关消歧义页"
STYLE_RULE = r"""\.[\w-]+(?:\s+[\w.:>\[\]"'-]+)*\s*\{[^{}]*\}"""
POINTER = r"^(?:主条目|另见|参见)[：:]|^.{0,4}见上文[。.]?$"
CAPTION = r"^(?:游戏|项目|作品)?图标[，,、]"
INFOBOX_SECTION = "基本信息"
INFOBOX_TITLES = ("基本资料", "基本信息", "资料")
INFOBOX_KEYS = (
    "本名 外文名 别名 别号 昵称 称号 头衔 原文名 罗马字 片假名 性别 年龄 种族 族群 种类 物种 发色 瞳色 外貌 特征 生日 忌日 出身地 出身地区 活动范围 常驻位置 所属 "
    "所属团体 所属组织 身份 职业 阵营 信仰 属性 命途 弱点 数值 配音 声优 演员 角色设计 作画 音乐 萌点 个人状态 相关人士 登场作品 登场 适龄提示 短信签名 座右铭 口头禅 "
    "全称 别称 简称 成立时间 总部 组织名称 组织种类 组织领导人 代表角色 种族名称 歌曲名 作曲 编曲 作词 演唱 收录专辑 出品 制作人 发行 发行商 发行日期 发行时间 "
    "原名 官方译名 常用译名 类型 平台 开发 开发商 引擎 模式 系列 分级 题材 玩家人数 相关作品 官网 画面 主角 监督 编剧 历法 货币"
).split()
CJK = r"[一-鿿]"


def unstyled(line: Column) -> Column:
    """A line without style rules."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, STYLE_RULE, ""), "、{2,}", "、"), "^[、 ]+|[、 ]+$", "")
    return F.when(line.rlike(STYLE_RULE), bare).otherwise(line)


def unmarked(text: Column) -> Column:
    """A line without references, badges, list marks and empty cells."""
    out = F.regexp_replace(text, "（参考：[^）]*）", "")
    out = F.regexp_replace(out, r"【[^】|]*\|[^】]*】", "")
    out = F.regexp_replace(out, r"[：:]\s*\*+\s*", "：")
    out = strip(F.regexp_replace(out, r"^\*+", ""))
    out = F.regexp_replace(out, r"([-▸▪◆●]\s*)[-－]\s*[：:]", "$1")
    out = F.regexp_replace(out, r"(?:\s*/\s*){2,}", " / ")
    out = F.regexp_replace(out, r"^\s*(?:/\s*)+|(?:\s*/)+\s*$", "")
    return F.regexp_replace(out, r"^(.{2,8})\1$", "$1")


def folded(text: Column, out: Column) -> Column:
    """``out`` with its repeats folded; empty if ``text``, what it was made of, only points elsewhere."""
    pairs = F.size(F.regexp_extract_all(out, F.lit(rf"({CJK}{{2}})\1"), F.lit(0)))
    single = out
    for _ in range(3):  # a fold halves a run, so three take runs of up to eight equal pairs
        single = F.regexp_replace(single, rf"({CJK}{{2}})\1", "$1")
    whole = F.regexp_replace(F.when(pairs >= 2, single).otherwise(out), r"([。，、；])\1+", "$1")
    return F.when(text.contains("详见「") | text.rlike(POINTER) | text.rlike(CAPTION), "").otherwise(strip(F.regexp_replace(whole, "[ 　]{2,}", " ")))


def clean_line(line: Column) -> Column:
    """A body line without residue of its rendering; lines that only point elsewhere become empty.

    Over a table, ``unstyled``, ``unmarked`` and ``folded`` in a projection each save repeated work.
    """
    text = unstyled(line)
    return folded(text, unmarked(text))


def header_level(line: Column) -> Column:
    out = F.lit(None).cast("int")
    for level, pattern in HEADERS.items():
        out = F.when(line.rlike(pattern), level).otherwise(out)
    return out


def header_text(line: Column) -> Column:
    return strip(F.regexp_replace(line, "^[【〔〖]|[】〕〗]$", ""))


def is_chapter_header(line: Column) -> Column:
    return (F.length(line) <= 60) & ~line.rlike("[。！？；]")


def readable(text: Column) -> Column:
    """Two or more CJK characters, kana or hangul, or three or more ASCII letters."""
    wide = F.length(F.regexp_replace(text, "[^぀-鿿가-힣]", ""))
    return (wide >= 2) | (F.length(F.regexp_replace(text, "[^A-Za-z]", "")) >= 3)


def low_value(text: Column, title: Column) -> Column:
    """Whether a one-line chunk is too short to hold anything, or a short line without CJK characters or sentence ends."""
    body = strip(text)
    short = F.length(body) < F.when(title.contains(" / "), 8).otherwise(12)
    stray = ~body.rlike(CJK) & (F.length(body) < 60) & ~body.rlike("[。！？；]")
    return ~body.contains("\n") & (short | stray)
