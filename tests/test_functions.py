"""Stated examples of the text functions, and random checks against plain statements of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from fennwick.functions import catalog as C
from fennwick.functions import cleaning as L
from fennwick.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def near_plainly(term, text, gap=6):
    """Each character is sought from the place after the last one's, at most ``gap`` places on."""
    at = [text.find(term[0])] if len(term) > 1 else [-1]
    for c in term[1:]:
        at.append(text.find(c, at[-1] + 1) if at[-1] >= 0 else -1)
    return min(at) >= 0 and all(b - a <= gap for a, b in zip(at, at[1:]))


def test_queries_are_read(spark):
    assert one(spark, T.clean_query(F.lit("崩铁是什么游戏"))) == "崩铁 游戏" and one(spark, T.clean_query(F.lit(" 是什么 "))) == "是什么"
    assert one(spark, T.query_phrases(F.lit("三月七 时装"))) == ["三月七", "时装"] and one(spark, T.query_phrases(F.lit("A，ab？ab 什么意思 谁"))) == ["ab", "什么意思"]
    assert one(spark, T.wants_overview(F.lit("崩铁是什么"))) and not one(spark, T.wants_overview(F.lit("崩铁")))
    near = lambda a, b: one(spark, T.near_in_order(F.lit(a), F.lit(b)))
    assert near("崩铁", "崩坏：星穹铁道") and near("星铁", "崩坏：星穹铁道") and not near("崩", "崩坏")


def test_near_in_order_random(spark):
    rnd = random.Random(4)
    pairs = [("".join(rnd.choices("abc", k=rnd.randint(1, 4))), "".join(rnd.choices("abcdefgh", k=rnd.randint(0, 25)))) for _ in range(400)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.near_in_order(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r["x"] == near_plainly(r["a"], r["b"]) for r in rows)


def test_dictionary_segmenter(spark):
    titles = spark.createDataFrame([("三月七 / 时装",), ("三月七 / 冬去煦至 / 2024",), ("abc / 这是一个超过了十二个字的小节标题",)], "title string")
    words = titles.select(F.explode(T.register_terms(F.col("title"))).alias("term")).distinct()
    assert {r["term"] for r in words.collect()} == {"三月七", "时装", "冬去煦至"}
    cut = T.dictionary_segmenter(words)
    got = spark.createDataFrame([("三月七的冬去煦至 ok2",), ("时装",), ("",), (None,)], "t string").select(cut(F.lower("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [["三月七", "三月", "月七", "的", "冬去煦至", "冬去", "去煦", "煦至", "ok2"], ["时装"], [], []]
    assert one(spark, T.tokenize(F.lit("三月七的时装"), True, cut)) == ["三月七", "三月", "月七", "时装"]
    with pytest.raises(ValueError):
        T.dictionary_segmenter(words, 2)


def test_shown_lines(spark):
    assert [one(spark, C.theme_of_source(F.lit(x))) for x in ("崩坏：星穹铁道知识库.txt", "a/原神 - 百科合集.md", "", None)] == ["崩坏：星穹铁道", "原神", "", ""]
    line = C.season_line(F.lit(2), F.lit("甲"), F.lit("2026-07-01"), F.lit(8.1), F.lit(0), F.lit("平台：TV"))
    assert one(spark, line) == "【2】甲（开播 2026-07-01 | 评分 8.1）\n平台：TV"
    assert one(spark, C.browse_head(F.lit(3), tag="科幻", year_from=2020, min_score=8)) == "按评分排序，符合条件（标签「科幻」、动画、2020 年起、评分 ≥8）的作品共 3 条："


@pytest.mark.parametrize("kept", ["身高：153cm", "血型：O型", "唱片公司：King Records", "原作：5pb."])
def test_strip_links_keeps(spark, kept):
    assert one(spark, T.strip_links(F.lit(kept))) == kept


def test_strip_links_drops(spark):
    assert one(spark, T.strip_links(F.lit("官网：https://a.example.com/x / 生日：1月1日 / Twitter(临时)：@x / 域：a.example.com"))) == "生日：1月1日"
    assert one(spark, T.strip_links(F.lit(None).cast("string"))) == ""


def test_truncation(spark):
    text = "甲" * 30 + "。" + "乙" * 40
    assert one(spark, T.truncate_at_sentence(F.lit(text), 50)) == "甲" * 30 + "。"
    assert one(spark, T.truncate_at_sentence(F.lit("短"), 50)) == "短"
    around = one(spark, T.truncate_around(F.lit("a" * 200 + "KEY" + "b" * 200), F.lit("key"), 60))
    assert "KEY" in around and around[0] == around[-1] == "…" and len(around) == 62


def test_tokenize(spark):
    assert one(spark, T.tokenize(F.lit("Hello, World 的 7"))) == ["hello", "world", "7"]
    assert one(spark, T.tokenize(F.lit(None).cast("string"))) == []
    assert one(spark, T.word_runs_and_bigrams(F.lit("三月七"))) == ["三月七", "三月", "月七"]


def test_lines(spark):
    clean = lambda s: one(spark, L.clean_line(F.lit(s)))
    assert clean(" / 生命值 635") == "生命值 635"
    assert clean("毁灭毁灭 巡猎巡猎") == "毁灭 巡猎"
    assert clean("考虑考虑再说") == "考虑考虑再说"
    assert clean("▸ -：登上星穹列车") == "▸ 登上星穹列车"
    assert clean("主条目：丰饶玄鹿") == ""
    assert one(spark, L.readable(F.lit("女女"))) and not one(spark, L.readable(F.lit("1 a")))


def test_infobox(spark):
    raw = "{{Infobox animanga/TVAnime\n|中文名= 某作\n|别名={\n[A]\n[B]\n}\n|空=\n}}"
    assert one(spark, C.infobox_text(F.lit(raw))) == "中文名：某作 / 别名：A、B"
    assert one(spark, C.alias_text(F.lit(raw))) == "某作、A、B"
    assert one(spark, C.chinese_name(F.lit(raw))) == "某作"
    assert one(spark, C.display_name(F.lit("n"), F.lit(""), F.lit(raw))) == "某作"


def test_dates_and_thresholds(spark):
    assert one(spark, C.parse_date(F.lit("2026-02-30"))) is None
    assert str(one(spark, C.parse_date(F.lit("2026-02-03 x")))) == "2026-02-03"
    need = lambda d: one(spark, C.year_requirement(F.lit(d).cast("date"), 10, 100, 2000, 2026))
    assert (need("2013-05-01"), need("1990-01-01"), need("2026-01-01"), need(None)) == (55, 100, 10, 10)
    new = lambda d, f: one(spark, C.is_new(F.lit(d).cast("date"), F.lit(f), "2026-01-01", 6))
    assert new("2025-12-01", 0) and not new("2020-01-01", 5) and new("2027-01-01", 1) and not new("2027-01-01", 0) and not new(None, 9)
    assert [C.quarter(2026, m, (2026, 1))[1] for m in (7, 8, 9, 13)] == [7, 7, 7, 10]
    assert one(spark, C.sum_values(F.expr("map('a', 2L, 'b', null)"))) == 2
    assert one(spark, C.season_extra(F.lit("类型：动画 / 发行日期：2026-01-01 / 平台：TV / 评分：8.1 / 标签：x、y"))) == "平台：TV / 标签：x、y"
