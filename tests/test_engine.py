"""Builds and searches over small literal sources."""

import datetime
import gzip
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from fennwick.functions import catalog as C
from fennwick.functions import text as T
from fennwick.operators import catalog as Q
from fennwick.operators import chunk_index as X
from fennwick.operators import chunking as K
from fennwick.operators import normalise as N
from fennwick.plans import catalog_build as E
from fennwick.plans import chunk_build as B
from fennwick.sources import dictionaries as D
from fennwick.sources import readers as R
from fennwick.sources.store import Store, StoreConflict
from fennwick.streaming.postings import stream_postings

ARTICLE = """三月七
【简介】【基本信息】
基本资料
性别
女
萌点
活泼、
粉发
发色
粉
这是一位开朗的少女角色。
【经历】
她醒来时被列车组所救，从此与大家同行，记下每一段旅程。
〔时装〕
冬去煦至（冰·存护）是她的一套时装外观。
〖短〗
很短的一节说明。
【外部链接】
〔更多〕
这里什么也不留下。
"""


def test_sections(spark):
    rows = K.parse_sections(spark.createDataFrame([(1, ARTICLE), (2, "没有任何标记的文章。"), (3, None)], "doc int, text string")).orderBy("seq").collect()
    got = {r["title"]: r["paragraphs"] for r in rows}
    assert got["三月七 / 基本信息"][:3] == ["性别：女", "萌点：活泼、、粉发", "发色：粉"] and "开朗" in got["三月七 / 基本信息"][3]
    assert got["三月七 / 经历 / 时装"][-1] == "短：很短的一节说明。"
    assert not any("外部链接" in t or "更多" in t for t in got) and {r["doc"] for r in rows} == {1}


RAW = """三月七
 / 生命值 635 / / 攻击
【基本信息】【基本信息】
基本资料
别名：- 小三小三
性别

女
萌点
活泼 活泼
这是一位少女。[1]
“”


正文，正文。
正文，正文。

正文，正文。
〔空〕
〖也空〗
【经历】
〖短〗
展开
宽屏模式显示视频
她{{UserName}}醒来。
【外部链接】
留不下

〔更多〕
也留不下
【末】
〔a〕

═══
"""
TIDY = """三月七
生命值 635 / 攻击
【基本信息】
别名：小三
性别：女
萌点：活泼
这是一位少女。
正文，正文。
【经历】
〖短〗
她醒来。
"""


def test_normalise_articles(spark):
    texts = [(1, RAW), (2, None), (3, ""), (4, "a\n\n\n b \nb\n\n"), (5, "【只有标题】"), (6, "【注释】\n x"), (7, "x\n" * 5 + "长" * 200_000)]
    got = {r["doc"]: r["text"] for r in N.normalise_articles(spark.createDataFrame(texts, "doc int, text string")).collect()}
    assert got[1] == TIDY and got[2] == got[3] == got[5] == got[6] == "\n" and got[4] == "a\n\nb\n" and len(got[7]) == 200_003
    assert N.normalise_articles(spark.createDataFrame([], "doc int, text string")).count() == 0
    again = N.normalise_articles(spark.createDataFrame([(1, TIDY)], "doc int, text string")).first()["text"]
    assert again == TIDY


def test_playable_names(spark):
    text = "主词条\n【登场角色】\n〔列车〕\n姬子 火智识\n哲\nCV：某人\n猫宫又奈物理强攻 / CV：某人\n星神 无名\n【经历】\n路人 火智识\n"
    names = K.playable_names(spark.createDataFrame([(1, text), (2, None)], "doc int, text string"))
    assert {r["allowed"] for r in names.collect()} == {"姬子", "哲", "猫宫又奈"}
    directory = spark.createDataFrame([(1, "姬子", "a", "x"), (2, "猫宫", "b", "y"), (3, "阿哈", "c", "z")], "doc int, name string, charms string, line string")
    assert {r["name"] for r in K.playable(directory, names).collect()} == {"姬子", "猫宫"}


def test_chunks(spark):
    sections = spark.createDataFrame([(1, 0, "t", ["甲" * 400 + "。", "乙" * 300 + "。", "丙" * 20]), (1, 1, "u", [("丁" * 99 + "。") * 15])], "doc int, seq int, title string, paragraphs array<string>")
    rows = K.chunk_sections(sections).orderBy("seq", "part").collect()
    assert [len(r["text"]) for r in rows] == [401, 301 + 1 + 20, 600, 600, 300]
    windows = K.chunk_windows(spark.createDataFrame([(n, "x" * n) for n in (1, 599, 600, 601, 1100, 1101, 2500)], "doc int, text string"))
    for n in (1, 599, 600, 601, 1100, 1101, 2500):
        starts, at = [0], 0
        while at + 600 < n:
            at += 500
            starts.append(at)
        assert [r["start"] for r in windows.where(F.col("doc") == n).orderBy("start").collect()] == starts


def test_chunk_index(spark, tmp_path):
    index = B.build_chunk_index(spark.createDataFrame([(1, ARTICLE), (2, ARTICLE.replace("三月七", "艾莲·乔").replace("活泼", "高冷"))], "doc int, text string"), theme="崩坏：星穹铁道", segmenter=T.word_runs_and_bigrams)
    index.save(str(tmp_path))
    index = X.ChunkIndex.load(spark, str(tmp_path))
    find = lambda q, **o: X.search(index, q, segmenter=T.word_runs_and_bigrams, as_of=datetime.date(2026, 1, 1), **o).collect()
    assert find("三月七 时装")[0]["title"] == "三月七 / 经历 / 时装"
    assert find("艾莲·乔")[0]["title"] == "艾莲·乔 / 基本信息"
    roster = find("崩铁 角色")
    assert len(roster) <= 2 and {r["title"].split(" / ")[1] for r in roster} <= {"登场角色一览", "角色萌点一览"}
    assert find("") == [] and find("什么") == [] and find("不存在的词条") == []
    assert [r["topic"] for r in X.topics(index.chunks).collect()]


def test_query_plans(spark):
    plan = X.plan_query(spark, "今年人气角色", [], as_of=datetime.date(2026, 1, 1))
    assert plan.flat == "2026年人气角色"
    fits = dict(zip(["崩坏：星穹铁道"], X.read_query(spark, "崩铁 星铁 三月七 角色", ["崩坏：星穹铁道"], T.word_runs)["fits"]))
    assert fits == {"崩坏：星穹铁道": ["崩铁", "星铁"]}
    assert X.theme_of(["崩铁", "星铁", "角色"], fits, lambda t: t == "角色") == "崩坏：星穹铁道"
    assert X.theme_of(["三月七", "角色"], fits, lambda t: t == "角色") is None
    assert X.plan_query(spark, "世萌 萌王是谁", []).pin == X.PIN_CROWN


def test_empty_build_raises(spark):
    with pytest.raises(ValueError):
        B.build_chunk_index(spark.createDataFrame([], "doc int, text string"))


def test_full_text_against_sqlite(spark):
    docs = [(1, "eren yeager", "the thread of titans"), (2, "armin", "eren and the thing then"), (3, "mikasa", "nothing here"), (4, "ereny", "the them their thread thread"), (5, "x", "eren eren the"), (6, "y", "z")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table fts using fts5(name, body, tokenize='unicode61')")
    db.executemany("insert into fts(rowid, name, body) values (?, ?, ?)", docs)
    want = {r[0]: -r[1] for r in db.execute("select rowid, bm25(fts, 8.0, 1.0) from fts where fts match '(eren OR eren*) AND (th OR th*)'")}
    found = Q.full_text(*Q.build_postings(spark.createDataFrame(docs, "doc_id long, name string, body string")), ["eren", "th"])
    got = {r["doc_id"]: r["relevance"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("dump"), str(tmp_path_factory.mktemp("catalog"))
    box = "{{Infobox\n|中文名= 甲作\n|简称= SAO\n}}"
    files = {
        "subject": [
            {"id": 1, "type": 2, "name": "A", "name_cn": "", "infobox": box, "platform": 1, "summary": " s ", "date": "2026-07-05", "score": 8.5, "rank": 3, "score_details": {"8": 500}, "favorite": {"done": 900}, "tags": [{"name": "科幻"}, {"name": ""}]},
            {"id": 2, "type": 2, "name": "B", "name_cn": "乙作", "infobox": "", "platform": 0, "summary": "", "date": "2026-02-30", "score": 0, "rank": 0, "score_details": {"8": 5, "9": None}, "favorite": {"done": 300}, "tags": []},
            {"id": 3, "type": 4, "name": "C", "name_cn": "丙作", "infobox": "", "platform": 7, "summary": "", "date": "1999-01-01", "score": 6, "rank": 9, "score_details": {"8": 50}, "favorite": {}, "tags": []},
            {"id": 4, "type": 2, "name": "", "name_cn": "", "infobox": "", "platform": 0, "summary": "", "date": "2026-07-01", "score": 9, "rank": 1, "score_details": {"8": 999}, "favorite": {}, "tags": []},
        ],
        "character": [{"id": 10, "name": "主", "infobox": "", "summary": ""}, {"id": 11, "name": "配", "infobox": "", "summary": ""}, {"id": 12, "name": "弃", "infobox": "", "summary": ""}],
        "person": [{"id": 20, "name": "导演", "infobox": "", "summary": "", "career": ["director"]}, {"id": 21, "name": "声", "infobox": "", "summary": "", "career": []}],
        "subject-characters": [{"subject_id": 1, "character_id": 11, "type": 2}, {"subject_id": 1, "character_id": 10, "type": 1}, {"subject_id": 3, "character_id": 12, "type": 1}, {"subject_id": 1, "character_id": 99, "type": 1}],
        "subject-persons": [{"subject_id": 1, "person_id": 20, "position": 2}, {"subject_id": 1, "person_id": 21, "position": 77}],
        "subject-relations": [{"subject_id": 1, "related_subject_id": 2, "relation_type": 1}],
        "person-characters": [{"person_id": 21, "subject_id": 1, "character_id": 10}],
        "person-relations": [{"person_id": 20, "related_person_id": 21, "relation_type": 5, "person_type": "prsn"}, {"person_id": 20, "related_person_id": 21, "relation_type": 6}],
        "episode": [{"id": 1, "subject_id": 1, "name": "e", "sort": 1}, {"id": 1, "subject_id": 1, "name": "f", "sort": "x"}, {"id": 2, "subject_id": 1, "name": "", "name_cn": ""}],
    }
    for name, rows in files.items():
        (folder / f"{name}.jsonlines").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n{bad\n")
    table = lambda rows: R.labels_table(spark, rows)
    dims = {"staff": table([(2, 2, "监督")]), "relation": table([(2, 1, "续集")]), "person_relation": table([(0, 5, "夫妻")]), "platform": table([(2, 1, "TV")])}
    dims["staff_priority"] = spark.createDataFrame([(2, 2, 100)], "kind int, code int, priority int")
    return E.build_catalog(spark, str(folder), out, E.BuildConfig("2026-08-01"), dims), str(folder)


def test_catalog_docs(catalog):
    rows = {(r["kind"], r["source_id"]): r for r in catalog[0].docs.collect()}
    assert set(rows) == {("subject", 1), ("subject", 2), ("character", 10), ("character", 11), ("person", 20), ("person", 21)}
    a, b = rows["subject", 1], rows["subject", 2]
    assert a["name_cn"] == "甲作" and a["ym"] == "2026-07" and a["relations"] == "角色：主、配 / 制作：导演（监督）、声 / 关联：乙作（续集）"
    assert a["extra"] == "类型：动画 / 发行日期：2026-07-05 / 平台：TV / 评分：8.5 / 排名：3 / 标签：科幻"
    assert (b["score"], b["rank"], b["platform"]) == (None, None, None)
    assert rows["character", 10]["relations"] == "登场：甲作（主角） / 声优：声" and rows["person", 20]["relations"] == "参与：甲作（监督） / 关系：声（夫妻）"
    assert sorted(r["rowid"] for r in rows.values()) == [1, 2, 3, 4, 5, 6] and a["rowid"] == 1


def test_catalog_queries(spark, catalog):
    c = catalog[0]
    assert c.search("SAO").first()["title"] == "条目#1 甲作" and c.search("乙作").first()["title"] == "条目#2 乙作"
    s = c.season(2026, 8).collect()
    assert [(r["source_id"], r["total"], r["start_month"]) for r in s] == [(1, 1, 7)] and s[0]["extra"].startswith("平台：TV")
    assert [r["title"] for r in c.browse(tag="科幻").collect()] == ["条目#1 甲作"] and c.browse(tag="科幻", min_score=9).collect() == []
    assert [r["title"] for r in c.browse(keyword="甲作", subject_type="anime", sort="nonsense").collect()][0] == "条目#1 甲作"
    with pytest.raises(ValueError):
        c.browse()
    assert {r["kind"]: (r["n"], r["source_date"]) for r in c.stats().collect()} == dict.fromkeys(("subject", "character", "person"), (2, R.newest_change(spark, catalog[1])))
    rest, missing = c.delete("subject:1, person:999, junk")
    assert missing == ["person:999"] and rest.docs.count() == 5 and rest.search("SAO").collect() == []
    assert [(r["id"], r["name"], r["sort"]) for r in R.read_episodes(spark, catalog[1]).collect()] == [(1, "f", 0.0)]
    with pytest.raises(Exception):
        R.read_jsonl(spark, catalog[1], "subject", strict=True).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("\ufeff三月七".encode())
    (tmp_path / "b.txt").write_bytes("艾莲".encode("gb18030"))
    assert [(r["stem"], r["text"]) for r in R.read_articles(spark, str(tmp_path)).orderBy("stem").collect()] == [("a", "三月七"), ("b", "艾莲")]
    body = {"format": 2, "engine_version": 1, "built_at": "x", "display_name": "主题", "chunks": [{"title": "t", "text": "u"}, {"title": "t", "text": " "}]}
    with gzip.open(tmp_path / "i.json.gz", "wt") as f:
        json.dump(body, f)
    (tmp_path / "j.json").write_text(json.dumps(body | {"format": 9}))
    rows, broken = R.read_index_files(spark, [str(tmp_path / "i.json.gz"), str(tmp_path / "j.json")])
    assert rows.count() == 1 and broken == [str(tmp_path / "j.json")]
    with pytest.raises(ValueError):
        R.read_index_file(spark, str(tmp_path / "j.json"))
    assert R.latest_build(rows).first()["built_at"] == "x" and R.newest_change(spark, str(tmp_path), "*.txt") and R.newest_change(spark, str(tmp_path), "*.none") == ""


LABELS = """define:
  types:
    anime: &ANIME
      1:
        en: "original"
        cn: "原作"
      2:
        cn: 无引号
      3:
        cn: " "
    other: &X
      4:
        cn: "不要"
staffs:
    anime: &ANIME
      9:
        cn: "段外"
presentation:
  *TYPE_ANIME :
    groups:
      source: [1, x, "29"]
      directors: [74, 2]
  *TYPE_OTHER :
    groups:
      source: [5]
"""
PLATFORMS = """platforms:
  types:
    anime:
      none: &PLATFORM_NONE 0
      tv: &PLATFORM_TV 1
      vr: &PLATFORM_VR 7
    game:
      games: &PLATFORM_GAMES 4001
defaults:
    anime:
      ova: &X 2
"""


def test_dictionaries(spark, tmp_path):
    lines = lambda text: D.outline(spark.createDataFrame([("x", text)], "doc string, text string"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(D.labels(lines(LABELS))) == [(2, 1, "原作")]
    assert rows(D.priorities(lines(LABELS))) == [(2, 1, 100), (2, 2, 201), (2, 29, 102), (2, 74, 200)]
    assert rows(D.platforms(lines(PLATFORMS))) == [(2, 1, "TV"), (2, 7, "VR"), (4, 4001, "游戏")]
    twice = 'define:\n  types:\n    anime: &A\n      1:\n        cn: "first"\n        cn: "second"\n      1:\n        cn: "last"\n      1:\n        cn: " "\n  x:\n    cn: "no"\n'
    assert rows(D.labels(lines(twice))) == [(2, 1, "last")] and rows(D.labels(lines(None))) == [] == rows(D.labels(lines("")))
    (tmp_path / "subject_staffs.yml").write_text(LABELS)
    dims = D.read_dictionaries(spark, str(tmp_path))
    assert dims["staff"].count() == 1 and dims["staff_priority"].count() == 4 and dims["platform"].collect() == []


def test_badly_typed_fields_keep_their_row(spark, tmp_path):
    lines = [
        '{"id": 1, "type": "2", "name": "a", "score": "7.5", "favorite": [], "tags": "x", "score_details": {"8": "5", "9": null, "10": "x"}}',
        '{"id": 2, "type": 2.0, "name": 5, "score": null, "rank": true, "favorite": {"done": 3}, "tags": [{"name": "t"}, 7, null, {"no": 1}]}', '{"id": "3", "platform": {}}', "{bad", "", "[1]",
    ]
    (tmp_path / "subject.jsonlines").write_text("\n".join(lines))
    rows = {r["id"]: r for r in R.read_jsonl(spark, str(tmp_path), "subject").collect()}
    assert set(rows) == {1, 2, 3} and (rows[1]["type"], rows[1]["score"], rows[2]["type"], rows[2]["name"], rows[2]["score"]) == (2, 7.5, 2, "5", None)
    assert rows[1]["score_details"] == {"8": 5, "9": None, "10": None} and rows[1]["favorite"] is None and rows[1]["tags"] is None and rows[2]["rank"] is None
    assert [t["name"] for t in rows[2]["tags"] if t["name"]] == ["t"] and rows[3]["platform"] is None
    assert R.bad_lines(spark, str(tmp_path), "subject").first()["n"] == 2
    both = R.read_jsonl(spark, f"{tmp_path}, {tmp_path}", "subject")
    assert both.count() == 6
    votes = {r["id"]: r["v"] for r in R.read_jsonl(spark, str(tmp_path), "subject").select("id", C.sum_values(F.col("score_details")).alias("v")).collect()}
    assert votes == {1: 5, 2: 0, 3: 0}


def test_articles_in_no_encoding(spark, tmp_path):
    before = spark.conf.get("spark.sql.legacy.codingErrorAction", None)
    (tmp_path / "u.txt").write_bytes("三月".encode() + b"\xff\xff!")
    (tmp_path / "g.txt").write_bytes("三月七，你好".encode("gb18030"))
    got = {r["stem"]: r["text"] for r in R.read_articles(spark, str(tmp_path)).collect()}
    assert got["g"] == "三月七，你好" and got["u"].startswith("三月") and "\ufffd" in got["u"] and got["u"].endswith("!")
    assert spark.conf.get("spark.sql.legacy.codingErrorAction", None) == before


def test_stored_catalog(spark, catalog, tmp_path):
    import shutil

    source, folder = catalog
    out = str(tmp_path / "c")
    shutil.copytree(source.path, out)
    assert R.available(spark, out) and not R.available(spark, str(tmp_path / "nothing"))
    stored = Q.Catalog.load(spark, out)
    row = stored.stats().where("kind = 'subject'").first()
    assert row["n"] == 2 and row["source_date"] and row["size_mb"] >= 0
    rest, missing = stored.delete("subject: 1, person:999, junk", write=True)
    again = Q.Catalog.load(spark, out)
    assert missing == ["person:999"] and again.docs.count() == 5 and again.search("SAO").collect() == [] and rest.docs.count() == 5
    assert [r["source_id"] for r in Q.Catalog.load(spark, out, 1).docs.where("kind = 'subject'").orderBy("source_id").collect()] == [1, 2]  # the version before is still there
    small = again.compact(1)
    assert small.docs.count() == 5 and small.version == 3 and len(small.postings.inputFiles()) == 1
    gone = Store(spark, out).vacuum()
    assert len(gone) == 5 and Q.Catalog.load(spark, out).docs.count() == 5 and Store(spark, out).versions() == [3]
    with pytest.raises(StoreConflict):
        again.compact()  # made from a version that is no longer the last
    built = E.build_catalog(spark, folder, str(tmp_path / "graph"), E.BuildConfig("2026-08-01", with_graph=True), {n: spark.createDataFrame([], "kind int, code int, label string") for n in ("staff", "relation", "person_relation", "platform")} | {"staff_priority": spark.createDataFrame([], "kind int, code int, priority int")})
    ends = lambda c: {tuple(r) for r in c.links.select("owner_kind", "owner_id", "target_kind", "target_id").collect()}
    assert {("subject", 1, "character", 10), ("person", 21, "character", 10)} <= ends(built) and not any(r[0] == "subject" and r[1] == 3 for r in ends(built))
    assert [(r["id"], r["name"], r["sort"]) for r in built.episodes.collect()] == [(1, "f", 0.0)]
    for less in (built.delete("subject:1")[0], built.delete("subject:1", write=True)[0], Q.Catalog.load(spark, str(tmp_path / "graph")).compact()):
        assert ("person", 21, "character", 10) in ends(less) and not any(("subject", 1) in (r[:2], r[2:]) for r in ends(less)) and less.episodes.collect() == []


def test_a_crash_leaves_the_version_before(spark, catalog, tmp_path, monkeypatch):
    import shutil

    out = str(tmp_path / "c")
    shutil.copytree(catalog[0].path, out)
    before = sorted(r["rowid"] for r in Q.Catalog.load(spark, out).docs.collect())
    write, written = Store.write, []

    def dies(self, name, rows, **options):
        if len(written) == 2:
            raise OSError("gone")
        written.append(name)
        return write(self, name, rows, **options)

    monkeypatch.setattr(Store, "write", dies)
    with pytest.raises(OSError):
        Q.Catalog.load(spark, out).compact()
    monkeypatch.undo()
    again = Q.Catalog.load(spark, out)
    assert len(written) == 2 and again.version == 1 and sorted(r["rowid"] for r in again.docs.collect()) == before
    assert again.compact().version == 2 and len(Store(spark, out).vacuum()) == 6


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "t", "eren thing"), (2, "t", "")], "chunk_id long, title string, text string").write.parquet(str(source))
    stream_postings(spark.readStream.schema("chunk_id long, title string, text string").parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    index = X.ChunkIndex.load(spark, str(tmp_path / "out"))
    assert {r["term"] for r in index.postings.collect()} == {"eren", "thing", "t"} and index.numbers["n"] == 1
