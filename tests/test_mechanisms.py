"""Entities, pieces of names, places of lines, index heads: against plain statements of each."""

import gzip
import html
import json
import random
import time
from html.entities import html5

from pyspark.sql import functions as F

from fennwick.functions.entities import unescape
from fennwick.operators import chunking as K
from fennwick.operators import normalise as N
from fennwick.plans import catalog_build as E
from fennwick.sources import readers as R


def test_every_reference_of_html(spark):
    texts = [f"a&{n}" for n in html5] + [f"&{n}x;&{n}" for n in html5 if not n.endswith(";")] + [f"&#{n};" for n in (*range(0, 300), 0x3042, 0xD800, 0xFDD0, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFF, 0x10FFFF, 0x110000, 10**12)]
    texts += ["&", "&&", "&;", "&#;", "&#x;", "&#x41", "&#X1f600;z", "&#00065;&#x0000041", "&notit;", "&nosuch; &amp;lt;", "&amp", "no", "", "&NotEqualTilde;&", "x & y &lt; z", None, "&#99999999999999999999;", "&#x110000000000;"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", unescape(F.col("t")).alias("u")).collect()
    bad = [(texts[r["k"]], r["u"]) for r in rows if r["u"] != (None if texts[r["k"]] is None else html.unescape(texts[r["k"]]))]
    assert not bad, bad[:5]


def test_names_that_hold_each_other(spark):
    rnd = random.Random(2)
    word = lambda most: "".join(rnd.choices("ab日é", k=rnd.randint(1, most)))
    for most, other in ((6, 6), (2, 12), (12, 2)):
        names, goods = [*{word(most) for _ in range(60)}, None, ""], [*{word(other) for _ in range(25)}, None, ""]
        found = K.playable(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(g,) for g in goods], "allowed string"))
        assert {r["name"] for r in found.collect()} == {n for n in names if n and any(g and (g in n or n in g) for g in goods)}


def test_a_name_of_ten_thousand_characters(spark):
    rnd = random.Random(3)
    long = "".join(rnd.choices("abcdefgh", k=10_000))
    directory = spark.createDataFrame([(long,), (long[5000:5009],), ("zzz",)], "name string")
    allowed = spark.createDataFrame([(long[100:140],), ("q" * 50,)], "allowed string")
    K.playable(directory, allowed).collect()
    began = time.time()
    assert [r["name"] for r in K.playable(directory, allowed).collect()] == [long]
    assert time.time() - began < 20


def test_first_seen_order_does_not_depend_on_splits(spark, tmp_path):
    rnd = random.Random(5)
    for part in ("b", "a"):
        (tmp_path / part).mkdir()
        lines = [json.dumps({"subject_id": rnd.randrange(20), "related_subject_id": 100 + rnd.randrange(60), "relation_type": 1, "pad": "x" * rnd.randrange(40)}) for _ in range(400)]
        (tmp_path / part / "subject-relations.jsonlines").write_text("\n".join(lines) + "\n")
    found = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1k", "3000", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        edges = R.read_jsonl(spark, f"{tmp_path}/a, {tmp_path}/b", "subject-relations")
        top = E.top_labels(edges, "subject_id", [F.col("_pos")], F.col("related_subject_id").cast("string"), 12, "related")
        found.append(sorted(tuple(r) for r in top.collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {}
    for part in ("a", "b"):
        for line in (tmp_path / part / "subject-relations.jsonlines").read_text().splitlines():
            r = json.loads(line)
            want.setdefault(r["subject_id"], {})[str(r["related_subject_id"])] = 1
    assert found[0] == found[1] == found[2] == sorted((k, "、".join(list(v)[:12])) for k, v in want.items())


def test_index_names(spark, tmp_path):
    head = {"format": 2, "display_name": ' 崩\\坏 "铁道" ', "chunks": [{"text": "x" * 50_000}]}
    (tmp_path / "a.json").write_text(json.dumps(head), encoding="utf-8")
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(json.dumps(head, ensure_ascii=False).encode()))
    (tmp_path / "late.json").write_text(json.dumps({"pad": "x" * 9000, "display_name": "late"}))
    (tmp_path / "none.json").write_text("{}")
    (tmp_path / "bad.json.gz").write_text("no gzip")
    names = [R.index_name(spark, str(tmp_path / f)) for f in ("a.json", "b.json.gz", "late.json", "none.json", "bad.json.gz", "missing.json")]
    assert names == ['崩\\坏 "铁道"', '崩\\坏 "铁道"', "", "", "", ""]


def test_a_dump_is_parsed_once_into_numbered_rows(spark, tmp_path):
    """The rows of ``read_jsonl`` from a table, in the same order by one number, over several files and splits."""
    for part in range(3):
        (tmp_path / "person-relations.jsonlines").mkdir(exist_ok=True)
        lines = [f'{{"person_id": {part * 1000 + i}, "related_person_id": {i % 7}, "relation_type": 1}}' for i in range(400)]
        (tmp_path / "person-relations.jsonlines" / f"part-{2 - part}.txt").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        plain, read = R.read_jsonl(spark, str(tmp_path), "person-relations"), E.read_dump(spark, str(tmp_path), "person-relations")
        assert dict(read.dtypes)["_pos"] == "bigint" and read.columns == plain.columns
        assert not any("jsonlines" in f for f in read.inputFiles())
        ids = lambda rows: [r["person_id"] for r in rows.orderBy("_pos").collect()]
        assert ids(read) == ids(plain) == [p * 1000 + i for p in (2, 1, 0) for i in range(400)]
        assert read.select("_pos").distinct().count() == 1200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_articles_are_dealt_by_their_bytes(spark, monkeypatch):
    """The number of tasks grows with the texts, results stay; lines are sorted by one order besides that of sections."""
    rows = [(i, f"【正文】\n第{i}行\n【外部链接】\nx\n〔更多〕\ny\n【全文】\n尾{i}" + "\n字句" * 50) for i in range(40)]
    articles = spark.createDataFrame(rows, "doc long, text string")
    plain = sorted(tuple(r) for r in N.normalise_articles(articles).collect())
    monkeypatch.setattr(N, "TASK_BYTES", 256, raising=False)
    small = N.normalise_articles(articles)
    assert small.rdd.getNumPartitions() >= 40 and sorted(tuple(r) for r in small.collect()) == plain
    assert all("x" not in t and "y" not in t and f"第{i}行" in t and f"尾{i}" in t for i, t in plain)
