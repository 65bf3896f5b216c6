"""Queries over articles, dumps and edges that are made from the driver's tables, each beside DuckDB SQL for the same rows.

Parts are works, suppliers persons, nations characters; the articles and JSON lines are written from their columns, so the
readers and parsers do their work and the SQL states what must come of it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fennwick.functions import catalog as C
from fennwick.functions import cleaning as L
from fennwick.functions import text as T
from fennwick.operators import catalog as S
from fennwick.operators import chunk_index as X
from fennwick.operators import chunking as K
from fennwick.operators import normalise as N
from fennwick.plans import catalog_build as E
from fennwick.plans import chunk_build as B
from fennwick.plans import queries as Q
from fennwick.sources import dictionaries as D
from fennwick.sources import readers as R
from fennwick.tables import materialize, remove, shuffles_cleaned, stage_path


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def normalised_articles(spark: SparkSession, d: str) -> DataFrame:
    box = ("【基本信息】", "类型", F.coalesce("source", F.lit("x")), "平台", "", F.coalesce("lang", F.lit("x")))
    text = _lines("文档", *box, "", "【外部链接】【附】〔空〕【外部链接】", "留不下", "〔更多〕", "也留不下", "【正文】", "〔空节〕", "【全文】", F.coalesce("text", F.lit("")))
    return N.normalise_articles(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), text.alias("text"))).select(F.col("doc").alias("doc_id"), F.md5("text").alias("text_md5"))


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    text = _lines(F.col("p_name"), "【概要】", F.concat_ws(" ", F.lit("This is"), "p_type", F.lit("made by"), "p_brand"), "〔尺寸〕", F.concat(F.lit("size "), F.col("p_size").cast("string")), "【外部链接】", "nothing stays")
    sections = K.parse_sections(table(spark, d, "part").select(F.col("p_partkey").alias("doc"), text.alias("text")))
    return K.chunk_sections(sections).select(F.col("doc").alias("p_partkey"), "part", "title", "text")


def _characters(spark: SparkSession, d: str) -> DataFrame:
    """A page for each nation, with its region as charm point."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = _lines(F.col("n_name"), "【基本信息】", "基本资料", "萌点", F.col("r_name"), "发色", F.col("n_name"), "【登场角色】", F.when(F.col("n_regionkey") < 2, F.concat(F.replace("n_name", F.lit(" "), F.lit("")), F.lit(" 火智识"))))
    return nations.select(F.col("n_nationkey").alias("doc"), text.alias("text"))


def directory_chunks(spark: SparkSession, d: str) -> DataFrame:
    pages = _characters(spark, d)
    edits = pages.select("doc", F.when(F.col("doc") % 3 > 0, F.concat(F.lit("2026010"), (F.col("doc") % 3).cast("string"))).otherwise("").alias("lastmod"))
    return K.directory_chunks(K.character_directory(K.parse_sections(pages)), "世界", edits)


def playable_filter(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select("n_nationkey", F.replace("n_name", F.lit(" "), F.lit("")).alias("name"))
    return K.playable(names, K.playable_names(_characters(spark, d))).select("n_nationkey", "name")


def catalog_relations(spark: SparkSession, d: str) -> DataFrame:
    """Staff of each part and works of each supplier, with labels for two of the positions."""
    none = lambda schema: spark.createDataFrame([], schema)
    parts, suppliers = table(spark, d, "part"), table(spark, d, "supplier")
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("subject_id"), F.col("l_suppkey").alias("person_id"), F.col("l_linenumber").cast("int").alias("position"), F.col("l_orderkey").alias("_pos"))
    src = {
        "subject": parts.select(F.col("p_partkey").alias("id"), F.lit(2).alias("type"), F.col("p_name").alias("name"), F.lit("").alias("name_cn"), F.lit("").alias("infobox"), F.col("p_retailprice").alias("score")),
        "person": suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("").alias("infobox")),
        "character": none("id long, name string, infobox string"),
        "subject-persons": edges,
        "subject-characters": none("subject_id long, character_id long, type int, _pos long"),
        "subject-relations": none("subject_id long, related_subject_id long, relation_type int, _pos long"),
        "person-characters": none("person_id long, subject_id long, character_id long, _pos long"),
        "person-relations": none("person_id long, related_person_id long, relation_type int, person_type string, _pos long"),
    }
    dims = {name: R.labels_table(spark, rows) for name, rows in {"staff": [(2, 1, "监督"), (2, 2, "脚本")], "relation": [], "person_relation": []}.items()}
    dims["staff_priority"] = spark.createDataFrame([(2, 1, 200), (2, 2, 100)], "kind int, code int, priority int")
    told = E.relation_summaries(src, {k: src[k].select("id") for k in ("subject", "character", "person")}, dims)
    return told["subject"].select(F.lit("subject").alias("kind"), "id", "relations").unionByName(told["person"].select(F.lit("person").alias("kind"), "id", "relations"))


def _ordered(rows: DataFrame, order: list[str], ranges: int = 0) -> DataFrame:
    return (rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)).sortWithinPartitions(*order)


def _ordered_dump(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]]) -> str:
    """A folder of JSON lines, a file after the other, of rows that are ``_ordered`` by columns that stay out.

    Written as gzip, which the readers take as they take plain lines: a file of one range is one task's to read.
    """
    folder = stage_path(spark, "dump")
    for name, (rows, order) in tables.items():
        rows.select(F.to_json(F.struct(*[c for c in rows.columns if c not in order])).alias("value")).write.option("compression", "gzip").text(f"{folder}/{name}.jsonlines")
    return folder


def catalog_build(spark: SparkSession, d: str) -> DataFrame:
    """A whole build from JSON lines: parts as works, nations as characters, suppliers as persons, edges of every kind."""
    read, key = lambda name: table(spark, d, name), ["k", "n", "a", "b"]
    size, ties = F.col("p_size"), [F.lit(0).alias("a"), F.lit(0).alias("b")]
    line = read("lineitem").select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    parts = read("part").crossJoin(F.broadcast(read("part").agg(F.max("p_partkey").alias("most")))).select("p_partkey", "most")  # one row
    # Sorted once for the files of all kinds of edges, in ranges that grow in number with the table, as kept rows are not dealt anew.
    ranges = 4 * read("lineitem").rdd.getNumPartitions()
    line = _ordered(line.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left"), key, ranges).persist(StorageLevel.DISK_ONLY)
    born = F.concat(F.lit("20"), F.lpad((size % 25).cast("string"), 2, "0"), F.lit("-0"), (size % 9 + 1).cast("string"), F.lit("-05"))
    works = read("part").select(
        F.col("p_partkey").alias("id"), F.lit(2).alias("type"), F.col("p_name").alias("name"), F.lit("").alias("name_cn"), F.concat(F.lit("{{Infobox x\n|别名= "), "p_brand", F.lit("\n}}")).alias("infobox"), F.concat(F.lit(" "), "p_type", F.lit("\n")).alias("summary"), F.when(size % 3 == 0, "").otherwise(born).alias("date"),
        (size / 2).cast("double").alias("score"), (F.col("p_partkey") % 3).cast("int").alias("rank"), F.create_map(F.lit("done"), size.cast("long")).alias("favorite"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("tags"), F.lit(0).alias("k"), F.col("p_partkey").alias("n"), *ties,
    )
    people = read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("").alias("infobox"), F.lit("").alias("summary"), F.array(F.lit("seiyu")).alias("career"), F.lit(0).alias("k"), F.col("s_suppkey").alias("n"), *ties)
    figures = read("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("infobox"), F.lit("").alias("summary"), F.lit(0).alias("k"), F.col("n_nationkey").alias("n"), *ties)
    figure = F.pmod(F.col("l_suppkey") + F.col("n"), F.lit(25))
    tables = {
        "subject": (_ordered(works, key), key), "person": (_ordered(people, key), key), "character": (_ordered(figures, key), key),
        "subject-characters": (line.select(F.col("l_partkey").alias("subject_id"), figure.alias("character_id"), (F.col("n") % 3 + 1).alias("type"), *key), key),
        "subject-persons": (line.select(F.col("l_partkey").alias("subject_id"), F.col("l_suppkey").alias("person_id"), F.col("n").alias("position"), *key), key),
        "subject-relations": (line.where("most is not null").select(F.col("l_partkey").alias("subject_id"), (F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.col("most")) + 1).alias("related_subject_id"), (F.col("n") % 3).alias("relation_type"), *key), key),
        "person-characters": (line.select(F.col("l_suppkey").alias("person_id"), F.col("l_partkey").alias("subject_id"), figure.alias("character_id"), *key), key),
        "person-relations": (line.select(F.col("l_suppkey").alias("person_id"), (F.col("n") + 1).alias("related_person_id"), (F.col("k") % 4).alias("relation_type"), F.when(F.col("k") % 3 == 0, "crt").otherwise("prsn").alias("person_type"), *key), key),
    }
    dims = {name: R.labels_table(spark, rows) for name, rows in {"staff": [(2, 1, "监督"), (2, 2, "脚本")], "relation": [(2, 1, "续集")], "person_relation": [(0, 1, "师父"), (1, 1, "配偶"), (0, 2, "同事")], "platform": []}.items()}
    dims["staff_priority"] = spark.createDataFrame([(2, 1, 200), (2, 2, 100)], "kind int, code int, priority int")
    cfg = E.BuildConfig(today="2026-08-01", votes=0, votes_oldest=0, favorites=10, favorites_oldest=10, new_months=0)
    with shuffles_cleaned(spark):
        folder = _ordered_dump(spark, tables)
        line.unpersist()
        src = E.read_dumps(spark, folder)
        remove(spark, folder)  # made for this build alone
    built = E.build_catalog(spark, folder, stage_path(spark, "catalog"), cfg, dims, "2026-07-01", src)
    hits = built.postings.groupBy(F.col("doc_id").alias("rowid")).agg(F.sum("name_tf").alias("name_words"))
    docs = built.docs.join(hits, "rowid", "left").crossJoin(F.broadcast(built.meta.select(F.col("value").alias("source_date"))))  # one row
    return docs.select("rowid", "kind", "source_id", "name_cn", "summary", "relations", "extra", "date", "ym", "rank", F.round("score", 2).alias("score"), "favorite", F.coalesce("name_words", F.lit(0)).cast("long").alias("name_words"), "source_date")


def chunk_build(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a whole build: sections, those of little value gone, the first of equal texts, numbered."""
    text = _lines(F.col("p_name"), "【概要】", F.concat_ws(" ", F.lit("This is"), "p_type", F.lit("made by"), "p_brand"), "with a full stop。", "〔尺寸〕", F.concat(F.lit("size "), F.col("p_size").cast("string")), "【外部链接】", "nothing stays")
    return B.build_chunks(table(spark, d, "part").select(F.col("p_partkey").alias("doc"), text.alias("text"))).select("chunk_id", "title", "text")


def long_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as single paragraphs: those of over 1,200 characters are cut at sentence ends, longer sentences hard."""
    whole = F.replace("text", F.lit("."), F.lit("。"))
    rows = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("seq"), F.lit("t").alias("title"), F.array(whole).alias("paragraphs"))
    return K.chunk_sections(rows).select(F.col("doc").alias("doc_id"), "part", F.md5("text").alias("text_md5"))


def query_reading(spark: SparkSession, d: str) -> DataFrame:
    """What is read from a question: the query without its phrases, its short pieces, whether it asks for an overview."""
    asked = F.concat(F.lit("请问 "), F.col("text"), F.when(F.col("item_id") % 2 == 0, "是什么？").otherwise("，有哪些"))
    rows = table(spark, d, "benchmark").select("item_id", asked.alias("q"), T.clean_query(asked).alias("cleaned"))
    return rows.select("item_id", "cleaned", F.array_join(F.array_sort(T.query_phrases(F.col("cleaned"))), "|").alias("phrases"), T.wants_overview(F.col("q")).alias("overview"))


def result_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("rank"), F.col("p_name").alias("title"), (F.col("p_size") / 8).alias("score"), F.col("p_type").alias("text"))
    return X.format_results(rows)


def stored_deletes(spark: SparkSession, d: str) -> DataFrame:
    """A stored catalog after two deletions, and after its tables were compacted: the same entries, terms and links."""
    works = Q.catalog(spark, d)
    links = table(spark, d, "lineitem").select(F.lit("subject").alias("owner_kind"), F.col("l_partkey").alias("owner_id"), F.lit("person").alias("target_kind"), F.col("l_suppkey").alias("target_id"), F.col("l_linenumber").cast("string").alias("meta"))
    path = stage_path(spark, "store")
    stored = S.store_tables(spark, path, {"docs": works.docs, "postings": works.postings, "lengths": works.lengths, "meta": works.meta, "links": links}, 0)
    less = stored.delete("subject:3, subject:5, person:1, junk", write=True)[0].delete("subject:7", write=True)[0]
    rows = []
    for what, c in (("deleted", less), ("compacted", less.compact())):
        found = [c.docs.agg(F.count("*").alias("n"), F.sum("source_id").alias("ids")), c.postings.agg(F.count("*").alias("postings"), F.sum("name_tf").alias("name_words")), c.links.agg(F.count("*").alias("links"))]
        rows.append(found[0].crossJoin(F.broadcast(found[1])).crossJoin(F.broadcast(found[2])).select(F.lit(what).alias("what"), "*"))  # one row each
    return rows[0].unionByName(rows[1])


def index_files(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of several packed index files; one of an unknown format is passed over."""
    group = F.pmod("p_partkey", F.lit(4)).cast("int")
    chunk = F.struct(F.col("p_name").alias("title"), F.when(F.col("p_size") % 5 > 0, F.col("p_type")).otherwise("  ").alias("text"))
    packed = table(spark, d, "part").groupBy(group.alias("g")).agg(F.collect_list(chunk).alias("chunks"))  # one file's chunks, as the format has them
    body = F.to_json(F.struct(F.when(F.col("g") == 3, 9).otherwise(F.col("g") % 2 + 1).alias("format"), F.lit(1).alias("engine_version"), F.concat(F.lit("2026-0"), (F.col("g") + 1).cast("string")).alias("built_at"), F.concat(F.lit("主题"), F.col("g").cast("string")).alias("display_name"), "chunks"))
    folder = stage_path(spark, "index-files")
    packed.select("g", body.alias("value")).write.partitionBy("g").text(folder)
    rows, broken = R.read_index_files(spark, [f"{folder}/g={g}" for g in range(4)])
    assert broken == [f"{folder}/g=3"]
    newest = R.latest_build(rows).select(F.col("built_at").alias("newest"))
    return rows.crossJoin(F.broadcast(newest)).select("built_at", "display_name", "title", "text", "newest")  # one row


def article_files(spark: SparkSession, d: str) -> DataFrame:
    """Articles read from files of their own: text, fingerprint and size."""
    folder = stage_path(spark, "articles")
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), F.concat(F.lit("词条："), "s_name").alias("value")).repartition(4, "doc").write.partitionBy("doc").text(folder)
    read = R.read_articles(spark, f"{folder}/*")
    return read.select(F.regexp_extract("path", r"doc=(\d+)", 1).cast("long").alias("s_suppkey"), "text", "sha256", "size")


def _dump(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """A folder with ``rows`` as JSON lines and a bad line among them."""
    folder = stage_path(spark, "dump")
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).unionByName(spark.createDataFrame([("{bad",)], "value string")).write.text(f"{folder}/{name}.jsonlines")
    return folder


def jsonl_entities(spark: SparkSession, d: str) -> DataFrame:
    heat = F.create_map(F.lit("8"), F.col("p_size").cast("long"), F.lit("9"), F.when(F.col("p_size") % 2 == 0, F.lit(7).cast("long")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 > 0, 2).alias("type"), F.col("p_name").alias("name"), heat.alias("score_details"), F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.lit(" ").alias("name")), F.struct(F.col("p_brand").alias("name"))).alias("tags"))
    read = R.read_jsonl(spark, _dump(spark, rows, "subject"), "subject")
    return read.select("id", F.col("type").alias("kind"), "name", C.sum_values(F.col("score_details")).alias("votes"), C.sum_values(F.col("favorite")).alias("favorites"), C.tags_text(F.col("tags")).alias("tags"))


def jsonl_episodes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(key.alias("id"), F.col("o_custkey").alias("subject_id"), F.when(key % 5 > 0, F.col("o_orderpriority")).otherwise(" ").alias("name"), F.lit("").alias("name_cn"), F.when(key % 3 > 0, (key % 100 / 4).cast("string")).otherwise("x").alias("sort"))
    return R.read_episodes(spark, _dump(spark, rows, "episode")).select("id", "subject_id", "name", "ep_type", "sort")


def jsonl_typed(spark: SparkSession, d: str) -> DataFrame:
    """Rows of which some fields have another type than expected."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    field = lambda name, c: F.concat(F.lit(f', "{name}": '), c)
    line = F.concat(
        F.lit('{"id": '), key.cast("string"), field("name", F.when(key % 2 == 0, key.cast("string")).otherwise(F.concat(F.lit('"'), "p_name", F.lit('"')))), field("score", F.when(key % 3 == 0, F.concat(F.lit('"'), size, F.lit('.5"'))).otherwise("true")),
        field("favorite", F.when(key % 4 == 0, "[]").otherwise(F.concat(F.lit('{"a": "'), size, F.lit('", "b": null, "c": "x"}')))), field("tags", F.when(key % 5 == 0, '"x"').otherwise('[{"name": "t"}, 7, {"no": 1}]')), F.lit("}"),
    )
    folder = stage_path(spark, "dump")
    table(spark, d, "part").select(line.alias("value")).write.text(f"{folder}/subject.jsonlines")
    read = R.read_jsonl(spark, folder, "subject")
    return read.select("id", "name", "score", C.sum_values(F.col("favorite")).alias("favorites"), C.tags_text(F.col("tags")).alias("tags"))


def dictionaries(spark: SparkSession, d: str) -> DataFrame:
    """Labels, platforms and display orders, from dictionary files that are written out of the nations."""
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    key = F.col("n_nationkey").cast("string")
    gathered = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("x")))), lambda r: r["x"]), "\n")  # noqa: E731  the lines of one file
    coded = _lines(F.concat(F.lit("      "), key, F.lit(":")), '        en: "e"', F.concat(F.lit('        cn: "'), "n_name", F.lit('"')), F.concat(F.lit("      "), key, F.lit(":")), '        cn: " "')
    lists = nations.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_nationkey")), ", ").alias("codes"))
    orders = lists.agg(gathered(F.col("n_regionkey"), F.concat(F.lit("      r"), F.col("n_regionkey").cast("string"), F.lit(": ["), "codes", F.lit("]"))).alias("orders"))
    letters = F.translate(F.lower("n_name"), "0123456789 ", "abcdefghij_")
    made = nations.agg(gathered(F.col("n_nationkey"), coded).alias("codes"), gathered(F.col("n_nationkey"), F.concat(F.lit("      "), letters, F.lit(": &P "), key)).alias("platforms")).crossJoin(F.broadcast(orders))  # one row each
    staffs = _lines("define:", "  types:", "    anime: &A", F.col("codes"), "presentation:", "  *TYPE_ANIME :", "    groups:", F.col("orders"))
    files = made.select(F.explode(F.array(F.struct(F.lit("subject_staffs").alias("doc"), staffs.alias("text")), F.struct(F.lit("subject_platforms").alias("doc"), _lines("x:", "  types:", "    game:", "      none: &N 99", F.col("platforms")).alias("text")))).alias("f")).select("f.*")
    found = D.dictionaries_of(materialize(files, "dictionary-files"))
    rows = [found[name].select(F.lit(what).alias("what"), "kind", "code", F.col(value).cast("string").alias("value")) for name, what, value in (("staff", "label", "label"), ("platform", "platform", "label"), ("staff_priority", "priority", "priority"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as sections of paragraphs of 250 characters: packed two by two, a short last one with those before it."""
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,250}"), F.lit(0))
    rows = table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("seq"), F.lit("t").alias("title"), cut.alias("paragraphs"))
    return K.chunk_sections(rows).select(F.col("doc").alias("doc_id"), "part", F.md5("text").alias("text_md5"))


def name_fields(spark: SparkSession, d: str) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    box = F.when(key % 2 == 0, F.concat(F.lit("{{Infobox x\n|中文名= "), "c_mktsegment", F.lit("\n|简称= c"), key.cast("string"), F.lit("\n}}")))
    shown = C.display_name(name, F.when(key % 3 == 0, F.concat(name, F.lit("中 "))), box)
    return table(spark, d, "customer").select("c_custkey", shown.alias("display"), C.search_name(name, shown).alias("searched"), C.alias_text(box).alias("alias"))


def extra_lines(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    line = C.extra_text(F.lit("subject"), F.lit("动画"), day, F.lit("TV"), F.when(F.col("o_orderkey") % 4 == 0, 4).otherwise(2), F.when(F.col("o_orderkey") % 3 == 0, 8.5).otherwise(0.0), (F.col("o_orderkey") % 5).cast("int"), F.col("o_orderpriority"), none)
    return table(spark, d, "orders").select("o_orderkey", line.alias("extra"), C.season_extra(line).alias("season_extra"))


def thresholds(spark: SparkSession, d: str) -> DataFrame:
    day = C.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    wanted = F.floor(F.col("o_totalprice") / 100000).cast("long")
    return table(spark, d, "orders").select("o_orderkey", C.year_requirement(day, 100, 400, 1996, 2001).cast("long").alias("needed"), C.is_new(day, wanted, "2000-06-01", 6).alias("fresh"))


def queries() -> dict:
    found = (normalised_articles, section_chunks, directory_chunks, playable_filter, catalog_relations, dictionaries, packed_chunks, jsonl_typed, jsonl_entities, jsonl_episodes, name_fields, extra_lines, thresholds, catalog_build, chunk_build, long_paragraphs, query_reading, result_lines, stored_deletes, index_files, article_files)
    return {f.__name__: f for f in found}


_STRIP = r"'^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'"
_LABEL = "|| CASE position WHEN 1 THEN '（监督）' WHEN 2 THEN '（脚本）' ELSE '' END"


def oracle_sql() -> dict[str, str]:
    return {
        "normalised_articles": rf"""WITH a AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM documents),
r AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM a), s AS (SELECT doc_id, pos, regexp_replace(raw, {_STRIP}) AS raw FROM r),
t AS (SELECT *, regexp_replace(regexp_replace(replace(regexp_replace(raw, '[\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{feff}}]', '', 'g'), chr(160), ' '), '\[\d+\]', '', 'g'), '\{{\{{[^{{}}]{{0,40}}\}}\}}', '', 'g') AS x FROM s),
u AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(x, '^[\s\p{{Z}}]*(?:/[\s\p{{Z}}]*)+|(?:[\s\p{{Z}}]*/)+[\s\p{{Z}}]*$', '', 'g'), '(?:[\s\p{{Z}}]*/[\s\p{{Z}}]*){{2,}}', ' / ', 'g'), {_STRIP}) AS y FROM t),
v AS (SELECT doc_id, pos, CASE WHEN raw = '' THEN '' WHEN y = '' OR regexp_matches(y, '^["“”‘’'']+$') OR regexp_matches(y, '{L.DECORATION}') THEN NULL
WHEN length(y) BETWEEN 4 AND 16 AND length(y) % 2 = 0 AND left(y, length(y) // 2) = right(y, length(y) // 2) THEN left(y, length(y) // 2) ELSE y END AS line FROM u),
b AS (SELECT * FROM (SELECT *, lag(line) OVER w AS before FROM v WHERE line IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE line <> '' OR coalesce(before, 'x') <> ''),
c AS (SELECT *, last_value(nullif(line, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS content FROM b),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM c WHERE line = '' OR line IS DISTINCT FROM content GROUP BY 1 HAVING max(line) <> '')
SELECT doc_id, md5(regexp_replace('文档' || chr(10) || '【基本信息】' || chr(10) || '类型：' || coalesce(source, 'x') || chr(10) || '平台：' || coalesce(lang, 'x') || CASE WHEN body IS NULL THEN '' ELSE chr(10) || '【全文】' || chr(10) || body END, '[\s\p{{Z}}]+$', '') || chr(10)) AS text_md5
FROM documents LEFT JOIN k USING (doc_id)""",
        "section_chunks": "SELECT p_partkey, 0 AS part, p_name || ' / 概要' AS title, 'This is ' || p_type || ' made by ' || p_brand AS text FROM part UNION ALL SELECT p_partkey, 0, p_name || ' / 概要 / 尺寸', 'size ' || p_size FROM part",
        "directory_chunks": """WITH n AS (SELECT *, CASE WHEN n_nationkey % 3 > 0 THEN '2026010' || (n_nationkey % 3) ELSE '' END AS d FROM nation JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT *, row_number() OVER (ORDER BY d DESC, n_nationkey) AS i FROM n), g AS (SELECT r_name, count(*) AS c FROM n GROUP BY 1)
SELECT '世界 / 登场角色一览' AS title, string_agg(n_name, '、' ORDER BY i) AS text FROM o UNION ALL
SELECT '世界 / 角色萌点一览', '常见萌点：' || (SELECT string_agg(r_name, '、' ORDER BY c DESC, r_name) FROM g) || chr(10) || string_agg(n_name || '：' || r_name || '（' || n_name || '·）', chr(10) ORDER BY i) FILTER (i <= 10) FROM o""",
        "playable_filter": """WITH n AS (SELECT n_nationkey, n_regionkey, replace(n_name, ' ', '') AS name FROM nation), a AS (SELECT name FROM n WHERE n_regionkey < 2 AND length(name) <= 12)
SELECT n_nationkey, name FROM n WHERE EXISTS (SELECT 1 FROM a WHERE contains(a.name, n.name) OR contains(n.name, a.name))""",
        "catalog_relations": f"""WITH e AS (SELECT l_partkey AS s, l_suppkey AS p, l_linenumber AS position, l_orderkey AS pos, p_name, s_name, p_retailprice AS score FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
st AS (SELECT s AS id, s_name {_LABEL} AS label, min((CASE position WHEN 1 THEN 200 WHEN 2 THEN 100 ELSE 9999 END, pos)) AS o FROM e GROUP BY 1, 2),
jb AS (SELECT p AS id, p_name {_LABEL} AS label, min((-score, pos)) AS o FROM e GROUP BY 1, 2),
sr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, label) AS n FROM st), jr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, label) AS n FROM jb)
SELECT 'subject' AS kind, p_partkey AS id, coalesce('制作：' || (SELECT string_agg(label, '、' ORDER BY n) FROM sr WHERE sr.id = p_partkey AND n <= 20), '') AS relations FROM part UNION ALL
SELECT 'person', s_suppkey, coalesce('参与：' || (SELECT string_agg(label, '、' ORDER BY n) FROM jr WHERE jr.id = s_suppkey AND n <= 12), '') FROM supplier""",
        "jsonl_typed": """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.5 END::DOUBLE AS score,
CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END::BIGINT AS favorites, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 't' END AS tags FROM part""",
        "dictionaries": """SELECT 'label' AS what, 2 AS kind, n_nationkey::INT AS code, n_name AS value FROM nation UNION ALL SELECT 'platform', 4, n_nationkey::INT, upper(translate(n_name, '0123456789 ', 'ABCDEFGHIJ_')) FROM nation UNION ALL
SELECT 'priority', 2, n_nationkey::INT, (100 * (dense_rank() OVER (ORDER BY n_regionkey)) + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::VARCHAR FROM nation""",
        "packed_chunks": """WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''), m AS (SELECT *, CASE WHEN n > 500 AND n % 500 BETWEEN 1 AND 98 THEN n // 500 - 1 ELSE (n - 1) // 500 END AS most FROM t),
c AS (SELECT *, unnest(range(0, most + 1)) AS part FROM m), p AS (SELECT doc_id, part, [substr(text, 500 * part + 1, 250), substr(text, 500 * part + 251, 250), CASE WHEN part = most THEN substr(text, 500 * part + 501) ELSE '' END] AS ps FROM c)
SELECT doc_id, part::INT AS part, md5(array_to_string(list_filter(ps, lambda x: x <> ''), chr(10))) AS text_md5 FROM p""",
        "jsonl_entities": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN 2 ELSE 0 END AS kind, p_name AS name, (p_size + CASE WHEN p_size % 2 = 0 THEN 7 ELSE 0 END)::BIGINT AS votes, 0::BIGINT AS favorites, p_type || '、' || p_brand AS tags FROM part",
        "jsonl_episodes": "SELECT o_orderkey AS id, o_custkey AS subject_id, o_orderpriority AS name, 0 AS ep_type, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 100) / 4.0 ELSE 0 END::DOUBLE AS sort FROM orders WHERE o_orderkey % 5 > 0",
        "name_fields": """WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN c_name || '中' WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS display FROM customer)
SELECT c_custkey, display, CASE WHEN display = c_name THEN display ELSE display || ' ' || c_name END AS searched, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '、c' || c_custkey ELSE '' END AS alias FROM c""",
        "extra_lines": """WITH x AS (SELECT o_orderkey, '类型：动画 / 发行日期：' || strftime(o_orderdate, '%Y-%m-%d') || ' / ' AS head, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '平台：TV / ' END AS tv, CASE WHEN o_orderkey % 3 = 0 THEN '评分：8.5 / ' ELSE '' END AS score, CASE WHEN o_orderkey % 5 > 0 THEN '排名：' || (o_orderkey % 5) || ' / ' ELSE '' END || '标签：' || o_orderpriority AS rest FROM orders)
SELECT o_orderkey, head || tv || score || rest AS extra, tv || rest AS season_extra FROM x""",
        "thresholds": """SELECT o_orderkey, CASE WHEN y <= 1996 THEN 400 WHEN y >= 2001 THEN 100 ELSE round_even(400 - 300 * ((y - 1996) / 5.0), 0) END::BIGINT AS needed,
CASE WHEN o_orderdate::DATE > DATE '2000-06-01' THEN o_orderdate::DATE <= DATE '2000-06-01' + 1095 AND floor(o_totalprice / 100000) > 0 ELSE o_orderdate::DATE >= DATE '2000-06-01' - 180 END AS fresh FROM (SELECT *, year(o_orderdate) AS y FROM orders)""",
        "catalog_build": f"""WITH s AS (SELECT p_partkey AS id, p_name AS name, p_size, p_size / 2.0 AS score, p_brand, p_type, p_partkey % 3 AS rk, CASE WHEN p_size % 3 = 0 THEN '' ELSE '20' || lpad((p_size % 25)::VARCHAR, 2, '0') || '-0' || (p_size % 9 + 1) || '-05' END AS date FROM part),
ks AS (SELECT * FROM s WHERE true), l AS (SELECT *, l_orderkey AS k, l_linenumber AS n, (l_suppkey + l_linenumber) % 25 AS fig FROM lineitem),
cast_ AS (SELECT l_partkey AS id, n_name AS label, min((n % 3 + 1, k, n, l_partkey, l_suppkey)) AS o FROM l JOIN nation ON fig = n_nationkey GROUP BY 1, 2),
staff AS (SELECT l_partkey AS id, s_name || CASE n WHEN 1 THEN '（监督）' WHEN 2 THEN '（脚本）' ELSE '' END AS label, min((CASE n WHEN 1 THEN 200 WHEN 2 THEN 100 ELSE 9999 END, k, n, l_partkey, l_suppkey)) AS o FROM l JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
rel AS (SELECT l_partkey AS id, b.name || CASE n % 3 WHEN 1 THEN '（续集）' ELSE '' END AS label, min((k, n, l_partkey, l_suppkey)) AS o FROM l JOIN s a ON l_partkey = a.id JOIN s b ON b.id = (l_partkey + l_suppkey) % (SELECT max(p_partkey) FROM part) + 1 GROUP BY 1, 2),
works AS (SELECT fig AS id, name || CASE n % 3 + 1 WHEN 1 THEN '（主角）' WHEN 2 THEN '（配角）' ELSE '（客串）' END AS label, min((-score, k, n, l_partkey, l_suppkey)) AS o FROM l JOIN s ON l_partkey = s.id GROUP BY 1, 2),
act AS (SELECT fig AS id, s_name AS label, min((k, n, l_partkey, l_suppkey)) AS o FROM l JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
jobs AS (SELECT l_suppkey AS id, name || CASE n WHEN 1 THEN '（监督）' WHEN 2 THEN '（脚本）' ELSE '' END AS label, min((-score, k, n, l_partkey, l_suppkey)) AS o FROM l JOIN s ON l_partkey = s.id GROUP BY 1, 2),
ties AS (SELECT l_suppkey AS id, s_name || '（' || how || '）' AS label, min((k, n, l_partkey, l_suppkey)) AS o FROM l JOIN supplier ON s_suppkey = n + 1 JOIN (VALUES (0, 1, '师父'), (1, 1, '配偶'), (0, 2, '同事')) v(grp, code, how) ON grp = (k % 3 = 0)::INT AND code = k % 4 GROUP BY 1, 2),
tops AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, id, string_agg(label, '、' ORDER BY o, label) AS x FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, label) AS i FROM {t}) WHERE i <= {m} GROUP BY id" for t, m in (("cast_", 20), ("staff", 20), ("rel", 12), ("works", 12), ("act", 5), ("jobs", 12), ("ties", 12)))}),
one AS (SELECT id, max(x) FILTER (t = 'cast_') AS c, max(x) FILTER (t = 'staff') AS st, max(x) FILTER (t = 'rel') AS r FROM tops WHERE t IN ('cast_', 'staff', 'rel') GROUP BY 1),
two AS (SELECT id, max(x) FILTER (t = 'works') AS w, max(x) FILTER (t = 'act') AS a FROM tops WHERE t IN ('works', 'act') GROUP BY 1),
three AS (SELECT id, max(x) FILTER (t = 'jobs') AS j, max(x) FILTER (t = 'ties') AS ti FROM tops WHERE t IN ('jobs', 'ties') GROUP BY 1),
told AS (SELECT 0 AS ord, 'subject' AS kind, s.id AS source_id, s.name AS name_cn, s.p_type AS summary, concat_ws(' / ', '角色：' || c, '制作：' || st, '关联：' || r) AS relations,
  concat_ws(' / ', '类型：动画', '发行日期：' || nullif(date, ''), '评分：' || nullif(s.score, 0), '排名：' || nullif(rk, 0), '标签：' || p_brand) AS extra, date, CASE WHEN date <> '' THEN left(date, 7) END AS ym, nullif(rk, 0)::INT AS rank, round(nullif(s.score, 0), 2)::DOUBLE AS score, p_size::BIGINT AS favorite,
  len(regexp_extract_all(lower(s.name || ' ' || p_brand), '[\\p{{L}}\\p{{N}}]+')) AS name_words FROM ks s LEFT JOIN one USING (id)
UNION ALL SELECT 1, 'character', n_nationkey, n_name, '', concat_ws(' / ', '登场：' || w, '声优：' || a), '', '', NULL, NULL, NULL, NULL, len(regexp_extract_all(lower(n_name), '[\\p{{L}}\\p{{N}}]+')) FROM nation JOIN two ON id = n_nationkey
UNION ALL SELECT 2, 'person', s_suppkey, s_name, '', concat_ws(' / ', '参与：' || j, '关系：' || ti), '职业：seiyu', '', NULL, NULL, NULL, NULL, len(regexp_extract_all(lower(s_name), '[\\p{{L}}\\p{{N}}]+')) FROM supplier JOIN three ON id = s_suppkey)
SELECT row_number() OVER (ORDER BY ord, source_id) AS rowid, kind, source_id, name_cn, summary, relations, extra, date, ym, rank, score, favorite, name_words, '2026-07-01' AS source_date FROM told""",
        "chunk_build": """WITH t AS (SELECT p_partkey, p_name || ' / 概要' AS title, 'This is ' || p_type || ' made by ' || p_brand || chr(10) || 'with a full stop。' AS text FROM part)
SELECT row_number() OVER (ORDER BY p_partkey) AS chunk_id, title, text FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(text, '[\\s\\p{Z}]+', '', 'g') ORDER BY p_partkey) AS i FROM t) WHERE i = 1""",
        "long_paragraphs": r"""WITH d AS (SELECT doc_id, replace(text, '.', '。') AS t FROM documents WHERE text <> ''),
p AS (SELECT doc_id, t, CASE WHEN length(t) <= 1200 THEN [[t]] ELSE list_transform(flatten(list_transform(regexp_extract_all(t, '[^。！？；\n]+[。！？；\n]?'), lambda s: list_transform(range(0, (length(s) - 1) // 600 + 1), lambda i: substr(s, i * 600 + 1, 600)))), lambda x: [x]) END AS ps FROM d),
c AS (SELECT doc_id, list_reduce(ps, lambda a, x: CASE WHEN length(a[-1]) + length(x[1]) <= 600 THEN list_append(a[:-2], a[-1] || x[1]) ELSE list_append(a, x[1]) END) AS c FROM p WHERE len(ps) > 0),
m AS (SELECT doc_id, CASE WHEN len(c) >= 2 AND length(c[-1]) < 60 AND length(c[-2]) + 1 + length(c[-1]) <= 1200 THEN list_append(c[:-3], c[-2] || chr(10) || c[-1]) ELSE c END AS c FROM c)
SELECT doc_id, (unnest(range(1, len(c) + 1)) - 1)::INT AS part, md5(unnest(c)) AS text_md5 FROM m""".replace("\\n", "\n"),
        "query_reading": f"""WITH q AS (SELECT item_id, '请问 ' || text || CASE WHEN item_id % 2 = 0 THEN '是什么？' ELSE '，有哪些' END AS q FROM benchmark),
c AS (SELECT item_id, q, regexp_replace(regexp_replace(regexp_replace(q, '{T.QUESTION}', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'), '^ +| +$', '', 'g') AS cleaned FROM q)
SELECT item_id, cleaned, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(cleaned, '[\\s\\p{{Z}}，。、,？?！!：:；;]+'), lambda x: lower(x)), lambda x: length(x) BETWEEN 2 AND 8 AND x NOT IN ({T.quoted(T.NOISE)})))), '|') AS phrases,
regexp_matches(q, '{T.OVERVIEW}') AS overview FROM c""",
        "result_lines": "SELECT p_partkey::INT AS rank, '【' || p_partkey || '】' || p_name || '（相关度 ' || (p_size / 8.0)::DOUBLE || '）' || chr(10) || p_type AS line FROM part",
        "stored_deletes": f"""WITH {Q._WORKS}, k AS (SELECT * FROM works WHERE source_id NOT IN (3, 5, 7)), w AS (SELECT source_id, unnest(regexp_extract_all(lower(p_name), '[\\p{{L}}\\p{{N}}]+')) AS t, 1 AS n FROM k UNION ALL SELECT source_id, unnest(regexp_extract_all(lower(split_part(extra, '、', 2) || ' ' || substr(extra, 4)), '[\\p{{L}}\\p{{N}}]+')), 0 FROM k),
one AS (SELECT (SELECT count(*) FROM k) AS n, (SELECT sum(source_id)::BIGINT FROM k) AS ids, (SELECT count(*) FROM (SELECT DISTINCT source_id, t FROM w)) AS postings, (SELECT sum(n)::BIGINT FROM w) AS name_words, (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (3, 5, 7)) AS links)
SELECT 'deleted' AS what, * FROM one UNION ALL SELECT 'compacted', * FROM one""",
        "index_files": "SELECT '2026-0' || (p_partkey % 4 + 1) AS built_at, '主题' || (p_partkey % 4) AS display_name, p_name AS title, p_type AS text, '2026-03' AS newest FROM part WHERE p_partkey % 4 < 3 AND p_size % 5 > 0",
        "article_files": "SELECT s_suppkey, '词条：' || s_name || chr(10) AS text, sha256('词条：' || s_name || chr(10)) AS sha256, octet_length(encode('词条：' || s_name || chr(10)))::BIGINT AS size FROM supplier",
    }
