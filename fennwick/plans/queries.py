"""The engine's queries over the driver's tables, each beside DuckDB SQL for the same rows.

The tables stand in for articles and catalogs: documents are chunks (their source is the title), parts and orders are
works, lineitems are edges. Every order is total, every computed column has a name, and doubles are rounded.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fennwick.functions import catalog as C
from fennwick.functions import cleaning as L
from fennwick.functions import text as T
from fennwick.operators import catalog as Q
from fennwick.operators import chunk_index as X
from fennwick.operators import chunking as K
from fennwick.plans import catalog_build as E
from fennwick.sources.readers import last_edit
from fennwick.streaming.postings import event_counts
from fennwick.tables import spread, stage_path

TERMS = ("thing", "with", "heed")
AS_OF = "2001-08-01"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name == "documents" else rows  # texts are costly to read through


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), "text")


@lru_cache(maxsize=4)
def _saved(application: str, d: str) -> str:
    """Where the documents' index of a folder was written in this application; built once for all queries."""
    spark = SparkSession.active()
    path = stage_path(spark, "index")
    X.build_index(chunks(spark, d)).save(path)
    return path


def _index(spark: SparkSession, d: str) -> X.ChunkIndex:
    return X.ChunkIndex.load(spark, _saved(spark.sparkContext.applicationId, d))


def works(spark: SparkSession, d: str, name: Column | None = None) -> DataFrame:
    """Parts as works of type 2."""
    return table(spark, d, "part").withColumn("p_name", F.col("p_name") if name is None else name).select(
        F.lit("subject").alias("kind"), F.col("p_partkey").alias("source_id"), F.lit(2).alias("subject_type"), F.col("p_name").alias("name_cn"), F.concat(F.lit("标签："), "p_type", F.lit("、"), "p_brand").alias("extra"),
        F.concat(F.lit("20"), F.lpad((F.col("p_size") % 25).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0")).alias("ym"), F.col("p_retailprice").alias("score"), F.col("p_size").cast("long").alias("favorite"),
    )


def catalog(spark: SparkSession, d: str, name: Column | None = None) -> Q.Catalog:
    """Works as a catalog: dates on the first of their month, the brand as summary."""
    docs = works(spark, d, name).select(
        "*", F.col("source_id").alias("rowid"), F.col("name_cn").alias("name"), F.concat("ym", F.lit("-01")).alias("date"), F.substring_index("extra", "、", -1).alias("summary"), F.lit("").alias("relations"), F.lit("").alias("infobox")
    )
    postings, lengths = Q.build_postings(docs.select(F.col("rowid").alias("doc_id"), "name", F.concat_ws(" ", "summary", F.regexp_replace("extra", "^标签：", "")).alias("body")))
    meta = spark.createDataFrame([("source_date", "2026-08-01")], "key string, value string")
    return Q.Catalog(docs, postings, lengths, meta)


def tool_search(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).search("promo", top_k=12, max_chars=60)


def tool_search_exact(spark: SparkSession, d: str) -> DataFrame:
    """Works that are named like the query come first."""
    named = F.when(F.col("p_partkey") % 97 == 0, "promo").when(F.col("p_partkey") % 89 == 0, F.concat(F.lit("promo "), "p_name")).otherwise(F.col("p_name"))
    return catalog(spark, d, named).search("promo", top_k=12, max_chars=60)


def tool_season(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).season(2003, 5, 20)


def tool_browse(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).browse(tag="PROMO", keyword="promo", year_from=2003, year_to=2015, min_score=905, sort="favorite", limit=40)


def tool_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).stats().select("kind", "n", "source_date")


def season_lines(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    return w.select("source_id", C.season_line(F.col("source_id"), F.col("name_cn"), F.col("ym"), F.col("score"), F.col("favorite") - 1, F.col("extra")).alias("line"))


def theme_names(spark: SparkSession, d: str) -> DataFrame:
    file = F.concat(F.lit("data/"), "s_name", F.when(F.col("s_suppkey") % 2 == 0, " - 百科合集.txt").otherwise("知识库"))
    return table(spark, d, "supplier").select("s_suppkey", C.theme_of_source(file).alias("theme"))


def registered_terms(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat_ws(" / ", F.concat(F.lit("三"), "n_name"), F.col("n_nationkey").cast("string"), F.lit("七"), F.concat(F.lit("第"), F.col("n_nationkey").cast("string"), F.lit("节")))
    return table(spark, d, "nation").select("n_nationkey", F.explode(T.register_terms(title)).alias("term"))


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term"))
    return docs.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.col("df").desc(), "term")


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _index(spark, d).stats
    return s.select("n", F.round("avg_len", 6).alias("avg_len"), F.round("avg_title_len", 6).alias("avg_title_len"))


def term_idf(spark: SparkSession, d: str) -> DataFrame:
    t = _index(spark, d).terms
    return t.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_single(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    wanted = spark.createDataFrame([(0, t) for t in TERMS], "query_id int, term string")
    found = X.match_terms(index, wanted).select("chunk_id", "matched", F.round("base", 6).alias("score"))
    return found.orderBy(F.col("score").desc(), "chunk_id").limit(10)


def _plan(terms: list[str], pin: str | None = None, k: int = 10) -> X.QueryPlan:
    return X.QueryPlan(terms, "".join(terms), [t for t in terms if 2 <= len(t) <= 8], False, pin, None, k, 300)


def bm25_fields(spark: SparkSession, d: str) -> DataFrame:
    scored = X.score_chunks(_index(spark, d), _plan(["src3", "with", "heed"]))
    return scored.orderBy(F.col("score").desc(), "chunk_id").limit(20).select("chunk_id", "title", "score")


def search_flagship(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks for a query, with snippets."""
    return X.search(_index(spark, d), "thing with heed", top_k=8)


def search_batch(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return X.search_batch(_index(spark, d), asked).select("query_id", "rank", "chunk_id", "score")


def phrase_bonus(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks by score, texts of others unread."""
    plan = _plan(["thing", "heed"])
    return X.rank_chunks(X.best_chunks(_index(spark, d), plan), plan, profile=False).select("rank", "chunk_id", "title", "score")


def pin_rank(spark: SparkSession, d: str) -> DataFrame:
    plan = _plan(["with", "heed"], pin="src3|src7")
    ranked = X.rank_chunks(X.score_chunks(_index(spark, d), plan), plan)
    return ranked.select("rank", "chunk_id", "title", "score")


def topics(spark: SparkSession, d: str) -> DataFrame:
    return X.topics(chunks(spark, d))


def fts_prefix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("name"), F.col("text").alias("body"))
    found = Q.full_text(*Q.build_postings(docs), ["thing", "src1"])
    return found.select("doc_id", F.round("relevance", 6).alias("relevance")).orderBy(F.col("relevance").desc(), "doc_id").limit(20)


def season_list(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(
        F.lit("subject").alias("kind"), F.lit(2).alias("subject_type"), F.col("o_orderkey").alias("source_id"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_totalprice").alias("favorite"), F.lit(None).cast("double").alias("score"),
    )
    return Q.season(o, C.quarter(1996, 8, (2001, 8))[2], 20).select("source_id", "date", F.round("favorite", 2).alias("favorite"), "total")


def browse_filter(spark: SparkSession, d: str) -> DataFrame:
    found = Q.facets(works(spark, d), 2, tag="promo", year_from=2003, year_to=2015, min_score=905)
    return found.orderBy(*Q.browse_order("score")).limit(15).select("source_id", "ym", F.round("score", 2).alias("score"), "favorite")


def browse_texts(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    return w.select("source_id", C.result_title(F.col("kind"), F.col("source_id"), F.col("name_cn")).alias("title"), C.compose(20, F.col("extra"), F.col("ym")).alias("text"))


def stats_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return Q.stats_by_kind(table(spark, d, "documents").select(F.col("lang").alias("kind")))


def heat_keep(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    counts = lambda key, by: F.create_map(F.lit(key), F.floor(F.col("o_totalprice") / by).cast("long"))
    subjects = o.select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), counts("10", 1000).alias("score_details"), counts("done", 100000).alias("favorite"))
    cfg = E.BuildConfig(AS_OF, votes=100, votes_oldest=400, favorites=4, favorites_oldest=9, oldest_year=1996, new_months=2)
    return E.heat_keep(subjects, cfg).select(F.col("id").alias("o_orderkey"))


def keep_semi(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("subject_id"), F.col("l_partkey").alias("part_id"))
    return E.keep_related(edges, heat_keep(spark, d).select(F.col("o_orderkey").alias("id")), "part_id").select(F.col("id").alias("part_id"))


def relation_summary(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("what"))
    edges = table(spark, d, "lineitem").join(parts, "l_partkey")
    return E.top_labels(edges, "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], F.col("what"), 5, "summary").select(F.col("id").alias("l_orderkey"), "summary")


def labelled_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with labels from a small dictionary, unlabelled ones kept."""
    nations = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("job"))
    people = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").join(nations, "c_nationkey", "left")
    return people.select("c_custkey", E._labelled(F.col("c_name"), F.col("job")).alias("label"))


def graph_links(spark: SparkSession, d: str) -> DataFrame:
    """Edges of which both ends are kept."""
    none = lambda *names: spark.createDataFrame([], ", ".join(f"{n} long" for n in names))
    src = {
        "subject-persons": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("subject_id"), F.col("l_suppkey").alias("person_id"), F.col("l_linenumber").alias("position")),
        "subject-characters": none("subject_id", "character_id", "type"), "subject-relations": none("subject_id", "related_subject_id", "relation_type"),
        "person-characters": none("person_id", "character_id", "subject_id"), "person-relations": none("person_id", "related_person_id", "relation_type"),
    }
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    suppliers = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    links = E.links_table(src, {"subject": orders, "person": suppliers, "character": none("id")})
    return links.groupBy(F.col("target_id").alias("l_suppkey")).agg(F.count("*").alias("links"))


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text")
    return K.first_of_equal(rows, ["doc_id"]).select("doc_id")


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    w = K.chunk_windows(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return w.select(F.col("doc").alias("doc_id"), F.col("start").cast("long").alias("start"), F.md5("text").alias("text_md5"))


def readable_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", L.readable(F.col("text")).alias("readable"), L.low_value(F.col("text"), F.lit("")).alias("low"))


def strip_links(spark: SparkSession, d: str) -> DataFrame:
    box = F.concat(F.lit("页："), F.col("page_id").cast("string"), F.lit(" / 官网："), "url", F.lit(" / 域："), F.regexp_extract("url", "://([^/]+)", 1), F.lit(" / twitter：@x / 身高：153cm"))
    return table(spark, d, "pages").select("page_id", T.strip_links(box).alias("text"))


def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.truncate_around(F.col("text"), F.lit("heed"), 300)).alias("snippet_md5"))


def sentence_cut(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(T.truncate_at_sentence(F.col("text"), 200)).alias("n"))


def near_in_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.near_in_order(F.lit("tre"), F.col("text")).alias("near"))


def infobox(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("{{Infobox x\n|原名= "), "p_name", F.lit("\n|类型= [["), "p_type", F.lit("]]\n|空=\n}}"))
    return table(spark, d, "part").select("p_partkey", C.infobox_text(raw).alias("box"), C.alias_text(raw).alias("alias"))


def last_edits(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit('{"lastmod":" 此页面最后编辑于2026年'), (F.col("page_id") % 12 + 1).cast("string"), F.lit("月"), (F.col("page_id") % 28 + 1).cast("string"), F.lit('日"}'))
    return table(spark, d, "pages").select("page_id", last_edit(F.when(F.col("page_id") % 5 > 0, page)).alias("edited"))


def delete_listed(spark: SparkSession, d: str) -> DataFrame:
    rest, _ = catalog(spark, d).delete("subject:3, subject:5, person:7, junk")
    left = rest.lengths.agg(F.count("*").alias("sized"))
    return rest.docs.groupBy("kind").agg(F.count("*").alias("n"), F.sum("source_id").alias("ids")).crossJoin(F.broadcast(left))  # one row


def tag_popularity(spark: SparkSession, d: str) -> DataFrame:
    tags = works(spark, d).select(F.explode(F.split(F.substring_index("extra", "标签：", -1), "、")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag").limit(10)


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = event_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


def ordered_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.withColumn("n", rank).select("conv_id", "n", F.length("text").alias("size"))


def queries() -> dict:
    found = (
        token_stats, index_stats, term_idf, bm25_single, bm25_fields, search_flagship, search_batch, phrase_bonus, pin_rank, topics, fts_prefix, season_list, browse_filter, browse_texts, tool_search, tool_search_exact, tool_season, tool_browse, tool_stats, season_lines, theme_names, registered_terms, stats_by_kind, heat_keep, keep_semi,
        relation_summary, labelled_edges, graph_links, dedupe_first, chunk_windows, readable_filter, strip_links, snippet, sentence_cut, near_in_order, infobox, last_edits, delete_listed, tag_popularity, event_windows, ordered_turns,
    )
    return {f.__name__: f for f in found}


_TOKENS = r"""tok AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
ttok AS (SELECT doc_id, unnest(regexp_extract_all(lower(source), '[\p{L}\p{N}]+')) AS term FROM documents),
len AS (SELECT doc_id, count(*) AS text_len FROM tok GROUP BY 1),
tlen AS (SELECT doc_id, count(*) AS title_len FROM ttok GROUP BY 1),
chunk AS (SELECT d.doc_id, d.source, d.text, len.text_len, greatest(coalesce(tlen.title_len, 0), 1) AS title_len FROM documents d JOIN len USING (doc_id) LEFT JOIN tlen USING (doc_id)),
post AS (SELECT doc_id, term, sum(x) AS text_tf, sum(y) AS title_tf FROM (SELECT doc_id, term, 1 AS x, 0 AS y FROM tok UNION ALL SELECT doc_id, term, 0, 1 FROM ttok SEMI JOIN len USING (doc_id)) GROUP BY 1, 2),
stats AS (SELECT count(*) AS n, avg(text_len) AS al, avg(title_len) AS tl FROM chunk),
terms AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY 1)"""
_WEIGHT = """CASE WHEN text_tf > 0 THEN idf * text_tf * 2.5 / (text_tf + 1.5 * (0.25 + 0.75 * text_len / al)) ELSE 0 END
+ CASE WHEN title_tf > 0 THEN 2.2 * idf * title_tf * 2.5 / (title_tf + 1.5 * (0.25 + 0.75 * title_len / tl)) ELSE 0 END"""
_WORKS = """works AS (SELECT p_partkey AS source_id, p_name, '标签：' || p_type || '、' || p_brand AS extra,
'20' || lpad((p_size % 25)::VARCHAR, 2, '0') || '-' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') AS ym, p_retailprice AS score, p_size::BIGINT AS favorite FROM part)"""
_HEAT = """heat AS (SELECT o_orderkey FROM (SELECT *, year(o_orderdate) AS y FROM orders) WHERE
floor(o_totalprice / 1000) >= CASE WHEN y <= 1996 THEN 400 WHEN y >= 2001 THEN 100 ELSE round_even(400 - 300 * ((y - 1996) / 5.0), 0) END
OR floor(o_totalprice / 100000) >= CASE WHEN y <= 1996 THEN 9 WHEN y >= 2001 THEN 4 ELSE round_even(9 - 5 * ((y - 1996) / 5.0), 0) END
OR CASE WHEN o_orderdate::DATE > DATE '2001-08-01' THEN o_orderdate::DATE <= DATE '2001-08-01' + 1095 AND floor(o_totalprice / 100000) > 0 ELSE o_orderdate::DATE >= DATE '2001-08-01' - 60 END)"""


#: From ``a`` (doc_id, text, p), the place of what a snippet is opened around, to ``shown`` (doc_id, cut).
_HEAD = "left(text, 300)"
_SNIPPET = f"""b AS (SELECT *, length(text) AS n, greatest(p - 1 - 105, 0) AS s FROM a), b2 AS (SELECT *, least(s + 300, n) AS e FROM b),
c AS (SELECT *, CASE WHEN s > 0 THEN CASE WHEN strpos(substr(text, s + 1), chr(10)) > 0 THEN s + strpos(substr(text, s + 1), chr(10)) ELSE 0 END ELSE 0 END AS ls, CASE WHEN strpos(reverse(substr(text, s + 1, e - s)), chr(10)) > 0 THEN e - strpos(reverse(substr(text, s + 1, e - s)), chr(10)) ELSE -1 END AS le0 FROM b2),
d AS (SELECT *, CASE WHEN le0 > ls THEN le0 ELSE e END AS le FROM c), f AS (SELECT *, contains(text, chr(10)) AND le - ls >= 80 AS al FROM d), g AS (SELECT *, CASE WHEN al THEN ls ELSE s END AS x, CASE WHEN al THEN le ELSE e END AS y FROM f),
shown AS (SELECT doc_id, CASE WHEN n <= 300 THEN text WHEN p = 0 THEN CASE WHEN contains({_HEAD}, chr(10)) AND 300 - strpos(reverse({_HEAD}), chr(10)) >= 150 THEN left(text, 300 - strpos(reverse({_HEAD}), chr(10)) + 1) ELSE {_HEAD} END
ELSE CASE WHEN x > 0 THEN '…' ELSE '' END || substr(text, x + 1, y - x) || CASE WHEN y < n THEN '…' ELSE '' END END AS cut FROM g)"""


def _scored(terms: list[str], near: str = "0", flat: str | None = None, phrases: list[str] | None = None, over: str = "1") -> str:
    """CTEs that end in ``scored`` (doc_id, source, text, score) for a list of terms, as ``score_chunks`` scores them."""
    listed, n = ", ".join(f"'{t}'" for t in terms), len(terms)
    flat, phrases = "".join(terms) if flat is None else flat, terms if phrases is None else phrases
    bonus = " + ".join([f"CASE WHEN contains(lower(text), '{flat}') THEN 0.5 ELSE 0 END"] + [f"CASE WHEN contains(lower(text), '{t}') THEN 0.18 ELSE 0 END" for t in phrases[:3]])
    return f"""{_TOKENS},
base AS (SELECT doc_id, sum({_WEIGHT}) AS base, count(*) AS m, sum((title_tf > 0)::INT) AS it, list(term) FILTER (title_tf > 0) AS titled FROM post JOIN terms USING (term) JOIN chunk USING (doc_id), stats WHERE term IN ({listed}) GROUP BY 1),
cov AS (SELECT *, base * (0.4 + 0.6 * m / {n}) * CASE WHEN m = {n} AND it = {n} THEN 1.8 ELSE 1 END AS s FROM base),
scored AS (SELECT doc_id, source, text, round((s + ({bonus}) * greatest(s, 1)) * ({over}) + ({near}), 3) AS score FROM cov JOIN chunk USING (doc_id))"""


_TOOL_SEARCH = r""", t AS (SELECT source_id, p_name, p_name AS name, extra, substr(extra, 4) AS tags FROM works), tk AS (SELECT source_id, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+')) AS w, 8 AS f FROM t UNION ALL
SELECT source_id, unnest(regexp_extract_all(lower(split_part(extra, '、', 2) || ' ' || tags), '[\p{L}\p{N}]+')), 1 FROM t), sz AS (SELECT source_id, count(*) AS size FROM tk GROUP BY 1), st AS (SELECT count(*) AS n, avg(size) AS a FROM sz),
h AS (SELECT 0 AS p, source_id, sum(f) AS f FROM tk WHERE w = 'promo' GROUP BY 2 UNION ALL SELECT 1, source_id, sum(f) FROM tk WHERE starts_with(w, 'promo') GROUP BY 2), np AS (SELECT p, count(*) AS k FROM h GROUP BY 1),
r AS (SELECT source_id, sum(CASE WHEN ln((n - k + 0.5) / (k + 0.5)) > 0 THEN ln((n - k + 0.5) / (k + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / a))) AS rel FROM h JOIN np USING (p) JOIN sz USING (source_id), st GROUP BY 1),
x AS (SELECT source_id, p_name, rel, extra || chr(10) || split_part(extra, '、', 2) AS whole FROM r JOIN t USING (source_id) ORDER BY lower(p_name) = 'promo' DESC, rel DESC, source_id LIMIT 12)
SELECT '条目#' || source_id || ' ' || p_name AS title, CASE WHEN length(whole) > 60 THEN rtrim(left(whole, 60), ' ' || chr(10)) || '…' ELSE whole END AS text, round(rel, 3) AS score FROM x"""


def oracle_sql() -> dict[str, str]:
    p = "strpos(lower(text), 'heed')"
    return {
        "token_stats": r"""SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY term""",
        "index_stats": f"WITH {_TOKENS} SELECT n, round(al, 6) AS avg_len, round(tl, 6) AS avg_title_len FROM stats",
        "term_idf": f"WITH {_TOKENS} SELECT term, df, round(idf, 6) AS idf FROM terms",
        "bm25_single": f"WITH {_TOKENS} SELECT doc_id AS chunk_id, count(*) AS matched, round(sum({_WEIGHT}), 6) AS score FROM post JOIN terms USING (term) JOIN chunk USING (doc_id), stats WHERE term IN {TERMS} GROUP BY 1 ORDER BY score DESC, chunk_id LIMIT 10",
        "bm25_fields": f"WITH {_scored(['src3', 'with', 'heed'], near='CASE WHEN NOT list_contains(coalesce(titled, []), $$src3$$) AND regexp_matches(source, $$s.{0,5}r.{0,5}c.{0,5}3$$) THEN 5.4 ELSE 0 END')} SELECT doc_id AS chunk_id, source AS title, score FROM scored WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 20",
        "search_batch": rf"""WITH {_TOKENS}, q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark), qn AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
b AS (SELECT item_id, doc_id, sum({_WEIGHT}) AS base, count(*) AS m, sum((title_tf > 0)::INT) AS it FROM q JOIN post USING (term) JOIN terms USING (term) JOIN chunk USING (doc_id), stats GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, round(base * (0.4 + 0.6 * m / n) * CASE WHEN m = n AND it = n THEN 1.8 ELSE 1 END, 3) AS score FROM b JOIN qn USING (item_id))
SELECT item_id AS query_id, rank, doc_id AS chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 4""",
        "phrase_bonus": f"""WITH {_scored(["thing", "heed"])} SELECT (row_number() OVER (ORDER BY score DESC, doc_id))::INT AS rank, doc_id AS chunk_id, source AS title, score FROM scored WHERE score > 0 ORDER BY rank LIMIT 10""",
        "pin_rank": f"""WITH {_scored(["with", "heed"])}, r AS (SELECT *, regexp_matches(source, 'src3|src7') AND length(text) >= 30 AS fits FROM scored WHERE score > 0),
f AS (SELECT *, fits AND row_number() OVER (PARTITION BY source, fits ORDER BY score DESC, doc_id) <= 2 AS first FROM r)
SELECT (row_number() OVER (ORDER BY first DESC, score DESC, doc_id))::INT AS rank, doc_id AS chunk_id, source AS title, score FROM f ORDER BY rank LIMIT 10""",
        "topics": "SELECT split_part(source, ' / ', 1) AS topic, min(doc_id) AS first FROM documents GROUP BY 1 HAVING topic <> '前言' AND topic <> '' ORDER BY 2",
        "fts_prefix": f"""WITH {_TOKENS}, st AS (SELECT count(*) AS n, avg(s) AS a FROM (SELECT doc_id, coalesce(text_len, 0) + coalesce(title_len, 0) AS s FROM (SELECT doc_id FROM documents) LEFT JOIN len USING (doc_id) LEFT JOIN tlen USING (doc_id))),
sz AS (SELECT doc_id, coalesce(text_len, 0) + coalesce(title_len, 0) AS size FROM (SELECT doc_id FROM documents) LEFT JOIN len USING (doc_id) LEFT JOIN tlen USING (doc_id)),
ph AS (SELECT * FROM (VALUES (0, 0, 'thing', false), (0, 1, 'thing', true), (1, 2, 'src1', false), (1, 3, 'src1', true)) v(g, p, w, pre)),
hits AS (SELECT g, p, doc_id, sum(8 * title_tf + text_tf) AS f FROM post JOIN ph ON CASE WHEN pre THEN starts_with(term, w) ELSE term = w END GROUP BY 1, 2, 3),
np AS (SELECT p, count(*) AS n_p FROM hits GROUP BY 1)
SELECT doc_id, round(sum(greatest(CASE WHEN ln((n - n_p + 0.5) / (n_p + 0.5)) > 0 THEN ln((n - n_p + 0.5) / (n_p + 0.5)) ELSE 1e-6 END, 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / a))), 6) AS relevance
FROM hits JOIN np USING (p) JOIN sz USING (doc_id), st GROUP BY 1 HAVING count(DISTINCT g) = 2 ORDER BY relevance DESC, doc_id LIMIT 20""",
        "season_list": "WITH s AS (SELECT * FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1996-07', '1996-08', '1996-09')) SELECT o_orderkey AS source_id, strftime(o_orderdate, '%Y-%m-%d') AS date, round(o_totalprice, 2) AS favorite, (SELECT count(*) FROM s) AS total FROM s ORDER BY o_totalprice DESC, date DESC, source_id LIMIT 20",
        "browse_filter": f"WITH {_WORKS} SELECT source_id, ym, round(score, 2) AS score, favorite FROM works WHERE extra ILIKE '%promo%' AND ym >= '2003-01' AND ym <= '2015-12' AND score >= 905 ORDER BY works.score DESC, favorite DESC, source_id LIMIT 15",
        "browse_texts": f"WITH {_WORKS}, t AS (SELECT *, extra || chr(10) || ym AS whole FROM works) SELECT source_id, '条目#' || source_id || ' ' || p_name AS title, CASE WHEN length(whole) > 20 THEN rtrim(left(whole, 20), ' ' || chr(10)) || '…' ELSE whole END AS text FROM t",
        "stats_by_kind": "SELECT lang AS kind, count(*) AS n FROM documents GROUP BY 1",
        "heat_keep": f"WITH {_HEAT} SELECT o_orderkey FROM heat",
        "keep_semi": f"WITH {_HEAT} SELECT DISTINCT l_partkey AS part_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM heat)",
        "relation_summary": """WITH e AS (SELECT l_orderkey, p_name, min((l_linenumber, l_partkey, l_suppkey)) AS o FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY o, p_name) AS n FROM e)
SELECT l_orderkey, string_agg(p_name, '、' ORDER BY n) AS summary FROM r WHERE n <= 5 GROUP BY 1""",
        "labelled_edges": "SELECT c_custkey, c_name || CASE WHEN n_name IS NULL THEN '' ELSE '（' || n_name || '）' END AS label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey",
        "graph_links": "SELECT l_suppkey, count(*) AS links FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1",
        "dedupe_first": r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY regexp_replace(text, '[\s\p{Z}]+', '', 'g')",
        "chunk_windows": r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents), w AS (SELECT doc_id, unnest(generate_series(0, length(t) - 1, 500)) AS start, t FROM t WHERE t <> '')
SELECT doc_id, start, md5(x) AS text_md5 FROM (SELECT doc_id, start, regexp_replace(substr(t, start + 1, 600), '^\s+|\s+$', '', 'g') AS x FROM w WHERE start = 0 OR start + 100 < length(t)) WHERE x <> ''""",
        "readable_filter": r"""SELECT conv_id, turn, length(regexp_replace(text, '[^぀-鿿가-힣]', '', 'g')) >= 2 OR length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 3 AS readable,
NOT contains(b, chr(10)) AND (length(b) < 12 OR (NOT regexp_matches(b, '[一-鿿]') AND length(b) < 60 AND NOT regexp_matches(b, '[。！？；]'))) AS low FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM conversations)""",
        "strip_links": "SELECT page_id, '页：' || page_id || ' / 身高：153cm' AS text FROM pages",
        "snippet": f"WITH a AS (SELECT doc_id, text, {p} AS p FROM documents), {_SNIPPET} SELECT doc_id, md5(cut) AS snippet_md5 FROM shown",
        "search_flagship": f"""WITH {_scored(list(TERMS))}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 ORDER BY rank LIMIT 8),
needle AS (SELECT *, lower(text) AS low FROM top), a AS (SELECT doc_id, text, strpos(low, CASE WHEN contains(low, '{''.join(TERMS)}') THEN '{''.join(TERMS)}' WHEN contains(low, 'thing') THEN 'thing' WHEN contains(low, 'with') THEN 'with' ELSE 'heed' END) AS p FROM needle), {_SNIPPET}
SELECT rank::INT AS rank, source AS title, cut AS text, score FROM top JOIN shown USING (doc_id)""",
        "tool_search": f"WITH {_WORKS}{_TOOL_SEARCH}",
        "tool_search_exact": f"WITH part AS (SELECT * REPLACE (CASE WHEN p_partkey % 97 = 0 THEN 'promo' WHEN p_partkey % 89 = 0 THEN 'promo ' || p_name ELSE p_name END AS p_name) FROM part), {_WORKS}{_TOOL_SEARCH}",
        "tool_season": f"""WITH {_WORKS}, w AS (SELECT * FROM works WHERE ym IN ('2003-04', '2003-05', '2003-06'))
SELECT 2003 AS year, 4 AS start_month, '2003年4月' AS label, (SELECT count(*) FROM w) AS total, source_id, p_name AS name, ym || '-01' AS date, score, favorite, extra FROM w ORDER BY favorite DESC, score DESC, date DESC, source_id LIMIT 20""",
        "tool_browse": f"""WITH {_WORKS} SELECT '条目#' || source_id || ' ' || p_name AS title, ym || '-01 / 评分：' || score || ' / 收藏：' || favorite || chr(10) || extra || chr(10) || split_part(extra, '、', 2) AS text, score
FROM works WHERE extra ILIKE '%promo%' AND ym >= '2003-01' AND ym <= '2015-12' AND works.score >= 905 ORDER BY favorite DESC, source_id LIMIT 40""",
        "tool_stats": "SELECT 'subject' AS kind, count(*) AS n, '2026-08-01' AS source_date FROM part",
        "season_lines": f"""WITH {_WORKS} SELECT source_id, '【' || source_id || '】' || p_name || '（开播 ' || ym || ' | 评分 ' || score || CASE WHEN favorite > 1 THEN ' | 追番 ' || (favorite - 1) ELSE '' END || '）' || chr(10) || extra AS line FROM works""",
        "theme_names": "SELECT s_suppkey, s_name AS theme FROM supplier",
        "registered_terms": "SELECT n_nationkey, term FROM (SELECT n_nationkey, '三' || n_name AS term FROM nation UNION ALL SELECT n_nationkey, '第' || n_nationkey || '节' FROM nation) WHERE length(term) BETWEEN 2 AND 12",
        "sentence_cut": "SELECT doc_id, CASE WHEN length(text) <= 200 THEN length(text) WHEN contains(left(text, 200), chr(10)) AND 200 - strpos(reverse(left(text, 200)), chr(10)) >= 100 THEN 200 - strpos(reverse(left(text, 200)), chr(10)) + 1 ELSE 200 END::INT AS n FROM documents",
        "near_in_order": """WITH a AS (SELECT item_id, text, strpos(text, 't') AS p FROM benchmark), b AS (SELECT *, strpos(substr(text, p + 1), 'r') AS g FROM a), c AS (SELECT *, strpos(substr(text, p + g + 1), 'e') AS h FROM b)
SELECT item_id, p > 0 AND g BETWEEN 1 AND 6 AND h BETWEEN 1 AND 6 AS near FROM c""",
        "infobox": "SELECT p_partkey, '原名：' || trim(p_name) || ' / 类型：' || trim(p_type) AS box, trim(p_name) AS alias FROM part",
        "last_edits": "SELECT page_id, CASE WHEN page_id % 5 > 0 THEN '2026' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') ELSE '' END AS edited FROM pages",
        "delete_listed": "SELECT 'subject' AS kind, count(*) AS n, sum(p_partkey)::BIGINT AS ids, count(*) AS sized FROM part WHERE p_partkey NOT IN (3, 5)",
        "tag_popularity": "SELECT tag, count(*) AS n FROM (SELECT unnest([p_type, p_brand]) AS tag FROM part) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10",
        "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
        "ordered_turns": "SELECT conv_id, n, length(text)::INT AS size FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INT AS n FROM conversations)",
    }
