"""Queries of the stored index: intents, pins and profiles, posting blocks and merging, each beside DuckDB SQL for the same rows.

Documents are chunks whose titles are their source and one of seven sections, so that every rule finds titles of its own.
"""

from __future__ import annotations

import datetime
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fennwick.operators import chunk_index as X
from fennwick.operators import word_graph as G
from fennwick.plans import queries as Q
from fennwick.tables import stage_path

SECTIONS = ("基本信息", "登场角色一览", "角色萌点一览", "用语与梗", "历年结果", "小组赛", "简介")
THEMES = ("src3", "src7")
AS_OF = datetime.date(2026, 8, 1)


def pages(spark: SparkSession, d: str) -> DataFrame:
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), (F.pmod("doc_id", F.lit(len(SECTIONS))) + 1).cast("int"))
    return Q.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat_ws(" / ", "source", section).alias("title"), "text")


@lru_cache(maxsize=4)
def _saved(application: str, d: str) -> str:
    spark = SparkSession.active()
    path = stage_path(spark, "pages-index")
    X.build_index(pages(spark, d), list(THEMES)).save(path)
    return path


def _find(spark: SparkSession, d: str, query: str, top_k: int = 8) -> DataFrame:
    index = X.ChunkIndex.load(spark, _saved(spark.sparkContext.applicationId, d))
    return X.search(index, query, top_k=top_k, as_of=AS_OF).select("rank", "title", "score")


def search_theme(spark: SparkSession, d: str) -> DataFrame:
    """A theme's roster: two chunks of its roster sections first."""
    return _find(spark, d, "src3 角色")


def search_meme(spark: SparkSession, d: str) -> DataFrame:
    return _find(spark, d, "src7 梗")


def search_crown(spark: SparkSession, d: str) -> DataFrame:
    return _find(spark, d, "世萌 thing 萌王")


def search_popular(spark: SparkSession, d: str) -> DataFrame:
    return _find(spark, d, "世萌 人气 thing")


def search_profile(spark: SparkSession, d: str) -> DataFrame:
    """A name alone: its profile first."""
    return _find(spark, d, "src5")


def search_subjective(spark: SparkSession, d: str) -> DataFrame:
    return _find(spark, d, "可爱 thing")


def search_overview(spark: SparkSession, d: str) -> DataFrame:
    return _find(spark, d, "heed thing 是什么")


def posting_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What the stored blocks decode to, by term."""
    sums = [F.sum(c).alias(c) for c in ("chunk_id", "text_tf", "title_tf", "text_len", "title_len")]
    return Q._index(spark, d).postings.groupBy("term").agg(F.count("*").alias("n"), *sums)


def merged_index(spark: SparkSession, d: str) -> DataFrame:
    """Terms of an index that is merged from two, of even and of odd documents."""
    rows, paths = Q.chunks(spark, d), [stage_path(spark, "half") for _ in range(3)]
    for k, path in enumerate(paths[:2]):
        X.build_index(rows.where(F.pmod("chunk_id", F.lit(2)) == k)).save(path)
    return X.merge_indexes(spark, paths[:2], paths[2]).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def word_graph(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts without their spaces, cut into words by the frequencies of all words in names and types."""
    parts = Q.table(spark, d, "part")
    words = parts.select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))
    texts = parts.select(F.col("p_partkey").alias("id"), F.regexp_replace(F.concat("p_name", F.lit("zq"), "p_type"), " ", "").alias("text"))
    return G.segment(texts, words, pattern="[a-z]+", search=False).select(F.col("id").alias("p_partkey"), F.array_join("terms", " ").alias("terms"))


def queries() -> dict:
    found = (search_theme, search_meme, search_crown, search_popular, search_profile, search_subjective, search_overview, posting_blocks, merged_index, word_graph)
    return {f.__name__: f for f in found}


_PAGES = f"documents AS (SELECT doc_id, source || ' / ' || [{', '.join(repr(s) for s in SECTIONS)}][doc_id % {len(SECTIONS)} + 1] AS source, text FROM documents)"


def _near(term: str) -> str:
    """What a title that lacks a term adds for it: its characters near each other in order, or else, if no chunk has it, all in it."""
    walk = f"list_reduce(range(2, {len(term) + 1}), lambda p, i: CASE WHEN p > 0 AND strpos(substr(source, p + 1), '{term}'[i]) BETWEEN 1 AND 6 THEN p + strpos(substr(source, p + 1), '{term}'[i]) ELSE 0 END, strpos(source, '{term[0]}'))"
    every = " AND ".join(f"contains(source, '{c}')" for c in term)
    return f"CASE WHEN list_contains(coalesce(titled, []), '{term}') THEN 0 WHEN {walk} > 0 THEN 5.4 WHEN NOT EXISTS (SELECT 1 FROM terms WHERE term = '{term}') AND {every} THEN 3.24 ELSE 0 END"


def _ranked(terms: list[str], flat: str, phrases: list[str], first: str = "false", most: str = "first_place <= 2", over: str = "1", k: int = 8) -> str:
    near = " + ".join(_near(t) for t in terms if len(t) >= 2) or "0"
    return f"""WITH {_PAGES}, {Q._scored(terms, near, flat, phrases, over)}, r AS (SELECT *, {first} AS fits FROM scored WHERE score > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY fits, {"source" if most == "first_place <= 2" else "true"} ORDER BY score DESC, doc_id) AS first_place FROM r),
g AS (SELECT *, fits AND {most} AS first FROM f) SELECT (row_number() OVER (ORDER BY first DESC, score DESC, doc_id))::INT AS rank, source AS title, score FROM g ORDER BY rank LIMIT {k}"""


def oracle_sql() -> dict[str, str]:
    pin = lambda words, theme="": f"regexp_matches(source, '{words}') AND length(text) >= 30" + (f" AND contains(regexp_replace(lower(source), '\\s+', '', 'g'), '{theme}')" if theme else "")
    return {
        "search_theme": _ranked(["src3", "角色"], "src3角色", ["src3", "角色"], pin("登场角色一览|角色萌点一览", "src3"), k=2),
        "search_meme": _ranked(["src7", "梗"], "src7梗", ["src7"], pin("用语与梗", "src7")),
        "search_crown": _ranked(["世萌", "thing", "萌王", "萌点", "冠军"], "世萌thing萌王", ["世萌", "thing", "萌王"], pin("得主|历年结果|举办日期及结果")),
        "search_popular": _ranked(["世萌", "人气", "thing", "萌点"], "世萌人气thing", ["世萌", "人气", "thing"], pin("小组赛|赛果")),
        "search_profile": _ranked(["src5"], "src5", [], "source = 'src5 / 基本信息'", "first_place = 1"),
        "search_subjective": _ranked(["可爱", "thing", "萌点"], "可爱thing", ["可爱", "thing"]),
        "search_overview": _ranked(["heed", "thing"], "heedthing", ["heed", "thing"], over="CASE WHEN regexp_matches(source, '简介|基本信息|介绍|概述|游戏简介|设定') THEN 1.6 ELSE 1 END"),
        "posting_blocks": f"WITH {Q._TOKENS} SELECT term, count(*) AS n, sum(doc_id)::BIGINT AS chunk_id, sum(text_tf)::BIGINT AS text_tf, sum(title_tf)::BIGINT AS title_tf, sum(text_len)::BIGINT AS text_len, sum(title_len)::BIGINT AS title_len FROM post JOIN chunk USING (doc_id) GROUP BY 1",
        "merged_index": f"WITH {Q._TOKENS} SELECT term, df, round(idf, 6) AS idf FROM terms",
        "word_graph": """WITH w AS (SELECT term, count(*) AS freq FROM (SELECT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS term FROM part) WHERE term <> '' GROUP BY 1), t AS (SELECT ln(sum(freq)) AS total FROM w),
r AS (SELECT p_partkey, lower(replace(p_name || 'zq' || p_type, ' ', '')) AS run FROM part), d AS (SELECT DISTINCT run FROM r), at_ AS (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM d),
p AS (SELECT run, i, unnest(range(1, least(16, length(run) - i + 1) + 1)) AS n FROM at_),
e AS (SELECT run, i, n, ln(coalesce(freq, 1)::DOUBLE) - total AS wt FROM p LEFT JOIN w ON term = substr(run, i, n), t WHERE freq IS NOT NULL OR n = 1),
g AS (SELECT run, i, [list(n::DOUBLE ORDER BY n), list(wt ORDER BY n)] AS e FROM e GROUP BY 1, 2),
f AS (SELECT run, list_reduce(list(e ORDER BY i DESC), lambda acc, e: list_transform([list_sort(list_transform(range(1, len(e[1]) + 1), lambda j: [e[2][j] + acc[1][e[1][j]::INT], e[1][j]]), 'DESC')[1]],
  lambda b: [list_prepend(b[1], acc[1]), list_prepend(b[2], acc[2])])[1], [[0.0::DOUBLE], []::DOUBLE[]])[2] AS lens FROM g GROUP BY 1),
s AS (SELECT run, lens, list_reduce(list_transform(range(1, length(run) + 1), lambda i: [i::DOUBLE]), lambda a, x: CASE WHEN a[1] = x[1] THEN list_prepend(x[1] + lens[x[1]::INT], list_append(a[2:], x[1])) ELSE a END, [1.0::DOUBLE])[2:] AS starts FROM f)
SELECT p_partkey, array_to_string(list_transform(starts, lambda k: substr(run, k::INT, lens[k::INT]::INT)), ' ') AS terms FROM r JOIN s USING (run)""",
    }
