"""Chunk search: an inverted index in tables, and field-weighted BM25 with intent rules over it."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fennwick.functions import text as T
from fennwick.operators import posting_blocks as B
from fennwick.operators import title_index as I
from fennwick.tables import materialize

# Fixed values of the ranking formula.
K1, LENGTH_SHARE = 1.5, 0.75
TITLE_BOOST = 2.2
COVERAGE = (0.4, 0.6)
TITLE_ALL = 1.8
WHOLE_BONUS, PHRASE_BONUS, PHRASES = 0.5, 0.18, 3
OVERVIEW_BOOST = 1.6
NEAR_SCORE, NEAR_FACTOR, CHARS_FACTOR = 1.8, 3.0, 1.8
PIN_LIMIT, PIN_LENGTH = 2, 30
# Fixed values of the intent rules.
SUBJECTIVE, SUBJECT_TERM = r"可爱|好看|漂亮|萌|颜值|魅力|喜欢", "萌点"
CROWN, CROWN_TERM, CONTEST = r"萌王|燃王", "冠军", r"(?i)世萌|B萌|萌战"
ROSTER_TERM, MEME_CHAR, POPULAR = "角色", "梗", "人气"
PIN_ROSTER, PIN_MEME, PIN_CROWN, PIN_POPULAR = r"登场角色一览|角色萌点一览", r"用语与梗", r"得主|历年结果|举办日期及结果", r"小组赛|赛果"
PROFILE_SECTION = "基本信息"
#: Bytes of a row group of stored chunks: few texts are read for each one sought.
ROW_GROUP = 4 << 20


@dataclass
class ChunkIndex:
    """Tables chunks (chunk_id, title, text, text_len, title_len), postings (term, chunk_id, text_tf, title_tf, text_len,
    title_len), terms (term, df, idf) and stats (one row: n, avg_len, avg_title_len).

    A stored index keeps its postings in ``blocks`` (``postings`` decodes them), and a dictionary of its ``titles`` with
    their ``grams``; ``numbers`` is the row of stats, read once. Its folder may hold several segments, as a stream or
    several builds leave them: they are read as one index, and ``merge_indexes`` makes one of them.
    """

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    themes: list[str] = field(default_factory=list)
    segmenter: T.Segmenter = T.word_runs
    tokens: DataFrame | None = None
    blocks: DataFrame | None = None
    titles: DataFrame | None = None
    grams: DataFrame | None = None
    numbers: dict | None = None

    def save(self, path: str) -> ChunkIndex:
        """Write the index and read it back. Texts are tokenized once; everything else is taken from what that wrote."""
        spark = self.chunks.sparkSession
        if self.tokens is None:
            write_segment(self.chunks, B.cut_blocks(self.postings), path)
        else:  # dealt by id, so that chunks lie in order and a task's lists of chunks are dense
            tokens = materialize(_tokens(self.tokens.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id"), self.segmenter), "index-tokens")
            if tokens.groupBy("chunk_id").count().where("count > 1").isEmpty():
                sized = tokens.select("*", *_lengths())
                blocks = B.merged_lists(materialize(B.term_lists(sized), "index-lists"))
            else:  # a chunk's counts are those of all rows of its id
                blocks = B.cut_blocks(_postings(tokens))
            write_segment(_sized(tokens), materialize(blocks, "index-blocks"), path, True)
        write_themes(spark, self.themes, path)
        return ChunkIndex.load(spark, path, self.segmenter)

    @staticmethod
    def load(spark: SparkSession, path: str, segmenter: T.Segmenter = T.word_runs) -> ChunkIndex:
        """The index in a folder, or in its folders ``segment=...`` together. Queries must be cut as its texts were: ``segmenter``."""
        parts = segments_of(spark, path)
        tables = {t: spark.read.parquet(*[f"{p}/{t}" for p in parts]) for t in ("chunks", "blocks", "terms", "stats", "titles", "grams", "themes")}
        tables = {t: df.drop("segment") for t, df in tables.items()}
        stats = _merged_stats(tables["stats"])
        numbers = stats.first().asDict()
        terms = tables["terms"]
        if len(parts) > 1:  # bounds by the averages of all segments
            tables["blocks"] = tables["blocks"].withColumn("bound", bound_of(numbers))
            terms = B.levels(tables["blocks"])
        terms = terms.withColumn("idf", F.log(1 + (F.lit(numbers["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        themes = sorted({r["theme"] for r in tables["themes"].distinct().collect()})
        return ChunkIndex(tables["chunks"], B.decoded(tables["blocks"]), terms, stats, themes, segmenter, None, tables["blocks"], tables["titles"], tables["grams"], numbers)


def segments_of(spark: SparkSession, path: str) -> list[str]:
    """The folders of an index's segments: the folder itself, or those named ``segment=...`` in it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(folder, "segment=*/stats/_SUCCESS"))
    return sorted(str(f.getPath().getParent().getParent()) for f in found or []) or [path]


def write_themes(spark: SparkSession, themes: list[str], path: str) -> None:
    spark.range(1).select(F.explode(F.array(*map(F.lit, themes)).cast("array<string>")).alias("theme")).write.mode("overwrite").parquet(f"{path}/themes")


def write_segment(chunks: DataFrame, blocks: DataFrame, path: str, ranged: bool = False) -> None:
    """Write a segment's tables: chunks by id in small row groups, blocks by term and falling bound, and what follows from them.

    ``ranged`` chunks lie in ranges of ids already. The statistics come last: a folder without them is no segment.
    """
    spark = chunks.sparkSession
    (chunks if ranged else chunks.repartitionByRange("chunk_id")).sortWithinPartitions("chunk_id").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    totals = chunks.agg(F.count("*").alias("n"), F.sum("text_len").alias("total_len"), F.sum("title_len").alias("total_title_len"))
    totals = spark.range(1).select(*[F.lit(x).cast("long").alias(c) for c, x in totals.first().asDict().items()])
    numbers = _merged_stats(totals).first().asDict()
    B.by_bound(blocks, bound_of(numbers)).write.mode("overwrite").options(**B.PACKED).parquet(f"{path}/blocks")
    B.levels(spark.read.parquet(f"{path}/blocks")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    I.title_table(chunks).repartitionByRange("name").sortWithinPartitions("name").write.mode("overwrite").parquet(f"{path}/titles")
    grams = I.gram_table(spark.read.parquet(f"{path}/titles"))
    grams.repartitionByRange("gram", "hash").sortWithinPartitions("gram", "hash").write.mode("overwrite").parquet(f"{path}/grams")
    totals.write.mode("overwrite").parquet(f"{path}/stats")


def _merged_stats(totals: DataFrame) -> DataFrame:
    """The one row (n, avg_len, avg_title_len) of one segment's totals or several."""
    summed = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total_len").alias("a"), F.sum("total_title_len").alias("b"))
    return summed.select("n", (F.col("a") / F.nullif("n", F.lit(0))).alias("avg_len"), (F.col("b") / F.nullif("n", F.lit(0))).alias("avg_title_len"))


def bound_of(numbers: dict) -> Column:
    """What a block's term adds to a chunk's score at most, without its idf."""
    average = [F.lit(float(numbers[c] or 0)) for c in ("avg_len", "avg_title_len")]
    text = F.when(F.col("top_text_tf") > 0, _weight(F.col("top_text_tf"), F.col("low_text_len"), average[0])).otherwise(0.0)
    return text + F.when(F.col("top_title_tf") > 0, TITLE_BOOST * _weight(F.col("top_title_tf"), F.col("low_title_len"), average[1])).otherwise(0.0)


def merge_indexes(spark: SparkSession, paths: list[str], out: str) -> ChunkIndex:
    """One stored index of several, whose chunk ids are moved on by what came before; no text is tokenized anew.

    Blocks keep their lists, as these go on from the block's first chunk; only their order follows the new averages.
    """
    chunks, blocks, themes, shift = None, None, set(), 0
    for path in paths:  # a few named indexes
        index = ChunkIndex.load(spark, path)
        low, high = index.chunks.agg(F.min("chunk_id"), F.max("chunk_id")).first()
        move = F.lit(shift - (low or 0))
        part = index.chunks.withColumn("chunk_id", F.col("chunk_id") + move)
        held = index.blocks.drop("bound").withColumn("first_id", F.col("first_id") + move)
        chunks, blocks = (part, held) if chunks is None else (chunks.unionByName(part), blocks.unionByName(held))
        themes |= set(index.themes)
        shift += (high or 0) - (low or 0) + 1
    write_segment(chunks, blocks, out)
    write_themes(spark, sorted(themes), out)
    return ChunkIndex.load(spark, out)


def build_index(chunks: DataFrame, themes: list[str] = (), segmenter: T.Segmenter = T.word_runs) -> ChunkIndex:
    """Index of ``chunks`` (chunk_id, title, text). Chunks without text or without any text term are left out.

    The tables are lazy; ``save`` computes each once.
    """
    rows = chunks.select("chunk_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = _tokens(rows, segmenter)
    sized, postings = _sized(tokens), _postings(tokens)
    stats = _merged_stats(sized.agg(F.count("*").alias("n"), F.sum("text_len").alias("total_len"), F.sum("title_len").alias("total_title_len")))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", idf.alias("idf"))  # one row
    return ChunkIndex(sized, postings, terms, stats, sorted({re.sub(r"\s+", "", t).lower() for t in themes}), segmenter, rows)


def _tokens(rows: DataFrame, segmenter: T.Segmenter) -> DataFrame:
    """``rows`` (chunk_id, title, text) with the terms of both; chunks without any text term are left out."""
    cut = rows.select("chunk_id", "title", "text", T.tokenize(F.col("text"), segmenter=segmenter).alias("a"), T.tokenize(F.col("title"), segmenter=segmenter).alias("b"))
    return cut.where(F.size("a") > 0)


def _lengths() -> list[Column]:
    return [F.size("a").alias("text_len"), F.greatest(F.size("b"), F.lit(1)).alias("title_len")]


def _sized(tokens: DataFrame) -> DataFrame:
    return tokens.select("chunk_id", "title", "text", *_lengths())


def _postings(tokens: DataFrame) -> DataFrame:
    """Postings of tokenized chunks. Counts are summed within a task before they are dealt by term and chunk."""
    one = lambda column, x, y: F.transform(column, lambda t: F.struct(t.alias("term"), F.lit(x).alias("x"), F.lit(y).alias("y")))
    rows = tokens.select("chunk_id", *_lengths(), F.explode(F.concat(one("a", 1, 0), one("b", 0, 1))).alias("p"))
    return rows.groupBy("p.term", "chunk_id").agg(F.sum("p.x").alias("text_tf"), F.sum("p.y").alias("title_tf"), F.first("text_len").alias("text_len"), F.first("title_len").alias("title_len"))


def topics(chunks: DataFrame, position: str = "chunk_id") -> DataFrame:
    """(topic, first) of the first parts of titles, in order of first appearance, except the foreword."""
    return chunks.groupBy(F.split("title", " / ")[0].alias("topic")).agg(F.min(position).alias("first")).where("topic <> '前言' and topic <> ''").orderBy("first")


@dataclass
class QueryPlan:
    """What a query string comes down to: terms, phrases, flags and an optional pin."""

    terms: list[str]
    flat: str
    phrases: list[str]
    overview: bool
    pin: str | None
    pin_theme: str | None
    top_k: int
    max_chars: int


def driver_terms(spark: SparkSession, text: str, segmenter: T.Segmenter) -> list[str]:
    """Distinct query terms of one short string."""
    return spark.sql("SELECT * FROM VALUES (:q) AS t(q)", args={"q": text}).select(F.array_distinct(T.tokenize(F.col("q"), True, segmenter)).alias("t")).first()["t"]


def theme_of(terms: list[str], fits: dict[str, list[str]], intent) -> str | None:
    """The first theme, by name, that holds all terms but those of the intent; ``fits`` lists the terms each theme holds."""
    rest = [t for t in terms if not intent(t)]
    return next((g for g in sorted(fits) if rest and set(rest) <= set(fits[g])), None)


def read_query(spark: SparkSession, query: str, themes: list[str], segmenter: T.Segmenter):
    """What the rules read from a query, in one row: terms, phrases, flags, and the terms that each theme holds.

    A theme holds a term as a whole or by its characters near each other in order.
    """
    q, added = F.col("q"), [F.lit(SUBJECT_TERM), F.lit(CROWN_TERM)]
    # A row of constants: the optimizer itself evaluates what is read from it, so no job runs.
    row = spark.sql("SELECT * FROM VALUES (:q) AS t(q)", args={"q": query}).select("q", T.clean_query(q).alias("cleaned"))
    row = row.select("q", "cleaned", T.tokenize(F.col("cleaned"), True, segmenter).alias("a"), T.tokenize(q, True, segmenter).alias("b"))
    row = row.select("q", "cleaned", F.array_distinct(F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b"))).alias("terms"))
    candidates = F.concat(F.col("terms"), F.array(*added))
    fits = F.transform(F.array(*map(F.lit, themes)).cast("array<string>"), lambda g: F.filter(candidates, lambda t: g.contains(t) | T.near_in_order(t, g)))
    flags = [q.rlike(CONTEST).alias("contest"), q.rlike(CROWN).alias("crown"), q.rlike(SUBJECTIVE).alias("subjective"), T.wants_overview(q).alias("overview")]
    flat = F.lower(T.squeeze(F.col("cleaned"))).alias("flat")
    return row.select("terms", T.query_phrases(F.col("cleaned")).alias("phrases"), flat, fits.alias("fits"), *flags).first()


def plan_query(spark: SparkSession, query: str, themes: list[str], top_k: int = 4, max_chars: int = 300, as_of: datetime.date | None = None, segmenter: T.Segmenter = T.word_runs) -> QueryPlan | None:
    """The plan of a query; None if it has no term. ``as_of`` gives the years of "this year" and "last year"."""
    year = (as_of or datetime.date.today()).year
    query = re.sub("去年|上年度|上届", f"{year - 1}年", re.sub("今年|本年度|本届", f"{year}年", query))
    read = read_query(spark, query, themes, segmenter)
    terms = list(read["terms"])
    if not terms:
        return None
    crown = read["crown"] or (CROWN_TERM in terms and read["contest"])
    for found, term in ((read["subjective"], SUBJECT_TERM), (crown, CROWN_TERM)):
        if found and term not in terms:
            terms.append(term)
    fits = dict(zip(themes, read["fits"]))
    pin, pin_theme = None, theme_of(terms, fits, lambda t: t == ROSTER_TERM)
    if pin_theme:
        pin, top_k, max_chars = PIN_ROSTER, min(top_k, 2), max(max_chars, 700)
    elif pin_theme := theme_of(terms, fits, lambda t: MEME_CHAR in t):
        pin = PIN_MEME
    elif crown:
        pin = PIN_CROWN
    elif POPULAR in terms and read["contest"]:
        pin = PIN_POPULAR
    return QueryPlan(terms, read["flat"], list(read["phrases"]), read["overview"], pin, pin_theme, top_k, max_chars)


def _weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - LENGTH_SHARE + LENGTH_SHARE * length / F.greatest(average, F.lit(1e-6))))


def match_terms(index: ChunkIndex, wanted: DataFrame) -> DataFrame:
    """(query_id, chunk_id, base, matched, in_title, titled) of the chunks that hold a term of ``wanted`` (query_id, term).

    Any number of queries at once: one join of the terms with the postings, which hold the lengths. Queries are few beside
    the postings, so the optimizer sends them to every task as long as they are small. Stored blocks are read for the
    terms wanted alone, and their postings dealt by chunk, so that what many queries want of a chunk is dealt once.
    """
    postings = index.postings
    if index.blocks is not None:
        postings = B.decoded(index.blocks.join(wanted.select("term").distinct(), "term", "left_semi")).repartition("chunk_id")
    weighed = postings.join(wanted.join(index.terms.select("term", "idf"), "term"), "term").crossJoin(F.broadcast(index.stats))  # one row
    text = F.when(F.col("text_tf") > 0, F.col("idf") * _weight(F.col("text_tf"), F.col("text_len"), F.col("avg_len"))).otherwise(0.0)
    title = F.when(F.col("title_tf") > 0, TITLE_BOOST * F.col("idf") * _weight(F.col("title_tf"), F.col("title_len"), F.col("avg_title_len"))).otherwise(0.0)
    return weighed.groupBy("query_id", "chunk_id").agg(F.sum(text + title).alias("base"), F.count("*").alias("matched"), F.sum((F.col("title_tf") > 0).cast("int")).alias("in_title"), F.collect_list(F.when(F.col("title_tf") > 0, F.col("term"))).alias("titled"))


def covered(base: Column, matched: Column, in_title: Column, n_terms: Column) -> Column:
    """The base score by the share of terms met, and by whether the title holds all."""
    s = base * (COVERAGE[0] + COVERAGE[1] * matched / n_terms)
    return F.when((matched == n_terms) & (in_title == n_terms), s * TITLE_ALL).otherwise(s)


def match_plan(index: ChunkIndex, terms: list[str]) -> tuple[DataFrame, set[str]]:
    """As ``match_terms`` for one query, and the terms that the index knows.

    Frequencies of the query's few terms and the one row of statistics are read first, so that its postings are found by a
    filter that reaches the scan, without a join.
    """
    stats = index.stats.first()
    known = {r["term"]: r["idf"] for r in index.terms.where(F.col("term").isin(*terms)).collect()}  # the query's terms at most
    hits = index.postings.where(F.col("term").isin(*known)) if known else index.postings.where(F.lit(False))
    idf = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.col("term")] if known else F.lit(0.0)
    average = {c: F.lit(float(stats[c] or 0)) for c in ("avg_len", "avg_title_len")}
    text = F.when(F.col("text_tf") > 0, idf * _weight(F.col("text_tf"), F.col("text_len"), average["avg_len"])).otherwise(0.0)
    title = F.when(F.col("title_tf") > 0, TITLE_BOOST * idf * _weight(F.col("title_tf"), F.col("title_len"), average["avg_title_len"])).otherwise(0.0)
    met = hits.groupBy("chunk_id").agg(F.sum(text + title).alias("base"), F.count("*").alias("matched"), F.sum((F.col("title_tf") > 0).cast("int")).alias("in_title"), F.collect_list(F.when(F.col("title_tf") > 0, F.col("term"))).alias("titled"))
    return met, set(known)


def _bonuses(plan: QueryPlan) -> list[tuple[str, float]]:
    """What a text may hold, and the share of the base score that it adds."""
    whole = [(plan.flat, WHOLE_BONUS)] if len(plan.flat) >= 2 else []
    return whole + [(p, PHRASE_BONUS) for p in plan.phrases[:PHRASES] if p != plan.flat]


def _scored(index: ChunkIndex, plan: QueryPlan) -> tuple[DataFrame, Column, Column]:
    """Candidates (chunk_id, title, _s, _near, _over), the score for a share of bonus, and the greatest share there is."""
    met, known = match_plan(index, plan.terms)
    found = met.join(index.chunks.select("chunk_id", "title"), "chunk_id")
    s = covered(F.col("base"), F.col("matched"), F.col("in_title"), F.lit(len(plan.terms)))
    near_by = F.lit(0.0)
    for term in (t for t in plan.terms if len(t) >= 2):
        extra = F.when(T.near_in_order(F.lit(term), F.col("title")), NEAR_SCORE * NEAR_FACTOR)
        if term not in known:
            extra = extra.when(F.forall(F.array(*[F.lit(c) for c in term]), lambda c: F.col("title").contains(c)), NEAR_SCORE * CHARS_FACTOR)
        near_by = near_by + F.when(~F.array_contains("titled", term), extra.otherwise(0.0)).otherwise(0.0)
    over = F.when(F.col("title").rlike("|".join(T.OVERVIEW_SECTIONS)), OVERVIEW_BOOST).otherwise(1.0) if plan.overview else F.lit(1.0)
    rows = found.select("chunk_id", "title", s.alias("_s"), near_by.alias("_near"), over.alias("_over"))

    def total(bonus: Column) -> Column:
        return F.round((F.col("_s") + bonus * F.greatest(F.col("_s"), F.lit(1.0))) * F.col("_over") + F.col("_near"), 3)

    return rows, total


def _with_text(index: ChunkIndex, plan: QueryPlan, rows: DataFrame, total) -> DataFrame:
    """(chunk_id, title, text, score) of candidates, with what their texts add."""
    low, bonus = F.lower("text"), F.lit(0.0)
    for piece, share in _bonuses(plan):
        bonus = bonus + F.when(low.contains(piece), share).otherwise(0.0)
    return rows.join(index.chunks.select("chunk_id", "text"), "chunk_id").select("chunk_id", "title", "text", total(bonus).alias("score")).where("score > 0")


def score_chunks(index: ChunkIndex, plan: QueryPlan) -> DataFrame:
    """(chunk_id, title, text, score) of the candidates with a positive score, to three places."""
    return _with_text(index, plan, *_scored(index, plan))


def best_chunks(index: ChunkIndex, plan: QueryPlan) -> DataFrame:
    """The rows of ``score_chunks`` that may be among the best ``top_k`` by score; texts of no others are read.

    A text adds a bounded share to what terms and title give, so a chunk that would stay below the k-th best even with
    all of it is passed over.
    """
    rows, total = _scored(index, plan)
    most = F.lit(float(sum(share for _, share in _bonuses(plan))))
    floor = rows.select(total(F.lit(0.0)).alias("low")).orderBy(F.col("low").desc()).limit(max(1, plan.top_k)).agg(F.min("low").alias("low"), F.count("*").alias("n")).first()
    if floor["n"] == max(1, plan.top_k):
        rows = rows.where(total(most) >= floor["low"])
    return _with_text(index, plan, rows, total)


def without_separators(text: str) -> str:
    return re.sub(r"[\s·・\-—]+", "", text)


def rank_chunks(scored: DataFrame, plan: QueryPlan, profile: bool = True) -> DataFrame:
    """The best ``top_k`` chunks with their rank: pinned ones or the profile first, then by score and chunk_id.

    Without ``profile`` none is sought. Only rows that fit a pin are ranked within their title; the others go through a top-k.
    """
    by_score, k = [F.col("score").desc(), F.col("chunk_id").asc()], max(1, plan.top_k)
    fits, most, group = F.lit(False), 1, F.lit("")
    if plan.pin:
        fits, most, group = F.col("title").rlike(plan.pin) & (F.length("text") >= PIN_LENGTH), PIN_LIMIT, F.col("title")
        if plan.pin_theme:
            fits = fits & T.squeeze(F.lower("title")).contains(plan.pin_theme)
    elif profile and len(flat := without_separators(plan.flat)) >= 2:
        parts = F.split("title", " / ")
        fits = (F.get(parts, F.lit(1)) == PROFILE_SECTION) & (F.regexp_replace(parts[0], r"(?U)[\s·・\-—]+", "") == flat)
    order = [F.col("_first").desc(), *by_score]
    # One pass over what is scored: the rows of a title that come first, and the best k of the others, are among the first k + ``most`` of their group.
    grouped = scored.withColumn("_group", F.when(F.coalesce(fits, F.lit(False)), group))
    near = grouped.withColumn("_place", F.row_number().over(Window.partitionBy("_group").orderBy(*by_score))).where(F.col("_place") <= k + most)
    best = near.withColumn("_first", F.col("_group").isNotNull() & (F.col("_place") <= most)).drop("_group", "_place").orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # top_k rows


def search(index: ChunkIndex, query: str, top_k: int = 4, max_chars: int = 300, as_of: datetime.date | None = None, segmenter: T.Segmenter | None = None) -> DataFrame:
    """(rank, title, text, score): the best chunks for a query, each cut to a window around what it met.

    A stored index is searched by its blocks (``pruned.candidates``), any other by scoring all chunks that hold a term.
    """
    from fennwick.operators import pruned  # which builds on this module

    spark = index.chunks.sparkSession
    plan = plan_query(spark, (query or "").strip(), index.themes, top_k, max_chars, as_of, segmenter or index.segmenter)
    if plan is None:
        return spark.createDataFrame([], "rank int, title string, text string, score double")
    scored, profile = pruned.candidates(index, plan) if index.blocks is not None else (None, True)
    if scored is None:
        scored = score_chunks(index, plan)
    ranked = rank_chunks(scored, plan, profile)
    ranked = ranked.withColumn("_needle", T.needle_of(F.col("text"), plan.flat, plan.terms))
    shown = T.truncate_around(F.col("text"), F.col("_needle"), max(50, plan.max_chars))
    return ranked.select("rank", "title", shown.alias("text"), "score").orderBy("rank")


def search_batch(index: ChunkIndex, queries: DataFrame, top_k: int = 4, segmenter: T.Segmenter = T.word_runs) -> DataFrame:
    """(query_id, rank, chunk_id, score) for many queries (query_id, query) in one plan: BM25 and coverage, no intents."""
    terms = queries.select("query_id", F.array_distinct(T.tokenize(F.col("query"), True, segmenter)).alias("t")).where(F.size("t") > 0)
    sized = terms.select("query_id", F.size("t").alias("n_terms"), F.explode("t").alias("term"))
    found = match_terms(index, sized.select("query_id", "term")).join(terms.select("query_id", F.size("t").alias("n_terms")), "query_id")
    scored = found.select("query_id", "chunk_id", F.round(covered(F.col("base"), F.col("matched"), F.col("in_title"), F.col("n_terms")), 3).alias("score")).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def format_results(results: DataFrame) -> DataFrame:
    """(rank, line) as shown to a reader."""
    return results.select("rank", F.concat(F.lit("【"), F.col("rank").cast("string"), F.lit("】"), F.col("title"), F.lit("（相关度 "), F.col("score").cast("string"), F.lit("）\n"), F.col("text")).alias("line"))
