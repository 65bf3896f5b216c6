"""Personal data: pattern spans, and terms that disclose them by an information-theoretic measure.

Everything is a DataFrame expression; no Python runs on the executors.

Base spans (e-mail, IP, card, phone) come from patterns. Two classes c are protected for each: the value itself, and the
group it belongs to (a mail domain, a network, a card issuer, a phone area), so that what points to a group is weighed
on the evidence of all texts that name one of it. The words of the sentence (of the text, if ``sentence`` is false), at
most ``words`` words away, are candidate terms t. Over all documents the corpus gives n(c), n(t) and n(c, t), the
documents that hold the class, the term, and the term beside the class, and from these

    p(c | t) = (n(c, t) + a n(c) / N) / (n(t) + a),    disclosure(c, t) = log(p(c | t) N / n(c)) / log(N / n(c)),

PMI over IC with p(c | t) shrunk towards n(c) / N by ``prior`` a, as if the term had stood in so many more texts at
random. It nears 1 as the evidence grows that the term only ever occurs beside the class, stays lower for a term seen
once, and is 0 when the two are independent. It changes smoothly with a table's size. Documents are counted over distinct
texts. From ``generalise`` on the term is generalised wherever it stands in the documents that hold the class; from
``remove`` on it discloses the class by itself, and is removed wherever it stands in any document.

A term is generalised along a hierarchy: numbers by their leading digits, 20345 to 2034*, 203** and so on, which are
counted over the corpus like terms, and the first is taken that discloses none of the text's classes; what is left
becomes [NUMBER], and other words [NAME] or [TERM].

The work grows with a text's length, however many spans it holds: places come from running sums by blocks, texts are
rewritten from blocks of bounded length, an entity has a bounded number of words beside it, and the places of terms
are found by a join of a text's words with the terms wanted in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennwick.llm.common import bit_test, materialize, once_each, table

# The kinds of base spans, in the order that breaks ties.
KINDS = ("email", "ip", "card", "phone")
# The base patterns. Runs are possessive and start where the last match ended or a run begins, which
# finds the same spans as the plain patterns without reading a run more than once.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind's spans to be sought at all; each is met wherever a valid span is.
HINTS = {"ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){11}"}

#: Words on either side of an entity, within its sentence, that may disclose it.
WORDS = 32
GENERALISE = 0.85
REMOVE = 0.97
#: The least digits of a term without letters; words may have any length.
MIN_TERM = 3
#: Texts in which a term counts as having stood at random, besides those it was seen in.
PRIOR = 0.5
#: The most leading digits that a generalised number keeps.
LEADING = 6
SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"
PLACES = "array<struct<start:int,end:int,term:string,mask:string>>"
TERM = r"[\p{L}\p{N}]++"
SENTENCE = r"[\n\r]++|(?<=[.!?])\s++|(?<=[。！？])"
#: Stand around an entity that is written into a text as one word; words that touch it are part of it.
OPEN, SHUT = "", ""
#: Code points of a block of text, and words of a row of a long sentence.
BLOCK, ROW_WORDS = 256, 512


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, most: bool = False) -> Column:
    """For each place of an array of integers the sum (or the greatest) of those before it; 0 for the first.

    By blocks of about the square root of the array's length: an array that grows by one is copied whole each time.
    """
    join = (lambda a, v: F.greatest(a, v)) if most else (lambda a, v: a + v)

    def walk(block: Column, first: Column) -> Column:
        state = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, state, lambda s, v: F.struct(join(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def whole(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / width).cast("int") - 1, F.lit(0))), lambda k: F.slice(v, k * width + 1, width))
        totals = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0), join))
        return _let(blocks, lambda bs: _let(walk(totals(bs), F.lit(0)), lambda heads: F.flatten(F.zip_with(bs, heads, walk))))

    return _let(values, whole)


def placed(text: Column, pattern: str) -> Column:
    """array(struct(start, end, value)) of a pattern's matches in code points, in order, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def at(f: Column, g: Column, e: Column) -> Column:
        begin = lambda i: F.get(e, i) + F.get(g, i)
        return F.transform(f, lambda v, i: F.struct(begin(i).alias("start"), (begin(i) + F.length(v)).alias("end"), v.alias("value")))

    return _let(found, lambda f: _let(gaps, lambda g: _let(running(F.transform(f, lambda v, i: F.get(g, i) + F.length(v))), lambda e: at(f, g, e))))


def _between(blocks: Column, a: Column, b: Column) -> Column:
    """The text from code point a to b (exclusive) of a text in blocks."""
    i, j = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
    first = F.substring(F.get(blocks, i), a % BLOCK + 1, F.least(b, (i + 1) * BLOCK) - a)
    rest = F.concat(F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(blocks, j), F.lit(1), b - j * BLOCK))
    return F.when(b <= a, "").when(i == j, first).otherwise(F.concat(first, rest))


def rewritten(text: Column, edits: Column, mask) -> Column:
    """A text with each edit (an array of structs with start and end, by start) replaced by ``mask(edit, read)``.

    ``read`` is how far edits before it reach; what they cover already isn't written again.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def write(b: Column, e: Column, read: Column) -> Column:
        pieces = F.transform(e, lambda x, i: F.concat(_between(b, F.get(read, i), x["start"]), mask(x, F.get(read, i))))
        last = F.aggregate(e, F.lit(0), lambda a, x: F.greatest(a, x["end"]))
        return F.concat(F.array_join(pieces, ""), _between(b, last, F.length(text)))

    done = _let(blocks, lambda b: _let(edits, lambda e: _let(running(F.transform(e, lambda x: x["end"]), most=True), lambda read: write(b, e, read))))
    return F.when(F.size(edits) > 0, done).otherwise(text)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(k: Column) -> Column:
        d = F.substring(F.reverse(digits), k, F.lit(1)).cast("int")
        return F.when(k % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        # Parts may have any number of digits: leading zeros aside, at most 255.
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return n.between(12, 19) & _luhn(F.when(n.between(12, 19), _digits(value)).otherwise("0"))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _hint(text: Column, kind: str) -> Column:
    """Whether a text may hold spans of a kind; the cheap tests come first."""
    if kind in ("email", "phone"):
        return text.contains("@" if kind == "email" else "+")
    return text.rlike("[0-9]") & text.rlike(HINTS[kind])


def may_hold(text: Column) -> Column:
    """False only for texts without any base span."""
    marks = text.contains("@") | text.contains("+")
    return F.coalesce(marks | (text.rlike("[0-9]") & (text.rlike(HINTS["ip"]) | text.rlike(HINTS["card"]))), F.lit(False))


def spans_of(text: Column, kind: str) -> Column:
    """Array of (start, rank, kind, end, value) of a kind's spans in code points, in order, end exclusive."""
    rank = KINDS.index(kind)
    fine = F.filter(placed(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    spans = F.transform(fine, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
    return F.when(_hint(text, kind), spans).otherwise(F.array().cast(f"array<{SPAN}>")).cast(f"array<{SPAN}>")


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind; null text has none."""
    return F.array_sort(F.concat(*[spans_of(F.coalesce(text, F.lit("")), k) for k in KINDS]))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is_term(word: Column) -> Column:
    return (F.length(word) >= MIN_TERM) | word.rlike(r"\p{L}")


def terms_of(text: Column) -> Column:
    """Distinct lower-case terms of a text: runs of letters and digits, as they are in the text before it is lowered."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), _is_term)
    return F.array_distinct(F.transform(words, F.lower))


def entity_of(span: Column) -> Column:
    """A span's entity: e-mail addresses without regard to case, numbers by their digits."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def group_of(entity: Column) -> Column:
    """The group of an entity: a mail domain, a network of three parts, six digits of a card, four of a phone number."""
    kind, value = F.substring_index(entity, ":", 1), F.regexp_replace(entity, "^[a-z]+:", "")
    network = F.concat(F.substring_index(value, ".", 3), F.lit(".*"))
    digits = F.concat(F.substring(value, F.lit(1), F.when(kind == "card", 6).otherwise(4)), F.lit("*"))
    mail = F.concat(F.lit("*@"), F.substring_index(value, "@", -1))
    return F.concat_ws(":", kind, F.when(kind == "email", mail).when(kind == "ip", network).otherwise(digits))


def classes_of(entity: Column) -> Column:
    """The protected classes of an entity: itself and its group."""
    return _let(entity, lambda e: F.array(e, group_of(e)))


def ancestors(term: Column) -> Column:
    """What a number generalises to, most specific first: its leading digits, ``LEADING`` at most; none for words."""
    n = F.length(term)
    levels = F.transform(F.sequence(F.least(n - 1, F.lit(LEADING)), F.lit(1), F.lit(-1)), lambda k: F.concat(F.substring(term, F.lit(1), k), F.repeat(F.lit("*"), n - k)))
    return F.when(term.rlike("^[0-9]{2,}$"), levels).otherwise(F.array().cast("array<string>"))


def levels_of(terms: Column) -> Column:
    """Distinct terms with the ancestors of those that are numbers; an ancestor holds a ``*``, which no term does."""
    return _let(terms, lambda ts: F.array_distinct(F.concat(ts, F.flatten(F.transform(F.filter(ts, lambda t: t.rlike("^[0-9]+$")), ancestors)))))


def _unmarked(text: Column) -> Column:
    return F.translate(text, OPEN + SHUT, "  ")


def holders_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, text, spans, entities) of each distinct text that holds a base span, with all classes of them; written once."""
    rows = docs.select(F.col(text).alias("text")).where(may_hold(F.col("text"))).withColumn("key", F.md5(F.col("text").cast("binary")))
    rows = rows.dropDuplicates(["key"]).withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0)
    return materialize(rows.withColumn("entities", F.array_distinct(F.flatten(F.transform("spans", lambda s: classes_of(entity_of(s)))))), "pii-holders")


def contexts(holders: DataFrame, words: int = WORDS, sentence: bool = True) -> DataFrame:
    """Distinct (key, entity, term): the words of an entity's sentence, at most ``words`` words away from it.

    ``entity`` is each class of the entity, ``term`` each word and what it generalises to. Without ``sentence`` the whole
    text is one.

    Words are counted with entities as one each; a word that touches an entity is part of it. Long sentences become
    rows of ``ROW_WORDS`` words, with ``words`` more on either side to look at.
    """
    named = rewritten(_unmarked(F.col("text")), F.col("spans"), lambda s, _: F.concat(F.lit(OPEN), F.hex(entity_of(s)), F.lit(SHUT)))
    parts = holders.select("key", F.explode(F.split(named, SENTENCE) if sentence else F.array(named)).alias("part")).where(F.col("part").contains(OPEN))
    listed = parts.select("key", F.regexp_extract_all("part", F.lit(rf"[\p{{L}}\p{{N}}{OPEN}{SHUT}]++"), F.lit(0)).alias("w"))

    def row(w: Column, k: Column) -> Column:
        first = F.greatest(k - words, F.lit(0))
        return F.struct((k - first).alias("skip"), F.slice(w, first + 1, k - first + ROW_WORDS + words).alias("w"))

    rows = listed.select("key", F.explode(_let(F.col("w"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(ROW_WORDS)), lambda k: row(w, k)))).alias("r"))
    rows = rows.select("key", F.col("r.skip").alias("skip"), F.col("r.w").alias("w"))

    def beside(x: Column, i: Column, w: Column) -> Column:
        near = F.slice(w, F.greatest(i - words, F.lit(0)) + 1, F.least(i, F.lit(words)) + words + 1)
        terms = F.array_distinct(F.transform(F.filter(near, lambda t: ~t.contains(OPEN) & ~t.contains(SHUT) & _is_term(t)), F.lower))
        named = F.array_distinct(F.regexp_extract_all(x, F.lit(f"{OPEN}([0-9A-F]+){SHUT}"), F.lit(1)))
        core = x.contains(OPEN) & (i >= F.col("skip")) & (i < F.col("skip") + ROW_WORDS)
        pairs = _let(terms, lambda ts: F.flatten(F.transform(named, lambda c: F.transform(ts, lambda t: F.struct(c.alias("entity"), t.alias("term"))))))
        return F.when(core, pairs).otherwise(F.array().cast("array<struct<entity:string,term:string>>"))

    pairs = rows.select("key", F.explode(F.flatten(_let(F.col("w"), lambda w: F.transform(w, lambda x, i: beside(x, i, w))))).alias("p"))
    pairs = pairs.select("key", F.decode(F.unhex("p.entity"), "UTF-8").alias("entity"), F.col("p.term").alias("term")).distinct()
    return pairs.select("key", F.explode(classes_of(F.col("entity"))).alias("entity"), "term").select("key", "entity", F.explode(levels_of(F.array("term"))).alias("term")).distinct()


def disclosures(docs: DataFrame, text: str = "text", words: int = WORDS, generalise: float = GENERALISE, holders: DataFrame | None = None, prior: float = PRIOR, sentence: bool = True) -> DataFrame:
    """(entity, term, disclosure, spread) of the pairs at or above the lower threshold, from counts over all distinct texts.

    ``entity`` is an entity or its group, ``term`` a word or what a number generalises to; ``spread`` says whether the
    term stands in more texts than beside the entity.
    """
    holders = holders if holders is not None else holders_of(docs, text)
    # Texts are told apart by 64 bits here: a clash among billions of texts would lower a count by one.
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    total = texts.select("key").distinct().count()
    once = once_each(texts, "key")
    held = holders.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    both = contexts(holders, words, sentence).groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    pairs = materialize(both.join(held, "entity"), "pii-pairs")
    wanted = materialize(pairs.select("term").distinct(), "pii-terms")
    # Counted before they are joined: a term is a row of each task at most, however common it is. An inner join with
    # distinct terms, since a semi join would be moved below the counting.
    seen = once.select(F.explode(levels_of(terms_of(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term")
    n = F.lit(float(max(total, 1)))
    given = (F.col("n_both") + F.lit(prior) * F.col("n_entity") / n) / (F.col("n_term") + F.lit(prior))
    ratio = F.log(given * n / F.col("n_entity")) / F.log(n / F.col("n_entity"))
    scored = pairs.join(seen, "term").where(F.col("n_entity") < n).select("entity", "term", F.least(ratio, F.lit(1.0)).alias("disclosure"), (F.col("n_term") > F.col("n_both")).alias("spread"))
    return materialize(scored.where(F.col("disclosure") >= generalise), "pii-disclosures")


def places_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, terms) of distinct ``texts`` (key, text, spans): where the words of ``wanted`` (key, term, removed, level) stand.

    ``level`` is what a number becomes, null for [NUMBER]. Words that a base span overlaps are passed over. Every text's words meet its own terms in one join.
    """
    hidden = rewritten(_unmarked(F.col("text")), F.col("spans"), lambda s, read: F.repeat(F.lit(OPEN), F.greatest(s["end"] - F.greatest(s["start"], read), F.lit(0))))
    asked = texts.join(wanted.select("key").distinct(), "key", "left_semi").select("key", hidden.alias("text"))
    words = asked.select("key", F.explode(placed(F.col("text"), rf"[\p{{L}}\p{{N}}{OPEN}]++")).alias("w")).where(~F.col("w.value").contains(OPEN))
    found = words.select("key", "w.start", "w.end", "w.value", F.lower("w.value").alias("term")).join(wanted, ["key", "term"])
    general = F.when(F.col("value").rlike("^[0-9]+$"), "[NUMBER]").when(F.col("value").rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
    one = F.struct("start", "end", "term", F.when(F.col("removed"), "").otherwise(F.coalesce("level", general)).alias("mask"))
    return materialize(found.groupBy("key").agg(F.array_sort(F.collect_list(one)).cast(PLACES).alias("terms")), "pii-places")


def generalised(hits: DataFrame, remove: float) -> DataFrame:
    """(key, term, removed, level) of the terms to sanitise, from ``hits`` (key, term, disclosure).

    ``level`` is a number's most specific ancestor that is no hit in the text itself; null where there is none.
    """
    hits = materialize(hits.groupBy("key", "term").agg((F.max("disclosure") >= remove).alias("removed")), "pii-hits")
    star = F.col("term").contains("*")
    numbers = hits.where(~star & ~F.col("removed")).select("key", "term", F.posexplode(ancestors(F.col("term"))).alias("depth", "level"))
    free = numbers.join(hits.where(star).select("key", F.col("term").alias("level")), ["key", "level"], "left_anti").groupBy("key", "term").agg(F.min_by("level", "depth").alias("level"))
    return materialize(hits.where(~star).join(free, ["key", "term"], "left"), "pii-wanted")


def detect(docs: DataFrame, text: str = "text", words: int = WORDS, generalise: float = GENERALISE, remove: float = REMOVE, prior: float = PRIOR, sentence: bool = True) -> DataFrame:
    """(row, text, spans, terms) of every row of ``docs``: the row as a struct, its base spans and its disclosing terms.

    ``spans`` are as in ``base_spans``, ``terms`` (start, end, term, mask) in order; an empty mask removes the term. Null and empty texts have none.
    Equal texts get equal spans, however often they are there. An empty table gives no rows. All other columns stay in
    ``row``, so their names can't clash.
    """
    holders = holders_of(docs, text)
    found = disclosures(docs, text, words, generalise, holders, prior, sentence)
    owned = holders.select("key", F.explode(levels_of(terms_of(F.col("text")))).alias("term"))
    # A text's terms are looked up first: an entity of many texts has many terms, of which a text holds few.
    known = owned.join(found, "term").select("key", "term", "entity", "disclosure")
    hits = known.join(holders.select("key", F.explode("entities").alias("entity")), ["key", "entity"]).select("key", "term", "disclosure")
    alone = materialize(found.where("spread").where(F.col("disclosure") >= remove).where(~F.col("term").contains("*")).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "pii-alone")
    everywhere = not alone.isEmpty()
    if everywhere:
        hits = hits.unionAll(owned.join(alone, "term").select("key", "term", "disclosure"))
    places = places_of(holders, generalised(hits, remove))
    key = F.md5(F.col("text").cast("binary"))
    other, test = F.lit(False), F.xxhash64("text")
    if everywhere:
        keyed = docs.select(F.col(text).alias("text")).where("text is not null").withColumn("key", key)
        loose = keyed.select("key", F.xxhash64("text").alias("h"), F.explode(terms_of(F.col("text"))).alias("term")).join(alone, "term")
        loose = materialize(loose.select("key", "h", "term").distinct().join(holders.select("key"), "key", "left_anti"), "pii-loose")
        found_in = bit_test(loose, "h")
        texts = keyed.where(found_in(test)).join(loose.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
        others = places_of(texts.withColumn("spans", F.array().cast(f"array<{SPAN}>")), loose.select("key", "term", F.lit(True).alias("removed"), F.lit(None).cast("string").alias("level")))
        places, other = materialize(places.unionByName(others), "pii-all-places"), F.coalesce(found_in(test), F.lit(False))
    # Only rows that may hold a span or a term are dealt by their text.
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    none, joins = F.array().cast(PLACES), may_hold(F.col("text")) | (F.col("text").isNotNull() & other)
    marked = rows.where(joins).withColumn("spans", base_spans(F.col("text"))).withColumn("text_key", key).join(places, F.col("text_key") == F.col("key"), "left")
    marked = marked.select("row", "text", "spans", F.coalesce("terms", none).alias("terms"))
    return rows.where(~joins).select("row", "text", F.array().cast(f"array<{SPAN}>").alias("spans"), none.alias("terms")).unionByName(marked)


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with base spans masked as [KIND] and disclosing terms generalised or removed; same columns.

    ``n_chars``, where it is there, follows the new text. Rows without an entity or a disclosing term come back as they are.
    """
    found = detect(docs, text, **options)
    piece = "array<struct<start:int,end:int,mask:string>>"
    masks = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mask")))
    soft = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["mask"].alias("mask")))
    edits = F.array_sort(F.concat(masks.cast(piece), soft.cast(piece)))
    done = rewritten(F.col("text"), F.col("edits"), lambda e, read: F.when(e["start"] >= read, e["mask"]).otherwise(""))
    out = found.select("row", "text", edits.alias("edits")).select("row", (F.size("edits") > 0).alias("held"), done.alias("new"))

    def column(c: str) -> Column:
        old = F.col("row")[c]
        if c == text:
            return F.col("new").alias(c)
        if c == "n_chars":
            return F.when(F.col("held"), F.length("new").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return out.select(*map(column, docs.columns))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of every document; terms that disclose an entity are added under the kind ``term``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), t["end"].alias("end"), t["term"].alias("value")))
    both = F.array_sort(F.concat(F.col("spans"), terms))
    return found.select("row.doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"), joined(both).alias("spans"))
