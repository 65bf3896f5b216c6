"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its elements (told by their path of tags, classes and ids) and its words (told by the path, the tag
and the words before them in their text node). Over the distinct pages of a host, tokens with the same occurrence vector
(so often on the first page, so often on the second, ...) form an equivalence class; a vector is held as the exclusive
or of a hash of each page and count, so that classes come from aggregations, however large the host. A class counts if
it has two tokens and is on ``SUPPORT`` of the pages. It must then be valid:

* ordered: elements of a class that lie in the same element follow each other in one order on every page; a word has the
  same words before it by what it is;
* nested: an element is part of the template only if the element around it is.

The valid classes make a tree, the host's template. Text nodes whose words all belong to it, to the tag that ends them,
are template; what is left are slots. A node is believed if chance would not repeat it: its words times the pages that
repeat them must reach ``EVIDENCE``, for a host of any size. The article's slots are those in the deepest container that
holds most of the slot text of all the host's pages; slots in elements such as nav, form, advert or comments are passed
over. A node of fixed and changing words is a slot as a whole, so that no article loses its first words.

The first pass reads elements and the first words of text nodes, the second all words of nodes whose first word is in a
class: no other node can be template. Where a host shows no template (its pages are copies of one page, or nearly all
text repeats), or a page lacks the template's container, the article is told by its own elements; ``found_by`` says which
way a row took.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennwick.llm.common import bound_batches, materialize, once_each, table
from fennwick.llm.html_page import CONTAINERS, END, Page, word_token

#: A class must be on this share of a host's distinct pages and have so many tokens.
SUPPORT = 0.9
CLASS_SIZE = 2
#: Words of a template node times the pages that repeat them.
EVIDENCE = 5
#: The article's container holds this share of the slot text; a host's slots hold this share of all its text.
MAIN_SHARE = 0.6
LEAST_SLOTS = 0.05
#: Slots hold at least this share of the container's text, else the host's pages are copies of one article.
LEAST_OWN = 0.5

ORDER, WORD, ELEMENT = 0, 1, 2
STATS = "host long, kind int, key long, a long, b long, c long, d long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def chain(words: list[str], path: int) -> list[int]:
    """A text node's tokens: each word told by what comes before it, then the end of the node."""
    out, at = [], path
    for word in words:
        at = word_token(word, at)
        out.append(at)
    return [*out, at ^ END]


def page_tokens(page: Page) -> dict[int, int]:
    """Occurrences of each element of the page, and of the first word of each text node."""
    n: dict[int, int] = {}
    for t in page.token[1:]:
        n[t] = n.get(t, 0) + 1
    for words, e, before, _ in text_nodes(page):
        t = word_token(words[0], page.token[e] ^ before)
        n[t] = n.get(t, 0) + 1
    return n


def marks(counts: dict[int, int], page: int) -> dict[int, int]:
    """What a page adds to the vectors of tokens that it holds so often."""
    return {k: xxhash.xxh64_intdigest(k.to_bytes(8, "little"), page) for k in set(counts.values())}


def votes_of(pages: DataFrame) -> DataFrame:
    """(host, page, html): one of each host's equal pages. Null pages and pages without a host have none."""
    host = host_of(F.col("url"))
    rows = pages.where(F.col("html").isNotNull() & (host != "")).select(F.xxhash64(host).alias("host"), "html")
    return once_each(rows.withColumn("page", F.xxhash64("host", "html")), "page").select("host", "page", "html")


def classes(votes: DataFrame) -> DataFrame:
    """(host, n, token, vector): tokens of the classes that are large and frequent enough, of hosts with two pages or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, sign, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = page_tokens(Page(html.as_py()))
                mark = marks(found, sign & (1 << 64) - 1)
                tokens = np.fromiter(found, np.uint64, len(found)).view(np.int64)
                vectors = np.fromiter((mark[k] for k in found.values()), np.uint64, len(found)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), host)), pa.array(tokens), pa.array(vectors)], names=["host", "token", "vector"])

    tokens = votes.mapInArrow(count, "host long, token long, vector long").groupBy("host", "token").agg(F.count("*").alias("on"), F.bit_xor("vector").alias("vector"))
    sizes = votes.groupBy("host").agg(F.count("*").alias("n")).where("n > 1")
    often = materialize(tokens.where(F.col("on") > 1).join(sizes, "host").where(F.col("on") >= SUPPORT * F.col("n")).select("host", "n", "token", "vector"), "html-tokens")
    large = often.groupBy("host", "vector").agg(F.count("*").alias("size")).where(F.col("size") >= CLASS_SIZE).select("host", "vector")
    return often.join(large, ["host", "vector"]).select("host", "n", "token", "vector")


def observe(page: Page, sign: int, vectors: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(kind, key, a, b, c, d) of what one page says of its host's class tokens (token to vector).

    ORDER: a group of elements of one class in one element; a is a hash of their order. WORD: a token of a text node whose
    first word is in a class; a is the page's part of its vector and, at the node's end, b is its words, c the class element
    around it, d its characters. ELEMENT: a is its text in characters, c the element around it, d its depth
    and whether it is a container.
    """
    groups: dict[int, list[int]] = {}
    around = [0] * len(page.parent)  # the nearest class element
    for e in range(1, len(page.parent)):
        t = page.token[e]
        around[e] = around[page.parent[e]]
        if t in vectors:
            around[e] = t
            group = xxhash.xxh64_intdigest(vectors[t].to_bytes(8, "little"), page.token[page.parent[e]])
            groups.setdefault(group, []).append(t)
    out = []
    for group, met in groups.items():
        first = list(dict.fromkeys(met))
        fine = met == first * (len(met) // len(first))
        out.append((ORDER, group, xxhash.xxh64_intdigest(repr(first)) >> 1 if fine else 1 << 63, 0, 0, 0))
    counts: dict[int, int] = {}
    ends: dict[int, tuple[int, int, int]] = {}
    full = [0] * len(page.parent)
    for words, e, before, _ in text_nodes(page):
        if page.boiler[e]:
            continue
        size = sum(map(len, words))
        full[e] += size
        if word_token(words[0], page.token[e] ^ before) in vectors:
            tokens = chain(words, page.token[e] ^ before)
            for t in tokens:
                counts[t] = counts.get(t, 0) + 1
            ends[tokens[-1]] = (len(words), around[e], size)
    mark = marks(counts, sign)
    for t, k in counts.items():
        words, element, size = ends.get(t, (0, 0, 0))
        out.append((WORD, t, mark[k], words, element, k * size))
    full = page.below(full)
    held: dict[int, list[int]] = {}
    for e in range(1, len(page.parent)):
        if page.token[e] in vectors:
            box = held.setdefault(page.token[e], [0, 0, page.token[page.parent[e]], page.depth[e] * 2 + (page.tags[e] in CONTAINERS and not page.boiler[e])])
            box[0] += full[e]
    return out + [(ELEMENT, t, *box) for t, box in held.items()]


def text_nodes(page: Page) -> list[tuple[list[str], int, int, int]]:
    """(words, element, tag before, events before) of the text nodes that hold words; pieces that no tag parts are one."""
    out: list[tuple[list[str], int, int, int]] = []
    last = -1
    for text, e, _, at in page.texts():
        words = text.split()
        if not words:
            continue
        if at == last:
            out[-1][0].extend(words)
        else:
            out.append((words, e, page.events[at - 1] if at else END, at))
        last = at
    return out


def deduce(n: int, vectors: dict[int, int], stats: list[tuple]) -> tuple[list[int], list[int], int] | None:
    """(elements, nodes, container) of a host's template from what its ``n`` pages say, or None if it shows none.

    ``nodes`` are the last tokens of its text nodes. ``stats`` holds (kind, key, pages, least a, greatest a, exclusive or of
    a, sum of a, b, c, greatest d, sum of d), all unsigned; the sums of ELEMENT's a and WORD's d only.
    """
    ordered = {key for kind, key, _, low, high, *_ in stats if kind == ORDER and low == high and low < 1 << 63}
    text, around, depth = ({r[1]: r[k] for r in stats if r[0] == ELEMENT} for k in (6, 8, 9))
    elements: set[int] = set()
    for t in sorted(depth, key=depth.get):  # from the outermost element inwards
        group = xxhash.xxh64_intdigest(vectors[t].to_bytes(8, "little"), around[t])
        if group in ordered and (around[t] == 0 or around[t] in elements):
            elements.add(t)
    often = [r for r in stats if r[0] == WORD and r[2] > 1 and r[2] >= SUPPORT * n]
    size: dict[int, int] = {}
    for v in [*vectors.values(), *(r[5] for r in often)]:
        size[v] = size.get(v, 0) + 1
    slots, nodes = dict(text), []
    for _, key, pages, _, _, vector, _, words, element, _, chars in often:
        if words and size[vector] >= CLASS_SIZE and words * (pages - 1) >= EVIDENCE:
            nodes.append(key)
            while element in slots:
                slots[element] -= chars
                element = around[element]
    total, whole = (max((x[t] for t in elements), default=0) for x in (slots, text))
    boxes = [t for t in elements if depth[t] % 2 and slots[t] >= MAIN_SHARE * total]
    if not boxes or not total:
        return None
    root = max(boxes, key=lambda t: (depth[t], slots[t], t))
    if slots[root] < LEAST_SLOTS * whole or slots[root] < LEAST_OWN * text[root]:
        return None
    return sorted(elements), sorted(nodes), root


def templates(votes: DataFrame) -> DataFrame:
    """(host, nodes, root) of the hosts that show a template: its text nodes and its article's container."""
    found = materialize(classes(votes), "html-classes")
    # A host's class tokens are few: at most the tokens of a page divided by SUPPORT.
    held = materialize(found.groupBy("host").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens"), F.collect_list("vector").alias("vectors")), "html-held")

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for i, (host, sign, html) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = _pairs(batch.column(3)[i], batch.column(4)[i])
                rows = observe(Page(html.as_py()), sign & (1 << 64) - 1, known[host])
                columns = [np.array(c, dtype=np.uint64).view(np.int64) for c in zip(*rows)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), host)), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])], names=["host", "kind", "key", "a", "b", "c", "d"])

    said = votes.join(held, "host").select("host", "page", "html", "tokens", "vectors").mapInArrow(say, STATS)
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)).otherwise(0))
    stats = said.groupBy("host", "kind", "key").agg(F.count("*").alias("pages"), F.min("a"), F.max("a"), F.bit_xor("a"), of(ELEMENT, "a").alias("size"), F.max("b"), F.max("c"), F.max("d"), of(WORD, "d").alias("sum_d"))
    # What is on few pages can't be template, so a host keeps what a page holds divided by SUPPORT.
    often = stats.join(held.select("host", "n"), "host").where((F.col("kind") != WORD) | (F.col("pages") >= SUPPORT * F.col("n"))).drop("n")
    per_host = often.groupBy("host").agg(F.collect_list(F.struct(*[c for c in stats.columns if c != "host"])).alias("stats")).join(held, "host")

    @F.pandas_udf("nodes array<long>, root long")
    def of_host(n: pd.Series, tokens: pd.Series, vectors: pd.Series, rows: pd.Series) -> pd.DataFrame:
        out, plain = [], lambda x: int(x) & (1 << 64) - 1
        for size, t, v, said in zip(n, tokens, vectors, rows):
            got = deduce(int(size), dict(zip(map(plain, t), map(plain, v))), [tuple(map(plain, r.values() if isinstance(r, dict) else r)) for r in said])
            out.append((None, None) if got is None else ([_signed(x) for x in got[1]], _signed(got[2])))
        return pd.DataFrame({"nodes": [w for w, _ in out], "root": pd.array([r for _, r in out], dtype="Int64")})

    return per_host.select("host", of_host("n", "tokens", "vectors", "stats").alias("t")).select("host", "t.nodes", "t.root").where("root is not null")


def _pairs(tokens: pa.ListScalar, vectors: pa.ListScalar) -> dict[int, int]:
    plain = lambda x: np.array(x.values, dtype=np.int64).view(np.uint64).tolist()
    return dict(zip(plain(tokens), plain(vectors)))


def main_text(html: str | None) -> str:
    """The main text of a page alone."""
    return extracted(html)[0]


def extracted(html: str | None, nodes: frozenset[int] | None = None, root: int = 0) -> tuple[str, bool]:
    """The page's main text, and whether it comes from its host's template (its text nodes, its article's container)."""
    if not html:
        return "", False
    page = Page(html)
    if nodes is not None:
        boxes = {e for e in range(1, len(page.parent)) if page.token[e] == root}
        if boxes:
            return _slots(page, nodes, boxes), True
    return _by_elements(page), False


def _fixed(page: Page, nodes: frozenset[int]) -> set[tuple[int, int]]:
    """(element, events before) of the page's template text nodes."""
    return {(e, at) for words, e, before, at in text_nodes(page) if chain(words, page.token[e] ^ before)[-1] in nodes}


def _slots(page: Page, nodes: frozenset[int], boxes: set[int]) -> str:
    """The slots of the article's containers; where they hold no heading of the first level, one before them is the article's."""
    inside = [False] * len(page.parent)
    for e in range(1, len(page.parent)):
        inside[e] = inside[page.parent[e]] or e in boxes
    fixed = _fixed(page, nodes) if nodes else set()
    own: list[int] = [0] * len(page.parent)
    for text, e, _, _ in page.texts():
        if inside[e] and not page.boiler[e]:
            own[e] += len(text.strip())
    size = page.below(own)
    main = [e for e in range(1, len(page.parent)) if inside[e] and page.rank[e] >= 2 and page.rank[page.parent[e]] < 2 and size[e]]
    if main:
        inside = page.inside(max(main, key=lambda e: size[e]))
    elif not any(inside[e] and page.tags[e] == "h1" for e in range(1, len(page.parent))):
        told = {e for e, _ in fixed}
        heads = [e for e in range(1, min(boxes)) if page.tags[e] == "h1" and not page.boiler[e] and e not in told]
        if heads:
            inside = [a or b for a, b in zip(inside, page.inside(heads[-1]))]
    return _joined(page, inside, fixed)


def _joined(page: Page, inside: list[bool], fixed: set[tuple[int, int]]) -> str:
    """The text of the elements ``inside`` that are no boilerplate, without template text nodes."""
    out: list[str] = []
    for text, e, parted, at in page.texts():
        if not inside[e] or page.boiler[e]:
            if parted or text[:1].isspace():
                out.append(" ")
        elif (e, at) in fixed:
            out.append(" ")
        else:
            out.append((" " if parted else "") + text)
    return " ".join("".join(out).split())


def _by_elements(page: Page) -> str:
    """Of a page alone: the element that says it is the article, or else the deepest one around most of the text."""
    own = [0] * len(page.parent)
    for text, e, _, _ in page.texts():
        if not page.boiler[e]:
            own[e] += len(text.strip())
    size, root = page.below(own), 0
    if not size[0]:
        return ""
    for rank in (3, 2, 1):
        outer = [e for e in range(1, len(page.parent)) if page.rank[e] == rank and page.rank[page.parent[e]] < rank and size[e]]
        if outer and (rank > 1 or max(size[e] for e in outer) >= MAIN_SHARE * size[0]):
            root = max(outer, key=lambda e: size[e])
            break
    else:
        wide = [e for e in range(len(page.parent)) if size[e] >= MAIN_SHARE * size[0] and page.tags[e] != "p"]
        root = max(wide, key=lambda e: (page.depth[e], size[e]), default=0)
    return _joined(page, page.inside(root), set())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, found_by) of every row of ``pages`` (page_id, url, html).

    Null and empty pages give the empty text. ``found_by`` is ``template`` or ``elements``. Pages without a host, and
    hosts that show no template, are read by their elements. Repeated rows come back each; an empty table gives no
    rows; other columns are not read. Very long pages and deep nesting take time in proportion to their length.
    """
    bound_batches(pages.sparkSession)
    deduced = materialize(templates(votes_of(pages)), "html-templates")
    keyed = pages.select("page_id", "url", "html", F.xxhash64(host_of(F.col("url"))).alias("_host"))
    joined = keyed.join(deduced, F.col("_host") == F.col("host"), "left").select("page_id", "url", "html", "nodes", "root")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, frozenset[int]] = {}
        for batch in batches:
            texts, ways = [], []
            for html, nodes, root in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist()):
                if root is None:
                    text, slot = extracted(html.as_py())
                else:
                    plain = np.array(nodes.values, dtype=np.int64).view(np.uint64)
                    key = (root, plain.tobytes())
                    if key not in kept:
                        if len(kept) > 1000:
                            kept.clear()
                        kept[key] = frozenset(plain.tolist())
                    text, slot = extracted(html.as_py(), kept[key], root & (1 << 64) - 1)
                texts.append(text)
                ways.append("template" if slot else "elements")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(ways, pa.string())], names=["page_id", "url", "text", "n_chars", "found_by"])

    kind = dict(pages.dtypes)["page_id"]
    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long, found_by string")


def op6_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page, and whether its host's template gave it."""
    return extract(table(spark, sf_dir, "pages"))
