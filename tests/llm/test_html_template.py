"""Classes and templates against a plain statement of the method, and pages that only the template tells apart."""

import functools
import operator
import random
import time
from collections import Counter, defaultdict

from fennwick.llm import html_extract as X
from fennwick.llm.html_page import END, Page

LAYOUT = '<html><body><div class="top"><span>My site</span></div><div class="x1"><p>{}</p>{}<p>Follow us on the net every day</p></div><div class="x2">{}</div><div class="low">Contact us here</div></body></html>'


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def site(rnd, host, n):
    words = [f"w{i}" for i in range(300)]
    story = lambda a, b: " ".join(rnd.choices(words, k=rnd.randint(a, b)))
    return [(f"http://{host}/{i}", LAYOUT.format(f"Story {i} {story(30, 60)}", "".join(f"<p>{story(5, 30)}</p>" for _ in range(rnd.randint(0, 3))), story(2, 5))) for i in range(n)]


def brute_classes(pages):
    """{host: {(token, ...)}}: the large and frequent classes by whole occurrence vectors."""
    by_host = defaultdict(list)
    for url, html in pages:
        by_host[url.split("/")[2]].append(X.page_tokens(Page(html)))
    out = {}
    for host, counts in by_host.items():
        groups = defaultdict(set)
        for t in {t for c in counts for t in c}:
            groups[tuple(c.get(t, 0) for c in counts)].add(t)
        n = len(counts)
        out[host] = {frozenset(g) for v, g in groups.items() if len(g) >= X.CLASS_SIZE and sum(k > 0 for k in v) >= max(2, X.SUPPORT * n)}
    return {h: g for h, g in out.items() if g}


def test_classes_against_brute_force(spark):
    rnd = random.Random(3)
    pages = [p for k, n in enumerate((1, 2, 5, 23)) for p in site(rnd, f"h{k}.example", n)]
    # Sites are told apart by words without digits, else the copies rule makes them one page.
    df = spark.createDataFrame([(i, u, h + f"<i>{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}</i>") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    want = brute_classes([(r["url"], r["html"]) for r in df.collect()])
    got = defaultdict(lambda: defaultdict(set))
    for r in X.classes(X.votes_of(df)).collect():
        got[r["host"]][r["vector"]].add(r["token"])
    mine = sorted(sorted(map(sorted, g.values())) for g in got.values())
    assert mine == sorted(sorted(sorted(map(signed, c)) for c in g) for g in want.values()) and len(mine) == 3


def test_deduced_template_is_ordered_and_nested():
    rnd = random.Random(5)
    pages = [Page(h) for _, h in site(rnd, "x", 12)]
    counts = [X.page_tokens(p) for p in pages]
    vectors = {t: hash(tuple(c.get(t, 0) for c in counts)) & (1 << 64) - 1 for t in counts[0] if sum(t in c for c in counts) >= 11}
    said = defaultdict(list)
    for sign, p in enumerate(pages):
        for kind, key, *rest in X.observe(p, sign, vectors):
            said[kind, key].append(rest)
    xor = lambda v: functools.reduce(operator.xor, (r[0] for r in v))
    stats = [
        (k, key, len(v), min(r[0] for r in v), max(r[0] for r in v), xor(v), sum(r[0] for r in v), max(r[1] for r in v), v[0][2], max(r[3] for r in v), sum(r[3] for r in v)) for (k, key), v in said.items()
    ]
    elements, nodes, root = X.deduce(12, vectors, stats)
    page = pages[0]
    by_label = {page.tags[e] + str(page.depth[e]): page.token[e] for e in range(1, len(page.parent))}
    parent = {page.token[e]: page.token[page.parent[e]] for e in range(1, len(page.parent))}
    assert all(parent[t] == 0 or parent[t] in elements for t in elements) and by_label["span4"] in elements
    box = next(e for e in range(1, len(page.parent)) if page.token[e] == root)
    assert page.tags[box] == "div" and page.depth[box] == 3
    fixed = {" ".join(words) for words, e, before, _ in X.text_nodes(page) if X.chain(words, page.token[e] ^ before)[-1] in nodes}
    assert fixed == {"My site", "Follow us on the net every day", "Contact us here"}
    # Elements that change places from page to page are in no order, so they are not part of a template.
    swapped = [(k, key, n, low, high + (k == X.ORDER), *rest) for k, key, n, low, high, *rest in stats]
    assert X.deduce(12, vectors, swapped) is None


def test_the_template_decides_where_no_element_names_the_article(spark):
    rnd = random.Random(7)
    rows = [(i, u, h) for i, (u, h) in enumerate(site(rnd, "plain.example", 30))]
    lone = (99, "http://lone.example/1", rows[0][2])
    got = {r["page_id"]: r for r in X.extract(spark.createDataFrame([*rows, lone], "page_id long, url string, html string")).collect()}
    assert Counter(r["found_by"] for r in got.values()) == {"template": 30, "elements": 1}
    for i in range(30):
        assert got[i]["text"].startswith(f"Story {i} ") and not any(w in got[i]["text"] for w in ("Follow", "My site", "Contact"))
    assert "Follow us on the net every day" in got[99]["text"]  # the same page, without the other pages of its host


def test_short_articles_are_found_by_their_host(spark):
    """Where a page's notice is longer than its article, only the host's other pages tell which is which."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    story = lambda k: " ".join(rnd.choices(words, k=k))
    size = [3] * 3 + [80] * 20
    rows = [(i, f"http://s.example/{i}", f"<body><div class=q><p>{story(12)}</p></div><div class=z><p>a{i}</p><p>{story(k)}</p></div></body>") for i, k in enumerate(size)]
    got = {r["page_id"]: r["text"] for r in X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith(f"a{i} w") and len(got[i].split()) == size[i] + 1 for i in range(23))


def test_nesting_takes_linear_time():
    for page in ("<b>" * 60_000 + "<div>x</div>" * 60_000, "<p><b>" * 30_000 + "</i>" * 60_000, "<div>" * 60_000 + "</p>x" * 60_000, "<p><table><td>" + "<i>" * 30_000 + "<div></div>" * 60_000):
        began = time.time()
        text = X.main_text(page)
        assert time.time() - began < 20 and isinstance(text, str)


def test_events_pair_up():
    page = Page("<div><p>a<p>b<ul><li>c<li>d</ul></div>")
    starts = [t for t in page.events if t in page.token]
    assert len(starts) == len(page.parent) - 1 and all(page.events.count(t ^ END) == page.events.count(t) for t in starts)
    assert [t.strip() for t, *_ in page.texts()] == ["a", "b", "c", "d"]
