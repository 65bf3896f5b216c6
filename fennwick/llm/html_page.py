"""A web page as a tree of elements with text nodes, read leniently and in time linear in its length."""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import xxhash

# Fixed values of HTML: elements without content, of raw text, and that part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br td th tr tbody thead tfoot caption option optgroup body head html".split())
# Elements that hold blocks and so may hold a whole article.
CONTAINERS = frozenset("html body main article section div td center table tbody tr details".split())
# Elements that never hold main text.
BOILER_TAGS = frozenset("nav footer aside form script style noscript template head title select option button iframe svg canvas textarea object dialog menu noembed noframes xmp datalist".split())
# Words of classes, ids and roles that name what is not main text.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner banners sidebar sidebars side rail menu menus nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer foot copyright cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login search share sharing social related recommended recommendations "
    "comment comments commentlist reply replies respond disqus discussion popup modal overlay widget widgets pagination pager toolbar skip complementary contentinfo".split()
)
MAIN_WORDS = frozenset("article articlebody articletext content maincontent post postbody postcontent entry entrycontent story storybody main text body".split())

_TAG = re.compile(
    r"""<!--(?P<comment>.*?)(?:-->|--!>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"""
    r"""(?P<attrs>(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+))?+|=)*+)>""",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Turns an element's token into that of its end.
END = 0x5BD1E9955BD1E995


@lru_cache(maxsize=20_000)
def _traits(name: str, attrs: str) -> tuple[str, int, bool, bool, bool]:
    """An element's label, rank as main, and whether it is boilerplate: anywhere, outside main elements, by its words."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
    words = {w.lower() for key in ("class", "id", "role") for w in _WORD.findall(found.get(key, ""))}
    compound = {re.sub(r"[^a-z]", "", w.lower()) for key in ("class", "id", "role", "itemprop") for w in found.get(key, "").split()}
    rank = 3 if name == "article" else 2 if name == "main" or "articlebody" in compound or found.get("role") == "main" else 1 if compound & MAIN_WORDS else 0
    off = name in BOILER_TAGS or (name == "article" and bool(words & {"comment", "comments", "reply"})) or "hidden" in found or found.get("aria-hidden") == "true"
    worded = bool(words & BOILER_WORDS) and name not in ("html", "body", "main") and rank < 2
    label = f"{name} {' '.join(f'{k}={v}' for k, v in sorted(found.items()))}"
    return label, rank, off, name == "header", worded


class Page:
    """Elements (parent, token, depth, boilerplate, rank as main, tag) and text pieces (text, element, parted, events).

    An element's token is its path of tags, classes and ids. ``events`` holds the tokens of the starts and ends of
    elements in page order; a piece stands before the event of its number.
    """

    def __init__(self, html: str):
        self.parent, self.token, self.depth, self.boiler, self.rank, self.tags = [-1], [0], [0], [False], [0], [""]
        self.pieces: list[tuple[str, int, bool, int]] = []
        self.events: list[int] = []
        self._p, self._open = [0], {}
        self._read(html)

    def _start(self, top: int, name: str, attrs: str) -> int:
        label, rank, off, header, worded = _traits(name, attrs)
        in_article = self.rank[top] >= 2
        off = off or self.boiler[top] or (header and not in_article) or (worded and not (header and in_article))
        self.parent.append(top)
        self.token.append(xxhash.xxh64_intdigest(label, self.token[top]))
        self.depth.append(self.depth[top] + 1)
        self.boiler.append(off)
        self.rank.append(0 if off else max(rank, self.rank[top]))
        self.tags.append(name)
        e = len(self.parent) - 1
        self._p.append(e if name == "p" else 0 if name in BLOCK else self._p[top])  # the open paragraph around it
        self.events.append(self.token[e])
        return e

    def _close(self, top: int, last: int) -> int:
        """Ends the open elements from ``top`` up to ``last``."""
        after = self.parent[last]
        while top != after:
            self.events.append(self.token[top] ^ END)
            self._open[self.tags[top]] -= 1
            top = self.parent[top]
        return after

    def _read(self, html: str) -> None:
        top, at, parted, n = 0, 0, True, len(html)
        while at < n:
            m = _TAG.search(html, at)
            stop = m.start() if m else n
            if stop > at:
                self.pieces.append((html[at:stop], top, parted, len(self.events)))
                parted = False
            if not m:
                break
            at, name = m.end(), (m["name"] or "").lower()
            if not name:
                continue
            parted |= name in BLOCK
            if m["end"]:
                if self._open.get(name):
                    k = top
                    while self.tags[k] != name:
                        k = self.parent[k]
                    top = self._close(top, k)
                continue
            if name in CLOSES_P:  # an open paragraph ends where a block begins
                if self._p[top]:
                    top = self._close(top, self._p[top])
            elif name in ("td", "th", "tr", "option", "tbody") and self.tags[top] == name:
                top = self._close(top, top)
            if name in ("li", "dt", "dd") and self.tags[top] in ("li", "dt", "dd") and (self.tags[top] == "li") == (name == "li"):
                top = self._close(top, top)
            e = self._start(top, name, m["attrs"])
            if name in VOID or m["attrs"].endswith("/") and name not in BLOCK and name not in RAW:
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
                continue
            self._open[name] = self._open.get(name, 0) + 1
            top = e

    def texts(self) -> list[tuple[str, int, bool, int]]:
        """The pieces with character references decoded; blank ones keep their white space."""
        return [(entities.unescape(raw) if "&" in raw else raw, e, parted, at) for raw, e, parted, at in self.pieces]

    def below(self, own: list[int]) -> list[int]:
        """For each element the sum of ``own`` over it and all elements in it."""
        out = list(own)
        for e in range(len(out) - 1, 0, -1):  # an element comes after the one around it
            out[self.parent[e]] += out[e]
        return out

    def inside(self, root: int) -> list[bool]:
        """For each element whether it is ``root`` or lies in it."""
        out = [False] * len(self.parent)
        for e in range(root, len(out)):
            out[e] = e == root or (e > 0 and out[self.parent[e]])
        return out


def word_token(word: str, element: int) -> int:
    """A word's token: its role is told by the path of the element that holds it."""
    return xxhash.xxh64_intdigest(word, element ^ 1)
