"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of block elements with its runs of text as leaves. Every node is a binary variable: "holds main
text". A node's own potential is a log-linear function of its features (tag, words of its class, id and role, length and
link density of its text, depth); the potential of a parent and a child depends on what the child is. Sum-product message
passing, upward from the leaves and downward from the root, gives exact marginals; runs with a marginal above one half
are the text. Whole batches of pages pass messages level by level in numpy.

Weights are trained by maximum likelihood (exact gradients from the same marginals) on labelled pages. The labelled pages
come from a generator in this module, which writes pages of many layouts with a label for each run of text: a fixed
number of them (``TRAINING_PAGES``), drawn from a seed.

Defined results: a null or empty page has an empty text; markup that is never closed, unknown tags and stray end tags
give some tree, never an error; pages that repeat an id are read one by one; columns beside id, url and html are left out,
whatever their names. Time is linear in a page's length, however deep its markup is. Texts are whole, blocks are joined by one
line feed, and white space inside a block (line breaks included) is one space.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

FEATURES = 1 << 13
TRAINING_PAGES = 400
STEPS = 150
#: Pages whose trees a task holds at once.
BATCH_PAGES = 250
KINDS = 3  # of edges: to an element, to a run in an element of running text, to another run

# A quote parts a value only right after an equals sign; a value whose quote never ends goes to the next space. What a tag
# or comment leaves open at the end of the page ends with it. No group is entered twice, so matching takes linear time.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]+))?")
_NAMES = frozenset("class id role itemprop".split())
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture".split())
#: Scripts, styles, form controls and drawings: text in them is never a run. All other text is, and the model decides.
NEVER = frozenset("head script style noscript template svg canvas iframe select option optgroup datalist textarea button title".split())
RUNNING = frozenset("p li dd dt td th blockquote pre h1 h2 h3 h4 h5 h6 figcaption".split())
#: What an opening tag ends, and where the search for it stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "body": ({"head"}, set())}
#: Where the search for an open paragraph stops.
KEEPS_P = ("td", "th", "button", "object")
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


@dataclass
class Page:
    """Nodes in document order: parent (-1 for the root), depth, features; runs of text by node."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    kind: list[int] = field(default_factory=lambda: [0])
    features: list[list[int]] = field(default_factory=lambda: [[_feature("root")]])
    runs: list[tuple[int, str]] = field(default_factory=list)

    def add(self, parent: int, kind: int, features: list[int]) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.kind.append(kind)
        self.features.append(features)
        return len(self.parent) - 1


_known: dict[str, int] = {}


def _feature(name: str) -> int:
    if name not in _known:
        if len(_known) > 100_000:
            _known.clear()
        _known[name] = zlib.crc32(name.encode()) % FEATURES
    return _known[name]


_element_cache: dict[tuple[str, str, str], list[int]] = {}


def _element_features(name: str, rest: str, parent: str) -> list[int]:
    key = (name, rest, parent)
    got = _element_cache.get(key)
    if got is None:
        names = ["bias", f"tag {name}", f"tag {name} in {parent}"]
        for attribute, value in _ATTRIBUTE.findall(rest) if rest else ():
            attribute = attribute.lower()
            if attribute in _NAMES:
                names += [f"word {w.lower()}" for w in _WORD.findall(value)]
            elif attribute == "hidden" or attribute == "aria-hidden" and "true" in value or attribute == "style" and "display:none" in value.replace(" ", ""):
                names.append("hidden")
        got = [_feature(n) for n in dict.fromkeys(names)]
        if len(_element_cache) > 20_000:
            _element_cache.clear()
        _element_cache[key] = got
    return got


def _run_features(text: str, tag: str, linked: int, depth: int) -> list[int]:
    n = len(text)
    density = min(4, 4 * linked // max(1, n))
    size = min(8, n.bit_length())
    ends = text[-1:] in ".!?…\"”"
    return [_feature("bias run"), _feature(f"run in {tag}"), _feature(f"size {size}"), _feature(f"links {density}"), _feature(f"size {size} links {density}"), _feature(f"ends {ends}"), _feature(f"depth {min(depth, 12) // 3}"), _feature(f"commas {min(3, text.count(','))}")]


def parse(html: str | None) -> Page:
    """The tree of a page. Open elements are a stack of (name, node, whether text below counts), and the places of each name in it."""
    page = Page()
    html = html or ""
    stack: list[tuple[str, int, bool]] = [("", 0, True)]
    places: dict[str, list[int]] = defaultdict(list)
    parts: list[str] = []
    linked, in_link = 0, 0

    def last(names) -> int:
        """The topmost open element of some names; 0 if there is none."""
        return max((places[n][-1] for n in names if places[n]), default=0)

    def shut(where: int) -> None:
        while len(stack) > where:
            places[stack.pop()[0]].pop()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            name, node, counts = stack[-1]
            if text and counts:
                run = page.add(node, 1 if name in RUNNING else 2, _run_features(text, name, linked, page.depth[node]))
                page.runs.append((run, text))
            parts.clear()
        linked = 0

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            data = html[at : m.start()]
            parts.append(data)
            if in_link:
                linked += len(data)
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if m.group("close"):
            if name == "a":
                in_link = 0
            if name in INLINE:
                if name == "br":
                    parts.append(" ")
                continue
            if where := last((name,)):
                flush()
                shut(where)
                in_link = 0
            elif name == "p":
                flush()
            continue
        if name in INLINE:
            if name == "a":
                in_link = 1
            elif name in ("br", "img", "wbr"):
                parts.append(" " if name == "br" else "")
            continue
        flush()
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if name in ENDS_P and (where := last(("p",))) > last(KEEPS_P):
            shut(where)
        if name in CLOSES:
            closes, stops = CLOSES[name]
            while (where := last(closes)) > last(stops):
                shut(where)
                if name not in ("tr", "tbody", "body"):
                    break
        if name in VOID:
            continue
        parent = stack[-1]
        node = page.add(parent[1], 0, _element_features(name, m.group("rest"), parent[0])) if parent[2] else parent[1]
        places[name].append(len(stack))
        stack.append((name, node, parent[2] and name not in NEVER))
    flush()
    return page


@dataclass
class Forest:
    """Many pages as arrays."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    feature: np.ndarray
    owner: np.ndarray
    run: np.ndarray
    page_of_run: np.ndarray


def forest(pages: list[Page]) -> Forest:
    sizes = np.array([len(p.parent) for p in pages])
    base = np.cumsum(sizes) - sizes
    parent = np.concatenate([np.array(p.parent) for p in pages])
    parent = np.where(parent < 0, -1, parent + np.repeat(base, sizes))
    lengths = np.array([len(f) for p in pages for f in p.features])
    runs = [len(p.runs) for p in pages]
    return Forest(
        parent, np.concatenate([np.array(p.depth) for p in pages]), np.concatenate([np.array(p.kind) for p in pages]),
        np.array([x for p in pages for f in p.features for x in f], np.int64), np.repeat(np.arange(len(lengths)), lengths),
        np.array([r + b for p, b in zip(pages, base, strict=True) for r, _ in p.runs], np.int64), np.repeat(np.arange(len(pages)), runs),
    )


@dataclass
class Weights:
    """unary: the log odds that each feature adds. pair[kind, parent's state, child's state]: log potentials."""

    unary: np.ndarray
    pair: np.ndarray


def marginals(f: Forest, w: Weights, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """P(node holds main text), and, if ``pairs`` are wanted, P(parent's state, node's state) for every node with a parent, (n, 2, 2)."""
    n = len(f.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(f.owner, w.unary[f.feature], n)
    up = own.copy()  # a node's potential with all messages from below
    message = np.zeros((n, 2))
    order = np.argsort(f.depth, kind="stable")
    cuts = np.searchsorted(f.depth[order], np.arange(f.depth.max(initial=-1) + 2))
    levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for at in levels[:0:-1]:
        m = np.logaddexp(up[at, None, 0] + w.pair[f.kind[at], :, 0], up[at, None, 1] + w.pair[f.kind[at], :, 1])
        message[at] = m - m.max(1, keepdims=True)
        for s in (0, 1):
            np.add.at(up[:, s], f.parent[at], message[at, s])
    belief = up.copy()  # with the message from above as well
    pair = np.zeros((n if pairs else 0, 2, 2))
    for at in levels[1:]:
        above = belief[f.parent[at]] - message[at]
        if pairs:
            joint = above[:, :, None] + w.pair[f.kind[at]] + up[at][:, None, :]
            joint = np.exp(joint - joint.max((1, 2), keepdims=True))
            pair[at] = joint / joint.sum((1, 2), keepdims=True)
        down = np.logaddexp(above[:, 0, None] + w.pair[f.kind[at], 0], above[:, 1, None] + w.pair[f.kind[at], 1])
        belief[at] = up[at] + down - down.max(1, keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair


def train(pages: list[Page], labels: list[list[int]], steps: int = STEPS, rate: float = 0.3, decay: float = 1e-3) -> Weights:
    """Maximum likelihood with full labels: an element holds main text if a run below it does."""
    f = forest(pages)
    truth = np.zeros(len(f.parent), int)
    truth[f.run] = [x for page in labels for x in page]
    for d in range(f.depth.max(initial=0), 0, -1):
        at = np.flatnonzero((f.depth == d) & (truth == 1))
        truth[f.parent[at]] = 1
    child = np.flatnonzero(f.parent >= 0)
    w = Weights(np.zeros(FEATURES), np.zeros((KINDS, 2, 2)))
    seen_pairs = np.zeros((KINDS, 2, 2))
    np.add.at(seen_pairs, (f.kind[child], truth[f.parent[child]], truth[child]), 1)
    square_u, square_p = np.full(FEATURES, 1e-6), np.full((KINDS, 2, 2), 1e-6)
    n_pages = len(pages)
    for _ in range(steps):
        p, pair = marginals(f, w)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, f.kind[child], pair[child])
        grad_u = np.bincount(f.feature, (truth - p)[f.owner], FEATURES) / n_pages - decay * w.unary
        grad_p = (seen_pairs - expected) / n_pages - decay * w.pair
        square_u += grad_u**2
        square_p += grad_p**2
        w.unary += rate * grad_u / np.sqrt(square_u)
        w.pair += rate * grad_p / np.sqrt(square_p)
    return w


# Labelled pages: a generator of layouts.

_CONTENT = "content post entry story article main body text prose markdown page document blog news detail".split()
_BAD = {
    "nav": ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "links"],
    "header": ["header", "masthead", "banner", "top", "site-header", "branding", "logo", "page-header", "topbar", "hero-bar"],
    "footer": ["footer", "foot", "copyright", "site-footer", "legal", "bottom", "colophon", "credits"],
    "aside": ["sidebar", "side", "aside", "widget", "rail", "secondary", "related", "recommended", "popular", "trending", "more", "tags", "author-box", "bio"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "ad-slot", "adsbygoogle", "commercial", "affiliate"],
    "notice": ["cookie", "cookie-banner", "notice", "alert", "gdpr", "consent", "popup", "modal", "newsletter", "subscribe", "paywall", "message-bar", "overlay", "disclaimer", "toast"],
    "form": ["search", "form", "login", "signup", "contact-form", "searchbox", "subscribe-form", "feedback", "survey"],
    "comments": ["comments", "comment", "comment-list", "discussion", "replies", "respond", "disqus", "comment-thread", "reader-comments", "responses", "user-comments", "reviews"],
    "share": ["share", "social", "sharing", "share-buttons", "follow", "toolbar", "actions", "meta", "byline-links"],
}
_BAD_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "ad": ["div", "aside", "section", "ins"], "notice": ["div", "aside", "section", "dialog"], "form": ["form", "div"], "comments": ["section", "div", "ol", "aside"], "share": ["div", "ul"]}


class Layouts:
    """Random pages as lists of (html, label of the next run of text or None)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.html: list[str] = []
        self.labels: list[int] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        ws = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiouéü") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for k in range(len(ws)):
            if r.random() < 0.1:
                ws[k] += r.choice(",.;")
        return " ".join(ws).capitalize()

    def run(self, tag: str, label: int, low: int, high: int, link: float = 0.0, stop: str = ".", name: str = "") -> None:
        """One element with one run of text; a part of it may be linked."""
        text = self.words(low, high) + (stop if self.r.random() < 0.85 else "")
        if self.r.random() < link:
            text = f'<a href="/x">{text}</a>'
        elif label and self.r.random() < 0.15:
            text += f' <a href="/x">{self.words(1, 3)}</a>'
        elif self.r.random() < 0.2:
            text = f"<b>{self.words(1, 2)}</b> {text}"
        self.html.append(f"<{tag}{name}>{text}</{tag}>")
        self.labels.append(label)

    def named(self, names: list[str], chance: float = 0.85) -> str:
        if self.r.random() > chance:
            return ""
        name = self.r.choice(names)
        if self.r.random() < 0.3:
            name += self.r.choice(["-wrap", "-container", "-inner", " clearfix", "-block", " row", "_box"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def open(self, tag: str, name: str = "") -> str:
        self.html.append(f"<{tag}{name}>")
        return f"</{tag}>"

    def bad(self, kind: str) -> None:
        r = self.r
        tag = r.choice(_BAD_TAGS[kind])
        sure = tag in ("div", "section", "ul", "ol", "ins", "dialog")
        end = self.open(tag, self.named(_BAD[kind], 1.0 if sure else 0.5))
        if kind in ("nav", "share") or kind == "aside" and r.random() < 0.6 or kind == "footer" and r.random() < 0.4:
            if r.random() < 0.4:
                self.run(r.choice(["h2", "h3", "h4", "p"]), 0, 1, 4, stop="")
            inner = self.open("ul") if tag not in ("ul", "ol") else ""
            for _ in range(r.randint(2, 7)):
                self.run("li", 0, 1, 6, link=0.9, stop="")
            self.html.append(inner)
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                self.html.append('<input type="text" name="q">')
                self.run(r.choice(["p", "div", "label", "legend"]) if r.random() < 0.6 else "p", 0, 1, 8, stop=":")
            self.html.append("<button>Go</button>")
        elif kind == "comments":
            if r.random() < 0.7:
                self.run(r.choice(["h2", "h3", "h4"]), 0, 1, 3, stop="")
            for _ in range(r.randint(1, 5)):
                each = self.open("li" if tag == "ol" else r.choice(["div", "article", "li", "p"]), self.named(["comment", "reply", "comment-body", "comment-content"], 0.7))
                if each == "</p>":
                    self.html.pop()
                    self.run("p", 0, 3, 40)
                    continue
                if r.random() < 0.6:
                    self.run(r.choice(["span", "div", "h4"]) if r.random() < 0.5 else "div", 0, 1, 3, stop="")
                for _ in range(r.randint(1, 2)):
                    self.run("p", 0, 3, 45)
                self.html.append(each)
        elif kind == "header":
            for _ in range(r.randint(1, 3)):
                self.run(r.choice(["h1", "h2", "div", "p"]), 0, 1, 8, link=0.4, stop="")
            if r.random() < 0.5:
                self.bad("nav")
        elif r.random() < 0.3:
            self.html.append(self.words(2, 25))
            self.labels.append(0)
        else:
            for _ in range(r.randint(1, 3)):
                self.run(r.choice(["p", "div", "p", "h3"]), 0, 2, 30, link=0.25)
        self.html.append(end)

    def good(self, depth: int = 0) -> None:
        """Some blocks of an article, with what is put between them."""
        r = self.r
        for _ in range(r.randint(1, 7)):
            x = r.random()
            if x < 0.62:
                self.run("p", 1, 1, r.choice([6, 20, 80, 160]))
            elif x < 0.72:
                self.run(r.choice(["h2", "h3", "h4"]), 1, 1, 8, stop="")
            elif x < 0.78:
                end = self.open(r.choice(["ul", "ol"]))
                for _ in range(r.randint(2, 6)):
                    self.run("li", 1, 1, 25, link=0.15)
                self.html.append(end)
            elif x < 0.81:
                end = self.open("blockquote")
                self.run("p", 1, 3, 40)
                self.html.append(end)
            elif x < 0.84:
                end = self.open("table") + ""
                for _ in range(r.randint(1, 3)):
                    self.html.append("<tr>")
                    for _ in range(2):
                        self.run("td", 1, 1, 5, stop="")
                    self.html.append("</tr>")
                self.html.append(end)
            elif x < 0.86:
                end = self.open("figure")
                self.run("figcaption", 1, 2, 12)
                self.html.append(end)
            elif x < 0.88:
                self.run("pre", 1, 3, 30)
            elif x < 0.91 and depth < 2:
                end = self.open(r.choice(["section", "div"]), self.named(_CONTENT, 0.5))
                self.good(depth + 1)
                self.html.append(end)
            elif x < 0.93:
                self.run("div", 1, 5, 60)
            else:
                self.bad(r.choice(["ad", "ad", "share", "notice", "aside", "form"]))

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.html, self.labels = ["<!DOCTYPE html><html><head><meta charset=utf-8><title>x</title><style>p{}</style><script>var t='</p>';</script></head><body>"], []
        wrap = self.open("div", self.named(["wrapper", "container", "page", "site", "outer", "layout"])) if r.random() < 0.5 else ""
        for kind, chance in (("notice", 0.2), ("header", 0.6), ("nav", 0.7), ("form", 0.2), ("ad", 0.4)):
            if r.random() < chance:
                self.bad(kind)
        row = self.open("div", self.named(["row", "columns", "layout", "wrap", "main-wrapper", "site-content"])) if r.random() < 0.4 else ""
        if r.random() < 0.25:
            self.bad("aside")
        outer = self.open("main") if r.random() < 0.3 else ""
        if r.random() < 0.15:
            self.bad("nav")
        tag = r.choice(["article", "article", "article", "div", "div", "section", "main", ""])
        end = self.open(tag, self.named(_CONTENT, 0.9 if tag in ("div", "section") else 0.4)) if tag and not (tag == "main" and outer) else ""
        if r.random() < 0.75:
            head = self.open("header") if tag == "article" and r.random() < 0.2 else ""
            self.run("h1", 1, 1, 12, stop="")
            self.html.append(head)
        self.good()
        if r.random() < 0.15:
            self.bad("comments")
        self.html.append(end + outer)
        for kind, chance in (("share", 0.2), ("comments", 0.45), ("aside", 0.35), ("ad", 0.25)):
            if r.random() < chance:
                self.bad(kind)
        self.html.append(row)
        for kind, chance in (("form", 0.15), ("notice", 0.25), ("footer", 0.8)):
            if r.random() < chance:
                self.bad(kind)
        self.html.append(wrap + "</body></html>")
        return "".join(self.html), list(self.labels)


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 1) -> tuple[list[Page], list[list[int]]]:
    """Pages of the generator whose runs the parser finds as they were written."""
    layouts, pages, labels = Layouts(seed), [], []
    while len(pages) < n:
        text, marks = layouts.page()
        page = parse(text)
        if len(page.runs) == len(marks):
            pages.append(page)
            labels.append(marks)
    return pages, labels


def extract(htmls: list[str | None], w: Weights) -> list[str]:
    """Main texts of a batch of pages."""
    pages = [parse(h) for h in htmls]
    if not pages:
        return []
    f = forest(pages)
    p, _ = marginals(f, w, pairs=False)
    keep = iter((p[f.run] > 0.5).tolist())
    return ["\n".join([text for _, text in page.runs if next(keep)]) for page in pages]


def main_text(pages: DataFrame, weights: Weights | None = None, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights or train(*labelled_pages()))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = batch.column(2)
            texts = [t for k in range(0, len(column), BATCH_PAGES) for t in extract(column.slice(k, BATCH_PAGES).to_pylist(), shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    out = pages.select("page_id", "url", F.col(html).alias("html")).mapInArrow(work, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
