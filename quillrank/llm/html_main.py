"""Main text of web pages by gradient-boosted trees over the nodes of the DOM.

A tolerant parser builds the tree (implied end tags, void and raw-text elements, unclosed tags, comments, cut-off pages).
Each element with text below it gets features: tag, tokens of class, id and role, depth, subtree text, link and tag
densities, sibling statistics and place on the page. Boosted trees with logistic loss, trained in numpy on pages that a
generator makes with known labels, give each element the log-odds of being main text if its parent is. Decoding is
hierarchical: probabilities multiply along the path from the root, so an ancestor and its descendants never contradict
each other.

Blocks are runs of text between block-level tags; references are decoded, white space (line breaks too) becomes one
space, and blocks are joined by two newlines. Nothing else is dropped or capped.

Nulls: a null html is empty and has empty text. Pages are independent: repeated rows give repeated results, empty tables
empty ones; columns other than the named ones are never read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillrank.llm._common import byte_texts, map_arrow, slices

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("script style title xmp iframe noembed noframes template svg head noscript select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tbody tfoot", "tbody": "thead tbody", "tfoot": "thead tbody"}
SAME = {k: frozenset(v.split()) for k, v in SAME.items()}
SCOPE = frozenset("table td th ul ol dl article section main div body html aside nav form button".split())
P_ONLY, LISTS = frozenset(["p"]), frozenset("ul ol dl table select".split())
TAGS = "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dd dt table tr td blockquote pre figure figcaption header footer nav aside form button label textarea fieldset a span b strong em i small address details dialog menu".split()
TAG_AT = {t: i for i, t in enumerate(TAGS)}

_tag = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)[^>\"']*+|[!?/][^>]*>)", re.S)
_cut = re.compile(r"<(?:!--.*\Z|[a-zA-Z!/][^<>]*\Z)", re.S)  # after the last ">"
_stop = re.compile(r"[>\"']")
_attr = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_token = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    tags: list[str]
    parents: list[int]
    attrs: list[str]
    segments: list[tuple[int, int, str]]  # block, element, raw text


def tag_end(source: str, at: int, dead: set[int]) -> int:
    """Where the tag that goes on at at has its ">": the first outside quoted values of any length; if there is none, or a
    quote stays open, the first of all. dead: opening quotes from which no end was found, kept for a page, so that each
    is followed once and a page takes linear time."""
    x, tried = at, []
    while m := _stop.search(source, x):
        k = m.start()
        if source[k] == ">":
            return k
        if k in dead:
            break
        tried.append(k)
        x = source.find(source[k], k + 1) + 1
        if not x:
            break
    dead.update(tried)
    return source.find(">", at)


def closed(stack: list[int], tags: list[str], is_open: Counter, ends: frozenset[str], scope: frozenset[str]) -> None:
    """Closes the innermost open element of ends, with what is open within it, unless one of scope is met first."""
    for k in range(len(stack) - 1, 0, -1):
        t = tags[stack[k]]
        if t in ends:
            is_open.subtract(tags[x] for x in stack[k:])
            del stack[k:]
            return
        if t in scope:
            return


def parse(source: str) -> Page:
    """Elements in document order (0 is a root above all) and their texts."""
    tags, parents, attrs, segments = ["#root"], [-1], [""], []
    stack, block, at, silent = [0], 0, 0, 0
    is_open = Counter()  # open elements by name: a close tag without one needn't search the stack
    last, dead = source.rfind(">"), set()
    while True:
        m = _tag.search(source, at) if at <= last else None
        if m is None or m.start() > last:
            m = _cut.search(source, max(at, last + 1))
        stop = m.start() if m else len(source)
        if stop > at and not silent:
            segments.append((block, stack[-1], source[at:stop]))
        if m is None:
            break
        at = m.end()
        if m.re is _cut or m[2] is None:
            continue
        name, stop = m[2].lower(), tag_end(source, at, dead)
        at = stop + 1
        if m[1]:
            if name == "br" and not silent:
                segments.append((block, stack[-1], " "))
                continue
            if is_open[name]:
                while True:
                    own = tags[stack.pop()]
                    is_open[own] -= 1
                    silent -= own in SILENT
                    if own == name:
                        break
            if name not in INLINE:
                block += 1
            continue
        if name in CLOSES_P:
            if is_open["p"]:
                closed(stack, tags, is_open, P_ONLY, SCOPE)
        elif name in SAME:
            if any(is_open[t] for t in SAME[name]):
                closed(stack, tags, is_open, SAME[name], LISTS)
        elif name == "body" and silent:  # a head that isn't closed
            while len(stack) > 1 and tags[stack[-1]] != "html":
                is_open[tags[stack[-1]]] -= 1
                silent -= tags[stack.pop()] in SILENT
        if name == "br":
            if not silent:
                segments.append((block, stack[-1], " "))
            continue
        if name not in INLINE:
            block += 1
        if name in VOID:
            continue
        rest = source[m.end(2) : stop]
        if rest.endswith("/") and name in ("svg", "path", "use"):
            continue
        tags.append(name)
        parents.append(stack[-1])
        attrs.append(rest)
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            if name not in SILENT and not silent:
                segments.append((block, len(tags) - 1, source[at : end.start() if end else len(source)]))
            at = end.end() if end else len(source)
            block += 1
            continue
        stack.append(len(tags) - 1)
        is_open[name] += 1
        silent += name in SILENT
    return Page(tags, parents, attrs, segments)


def attr_tokens(rest: str) -> frozenset[str]:
    return short_tokens(rest) if len(rest) <= 2000 else short_tokens.__wrapped__(rest)  # long ones aren't kept


@lru_cache(maxsize=20_000)
def short_tokens(rest: str) -> frozenset[str]:
    return frozenset(t.lower() for m in _attr.finditer(rest) for t in _token.findall(m[2] or m[3] or m[4] or ""))


NUMERIC = ("depth", "log_text", "share", "link_density", "tags_per_text", "mean_block", "place", "sibling_at", "siblings", "sibling_share", "same_tag_siblings", "children", "commas", "in_article", "in_edge", "has_p", "has_h", "parent_links")
EDGE = frozenset("nav header footer aside form menu dialog".split())


def features(page: Page, vocab: dict[str, int]) -> np.ndarray:
    """Rows for all elements: numeric ones, tags, then attribute tokens of vocab."""
    n = len(page.tags)
    parent = np.array(page.parents)
    own, links, commas, blocks = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    before = np.zeros(n)
    seen, last = 0, -1
    first_text: dict[int, int] = {}
    for b, e, t in page.segments:
        size = len(t) if not t.isspace() else 0
        if size:
            first_text.setdefault(e, seen)
            own[e] += size
            commas[e] += t.count(",") + t.count(".")
            if b != last:
                blocks[e] += 1
                last = b
            seen += size
    tag = np.array([TAG_AT.get(t, -1) for t in page.tags])
    text, sub, kids = own.copy(), np.ones(n), np.zeros(n)
    is_a = np.array([t == "a" for t in page.tags])
    has_p, has_h = np.array([t == "p" for t in page.tags], float), np.array([t in ("h1", "h2", "h3") for t in page.tags], float)
    depth, in_article, in_edge, place = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -1.0)
    sibling_at = np.zeros(n)
    par = page.parents
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = par[i]
        links[i] = text[i] if is_a[i] else links[i]
        text[p] += text[i]
        links[p] += links[i]
        commas[p] += commas[i]
        blocks[p] += blocks[i]
        sub[p] += sub[i]
        kids[p] += 1
        has_p[p] += has_p[i]
        has_h[p] += has_h[i]
    count = np.zeros(n)
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = par[i]
        depth[i] = depth[p] + 1
        in_article[i] = in_article[p] or page.tags[i] in ("article", "main")
        in_edge[i] = in_edge[p] or page.tags[i] in EDGE
        sibling_at[i] = count[p]
        count[p] += 1
        same[p, page.tags[i]] = same.get((p, page.tags[i]), 0) + 1
        place[i] = first_text.get(i, -1)
    for i in range(n - 1, 0, -1):
        if place[i] >= 0 and (place[par[i]] < 0 or place[i] < place[par[i]]):
            place[par[i]] = place[i]
    total = max(1.0, text[0])
    x = np.zeros((n, len(NUMERIC) + len(TAGS) + len(vocab)), np.float32)
    up = np.maximum(parent, 0)
    x[:, 0] = depth
    x[:, 1] = np.log1p(text)
    x[:, 2] = text / total
    x[:, 3] = links / np.maximum(text, 1)
    x[:, 4] = sub / np.maximum(text, 1) * 100
    x[:, 5] = np.log1p(text / np.maximum(blocks, 1))
    x[:, 6] = np.maximum(place, 0) / total
    x[:, 7] = sibling_at / np.maximum(count[up], 1)
    x[:, 8] = count[up]
    x[:, 9] = text / np.maximum(text[up], 1)
    x[:, 10] = [same.get((p, t), 0) for p, t in zip(par, page.tags, strict=True)]
    x[:, 11] = kids
    x[:, 12] = commas / np.maximum(text, 1) * 100
    x[:, 13], x[:, 14], x[:, 15], x[:, 16] = in_article, in_edge, np.log1p(has_p), np.log1p(has_h)
    x[:, 17] = links[up] / np.maximum(text[up], 1)
    known = tag >= 0
    x[np.flatnonzero(known), len(NUMERIC) + tag[known]] = 1
    base = len(NUMERIC) + len(TAGS)
    for i, rest in enumerate(page.attrs):
        if rest:
            for t in attr_tokens(rest):
                if (k := vocab.get(t)) is not None:
                    x[i, base + k] = 1
    return x


class Trees:
    """Gradient-boosted regression trees of a fixed depth for logistic loss, on binned features."""

    def __init__(self, depth: int = 5, rounds: int = 60, rate: float = 0.25, bins: int = 24, ridge: float = 2.0):
        self.depth, self.rounds, self.rate, self.bins, self.ridge = depth, rounds, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        edges = [np.unique(np.concatenate((e, [0.5]))) if set(np.unique(x[:200, j])) <= {0.0, 1.0} else e for j, e in enumerate(edges)]
        width = max(map(len, edges)) + 1
        b = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        flat = b + np.arange(m) * width
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.threshold, self.value = np.zeros((self.rounds, size), np.int32), np.full((self.rounds, size), np.inf, np.float32), np.zeros((self.rounds, size))
        p0 = (weight * y).sum() / weight.sum()
        self.base = float(np.log(p0 / (1 - p0)))
        f = np.full(n, self.base)
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth + 1):
                first, many = 2**level - 1, 2**level
                k = node - first
                tg, th = np.bincount(k, g, many), np.bincount(k, h, many)
                self.value[r, first : first + many] = self.rate * tg / (th + self.ridge)
                if level == self.depth:
                    break
                key = (k[:, None] * (m * width) + flat).ravel()
                hg = np.bincount(key, np.repeat(g, m), many * m * width).reshape(many, m, width)
                hh = np.bincount(key, np.repeat(h, m), many * m * width).reshape(many, m, width)
                lg, lh = hg.cumsum(2), hh.cumsum(2)
                rg, rh = tg[:, None, None] - lg, th[:, None, None] - lh
                gain = lg**2 / (lh + self.ridge) + rg**2 / (rh + self.ridge) - (tg**2 / (th + self.ridge))[:, None, None]
                gain[(lh < 1) | (rh < 1)] = 0
                best = gain.reshape(many, -1).argmax(1)
                for q in range(many):
                    j, cut = divmod(int(best[q]), width)
                    if gain[q, j, cut] > 1e-6 and cut < len(edges[j]):
                        self.feature[r, first + q], self.threshold[r, first + q] = j, edges[j][cut]
                node = 2 * node + 1 + (x[np.arange(n), self.feature[r, node]] > self.threshold[r, node])
            f += self.value[r, node]
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for r in range(self.rounds):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[r, node]] > self.threshold[r, node])
            f += self.value[r, node]
        return f


def decode(parents: list[int], logit: np.ndarray) -> np.ndarray:
    """The trees give the odds that an element is main text if its parent is. An element's own probability is the product
    along its path, which never grows downwards: keeping those above one half leaves no kept element below a dropped
    one."""
    p = (1 / (1 + np.exp(-logit))).tolist()
    p[0] = 1.0
    for i in range(1, len(p)):
        p[i] *= p[parents[i]]
    return np.array(p) > 0.5


def assembled(page: Page, kept) -> str:
    out, last, parts = [], None, []
    for b, e, t in page.segments:
        if b != last:
            if parts:
                out.append("".join(parts))
            last, parts = b, []
        if kept[e]:
            parts.append(t)
    if parts:
        out.append("".join(parts))
    blocks = (" ".join(entities.unescape(x).split()) for x in out)
    return "\n\n".join(x for x in blocks if x)


@dataclass
class Model:
    trees: Trees
    vocab: dict[str, int]

    def extract(self, sources: list[str]) -> list[str]:
        pages = [parse(s) for s in sources]
        xs = [features(p, self.vocab) for p in pages]
        logit = self.trees.logits(np.concatenate(xs)) if xs else np.zeros(0)
        out, at = [], 0
        for p, x in zip(pages, xs, strict=True):
            own = logit[at : at + len(x)]
            for i, t in enumerate(p.tags):
                if t in ("html", "body"):  # they hold everything
                    own[i] = 30
            out.append(assembled(p, decode(p.parents, own)))
            at += len(x)
        return out


# --- training pages -------------------------------------------------------------------------------------------------

#: Words that sites use in class and id attributes, by the part of the page that they name.
NAMES = {
    "nav": "nav navbar menu navigation topnav links breadcrumb breadcrumbs toc pagination pager skip".split(),
    "header": "header masthead top site-header banner branding logo topbar hero".split(),
    "footer": "footer foot site-footer bottom copyright legal colophon".split(),
    "sidebar": "sidebar side aside widget rail secondary related recommended trending popular more-stories".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion adsense ad-slot outbrain".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall banner message".split(),
    "form": "form search newsletter subscribe signup login contact feedback".split(),
    "comments": "comments comment reply replies disqus respond discussion comment-list reader-comments".split(),
    "share": "share social sharing follow tags byline meta toolbar".split(),
    "main": "article content main post entry story body text article-body post-content entry-content page-content".split(),
}
SYLLABLES = "the an on ti re ed in er sh ou le que es ver ung ción ado la de eau tion st lich".split()


class Writer:
    """Makes pages whose elements are marked as main text or not."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, x):
        return x[int(self.rng.integers(len(x)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def sentence(self, lo: int, hi: int) -> str:
        n = int(self.rng.integers(lo, hi + 1))
        return " ".join("".join(self.pick(SYLLABLES) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n)).capitalize() + self.pick([".", ".", "", "!"])

    def prose(self) -> str:
        size = self.pick([1, 1, 2, 4, 8, 20])
        text = " ".join(self.sentence(1, 18) for _ in range(size))
        if self.chance(0.1):
            text += " " + self.element("a", self.sentence(1, 5), True, "href='/x'")
        return text

    def element(self, tag: str, inner: str, main: bool, attrs: str = "") -> str:
        return f"<{tag} {attrs} data-main={int(main)}>{inner}</{tag}>"

    def named(self, part: str, p: float = 0.8) -> str:
        if not self.chance(p):
            return ""
        name = self.pick(NAMES[part])
        if self.chance(0.25):
            name += " " + self.pick(["box", "wrap", "inner", "container", "col", self.pick(NAMES[part])])
        if self.chance(0.15):
            name = self.pick(["site-", "page-", "js-", "main-" if part == "main" else "l-"]) + name
        return f"{self.pick(['class', 'class', 'id'])}=\"{name}\""

    def links(self, main: bool = False) -> str:
        n = int(self.rng.integers(2, 9))
        a = [self.element("a", self.sentence(1, 3), main, "href='/y'") for _ in range(n)]
        if self.chance(0.6):
            return self.element("ul", "".join(self.element("li", x, main) for x in a), main)
        return self.pick([" ", " | ", " · "]).join(a)

    def block(self, depth: int = 0) -> str:
        k = self.rng.random()
        if k < 0.66:
            return self.element("p", self.pick(["", "", "<b>"]) + self.prose(), True)
        if k < 0.78:
            return self.element(self.pick(["h2", "h3", "h4"]), self.sentence(1, 9), True)
        if k < 0.86:
            return self.element(self.pick(["ul", "ol"]), "".join(self.element("li", self.prose(), True) for _ in range(int(self.rng.integers(1, 6)))), True)
        if k < 0.90:
            return self.element("blockquote", self.element("p", self.prose(), True), True)
        if k < 0.92:
            return self.element("pre", self.sentence(3, 20), True)
        if k < 0.95:
            return self.element("figure", "<img src=x>" + self.element("figcaption", self.sentence(2, 12), True), True)
        if k < 0.97:
            return self.element("table", "".join(self.element("tr", "".join(self.element("td", self.sentence(1, 4), True) for _ in range(3)), True) for _ in range(3)), True)
        return self.element("div", self.prose() if depth else self.block(1), True)

    def noise_inside(self) -> str:
        part = self.pick(["ad", "ad", "share", "form", "notice", "sidebar"])
        return self.aside_of(part)

    def aside_of(self, part: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}.get(part, "div")
        if not self.chance(0.6):
            tag = self.pick(["div", "section", "div"])
        attrs = self.named(part, 0.95 if tag in ("div", "section") else 0.4)
        if tag in ("div", "section") and not attrs:
            attrs = f'class="{self.pick(NAMES[part])}"'
        if part == "comments":
            inner = self.element(self.pick(["h2", "h3"]), self.sentence(1, 3), False) if self.chance(0.6) else ""
            for _ in range(int(self.rng.integers(1, 6))):
                body = self.element("p", self.prose(), False)
                inner += self.element(self.pick(["div", "li", "article"]), self.element("b", self.sentence(1, 2), False) + body, False, self.named("comments", 0.7))
        elif part in ("nav", "share"):
            inner = self.links()
        elif part == "header":
            inner = self.element(self.pick(["h1", "div", "p", "a"]), self.sentence(1, 5), False) + (self.aside_of("nav") if self.chance(0.4) else "")
        elif part == "form":
            inner = self.element("label", self.sentence(1, 4), False) + "<input name=q>" + self.element("button", self.sentence(1, 2), False) + (self.element("p", self.sentence(3, 15), False) if self.chance(0.4) else "")
        elif part == "sidebar":
            inner = self.element(self.pick(["h2", "h3", "h4"]), self.sentence(1, 3), False) + (self.links() if self.chance(0.6) else self.element("p", self.prose(), False))
        elif part == "footer":
            inner = "&copy; " + self.sentence(1, 8) if self.chance(0.5) else self.element("p", "&copy; " + self.sentence(1, 12), False) + self.links()
        else:
            inner = self.sentence(1, 14) if self.chance(0.5) else self.element("p", self.prose(), False) + (self.element("button", self.sentence(1, 2), False) if self.chance(0.4) else "")
        return self.element(tag, inner, False, attrs)

    def page(self) -> str:
        blocks = [self.element("h1", self.sentence(2, 12), True)] if self.chance(0.85) else []
        for _ in range(self.pick([1, 2, 3, 5, 8, 14])):
            blocks.append(self.block())
            if self.chance(0.06):
                blocks.append(self.noise_inside())
        if self.chance(0.12):
            blocks.append(self.aside_of(self.pick(["comments", "share", "form"])))
        inner = "".join(blocks)
        kind = self.rng.random()
        if kind < 0.5:
            inner = self.element("article", inner, True, self.named("main", 0.3))
            if self.chance(0.3):
                inner = self.element(self.pick(["main", "div"]), inner, True, self.named("main", 0.6))
        elif kind < 0.65:
            inner = self.element("main", inner, True, self.named("main", 0.3))
        elif kind < 0.92:
            inner = self.element(self.pick(["div", "div", "section"]), inner, True, self.named("main", 0.8))
        top = [self.aside_of(p) for p in ("notice", "header", "nav", "ad", "nav", "form", "sidebar", "share") if self.chance(0.35)]
        end = [self.aside_of(p) for p in ("sidebar", "ad", "comments", "share", "sidebar", "form", "notice", "footer") if self.chance(0.35)]
        self.rng.shuffle(end)
        if self.chance(0.15):
            inner, end = self.element("div", inner + "".join(end[:2]), True, "class=wrap"), end[2:]
        return f"<html><head><title>x</title></head><body>{''.join(top)}{inner}{''.join(end)}</body></html>"


_marked = re.compile(r"data-main=(\d)")


def train(pages: int = 1000, seed: int = 3) -> Model:
    """Trains on generated pages; the vocabulary is what their attributes say."""
    writer = Writer(seed)
    parsed = [parse(writer.page()) for _ in range(pages)]
    names = sorted({t for v in NAMES.values() for x in v for t in attr_tokens(f' class="{x}"')})
    vocab = {t: i for i, t in enumerate(names)}
    xs, ys = [], []
    for p in parsed:
        x = features(p, vocab)
        mark = [m[1] == "1" if (m := _marked.search(a)) else True for a in p.attrs]
        use = [i for i, a in enumerate(p.attrs) if i and _marked.search(a) and x[i, 1] > 0 and mark[p.parents[i]]]
        xs.append(x[use])
        ys += [int(mark[i]) for i in use]
    x, y = np.concatenate(xs), np.array(ys, float)
    return Model(Trees().fit(x, y, np.ones(len(y))), vocab)


def extract(df: DataFrame, id_col: str, url_col: str, html_col: str, model: Model) -> DataFrame:
    """Per page: id_col, url_col, text. The model is a few hundred kilobytes, whatever the table's size."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            for part in slices(batch, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(m.extract([t.decode() for t in byte_texts(part.column(2))]), pa.string())], names=["id", "url", "text"])

    kinds = dict(df.dtypes)
    got = map_arrow(df.select(id_col, url_col, html_col), run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string")
    return got.withColumnsRenamed({"id": id_col, "url": url_col})
