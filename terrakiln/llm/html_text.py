"""HTML extraction (op2): gradient-boosted trees judge DOM nodes, a dynamic program makes their choices agree.

A tolerant reader builds the tree: void, raw-text and implied end tags, comments, unclosed and stray tags, unquoted
attributes. Its nodes are block elements and text blocks (the text between block boundaries; inline elements and <br>
don't bound one). Features of a node: depth, sibling place and counts, share of the page's text, text and tag density of
its subtree, links, list items, paragraphs, form parts, punctuation, kinds of tokens in its class, id and role, and those
of its ancestors. The trees (Newton boosting on logistic loss, exact greedy splits on 24 quantile bins) are trained once a
process on generated pages of many layouts (html_pages.py), whose parts are known; nothing of the input is used.

Decoding maximises the sum of log-probabilities over the page under the rule that what lies in a dropped node is
dropped, from the leaves up; so a node is kept with all its ancestors. Kept text blocks make the text: references
decoded, white space runs to one space, trimmed, empty ones left out, joined by one \\n in page order.

Each page is read whole, in its own partition: no shuffle. Defined cases: null or empty html has the text ""; a page
without tags is one text block; nesting may be of any depth; repeated rows give repeated
rows; an empty table an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import html_pages
from .common import lean, table

TREES, DEPTH, RATE, BINS, LEAST = 40, 4, 0.3, 24, 4.0
#: Pages whose nodes are judged together.
TOGETHER = 128

#: An attribute as browsers read it: a quote opens a value only behind a =, elsewhere it is part of a name.
_PAIR = r"""(?:[^\s/>=]++|=)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)?"""
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?>\s++|/(?!>)|{_PAIR})*+)(/?)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?""", re.S)
_ATTR = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript iframe svg math object canvas select datalist textarea button title head".split())
_RAW_TEXT = frozenset("script style textarea title iframe".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "thead": {"table"}, "tbody": {"table"}, "option": {"select"}}
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_KINDS = {
    "good": "article articlebody content main post entry story text body page hentry prose reader",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs topbar sitemap skip",
    "head": "header masthead banner branding logo hero topper",
    "foot": "footer foot copyright colophon legal bottom",
    "side": "sidebar aside widget related recommended recommendations popular trending rail more teaser promoted tags archive",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense adbox commercial dfp outbrain taboola",
    "note": "cookie cookies consent gdpr notice alert popup modal overlay banner toast newsletter subscribe subscription signup paywall warning disclaimer",
    "talk": "comment comments reply replies discussion disqus respond thread reviews guestbook",
    "form": "form search login register input contact feedback",
    "share": "share sharing social follow facebook twitter print email author byline meta",
    "off": "hidden none sr offscreen invisible",
}
_KIND_OF: dict[str, int] = {}
for _i, _words in enumerate(_KINDS.values()):
    for _w in _words.split():
        _KIND_OF[_w] = _KIND_OF.get(_w, 0) | 1 << _i
_TAG_BITS = {"article": 0, "main": 1, "nav": 2, "header": 3, "footer": 4, "aside": 5, "form": 6, "dialog": 2, "menu": 2, "section": 7, "h1": 8, "h2": 9, "h3": 9, "h4": 9, "p": 10, "ul": 11, "ol": 11, "dl": 11, "table": 12, "blockquote": 13, "pre": 13, "figure": 13, "li": 14, "div": 15}
_N_TAG, _N_KIND = 16, len(_KINDS)


class Node:
    __slots__ = ("bits", "block", "children", "depth", "kinds", "parent", "tag", "text", "up_bits", "up_kinds")

    def __init__(self, tag: str, parent: Node | None, kinds: int = 0):
        self.tag, self.parent, self.kinds = tag, parent, kinds
        self.children: list[Node] = []
        self.text: str | None = None
        self.bits = 1 << _TAG_BITS[tag] if tag in _TAG_BITS else 0
        if parent is None:
            self.depth, self.up_bits, self.up_kinds = 0, 0, 0
        else:
            self.depth, self.up_bits, self.up_kinds = parent.depth + 1, parent.up_bits | parent.bits, parent.up_kinds | parent.kinds
            parent.children.append(self)


def _kinds(attributes: str) -> int:
    bits = 0
    for name, value in _ATTR.findall(attributes):
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and "true" in value) or (name == "style" and _UNSEEN.search(value)):
            bits |= _KIND_OF["none"]
        elif name in ("class", "id", "role", "itemprop"):
            for word in _WORDS.findall(value):
                bits |= _KIND_OF.get(word.lower(), 0)
    return bits


def read(page: str) -> tuple[Node, list[tuple[Node, int, int]]]:
    """The tree of block nodes; text blocks are leaves with tag "#text". Links: characters of link text by leaf."""
    root = Node("#root", None)
    stack = [root]
    inline: list[str] = []  # open inline elements that matter (a)
    pieces: list[str] = []
    linked, tags = 0, 0
    facts: list[tuple[Node, int, int]] = []
    closers: dict[str, re.Pattern] = {}
    opened: Counter[str] = Counter()

    def shut_from(i: int) -> None:
        for node in stack[i:]:
            opened[node.tag] -= 1
        del stack[i:]

    def flush() -> None:
        nonlocal linked, tags
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                leaf = Node("#text", stack[-1])
                leaf.text = text
                facts.append((leaf, min(linked, len(text)), tags))
            pieces.clear()
        linked, tags = 0, 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            said = html.unescape(piece) if "&" in piece else piece
            pieces.append(said)
            if inline:
                linked += len(said.strip())

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[6]
        if tag is None:
            continue
        tag = tag.lower()
        closing = m[1] or m[5]
        if not closing and tag in _RAW:
            if tag in _RAW_TEXT or tag in ("svg", "math", "noscript", "template", "object", "canvas", "select", "datalist", "button", "head"):
                closer = closers.get(tag) or closers.setdefault(tag, re.compile(rf"</{tag}\s*>" + (r"|<body\b" if tag == "head" else ""), re.I))
                shut = closer.search(page, at)
                if tag == "head":
                    at = (shut.start() if shut[0].startswith(("<b", "<B")) else shut.end()) if shut else at
                elif tag not in ("svg",) or not (m[4] and not shut):
                    at = shut.end() if shut else (end if tag in ("script", "style") else at)
                if tag not in ("button", "svg", "math", "canvas", "object", "select"):
                    flush()
            continue
        if tag in _INLINE:
            tags += 1
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                if closing:
                    inline.clear()
                else:
                    inline[:] = ["a"]
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        inline.clear()
        if closing:
            if opened[tag] > 0:
                shut_from(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in ("html", "body") and opened[tag] > 0:
            continue
        if tag in _ENDS_P and stack[-1].tag == "p":
            shut_from(len(stack) - 1)
        if tag in _ENDED_BY and any(opened[x] > 0 for x in _ENDED_BY[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _HOLDS.get(tag, ()):
                    break
                if stack[i].tag in _ENDED_BY[tag]:
                    shut_from(i)
                    break
        node = Node(tag, stack[-1], _kinds(m[3] or m[7] or "") if (m[3] or m[7]) else 0)
        if not m[4]:
            stack.append(node)
            opened[tag] += 1
    flush()
    return root, facts


def features(root: Node, facts: list[tuple[Node, int, int]]) -> tuple[list[Node], np.ndarray]:
    """The nodes of the page, parents first, and a row of figures for each."""
    order: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(reversed(node.children))
    own = {id(leaf): (links, tags) for leaf, links, tags in facts}
    place = {id(n): i for i, n in enumerate(order)}
    # sums over subtrees: characters, link characters, inline tags, text blocks, elements, p, li, form parts, sentence ends, commas, long blocks
    sums = np.zeros((len(order), 11))
    for i, n in enumerate(order):
        if n.text is not None:
            t = n.text
            links, tags = own[id(n)]
            sums[i] = (len(t), links, tags, 1, 0, 0, 0, 0, t.count(". ") + t.count("! ") + t.count("? ") + (t[-1] in ".!?"), t.count(","), len(t) > 80)
        else:
            sums[i, 4:8] = (1, n.tag == "p", n.tag == "li", n.tag in ("form", "fieldset"))
    rows = sums.tolist()
    for i in range(len(order) - 1, 0, -1):
        up, here = rows[place[id(order[i].parent)]], rows[i]
        for j in range(11):
            up[j] += here[j]
    all_chars, all_nodes = max(1.0, rows[0][0]), len(order)
    out = np.zeros((len(order), 16 + 2 * (_N_TAG + _N_KIND)), np.float32)
    for i, n in enumerate(order):
        chars, links, tags, texts, elements, ps, lis, forms, stops, commas, longs = rows[i]
        up = n.parent
        siblings = up.children if up else [n]
        at = i and (place[id(n)] / all_nodes)
        out[i, :16] = (
            n.depth, len(n.children), len(siblings), at, chars / all_chars, math.log1p(chars), links / max(1.0, chars), (elements + tags) / max(1.0, chars) * 100,
            chars / max(1.0, texts), ps, lis / max(1.0, elements), forms, stops / max(1.0, texts), commas / max(1.0, chars) * 100, longs, n.text is not None,
        )
    masks = np.array([(n.bits, n.kinds, n.up_bits, n.up_kinds) for n in order], np.int64)
    a = 16
    for column, width in ((0, _N_TAG), (1, _N_KIND), (2, _N_TAG), (3, _N_KIND)):
        out[:, a : a + width] = masks[:, column, None] >> np.arange(width) & 1
        a += width
    return order, out


class Boosted:
    """Trees as arrays: 2 ** DEPTH - 1 splits and 2 ** DEPTH leaves each."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(self.cuts, x.T, strict=True)], 1).astype(np.int64)
        useful = [f for f in range(x.shape[1]) if len(np.unique(binned[:, f])) > 1]
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.zeros(len(y))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (p - y), weight * p * (1 - p)
            feature, cut, value = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf, np.float32), np.zeros(2**DEPTH)
            where = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                width = 2**level
                best, best_f, best_b = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
                gs, hs = np.bincount(where, g, width), np.bincount(where, h, width)
                for f in useful:
                    cell = where * (BINS + 1) + binned[:, f]
                    left_g = np.cumsum(np.bincount(cell, g, width * (BINS + 1)).reshape(width, -1), 1)[:, :-1]
                    left_h = np.cumsum(np.bincount(cell, h, width * (BINS + 1)).reshape(width, -1), 1)[:, :-1]
                    right_g, right_h = gs[:, None] - left_g, hs[:, None] - left_h
                    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - (gs**2 / (hs + 1))[:, None]
                    gain[(left_h < LEAST / 4) | (right_h < LEAST / 4)] = 0
                    b = gain.argmax(1)
                    top = gain[np.arange(width), b]
                    better = top > best + 1e-12
                    best[better], best_f[better], best_b[better] = top[better], f, b[better]
                for k in range(width):
                    if best_b[k] >= 0 and best_b[k] < len(self.cuts[best_f[k]]):
                        feature[width - 1 + k], cut[width - 1 + k] = best_f[k], self.cuts[best_f[k]][best_b[k]]
                node = width - 1 + where
                where = 2 * where + (x[np.arange(len(y)), feature[node]] > cut[node])
            value = -RATE * np.bincount(where, g, 2**DEPTH) / (np.bincount(where, h, 2**DEPTH) + 1)
            self.trees.append((feature, cut, value))
            score += value[where]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds that a node is kept."""
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, value in self.trees:
            where = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                node = 2**level - 1 + where
                where = 2 * where + (x[rows, feature[node]] > cut[node])
            out += value[where]
        return out


_model: list[Boosted] = []


def model() -> Boosted:
    """Trained once a process on the generated pages."""
    if not _model:
        xs, ys, ws = [], [], []
        for page, marks in html_pages.generate():
            order, x = features(*read(page))
            keep = np.zeros(len(order))
            for i in range(len(order) - 1, -1, -1):
                n = order[i]
                keep[i] = float(any(m in n.text for m in marks)) if n.text is not None else max([0.0, *(keep[j] for j in _children(order, i))])
            xs.append(x)
            ys.append(keep)
            ws.append(np.array([2.0 if n.text is not None else 1.0 for n in order]))
        _model.append(Boosted(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws)))
    return _model[0]


def _children(order: list[Node], i: int) -> Iterator[int]:
    depth = order[i].depth
    for j in range(i + 1, len(order)):
        if order[j].depth <= depth:
            return
        if order[j].depth == depth + 1:
            yield j


def decode(order: list[Node], odds: np.ndarray) -> list[str]:
    """The kept text blocks, in page order."""
    place = {id(n): i for i, n in enumerate(order)}
    keep = (-np.logaddexp(0, -odds)).tolist()
    drop = (-np.logaddexp(0, odds)).tolist()
    for i in range(len(order) - 1, 0, -1):
        up = place[id(order[i].parent)]
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
    kept = [False] * len(order)
    out = []
    for i, n in enumerate(order):
        kept[i] = (n.parent is None or kept[place[id(n.parent)]]) and keep[i] > drop[i]
        if kept[i] and n.text is not None:
            out.append(n.text)
    return out


def extract(pages: list[str | None], judge: Boosted) -> list[str]:
    """The main text of each page."""
    read_pages = [features(*read(p)) if p else None for p in pages]
    full = [r for r in read_pages if r is not None]
    odds = judge.score(np.concatenate([x for _, x in full])) if full else np.zeros(0)
    out, at = [], 0
    for r in read_pages:
        if r is None:
            out.append("")
        else:
            out.append("\n".join(decode(r[0], odds[at : at + len(r[0])])))
            at += len(r[0])
    return out


def _extract(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                texts = extract(part.column(2).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each of pages (page_id, url, html, ...)."""
    sent = pages.sparkSession.sparkContext.broadcast(model())
    return pages.select(pages["page_id"].cast("long"), "url", "html").mapInArrow(lean(_extract(sent)), "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
