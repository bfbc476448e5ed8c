"""Main text of web pages: boosted trees over DOM nodes, decoded so that a node never contradicts its ancestors.

A page becomes a tree of elements. Every element that holds text gets features: its own and its
ancestors' kind of tag and of attribute tokens, depth, density of its subtree (text, links, tags,
controls, paragraphs), its share of the page and of its parent, and the same of its siblings. A
gradient-boosted classifier gives the probability that the subtree holds main text. Decoding takes
the most probable labelling in which everything below a rejected element is rejected (a maximum
over the tree, from the leaves up), so no text is kept inside a rejected part.

The classifier is trained on a bounded sample (``SAMPLE`` pages with the smallest hashes of their
content). Labels come from the pages' semantic elements. Most pages use few layouts, so every
sampled page is also laid out anew ``VARIANTS`` times from its own texts: other containers and names,
menus, side bars, notices, adverts, forms and comments, with labels known from the making. A page as it
is counts ``REAL`` times.

Text: character references are decoded; white space inside a block becomes one space; blocks are
trimmed and joined by one line end. A line break element is white space.

Nulls: null or empty html has the empty text; null ids and urls are kept. Broken markup is read to
its end; a declaration that is none is a comment up to the next ``>``. Repeated pages are treated one by one; an empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import on_arrow, require, written

SAMPLE, VARIANTS, REAL, TREES, DEPTH, INSIDE, BARE = 300, 5, 3, 24, 5, 0.8, 0.98
BARE_TAGS = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 li dt dd tr td th".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object select option textarea button canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img input".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("td", ("tr", "table")), "p": ("p", ("td", "div", "article", "section"))}

#: Kinds of tags and of attribute tokens.
TAGS = {"main": "article main", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset", "section": "section", "box": "div", "par": "p blockquote pre figure figcaption",
        "head": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "item": "li dt dd", "table": "table tbody thead tfoot tr td th", "page": "html body"}
WORDS = {
    "main": "article content post entry story main body text blog",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs links pagination pager tabs toc skip",
    "ad": "ad ads adv advert adverts advertisement adbox banner sponsor sponsored promo promotion dfp outbrain taboola",
    "comment": "comment comments reply replies discussion disqus respond reader feedback thread",
    "footer": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside widget widgets related recommended popular trending more rail column",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning message toast privacy",
    "form": "form search login signin signup subscribe subscription newsletter register contact input field",
    "header": "header head masthead top topbar logo brand hero",
    "share": "share sharing social follow tags tag meta byline author",
}
_TAG = {t: k for k, ts in enumerate(TAGS.values()) for t in ts.split()}
_WORD = {w: k for k, ws in enumerate(WORDS.values()) for w in ws.split()}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_LONG = re.compile(r"&#([0-9]{100,});?")  # longer numbers than Python reads


def _short(reference: re.Match) -> str:
    digits = reference[1].lstrip("0")
    return f"&#{digits or 0};" if len(digits) < 8 else "\ufffd"


class Tree(HTMLParser):
    """Elements of a page as parallel lists, and its blocks of text in page order: (element, text, link characters)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.words, self.given, self.blocks = [-1], ["html"], [0], [""], []
        self.tags, self.controls, self.links = [0], [0], [0]
        self.stack, self.silent, self.text, self.anchor, self.linked = [0], 0, [], 0, 0
        self.feed(_LONG.sub(_short, html))
        self.close()
        self._flush()

    def parse_marked_section(self, i, report=1):
        """As browsers do: whatever begins with ``<![`` is a comment up to the next ``>``, and reading goes on behind it."""
        return self.parse_bogus_comment(i, report)

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            node = next((n for n in reversed(self.stack) if self.tag[n] not in INLINE), 0)
            self.blocks.append((node, text, min(self.linked, len(text))))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag in SILENT and tag not in VOID:
                self.stack.append(self._new(tag, attrs))
                self.silent += 1
            return
        if tag == "html" or tag == "body" and "body" in (self.tag[n] for n in self.stack):
            return
        if tag not in INLINE:
            self._flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in CLOSES_P:
            self._end("p", ("td", "th", "li", "div", "article", "section", "body", "aside", "form"))
        if tag in CLOSES and tag != "p":
            for t in (tag, CLOSES[tag][0]):
                self._end(t, CLOSES[tag][1])
        self.tags[self.stack[-1]] += 1
        if tag in ("input", "select", "textarea", "button"):
            self.controls[self.stack[-1]] += 1
        if tag in VOID:
            return
        self.stack.append(self._new(tag, attrs))
        if tag == "a":
            self.anchor += 1
            self.links[self.stack[-1]] += 1
        if tag in SILENT:
            self.silent += 1

    def _new(self, tag, attrs) -> int:
        bits, given = 0, ""
        for name, value in attrs:
            if name == "data-y":
                given = value or ""
            if value and name in ("class", "id", "role", "aria-label", "itemprop"):
                for w in _PARTS.findall(value):
                    k = _WORD.get(w.lower())
                    if k is not None:
                        bits |= 1 << k
        for column, value in ((self.parent, self.stack[-1]), (self.tag, tag), (self.words, bits), (self.given, given), (self.tags, 0), (self.controls, 0), (self.links, 0)):
            column.append(value)
        return len(self.tag) - 1

    def _end(self, tag: str, within: tuple = ()) -> None:
        """Close the innermost open ``tag``, unless one of ``within`` was opened inside it."""
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[k]]
            if t == tag:
                self._flush()
                for n in self.stack[k:]:
                    self.anchor -= self.tag[n] == "a"
                    self.silent -= self.tag[n] in SILENT
                del self.stack[k:]
                return
            if t in within:
                return

    def handle_endtag(self, tag):
        if self.silent and tag not in SILENT:
            return
        if tag == "p" and not self.silent and "p" not in (self.tag[n] for n in self.stack):
            self._flush()
        if tag not in ("html", "body"):
            if tag not in INLINE:
                self._flush()
            self._end(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math") and tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.anchor:
                self.linked += len(data)


NAMES = ["depth", "chars", "link_share", "tag_density", "controls", "paragraphs", "items", "stops", "words_per_block", "blocks", "start", "of_page", "of_parent", "same_siblings", "place", "before", "after", "before_link", "after_link", "copyright",
         *[f"tag_{k}" for k in TAGS], *[f"word_{k}" for k in WORDS], *[f"above_{k}" for k in TAGS], *[f"above_word_{k}" for k in WORDS], *[f"below_word_{k}" for k in WORDS]]
_FIXED = 20


def features(t: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Elements that hold text, in page order, and their features in the order of ``NAMES``."""
    n = len(t.tag)
    chars, linked, count, stops, tokens, mark = (np.zeros(n) for _ in range(6))
    begin = np.full(n, np.inf)
    at = 0
    for node, text, link in t.blocks:
        chars[node] += len(text)
        linked[node] += link
        count[node] += 1
        stops[node] += sum(map(text.count, ".,;:!?"))
        tokens[node] += text.count(" ") + 1
        mark[node] += "©" in text
        begin[node] = min(begin[node], at)
        at += len(text)
    tags, controls = np.array(t.tags, float), np.array(t.controls, float)
    par, item = np.array([x == "p" for x in t.tag], float), np.array([x == "li" for x in t.tag], float)
    below = np.array(t.words, np.int64)
    parent = t.parent
    for k in range(n - 1, 0, -1):
        p = parent[k]
        for col in (chars, linked, count, stops, tokens, mark, tags, controls, par, item):
            col[p] += col[k]
        begin[p] = min(begin[p], begin[k])
        below[p] |= below[k]
    kind = np.array([_TAG.get(x, -1) for x in t.tag])
    own = np.where(kind >= 0, 1 << np.maximum(kind, 0), 0)
    above, above_words, depth = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for k in range(1, n):
        p = parent[k]
        above[k], above_words[k], depth[k] = above[p] | own[p], above_words[p] | t.words[p], depth[p] + 1
    keep = np.flatnonzero((chars > 0) & np.array([x not in INLINE for x in t.tag]))
    family: dict[int, list[int]] = {}
    for k in keep.tolist():
        family.setdefault(parent[k], []).append(k)
    index = {k: j for brothers in family.values() for j, k in enumerate(brothers)}
    alike = {p: Counter(t.tag[b] for b in brothers) for p, brothers in family.items()}
    out = np.zeros((len(keep), len(NAMES)))
    row = {k: i for i, k in enumerate(keep.tolist())}
    total = max(chars[0], 1)
    for k, i in row.items():
        brothers, j = family[parent[k]], index[k]
        before, after = (brothers[j - 1] if 0 < j < len(brothers) else -1), (brothers[j + 1] if j + 1 < len(brothers) else -1)
        out[i, :_FIXED] = (
            depth[k], math.log1p(chars[k]), linked[k] / chars[k], tags[k] / chars[k], math.log1p(controls[k]), math.log1p(par[k]), math.log1p(item[k]), stops[k] / tokens[k], tokens[k] / count[k], math.log1p(count[k]),
            begin[k] / total, chars[k] / total, chars[k] / max(chars[max(parent[k], 0)], 1), math.log1p(alike[parent[k]][t.tag[k]]), j / len(brothers),
            math.log1p(chars[before]) if before >= 0 else 0, math.log1p(chars[after]) if after >= 0 else 0, linked[before] / chars[before] if before >= 0 else 0, linked[after] / chars[after] if after >= 0 else 0, mark[k] > 0)
    bits = lambda x, m: (x[keep][:, None] >> np.arange(m)) & 1
    a, b = len(TAGS), len(WORDS)
    out[:, _FIXED:] = np.concatenate([bits(own, a), bits(np.array(t.words, np.int64), b), bits(above, a), bits(above_words, b), bits(below, b)], axis=1)
    return keep, out


def decode(t: Tree, keep: np.ndarray, p: np.ndarray) -> list[str]:
    """Blocks of the most probable labelling in which nothing below a rejected element is kept.

    An element inside a kept one is kept with the prior ``INSIDE``, or ``BARE`` if it is a paragraph, heading, item or
    cell without a telling name.
    """
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = dict(zip(keep.tolist(), np.log(p).tolist(), strict=True)), dict(zip(keep.tolist(), np.log1p(-p).tolist(), strict=True))
    bare = {k: not t.words[k] and t.tag[k] in BARE_TAGS for k in yes}
    stay, leave = {False: math.log(INSIDE), True: math.log(BARE)}, {False: math.log(1 - INSIDE), True: math.log(1 - BARE)}
    inside, outside = {k: yes[k] for k in yes}, {k: no[k] for k in no}
    order = keep.tolist()
    for k in reversed(order):
        up = t.parent[k]
        while up >= 0 and up not in inside:
            up = t.parent[up]
        if up >= 0:
            outside[up] += outside[k]
            inside[up] += max(inside[k] + stay[bare[k]], outside[k] + leave[bare[k]])
    chosen: dict[int, bool] = {}
    for k in order:
        up = t.parent[k]
        while up >= 0 and up not in inside:
            up = t.parent[up]
        chosen[k] = (up < 0 or chosen[up]) and inside[k] + stay[bare[k]] >= outside[k] + leave[bare[k]]
    return [text for node, text, _ in t.blocks if chosen.get(node, False)]


_GOOD, _BAD = frozenset("article main".split()), frozenset("nav footer aside form".split())


def semantic_labels(t: Tree, keep: np.ndarray) -> np.ndarray | None:
    """1 for elements that hold text inside an article and outside of its by-work; None where a page has no such element."""
    n = len(t.tag)
    state = np.zeros(n, bool)
    seen = False
    bad_words = sum(1 << k for k, name in enumerate(WORDS) if name in ("ad", "comment", "side", "notice", "nav", "footer", "form"))
    for k in range(1, n):
        state[k] = state[t.parent[k]] or t.tag[k] in _GOOD
        seen |= t.tag[k] in _GOOD
        if t.tag[k] in _BAD or t.words[k] & bad_words:
            state[k] = False
    return _upwards(t, keep, state) if seen else None


def _upwards(t: Tree, keep: np.ndarray, state: np.ndarray) -> np.ndarray:
    holds = np.zeros(len(t.tag), bool)
    for node, _, _ in t.blocks:
        holds[node] |= state[node]
    for k in range(len(t.tag) - 1, 0, -1):
        holds[t.parent[k]] |= holds[k]
    return holds[keep].astype(np.int64)


def layout(main: list[str], other: list[str], rng: random.Random) -> str:
    """A page made of the given texts; elements with the attribute ``data-y`` are by-work (0) or main text (1)."""
    pick, low = rng.choice, rng.random

    def words(k: int) -> str:
        source = pick(other or main).split()
        a = rng.randrange(max(1, len(source) - k))
        return " ".join(source[a : a + k]) or "text"

    def named(kind: str) -> str:
        w = pick(WORDS[kind].split())
        w = pick([w, f"{w}-{pick(('box', 'area', 'wrap', 'inner', 'block', 'list', '1'))}", f"{pick(('site', 'page', 'js', 'c'))}-{w}"])
        return f' {pick(("class", "class", "id"))}="{w}"'

    def menu(kind: str = "nav") -> str:
        items = "".join(f'<li><a href="/{k}">{words(rng.randrange(1, 4))}</a></li>' for k in range(rng.randrange(3, 12)))
        tag = pick(("nav", "div", "ul"))
        inner = items if tag == "ul" else f"<ul>{items}</ul>"
        return f'<{tag} data-y="0"{named(kind) if tag != "nav" or low() < 0.5 else ""}>{inner}</{tag}>'

    def box(kind: str, tags: tuple[str, ...], long: int = 30) -> str:
        tag = pick(tags)
        head = f"<h3>{words(3)}</h3>" if low() < 0.4 else ""
        body = "".join(pick((f"<p>{words(rng.randrange(4, long))}</p>", words(rng.randrange(4, long)), f'<a href="/x">{words(5)}</a>')) for _ in range(rng.randrange(1, 4)))
        return f'<{tag} data-y="0"{"" if tag in ("aside", "footer", "form") and low() < 0.4 else named(kind)}>{head}{body}</{tag}>'

    def form() -> str:
        return f'<{"form"} data-y="0"{named("form") if low() < 0.6 else ""}><label>{words(2)}</label><input name="q"><p>{words(8)}</p><button>{words(1)}</button></form>'

    def comments() -> str:
        outer, inner = pick(("section", "div", "ul")), pick(("div", "li", "article"))
        each = "".join(f'<{inner} class="{pick(("comment", "reply", "comment-body", "item"))}"><b>{words(1)}</b><p>{words(rng.randrange(5, 60))}</p></{inner}>' for _ in range(rng.randrange(1, 6)))
        return f'<{outer} data-y="0"{named("comment")}><h2>{words(2)}</h2>{each}</{outer}>'

    blocks = []
    for k, text in enumerate(main):
        tag = "h1" if k == 0 else pick(("p", "p", "p", "p", "div", "blockquote", "h2")) if len(text) > 40 else pick(("p", "h2", "h3", "li"))
        inner = text if low() < 0.8 else f"<b>{text}</b>"
        blocks.append(f"<ul><li>{inner}</li></ul>" if tag == "li" else f"<{tag}>{inner}</{tag}>")
        if low() < 0.12:
            blocks.append(pick((lambda: box("ad", ("div", "aside")), lambda: box("side", ("aside", "div")), form, lambda: box("share", ("div",), 8)))())
    opened, closed = pick((("<article data-y=\"1\">", "</article>"), ("<main data-y=\"1\">", "</main>"), (f'<div data-y="1"{named("main")}>', "</div>"), (f'<section data-y="1"{named("main")}>', "</section>"), ('<div data-y="1">', "</div>")))
    head = f"<header>{blocks[0]}</header>" if blocks and low() < 0.2 else (blocks[0] if blocks else "")
    body = opened + head + "".join(blocks[1:]) + closed
    if low() < 0.3:
        body = f'<div{named("main") if low() < 0.5 else ""}>{body}</div>'
    top = [menu(), box("header", ("header", "div"), 8), box("notice", ("div", "section"), 40), box("ad", ("div", "aside")), menu("header"), form()]
    end = [box("footer", ("footer", "div"), 20), box("side", ("aside", "div"), 30), comments(), menu("side"), box("ad", ("div",)), box("notice", ("div",), 40), form(), f'<footer data-y="0">&copy; {words(2)} &middot; {words(6)}</footer>']
    before, after = [x for x in top if low() < 0.5], [x for x in end if low() < 0.55]
    rng.shuffle(before), rng.shuffle(after)
    return f"<html><head><title>{words(4)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def given_labels(t: Tree, keep: np.ndarray) -> np.ndarray:
    """Labels of a page made by ``layout``."""
    state = np.zeros(len(t.tag), bool)
    for k in range(1, len(t.tag)):
        state[k] = t.given[k] == "1" if t.given[k] else state[t.parent[k]]
    return _upwards(t, keep, state)


def training_rows(pages: DataFrame, sample: int = SAMPLE, variants: int = VARIANTS) -> DataFrame:
    """label and features of the elements of the sampled pages with semantic elements, and of their new layouts."""

    def run(batches):
        for batch in batches:
            x, y = [], []
            for html in batch.column(0).to_pylist():
                t = Tree(html)
                keep, own = features(t)
                labels = semantic_labels(t, keep)
                if labels is None or not len(keep):
                    continue
                x += [own] * REAL
                y += [labels] * REAL
                good = dict(zip(keep.tolist(), labels.tolist(), strict=True))
                main = [text for node, text, _ in t.blocks if good.get(node)]
                other = [text for node, text, _ in t.blocks if not good.get(node)]
                rng = random.Random(len(html) * 1_000_003 + sum(map(len, main)))
                for _ in range(variants if main else 0):
                    some = main if rng.random() < 0.5 else main[: rng.randrange(1, len(main) + 1)]
                    new = Tree(layout(some, other + main, rng))
                    keep, own = features(new)
                    x.append(own), y.append(given_labels(new, keep))
            if x:
                yield (np.concatenate(y).astype(float), list(np.concatenate(x)))

    chosen = require(pages, "html").where("length(html) > 0").withColumn("h", F.xxhash64("html")).orderBy("h", "html").limit(sample).select("html")
    return written(on_arrow(chosen, run, "label double, features array<double>"), "dom-nodes")


def train(pages: DataFrame, sample: int = SAMPLE, variants: int = VARIANTS, trees: int = TREES, depth: int = DEPTH):
    """The trees as arrays (feature, threshold, left, right, value, start of each tree, weight); None where no page could be labelled."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = training_rows(pages, sample, variants)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    data = rows.select("label", array_to_vector("features").alias("features")).coalesce(1 + sum(counts.values()) // 50_000)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=32, subsamplingRate=1.0).fit(data)
    columns: list[list] = [[], [], [], [], []]
    starts = []

    def add(node) -> int:
        at = len(columns[0])
        for column, value in zip(columns, (0, 0.0, at, at, node.prediction()), strict=True):
            column.append(value)
        if node.getClass().getSimpleName() == "InternalNode":
            columns[0][at], columns[1][at] = node.split().featureIndex(), node.split().threshold()
            columns[2][at], columns[3][at] = add(node.leftChild()), add(node.rightChild())
        return at

    for tree in model.trees:
        starts.append(add(tree._java_obj.rootNode()))
    return (np.array(columns[0], np.int32), np.array(columns[1]), np.array(columns[2], np.int32), np.array(columns[3], np.int32), np.array(columns[4]), np.array(starts, np.int32), np.array(model.treeWeights), depth)


def probabilities(model, x: np.ndarray) -> np.ndarray:
    """Probability of main text for each row of features; a model that could not be trained says 0.5."""
    if model is None or not len(x):
        return np.full(len(x), 0.5)
    feature, threshold, left, right, value, starts, weights, depth = model
    margin, rows = np.zeros(len(x)), np.arange(len(x))
    for start, weight in zip(starts, weights, strict=True):
        at = np.full(len(x), start)
        for _ in range(depth):
            at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
        margin += weight * value[at]
    return 1 / (1 + np.exp(-2 * margin))


def extract(pages: DataFrame, model) -> DataFrame:
    """page_id, url, text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                trees = [Tree(html or "") for html in part.column(2).to_pylist()]
                found = [features(t) for t in trees]
                p = probabilities(shared.value, np.concatenate([x for _, x in found]))
                edges = np.cumsum([0, *[len(k) for k, _ in found]])
                texts = ["\n".join(decode(t, keep, p[i:j])) for t, (keep, _), i, j in zip(trees, found, edges, edges[1:], strict=False)]
                yield (part.column(0), part.column(1), texts)

    return on_arrow(require(pages, "page_id", "url", "html"), run, "page_id bigint, url string, text string")
