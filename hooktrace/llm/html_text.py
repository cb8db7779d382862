"""Main text of web pages: boosted trees over DOM nodes, decoded from the root down."""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hooktrace.llm.boosting import BoostedTrees

SAMPLE_PAGES = 300
_BATCH_BYTES = 4_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S
)
# Where no tag can end any more.
_REST = re.compile(r"<!--.*\Z|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_TRUTH = re.compile('data-truth="([01])"')
_CAMEL = re.compile(r"([a-z])([A-Z])")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg")}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre search section select "
    "summary table tbody td tfoot th thead tr ul button".split()
)
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table html body article section div main aside nav header footer form".split())

# Words in classes, ids and roles that speak for or against the main text.
_FOR = frozenset("article articlebody blog body content entry main page post story text".split())
_AGAINST = frozenset(
    "ad ads advert adverts advertisement alert author banner bar bio bottom breadcrumb breadcrumbs byline comment comments "
    "complementary contentinfo cookie cookies consent copyright discuss dialog disqus feedback foot footer form gdpr head "
    "header legal links list login masthead menu meta modal nav navbar navigation newsletter notice notification pagination "
    "pager paywall popup popular promo promotion recommended related reply replies respond response responses review reviews "
    "rail search share sharing side sidebar signup site skip social sponsor sponsored subscribe subscription tags teaser toc "
    "toolbar top trending warning widget".split()
)
_COMMENT = frozenset("comment comments discuss disqus feedback reply replies respond responses review reviews".split())
_TAGS = ("p", "li", "a", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "body")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CHROME = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "fieldset", "head", "search"))


class Node:
    __slots__ = ("tag", "names", "parent", "depth", "kids", "texts", "own", "linked", "tags", "truth", "total", "links", "count", "blocks", "begin")

    def __init__(self, tag: str, names: frozenset, parent: int, depth: int, truth: int | None, begin: int):
        self.tag, self.names, self.parent, self.depth, self.truth, self.begin = tag, names, parent, depth, truth, begin
        self.kids: list[int] = []
        self.texts: list[tuple[int, str]] = []
        self.own = self.linked = self.tags = 0


def parse(page: str, marked: bool = False) -> list[Node]:
    """The block elements of a page in page order, inline elements folded into them.

    Never fails: unknown and stray tags are passed over as browsers do, and what an unclosed script
    or style begins goes on to the end of the page. A node's texts are its runs of inline text, each
    with its place in the page's order of blocks. ``marked`` is for pages made to learn from: only
    there does a ``data-truth`` attribute of 0 or 1 mark a node. Stray end tags and unclosed
    elements cost no search: names of open elements are counted, and what has no end is remembered.
    """
    nodes = [Node("#root", frozenset(), -1, 0, None, 0)]
    stack: list[tuple[str, int]] = [("#root", 0)]
    run: list[str] = []
    links = order = at = 0
    size = len(page)
    last_end = page.rfind(">")
    open_tags: Counter = Counter()
    endless: set[str] = set()

    def close_run() -> None:
        nonlocal order
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                node = nodes[stack[-1][1]]
                node.texts.append((order, text))
                node.own += len(text)
                order += 1

    while at < size:
        found = (_TOKEN if at < last_end else _REST).match(page, at)
        tag = found[2] if at < last_end else None
        at = found.end()
        if tag is None:
            text = found[0]
            if text[0] == "<" and len(text) > 1:
                continue
            run.append(text)
            if links:
                nodes[stack[-1][1]].linked += len(text.strip())
            continue
        tag = tag.lower()
        if not found[1]:
            if tag in _RAW:
                end = None if tag in endless else _RAW[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag != "title":
                    at = size
                else:
                    endless.add(tag)
                continue
            if tag == "br":
                run.append(" ")
                continue
            if tag in _BLOCK:
                close_run()
                links = 0
                _imply_ends(stack, tag, open_tags)
                parent = stack[-1][1]
                names = _names(found[3])
                truth = _truth(found[3]) if marked else None
                nodes.append(Node(tag, names, parent, nodes[parent].depth + 1, truth, found.start()))
                nodes[parent].kids.append(len(nodes) - 1)
                if tag not in _VOID and not found[3].endswith("/"):
                    stack.append((tag, len(nodes) - 1))
                    open_tags[tag] += 1
            elif tag not in _VOID:
                nodes[stack[-1][1]].tags += 1
                if tag == "a":
                    links += 1
        elif tag == "a":
            links = max(0, links - 1)
        elif tag in _BLOCK and open_tags[tag]:
            close_run()
            links = 0
            while _pop(stack, open_tags) != tag:
                pass
    close_run()
    return nodes


def _pop(stack: list[tuple[str, int]], open_tags: Counter) -> str:
    tag, _ = stack.pop()
    open_tags[tag] -= 1
    return tag


def _imply_ends(stack: list[tuple[str, int]], tag: str, open_tags: Counter) -> None:
    """Close what a new block element ends: an open paragraph, or an item of the same list or row."""
    if stack[-1][0] == "p" or (stack[-1][0] in _HEADINGS and tag in _HEADINGS):
        _pop(stack, open_tags)
    ends = _ENDS.get(tag)
    if ends and any(open_tags[e] for e in ends):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in ends:
                while len(stack) > i:
                    _pop(stack, open_tags)
                return
            if stack[i][0] in _SCOPES:
                return


def _names(attributes: str) -> frozenset:
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        names.update(_NAME.findall(_CAMEL.sub(r"\1 \2", m[1] or m[2] or m[3] or "").lower()))
    return frozenset(names)


def _truth(attributes: str) -> int | None:
    found = _TRUTH.search(attributes)
    return int(found[1]) if found else None


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node."""
    for node in nodes:
        node.total, node.links, node.count, node.blocks = node.own, min(node.linked, node.own), node.tags, len(node.texts)
    for node in reversed(nodes):
        if node.parent >= 0:
            up = nodes[node.parent]
            up.total += node.total
            up.links += node.links
            up.count += node.count + 1
            up.blocks += node.blocks
    whole, last = max(1, nodes[0].total), max(1, nodes[-1].begin)
    lifted: list[tuple] = []
    rows = []
    for node in nodes:
        tag, names = node.tag, node.names
        good, bad = len(names & _FOR), len(names & _AGAINST)
        if node.parent >= 0:
            up = nodes[node.parent]
            above = lifted[node.parent]
            siblings, share = len(up.kids), node.total / max(1, up.total)
        else:
            up, above, siblings, share = node, (0, 0, 0, 0, 0), 1, 1.0
        here = (
            above[0] + (good > 0 and not bad),
            above[1] + (bad > 0),
            above[2] + (tag in _CHROME),
            above[3] + (tag == "article" or tag == "main" or "main" in names or "articlebody" in names),
            above[4] + bool(names & _COMMENT),
        )
        lifted.append(here)
        text = node.texts[0][1] if node.texts else ""
        rows.append(
            (
                math.log1p(node.total), math.log1p(node.own), node.links / max(1, node.total),
                node.total / (node.count + 1), node.depth, node.begin / last, siblings, share, node.total / whole,
                node.total / max(1, node.blocks), len(node.kids), good, bad, *here, *above[:3],
                tag in _HEADINGS, text.count(",") + text.count("."), up.total / max(1, up.blocks), up.links / max(1, up.total),
                *(tag == t for t in _TAGS),
            )
        )
    return np.array(rows, dtype=np.float64)


def decode(nodes: list[Node], probability: np.ndarray) -> str:
    """The likeliest consistent choice of nodes, as text.

    A node is kept, dropped, or mixed. Below a dropped node everything is dropped; a kept node may
    hold dropped ones; only a mixed node, whose own text goes, may hold both kinds of branches. So
    no node is kept under one that is dropped. The choice with the highest likelihood is found from
    the leaves up.
    """
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    keep, drop = np.log(p).tolist(), np.log(1 - p).tolist()
    mixed = [math.log(0.5)] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
        mixed[up] += max(keep[i], drop[i], mixed[i])
    state = [""] * len(nodes)
    texts: list[tuple[int, str]] = []
    for i, node in enumerate(nodes):
        above = state[node.parent] if i else "mixed"
        options = {"drop": drop[i]}
        if above != "drop":
            options["keep"] = keep[i]
        if above == "mixed":
            options["mixed"] = mixed[i]
        state[i] = max(options, key=options.get)
        if state[i] == "keep":
            texts += node.texts
    texts.sort()
    return "\n\n".join(t for _, t in texts)


_FILLER = (
    "The river rose over night, and by morning the lower road was closed to all but the heaviest carts.",
    "Nobody in the village could say who had first planted the orchard, though many claimed to know.",
    "A second report, published a year later, came to much the same result with far better figures.",
    "She wrote to her brother twice a week, in a small upright hand that never changed.",
    "Prices fell in spring, rose again before the harvest, and had settled down by the end of autumn.",
    "The old bridge was measured, drawn, taken apart stone by stone, and put up again further down.",
)


def article_texts(page: str) -> list[str]:
    """Runs of text in a page's article or main element, for making teaching pages; may be empty."""
    nodes = parse(page)
    inside: list[bool] = []
    texts = []
    for node in nodes:
        above = node.parent >= 0 and inside[node.parent]
        inside.append((above or node.tag in ("article", "main")) and node.tag not in _CHROME and not node.names & _AGAINST)
        if inside[-1]:
            texts += node.texts
    return [t for _, t in sorted(texts)]


def teaching_page(draw: random.Random, body: list[str], other: list[str]) -> str:
    """A page around given article texts, its nodes marked as main text (1) or not (0).

    Frames, class names, places and lengths vary, so that the trees learn from the statistics and
    names of nodes rather than from one site's layout.
    """

    def some(low: int, high: int) -> list[str]:
        return [draw.choice(other) for _ in range(draw.randint(low, high))]

    def short(text: str) -> str:
        return entities.escape(" ".join(text.split()[: draw.randint(1, 4)]))

    def full(text: str) -> str:
        return entities.escape(text)

    def linked(items: list[str]) -> str:
        return "".join(f'<li data-truth="0"><a href="/x">{short(t)}</a></li>' for t in items)

    def junk(kind: str) -> str:
        zero = 'data-truth="0"'
        if kind == "menu":
            tag, name = draw.choice([("nav", ""), ("div", "menu"), ("nav", "main-menu"), ("div", "nav-bar"), ("div", "navigation"), ("ul", "links")])
            inner = linked(some(3, 8))
            return f'<{tag} class="{name}" {zero}>{inner if tag == "ul" else f"<ul {zero}>{inner}</ul>"}</{tag}>'
        if kind == "header":
            tag, name = draw.choice([("header", ""), ("div", "site-header"), ("div", "masthead"), ("header", "page-head"), ("div", "top-bar")])
            return f'<{tag} id="{name}" {zero}><div {zero}>{short(draw.choice(other))}</div><p {zero}>{short(draw.choice(other))}</p></{tag}>'
        if kind == "footer":
            tag, name = draw.choice([("footer", ""), ("div", "footer"), ("div", "site-footer"), ("footer", "legal"), ("div", "copyright")])
            return f"<{tag} class='{name}' {zero}>&copy; {short(draw.choice(other))}" + draw.choice(["", f"<p {zero}>{full(draw.choice(other))}</p>"]) + f"</{tag}>"
        if kind == "side":
            tag, name = draw.choice([("aside", ""), ("div", "sidebar"), ("div", "side"), ("aside", "related"), ("div", "widget popular"), ("section", "related-posts")])
            inner = "".join(f"<p {zero}>{full(t)}</p>" for t in some(1, 3)) if draw.random() < 0.5 else f"<h3 {zero}>{short(draw.choice(other))}</h3><ul {zero}>{linked(some(2, 5))}</ul>"
            return f'<{tag} class="{name}" {zero}>{inner}</{tag}>'
        if kind == "notice":
            name = draw.choice(["notice", "cookie-notice", "alert", "cookie-consent", "newsletter-signup", "banner", "paywall popup"])
            return f'<div class="{name}" {zero}>{draw.choice([full, short])(draw.choice(other))}</div>'
        if kind == "ad":
            name = draw.choice(["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo"])
            inner, tag = full(draw.choice(other)), draw.choice(["div", "aside", "section"])
            return f'<{tag} class="{name}" {zero}>{draw.choice([inner, f"<p {zero}>{inner}</p>"])}</{tag}>'
        if kind == "form":
            return f'<form action="/s" {zero}><p {zero}>{short(draw.choice(other))}</p><label>{short(draw.choice(other))}</label><input name="q"><button {zero}>{short(draw.choice(other))}</button></form>'
        name = draw.choice(["comments", "comment-list", "discussion comments", "reader-comments", "responses", "disqus-thread"])
        each = draw.choice(["comment", "comment-body", "reply", "comment entry"])
        inner = "".join(f'<div class="{each}" {zero}><p {zero}>{full(t)}</p></div>' for t in some(1, 5))
        tag = draw.choice(["section", "div"])
        return f'<{tag} id="{name}" {zero}><h2 {zero}>{short(draw.choice(other))}</h2>{inner}</{tag}>'

    kinds = ["menu", "header", "side", "notice", "ad", "form", "menu"]
    one = 'data-truth="1"'
    parts = []
    for i, text in enumerate(body):
        tag = "h1" if i == 0 and draw.random() < 0.7 else draw.choice(["p"] * 12 + ["h2", "li", "blockquote", "div"])
        inner = full(text)
        parts.append(f"<ul {one}><li {one}>{inner}</li></ul>" if tag == "li" else f"<{tag} {one}>{inner}</{tag}>")
        if i and draw.random() < 0.06:
            parts.append(junk(draw.choice(["ad", "form", "notice", "side"])))
    tag, name = draw.choice(
        [("article", ""), ("article", "post"), ("main", ""), ("div", "post-content"), ("div", "article-body"), ("div", "content")]
        + [("section", "entry-content"), ("div", "story"), ("div", ""), ("td", "main-text"), ("div", "page-text"), ("article", "")]
    )
    article = f'<{tag} class="{name}" {one}>{"".join(parts)}'
    if draw.random() < 0.3:
        article += junk("comments")
    article += f"</{tag}>"
    if tag == "td":
        article = f"<table><tr>{article}</tr></table>"
    if draw.random() < 0.4:
        article = f'<div class="{draw.choice(["wrapper", "container", "page", "row", ""])}">{article}{junk("side") if draw.random() < 0.5 else ""}</div>'
    before = "".join(junk(draw.choice(kinds)) for _ in range(draw.randint(1, 4)))
    after = "".join(junk(draw.choice(["side", "ad", "comments", "notice", "form", "menu"])) for _ in range(draw.randint(0, 3)))
    return f"<html><head><title>{short(draw.choice(other))}</title></head><body>{before}{article}{after}{junk('footer')}</body></html>"


def train(pages: list[str], variants: int = 3, seed: int = 7) -> BoostedTrees:
    """Trees taught by sample pages with a marked article and by pages made anew from their texts."""
    draw = random.Random(seed)
    bodies = [b for b in map(article_texts, pages) if b]
    pool = [t for b in bodies for t in b[:20] if len(t) < 2_000] or list(_FILLER)
    pool += list(_FILLER)
    rows, target = [], []
    made = []
    for body in bodies or [list(_FILLER)] * 100:
        for _ in range(variants):
            texts = draw.sample(body, len(body)) if draw.random() < 0.3 else body
            texts = [t[:2_000] for t in texts[: draw.choice((1, 3, 6, 12, 12, 12))]]
            if draw.random() < 0.15:  # some articles are a few words long
                texts = [" ".join(t.split()[: draw.randint(1, 5)]) for t in texts[:2]]
            made.append(teaching_page(draw, texts, pool))
    # Marks that real pages bring along say nothing.
    made += [_FLAG.sub(r'<\1 data-truth="1"\2', p.replace("data-truth", "data-other")) for p, b in zip(pages, map(article_texts, pages)) if b]
    for page in made:
        nodes = parse(page, marked=True)
        # An unmarked node takes the mark above it; a node above marks counts by the share of its text.
        marks: list[float] = []
        for node in nodes:
            marks.append(float(node.truth) if node.truth is not None else (marks[node.parent] if node.parent >= 0 else 0.0))
        table = features(nodes)
        good = [m * n.own for m, n in zip(marks, nodes)]
        for i in range(len(nodes) - 1, 0, -1):
            good[nodes[i].parent] += good[i]
        for i, node in enumerate(nodes):
            if marks[i] == 0.0 and node.truth is None and node.total and good[i]:
                marks[i] = good[i] / node.total
        rows.append(table)
        target += marks
    return BoostedTrees().fit(np.concatenate(rows), np.array(target))


_FLAG = re.compile(r"<(article|main)\b([^>]*)", re.I)


def extract_all(model: BoostedTrees, pages: list[str | None]) -> list[str]:
    """Main texts of pages, the nodes of many pages in one matrix."""
    parsed = [parse(p or "") for p in pages]
    tables = [features(n) for n in parsed]
    probability = model.predict(np.concatenate(tables)) if tables else np.zeros(0)
    out, at = [], 0
    for nodes in parsed:
        out.append(decode(nodes, probability[at : at + len(nodes)]))
        at += len(nodes)
    return out


def fit(pages: DataFrame, html: str = "html", key: str = "page_id", sample: int = SAMPLE_PAGES) -> BoostedTrees:
    """Train on at most ``sample`` pages, those with the smallest hash of their key."""
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).where("html is not null")
    ids = rows.select("key").orderBy(F.xxhash64("key"), "key").limit(sample)
    found = rows.join(F.broadcast(ids.distinct()), "key").orderBy("key", "html").limit(sample).collect()
    return train([r["html"] for r in found])


def extract(pages: DataFrame, model: BoostedTrees, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of whole pages.

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined by an empty line. A null or empty page, or one without main text, has the empty text.
    Rows and other columns pass through; an existing ``out`` is replaced.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found: list[str] = []
            held, size = [], 0
            for page in batch:
                held.append(page)
                size += len(page or "")
                if size > _BATCH_BYTES:
                    found += extract_all(model, held)
                    held, size = [], 0
            found += extract_all(model, held)
            yield pd.Series(found, index=batch.index, dtype=object)

    return pages.withColumn(out, texts(F.col(html)))
