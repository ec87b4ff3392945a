"""Main text of web pages by a tree-structured graphical model.

Block elements are nodes and each is content or not. A node has a potential from its features (tag, words of class and id,
lengths, links, sentences, its subtree), and each pair of parent and child has one of four by their states and by whether the parent is
the root. Sum-product messages go from the leaves up and from the root down, over all trees of a batch at once, a
level at a time; what results are exact marginals. A node's own text is kept if its marginal is at least a half.

Weights are trained by gradient ascent on the likelihood of labelled pages, whose expected counts come from the same messages.
``labelled_pages`` builds these pages, from layouts written here; others can be given.

Text: character references are decoded, white space becomes one space within a block, blocks come in page order joined
by a line feed. Scripts, styles, drawings, form controls and other raw or hidden elements are never text; what ``noscript`` and
``object`` hold is a block like others, and formulas are text of their block. Null, empty and blank html gives
an empty text. Broken markup is read as far as it goes: a new block ends an open paragraph, an unknown end tag is
ignored. Reading takes time in proportion to the page, however deep it is. Rows are kept as they come, repeated ids and nulls included; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import random
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulselake.llm.common import Kept, slices, table

SLICE_CHARS = 2_000_000
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
OPEN_END = re.compile(r"<[!?].*\Z", re.S)  # all the markup there can be after the last ">"
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CONTENT_MARK = re.compile(r"\bdata-content=\"([01])\"")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCKS = set(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre"
    " figure figcaption header footer nav aside form fieldset address details summary center noscript object".split()
)
RAW = {"script", "style", "title", "textarea", "template", "iframe", "svg", "select", "button", "canvas", "head"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "embed", "area", "col", "track", "param", "base"}
ENDS_PARAGRAPH = BLOCKS - {"html", "body"}
ENDS_OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "aside", "body"}
TAGS = "html body article main section div p h1 h2 h3 h4 ul ol li table td blockquote pre figure figcaption header footer nav aside form".split()
NEGATIVE = {
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promoted banner",
    "nav": "nav navigation menu menubar navbar breadcrumb breadcrumbs tabs pagination pager toc",
    "edge": "header head masthead top footer foot bottom copyright legal colophon contentinfo",
    "side": "sidebar side aside widget related recommended trending popular complementary tags",
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr newsletter subscribe signup",
    "talk": "comment comments reply replies respond discussion disqus reactions",
    "share": "share sharing social follow login search form button toolbar",
}
POSITIVE = {"text": "article content post entry story body main text maintext prose"}
GROUPS = {word: f"name:{group}" for kind in (NEGATIVE, POSITIVE) for group, words in kind.items() for word in words.split()}
FEATURES = (
    ["bias"] + [f"tag:{t}" for t in TAGS] + ["tag:other"] + [f"name:{g}" for g in [*NEGATIVE, *POSITIVE]]
    + ["chars", "long", "links", "sentences", "own", "below", "below_links", "first", "last"]
)
PLACE = {name: i for i, name in enumerate(FEATURES)}


@dataclass
class Page:
    """Nodes in page order: tag, parent (-1 for the root), depth, groups of names; text segments with their node."""

    tags: list[str]
    parents: list[int]
    depths: list[int]
    groups: list[set[str]]
    marks: list[str | None]
    links: list[int]
    segments: list[tuple[int, str]]


def read_page(source: str) -> Page:
    page = Page(["html"], [-1], [0], [set()], [None], [0], [])
    stack, texts, at, link, open_head = [0], [], 0, False, False
    places: dict[str, list[int]] = defaultdict(list)  # where the open elements of a tag are on the stack

    def end_segment() -> None:
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                page.segments.append((stack[-1], text))
            texts.clear()

    def take(text: str) -> None:
        if text:
            decoded = references.unescape(text) if "&" in text else text
            texts.append(decoded)
            if link:
                page.links[stack[-1]] += len(decoded.strip())

    def close(to: int) -> None:
        end_segment()
        for node in stack[to:]:
            places[page.tags[node]].pop()
        del stack[to:]

    def innermost(tags) -> int:
        """The place of the last opened of these elements; 0 if none is open."""
        return max((places[t][-1] for t in tags if places[t]), default=0)

    size, tags_end = len(source), source.rfind(">") + 1
    while at < size:
        found = (MARKUP if at < tags_end else OPEN_END).search(source, at)
        if not found:
            take(source[at:])
            break
        take(source[at : found.start()])
        at = found.end()
        if found.lastindex is None or not found[2]:
            continue
        ending, name = found[1], found[2].lower()
        if name in RAW:
            if not ending and not found[3].rstrip().endswith("/") and not (open_head and name == "head"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>|\Z", re.I).search(source, at)
                open_head = name == "head" and not end[0]  # an open head is left to its own elements
                at = at if open_head else end.end()
            continue
        if name == "a":
            link = not ending
            continue
        if name in ("br", "hr"):
            texts.append(" ")
            continue
        if name not in BLOCKS:
            continue
        if ending:
            k = innermost([name])
            if k:
                close(k)
                link = False
            elif name == "p":
                end_segment()
            continue
        if name == "html":
            continue
        end_segment()
        if name in ENDS_PARAGRAPH and page.tags[stack[-1]] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and len(stack) > 1:
            close(len(stack) - 1)
        if name in ENDS_OWN_KIND:
            k = innermost(ENDS_OWN_KIND[name])
            if k > innermost(SCOPES):
                close(k)
        attributes = found[3]
        groups = set()
        if attributes:
            for values in NAMES.findall(attributes):
                for word in PART.findall("".join(values)):
                    group = GROUPS.get(word.lower())
                    if group:
                        groups.add(group)
        mark = CONTENT_MARK.search(attributes) if attributes else None
        page.tags.append(name)
        page.parents.append(stack[-1])
        page.depths.append(len(stack))
        page.groups.append(groups)
        page.marks.append(mark[1] if mark else None)
        page.links.append(0)
        if not attributes.rstrip().endswith("/"):
            places[name].append(len(stack))
            stack.append(len(page.tags) - 1)
    end_segment()
    return page


@dataclass
class Forest:
    """The trees of several pages laid one after the other."""

    features: np.ndarray
    parents: np.ndarray
    levels: list[np.ndarray]  # node numbers by depth
    under_root: np.ndarray  # the parent is html or body
    starts: np.ndarray


def forest(pages: list[Page]) -> Forest:
    sizes = np.array([len(p.tags) for p in pages], np.int64)
    starts = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    parents = np.concatenate([np.where(np.array(p.parents) >= 0, np.array(p.parents) + s, -1) for p, s in zip(pages, starts.tolist())])
    depths = np.concatenate([np.array(p.depths) for p in pages])
    chars, marks, segments = np.zeros(total), np.zeros(total), np.zeros(total)
    features = np.zeros((total, len(FEATURES)))
    root = np.zeros(total, bool)
    for page, start in zip(pages, starts.tolist()):
        for node, text in page.segments:
            chars[start + node] += len(text)
            marks[start + node] += text.count(".") + text.count("?") + text.count("!")
            segments[start + node] += 1
        for i, (tag, groups) in enumerate(zip(page.tags, page.groups), start):
            features[i, PLACE.get(f"tag:{tag}", PLACE["tag:other"])] = 1
            root[i] = tag in ("html", "body")
            for group in groups:
                features[i, PLACE[group]] = 1
    links = np.concatenate([np.array(p.links, np.float64) for p in pages])
    below, below_links = chars.copy(), links.copy()
    order = np.argsort(depths, kind="stable")
    edges = np.searchsorted(depths[order], np.arange(int(depths.max()) + 2 if total else 1))
    levels = [order[a:b] for a, b in zip(edges, edges[1:])]
    for level in levels[:0:-1]:
        np.add.at(below, parents[level], below[level])
        np.add.at(below_links, parents[level], below_links[level])
    whole = np.maximum(np.repeat(below[starts] if total else below, sizes), 1)
    place = np.arange(total) - np.repeat(starts, sizes)
    features[:, PLACE["bias"]] = 1
    features[:, PLACE["chars"]] = np.log1p(chars) / 5
    features[:, PLACE["long"]] = chars > 120
    features[:, PLACE["links"]] = np.minimum(links / np.maximum(chars, 1), 1)
    features[:, PLACE["sentences"]] = np.minimum(marks, 5) / 5
    features[:, PLACE["own"]] = chars > 0
    features[:, PLACE["below"]] = below / whole
    features[:, PLACE["below_links"]] = np.minimum(below_links / np.maximum(below, 1), 1)
    features[:, PLACE["first"]] = np.exp(-place / 4)
    features[:, PLACE["last"]] = np.exp(-(np.repeat(sizes, sizes) - 1 - place) / 4)
    under = np.zeros(total, np.int64)
    inner = parents >= 0
    under[inner] = root[parents[inner]]
    return Forest(features, parents, levels, under, starts)


def messages(trees: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (nodes x 2) and those of each node with its parent (nodes x parent state x own state); log potentials given."""
    belief = unary.copy()
    up = np.zeros_like(unary)
    edge = pair[trees.under_root]  # nodes x parent state x own state
    for level in trees.levels[:0:-1]:
        up[level] = np.logaddexp.reduce(edge[level] + belief[level][:, None, :], axis=2)
        np.add.at(belief, trees.parents[level], up[level])
    joint = np.zeros_like(edge)
    for level in trees.levels[1:]:
        parent = trees.parents[level]
        rest = belief[parent] - up[level]  # what the parent believes without this child
        both = rest[:, :, None] + edge[level] + belief[level][:, None, :]
        joint[level] = both
        belief[level] += np.logaddexp.reduce(rest[:, :, None] + edge[level], axis=1)
    marginal = np.exp(belief - np.logaddexp.reduce(belief, axis=1)[:, None])
    flat = joint.reshape(len(joint), 4)
    return marginal, np.exp(flat - np.logaddexp.reduce(flat, axis=1)[:, None]).reshape(joint.shape)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the features for state 1
    pair: np.ndarray  # under root (0, 1) x parent state x own state

    def marginals(self, trees: Forest) -> np.ndarray:
        score = trees.features @ self.weights
        return messages(trees, np.stack([np.zeros_like(score), score], axis=1), self.pair)[0][:, 1]


def labels(page: Page) -> np.ndarray:
    """The state of each node of a labelled page: its ``data-content`` mark, or its parent's state."""
    out = np.zeros(len(page.tags), np.int64)
    for i, (mark, parent) in enumerate(zip(page.marks, page.parents)):
        out[i] = int(mark) if mark is not None else (out[parent] if parent >= 0 else 0)
    return out


def fit(sources: list[str], rounds: int = 300, rate: float = 0.1, decay: float = 5e-5) -> Model:
    """Ascend the likelihood of the labels of all pages, by Adam on exact gradients."""
    pages = [read_page(s) for s in sources]
    trees, truth = forest(pages), np.concatenate([labels(p) for p in pages])
    inner = trees.parents >= 0
    observed = trees.features.T @ truth
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (trees.under_root[inner], truth[trees.parents[inner]], truth[inner]), 1)
    weights = [np.zeros(len(FEATURES)), np.zeros((2, 2, 2))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        score = trees.features @ weights[0]
        marginal, joint = messages(trees, np.stack([np.zeros_like(score), score], axis=1), weights[1])
        expected = np.stack([joint[inner & (trees.under_root == k)].sum(axis=0) for k in (0, 1)])
        gradients = [(observed - trees.features.T @ marginal[:, 1]) / len(truth), (seen - expected) / len(truth)]
        for w, g, m, s in zip(weights, gradients, first, second):
            g = g - decay * w
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Model(*weights)


def labelled_pages(count: int = 400, seed: int = 11) -> list[str]:
    """Pages in many layouts; ``data-content`` marks the main text (1) and what is not main text within it (0)."""
    rng = random.Random(seed)
    letters = "aaaeeeiioouulnrstdmbcghkp"

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))

    def sentence(low: int = 3, high: int = 18) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice(".....!?")

    def text(low: int, high: int) -> str:
        return " ".join(sentence() for _ in range(rng.randint(low, high)))

    def name(*choices: str) -> str:
        return f'{rng.choice(["class", "id"])}="{rng.choice(choices)}"'

    def menu(kind: str = "nav") -> str:
        items = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(rng.randint(3, 9)))
        plain = f'<div {name("menu", "top-nav", "navigation", "navbar", "breadcrumbs")}><ul>{items}</ul></div>'
        return f"<nav><ul>{items}</ul></nav>" if kind == "nav" and rng.random() < 0.6 else plain

    def ad() -> str:
        body = rng.choice([sentence(), text(1, 3), f'<a href="/{word()}">{sentence()}</a>', f"<p>{sentence()}</p>"])
        return f'<{(tag := rng.choice(["div", "aside", "section", "p"]))} data-content="0" {name("ad", "ads", "ad-slot", "advert", "sponsored promo", "banner")}>{body}</{tag}>'

    def notice() -> str:
        return f'<div data-content="0" {name("cookie-notice", "consent", "newsletter-signup", "alert", "gdpr-banner", "modal popup")}><p>{text(1, 3)}</p></div>'

    def form() -> str:
        return f'<form data-content="0"{rng.choice(["", " " + name("search", "login-form", "subscribe")])}><p>{sentence(2, 6)}</p><input name="q">{rng.choice(["", sentence(1, 3)])}</form>'

    def side() -> str:
        items = "".join(f'<li><a href="/{word()}">{sentence(2, 7)}</a></li>' for _ in range(rng.randint(2, 6)))
        tag, attributes = rng.choice([("aside", ""), ("aside", name("sidebar", "related")), ("div", name("sidebar", "widget", "related-posts", "trending"))])
        return f'<{tag} data-content="0" {attributes}><h3>{sentence(1, 4)}</h3>{rng.choice([f"<ul>{items}</ul>", f"<p>{text(1, 3)}</p>"])}</{tag}>'

    def comments() -> str:
        one = lambda: f'<div class="comment"><p>{text(1, 4)}</p></div>'
        other = lambda: f"<li><p>{text(1, 3)}</p></li>"
        tag = rng.choice(["div", "section"])
        body = "".join(rng.choice([one, other])() for _ in range(rng.randint(1, 5)))
        return f'<{tag} data-content="0" {name("comments", "comment-list", "discussion", "replies", "disqus_thread")}><h3>{sentence(1, 3)}</h3>{body}</{tag}>'

    def head() -> str:
        body = rng.choice([f"<p>{sentence(1, 5)}</p>", menu(), f"<h2>{sentence(1, 4)}</h2>" + menu(), f'<a href="/">{word()}</a>'])
        return rng.choice([f"<header>{body}</header>", f'<div {name("header", "masthead", "top")}>{body}</div>'])

    def foot() -> str:
        body = rng.choice([f"&copy; {word()} &middot; {text(1, 2)}", f"<p>{text(1, 2)}</p>", menu("ul"), sentence()])
        return rng.choice([f"<footer>{body}</footer>", f"<footer>{body}</footer>", f'<div {name("footer", "copyright", "page-bottom")}>{body}</div>'])

    def block() -> str:
        p = rng.random()
        if p < 0.5:
            return f"<p>{text(1, 6)}</p>"
        if p < 0.62:
            return f"<p>{sentence(1, 3)}</p>"
        if p < 0.72:
            return f"<p><b>{text(1, 4)}<br>"
        if p < 0.8:
            return f"<h2>{sentence(1, 6)}</h2><p>{text(1, 4)}</p>"
        if p < 0.85:
            return f"<blockquote><p>{text(1, 2)}</p></blockquote>"
        if p < 0.9:
            return f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.randint(2, 5))) + f"</{t}>"
        if p < 0.93:
            return f"<table><tr><td>{word()}</td><td>{sentence()}</td></tr></table>"
        if p < 0.96:
            return f"<pre>{text(1, 2)}</pre>"
        return f'<p>{sentence()} <a href="/{word()}">{sentence(1, 4)}</a> {sentence()}</p>'

    def body(bare: bool) -> str:
        blocks = [block() for _ in range(rng.choice([1, 1, 1, 2, 3] if bare else [1, 2, 3, 5, 8, 14, 25]))]
        for extra, share in ((ad, 0.25), (side, 0.12), (form, 0.1), (notice, 0.08), (menu, 0)):
            if rng.random() < share:
                blocks.insert(rng.randint(0, len(blocks)), extra())
        inner = "".join(blocks)
        title = rng.choice([f"<h1>{sentence(2, 9)}</h1>", f"<h1>{sentence(2, 9)}</h1>", f"<header><h1>{sentence(2, 8)}</h1></header>", *[""] * (6 if bare else 1)])
        if "<header>" in title:
            title = title.replace("<header>", '<header data-content="1">')
        if rng.random() < 0.2:
            inner += comments()
        kind = rng.random()
        if kind < 0.55:
            return f'<article data-content="1">{title}{inner}</article>'
        if kind < 0.7:
            return f'<main data-content="1">{title}{inner}</main>'
        if kind < 0.78:
            return f'<main><article data-content="1">{title}{inner}</article></main>'
        if kind < 0.95:
            return f'<div data-content="1" {name("content", "post", "entry-content", "story", "article-body", "main-text")}>{title}{inner}</div>'
        return f'<div data-content="1">{title}{inner}</div>'

    pages = []
    for _ in range(count):
        before = [head() if rng.random() < 0.4 else "", menu() if rng.random() < 0.8 else ""]
        before += [f() for f, share in ((ad, 0.5), (notice, 0.3), (side, 0.15), (form, 0.15)) if rng.random() < share]
        after = [f() for f, share in ((side, 0.3), (comments, 0.3), (ad, 0.25), (form, 0.15), (notice, 0.1)) if rng.random() < share]
        bare = rng.random() < 0.35
        if bare:
            before, after = [rng.choice(["", "", ad(), menu()])], [rng.choice(["", "", comments(), side()])]
        main, wrap = body(bare), rng.random()
        middle = "".join(before) + main + "".join(after)
        middle = f"<div {name('wrapper', 'page', 'container')}>{middle}</div>" if wrap < 0.3 else middle
        pages.append(f"<html><body>{middle}{foot() if rng.random() < (0.3 if bare else 0.9) else ''}</body></html>")
    return pages


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_pages())


def texts(sources: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    out: list[str] = []
    for a, b in slices([len(s) for s in sources], SLICE_CHARS):
        pages = [read_page(s) for s in sources[a:b]]
        trees = forest(pages)
        content = model.marginals(trees) >= 0.5
        for page, start in zip(pages, trees.starts.tolist()):
            out.append("\n".join(text for node, text in page.segments if content[start + node]))
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    kept = Kept(pages.sparkSession, model or default_model(), lambda m: m)
    chosen = pages.select("page_id", "url", "html")
    id_type, url_type = (chosen.schema[c].dataType.simpleString() for c in ("page_id", "url"))

    def run(batches):
        model = kept.get()
        for batch in batches:
            found = texts([h or "" for h in batch.column(2).to_pylist()], model)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return chosen.mapInArrow(run, f"page_id {id_type}, url {url_type}, text string, n_chars bigint")


def op7_html_content(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
