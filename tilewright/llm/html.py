"""Main-text extraction by gradient-boosted trees over DOM nodes, with hierarchical decoding.

A page is parsed into a tree of block-level elements and of inline elements with names of their own
(class, id, role). Boosted trees score every node by its tag, its own and inherited attribute tokens,
depth, place among its siblings, and the amount, density and links of the text below it. A node may be
kept only if its parent is: among all such choices the one with the largest sum of log-odds is taken,
by one pass from the leaves up and one down, so no kept node is below a dropped one.

Attribute tokens and tags are hashed into buckets. What a bucket says (its log-odds of being main text)
is learned from the training pages, out of fold for the trees that are fitted on it, so no list of good
and bad names is written down here and a name never met says nothing.

The trees are trained on pages made by rule (``pages.py``), TRAINING_PAGES from a fixed seed.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pages import MARK, PageMaker

TRAINING_PAGES = 600
#: Buckets of hashed tokens, and training folds for what they say.
BUCKETS, FOLDS = 4096, 5

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|data-main)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PIECES = re.compile(r"[a-z]+")
_FALLBACK = re.compile(r"[^<]*</iframe[^>]*>", re.I)

# HTML's void elements, those whose content is no markup, and elements that stand as blocks.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title".split())
_BLOCKS = set(
    "html body div p section article main nav header footer aside form ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address fieldset details summary dialog button menu hgroup "
    "center label legend option optgroup select noscript".split()
)
#: Elements that sloppy pages leave open: without any end tag further on, their start tag is passed over.
_MUST_CLOSE = set("template noscript select object video audio canvas svg math button dialog label".split())
_EMBEDDED = set("object video audio canvas svg math picture".split())
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"},
}
_INSIDE_CONTROLS = set("button label option optgroup legend select".split())
_WALLS = set("ul ol dl table article section div main nav header footer aside form body html blockquote td th".split())
#: Kinds of elements by HTML's content model, in an order that lets a cut tell neighbours apart.
_TAG_KIND = {
    **dict.fromkeys(["article", "main"], 8), **dict.fromkeys(["p", "blockquote", "pre"], 7),
    **dict.fromkeys(["h1", "h2", "h3", "h4", "h5", "h6", "hgroup"], 6), **dict.fromkeys(["html", "body"], 5),
    **dict.fromkeys(["div", "section", "center"], 4), **dict.fromkeys(["ul", "ol", "li", "dl", "dt", "dd"], 3),
    **dict.fromkeys(["table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "figure", "figcaption"], 3.5),
    **dict.fromkeys(["header", "footer", "aside"], 1), **dict.fromkeys(["nav", "menu"], 0.5),
    **dict.fromkeys(["form", "button", "dialog", "label", "fieldset", "option", "optgroup", "legend", "select", "noscript"], 0),
}


@lru_cache(maxsize=100_000)
def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    names: list[int] = field(default_factory=list)
    marked: bool = False
    children: list[int] = field(default_factory=list)
    links: int = 0
    link_chars: int = 0
    chars: int = 0
    words: int = 0
    stops: int = 0
    nodes: int = 1
    blocks: int = 0
    paragraphs: int = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str, bool]]]:
    """Nodes in page order, and the text runs as (node, text, does a block end before it)."""
    nodes = [Node("#page", -1, 0)]
    texts: list[tuple[int, str, bool]] = []
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements, each with the node that holds its text
    at, size, broken, in_link = 0, len(page), True, 0
    ends: dict[str, tuple[int, int]] = {}

    def add(text: str) -> None:
        nonlocal broken
        if text:
            node = stack[-1][1]
            texts.append((node, text, broken))
            broken = False
            if in_link:
                nodes[node].link_chars += len(text.strip())

    def close(tags: set[str]) -> None:
        nonlocal in_link
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                in_link -= sum(t == "a" for t, _ in stack[i:])
                del stack[i:]
                break
            if stack[i][0] in _WALLS:
                break

    def end_of(tag: str, after: int) -> int:
        """Where the next end tag of an element ends; -1 without one. Each part of the page is searched once for each tag."""
        start, end = ends.get(tag, (-1, 0))
        if end >= 0 and start < after:
            m = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, after)
            start, end = ends[tag] = (m.start(), m.end()) if m else (size, -1)
        return end

    while at < size:
        next_at = page.find("<", at)
        if next_at < 0:
            add(page[at:])
            break
        if next_at > at:
            add(page[at:next_at])
        m = _TOKEN.match(page, next_at)
        if not m:
            add("<")
            at = next_at + 1
            continue
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, attrs = name.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:  # an end tag
            if tag in _BLOCKS:
                broken = True
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    in_link -= sum(t == "a" for t, _ in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] in _WALLS and tag not in _WALLS:
                    break
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                broken = True
            continue
        if attrs.endswith("/") and tag not in _BLOCKS:
            continue
        if tag in _RAW:  # as in a browser, one without an end goes on to the end of the page
            end = end_of(tag, at)
            at = end if end >= 0 else size
            continue
        if tag == "iframe":
            fallback = _FALLBACK.match(page, at)
            at = fallback.end() if fallback else at
            continue
        if tag in _MUST_CLOSE:
            end = end_of(tag, at)
            if end < 0:
                continue
            if tag == "template":
                at = end
                continue
        if tag in _BLOCKS:
            broken = True
            if tag not in _INSIDE_CONTROLS and tag not in ("html", "body"):
                close({"select"})
                close({"p"})
            if tag in _CLOSED_BY:
                close(_CLOSED_BY[tag])
        holder = stack[-1][1]
        names: list[int] = []
        marked = False
        if attrs and not attrs.isspace():
            for kind, *values in _ATTR.findall(attrs):
                if kind.lower() == MARK:
                    marked = True
                else:
                    names += map(_bucket, _PIECES.findall("".join(values).lower()))
        if tag in _BLOCKS or (names and tag != "a" and tag not in _EMBEDDED):
            nodes.append(Node(tag, holder, len(stack), names, marked))
            nodes[holder].children.append(len(nodes) - 1)
            holder = len(nodes) - 1
        if tag == "a":
            nodes[holder].links += 1
            in_link += 1
        if not attrs.endswith("/"):
            stack.append((tag, holder))
    return nodes, texts


@dataclass
class Evidence:
    """Log-odds of main text by bucket, of tags and of attribute tokens; 0 where training has not met a bucket."""

    tags: np.ndarray
    names: np.ndarray

    @classmethod
    def of(cls, pages: list[list[Node]]) -> Evidence:
        """Learns from marked nodes; each bucket is smoothed by four nodes that say nothing."""
        seen = np.zeros((2, 2, BUCKETS))
        for nodes in pages:
            for x in nodes[1:]:
                seen[0, int(x.marked), _bucket(x.tag)] += 1
                for b in set(x.names):
                    seen[1, int(x.marked), b] += 1
        share = (seen[:, 1].sum(axis=1) + 1) / (seen.sum(axis=(1, 2)) + 2)
        odds = np.log((seen[:, 1] + 4 * share[:, None]) / (seen[:, 0] + 4 * (1 - share[:, None])))
        odds -= np.log(share / (1 - share))[:, None]
        return cls(odds[0], odds[1])


def count_text(nodes: list[Node], texts: list[tuple[int, str, bool]]) -> list[int]:
    """Sums up each node's text and that of all nodes below it; returns the characters of its own."""
    for node, text, fresh in texts:
        x = nodes[node]
        n = len(text.split())
        if n:
            x.chars += len(text)
            x.words += n
            x.stops += text.count(".") + text.count(",")
            x.blocks += fresh
    own = [x.chars for x in nodes]
    for x in nodes:
        x.paragraphs = int(x.tag == "p")
    for i in range(len(nodes) - 1, 0, -1):
        x, up = nodes[i], nodes[nodes[i].parent]
        up.chars += x.chars
        up.words += x.words
        up.stops += x.stops
        up.links += x.links
        up.link_chars += x.link_chars
        up.nodes += x.nodes
        up.blocks += x.blocks
        up.paragraphs += x.paragraphs
    return own


WIDTH = 30


def node_features(nodes: list[Node], own: list[int], evidence: Evidence) -> np.ndarray:
    """One row of features for each node, by its counted text."""
    whole, log = max(1, nodes[0].chars), np.log1p
    place: dict[int, tuple[int, int]] = {}
    for x in nodes:
        for j, child in enumerate(x.children):
            place[child] = (j, len(x.children))
    rows: list[tuple] = []
    top = (0.0, 0.0, 9.0, 0.0, 0.0)
    inherited = [top] * len(nodes)
    held: list[float] = []
    seen = 0
    for i, x in enumerate(nodes):
        kind, of_tag = _TAG_KIND.get(x.tag, 2), float(evidence.tags[_bucket(x.tag)])
        of_names = evidence.names[x.names] if x.names else np.zeros(1)
        least, most, total = float(of_names.min()), float(of_names.max()), float(of_names.sum())
        held.append(of_tag)
        up = inherited[x.parent] if i else top
        parent = nodes[x.parent] if i else x
        j, n = place.get(i, (0, 1))
        before = nodes[parent.children[j - 1]] if i and j else None
        after = nodes[parent.children[j + 1]] if i and j + 1 < n else None
        rows.append((
            kind, of_tag, least, most, total, *up, held[x.parent] if i else 0.0, x.depth,
            x.chars, own[i], x.link_chars / max(1, x.chars), x.links, x.chars / x.nodes,
            x.stops / max(1, x.words), x.chars / whole, x.chars / max(1, parent.chars), seen / whole, j, n, j / n, n - j,
            x.paragraphs, x.words / max(1, x.blocks), before.chars if before else -0.5, after.chars if after else -0.5,
            _TAG_KIND.get(before.tag, 2) if before else -1,
        ))
        strong = kind if kind != 5 else 0.0  # html and body are on every page
        inherited[i] = (min(up[0], least), max(up[1], most), min(up[2], kind), max(up[3], strong), min(up[4], of_tag))
        seen += own[i]
    out = np.array(rows, float).reshape(-1, WIDTH)
    for column in (12, 13, 15, 16, 25, 27, 28):
        out[:, column] = log(out[:, column])
    return out


@dataclass
class Boosted:
    """Regression trees on log-odds; each tree is complete, its nodes in level order."""

    base: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaves.shape[1]))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32) -> Boosted:
    """Fits trees to the logistic loss by Newton steps, over the quantile bins of each feature."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    width_x = x.shape[1]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    place = binned + np.arange(width_x) * bins
    allowed = np.arange(bins)[None, :] < np.array([len(e) for e in edges])[:, None]
    base = float(np.log(y.mean() / (1 - y.mean())))
    at_score, n_inner = np.full(len(y), base), 2**depth - 1
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-at_score))
        g, h = y - p, p * (1 - p) + 1e-9
        g_wide, h_wide = np.repeat(g, width_x), np.repeat(h, width_x)
        feature, cut = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = (place + ((at - first) * width_x * bins)[:, None]).ravel()
            gs = np.bincount(cell, g_wide, width * width_x * bins).reshape(width, width_x, bins).cumsum(axis=2)
            hs = np.bincount(cell, h_wide, width * width_x * bins).reshape(width, width_x, bins).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
            gain[(hs < 1) | (ht - hs < 1) | ~allowed] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for node, b in enumerate(best.tolist()):
                f, k = divmod(b, bins)
                if gain[node, f, k] > 1e-6:
                    feature[first + node], cut[first + node] = f, edges[f][k]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - n_inner
        gs, hs = np.bincount(leaf, g, n_inner + 1), np.bincount(leaf, h, n_inner + 1)
        value = rate * gs / (hs + 1)
        at_score += value[leaf]
        features.append(feature)
        cuts.append(cut)
        leaves.append(value)
    return Boosted(base, np.array(features), np.array(cuts), np.array(leaves))


@dataclass
class Extractor:
    """What training leaves: the buckets' evidence and the trees."""

    evidence: Evidence
    trees: Boosted


@lru_cache(maxsize=2)
def trained(seed: int = 11, pages: int = TRAINING_PAGES) -> Extractor:
    """The extractor for pages of a seed; deterministic."""
    maker = PageMaker(seed)
    made = [parse(maker.page()) for _ in range(pages)]
    own = [count_text(*x) for x in made]
    rows, marks = [], []
    for fold in range(FOLDS):
        others = Evidence.of([nodes for i, (nodes, _) in enumerate(made) if i % FOLDS != fold])
        for (nodes, _), held in list(zip(made, own, strict=True))[fold::FOLDS]:
            rows.append(node_features(nodes, held, others)[1:])
            marks += [x.marked for x in nodes[1:]]
    return Extractor(Evidence.of([nodes for nodes, _ in made]), boost(np.concatenate(rows), np.array(marks, float)))


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The kept nodes: the closed-under-parents set of the largest sum of log-odds. The page itself is always kept."""
    best = np.clip(odds, -8, 8)
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and best[i] > 0
    return kept


def _joined(texts: list[tuple[int, str, bool]], kept: np.ndarray) -> str:
    """The kept runs: white space inside a block made one space, blocks parted by line breaks."""
    blocks: list[list[str]] = [[]]
    broken = False
    for node, text, fresh in texts:
        broken = broken or fresh
        if kept[node]:
            if broken:
                blocks.append([])
                broken = False
            blocks[-1].append(text)
    lines = (" ".join(html_lib.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: list[str | None], model: Extractor) -> list[str]:
    """The main text of each page; null and empty pages have none."""
    parsed = [parse(p or "") for p in pages]
    rows = [node_features(x[0], count_text(*x), model.evidence) for x in parsed]
    if not rows:
        return []
    odds = model.trees.predict(np.concatenate(rows))
    out, at = [], 0
    for (nodes, texts), x in zip(parsed, rows, strict=True):
        out.append(_joined(texts, decode(nodes, odds[at : at + len(x)])))
        at += len(x)
    return out


def _run(model: Extractor):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html", 2_000_000):
            found = extract(batch.column("_html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                names=["_id", "_url", "text", "n_chars"],
            )

    return run


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars.

    Null and empty pages have an empty text; a null id or url is carried on; repeated rows each get a row;
    an empty table gives none; other columns of ``pages``, whatever their names, are not looked at. A page
    is parsed whole in one task: about 30 bytes of memory for each of its characters. White space is what
    Python's str.split takes for it, so a non-breaking space becomes a space too. As in a browser, a
    ``textarea`` or ``title`` that is never closed holds the rest of its page, which is no main text then.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    out = rows.mapInArrow(_run(trained()), "_id long, _url string, text string, n_chars long")
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_url", url_col)
