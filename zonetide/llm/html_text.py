"""HTML extraction: a tree-structured graphical model over the nodes of a page.

Every element and every run of text is a node that is content or not. A node has a potential from its own features (tag, words
of class and id, links, lengths, punctuation), and every pair of parent and child has one from both labels and the child's tag.
On a tree, sum-product message passing, once up and once down, gives the exact marginals of all nodes; text whose marginal is
above a half is content. The potentials are fitted by maximum likelihood (gradients are marginals minus labels) on labelled
pages, whose texts are marked as article or not; a generator of such pages in many layouts is in ``labelled_pages``.

Content is written in blocks: block elements and <br> begin a new one, white space inside a block becomes one space, blocks without
text go, and a block's text is all of its content nodes in page order. Scripts, styles and the like have no text.

Defined results: a null or empty page, and a page without content, give an empty text. Unclosed and wrongly nested tags are closed as
browsers do for the common cases; nesting has no depth limit. Repeated rows give equal texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from .labelled_pages import pages as labelled_pages
from .shipped import ship

# Names of elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe object svg math head title textarea select option canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag ends an open paragraph if it is one of these; items and cells end those before them.
ENDS_P = BLOCKS - {"br", "body", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}
ENDS_ITEM = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
# What a page may end inside of.
UNENDED = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
# White space of HTML and what \s has beyond it, no-break spaces included.
SPACE = re.compile(r"\s+")

HASHES = 2048
STEPS = 60
WORD = re.compile(r"[a-z]+")


@dataclass
class Tree:
    """Nodes in page order, so a parent stands before its children."""

    parent: list[int]
    tag: list[str]
    names: list[str]  # class, id and role
    text: list[str | None]
    hidden: list[bool]
    marked: list[bool | None]  # the label, of labelled pages


class _Builder(HTMLParser):
    """Nodes from tags as browsers would nest them; a step takes the same time however many elements are open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tree = Tree([-1], ["#page"], [""], [None], [False], [None])
        self.open = [0]
        # depths of the open elements by tag, of blocks, and of blocks that aren't paragraphs
        self.depths: dict[str, list[int]] = {}
        self.blocks, self.bounds = [0], [0]

    def _add(self, tag: str, names: str, text: str | None, hidden: bool, marked: bool | None) -> int:
        t = self.tree
        up = self.open[-1]
        t.parent.append(up)
        t.tag.append(tag)
        t.names.append(names)
        t.text.append(text)
        t.hidden.append(hidden or t.hidden[up])
        t.marked.append(t.marked[up] if marked is None else marked)
        return len(t.tag) - 1

    def _open(self, tag: str, node: int) -> None:
        depth = len(self.open)
        self.open.append(node)
        self.depths.setdefault(tag, []).append(depth)
        if tag in BLOCKS:
            self.blocks.append(depth)
            if tag != "p":
                self.bounds.append(depth)

    def _close(self, depth: int) -> None:
        """Close the element at a depth and all inside it."""
        while len(self.open) > depth:
            tag = self.tree.tag[self.open.pop()]
            self.depths[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
                if tag != "p":
                    self.bounds.pop()

    def _innermost(self, tags: Iterable[str]) -> int:
        return max((self.depths[tag][-1] for tag in tags if self.depths.get(tag)), default=0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P and (depth := self._innermost(("p",))) > self.bounds[-1]:
            self._close(depth)
        if tag in ENDS_ITEM and (depth := self._innermost(ENDS_ITEM[tag])) > self._innermost(SCOPES):
            self._close(depth)
        given = dict(attrs)
        names = " ".join(given.get(k) or "" for k in ("class", "id", "role", "aria-label", "itemprop")).lower()
        hidden = tag in SILENT or "hidden" in given or "display:none" in (given.get("style") or "").replace(" ", "").lower()
        mark = given.get("data-content")
        node = self._add(tag, names, None, hidden, None if mark is None else mark == "1")
        if tag not in VOID:
            self._open(tag, node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        depth = self._innermost((tag,))
        if depth and not (tag in INLINE and self.blocks[-1] > depth):
            self._close(depth)

    def handle_data(self, data: str) -> None:
        self._add("#text", "", data, False, None)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![..``, whatever follows, is a comment up to the next ``>``."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def close(self) -> None:
        # a comment, declaration or tag that the page doesn't end is no text
        if UNENDED.match(self.rawdata):
            self.rawdata = ""
        super().close()


def parse(html: str | None) -> Tree:
    """The nodes of a page."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.tree


@lru_cache(maxsize=100_000)
def _hashed(kind: str, value: str | int) -> int:
    return crc32(f"{kind}:{value}".encode()) % HASHES


def features(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of all nodes' binary features, the node of each, and each node's edge type (the tag's)."""
    n = len(tree.tag)
    size, linked, marks = [0] * n, [0] * n, [0] * n
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[tree.parent[i]] or tree.tag[i] == "a"
    for i in range(n - 1, -1, -1):
        text = tree.text[i]
        if text is not None and not tree.hidden[i]:
            size[i] = len(text.split())
            linked[i] = size[i] if inside[i] else 0
            marks[i] = text.count(".") + text.count(",")
        if i and size[i]:
            up = tree.parent[i]
            size[up] += size[i]
            linked[up] += linked[i]
            marks[up] += marks[i]
    index, node = [], []
    for i in range(n):
        words = size[i]
        own = [_hashed("tag", tree.tag[i]), _hashed("words", min(words, 250).bit_length())]
        own += [_hashed("linked", 4 * linked[i] // words), _hashed("marks", min(20 * marks[i] // words, 5))] if words else [_hashed("linked", -1)]
        if tree.names[i]:
            own += [_hashed("name", w) for w in WORD.findall(tree.names[i])]
        if tree.hidden[i]:
            own.append(_hashed("hidden", 1))
        index += own
        node += [i] * len(own)
    return np.array(index), np.array(node), np.array([_hashed("edge", t) for t in tree.tag])


@dataclass
class Model:
    """Weights: of features for content, and of (parent's label, child's label) by the child's tag."""

    own: np.ndarray
    pair: np.ndarray


def levels_of(parent: list[int]) -> list[np.ndarray]:
    """Nodes by depth; parents stand before their children."""
    levels: list[list[int]] = []
    depth = [0] * len(parent)
    for i, up in enumerate(parent):
        d = depth[i] = depth[up] + 1 if up >= 0 else 0
        if d == len(levels):
            levels.append([])
        levels[d].append(i)
    return [np.array(x) for x in levels]


def marginals(own: np.ndarray, pair: np.ndarray, parent: np.ndarray, levels: list[np.ndarray], joint: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on trees: the probability of content of each node, and (if ``joint``) of both labels of each edge.

    ``own`` (n) scores content, ``pair`` (n, 2, 2) scores (parent's label, own label); roots have parent -1.
    """
    n = len(own)
    below = np.stack([np.zeros(n), own], axis=1)  # log potential with all messages from below
    upward = np.zeros((n, 2))
    for level in reversed(levels[1:]):
        upward[level] = np.logaddexp(pair[level, :, 0] + below[level, None, 0], pair[level, :, 1] + below[level, None, 1])
        np.add.at(below, parent[level], upward[level])
    belief = below.copy()
    edges = np.zeros((n if joint else 0, 2, 2))
    for level in levels[1:]:
        above = belief[parent[level]] - upward[level]
        both = above[:, :, None] + pair[level] + below[level, None, :]
        belief[level] = np.logaddexp(both[:, 0], both[:, 1])
        if joint:
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            edges[level] = both / both.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), edges


def fit(pages: list[str], steps: int = STEPS, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Maximum likelihood by Adam on the nodes of all labelled pages at once."""
    index, node, edge, parent, label = [], [], [], [], []
    at = 0
    for html in pages:
        tree = parse(html)
        i, k, e = features(tree)
        index.append(i)
        node.append(k + at)
        edge.append(e)
        parent.append(np.where(np.array(tree.parent) < 0, -1, np.array(tree.parent) + at))
        label.append(np.array([bool(m) for m in tree.marked], dtype=float))
        at += len(tree.tag)
    if not at:
        return Model(np.zeros(HASHES), np.zeros((HASHES, 2, 2)))
    index, node, edge, parent, label = map(np.concatenate, (index, node, edge, parent, label))
    levels = levels_of(parent.tolist())
    inner = np.flatnonzero(parent >= 0)
    truth = np.zeros((at, 2, 2))
    truth[inner, label[parent[inner]].astype(int), label[inner].astype(int)] = 1
    weights = [np.zeros(HASHES), np.zeros((HASHES, 2, 2))]
    state = [(w, np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, steps + 1):
        own = np.bincount(node, weights[0][index], at)
        p, joint = marginals(own, weights[1][edge], parent, levels)
        wrong = np.zeros((HASHES, 2, 2))
        np.add.at(wrong, edge[inner], (joint - truth)[inner])
        gradients = (np.bincount(index, (p - label)[node], HASHES) / len(pages) + decay * weights[0], wrong / len(pages) + decay * weights[1])
        for (w, mean, square), g in zip(state, gradients, strict=True):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g**2 - square)
            w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(*weights)


def content(tree: Tree, model: Model) -> np.ndarray:
    """The marginal of content of each node."""
    index, node, edge = features(tree)
    parent = np.array(tree.parent)
    own = np.bincount(node, model.own[index], len(parent))
    return marginals(own, model.pair[edge], parent, levels_of(tree.parent), joint=False)[0]


def text_of(html: str | None, model: Model, at_least: float = 0.5) -> str:
    """The main text of a page."""
    tree = parse(html)
    p = content(tree, model)
    blocks: list[str] = []
    current: list[str] = []
    block_of: list[int] = [0] * len(tree.tag)
    last = None
    for i in range(len(tree.tag)):
        if i:
            up = tree.parent[i]
            block_of[i] = i if tree.tag[i] in BLOCKS else block_of[up]
        if tree.tag[i] in BLOCKS and tree.tag[i] in VOID or block_of[i] != last:
            blocks.append("".join(current))
            current = []
            last = block_of[i]
            if tree.tag[i] in VOID and i:
                last = block_of[i] = i
        if tree.text[i] is not None and not tree.hidden[i] and p[i] >= at_least:
            current.append(tree.text[i])
    blocks.append("".join(current))
    return "\n".join(b for b in (SPACE.sub(" ", x).strip() for x in blocks) if b)


def trained(seed: int = 5, n_pages: int = 400) -> Model:
    """A model from ``n_pages`` generated labelled pages."""
    return fit(labelled_pages(n_pages, seed))


def main_text(df: DataFrame, html: Column, model: Model | None = None) -> Column:
    """The main text of each page."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model or trained())  # weights of fixed size

    @F.arrow_udf(StringType())
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([text_of(h.as_py(), sent.value) for h in pages], type=pa.string())

    return extracted(html)
