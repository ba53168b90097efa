"""Main text of web pages by a tree-structured graphical model of the DOM.

``extract(pages)`` returns page_id, url, text and n_chars (code points) of each
row: the article without menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments. Character references are decoded,
white space inside a block becomes one space, and blocks are joined in page order
by one space. Nothing else is dropped or cut.

Model
  The nodes are a page's elements (plain inline ones belong to the element around
  them); each has a hidden label, main text or frame. A node's own potential is
  linear in features of its tag, its parent's tag, the words in its class, id and
  role, and the length, punctuation and link share of its own text. A potential for each pair of
  parent and child, by kind of child, ties labels along the tree. *Sum-product*
  message passing, upward from the leaves and then downward from the root, gives
  the exact marginals; text whose element is main text with probability of at
  least one half stays. All potentials are trained jointly by the gradient of the
  log-likelihood (empirical minus expected statistics, from the same messages) on
  ``TRAIN`` labelled pages of many layouts.

  Messages go level by level over all trees of a batch at once (numpy). Training
  takes place on the driver on that fixed number of small pages; the model is a
  few hundred numbers and is broadcast. Pages are read where they lie, no shuffle.

Defined cases: null and empty html, and pages without main text, give an empty
text; markup that ends inside a tag, comment or script is closed at the end of
the page; text outside any element belongs to the root; repeated rows each get
their row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import labelled
from .util import batched, ready

TRAIN = 600
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)>?", re.S)
_ATTR = re.compile(r"""(class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
RAW = frozenset("script style noscript template iframe svg textarea object canvas".split())
# What an opening tag closes, if it is open above it and below the stopping tags.
_BLOCKS = frozenset("address article aside blockquote div dl dd dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
_CLOSES = {t: ("p",) for t in _BLOCKS} | {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"),
    "th": ("td", "th", "p"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th", "p")}
_STOPS = frozenset("ul ol dl table select article section div main aside nav form header footer body html blockquote".split())
TAGS = ("html body head title article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody tr td th figure figcaption "
        "nav aside header footer form label button select option details summary a span address").split()
# Kinds of children with a pair potential of their own: parts of a page, frames
# by their tag, parts of lists and tables, blocks of text.
_KINDS = {t: k for k, tags in enumerate(("article main section div body", "nav aside header footer form label button select details",
                                         "li dt dd tr td th tbody option ul ol dl table")) for t in tags.split()}
_OUTER = frozenset(["#root", "html", "body"])  # and each kind anew below these
_N_KINDS = 8


@dataclass
class Page:
    """Elements (parent index, tag, attributes) and text in page order."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    names: list[list[str]] = field(default_factory=lambda: [[]])
    mark: list[int | None] = field(default_factory=lambda: [None])
    # (element, block, inside a link, text)
    pieces: list[tuple[int, int, bool, str]] = field(default_factory=list)


def parse(html: str) -> Page:
    """A forgiving reading of tags: unknown ends are ignored, open elements end
    with their parent, and paragraphs, items and cells end where the next begins."""
    page = Page()
    open_: list[int] = [0]
    opened: Counter[str] = Counter()  # open elements by tag, so that an end without a beginning costs nothing
    block, link, at, n = 0, 0, 0, len(html)
    inline: list[tuple[str, bool]] = []  # open inline tags, and whether each is an element here
    inlines: Counter[str] = Counter()

    def close(i: int) -> None:
        """The open element at place i ends, and with it all within."""
        nonlocal link
        for e in open_[i:]:
            opened[page.tag[e]] -= 1
        del open_[i:]
        link = 0
        inline.clear()
        inlines.clear()

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            m_start, m_end = n, n
        else:
            m_start, m_end = m.start(), m.end()
        if m_start > at:
            page.pieces.append((open_[-1], block, link > 0, html[at:m_start]))
        at = m_end
        if m is None or m[2] is None:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if tag in VOID:
            block += tag in ("br", "hr")
            continue
        if tag in INLINE:
            if end:
                for i in range(len(inline) - 1, -1, -1) if inlines[tag] else ():
                    if inline[i][0] == tag:
                        if inline[i][1] and len(open_) > 1 and page.tag[open_[-1]] == tag:
                            opened[page.tag[open_.pop()]] -= 1
                        link -= tag == "a"
                        inlines[tag] -= 1
                        del inline[i]
                        break
                link = max(link, 0)
                continue
            names, _ = _attributes(m[3])
            if names:
                _open(page, open_, tag, m[3])
                opened[tag] += 1
            inlines[tag] += 1
            inline.append((tag, bool(names)))
            link += tag == "a"
            continue
        block += 1
        if end:
            for i in range(len(open_) - 1, 0, -1) if opened[tag] else ():
                if page.tag[open_[i]] == tag:
                    close(i)
                    break
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
                at = stop.end() if stop else n
            continue
        closes = _CLOSES.get(tag, ())
        for i in range(len(open_) - 1, 0, -1):
            t = page.tag[open_[i]]
            if t in closes:
                close(i)
                if t == tag or tag in _BLOCKS and tag not in ("li", "dt", "dd"):
                    break
            elif t in _STOPS:
                break
        _open(page, open_, tag, m[3])
        opened[tag] += 1
    return page


def _attributes(text: str) -> tuple[list[str], int | None]:
    names, mark = [], None
    for k, v in _ATTR.findall(text) if "=" in text else ():
        v = v.strip("\"'")
        if k.lower() == "data-y":
            mark = {"0": 0, "1": 1}.get(v)  # a training label; whatever else a page has there is nothing
        else:
            names += [w.lower() for w in _NAME.findall(v)] + [w.lower() for w in v.split() if "-" in w or "_" in w]
    return names, mark


def _open(page: Page, open_: list[int], tag: str, attributes: str) -> None:
    names, mark = _attributes(attributes)
    page.parent.append(open_[-1])
    page.tag.append(tag)
    page.names.append(names)
    page.mark.append(mark)
    open_.append(len(page.parent) - 1)


def text_of(page: Page, main: np.ndarray) -> str:
    """Kept text: one block after the other, white space normalised."""
    out, last, parts = [], None, []
    for element, block, _, text in page.pieces:
        if not main[element]:
            continue
        if block != last:
            out.append("".join(parts))
            last, parts = block, []
        parts.append(text)
    out.append("".join(parts))
    return " ".join(t for x in out if (t := " ".join(entities.unescape(x).split())))


# --- features --------------------------------------------------------------------

_TAG = {t: i for i, t in enumerate(TAGS)}
_N_TAGS = len(TAGS) + 1
_N_TEXT = 18


def _text_features(page: Page) -> list[list[int]]:
    n = len(page.parent)
    length, linked, dots, commas = [0] * n, [0] * n, [0] * n, [0] * n
    for e, _, a, t in page.pieces:
        k = len(t) - t.count(" ") if len(t) < 400 else len(t)
        if t.isspace():
            continue
        length[e] += k
        linked[e] += k if a else 0
        dots[e] += t.count(". ") + t.rstrip()[-1:].count(".")
        commas[e] += t.count(",")
    out = []
    for i in range(n):
        size = length[i]
        f = [0 if size == 0 else 1 if size < 20 else 2 if size < 60 else 3 if size < 160 else 4 if size < 500 else 5]
        if size:
            share = linked[i] / size
            f.append(6 if share == 0 else 7 if share < 0.3 else 8 if share < 0.8 else 9)
            f.append(10 if dots[i] == 0 else 11 if dots[i] < 3 else 12)
            f.append(13 if commas[i] == 0 else 14)
        f.append(15 if page.names[i] else 16)
        out.append(f)
    return out


class Forest:
    """The elements of many pages as one forest, with features and levels."""

    def __init__(self, pages: list[Page], vocabulary: dict[str, int]):
        parent, feats, kind, depth, begin = [], [], [], [], [0]
        base = _N_TAGS + _N_TEXT
        for p in pages:
            start = begin[-1]
            d: list[int] = []
            for i, (up, tag, names, own) in enumerate(zip(p.parent, p.tag, p.names, _text_features(p), strict=True)):
                parent.append(start + up if up >= 0 else -1)
                d.append(d[up] + 1 if up >= 0 else 0)
                kind.append(_KINDS.get(tag, 3) + 4 * (up >= 0 and p.tag[up] in _OUTER))
                f = [_TAG.get(tag, _N_TAGS - 1)] + [_N_TAGS + k for k in own]
                f += [base + vocabulary[w] for w in {*names, f"{tag}<{p.tag[up]}" if up >= 0 else tag} if w in vocabulary]
                feats.append(f)
            depth += d
            begin.append(start + len(p.parent))
        self.begin = begin
        self.parent, self.kind, self.depth = np.array(parent), np.array(kind), np.array(depth)
        self.flat = np.array([x for f in feats for x in f])
        self.owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
        order = np.argsort(self.depth, kind="stable")
        edges = np.searchsorted(self.depth[order], np.arange(self.depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def marginals(self, weight: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(main) of every element and the joint (parent, child) beliefs.
        ``weight``: log-odds of each feature; ``pair``: [kind, parent, child]."""
        n = len(self.parent)
        belief = np.zeros((n, 2))
        belief[:, 1] = np.bincount(self.owner, weights=weight[self.flat], minlength=n)
        up = np.zeros((n, 2))
        for level in self.levels[:0:-1]:  # upward: leaves first
            m = pair[self.kind[level]] + belief[level][:, None, :]
            up[level] = np.logaddexp(m[:, :, 0], m[:, :, 1])
            np.add.at(belief, self.parent[level], up[level])
        joint = np.zeros((n, 2, 2))
        total = belief.copy()
        for level in self.levels[1:]:  # downward: from the root
            cavity = total[self.parent[level]] - up[level]
            m = pair[self.kind[level]] + cavity[:, :, None]
            total[level] = belief[level] + np.logaddexp(m[:, 0, :], m[:, 1, :])
            j = m + belief[level][:, None, :]
            j = np.exp(j - j.max((1, 2), keepdims=True))
            joint[level] = j / j.sum((1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), joint


@dataclass
class Model:
    vocabulary: dict[str, int]
    weight: np.ndarray
    pair: np.ndarray

    def texts(self, htmls: list[str | None]) -> list[str]:
        pages = [parse(h or "") for h in htmls]
        if not pages:
            return []
        forest = Forest(pages, self.vocabulary)
        p, _ = forest.marginals(self.weight, self.pair)
        return [text_of(page, p[a:b] >= 0.5) for page, a, b in zip(pages, forest.begin, forest.begin[1:], strict=False)]


def labels_of(page: Page) -> np.ndarray:
    out = [0] * len(page.parent)
    for i in range(1, len(out)):
        mark = page.mark[i]
        out[i] = out[page.parent[i]] if mark is None else mark
    return np.array(out)


def train(htmls: list[str], steps: int = 250, rate: float = 0.25, ridge: float = 1e-4) -> Model:
    """Maximise the labels' likelihood (Adam on the exact gradient)."""
    pages = [parse(h) for h in htmls]
    seen: dict[str, int] = {}
    for p in pages:
        for up, tag, names in zip(p.parent, p.tag, p.names, strict=True):
            for w in {*names, f"{tag}<{p.tag[up]}" if up >= 0 else tag}:
                seen[w] = seen.get(w, 0) + 1
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, c in seen.items() if c > 2))}
    forest = Forest(pages, vocabulary)
    y = np.concatenate([labels_of(p) for p in pages])
    child = np.nonzero(forest.parent >= 0)[0]
    size = _N_TAGS + _N_TEXT + len(vocabulary)
    theta = np.zeros(size + 4 * _N_KINDS)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    have = np.zeros((_N_KINDS, 2, 2))
    np.add.at(have, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    for step in range(1, steps + 1):
        weight, pair = theta[:size], theta[size:].reshape(_N_KINDS, 2, 2)
        p, joint = forest.marginals(weight, pair)
        expected = np.stack([joint[child[forest.kind[child] == k]].sum(0) for k in range(_N_KINDS)])
        g = np.concatenate([np.bincount(forest.flat, weights=(y - p)[forest.owner], minlength=size), (have - expected).ravel()])
        g = g / len(pages) - ridge * theta
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta = theta + rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8) / (1 + step / 100)
    return Model(vocabulary, theta[:size], theta[size:].reshape(_N_KINDS, 2, 2))


_TRAINED: dict[int, Model] = {}


def model(n: int = TRAIN) -> Model:
    """The model of ``n`` labelled pages, trained once in a process."""
    if n not in _TRAINED:
        _TRAINED[n] = train(labelled(n))
    return _TRAINED[n]


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def extract(pages: DataFrame, m: Model | None = None, lot: int = 64) -> DataFrame:
    """See the module's text. ``pages``: page_id (long), url, html."""
    spark = pages.sparkSession
    ready(spark)
    held = spark.sparkContext.broadcast(m or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for s in range(0, b.num_rows, lot):
                    part = b.slice(s, lot)
                    yield from zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(),
                                   held.value.texts(part.column("html").to_pylist()), strict=True)
        yield from batched(rows(), _OUT)

    out = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
