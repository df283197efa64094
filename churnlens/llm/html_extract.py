"""Main-text extraction with a tree-structured graphical model over the DOM.

Method: every element of a page is a binary variable, content or not.  Its
unary potential is a linear function of markup and text shape (tag group,
words in class, id and role, link share, text length, punctuation); a 2 x 2
potential ties it to its parent, one for each kind of child (marked by its
tag or a class word, plain container, other).  A plain container that is all
its parent holds is only a wrapper: it is the same variable as its parent, so
nesting depth does not wear the message out.  Sum-product messages pass from the leaves up
and from the root down, which gives every element's exact content marginal;
the text of elements with a marginal over one half is the main text.  Both
potentials are trained together, as a conditional random field, from the
labelled pages of ``html_pages`` (the gradient is the labels' statistics minus
those of the model's marginals).

Messages are computed level by level for all pages of a batch at once; a page
is parsed, judged and written in one narrow map, so pages are independent and
memory follows a batch of about ``CHUNK_CHARS`` characters (or one longer page).

Text: character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined in page order by one space.  What is
not rendered (scripts, styles, head, templates, comments) is no text.

Defined cases: null or empty html gives the empty text; unclosed, stray and
overlapping tags are closed where the next block, cell or item begins; a tag
that the page's end cuts off is dropped;
repeated pages are extracted row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import html_pages
from churnlens.session import ship_package

CHUNK_CHARS = 1 << 20
#: Quotes only quote a value right after its ``=``; an unquoted value ends at white space or ``>``, a quote that never
#: closes is an ordinary character.  All repeats are possessive, so a page is scanned once.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

# HTML element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNRENDERED = set("script style head title template noscript textarea select option svg math iframe object canvas audio video".split())
RAW = set("script style title textarea noscript iframe".split())
BLOCK = set(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr caption ul br button label legend".split()
)
#: an opening tag of the key closes these open elements first
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
CLOSE_P = BLOCK - {"br", "label", "button", "legend", "tr", "td", "th"}
#: these end the search for an element to close
SCOPE = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"},
    "option": {"select"}, "p": {"td", "th", "table", "button", "li", "div", "article", "section", "aside", "main", "blockquote", "footer", "header", "nav"},
}
TAG_GROUPS = (
    {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "button", "label", "input", "legend"}, {"article"}, {"main"},
    {"section"}, {"div"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"},
    {"table", "tbody", "tr", "td", "th"}, {"a"}, {"html", "body"}, {"figure", "figcaption"},
)
WORD_GROUPS = (
    {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner"},
    {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "toolbar", "links", "pagination", "toc"},
    {"header", "masthead", "topbar"}, {"footer", "bottom", "copyright", "legal"},
    {"sidebar", "aside", "widget", "related", "recommended", "recommendations", "complementary", "rail"},
    {"comment", "comments", "respond", "reply", "replies", "discussion", "disqus", "feedback"},
    {"cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "gdpr", "warning"},
    {"share", "social", "newsletter", "subscribe", "signup", "login", "search", "form", "contentinfo"},
    {"article", "content", "main", "post", "entry", "story", "body", "text"},
)
SHAPE = 5
N_FEATURES = len(TAG_GROUPS) + len(WORD_GROUPS) + SHAPE

MARKED = 7  # the first groups (nav .. main) mark an element by its tag
CONTAINERS = {"section", "div", "table", "tbody", "tr", "td", "th", "html", "body", "#page"}

WRAPPER = 3
SAME = np.array([[0.0, -1e3], [-1e3, 0.0]])  # potential of a wrapper and its parent

_TAGS = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
_WORDS = {w: len(TAG_GROUPS) + i for i, g in enumerate(WORD_GROUPS) for w in g}


class Dom:
    """Elements of many pages in flat lists; text pieces carry their element and block."""

    def __init__(self):
        self.parent, self.depth, self.feature, self.label, self.kind, self.top = [], [], [], [], [], []
        self.pieces: list[tuple[int, int, str]] = []  # (element, block, text)
        self.page_pieces = [0]
        self._known: dict[tuple[str, str], list[int]] = {}

    def _features(self, tag: str, attrs: str) -> list[int]:
        key = (tag, attrs)
        found = self._known.get(key)
        if found is None:
            found = [_TAGS[tag]] if tag in _TAGS else []
            for m in ATTRIBUTE.finditer(attrs):
                if m[1].lower() in ("class", "id", "role"):
                    words = re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower())
                    found += sorted({_WORDS[w] for w in words if w in _WORDS} - set(found))
            if len(self._known) < 10_000:
                self._known[key] = found
        return found

    def _open(self, parent: int, tag: str, attrs: str) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        found = self._features(tag, attrs)
        self.feature.append(found)
        marked = any(c < MARKED or c >= len(TAG_GROUPS) for c in found)
        self.top.append(tag in ("#page", "html", "body"))
        self.kind.append(0 if marked else 1 if tag in CONTAINERS else 2)
        self.label.append(int(m[1]) if (m := re.search(r'\by="([01])"', attrs)) else self.label[parent] if parent >= 0 else 0)
        return len(self.parent) - 1

    def add(self, page: str) -> None:
        root = self._open(-1, "#page", "")
        self.label[root] = int(page.startswith("<!--y-->"))
        stack, tags, block, at, hidden = [root], ["#page"], 0, 0, 0
        lower = None

        def text(a: int, b: int) -> None:
            if a < b and not hidden:
                self.pieces.append((stack[-1], block, page[a:b]))

        while True:
            m = TOKEN.search(page, at)
            if m is None:
                text(at, len(page))
                break
            text(at, m.start())
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag == "p" and "p" not in tags:
                    block += 1
                    continue
                if tag in tags:
                    # an inline tag does not close the blocks opened inside it
                    k = len(tags) - 1 - tags[::-1].index(tag)
                    if tag in BLOCK or tag in UNRENDERED or not any(t in BLOCK for t in tags[k + 1 :]):
                        block += any(t in BLOCK for t in tags[k:])
                        hidden -= sum(t in UNRENDERED for t in tags[k:])
                        del tags[k:], stack[k:]
                continue
            shut = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSE_P else set())
            for name in shut:
                edge = SCOPE.get(name, set())
                for k in range(len(tags) - 1, 0, -1):
                    if tags[k] == name:
                        hidden -= sum(t in UNRENDERED for t in tags[k:])
                        del tags[k:], stack[k:]
                        break
                    if tags[k] in edge:
                        break
            block += tag in BLOCK
            if tag in RAW:
                if lower is None:
                    lower = page.lower()
                    if len(lower) != len(page):  # letters that grow: A-Z only
                        lower = page.translate(ASCII_LOWER)
                end = lower.find(f"</{tag}", at)
                if end < 0:
                    break
                close = page.find(">", end)
                at = close + 1 if close >= 0 else len(page)
                continue
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
                continue
            stack.append(self._open(stack[-1], tag, m[3]))
            tags.append(tag)
            hidden += tag in UNRENDERED
        self.page_pieces.append(len(self.pieces))

    def arrays(self):
        """(parent, levels of element numbers, feature matrix, kinds)."""
        n = len(self.parent)
        parent, depth = np.array(self.parent), np.array(self.depth)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
        levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        x = np.zeros((n, N_FEATURES))
        rows = np.repeat(np.arange(n), [len(f) for f in self.feature])
        x[rows, [c for f in self.feature for c in f]] = 1
        chars, linked, points = np.zeros(n), np.zeros(n), np.zeros(n)
        link = x[:, _TAGS["a"]] > 0
        for e, _, t in self.pieces:
            size = len(t.strip())
            chars[e] += size
            points[e] += t.count(",") + t.count(".")
            if link[e]:
                linked[e] += size
        for level in levels[:0:-1]:
            for v in (chars, linked, points):
                np.add.at(v, parent[level], v[level])
        some = np.maximum(chars, 1)
        own = np.zeros(n)
        for e, _, t in self.pieces:
            own[e] += len(t.strip())
        kind, top = np.array(self.kind), np.array(self.top)
        children = np.bincount(parent[parent >= 0], minlength=n)
        kind[(kind == 1) & (parent >= 0) & ~top[parent] & (children[parent] == 1) & (own[parent] == 0)] = WRAPPER
        x[:, -5] = own > 0
        x[:, -4] = linked / some
        x[:, -3] = np.log1p(np.minimum(chars, 400)) / 6
        x[:, -2] = np.minimum(points / some * 20, 1)
        x[:, -1] = (linked > 0.5 * some) & (chars > 0)
        x[kind == WRAPPER] = 0
        return parent, levels, x, kind


class Model:
    """Unary weights (last one the intercept) and the potentials pair[kind of child, child, parent]."""

    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, np.concatenate((pair, SAME[None]))

    def propagate(self, parent: np.ndarray, levels: list[np.ndarray], x: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log marginals of every element, and of every (child, parent) pair, by an upward and a downward pass."""
        z = np.column_stack((x, kind != WRAPPER)) @ self.weights
        unary = np.stack((np.zeros(len(z)), z), axis=1)
        belief, up = unary.copy(), np.zeros_like(unary)
        for level in levels[:0:-1]:
            tie = self.pair[kind[level]]
            up[level] = np.logaddexp(belief[level, :1] + tie[:, 0], belief[level, 1:] + tie[:, 1])
            np.add.at(belief, parent[level], up[level])
        joint = np.full((len(z), 2, 2), -np.inf)
        for level in levels:
            if parent[level[0]] >= 0:
                out = belief[parent[level]] - up[level]  # what the parent knows without this child
                tie = self.pair[kind[level]]
                joint[level] = belief[level][:, :, None] + tie + out[:, None, :]
                joint[level] -= np.logaddexp.reduce(joint[level].reshape(-1, 4), axis=1)[:, None, None]
                belief[level] += np.logaddexp(out[:, :1] + tie[:, :, 0], out[:, 1:] + tie[:, :, 1])
            belief[level] -= np.logaddexp.reduce(belief[level], axis=1, keepdims=True)
        return belief, joint

    def marginals(self, parent: np.ndarray, levels: list[np.ndarray], x: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Content marginal of every element."""
        return np.exp(self.propagate(parent, levels, x, kind)[0][:, 1])


def train(labelled: list[str], steps: int = 400, rate: float = 0.1, l2: float = 0.1) -> Model:
    """Maximum conditional likelihood (Adam) from pages whose elements carry ``y`` marks."""
    dom = Dom()
    for page in labelled:
        dom.add(page)
    parent, levels, x, kind = dom.arrays()
    y = np.array(dom.label)
    child = np.flatnonzero((parent >= 0) & (kind != WRAPPER))
    seen, expected = np.zeros((3, 2, 2)), np.zeros((3, 2, 2))
    np.add.at(seen, (kind[child], y[child], y[parent[child]]), 1)
    flat = np.column_stack((x, kind != WRAPPER))
    n = N_FEATURES + 1
    w = np.zeros(n + 12)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        belief, joint = Model(w[:n], w[n:].reshape(3, 2, 2)).propagate(parent, levels, x, kind)
        expected[:] = 0
        np.add.at(expected, kind[child], np.exp(joint[child]))
        g = np.concatenate((flat.T @ (np.exp(belief[:, 1]) - y), (expected - seen).reshape(-1))) + l2 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w = w - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Model(w[:n], w[n:].reshape(3, 2, 2))


def main_texts(model: Model, pages: list[str]) -> list[str]:
    """Main text of every page of a batch."""
    dom = Dom()
    for page in pages:
        dom.add(page)
    parent, levels, x, kind = dom.arrays()
    keep = model.marginals(parent, levels, x, kind) > 0.5
    out = []
    for a, b in zip(dom.page_pieces[:-1], dom.page_pieces[1:]):
        blocks: list[list[str]] = []
        last = None
        for e, block, t in dom.pieces[a:b]:
            if keep[e]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(_html.unescape(t) if "&" in t else t)
        joined = (" ".join("".join(b).split()) for b in blocks)
        out.append(" ".join(t for t in joined if t))
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    ship_package(pages.sparkSession)
    model = model or train(html_pages.pages())

    def run(batches):
        for b in batches:
            html = [h or "" for h in b.column("html").to_pylist()]
            texts: list[str] = []
            while len(texts) < len(html):
                i = j = len(texts)
                size = 0
                while j < len(html) and (j == i or size + len(html[j]) <= CHUNK_CHARS):
                    size += len(html[j])
                    j += 1
                texts += main_texts(model, html[i:j])
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
