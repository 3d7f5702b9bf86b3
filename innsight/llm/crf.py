"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into its leaf blocks: runs of text between block-level tags, in
page order, with the tags and class words of their ancestors.  Scripts, styles,
the head and comments hold no blocks.  Each block has features of its ancestors
and of its text (length, share of links, ending, marks, place); a linear-chain
CRF with the labels *content* and *other* is trained on labelled pages and
decoded by Viterbi; the blocks decoded as content make the text.

No table labels pages, so pages label themselves where their markup is sure:
a block within ``article`` or ``main`` and outside of navigation, footers and the like
is content.  Sure markup is not everywhere, so each labelled page is
also learned with its article under another container and with one more block
of a kind that the page lacks (sidebar, comments, notice, form ...), and with
its sure tags hidden.  ``FIT_PAGES`` bounds the labelled pages, chosen by hash.

Defined results: NULL or empty html gives the empty text; a page without sure
markup is decoded like any other; a head without an end ends where HTML says
(at the body, or at what a head cannot hold); without labelled pages, the weights are
those of a few fixed examples; broken markup is read as far as it goes;
repeated rows give equal texts; an empty table gives no rows; columns but
page_id, url and html are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.chunks import slices
from innsight.llm.common import first_by_hash

#: Labelled pages that the weights are trained on.
FIT_PAGES = 300
EPOCHS = 6
DIM = 1 << 13

# fixed values: tags of HTML
_BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HIDDEN = {"script", "style", "head", "noscript", "template", "iframe", "svg", "object", "canvas", "title", "textarea", "select", "option", "datalist"}
_EMPTY = set("area base br col embed hr img input link meta source track wbr".split())
#: A start tag closes these if they are open.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: What a head may hold; anything else ends it.
_IN_HEAD = set("html head base basefont bgsound link meta title style script noscript noframes template".split())
_SURE = {"article", "main"}
_OTHER = {"nav", "footer", "aside", "form", "header", "menu", "button", "dialog"}
_OTHER_WORDS = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent footer header menu nav navigation newsletter notice pager pagination popup promo related reply respond share sidebar social sponsor sponsored subscribe tags toolbar widget".split())
#: What a page may have besides: (markup before, after).
_EXTRA = [
    ('<aside class="sidebar">', "</aside>"), ('<div class="sidebar"><h3>', "</h3></div>"), ('<section class="comments" id="comments"><div class="comment">', "</div></section>"),
    ('<div class="comment"><p>', "</p></div>"), ('<ol class="comment-list"><li class="comment">', "</li></ol>"), ('<div class="cookie-notice">', "</div>"), ('<div class="notice">', "</div>"),
    ('<form class="newsletter"><label>', "</label></form>"), ("<header>", "</header>"), ('<div class="header">', "</div>"), ('<div class="ad">', "</div>"), ('<div class="advert sponsored">', "</div>"),
    ('<div class="related"><ul><li><a href="/x">', "</a></li></ul></div>"), ('<div id="footer">', "</div>"), ('<div class="share social">', "</div>"), ('<div class="menu"><a href="/x">', "</a></div>"),
    ('<div role="navigation"><a href="/x">', "</a></div>"), ('<div class="breadcrumbs"><a href="/x">', "</a></div>"), ('<div id="banner">', "</div>"), ("<aside>", "</aside>"), ("<form>", "</form>"),
    ("<header><h1>", "</h1></header>"), ('<div class="sidebar"><p>', "</p></div>"), ("<aside><h2>More</h2><p>", "</p></aside>"), ('<div class="widget"><p>', "</p></div>"),
    ('<div class="comments"><h3>Comments</h3><p>', "</p></div>"), ('<form action="/s"><p>', "</p></form>"), ('<div class="notice"><p>', "</p></div>"), ('<div class="header"><h1>', "</h1></div>"),
]
_CONTAINERS = ["<main>", '<div class="content">', '<div id="content">', '<div class="post">', '<div class="entry-content">', '<div class="article-body">', '<section class="article">', "<div>", '<div role="main">']
_EXAMPLES = [
    '<html><body><nav><a href="/a">Home</a><a href="/b">News</a></nav><article><h1>A heading</h1><p>A paragraph of some words, with an end.</p><p>And one more of them here.</p></article><div class="ad">Buy this now.</div><footer>&copy; a site</footer></body></html>',
    '<html><body><header>A site</header><main><h1>Some title</h1><p>Words that make up the first paragraph of a text.</p><ul><li>One point</li><li>Two points</li></ul></main><aside>More to read</aside><footer>Contact</footer></body></html>',
]
_WORD = re.compile(r"[a-z]+")


class _Blocks(HTMLParser):
    """Collects (text, ancestors, class words, characters in links) of leaf blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, frozenset]] = []
        self.hidden = 0
        self.links = 0
        self.text: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[str, tuple, frozenset, float]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            tags = tuple(t for t, _ in self.open)
            self.blocks.append((text, tags, frozenset().union(*(w for _, w in self.open)), self.linked / len(text)))
        self.text, self.linked = [], 0

    def _pop(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.hidden -= tag in _HIDDEN
            self.links -= tag == "a"
        del self.open[at:]

    def _end_head(self, tag: str) -> None:
        """Close a head that was left open: at the body, or at what it cannot hold outside of its hidden elements."""
        at = next((k for k, (name, _) in enumerate(self.open) if name == "head"), None)
        if at is None:
            return
        inside = {name for name, _ in self.open[at + 1 :]}
        if tag == "body" or (tag not in _IN_HEAD and not inside) or (tag in _BLOCKS and not inside & (_HIDDEN - {"title"})):
            self._pop(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden:
            self._end_head(tag)
        if tag == "br":
            self.text.append(" ")
        if tag in _BLOCKS:
            self.flush()
            closes = _CLOSES.get(tag, {"p"})
            for at in range(len(self.open) - 1, -1, -1):
                name = self.open[at][0]
                if name in closes:
                    self._pop(at)
                    break
                if name in _BLOCKS and name != "p":
                    break
        if tag in _EMPTY:
            return
        words = frozenset(w for k, v in attrs if k in ("class", "id", "role") and v for w in _WORD.findall(v.lower()))
        self.open.append((tag, words))
        self.hidden += tag in _HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._pop(at)
                return
            if tag not in _BLOCKS and self.open[at][0] in _BLOCKS:
                return  # an inline end tag does not close blocks

    def handle_data(self, data: str) -> None:
        if self.hidden and self.open[-1][0] == "head" and data.strip():
            self._end_head("")
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str) -> list[tuple[str, tuple, frozenset, float]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def sure_labels(blocks: list) -> list[int] | None:
    """1 for content, 0 for other; None if the page's markup does not say."""
    if not any(_SURE & set(tags) for _, tags, _, _ in blocks):
        return None
    return [int(bool(_SURE & set(tags)) and not _OTHER & set(tags) and not _OTHER_WORDS & words) for _, tags, words, _ in blocks]


def features(blocks: list, hide: frozenset = frozenset()) -> list[np.ndarray]:
    """Hashed feature numbers of each block; ancestors in ``hide`` count as plain containers."""
    out = []
    for i, (text, tags, words, linked) in enumerate(blocks):
        n = text.count(" ") + 1
        near = [t for t in tags if t in _BLOCKS and t not in ("html", "body")]
        names = ["bias", f"len{min(n.bit_length(), 8)}", f"link{round(linked * 4)}", f"end{text[-1] if text[-1] in '.!?:|' else ''}", f"first{i == 0}", f"last{i == len(blocks) - 1}",
                 f"sign{'©' in text or '·' in text}", f"parent{near[-1] if near and near[-1] not in hide else 'div'}"]
        names += [f"in_{t if t not in hide else 'div'}" for t in set(near)]
        names += [f"word_{w}" for w in words]
        names += [f"other{bool(_OTHER_WORDS & words)}"]
        out.append(np.unique(np.fromiter((zlib.crc32(x.encode()) % DIM for x in names), np.int64, len(names))))
    return out


class Chain:
    """Linear-chain CRF with two labels: a weight per feature (for content) and four transitions."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros(DIM) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    def _unary(self, x: list[np.ndarray]) -> np.ndarray:
        return np.array([[0.0, self.weights[f].sum()] for f in x])

    def marginals(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(P(label of each block), expected count of each transition), by forward-backward."""
        u, n = self._unary(x), len(x)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0] = u[0]
        for i in range(1, n):
            a[i] = u[i] + np.logaddexp(a[i - 1, 0] + self.moves[0], a[i - 1, 1] + self.moves[1])
        for i in range(n - 2, -1, -1):
            s = u[i + 1] + b[i + 1]
            b[i] = np.logaddexp(self.moves[:, 0] + s[0], self.moves[:, 1] + s[1])
        z = np.logaddexp(a[-1, 0], a[-1, 1])
        pairs = np.zeros((2, 2))
        if n > 1:
            pairs = np.exp(a[:-1, :, None] + self.moves + (u[1:] + b[1:])[:, None, :] - z).sum(0)
        return np.exp(a + b - z), pairs

    def train(self, pages: list[tuple[list[np.ndarray], list[int]]], epochs: int, seed: int, rate: float = 0.5, shrink: float = 1e-4) -> Chain:
        """AdaGrad on the log-likelihood, page by page."""
        rng = np.random.default_rng(seed)
        gw, gm = np.full(DIM, 1e-6), np.full((2, 2), 1e-6)
        for _ in range(epochs):
            for k in rng.permutation(len(pages)):
                x, y = pages[k]
                p, pairs = self.marginals(x)
                at = np.concatenate(x)
                d = np.bincount(at, np.repeat(np.array(y) - p[:, 1], [len(f) for f in x]), DIM)
                some = np.unique(at)
                d[some] -= shrink * self.weights[some]
                gw[some] += d[some] ** 2
                self.weights[some] += rate * d[some] / np.sqrt(gw[some])
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                dm = seen - pairs - shrink * self.moves
                gm += dm**2
                self.moves += rate * dm / np.sqrt(gm)
        return self

    def viterbi(self, x: list[np.ndarray]) -> list[int]:
        """The most probable labels."""
        best, back = [0.0, float(self.weights[x[0]].sum())], []
        (m00, m01), (m10, m11) = self.moves.tolist()
        for f in x[1:]:
            from0, from1 = (best[0] + m00, best[1] + m10), (best[0] + m01, best[1] + m11)
            back.append((int(from0[1] > from0[0]), int(from1[1] > from1[0])))
            best = [max(from0), float(self.weights[f].sum()) + max(from1)]
        labels = [int(best[1] > best[0])]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def main_text(html: str, chain: Chain) -> str:
    blocks = leaf_blocks(html)
    if not blocks:
        return ""
    labels = chain.viterbi(features(blocks))
    return "\n".join(b[0] for b, y in zip(blocks, labels, strict=True) if y)


def _variants(html: str, rng: np.random.Generator) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Training pages made of one labelled page."""
    blocks = leaf_blocks(html)
    labels = sure_labels(blocks) if blocks else None
    if labels is None or not any(labels):
        return
    yield features(blocks), labels
    # another container, and blocks of other kinds before, within or after the article
    sure = frozenset(_SURE)
    texts = [b[0] for b in blocks]
    container = _CONTAINERS[rng.integers(len(_CONTAINERS))]
    tags = leaf_blocks(f"{container}x</div>")[0]
    changed = [(t, tuple(a if a not in _SURE else tags[1][0] for a in anc), w | tags[2] if y else w, link) for (t, anc, w, link), y in zip(blocks, labels, strict=True)]
    y = list(labels)
    for _ in range(4):
        before, after = _EXTRA[rng.integers(len(_EXTRA))]
        extra = leaf_blocks(f"{before}{_plain(texts[rng.integers(len(texts))])}{after}")
        if not extra:
            continue
        first, last = y.index(1), len(y) - 1 - y[::-1].index(1)
        at = (first, last + 1, len(y))[rng.integers(3)]
        if rng.integers(3) == 0:  # inside the article's container
            at = int(rng.integers(first, last + 2))
            extra = [(t, (tags[1][0], *anc), w | tags[2], link) for t, anc, w, link in extra]
        changed[at:at] = extra
        y[at:at] = [0] * len(extra)
    yield features(changed, sure if container not in ("<main>",) else frozenset()), y


def _plain(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def fit(pages: DataFrame, seed: int = 11, fit_pages: int = FIT_PAGES) -> Chain:
    """Weights from at most ``fit_pages`` pages whose markup is sure."""
    sure = pages.where(F.col("html").rlike("(?i)<(?:article|main)[\\s>]")).select("html", F.xxhash64("html", F.lit(seed)).alias("h"))
    # of pages that repeat, one; at most fit_pages reach the driver
    picked = first_by_hash(sure, "h", fit_pages).groupBy("h").agg(F.min("html").alias("html")).collect()
    some = [r.html for r in sorted(picked, key=lambda r: r.h)]
    rng = np.random.default_rng(seed)
    made = [v for html in [*_EXAMPLES, *some] for _ in range(3) for v in _variants(html, rng)]
    return Chain().train(made, EPOCHS, seed)


def extract(pages: DataFrame, chain: Chain) -> DataFrame:
    """(page_id, url, text, n_chars) of (page_id, url, html)."""
    weights, moves = chain.weights, chain.moves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(weights, moves)
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h, model) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
