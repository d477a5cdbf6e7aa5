"""Main text of web pages: flat text blocks classified by a decision tree.

A page is scanned once into flat text blocks: block-level tags end a block,
inline tags do not. Each block carries shallow features: its words and link
density, those of the blocks before and after it and of those in the same
element, and weaker ones of the region it lies in (tags, and the part of the page
that class words mark). A decision tree, trained on a small labelled table, tells
content from the rest; where it finds none, the text outside all side regions is
content. The built-in labelled table is made from invented pages; a
caller may give labelled blocks of their own.

Defined results: a null or empty page has the empty text. Unclosed or stray
tags, comments and truncated markup are tolerated, in linear time. Character references are
decoded; white space inside a block becomes one space; blocks are trimmed and
joined in page order by one newline; empty blocks vanish. Repeated rows give
the same text; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import small_batches

#: Tags that end a text block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav noframes ol option optgroup p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags whose content is no text of the page.
SILENT_TAGS = frozenset("script style noscript template iframe object svg canvas audio video title textarea select option".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Regions by tag.
SIDE_TAGS = frozenset("nav footer aside form dialog menu button label fieldset".split())
MAIN_TAGS = frozenset("article main".split())
#: Elements that blocks stand in.
HOME_TAGS = frozenset("html body div section article main td aside nav footer header form fieldset center details dialog menu".split())
#: An opening tag of the key closes an open element of the values.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words in class, id or role that mark a region as no part of an article.
SIDE_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|"
    r"side-?bar|widget|related\w*|recommend\w*|more-?(?:links|stories)|share\w*|sharing|social|follow|subscri\w*|newsletter|sign-?up|log-?in|search\w*|"
    r"comments?|comment\w*|disqus|respond|reply|replies|footer\w*|foot|copyright|header|masthead|topbar|toolbar|pagination|pager|tags|toc|skip\w*|hidden|complementary|contentinfo|navigation|banner)(?![a-z])"
)
MAIN_WORDS = re.compile(r"(?:^|[^a-z])(?:article|post|entry|story|main|content|body|text)(?![a-z])|(?:article|post|entry|story|main)-?(?:body|content|text)")

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)", re.S)
_TAG_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I | re.S)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = (
    "words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density",
    "peer_words", "peer_link_density", "side_tag", "side_share", "main", "near_main", "heading", "has_main",
)


#: Words beyond which a block is simply long; peers together twice as many.
MANY_WORDS = 30


class Block:
    """A flat text block: its words, those in links, the element it stands in (home), and the region:
    side by tag, the element whose class marks a side region (0: none), main by tag, near a main class."""

    __slots__ = ("text", "words", "linked", "home", "side", "word", "main", "near", "heading")

    def __init__(self, text: str, words: int, linked: int, home: int, side: bool, word: int, main: bool, near: bool, heading: bool):
        self.text, self.words, self.linked, self.home = text, words, linked, home
        self.side, self.word, self.main, self.near, self.heading = side, word, main, near, heading


def _marks(attrs: str) -> tuple[bool, bool, bool]:
    """Whether attributes mark a side region, a main region, a hidden element."""
    side = main = hidden = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            hidden = True
        elif name in ("class", "id", "role"):
            side |= bool(SIDE_WORDS.search(value))
            main |= bool(MAIN_WORDS.search(value))
    return side, main and not side, hidden


class _Scanner:
    """The tags and texts of a page in one pass; a quote without its end is a character like any other."""

    def __init__(self, page: str):
        self.page, self.open = page, {'"': True, "'": True}

    def end_of_tag(self, at: int) -> int:
        """Where a tag's attributes end: before its ``>``, or at the end of the page."""
        page = self.page
        while m := _TAG_STOP.search(page, at):
            quote = m[0]
            if quote == ">":
                return m.start()
            close = page.find(quote, m.end()) if self.open[quote] else -1
            self.open[quote] = close >= 0
            at = close + 1 if close >= 0 else m.end()
        return len(page)


class _Region:
    """What an open element passes on to its content."""

    __slots__ = ("home", "side", "word", "main", "near", "hidden")

    def __init__(self, home: int = 0, side: bool = False, word: int = 0, main: bool = False, near: bool = False, hidden: bool = False):
        self.home, self.side, self.word, self.main, self.near, self.hidden = home, side, word, main, near, hidden


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order; linear in the page, whatever its markup."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, _Region]] = []
    places: dict[str, list[int]] = {}  # where each tag is open, and (under "") any tag that inline ones cannot close across
    outside = _Region()
    links = heading = elements = 0
    region = outside

    def end_block() -> None:
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(text, len(text.split()), len(entities.unescape(" ".join(linked)).split()), region.home, region.side, region.word, region.main, region.near, heading > 0))
        parts.clear()
        linked.clear()

    def say(raw: str) -> None:
        if raw and not region.hidden:
            parts.append(raw)
            if links:
                linked.append(raw)

    def close(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop()[0]
            places[tag].pop()
            if tag in BLOCK_TAGS or tag in SILENT_TAGS:
                places[""].pop()

    scan = _Scanner(page)
    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if m["cdata"] is not None:
            say(m["cdata"])
        if m["tag"] is None:
            continue
        stop = scan.end_of_tag(at)
        attrs, at = page[at:stop], stop + 1
        tag, closing = m["tag"].lower(), bool(m["end"])
        if tag in ("script", "style") and not closing:
            ended = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = ended.end() if ended else n
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK_TAGS:
            end_block()
        if tag == "a":
            links = 0 if closing else 1
        if re.fullmatch("h[1-6]", tag):
            heading = 0 if closing else 1
        wall = places.setdefault("", [])
        if closing:
            if places.get(tag) and (tag in BLOCK_TAGS or tag in SILENT_TAGS or not wall or wall[-1] < places[tag][-1]):
                close(places[tag][-1])
            region = stack[-1][1] if stack else outside
        elif tag not in VOID_TAGS:
            while stack and stack[-1][0] in CLOSES.get(tag, ()):
                close(len(stack) - 1)
            up = stack[-1][1] if stack else outside
            side, main, hidden = _marks(attrs) if "=" in attrs or "hidden" in attrs else (False, False, False)
            is_main, whole = tag in MAIN_TAGS, tag in ("html", "body")
            elements += 1
            region = _Region(
                # a block stands in the nearest element that is more than a paragraph, an item or a heading
                elements if tag in HOME_TAGS else up.home,
                up.side or (not whole and (tag in SIDE_TAGS or (tag == "header" and not up.main))),
                # an article within a marked region is told by its own marks
                0 if is_main else up.word or (elements if side and not whole else 0),
                up.main or is_main, up.near or main, up.hidden or hidden or tag in SILENT_TAGS,
            )
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK_TAGS or tag in SILENT_TAGS:
                wall.append(len(stack))
            stack.append((tag, region))
    end_block()
    return out


def features(found: Sequence[Block]) -> np.ndarray:
    """One row of FEATURES a block; neighbours beyond the page count 0.

    Peers are the blocks of the same element. side_share is the part of the page's words that the
    region marked by class words holds: a wrapper of the whole page has such words, too.
    """
    if not found:
        return np.zeros((0, len(FEATURES)))
    words, linked = (np.array(c, float) for c in zip(*((b.words, b.linked) for b in found), strict=True))
    density = linked / np.maximum(words, 1)
    before, after = (lambda x: np.r_[0.0, x[:-1]]), (lambda x: np.r_[x[1:], 0.0])
    _, home = np.unique([b.home for b in found], return_inverse=True)
    peers, peer_links = np.bincount(home, words)[home], np.bincount(home, linked)[home]
    mark = np.array([b.word for b in found])
    _, region = np.unique(mark, return_inverse=True)
    share = np.where(mark > 0, np.bincount(region, words)[region] / words.sum(), 0.0)
    flags = np.array([(b.main, b.near, b.heading) for b in found], float)
    side = np.array([b.side for b in found], float)
    has_main = np.full(len(found), float(any(b.main and not b.side and not b.word for b in found)))
    near = np.minimum(words, MANY_WORDS)
    return np.c_[near, density, before(near), before(density), after(near), after(density), np.minimum(peers, 2 * MANY_WORDS), peer_links / np.maximum(peers, 1), side, share, flags, has_main]


class Tree:
    """A binary decision tree grown by Gini gain; nodes are (feature, threshold, left, right, share)."""

    def __init__(self, depth: int = 10, leaf: int = 6):
        self.depth, self.leaf = depth, leaf
        self.nodes: list[tuple[int, float, int, int, float]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.nodes = []
        self._grow(x, y.astype(float), 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        share = float(y.mean()) if len(y) else 0.0
        self.nodes.append((-1, 0.0, -1, -1, share))
        best = (1e-12, -1, 0.0)
        if depth < self.depth and 0 < share < 1:
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, cum = x[order, f], np.cumsum(y[order])
                k = np.flatnonzero(v[1:] > v[:-1]) + 1
                k = k[(k >= self.leaf) & (len(y) - k >= self.leaf)]
                if len(k):
                    left, right = cum[k - 1], cum[-1] - cum[k - 1]
                    gain = left**2 / k + right**2 / (len(y) - k) - cum[-1] ** 2 / len(y)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), f, float((v[k[i] - 1] + v[k[i]]) / 2))
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            left, right = self._grow(x[low], y[low], depth + 1), self._grow(x[~low], y[~low], depth + 1)
            self.nodes[at] = (best[1], best[2], left, right, share)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo and self.nodes:
            at, rows = todo.pop()
            f, cut, left, right, share = self.nodes[at]
            if f < 0:
                out[rows] = share
            else:
                low = x[rows, f] <= cut
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


def labelled_pages(pages: int = 1500, seed: int = 3) -> list[tuple[str, set[str]]]:
    """The built-in labelled table: invented pages and the texts of their content blocks.

    Each page draws a layout, what that stands in, and short and long paragraphs, lists,
    quotes and tables; every other block is boilerplate, of any length, too. Without a marked
    region, content is what has long paragraphs in its element.
    """
    draw = random.Random(seed)
    sentence = "the quiet river runs below an old stone bridge where people meet on market days".split()
    numbers = iter(range(1 << 30))

    def say(n: int) -> str:  # a block's first word is its number, so that every block is its own text
        k = next(numbers)
        return " ".join([f"w{k}", *(sentence[(k + i) % len(sentence)] for i in range(n - 1))])

    some = lambda low, high: round(low * (high / low) ** draw.random())
    link = lambda low=1, high=6: f'<a href="/x">{say(some(low, high))}</a>'
    text = lambda: say(some(2, 150))
    side = {
        "nav": lambda: f"<nav><ul><li>{link()}</li><li>{link()}</li></ul></nav>",
        "menu": lambda: f'<div id="menu"><ul><li>{link()}<li>{link()}</ul></div>',
        "header": lambda: f"<header><h2>{say(some(1, 8))}</h2><p>{text()}</p></header>",
        "footer": lambda: f"<footer><p>&copy; {text()}</p><div>{link()}</div></footer>",
        "aside": lambda: f"<aside><h3>{say(3)}</h3><p>{text()}</p><p>{text()}</p></aside>",
        "ad": lambda: f'<div class="{draw.choice(("ad", "advert-box", "sponsored"))}">{text()}</div>',
        "cookie": lambda: f'<div class="cookie-notice"><p>{text()}</p><button>{say(some(1, 3))}</button></div>',
        "form": lambda: f"<form><label>{say(some(1, 6))}</label><p>{text()}</p></form>",
        "related": lambda: f'<div class="related"><p>{link(2, 15)}</p><p>{link(2, 15)} {text()}</p></div>',
        "comments": lambda: f'<section id="comments"><h3>{say(2)}</h3><div class="comment"><p>{text()}</p></div><div class="comment"><p>{text()}</p></div></section>',
        "share": lambda: f'<div class="share-bar">{link()} {link()}</div>',
        "bare note": lambda: f"<div>{say(some(2, 9))}</div><div><p>{say(some(2, 12))}</p></div>",
        "bare links": lambda: f"<div><p>{link()} | {link()} | {link()}</p></div>",
        "bare list": lambda: f"<div><ul><li>{link(1, 14)}</li><li>{link(1, 14)}</li><li>{link(1, 14)}</li></ul></div>",
        "bare teaser": lambda: f"<div><div>{link(4, 20)}</div><div>{say(some(1, 4))} {link(6, 20)}</div></div>",
    }
    inside = ("related", "comments", "share", "form", "aside", "ad", "bare list", "bare teaser", "bare links")
    layouts = ("<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", '<div class="post-content">{}</div>', '<div id="content">{}</div>', "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "{}")
    # what a layout may stand in; its class words say nothing of its content
    wrappers = ("{}", "{}", '<div class="layout has-sidebar">{}</div>', '<div id="page" class="with-header">{}</div>', '<section class="related-topics follow">{}</section>')
    out = []
    for _ in range(pages):
        layout, wanted, good = draw.choice(layouts), set(), []

        def put(markup: str, words: int, wanted: set = wanted, good: list = good) -> None:
            block = say(words)
            wanted.add(block)
            good.append(markup.format(block))

        plain = layout in layouts[-3:]
        put("<h1>{}</h1>", some(1, 12))
        for _ in range(draw.randint(1, 8)):
            put("<p>{}</p>", some(1, 200))
            if draw.random() < 0.2:
                words, more = say(some(20, 60)), next(numbers)
                wanted.add(f"{words} w{more} stone bridge")
                good.append(f'<p>{words} <a href="/x">w{more} stone bridge</a></p>')  # a paragraph with a link
        if draw.random() < 0.25:  # a paragraph with links all over
            parts = [(say(some(3, 30)), say(some(1, 6))) for _ in range(draw.randint(2, 4))]
            wanted.add(" ".join(f"{a} {b}" for a, b in parts))
            good.append("<p>" + " ".join(f'{a} <a href="/x">{b}</a>' for a, b in parts) + "</p>")
        if draw.random() < 0.2 and not plain:  # a paragraph that is a link, and references, in the article itself
            put('<p><a href="/x">{}</a></p>', some(2, 20))
        if draw.random() < 0.2 and not plain:
            good.append("<ul>")
            for _ in range(draw.randint(1, 5)):
                put('<li><a href="/x">{}</a></li>', some(1, 12))
            good.append("</ul>")
        if plain:
            for n in (some(25, 80), some(25, 80), some(1, 9)):
                put("<p>{}</p>", n)
        if draw.random() < 0.3:
            put("<ul><li>{}</li></ul>", some(2, 9))
            put("<blockquote>{}</blockquote>", some(6, 40))
        if draw.random() < 0.2 and not plain:
            put("<table><tr><td>{}</td></tr></table>", some(1, 4))
        if not plain:
            good += [side[draw.choice(inside)]() for _ in range(draw.randint(0, 2))]
        before, after = ("".join(side[draw.choice(list(side))]() for _ in range(draw.randint(0, 3))) for _ in range(2))
        whole = draw.choice(wrappers).format(layout.format("".join(good)))
        out.append((f"<html><head><title>{say(4)}</title></head><body>{before}{whole}{after}</body></html>", wanted))
    return out


def train(labelled: Sequence[tuple[str, set[str]]] | None = None) -> Tree:
    """A tree from labelled pages: (markup, texts of the blocks that are content)."""
    xs, ys = [], []
    for page, wanted in labelled_pages() if labelled is None else labelled:
        found = blocks(page)
        xs.append(features(found))
        ys.append(np.array([b.text in wanted for b in found], bool))
    return Tree().fit(np.concatenate(xs), np.concatenate(ys)) if xs else Tree()


def unmarked(found: Sequence[Block]) -> np.ndarray:
    """The blocks outside all side regions: those of a main region if it has any, else those that are not links alone."""
    free = np.array([not b.side and not b.word for b in found], bool)
    inside = free & np.array([b.main for b in found], bool)
    return inside if inside.any() else free & np.array([b.linked < b.words for b in found], bool)


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    keep = tree.predict(features(found)) >= 0.5
    if not keep.any():
        keep = unmarked(found)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, tree: Tree | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of each row."""
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tree or train())
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, shared.value) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string")
