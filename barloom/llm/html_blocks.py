"""Main text of web pages: flat text blocks, described by word count and link density of themselves and their neighbours,
classified by decision trees that are trained on a small labelled table of pages. What a block stands in is known to the trees
as further features. There are two: one for pages that mark their article, one for all others. In the labelled pages of the first
the same kinds of blocks stand inside and outside the article, so it learns from the marks and not from what articles often look like.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unpacked

MARKUP = (
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)"
    r"|[^<]+|<"
)
COMMENT = r"<!--.*?(?:-->|\Z)"
#: Only raw text runs to the end of the page where nothing closes it. Within svg nothing is raw text.
TOKEN = re.compile(rf"{COMMENT}|<(script|style|title|textarea)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|{MARKUP}", re.DOTALL | re.IGNORECASE)
SVG_TOKEN = re.compile(rf"{COMMENT}|((?!))|{MARKUP}", re.DOTALL | re.IGNORECASE)
#: Elements whose text is none of the page's.
DROPPED = frozenset("noscript template iframe svg select button canvas object".split())
#: Start tags that end an svg, as in the HTML standard.
LEAVES_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold others; the rest don't count as context.
HOLDS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
OFF = frozenset("aside dialog fieldset footer form menu nav".split())
#: Class and id names of what is none of the text: as a whole or as a name's last part, and as its first part.
OFF_LAST = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form login masthead menu modal nav navbar navigation newsletter notice notification alert pagination pager popup promo promoted related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split())
OFF_FIRST = frozenset("ad ads advert breadcrumb breadcrumbs comment comments footer menu nav navbar navigation newsletter pagination sidebar".split())
PARTS = re.compile(r"[a-zA-Z0-9]+")
HEADER_NAME = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.IGNORECASE)
OFF_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu toolbar".split())
ON_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body-?text|content|entry|main|post|story)(?:$|[\s_-])", re.IGNORECASE)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.IGNORECASE)

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "off", "on", "outside", "off_somewhere")
#: What may follow the first part of a name in OFF_FIRST: ad-slot is an advert, ad-hoc-query is none.
CONTAINERS = frozenset("area bar block body bottom box center col column container content desktop footer form group header holder horizontal inner item items layer left link links list main mobile nav outer panel primary right row secondary section side slot space thread title top unit vertical view widget wrap wrapper zone".split())


def _off_name(names: str) -> bool:
    for name in names.lower().split():
        parts = PARTS.findall(name)
        if not parts or "and" in parts:
            continue
        if parts[-1] in OFF_LAST or parts[0] in OFF_FIRST and all(p in CONTAINERS or p in OFF_FIRST or p.isdigit() for p in parts[1:]):
            return True
    return False


def _kind(tag: str, attributes: str) -> str:
    """'off', 'on', 'header' or '' for an element that holds others."""
    names, role = "", ""
    for m in ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            names += " " + value
        elif key == "role":
            role = value.lower()
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return "off"
    if tag in OFF or role in OFF_ROLE or tag not in ("body", "html", "article", "main") and _off_name(names):
        return "off"
    if tag == "header" or names and HEADER_NAME.search(names):
        return "header"
    return "on" if tag in ("article", "main") or role in ("main", "article") or names and ON_NAME.search(names) else ""


def blocks_of(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, characters, characters in links, off, on, heading) of each text block, in page order."""
    out: list = []
    parts: list[str] = []
    linked, in_link, heading = 0, 0, False
    stack: list[tuple[str, str]] = []
    places: dict[str, list[int]] = defaultdict(list)  # by tag: where it stands in the stack
    kinds: Counter = Counter()  # of what is open

    def close() -> None:
        nonlocal linked, parts
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            on = kinds["on"] > 0
            off = kinds["off"] > 0 or kinds["header"] > 0 and not (on and heading)
            out.append((text, len(text), min(linked, len(text)), off, on, heading))
        parts, linked = [], 0

    def push(tag: str, kind: str = "") -> None:
        places[tag].append(len(stack))
        stack.append((tag, kind))
        kinds[kind] += 1

    dropping: list[list] = []  # [depth of the stack, tag, whether its close is ahead, open blocks within] of dropped elements
    last: dict[str, int] = {}  # by dropped element: where its last close stands

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            tag, kind = stack.pop()
            places[tag].pop()
            kinds[kind] -= 1
        while dropping and dropping[-1][0] >= depth:
            dropping.pop()

    at = 0
    while at < len(page):
        m = (SVG_TOKEN if dropping and dropping[-1][1] == "svg" else TOKEN).match(page, at)
        at, tag = m.end(), m[3]
        if tag is None:
            if not dropping and (m[1] is None and not m[0].startswith("<") or m[0] == "<"):
                parts.append(m[0])
                if in_link:
                    linked += len(" ".join(html.unescape(m[0]).split()))
            continue
        tag, ends = tag.lower(), bool(m[2])
        if dropping and not ends:
            depth, own, closed, _ = dropping[-1]
            if own == "svg" and tag in LEAVES_SVG or own == tag in ("button", "select") or not closed and tag in BLOCK:
                pop_to(depth)
        elif dropping and tag in BLOCK and tag not in HOLDS:
            # a close that nothing within the dropped element opened is that of an element around it
            while dropping and not dropping[-1][3].get(tag):
                pop_to(dropping[-1][0])
            if dropping and dropping[-1][3].get(tag):
                dropping[-1][3][tag] -= 1
        if tag in DROPPED or dropping and tag == "foreignobject":
            if ends:
                if places[tag]:
                    pop_to(places[tag][-1])
            elif not (m[4].endswith("/") and (tag in ("svg", "foreignobject") or dropping and dropping[-1][1] == "svg")):
                if tag not in last:
                    last[tag] = max((c.start() for c in re.finditer(rf"</{tag}(?=[\s/>])", page, re.IGNORECASE)), default=-1)
                dropping.append([len(stack), tag, last[tag] >= at, {}])
                push(tag)
            continue
        if dropping:
            if tag in HOLDS:
                if not ends:
                    push(tag)
                    continue
                if not places[tag]:
                    continue
                inside = places[tag][-1] > dropping[-1][0]
                if inside or len(dropping) > 1 and places[tag][-1] > dropping[0][0]:
                    pop_to(places[tag][-1])
                    continue
                pop_to(dropping[0][0])
            else:
                if tag in BLOCK and not ends:
                    dropping[-1][3][tag] = dropping[-1][3].get(tag, 0) + 1
                continue
        if tag == "a":
            in_link = 0 if ends else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            close()
            in_link = 0
            heading = not ends and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            if tag in HOLDS:
                if not ends:
                    push(tag, _kind(tag, m[4]))
                elif places[tag]:
                    pop_to(places[tag][-1])
    close()
    return out


def features(blocks: list) -> np.ndarray:
    n = len(blocks)
    x = np.zeros((n, len(FEATURES)))
    x[:, 0] = [len(b[0].split()) for b in blocks]
    x[:, 1] = [b[2] / b[1] for b in blocks]
    x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
    off, on = np.array([b[3] for b in blocks]), np.array([b[4] for b in blocks])
    x[:, 6], x[:, 7], x[:, 8] = [b[5] for b in blocks], off, on
    x[:, 9] = (on & ~off).any() & ~on  # the page marks its article elsewhere
    x[:, 10] = off.any()
    return x


def marked(blocks: list) -> bool:
    """Whether the page marks an article that has text."""
    return any(b[4] and not b[3] for b in blocks)


class _Page:
    """Writes labelled pages of drawn sizes: text blocks of the article begin with a mark, others don't."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def one(self, *of):
        return of[self.rng.integers(len(of))]

    def some(self, *of: str) -> str:
        """A drawn half of the given parts, in their order."""
        return "".join(x for x in of if self.rng.random() < 0.5)

    def w(self, low: int, high: int) -> str:
        return " ".join(["word"] * int(self.rng.integers(low, high + 1)))

    def size(self) -> str:
        return self.w(*self.one((1, 8), (8, 40), (8, 40), (40, 200)))

    def a(self, most: int = 3, tag: str = "li", mark: str = "") -> str:
        """A list of links."""
        return "".join(f"<{tag}><a href=x>{mark}{self.w(1, most)}</a></{tag}>" for _ in range(self.rng.integers(2, 8)))

    def any(self, mark: str, n: int = 0) -> str:
        """n blocks of all kinds, 1 to 10 if 0, each of which may stand in an article or out of it."""
        out = ""
        for _ in range(n or self.rng.integers(1, 11)):
            h = self.one("h1", "h2", "h3")
            out += self.one(
                f"<p>{mark}{self.size()}</p>", f"<p>{mark}{self.size()}</p>", f"<p>{mark}{self.w(1, 9)}</p>", f"<{h}>{mark}{self.w(1, 14)}</{h}>", f"<{h}><a href=x>{mark}{self.w(1, 12)}</a></{h}>",
                f"<ul>{self.a(6, 'li', mark)}</ul>", f"<p><a href=x>{mark}{self.w(1, 25)}</a></p>", f"<p>{mark}{self.w(2, 12)} <a href=x>{self.w(2, 20)}</a></p>", f"<div>{self.a(3, 'span', mark)}</div>",
                f"<ul><li>{mark}{self.w(1, 9)}</li><li>{mark}{self.w(1, 30)}</li></ul>", f"<table><tr><td>{mark}{self.w(1, 4)}</td><td>{mark}{self.w(1, 4)}</td></tr></table>", f"<blockquote>{mark}{self.size()}</blockquote>",
            )
        return out

    def text(self, n: int = 0) -> str:
        """n blocks of an article on a page that marks nothing, 2 to 12 if 0: paragraphs, a quarter of them short, and now and then a heading or a linked line among them."""
        out = ""
        for _ in range(n or self.rng.integers(2, 13)):
            out += self.one(*(f"<p>\u00a7{self.size()}</p>",) * 6, f"<h2>\u00a7{self.w(2, 12)}</h2><p>\u00a7{self.w(20, 120)}</p>", f"<h2><a href=x>\u00a7{self.w(2, 12)}</a></h2><p>\u00a7{self.w(20, 120)}</p>", f"<p>\u00a7{self.w(20, 60)}</p><p><a href=x>\u00a7{self.w(4, 20)}</a></p><p>\u00a7{self.w(20, 60)}</p>")
        return out


#: Names of an article's element and of what is none of it, as pages have them.
ON_TAGS = ("article", "main", "div class=content", "div role=main", "div class=post", "div class=entry-content", "section id=main")
OFF_TAGS = ("nav", "aside", "footer", "form", "div class=ad", "div class=sidebar", "div class=related", "section class=comments", "div class=share", "div class=newsletter", "div id=cookie-notice", "div class=menu")


def _in(tag: str, inner: str) -> str:
    return f"<{tag}>{inner}</{tag.split()[0]}>"


def marked_page(p: _Page) -> str:
    """A page that marks its article: any blocks inside, any in what is off, and any outside; each of these but the article may be missing."""
    off = lambda: _in(p.one(*OFF_TAGS), p.any("", p.one(1, 2, 4)))
    head = p.one("", "", f"<header>{p.any('', 1)}</header>")
    inner = p.some(f"<h1>\u00a7{p.w(1, 14)}</h1>") + p.any("\u00a7") + p.some(off()) + p.some(p.any("\u00a7"))
    return head + p.some(off(), p.any("", p.one(1, 3)), off()) + _in(p.one(*ON_TAGS), inner + p.some(off())) + p.some(off(), p.any("", p.one(1, 3)), off())


def plain_pages(p: _Page) -> list[str]:
    """Pages that mark no article: their menus, adverts and footers are named, or nothing is."""
    heading = f"<h1>\u00a7{p.w(2, 14)}</h1>"
    named = p.some(f"<nav><ul>{p.a()}</ul></nav>", f"<header><p>{p.w(1, 8)}</p></header>") + heading + p.text() + p.some(f"<aside>{p.w(10, 60)}</aside>", f"<footer>{p.w(3, 24)}</footer>", f"<footer>{p.a(2, 'span')}</footer>")
    return [
        named, named, f"<nav>{p.a()}</nav>{heading}{p.text()}", f"<div id=cookie-notice>{p.w(10, 60)}</div>{heading}{p.text()}<div id=footer><p>{p.w(3, 24)}</p></div>",
        f"<ul>{p.a()}</ul><div>{p.w(4, 18)}</div>{heading}{p.text()}<div>{p.w(3, 24)}</div>", f"<ul>{p.a()}</ul>{heading}{p.text(2)}<div>{p.w(3, 20)}</div>",
        f"<div>{p.a(3, 'span')}</div><div>{p.text()}<p>\u00a7{p.w(30, 90)}</p></div><p>{p.w(3, 8)}</p><p>{p.w(2, 6)}</p>", f"<div>{p.a(3, 'p')}</div>{heading}{p.text()}<p>\u00a7{p.w(30, 90)}</p>{p.a(6, 'p')}<p>{p.w(2, 8)}</p>",
        f"{heading}{p.text()}", f"{heading}{p.text()}<ul><li>\u00a7{p.w(2, 9)}</li><li>\u00a7{p.w(2, 9)}</li></ul>{p.text(2)}", f"<ul>{p.a()}</ul>{heading}{p.text()}", f"{p.text(2)}",
        f"<p>\u00a7{p.w(1, 12)}</p>", f"<p>\u00a7{p.w(8, 90)}</p>", f"<p>\u00a7{p.w(2, 30)}</p><p>\u00a7{p.w(2, 30)}</p>", f"<ul>{p.a(4)}</ul>", f"<div>{p.a(3, 'span')}</div>",
    ]


def labelled_tables(draws: int = 12) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The labelled pages' blocks as rows of features and labels: pages that mark their article, and others."""
    out = []
    for marks in (True, False):
        xs, ys = [], []
        for seed in range(draws):
            p = _Page(seed)
            for page in [marked_page(p) for _ in range(16)] if marks else plain_pages(p):
                blocks = blocks_of(page)
                if blocks and marked(blocks) == marks:
                    xs.append(features(blocks))
                    ys.append(np.array([b[0].startswith("\u00a7") for b in blocks]))
        out.append((np.concatenate(xs), np.concatenate(ys)))
    return tuple(out)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 8) -> tuple | bool:
    """A decision tree by Gini impurity: (feature, threshold, tree for values up to it, tree for values above), or a label; at least `least` rows on either side."""
    if depth == 0 or y.all() or not y.any():
        return bool(2 * y.sum() > len(y))
    best, n = None, len(y)
    for j in (8, 7, 9, 10, 1, 0, 5, 3, 4, 2, 6):  # of equal splits the first holds: context, then the block's own features, then its neighbours'
        order = np.argsort(x[:, j], kind="stable")
        v, hits = x[order, j], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])  # a split after each of these rows
        at = at[(at + 1 >= least) & (n - at - 1 >= least)]
        if not len(at):
            continue
        low, below = at + 1.0, hits[at].astype(float)
        above = hits[-1] - below
        cost = below * (1 - below / low) + above * (1 - above / (n - low))
        k = int(np.argmin(cost))
        if best is None or cost[k] < best[0] - 1e-9:
            best = (cost[k], j, (v[at[k]] + v[at[k] + 1]) / 2)
    if best is None:
        return bool(2 * y.sum() > len(y))
    _, j, t = best
    low = x[:, j] <= t
    return (j, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def trained() -> tuple:
    """The two trees: for pages that mark their article, and for others."""
    return tuple(grow(x, y) for x, y in labelled_tables())


def classify(tree, row: np.ndarray) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, trees: tuple) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    tree = trees[0] if marked(blocks) else trees[1]
    return "\n".join(b[0] for b, row in zip(blocks, features(blocks), strict=True) if classify(tree, row))


def _extract(trees: tuple):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, trees) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["row", "text", "n_chars"])

    return extract


def extract_text(pages: DataFrame) -> DataFrame:
    """pages with text (main text; empty if none) and n_chars (its code points) in place of html.

    Null and empty html give an empty text. Character references are decoded, white space in a block becomes one space, and
    blocks are joined by a line feed in page order. Unclosed elements end with what holds them; text within
    DROPPED elements is left out, and one that the page never closes ends at the next block. Repeated rows are answered
    alike. Columns with the names of the results, in whatever case, are replaced. An empty table gives an empty result.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]
    rows = pages.select(F.struct(*kept).alias("row"), F.col("html").alias("html"))
    return unpacked(rows.mapInArrow(_extract(trained()), rows.drop("html").schema.add("text", "string").add("n_chars", "long")), "text", "n_chars")
