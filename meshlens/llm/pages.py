"""Main text of web pages from flat text blocks and a decision tree.

A page is read into a flat list of text blocks. Each block has its number of words, its link
density, those of the blocks before and after it, and what markup it stands in. A decision tree
fitted on the small labelled table below tells main text from the rest.

Class, id and role names mark a part as no main text where a whole name says so (``comments``,
``cookie-notice``, ``sidebar-left``, but not ``has-sidebar`` or ``related-work``), unless the part is
the wrapper of the page: it holds a main element or all articles, or, on a page without both, a first
heading and most of the words.

Character references are decoded, white space inside a block becomes one space, blocks are joined
in page order by one space; nothing else is dropped or cut. NULL counts as the empty page; a page
without main text gives the empty text. Rows are neither dropped nor merged; a column named like
the result is replaced.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meshlens.llm.common import add_columns

DEPTH = 6
#: Elements that begin and end a block; all others stand inside one.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main"
    " menu nav noscript object ol optgroup option p pre search section select summary table tbody td"
    " textarea tfoot th thead title tr ul".split()
)
#: Elements whose text is never shown or is data.
HIDDEN = frozenset("script style template title noscript iframe object svg annotation annotation-xml textarea select head".split())
#: Their content is read up to the matching end tag, whatever it looks like.
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("nav footer aside menu button search".split())
#: As the names below: apart, unless they are the wrapper of the page.
MARKED = frozenset("form dialog fieldset".split())
TOPS = frozenset(("main", "article"))
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
SAME_CLOSES = {"li": "ul ol menu", "dd": "dl", "dt": "dl", "td": "tr table", "th": "tr table", "tr": "table", "option": "select"}
#: Words of class, id and role names that mark what is not main text.
HINT = re.compile(
    r"ads?|adverts?|advert\w*|banner|breadcrumbs?|comments?|respond|reply|replies|cookies?|consent|gdpr|"
    r"copyright|disclaimer|disqus|footer|form|header|legal|login|masthead|menu|modal|nav\w*|newsletter|notice|notices|"
    r"notification|pager|pagination|popup|promo\w*|recommend\w*|related|search|share|sharing|sidebar|side|skip|social|"
    r"sponsor\w*|subscribe|subscription|tags|teaser|toolbar|topbar|warning|alert|widget",
    re.I,
)
#: Words that may stand before and behind them in one name.
BEFORE = frozenset("site main primary secondary global top bottom left right mobile desktop".split())
BEHIND = BEFORE | frozenset(
    "list item items box bar block section area container wrapper wrap inner outer content link links post posts article articles"
    " story stories button buttons icon icons title slot unit policy message panel group row column".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<[!?/][^>]*(?:>|$)", re.S)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SHOWN_NOT = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


@functools.lru_cache(maxsize=4096)
def hints(named: str) -> frozenset[str]:
    """The words that mark what is not main text, of names that are made of such words as a whole."""
    out: set[str] = set()
    for name in named.lower().split():
        words = [w for w in re.split("[-_]+", name) if w]
        at = [k for k, w in enumerate(words) if HINT.fullmatch(w)]
        if at and BEFORE.issuperset(words[: at[0]]) and all(k in at or w in BEHIND or w.isdigit() for k, w in enumerate(words[at[0] :], at[0])):
            out.update(words[k] for k in at)
    return frozenset(out)


class Part:
    """A marked part of a page: what it holds tells whether it is the wrapper of all.

    Counts are those of the page when the part begins, and the difference once it has ended.
    """

    __slots__ = ("tops", "mains", "heads", "words", "outer", "ended", "apart")

    def __init__(self, page: Part | None = None, outer: Part | None = None) -> None:
        self.tops, self.mains, self.heads, self.words = (page.tops, page.mains, page.heads, page.words) if page else (0, 0, 0, 0)
        self.outer, self.ended, self.apart = outer, False, False

    def end(self, page: Part) -> None:
        if not self.ended:
            self.tops, self.mains = page.tops - self.tops, page.mains - self.mains
            self.heads, self.words = page.heads - self.heads, page.words - self.words
            self.ended = True

    def wraps(self, page: Part) -> bool:
        if page.mains:
            return self.mains > 0
        return self.tops == page.tops if page.tops else self.heads > 0 and 2 * self.words > page.words


class Block:
    __slots__ = ("text", "words", "links", "apart", "inside", "heading", "item", "part")

    def __init__(self, parts: list[tuple[str, bool]], apart: bool, inside: bool, heading: bool, item: bool, part: Part | None):
        self.text = " ".join("".join(t for t, _ in parts).split())
        self.words = len(self.text.split())
        self.links = len("".join(t if linked else " " for t, linked in parts).split())
        self.apart, self.inside, self.heading, self.item, self.part = apart, inside, heading, item, part


class Stack:
    """The open elements of a page. What is asked of them is counted as they come and go, however deep they lie."""

    def __init__(self) -> None:
        #: Element, is it apart, is it hidden, its marked part.
        self.open: list[tuple[str, bool, bool, Part | None]] = []
        self.at: dict[str, list[int]] = {}  # places of the open elements of a name
        self.blocks: list[int] = []
        self.closing: list[int] = []  # places of paragraphs and headings
        self.marked: list[Part] = []
        self.apart = self.hidden = 0

    def push(self, name: str, apart: bool, hidden: bool, part: Part | None) -> None:
        place = len(self.open)
        self.at.setdefault(name, []).append(place)
        if name in BLOCKS:
            self.blocks.append(place)
        if name in CLOSED_BY_BLOCK:
            self.closing.append(place)
        if part:
            self.marked.append(part)
        self.apart += apart
        self.hidden += hidden
        self.open.append((name, apart, hidden, part))

    def cut(self, place: int, page: Part) -> None:
        """Close the elements from a place on."""
        for name, apart, hidden, part in reversed(self.open[place:]):
            self.at[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            if name in CLOSED_BY_BLOCK:
                self.closing.pop()
            if part:
                self.marked.pop().end(page)
            self.apart -= apart
            self.hidden -= hidden
        del self.open[place:]

    def last(self, *names: str) -> int:
        """Place of the innermost open element of some names; -1 without one."""
        return max((places[-1] for n in names if (places := self.at.get(n))), default=-1)

    def first(self, name: str) -> int | None:
        places = self.at.get(name)
        return places[0] if places else None

    def top(self) -> int | None:
        """Place of the outermost article, or else of the outermost main element."""
        article = self.first("article")
        return self.first("main") if article is None else article


def blocks(page: str | None) -> list[Block]:
    """The shown text blocks of a page, in order."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack, whole_page = Stack(), Part()
    marked: list[Part] = []

    def flush() -> None:
        if any(not t.isspace() for t, _ in parts):
            top, header = stack.top(), stack.first("header")
            apart = stack.apart > 0 or header is not None and (top is None or header < top)
            heading = any(stack.at.get(n) for n in CLOSED_BY_BLOCK if n != "p")
            part = stack.marked[-1] if stack.marked else None
            out.append(Block(parts, apart, top is not None, heading, bool(stack.at.get("li")), part))
            whole_page.words += out[-1].words
        parts.clear()

    def say(text: str) -> None:
        if text and not stack.hidden:
            parts.append((html.unescape(text), bool(stack.at.get("a"))))

    def close(name: str) -> None:
        place = stack.last(name)
        if place >= 0:
            if stack.blocks and stack.blocks[-1] >= place:
                flush()
            stack.cut(place, whole_page)

    page = page or ""
    at = 0
    while at < len(page):
        tag = _TOKEN.search(page, at)
        if not tag:
            say(page[at:])
            break
        say(page[at : tag.start()])
        at = tag.end()
        if tag[1] is not None:
            say(tag[1])
        if not tag[3]:
            continue
        name = tag[3].lower()
        if tag[2]:
            if name in BLOCKS:
                flush()
            close(name)
            continue
        if name in BLOCKS:
            flush()
            if stack.closing and stack.blocks[-1] == stack.closing[-1]:
                stack.cut(stack.closing[-1], whole_page)
            if name in SAME_CLOSES:
                same = next((pair for pair in (("dd", "dt"), ("td", "th")) if name in pair), (name,))
                place = stack.last(*same)
                if place > stack.last(*SAME_CLOSES[name].split()):
                    stack.cut(place, whole_page)
        if name == "br":
            say(" ")
        if name in VOID or tag[4].endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        named = hints(" ".join(a or b or c for a, b, c in _NAMES.findall(tag[4])))
        within = stack.top() is not None
        if not stack.hidden:
            whole_page.tops += name in TOPS and not within
            whole_page.mains += name == "main"
            whole_page.heads += name == "h1"
        whole = name in ("body", "html", "article", "main") or named == {"header"} and within
        part = None
        if name in MARKED or named and not whole:
            part = Part(whole_page, stack.marked[-1] if stack.marked else None)
            marked.append(part)
        stack.push(name, name in APART, name in HIDDEN or bool(_SHOWN_NOT.search(tag[4])), part)
    flush()
    stack.cut(0, whole_page)
    for part in marked:  # outer parts come first
        part.apart = not part.wraps(whole_page) or part.outer is not None and part.outer.apart
    for block in out:
        block.apart = block.apart or block.part is not None and block.part.apart
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row for each block: words and link density of itself and its neighbours, and its place."""
    words = [0, *(b.words for b in found), 0]
    density = [0.0, *(b.links / max(1, b.words) for b in found), 0.0]
    has_main = any(b.inside for b in found)
    rows = []
    for i, b in enumerate(found, 1):
        rows.append(
            (words[i - 1], words[i], words[i + 1], density[i - 1], density[i], density[i + 1], b.apart, b.inside, has_main, b.heading, b.item)
        )
    return np.array(rows, dtype=float).reshape(len(rows), 11)


def tree(rows: np.ndarray, main: np.ndarray, depth: int = DEPTH):
    """A decision tree: a share of main text, or (feature, bound, tree up to it, tree above it)."""
    share = float(main.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for k in range(rows.shape[1]):
        values = np.unique(rows[:, k])
        for bound in (values[:-1] + values[1:]) / 2:
            low = rows[:, k] <= bound
            impurity = sum(m.sum() * (len(m) - m.sum()) / len(m) for m in (main[low], main[~low]))
            if best is None or impurity < best[0] - 1e-9:
                best = (impurity, k, float(bound), low)
    if best is None:
        return share
    _, k, bound, low = best
    return k, bound, tree(rows[low], main[low], depth - 1), tree(rows[~low], main[~low], depth - 1)


def is_main(row: np.ndarray, node) -> bool:
    while isinstance(node, tuple):
        k, bound, low, high = node
        node = low if row[k] <= bound else high
    return node >= 0.5


def _prose(n: int, mark: str = "") -> str:
    return " ".join(f"{mark}word{i}" for i in range(n))


def _links(n: int, each: int = 1) -> str:
    return "".join(f'<li><a href="/{i}">{_prose(each)}</a></li>' for i in range(n))


def _own_links(n: int, each: int) -> str:
    return "".join(f'<li><a href="/{i}">main:{_prose(each)}</a></li>' for i in range(n))


#: The labelled table: pages whose main blocks begin with "main:" (the mark is cut off).
LABELLED = [
    f"<body><nav><ul>{_links(5)}</ul></nav><div class='ad'>{_prose(9)}</div><article><h1>main:{_prose(6)}</h1>"
    f"<p>main:{_prose(60)}</p><p>main:{_prose(3)}</p><p>main:{_prose(25)}</p></article><footer>{_prose(8)}</footer></body>",
    f"<header><h1>{_prose(3)}</h1><p>{_prose(7)}</p></header><main><h2>main:{_prose(5)}</h2><p>main:{_prose(40)}</p><ul><li>main:{_prose(8)}</li>"
    f"<li>main:{_prose(12)}</li></ul><p>main:{_prose(30)} <a>{_prose(3)}</a></p></main><aside>{_prose(30)}</aside><footer>{_prose(20)}</footer>",
    f"<div class='menu'>{_links(4)}</div><div id='content'><h1>main:{_prose(7)}</h1><p>main:{_prose(50)}</p><p>main:{_prose(2)}</p><p>main:{_prose(70)}</p>"
    f"<blockquote>main:{_prose(15)}</blockquote></div><div id='comments'><p>{_prose(25)}</p><p>{_prose(40)}</p></div><div class='footer'>{_prose(5)}</div>",
    f"<div>{_links(6, 2)}</div><div><h1>main:{_prose(8)}</h1><p>main:{_prose(45)}</p><p>main:{_prose(33)} <a>{_prose(2)}</a> {_prose(9)}</p></div>"
    f"<ul>{_links(8, 4)}</ul><p><a>{_prose(3)}</a> <a>{_prose(2)}</a></p>",
    f"<div class='cookie-notice'><p>{_prose(28)}</p></div><article><header><h1>main:{_prose(5)}</h1></header><p>main:{_prose(4)}</p><p>main:{_prose(55)}</p>"
    f"<form><label>{_prose(2)}</label></form><p>main:{_prose(18)}</p><div class='related'><h3>{_prose(2)}</h3><ul>{_links(4, 6)}</ul></div></article>"
    f"<section class='comments'><h2>{_prose(2)}</h2><p>{_prose(35)}</p></section>",
    f"<article><p>main:{_prose(1)}</p></article><footer><p>{_prose(12)} <a>{_prose(1)}</a></p></footer>",
    f"<article><h1>main:{_prose(4)}</h1><ul><li><a>main:{_prose(3)}</a></li></ul><p>main:{_prose(80)}</p><table><tr><td>main:{_prose(2)}</td>"
    f"<td>main:{_prose(1)}</td></tr></table></article><nav>{_links(3)}</nav>",
    f"<p>main:{_prose(30)}</p><p>main:{_prose(12)}</p><p>main:{_prose(5)}</p>",
    f"<div class='banner'>{_prose(60)}</div><p>main:{_prose(44)}</p><div class='newsletter'><form><p>{_prose(14)}</p><button>{_prose(1)}</button></form></div><p>main:{_prose(20)}</p>",
    f"<div class='layout has-sidebar'><form id='form'><main><h1>main:{_prose(4)}</h1><p>main:{_prose(30)}</p><section id='related-work'><p>main:{_prose(20)}</p></section>"
    f"<section aria-label='Side effects'><p>main:{_prose(22)}</p></section><div class='share'><p>{_prose(9)}</p></div></main></form><div class='sidebar-left'>{_prose(40)}</div></div>",
    f"<div class='widget'><h1>main:{_prose(5)}</h1><p>main:{_prose(48)}</p><p>main:{_prose(31)}</p><div class='comments-list'><p>{_prose(26)}</p></div></div><div class='sidebar'><p>{_prose(21)}</p></div>",
    f"<main><nav>{_links(3, 2)}</nav><section><h2>main:{_prose(3)}</h2><p>main:{_prose(9)}</p></section><aside><p>{_prose(50)}</p></aside></main>",
    # Linked text that belongs to the article: paragraphs, lists, cells.
    f"<article><h1>main:{_prose(5)}</h1><p>main:{_prose(1)} <a>{_prose(26)}</a></p><p>main:{_prose(12)}</p><ul>{_own_links(4, 5)}</ul><p>main:{_prose(40)}</p></article>",
    f"<main><h1>main:{_prose(3)}</h1><table><tr><td><a>main:{_prose(4)}</a></td><td><a>main:{_prose(2)}</a></td><td>main:{_prose(3)}</td></tr></table>"
    f"<p><a>main:{_prose(9)}</a></p></main><footer><a>{_prose(2)}</a> <a>{_prose(2)}</a></footer>",
    f"<article><p><a>main:{_prose(14)}</a></p></article><div>{_prose(2)} <a>{_prose(3)}</a></div>",
    # Pages without any name: size and links tell, of a block and of its neighbours.
    f"<div><a>{_prose(2)}</a> <a>{_prose(1)}</a> <a>{_prose(3)}</a></div><div><a>{_prose(2)}</a></div><h1>main:{_prose(6)}</h1><p>main:{_prose(52)}</p>"
    f"<p>main:{_prose(20)} <a>{_prose(12)}</a></p><p>main:{_prose(61)}</p><div><a>{_prose(4)}</a></div><div><a>{_prose(5)}</a></div><div>{_prose(2)} <a>{_prose(4)}</a></div>",
    f"<table><tr><td><a>{_prose(1)}</a></td><td><a>{_prose(1)}</a></td></tr></table><div>main:{_prose(75)}</div><div>main:{_prose(9)}</div><div>main:{_prose(64)}</div>"
    f"<div><a>{_prose(3)}</a> <a>{_prose(3)}</a></div><div><a>{_prose(2)}</a> {_prose(1)}</div>",
    f"<div><a>{_prose(3)}</a></div><p>main:{_prose(35)}</p><p>main:{_prose(3)} <a>{_prose(16)}</a></p><p>main:{_prose(58)}</p><p>main:{_prose(7)}</p><p>main:{_prose(33)}</p>"
    f"<div><a>{_prose(6)}</a></div><div><a>{_prose(7)}</a></div>",
]


@functools.lru_cache(maxsize=1)
def fitted():
    """The tree fitted on the labelled table."""
    rows, main = [], []
    for page in LABELLED:
        found = blocks(page)
        rows.append(features(found))
        main += ["main:" in b.text for b in found]
    return tree(np.concatenate(rows), np.array(main, dtype=float))


def main_text(page: str | None) -> str:
    found = blocks(page)
    node = fitted()
    return " ".join(b.text for b, row in zip(found, features(found), strict=True) if is_main(row, node))


def extract(pages: DataFrame, source: str = "html", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``text``, the main text of ``source``. ``keep``: input columns to keep (default: all)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([main_text(h) for h in batch.column(source).to_pylist()], pa.string())]

    return add_columns(pages, [T.StructField(text, T.StringType())], run, keep)
