"""Main text of web pages by tag-path ratios.

A page becomes its text blocks in page order, each with the path of block elements from the
root to it (names and classes).  Over a page, text length outside links and punctuation are
summed for each path; a path's ratio is its mean text a block, weighted by mean punctuation.
The ratios are smoothed along the page by a Gaussian, fused path by path (a short paragraph
has the value of its path, not of itself) and held against a threshold that follows their
spread.  The paths that pass elect the content container (the innermost element that holds nearly all
of their text, or an article), and all blocks in it stay but those of boilerplate zones (elements, roles and class words that say so) and of paths that hold links alone.

Every page is one row of one task, so pages need no shuffle; a batch is worked on in small parts.

Defined results: a null html counts as empty and gives the empty text; rows with null
page_id or url and repeated rows come out as they are, each with its own text; paths with equal
weights (ties) go by page order; pages of any length are read whole, in linear time; an end in the
middle of a tag or comment drops that tag, an end in the middle of a reference keeps its
letters; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Blocks to both sides that smoothing reaches, its width, and the share of the spread that a path has to reach.
REACH, SIGMA, SPREAD = 2, 1.0, 0.8
#: A child container is entered if it holds this share of the elected text; an article or main element needs less.
SHARE, NAMED_SHARE = 0.75, 0.1
#: A path with a larger share of its text in links is a menu.
LINKS = 0.8

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = str.maketrans("", "", ".,;:!?…。，、；：！？؟،")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_TEXTUAL = _HEADINGS | frozenset("p li dt dd ul ol dl blockquote pre figure figcaption summary caption address".split())
_BLOCKS = _TEXTUAL | frozenset(
    "html head body main article section div nav header footer aside form fieldset legend details dialog menu center table thead tbody tfoot tr td th option optgroup select noscript template search hgroup hr".split()
)
_HEAD = frozenset("title meta link style script base noscript template".split())
#: Elements that never hold main text, and those whose roles say the same.
_DROPPED = frozenset("head nav footer aside form button select textarea menu dialog noscript template svg math canvas audio video object iframe map search script style title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip status".split())
#: Words of class and id that say the same.
_WORDS = frozenset(
    "nav navbar navigation sidenav topnav subnav menu menus menubar breadcrumb breadcrumbs pagination pager masthead topbar footer sidebar aside ad ads adv advert adverts "
    "advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr privacy notice notices notification alert popup modal overlay dialog "
    "newsletter subscribe subscription signup login signin register share sharing social related recommended recommendations widget widgets comment comments commentlist disqus "
    "reply replies respond responses discussion feedback copyright legal disclaimer search form toolbar hidden paywall".split()
)
_UNLESS = frozenset(("with", "has", "no", "without", "not", "is"))
#: How an inner element ends open ones: (names it ends, names that shield them).
_ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
KEPT, DROPPED, HEADER = 0, 1, 2


def _marks(name: str, attributes: str) -> tuple[str, int, bool]:
    """(class words of a path step, zone, whether the role is main) of a start tag."""
    if not attributes or attributes.isspace():
        return "", HEADER if name == "header" else DROPPED if name in _DROPPED else KEPT, name == "main"
    values = {k.lower(): html.unescape(a or b or c) for k, a, b, c in reversed(_ATTRIBUTE.findall(attributes))}
    role = values.get("role", "").strip().lower()
    words = [w.lower() for w in _WORD.findall(values.get("class", "") + " " + values.get("id", ""))]
    zone = HEADER if name == "header" else DROPPED if name in _DROPPED else KEPT
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").replace(" ", "").lower() or role in _ROLES:
        zone = DROPPED
    if zone == KEPT and words and name not in ("html", "body", "main") and role != "main":
        said = [w for before, w in zip(["", *words], words, strict=False) if before not in _UNLESS]
        said = words[:1] if name == "article" else said  # classes of an article tell about its parts too
        zone = DROPPED if any(w in _WORDS for w in said) else HEADER if "header" in said else KEPT
    return ".".join(dict.fromkeys(words)), zone, name == "main" or role == "main"


class Page:
    """Text blocks of a page and the tree of their paths."""

    def __init__(self, source: str):
        self.name, self.main = [""], [False]  # a path each
        self.parent, self.path_of = [-1], [0]  # a block element each
        self.element, self.texts, self.inside, self.zones = [], [], [], []  # a block each
        self.free: set[int] = set()  # forms and labelled containers around the main element
        self._known: dict[tuple, int] = {}
        self._marks: dict[tuple[str, str], tuple[str, int, bool]] = {}
        self._stack: list[tuple] = [("", 0, KEPT, (), True)]  # name, block element, zone, elements that dropped it, whether a block
        self._open_now: Counter[str] = Counter()
        self._forms: set[int] = set()
        self._runs: list[str] = []
        self._links = self._in_link = self._elements = self._mains = 0
        self._read(source)

    def _block(self) -> int:
        """Place of the innermost open block."""
        at = len(self._stack) - 1
        while not self._stack[at][4]:
            at -= 1
        return at

    def _flush(self) -> None:
        text = " ".join("".join(self._runs).split())
        if text:
            _, element, zone, by, _ = self._stack[self._block()]
            self.element.append(element)
            self.texts.append(text)
            self.inside.append(min(self._links, len(text)))
            self.zones.append((zone, by))
        self._runs, self._links = [], 0

    def _text(self, run: str) -> None:
        if self._stack[-1][0] == "head":
            if run.isspace():
                return
            self._pop(len(self._stack) - 1)
        zone = self._stack[-1][2]
        if zone != KEPT and not self._stack[-1][4]:
            return  # a dropped element within a line
        run = html.unescape(run) if "&" in run else run
        self._runs.append(run)
        if self._in_link:
            self._links += len(run.strip())

    def _pop(self, to: int) -> None:
        """Ends all open elements from the ``to``-th on."""
        if any(e[4] for e in self._stack[to:]):
            self._flush()
        for e in self._stack[to:]:
            self._open_now[e[0]] -= 1
            self._mains -= e[4] and self.main[self.path_of[e[1]]]
        self._in_link = self._open_now["a"]
        del self._stack[to:]

    def _open(self, names: frozenset, shields: frozenset) -> int:
        for i in range(len(self._stack) - 1, 0, -1) if any(self._open_now[n] for n in names) else ():
            if self._stack[i][0] in names:
                return i
            if self._stack[i][0] in shields:
                break
        return 0

    def _start(self, name: str, attributes: str) -> None:
        block = name in _BLOCKS
        if name in ("html", "body") and self._open_now[name]:
            return
        if self._stack[-1][0] == "head" and name not in _HEAD:
            self._pop(len(self._stack) - 1)
        if name == "br":
            self._runs.append(" ")
            return
        if block:
            at = self._block()
            if self._stack[at][0] == "p" or (name in _HEADINGS and self._stack[at][0] in _HEADINGS):
                self._pop(at)
            if name in _ENDS and (at := self._open(*_ENDS[name])):
                self._pop(at)
            self._flush()
        if name in _VOID:
            return
        key = (name, attributes)
        if key not in self._marks:
            self._marks[key] = _marks(name, attributes)
        label, zone, is_main = self._marks[key]
        _, element, outer, by, _ = self._stack[-1]
        self._elements += 1
        if name == "form":
            self._forms.add(self._elements)
        if is_main or name == "article":
            self.free.update(i for i in by if i > 0 and (is_main or i in self._forms))
        if zone == HEADER and not self._open_now["article"] and not self._mains:
            zone = DROPPED
        if zone != KEPT:
            by = (*by, self._elements) if len(by) < 9 else (*by[:9], -1)
        if outer == DROPPED or (outer == HEADER and name not in _HEADINGS):
            zone = outer
        if block:
            element = self._step(element, name, label, is_main)
            self._mains += is_main
        self._stack.append((name, element, zone, by, block))
        self._open_now[name] += 1
        self._in_link = self._open_now["a"]

    def _step(self, above: int, name: str, label: str, is_main: bool) -> int:
        path = self._known.setdefault((self.path_of[above], name, label), len(self.name))
        if path == len(self.name):
            self.name.append(name)
            self.main.append(is_main)
        self.parent.append(above)
        self.path_of.append(path)
        return len(self.parent) - 1

    def _end(self, name: str) -> None:
        if name in ("html", "body") or name in _VOID:
            return
        block = name in _BLOCKS
        for i in range(len(self._stack) - 1, 0, -1) if self._open_now[name] else ():
            if self._stack[i][0] == name:
                self._pop(i)
                return
            if not block and self._stack[i][4]:
                return  # an element within a line does not end its block

    def _read(self, source: str) -> None:
        at = 0
        while True:
            found = _TOKEN.search(source, at)
            if found is None:
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            if not found[2]:
                continue
            name = found[2].lower()
            if at == len(source) and source[-1] != ">":
                break  # the page ends within the tag
            if found[1]:
                self._end(name)
                continue
            self._start(name, found[3])
            if name in _RAW:
                close = _RAW[name].search(source, at)
                at = close.start() if close else len(source)
        if at < len(source):
            self._text(source[at:])
        self._flush()

    def kept(self) -> list[int]:
        """Blocks outside of boilerplate zones."""
        return [i for i, (zone, by) in enumerate(self.zones) if zone == KEPT or (zone == DROPPED and self.free.issuperset(by))]


def _ratios(page: Page, path: np.ndarray, kept: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each block kept: its text if its path passes the threshold, and the share of its path's text in links."""
    size = np.array([len(page.texts[i]) for i in kept], float)
    links = np.array([page.inside[i] for i in kept], float)
    marks = np.array([len(page.texts[i]) - len(page.texts[i].translate(_PUNCTUATION)) for i in kept], float)
    blocks, text, linked, stops = (np.bincount(path, w) for w in (None, size - links, links, marks))
    mean = np.maximum(blocks, 1)
    ratio = text / mean * (1 + stops / mean)
    kernel = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / (2 * SIGMA**2))
    around = np.convolve(ratio[path], kernel)[REACH:-REACH] / np.convolve(np.ones(len(path)), kernel)[REACH:-REACH]
    fused = np.sqrt(ratio * np.bincount(path, around) / mean)[path]
    passed = (fused > 0) & (fused >= SPREAD * fused.std())
    elected = np.where(passed, size - links, 0.0) if passed.any() else size
    return elected, (linked / np.maximum(text + linked, 1))[path]


def _container(page: Page, elements: np.ndarray, elected: np.ndarray) -> list[int]:
    """The block elements from the root to the content container; ``elected``: text that passed, of each of ``elements``."""
    total = np.bincount(elements, elected, len(page.parent)).tolist()
    named = [page.main[p] or page.name[p] == "article" for p in page.path_of]
    inner: list[list[int]] = [[] for _ in total]
    for e in range(len(total) - 1, 0, -1):
        named[e] = named[e] and total[e] > 0
        total[page.parent[e]] += total[e]
        named[page.parent[e]] |= named[e]
        inner[page.parent[e]].append(e)
    chain = [0]
    while page.name[page.path_of[chain[-1]]] != "article":
        fit = [e for e in inner[chain[-1]] if total[e] >= (NAMED_SHARE if named[e] else SHARE) * total[0] and page.name[page.path_of[e]] not in _TEXTUAL]
        if not fit:
            break
        chain.append(max(fit, key=lambda e: (named[e], total[e], -e)))
    return chain


def main_blocks(source: str) -> list[str]:
    """The blocks of main text of a page, in page order."""
    page = Page(source)
    kept = page.kept()
    if not kept:
        return []
    elements, path_of = np.array([page.element[i] for i in kept]), np.array(page.path_of)
    elected, links = _ratios(page, path_of[elements], kept)
    chain = _container(page, elements, elected)
    inside = np.zeros(len(path_of), bool)
    inside[chain[-1]] = True
    if page.name[path_of[chain[-1]]] == "article":  # articles of one path are parts of one text
        inside |= path_of == path_of[chain[-1]]
    for e in range(1, len(path_of)):
        inside[e] |= inside[page.parent[e]]
    titles = {int(e) for e in elements if page.name[path_of[e]] == "h1"}
    if not any(inside[e] for e in titles):  # the title beside the container
        inside[[e for e in titles if page.parent[e] in chain]] = True
    return [page.texts[i] for i, e, share in zip(kept, elements.tolist(), links, strict=True) if inside[e] and share <= LINKS]


def _extract(batches):
    for batch in tx.small(batches):
        texts = ["\n".join(main_blocks(h)) if h else "" for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def html_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by a line feed), n_chars (its code points)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
