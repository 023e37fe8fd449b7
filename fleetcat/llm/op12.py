"""HTML main-text extraction by tag-path ratios.

A page is read once, tag by tag, into blocks: runs of text between block-level
tags, with the path of block-level elements (tag, class, id) from the root.

1. Aggregate: per path the mean text length and the mean number of punctuation
   marks of its blocks (text-to-path and punctuation-to-path ratio).
2. Smooth: both sequences over the blocks in page order, with a Gaussian.
3. Fuse: length * (1 + punctuation), averaged per path again.
4. Threshold: paths at or above one standard deviation of the fused values.

The content root is the deepest element that holds nine tenths of the text on
selected paths (an ``article`` or ``main`` around it, if there is one).  Below
it every block is kept, however short: headings, lists, tables, one-word
paragraphs.  Never candidates are blocks inside elements whose tag, role, class
or id says that they are not the article (navigation, header, footer, aside,
form, advert, notice, comments, scripts, hidden parts), and lists in which all
text is links.  The heading inside an article's own header is kept.

A page is one row, and its work is linear in its length; nothing is shuffled.

Defined cases: null or empty html, and pages without candidates, give the empty
string; unclosed tags and comments end with the page, a tag cut off by the end
is dropped; void and misnested tags are tolerated; repeated rows each get a row;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcat.llm.runtime import map_arrow

SCHEMA = "page_id long, url string, text string"
BATCH_CHARS = 1 << 20  # output text of one Arrow batch, about
ROOT_SHARE = 0.9
KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)  # Gaussian, sigma 1, over two blocks on each side

# Fixed values of HTML: elements by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
NEVER = frozenset(
    "script style title textarea iframe xmp noembed noframes noscript template head nav footer aside menu svg math object embed video audio canvas dialog "
    "select option button input label fieldset datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | {"p", "li", "td", "th", "dd", "dt", "pre"}  # blocks, not parts of a page
CONTENT = frozenset(["article", "main"])
NEVER_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status tablist".split())
CLOSES = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}

# Words of class and id names for parts that are not the article
NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay toast newsletter subscribe subscription signup login "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets topbar toolbar footer foot copyright disclaimer "
    "share sharing social related recommended recommendations trending comment comments commentlist disqus reply replies respond discussion discussions "
    "feedback reactions form search pagination pager skip teaser teasers".split())
HEADER_WORDS = frozenset(["header", "masthead"])
NEGATIONS = frozenset(["no", "not", "has", "with", "without", "is", "hide"])  # "has-sidebar" is not a sidebar

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+')?+)*+)(?:(?P<end>>)|\Z)", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_ANY_ATTR = re.compile("class|id|role|hidden|style", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCTUATION = re.compile("[.,;:!?…。、，！？；：؟،।]")

OPEN, HEADINGS_ONLY, FORM, CLOSED = 0, 1, 2, 3  # what text inside an element may become


class _Element:
    """An open or closed element; ``number`` counts elements in page order, so a parent's is less than its children's."""

    __slots__ = ("tag", "parent", "number", "path", "state", "in_content", "is_main", "is_block", "in_link", "_owner", "list")

    def __init__(self, tag: str, parent: _Element | None, number: int, path: int, state: int, is_main: bool, is_block: bool):
        self.tag, self.parent, self.number, self.path, self.state = tag, parent, number, path, state
        self.is_main, self.is_block = is_main, is_block
        self.in_content = is_main or (parent is not None and parent.in_content)
        self.in_link = tag == "a" or (parent is not None and parent.in_link)
        self._owner = None if is_block else parent.owner
        self.list = number if tag in ("ul", "ol") else parent.list if parent is not None else -1

    @property
    def owner(self) -> _Element:
        """The block that holds its text."""
        return self if self.is_block else self._owner


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if _ANY_ATTR.search(text):
        for name, a, b, c in _ATTR.findall(text):
            found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def _names(value: str) -> set[str]:
    """Words of class or id names; a word after a negation does not count."""
    words = set()
    for name in value.split():
        parts = [x.lower() for x in _NAME_PART.findall(name)]
        words.update(w for before, w in zip([""] + parts, parts) if before not in NEGATIONS)
    return words


def _state(tag: str, attrs: dict[str, str], above: _Element) -> int:
    """What text may become inside an element that opens below ``above``."""
    state = above.state
    if state == CLOSED or tag in NEVER:
        return CLOSED
    if attrs and tag not in ("html", "body"):
        words = _names(attrs.get("class", "") + " " + attrs.get("id", ""))
        if ("hidden" in attrs or attrs.get("aria-hidden") == "true" or _INVISIBLE.search(attrs.get("style", ""))
                or attrs.get("role", "").lower() in NEVER_ROLES or not NEVER_WORDS.isdisjoint(words)):
            return CLOSED
        if not HEADER_WORDS.isdisjoint(words):
            tag = "header"
    if tag == "header":
        return max(state, HEADINGS_ONLY) if above.in_content else CLOSED
    if tag == "form":
        return FORM
    if (state == FORM and tag in CONTENT) or (state == HEADINGS_ONLY and tag in HEADINGS):
        return OPEN  # a page that is one form around its article; the article's heading in its own header
    return state


class Page:
    """Blocks of a page that may be content: texts, their elements, and whether all their text is inside links."""

    def __init__(self, source: str):
        self.root = _Element("#page", None, 0, 0, OPEN, False, True)
        self.elements = [self.root]
        self.texts: list[str] = []
        self.owners: list[_Element] = []
        self.linked: list[bool] = []
        self._stack = [self.root]
        self._open: dict[str, int] = {}
        self._paths: dict[tuple, int] = {}
        self._parts: list[str] = []
        self._has_text = self._has_plain = False
        self._read(source)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt != at:
                self._text(source[at:lt] if lt > 0 else source[at:])
                if lt < 0:
                    break
            token = _TOKEN.match(source, lt)
            if token is None:  # a bare "<" is text
                self._text("<")
                at = lt + 1
                continue
            at = token.end()
            close, tag, attrs, end = token.groups()
            if end is None:  # a comment, a declaration, or a tag that the end of the page cuts off
                continue
            tag = tag.lower()
            if close:
                self._end(tag)
                continue
            self._start(tag, attrs)
            if tag in RAW:
                raw_end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
                at = raw_end.start() if raw_end else n
        self._flush()

    def _text(self, raw: str) -> None:
        top = self._stack[-1]
        if top.state == OPEN:
            text = html.unescape(raw) if "&" in raw else raw
            self._parts.append(text)
            if not text.isspace():
                self._has_text = True
                self._has_plain |= not top.in_link

    def _flush(self) -> None:
        """End the block that is being read."""
        if self._has_text:
            self.texts.append(" ".join("".join(self._parts).split()))
            self.owners.append(self._stack[-1].owner)
            self.linked.append(not self._has_plain)
        self._parts, self._has_text, self._has_plain = [], False, False

    def _close(self, upto: int) -> None:
        while len(self._stack) > upto:
            self._open[self._stack.pop().tag] -= 1

    def _close_nearest(self, tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        """Close the nearest of ``tags``, unless one of ``limits`` is nearer."""
        if any(self._open.get(t) for t in tags):
            for i in range(len(self._stack) - 1, 0, -1):
                tag = self._stack[i].tag
                if tag in tags:
                    self._close(i)
                if tag in tags or tag in limits:
                    return

    def _start(self, tag: str, attr_text: str) -> None:
        if tag in ("html", "body") and self._open.get(tag):
            return
        if tag == "br":
            self._parts.append(" ")
            return
        block = tag not in INLINE
        if block:
            self._flush()
            holder = self._stack[-1].owner.tag
            if tag not in VOID and (holder == "p" or (tag in HEADINGS and holder in HEADINGS)):
                self._close_nearest((holder,), ())
            if tag in CLOSES:
                self._close_nearest(*CLOSES[tag])
        if tag in VOID or (attr_text.endswith("/") and (self._open.get("svg") or self._open.get("math"))):
            return
        above = self._stack[-1]
        attrs = _attributes(attr_text) if attr_text else {}
        state = _state(tag, attrs, above)
        if not block and state != above.state:  # an inline element that is no content is a part of its own
            self._flush()
            block = True
        path = above.path
        if block:
            path = self._paths.setdefault((path, tag, attrs.get("class", ""), attrs.get("id", "")), len(self._paths) + 1)
        main = tag in CONTENT or attrs.get("role", "").lower() in CONTENT
        element = _Element(tag, above, len(self.elements), path, state, main, block)
        self.elements.append(element)
        self._stack.append(element)
        self._open[tag] = self._open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._parts.append(" ")
            return
        inline = tag in INLINE
        if not inline:
            self._flush()
        if not self._open.get(tag):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            e = self._stack[i]
            if e.tag == tag:
                break
            if inline and e.is_block:
                return  # misnested: the inline element stays open around the block
        if e.is_block:
            self._flush()
        self._close(i)


def path_values(paths: np.ndarray, lengths: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, float]:
    """(fused value of each block's path, threshold)."""
    _, at = np.unique(paths, return_inverse=True)
    n = np.bincount(at)

    def smooth(x):
        ratio = (np.bincount(at, x) / n)[at]
        return np.convolve(ratio, KERNEL)[2:-2] / np.convolve(np.ones(len(x)), KERNEL)[2:-2]

    fused = smooth(lengths) * (1 + smooth(marks))
    return (np.bincount(at, fused) / n)[at], float(fused.std())


def _ancestors(e: _Element | None):
    while e is not None:
        yield e
        e = e.parent


def _candidates(page: Page) -> list[int]:
    """Blocks that may be the article: not link lists; those of ``article`` and ``main`` elements if there are any."""
    lists: dict[int, list[int]] = {}
    for i, owner in enumerate(page.owners):
        lists.setdefault(owner.list, []).append(i)
    menus = {i for k, members in lists.items() if k >= 0 and len(members) > 1 and all(page.linked[i] for i in members) for i in members}
    rows = [i for i in range(len(page.texts)) if i not in menus]
    return [i for i in rows if page.owners[i].in_content] or rows


def _content_root(page: Page, owners: list[_Element], amounts: np.ndarray) -> _Element:
    """The deepest element with ROOT_SHARE of the amounts; an article or main around it, if there is one."""
    weight = np.zeros(len(page.elements))
    np.add.at(weight, [e.number for e in owners], amounts)
    for e in reversed(page.elements[1:]):
        weight[e.parent.number] += weight[e.number]
    heaviest = owners[int(np.argmax(amounts))]
    root = next(e for e in _ancestors(heaviest) if weight[e.number] >= ROOT_SHARE * weight[0])
    if root.tag in LEAVES:
        root = root.parent
    return next((e for e in _ancestors(root) if e.is_main), root)


def main_text(source: str | None) -> str:
    """The article's text of one page, blocks joined by one space."""
    page = Page(source or "")
    rows = _candidates(page)
    if not rows:
        return ""
    owners = [page.owners[i] for i in rows]
    lengths = np.array([len(page.texts[i]) for i in rows], float)
    marks = np.array([len(_PUNCTUATION.findall(page.texts[i])) for i in rows], float)
    value, threshold = path_values(np.array([e.path for e in owners]), lengths, marks)
    chosen = value >= threshold
    root = _content_root(page, owners, np.where(chosen, lengths, 0))
    inside = np.zeros(len(page.elements), bool)
    for e in page.elements[root.number:]:
        inside[e.number] = e is root or inside[e.parent.number]
    loose = root.tag in ("body", "html", "#page")  # no element holds the article: selected paths, what stands beside them, headings
    beside = {e.parent.number for e, yes in zip(owners, chosen) if yes and e.parent is not None}
    kept = [page.texts[i] for i, e, yes in zip(rows, owners, chosen)
            if inside[e.number] and (not loose or yes or e.tag in HEADINGS or (e.parent is not None and e.parent.number in beside))]
    return " ".join(kept)


def _extract(batches):
    names = ["page_id", "url", "text"]
    for batch in batches:
        sources, first, texts, size = batch.column("html"), 0, [], 0
        for i in range(batch.num_rows):
            texts.append(main_text(sources[i].as_py()))
            size += len(texts[-1])
            if size >= BATCH_CHARS or i + 1 == batch.num_rows:
                n = i + 1 - first
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").slice(first, n), batch.column("url").slice(first, n), pa.array(texts, pa.string())], names=names)
                first, texts, size = i + 1, [], 0


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text (the article; empty if there is none)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return map_arrow(rows, _extract, SCHEMA)
