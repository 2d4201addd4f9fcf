"""Main text of web pages by line-block distribution.

A page becomes lines: markup is stripped, each block element's text is a line. Scripts, styles,
forms and the like have no text. Every other line has a weight, its length, or none where the
markup says that it is no article text: menus, headers, footers, sidebars, notices, adverts,
reader comments. So have lists of links outside the main element.

The weights of `window` following lines are summed. Text surges where the sum rises to a level,
a share of the page's highest sum and at least `surge` characters, and dives where it falls
below; all lines with a weight between the first surge and the last dive are kept. Beyond,
short lines are kept if they are paragraphs, headings or list items, as titles and last words
are, and left out if they are bare lines of text, as menus and footers made of plain
elements are. Where most text lies in an `article` or `main` element, lines outside it need
the full level themselves. A page whose text never surges keeps what text it has.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements by what they mean for the text.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_DROPPED = frozenset(
    "form script style noscript template iframe svg canvas object embed head title dialog select "
    "option button textarea fieldset label input audio video map math xmp noembed noframes "
    "datalist".split()
)
_UNWEIGHTED = frozenset("nav footer aside menu".split())
_PROSE = frozenset(
    "p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th caption figcaption summary".split()
)
_OPENERS = frozenset("p h1 h2 h3 h4 h5 h6".split())
_BLOCK = frozenset(
    "address article blockquote body caption center dd details dir div dl dt figcaption figure "
    "h1 h2 h3 h4 h5 h6 hgroup hr html li main ol optgroup p pre section summary table tbody td "
    "tfoot th thead tr ul header nav footer aside form fieldset menu dialog".split()
)
_CLOSES_P = _BLOCK - {"body", "html"}
_MAIN = frozenset(("article", "main"))
# What may stand in a head; anything else ends one that was not closed.
_IN_HEAD = frozenset(
    "base basefont bgsound link meta title style script noscript template noframes".split()
)
_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert dialog menu menubar "
    "alertdialog toolbar status tablist".split()
)
# Words of a class or id that mark what is not the article; "has-sidebar" says so of a layout.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?<!has[_-])(?<!with[_-])(?<!no[_-])(?:ads?|advert\w*|adsense|adslot|adbox|banner|"
    r"sponsor\w*|promo\w*|nav|navbar|navigation|menus?|breadcrumbs?|sidebar\w*|aside|footer|masthead|"
    r"topbar|comments|commentlist|disqus\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|"
    r"newsletter|skip-link|hidden)(?:$|[\s_-])",
    re.I,
)
# Words that mark what often is not: such an element's short lines weigh nothing outside the
# main element. Paragraphs and headings may be called anything.
_WEAK_NAMES = re.compile(
    r"(?:^|[\s_-])(?:share|sharing|social|related|recommended|widgets?|pagination|pager|toolbar|"
    r"subscribe|signup|login|copyright|legal|disclaimer|respond|replies|search)(?:$|[\s_-])",
    re.I,
)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")
_GAP = 3


def _attributes(text: str) -> dict[str, str]:
    return {
        m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(text)
    }


class Line(NamedTuple):
    """A line of a page's text and what the markup says of it."""

    text: str
    inside: bool = False  # in the main element
    linked: bool = False  # nothing but links
    prose: bool = False  # a paragraph, heading or list item, not a bare line
    opener: bool = False  # a paragraph or heading
    weak: bool = False  # in an element that often is no article text
    weighs: bool = True  # not in an element that is none


_WEIGHS, _WEAK, _NOTHING, _GONE = range(4)


def _standing(tag: str, raw: str, inside_main: bool) -> int:
    """What an element's markup says of its text."""
    if tag in _DROPPED:
        return _GONE
    if tag in _UNWEIGHTED or tag == "header" and not inside_main:
        return _NOTHING
    if not raw or tag in ("html", "body") or tag in _MAIN:
        return _WEIGHS
    attributes = _attributes(raw)
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return _GONE
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return _GONE
    if attributes.get("role", "").lower() in _ROLES:
        return _NOTHING
    names = _CAMEL.sub("-", f"{attributes.get('class', '')} {attributes.get('id', '')}")
    if names == " ":
        return _WEIGHS
    # The header of a page weighs nothing; the header of an article holds its title.
    if _NAMES.search(names) or not inside_main and _HEADER.search(names):
        return _NOTHING
    return _WEAK if tag not in _PROSE and _WEAK_NAMES.search(names) else _WEIGHS


class _Open:
    """The open elements, with counters instead of searches: a page is read in linear time."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = []  # tag, standing, is a main element
        self.at: dict[str, list[int]] = {}  # tag -> depths of its open elements
        self.blocks: list[int] = []  # depths of open block elements
        self.levels = [0, 0, 0, 0]  # open elements by standing
        self.main = 0

    def push(self, tag: str, standing: int, is_main: bool) -> None:
        depth = len(self.stack)
        self.at.setdefault(tag, []).append(depth)
        if tag in _BLOCK:
            self.blocks.append(depth)
        self.stack.append((tag, standing, is_main))
        self.levels[standing] += 1
        self.main += is_main

    def pop(self) -> None:
        tag, standing, is_main = self.stack.pop()
        self.at[tag].pop()
        if tag in _BLOCK:
            self.blocks.pop()
        self.levels[standing] -= 1
        self.main -= is_main

    def last(self, tag: str) -> int:
        """Depth of the innermost open element of this tag, or -1."""
        depths = self.at.get(tag)
        return depths[-1] if depths else -1

    def block(self) -> str:
        """Tag of the innermost open block element."""
        return self.stack[self.blocks[-1]][0] if self.blocks else ""


def lines_of(page: str) -> list[Line]:
    """The lines of a page; elements without text and those of another standing end a line."""
    lines: list[Line] = []
    parts: list[str] = []
    own = 0  # text outside links in this line
    now = _Open()

    def end_line() -> None:
        nonlocal own
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                tag = now.block()
                lines.append(
                    Line(text, now.main > 0, own == 0, tag in _PROSE, tag in _OPENERS,
                         now.levels[_WEAK] > 0, now.levels[_NOTHING] == 0)
                )
        own = 0

    def leave(depth: int) -> None:
        while len(now.stack) > depth:
            tag, standing, is_main = now.stack[-1]
            if (tag in _BLOCK or standing or is_main) and not now.levels[_GONE]:
                end_line()
            now.pop()

    at = 0
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        gone = now.levels[_GONE] > 0
        if start > at and not gone:
            parts.append(page[at:start])
            own += now.last("a") < 0 and not page[at:start].isspace()
        if start == len(page):
            break
        m = _TOKEN.match(page, start)
        if m is None:  # a bare < is text
            if not gone:
                parts.append("&lt;")
                own += now.last("a") < 0
            at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and not gone:
                parts.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if closing:
            if (depth := now.last(tag)) >= 0:
                leave(depth)
            elif tag in _BLOCK and not gone:
                end_line()
            continue
        # The end tag of a head may be left out.
        if tag not in _IN_HEAD and tag != "head":
            depth = now.last("head")
            if depth >= 0 and now.last("template") < depth:
                leave(depth)
        # A new block ends an open paragraph.
        if tag in _CLOSES_P and (depth := now.last("p")) >= 0 and now.blocks[-1] == depth:
            leave(depth)
        if tag in _BLOCK and not now.levels[_GONE]:
            end_line()
        if tag == "li" and (depth := now.last("li")) > max(map(now.last, ("ul", "ol", "menu"))):
            leave(depth)
        if tag == "br" and not now.levels[_GONE]:  # white space; two in a row end the block
            blank = next((p for p in reversed(parts) if p == "\n" or p.strip()), "")
            if blank == "\n":
                end_line()
            else:
                parts.append("\n")
        closed = m[3].endswith("/") and not m[3].endswith("=/")
        if tag in _VOID or closed and tag not in _BLOCK:
            continue
        standing = _standing(tag, m[3], now.main > 0)
        silent = now.levels[_GONE] + now.levels[_NOTHING] > 0
        is_main = tag in _MAIN and standing < _NOTHING and not silent
        if (standing or is_main) and not now.levels[_GONE]:
            end_line()
        now.push(tag, standing, is_main)
        if tag in _RAW:  # no markup inside; ends at its own end tag only
            end = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
            if end is None:
                at = len(page)
            else:
                if not now.levels[_GONE]:
                    parts.append(page[at : end.start()])
                at = end.start()
    leave(0)
    end_line()
    return lines


def _runs(marks: list[bool]) -> list[tuple[int, int]]:
    """Maximal runs of true marks, as half-open ranges."""
    out, start = [], None
    for i, mark in enumerate([*marks, False]):
        if mark and start is None:
            start = i
        elif not mark and start is not None:
            out.append((start, i))
            start = None
    return out


def weights(lines: list[Line], window: int, surge: int) -> list[int]:
    """A line's length, or 0 if it is no article text, an only link, or one of a list of links."""
    listed = [False] * len(lines)
    for a, b in _runs([x.linked and not x.inside for x in lines]):
        if b - a >= window:
            listed[a:b] = [True] * (b - a)
    out = []
    for line, in_list in zip(lines, listed, strict=True):
        size = len(line.text)
        if not line.weighs or in_list or line.linked and not (line.inside or line.opener):
            size = 0
        if line.weak and not line.inside and size < surge:
            size = 0
        out.append(size)
    return out


def main_lines(
    lines: list[Line], window: int = _GAP, surge: int = 20, rise: float = 0.15
) -> list[str]:
    """The lines that belong to the text, in order.

    The block length at a line is the summed weight of it and the `window - 1` lines after it.
    The text surges where a block reaches the level, `rise` of the highest block and at least
    `surge`, and dives for good after the last such block.
    """
    sizes = weights(lines, window, surge)
    blocks = [sum(sizes[i : i + window]) for i in range(len(sizes))]
    peak = max(blocks, default=0)
    if peak < surge:
        return _short(lines, sizes)
    level = max(surge, rise * peak)
    surging = [i for i, block in enumerate(blocks) if block >= level]
    # A surge begins and ends with a line that has its share in it, and is no mere label if any
    # line is longer.
    share = max(level / window, min(surge, max(sizes)))
    in_surge = {j for i in surging for j in range(i, min(i + window, len(sizes)))}
    own = [j for j in in_surge if sizes[j] >= share] or [j for j in in_surge if sizes[j]]
    first, last = min(own), max(own)
    inside = sum(size for size, line in zip(sizes, lines, strict=True) if line.inside)
    home = 2 * inside >= sum(sizes)
    kept = [False] * len(lines)
    bare = [False] * len(lines)
    for i, (line, size) in enumerate(zip(lines, sizes, strict=True)):
        if home and not line.inside:
            kept[i] = size >= level
        elif first <= i <= last:
            kept[i] = size > 0 or line.linked and line.weighs and not line.weak and _alone(lines, i)
        elif size:
            kept[i] = line.inside or line.prose
            bare[i] = not kept[i]
    # One or two bare lines beside the text are part of it, more are a menu or a footer.
    for a, b in _runs(bare):
        beside = b == first or a == last + 1
        if beside and b - a < window:
            kept[a:b] = [True] * (b - a)
    return [line.text for line, keep in zip(lines, kept, strict=True) if keep]


def _alone(lines: list[Line], i: int) -> bool:
    """Whether a line of links has text that weighs before and after it."""
    before, after = lines[i - 1 : i], lines[i + 1 : i + 2]
    return all(x and not x[0].linked and x[0].weighs for x in (before, after))


def _short(lines: list[Line], sizes: list[int]) -> list[str]:
    """The lines of a page whose text never surges: those of the main element, else prose, else
    the longest run of lines with a weight, else whatever is no boilerplate."""
    for pick in (lambda x: x.inside, lambda x: x.prose and not x.linked):
        found = [x.text for x, size in zip(lines, sizes, strict=True) if size and pick(x)]
        if found:
            return found
    runs = _runs([size > 0 for size in sizes])
    if runs:
        a, b = max(runs, key=lambda r: (sum(sizes[r[0] : r[1]]), -r[0]))
        return [x.text for x in lines[a:b]]
    return [x.text for x in lines if x.weighs and not x.weak and x.text]


def main_text(page: str | None, window: int = _GAP, surge: int = 20) -> str:
    """Main text of a page, one line per block; empty for a null page or one without text."""
    return "\n".join(main_lines(lines_of(page), window, surge)) if page else ""


def extract_pages(pages: DataFrame, window: int = _GAP, surge: int = 20) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`, in place: nothing is shuffled.

    Null or empty html, or html without article text, gives an empty text and 0. Ids and
    urls are passed on as they are, nulls and repeats too; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), window, surge) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(
        rows, "page_id bigint, url string, text string, n_chars bigint"
    )
