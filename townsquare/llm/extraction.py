"""Main text of web pages by their line-block distribution.

1. Markup is stripped: what stands between two tags of blocks is a line. Scripts,
   styles and comments vanish; menus, adverts and other furniture leave a line
   without text behind, as do links alone outside of an article.
2. The distribution gives each line the sum of the text lengths in the window
   of lines that begins there.
3. A surge point is where this sum rises from nothing, the dive point where it
   falls to nothing again. Between them lies a hump.
4. The text is what stands between the surge and the dive of the highest hump, and
   of those that belong to it: an advert may part an article. A page that
   names its article, or its main part, has humps there only.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townsquare.llm.common import packed, pieces, small_batches, unpacked

WINDOW = 3  # lines in a window
DENSE = 80  # characters of a line that is surely prose; shorter ones may be furniture at the edge of a hump

#: Comments, declarations, elements whose content is no markup, tags; their ends may be missing.
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>script|style|title|textarea|xmp|iframe|noembed|noframes)(?=[\s/>])(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed names: elements that are no block, that have no content, that readers do not see, that are furniture.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label map mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head noscript template svg math object audio video canvas map datalist select".split())
FURNITURE = set("nav footer aside form dialog menu button fieldset search".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HEADINGS = {f"h{n}" for n in range(1, 7)}
CONTENT = {"article": 2, "main": 1}
# Fixed words in the class or id of furniture, anywhere and outside of articles.
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar aside "
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer share sharing social related recommended recommendations "
    "alert disclaimer toolbar pagination pager widget widgets form search skip".split()
)
COMMENT_WORDS = set("disqus respond reply replies discussion feedback guestbook".split())  # and those that begin with comment
OUTER_WORDS = set("header masthead topbar copyright".split())
#: Elements whose class says how the page is laid out, not what they are.
FRAMES = {"html", "body", "article", "main"} | HEADINGS


class Line(NamedTuple):
    """A block's text; its length, or 0 for furniture; whether an article (2), a main part (1) or neither (0) encloses
    it, and the number of that element; the number of the block around its own; whether it is a heading."""

    text: str
    length: int
    rank: int
    content: int
    parent: int
    heading: bool


class Element:
    """An open element."""

    __slots__ = ("comment", "content", "furniture", "heading", "link", "name", "number", "rank", "unseen")

    def __init__(self, name: str, number: int, parent: Element | None) -> None:
        self.name, self.number = name, number
        self.furniture = self.unseen = self.comment = self.link = self.heading = False
        self.rank = self.content = 0
        if parent is not None:
            self.furniture, self.unseen, self.comment, self.link = parent.furniture, parent.unseen, parent.comment, parent.link
            self.rank, self.content, self.heading = parent.rank, parent.content, parent.heading


def _words(attributes: str) -> tuple[set[str], dict[str, str]]:
    """Words of class and id, and the attributes by name."""
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return {w.lower() for w in NAME_PART.findall(f"{found.get('class', '')} {found.get('id', '')}")}, found


def _opened(name: str, attributes: str, number: int, parent: Element) -> Element:
    element = Element(name, number, parent)
    element.link |= name == "a"
    element.heading |= name in HEADINGS
    element.unseen |= name in UNSEEN
    words, found = _words(attributes) if "=" in attributes or "hidden" in attributes else (set(), {})
    element.comment |= name not in ("html", "body") and any(w in COMMENT_WORDS or w.startswith("comment") for w in words)
    if name in CONTENT and not element.comment:
        if CONTENT[name] > element.rank:  # what encloses an article is no furniture, whatever its class says
            element.rank, element.content, element.furniture = CONTENT[name], number, False
    elif name in FURNITURE or name == "header" and element.rank < 2 or found.get("role", "").lower() in ROLES:
        element.furniture = True
    elif name not in FRAMES and words & (FURNITURE_WORDS if element.rank == 2 else FURNITURE_WORDS | OUTER_WORDS):
        element.furniture = True
    style = found.get("style", "").lower().replace(" ", "")
    element.unseen |= "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style
    return element


#: An open element of the first kind ends where one of the others begins, and no further up than the third.
_CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_LISTS = {"ul", "ol", "dl", "table", "select"}


def lines_of(page: str) -> list[Line]:
    """The lines of a page. Tags that are missing or crossed are taken as browsers take them: an end tag closes
    all that was opened within, one without a beginning nothing, a new block closes a paragraph."""
    root = Element("", 0, None)
    stack, lines, parts, linked, opened = [root], [], [], [0], Counter()

    def close_line() -> None:
        top = stack[-1]
        block, around = islice(chain((e for e in reversed(stack) if e.name not in INLINE), [root]), 2)
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        links, linked[0] = linked[0], 0
        if text:
            shown = not top.furniture and not block.furniture and not block.comment and (block.rank or 2 * links <= len(text))
            lines.append(Line(text, len(text) if shown else 0, block.rank, block.content, around.number, block.heading))

    def cut(place: int) -> None:
        opened.subtract(e.name for e in stack[place:])
        del stack[place:]

    def add(text: str) -> None:
        top = stack[-1]
        if text and not top.unseen:
            parts.append(text)
            if top.link:
                linked[0] += len(text.strip())

    at, number = 0, 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"]:
                add(" ")
            continue
        if m["end"]:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0) if opened[name] else 0
            if name not in INLINE or place and stack[place].furniture and not stack[place - 1].furniture:
                close_line()
            if place and not (name in INLINE and any(e.name not in INLINE for e in stack[place:])):
                cut(place)
            continue
        if name == "br":
            add(" ")
            continue
        number += 1
        if name not in INLINE:
            close_line()
            while stack[-1].name in INLINE and stack[-1].name != "a":
                cut(len(stack) - 1)
            for i in range(len(stack) - 1, 0, -1):
                closers = _CLOSED_BY.get(stack[i].name, ())
                if closers is None or name in closers:
                    cut(i)
                    break
                if stack[i].name in _LISTS or stack[i].name not in INLINE and stack[i].name not in _CLOSED_BY:
                    break
        if name not in VOID:
            element = _opened(name, m["attributes"], number, stack[-1])
            if name in INLINE and element.furniture and not stack[-1].furniture:
                close_line()
            stack.append(element)
            opened[name] += 1
            if element.furniture and not stack[-2].furniture or element.comment and not stack[-2].comment:
                # Furniture breaks the run of lines however little it says.
                lines.extend([Line("", 0, element.rank, element.content, element.number, False)] * WINDOW)
    add(page[at:])
    close_line()
    return lines


def distribution(lengths: list[int], window: int = WINDOW) -> list[int]:
    """For each line the text in the window of lines that begins there."""
    total, out = 0, [0] * len(lengths)
    for i in range(len(lengths) - 1, -1, -1):
        total += lengths[i] - (lengths[i + window] if i + window < len(lengths) else 0)
        out[i] = total
    return out


def humps(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Runs of lines from a surge of the distribution to its dive, without the empty lines at both ends."""
    found, surge = [], None
    for i, height in enumerate([*distribution(lengths, window), 0]):
        if height and surge is None:
            surge = i
        elif not height and surge is not None:
            found.append((surge, i))
            surge = None
    return [(low + next(k for k, n in enumerate(lengths[low:high]) if n), high) for low, high in found]


def _trimmed(lines: list[Line], low: int, high: int) -> tuple[int, int]:
    """Outside of an article, short lines at both ends that stand in other blocks than the prose are furniture."""
    prose = {x.parent for x in lines[low:high] if x.length >= DENSE}
    apart = lambda x: x.length < DENSE // 2 and not x.rank and not x.heading and x.parent not in prose
    if prose:
        while apart(lines[low]):
            low += 1
        while apart(lines[high - 1]):
            high -= 1
    return low, high


def main_text(page: str) -> str:
    """The article of a page, its blocks joined by blanks; empty if there is none."""
    lines = lines_of(page)
    rank = max((x.rank for x in lines if x.length), default=0)
    lengths = [x.length if x.rank >= rank else 0 for x in lines]
    found = humps(lengths)
    if not found:
        return ""
    weigh = lambda run: sum(lengths[run[0] : run[1]])
    if rank:
        by_content: dict[int, int] = {}
        for x, n in zip(lines, lengths, strict=True):
            by_content[x.content] = by_content.get(x.content, 0) + n
        chosen = max(by_content, key=by_content.__getitem__)
        lengths = [n if x.content == chosen else 0 for x, n in zip(lines, lengths, strict=True)]
        kept = humps(lengths)
    else:
        best = max(found, key=weigh)
        homes = {x.parent for x in lines[slice(*best)] if x.length >= DENSE}
        kept = [run for run in found if run == best or any(x.parent in homes for x in lines[slice(*run)])]
        kept = [_trimmed(lines, *run) for run in kept]
    return " ".join(lines[i].text for low, high in kept for i in range(low, high) if lengths[i])


def extract(pages: DataFrame, column: str = "html", result: str = "main_text") -> DataFrame:
    """All rows and columns of ``pages``, with the main text of each in ``result``.

    A null or empty page, and one of furniture alone, has an empty text. Pages
    of any length are read whole, and nothing of an article is cut. Character
    references are decoded by the rules of the HTML standard; white space is what
    Unicode calls so. A column named as the result is replaced; rows may be
    repeated. No pages, no rows.
    """
    small_batches(pages.sparkSession, 500)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = [main_text(page) for part in pieces(batch.to_frame("page"), "page") for page in part["page"]]
            yield pd.Series(found, index=batch.index, dtype=object)

    rows = packed(pages)
    page = F.coalesce(F.col(f"row.`{column}`").cast("string"), F.lit(""))
    return unpacked(rows.withColumn("found", texts(page)), **{result: F.col("found")})


def extraction_digest(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and its code points ``n_chars``."""
    rows = extract(pages.select("page_id", "url", "html"), result="text")
    return rows.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
