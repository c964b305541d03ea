"""Main-text extraction by tree scoring.

A page becomes a tree of elements. Each paragraph passes points for its length and its commas to its parent and,
halved, to its grandparent; a container's points are discounted by the share of its text inside links. The best
container and those siblings that come near it are kept, less the parts that are page furniture.

Furniture is told by element names, and by words in class, id and role. Words alone can mislead: an element so marked stays
if it holds the article's own frame or most of the page's prose, and a block of prose inside an article stays under a word
that may only be its subject.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag of the key ends an open element of the values, up to the nearest container.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = frozenset("ul ol dl menu table select article section div main aside body".split())
CLOSES_P = BLOCK - frozenset("body head html title caption option optgroup td th tr tbody thead tfoot legend".split())
#: Elements that hold no article text wherever they stand.
FURNITURE = frozenset("nav aside footer form script style noscript iframe template title head button select textarea svg dialog menu object canvas input".split())
#: Words in class, id or role by which pages mark reader comments, other furniture, and what may be furniture.
COMMENTS = frozenset("comment comments disqus replies respond commentlist".split())
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsors sponsored nav navbar navigation breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies consent gdpr popup modal "
    "pagination pager complementary contentinfo".split()
)
SOFT = frozenset("banner promo promos menu menus notice notices newsletter subscribe subscription signup share sharing social related recommend recommended recommendations widget widgets toolbar search header".split())
#: Last parts of compound names that keep the sense of the first one, as in share-buttons; first ones that say a thing is there.
PARTS = frozenset("area bar block body bottom box button buttons container content form icons inner item items left link links list panel posts right section slot stories thread top unit widget wrap wrapper".split())
STATES = frozenset("has with no is js hide show without non not".split())
LIKELY = re.compile(r"(?<![a-z])(article\w*|content|entry\w*|main|post|story|body|text)(?![a-z])", re.I)

#: An attribute as the HTML standard reads it: a quote inside a name or an unquoted value is a letter like others. A quote
#: that is never closed is taken for one too, so that it costs a value and not the rest of the page.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|$))|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</(?:>|[^a-zA-Z][^>]*(?:>|$))|"
    rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]*+{_ATTRIBUTE})*+[\s/]*+)(?:>|$)",
    re.S,
)
_PAIR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _attributes(area: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of repeated ones counts."""
    out: dict[str, str] = {}
    for name, *values in _PAIR.findall(area):
        out.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return out


def mark_of(names: str) -> str | None:
    """What class, id or role say an element is: ``comments``, ``marked``, ``soft`` or nothing.

    A name counts by its last word, or by its first one if the last only adds a part; names of a state don't.
    """
    found = set()
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not words or words[0] in STATES:
            continue
        found.add(words[-1])
        if words[-1] in PARTS:
            found.add(words[0])
    for kind, known in (("comments", COMMENTS), ("marked", MARKED), ("soft", SOFT)):
        if found & known:
            return kind
    return None


class Element:
    __slots__ = ("items", "marks", "mark", "name", "points", "up", "drop", "chars", "linked", "core")

    def __init__(self, name: str, up: Element | None, area: str = "") -> None:
        self.name, self.up, self.items, self.points = name, up, [], 0.0
        found = _attributes(area) if area.strip() else {}
        self.marks = " ".join(found[k] for k in ("class", "id", "role") if found.get(k))
        self.mark = mark_of(self.marks) if self.marks and name not in ("html", "body", "main") else None
        hidden = "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        self.drop = name in FURNITURE or hidden
        self.chars = self.linked = 0
        self.core = False


def parse(html: str) -> Element:
    """A tree from any string; unclosed elements end where a parent or a competing element does."""
    root = now = Element("#root", None)
    at, n = 0, len(html)
    while at < n:
        found = _TOKEN.search(html, at)
        start = found.start() if found else n
        if start > at:
            now.items.append(unescape(html[at:start]))
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            x = now
            while x is not None and x.name != name:
                # an inline end tag doesn't close the block it stands in
                x = None if name not in BLOCK and x.name in BLOCK else x.up
            if x is not None and x.up is not None:
                now = x.up
            elif name == "br" or name == "p":
                now.items.append(Element(name, now))
            continue
        if name in CLOSES_P:
            x = now
            while x is not None and x.name not in SCOPE and x.name != "p":
                x = x.up
            if x is not None and x.name == "p":
                now = x.up
        if name in ENDS:
            x = now
            while x is not None and x.name not in SCOPE:
                if x.name in ENDS[name]:
                    now = x.up
                x = x.up
        made = Element(name, now, found[3])
        now.items.append(made)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
        elif name not in VOID and not found[3].endswith("/"):
            now = made
    return root


def _walk(top: Element) -> list[Element]:
    """Elements that may hold article text, parents first."""
    out, stack = [], [(top, False)]
    while stack:
        x, inside = stack.pop()
        if x.drop or (x.name == "header" and not inside):
            x.drop = True
            continue
        out.append(x)
        inside = inside or x.name in ("article", "main")
        stack.extend((y, inside) for y in reversed(x.items) if isinstance(y, Element))
    return out


def _weigh(kept: list[Element]) -> None:
    """How much text each element has, how much of it in links, and whether it frames an article."""
    for x in reversed(kept):
        x.chars = x.linked = 0
        x.core = x.name in ("main", "h1")
        for y in x.items:
            if isinstance(y, str):
                x.chars += len(y.strip())
            elif not y.drop:
                x.chars += y.chars
                x.linked += y.chars if y.name == "a" else y.linked
                x.core = x.core or y.core or (y.name == "article" and x.mark != "comments")
        if x.name == "a":
            x.linked = x.chars


def _furnished(kept: list[Element], total: int) -> None:
    """Drop elements marked as furniture, unless they hold the article's frame, most of the page's prose, or prose in an article."""
    inside: set[int] = set()
    for x in kept:
        if x.up is not None and (x.up.name in ("article", "main") or id(x.up) in inside):
            inside.add(id(x))
        if x.mark is None or x.core:
            continue
        prose = x.chars - x.linked
        if x.mark == "comments":
            x.drop = True
        elif x.mark == "soft" and id(x) in inside:
            x.drop = x.chars < 200 or x.linked > 0.3 * x.chars
        else:
            x.drop = prose * 2 <= total


def _own(x: Element) -> str:
    """Text of an element and of the inline elements in it."""
    out, stack = [], [x]
    while stack:
        y = stack.pop()
        if isinstance(y, str):
            out.append(y)
        elif y is x or (not y.drop and y.name not in BLOCK):
            stack.extend(reversed(y.items))
    return "".join(out)


def _blocks(top: Element) -> list[str]:
    """The text of each block under ``top`` in page order, white space as one space."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    stack: list = [(top, False)]
    while stack:
        x, leaving = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif leaving:
            end()
        elif not x.drop:
            if x.name == "br":
                line.append(" ")
            block = x.name in BLOCK
            if block:
                end()
                stack.append((x, True))
            stack.extend((y, False) for y in reversed(x.items))
    end()
    return out


def extract(html: str) -> str:
    """The main text of a page; empty if there is none."""
    root = parse(html)
    kept = _walk(root)
    _weigh(kept)
    _furnished(kept, root.chars - root.linked)
    kept = _walk(root)
    _weigh(kept)
    for x in kept:
        if x.name in ("p", "pre", "blockquote", "td", "li", "dd") or (x.name in ("div", "section", "article", "main", "body") and any(isinstance(y, str) and y.strip() for y in x.items)):
            text = " ".join(_own(x).split())
            if not text:
                continue
            points = 1 + text.count(",") + text.count("、") + text.count("،") + min(len(text) / 100, 3)
            if x.name in ("p", "pre", "blockquote", "td", "li", "dd") and x.up is not None:
                x.up.points += points
                if x.up.up is not None:
                    x.up.up.points += points / 2
            else:
                x.points += points
                if x.up is not None:
                    x.up.points += points / 2
    best, most = None, 0.0
    for x in kept:
        if not x.points or x.name in ("#root", "p", "b", "i", "a", "span", "em", "strong"):
            continue
        bonus = 25 if x.name in ("article", "main") else 10 if x.marks and LIKELY.search(x.marks) else 0
        value = (x.points + (bonus if x.points else 0)) * (1 - x.linked / max(1, x.chars))
        if value > most:
            best, most = x, value
    if best is None:
        return " ".join(_blocks(root))
    blocks = []
    for x in best.up.items if best.up is not None else [best]:
        if x is best:
            blocks += _blocks(x)
        elif isinstance(x, Element) and not x.drop:
            density = x.linked / max(1, x.chars)
            near = x.points * (1 - density) >= max(10.0, most * 0.2)
            prose = x.name in ("p", "h1", "h2") and x.chars and density < 0.25 and (x.chars > 80 or x.name != "p" or _own(x).rstrip().endswith((".", "!", "?")))
            if near or prose:
                blocks += _blocks(x)
    return " ".join(blocks)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null html counts as empty; a page without main text has the empty text. Markup may be broken in any way and of
    any length. Rows that repeat are extracted each; extra columns are ignored.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [extract(x) for x in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    wanted = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return wanted.mapInArrow(run, "page_id long, url string, text string, n_chars long")
