"""The main text of web pages by line-block distribution.

Markup is stripped into blocks of text; those of page furniture (menus, headers, footers,
adverts, forms, comments, ...) are left out.  The lengths of `WINDOW` consecutive blocks are
summed, without the text of links: text surges where a sum reaches `SURGE` characters, or half of
the page's highest sum if that is lower, and dives at a menu, which is a run of blocks with two
links or more and no words outside them, unless it stands in one element (not the body) with the
text before and behind it.  Between two menus all blocks are kept, short and linked
ones too, if text surges anywhere between them.  Between the first and the last surge, text is
kept, and so are lists of links that stand in the same element as the text next to them.
In an article element the text of links counts, and any block weighs enough to surge; text
outside it is weighed like that of other pages.

An element is furniture by its kind (nav, hidden, a role, ...) or by a name (class or id).  By name it
is not, and a form is not, if it holds more than half of the page's text or of the text in articles.
In an article, only names that speak of nothing but furniture count, and only on containers; an
article's own header stays if it holds a level 1 heading, and a label outside forms is text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks whose lengths are summed, and the sum at which text surges.
WINDOW, SURGE = 3, 86

_RAW = frozenset("script style noscript template textarea title iframe object xmp noframes".split())
_ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in _RAW}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
_FURNITURE = frozenset("nav header footer aside form menu dialog button select input label head audio video canvas map datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner sidebar widget widgets "
    "menu nav navbar navigation breadcrumb breadcrumbs masthead header footer notice notices alert cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment "
    "comments commentlist disqus respond replies pagination pager copyright disclaimer search toolbar skip hidden".split()
)
#: Names of what is no main text, however much of the page it is, unless all articles stand in it.
_NEVER = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion cookie cookies consent gdpr "
    "comment comments commentlist disqus respond replies hidden related recommended social share sharing newsletter "
    "subscribe subscription signup login".split()
)
#: Words that say in what state a page or wrapper is: has-sidebar, menu-open.
_BEFORE = frozenset("has no not non with without".split())
_AFTER = frozenset("open opened closed enabled disabled on off active visible collapsed expanded free".split())
_LISTS = frozenset("li ul ol dl dt dd".split())
_SECTIONING = frozenset("html body article main".split())


#: Words that only say which part of a piece of furniture a compound name means: ad-slot, share-buttons.
_PART_OF = frozenset(
    "area bar block body bottom box btn button buttons center container content form group head icon icons inner item items "
    "left line link links list main outer page panel post posts right section sidebar site slot thread title top unit user wrap wrapper"
    .split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXTUAL = frozenset("p a abbr b cite code em font i label mark q s small span strong sub sup time u".split())
#: Names an article's own header, which stays if it holds the title.
_TITLED = "header of an article"


def _named(name: str, attributes: str, article: bool) -> str | None:
    """The word of a class or id that names furniture.

    A heading is never named (its id is made of its words).  A paragraph or inline element is
    by a whole word, not in an article.  In an article the words of a compound must all speak of
    furniture or of a part of it: a section on related-work is none.
    """
    if name in _HEADINGS or article and name in _TEXTUAL:
        return None
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id") and (name not in _SECTIONING or "comment" in value):
            for word in value.split():
                parts = re.split(r"[-_]+", word)
                if word in _NAMES:
                    return word
                if name in _TEXTUAL or parts[0] in _BEFORE or parts[-1] in _AFTER:
                    continue
                if article and not all(p in _NAMES or p in _PART_OF or p.isdigit() for p in parts):
                    continue
                for part in (parts[0], parts[-1]):
                    if part in _NAMES:
                        return part
    return None


def _is_furniture(name: str, attributes: str, article: bool) -> bool:
    """Whether an element is furniture by its kind, whatever it is called."""
    by_kind = name in _FURNITURE and name != "form" or name == "svg"
    if by_kind and not (article and name in ("header", "label")):
        return True
    if not attributes.strip():
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value in _ROLES:
            return True
    return False


@dataclass(slots=True)
class _Element:
    """An open or closed element; the root has number 0."""

    number: int
    name: str = ""
    skipped: bool = False  # it or one around it is furniture
    named: str | None = None  # furniture by this name, unless it holds the article or most text
    link: int = 0  # the innermost link
    article: bool = False
    place: int = 0
    block: int = 0  # the innermost block
    listed: bool = False  # which is a list or item
    parent: int = 0
    size: int = 0  # text in it, outside links and furniture by kind
    main: int = 0  # of that, in articles
    titles: int = 0  # level 1 headings in it

    def child(self, number: int, name: str, attributes: str) -> _Element:
        skipped = self.skipped or _is_furniture(name, attributes, self.article)
        named = None if skipped else _named(name, attributes, self.article) or ("form" if name == "form" else None)
        if name == "header" and not skipped:
            named = _TITLED
        out = _Element(
            number, name, skipped, named, number if name == "a" else self.link,
            self.article or name in ("article", "main") and not named, self.place, self.block, self.listed, self.number,
        )
        if name in _BLOCKS and name != "body":
            out.place, out.block, out.listed = self.place if self.listed else self.block, number, name in _LISTS
        return out


class Block(NamedTuple):
    """A line of a page that has text."""

    text: str
    size: int  # characters outside links, 0 if they have no word; in articles all, and enough to surge
    links: frozenset[int]
    place: int  # the element around the block, or around its list if it is an item; 0 for the body


class _Blocks:
    """Gathers the text of one block after another."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self._parts: list[str] = []
        self._plain: list[str] = []
        self._links: set[int] = set()

    def add(self, raw: str, skipped: bool, link: int) -> None:
        if skipped or not raw:
            return
        self._parts.append(raw)
        if not link:
            self._plain.append(raw)
        elif not raw.isspace():
            self._links.add(link)

    def cut(self, article: bool, place: int) -> None:
        if text := _plain_text(self._parts):
            plain = _plain_text(self._plain) if self._links else text
            size = len(text) + SURGE if article else len(plain) if not self._links or re.search(r"\w", plain) else 0
            self.blocks.append(Block(text, size, frozenset(self._links), place))
        self._parts, self._plain, self._links = [], [], set()


def _plain_text(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def _read(page: str) -> tuple[list[_Element], list[tuple[str, int, bool]]]:
    """The elements of a page; its pieces of text, their elements, and whether a block ends there."""
    elements = [_Element(0)]
    stack, pieces, at = [elements[0]], [], 0
    open_: defaultdict[str, list[int]] = defaultdict(list)  # where elements of a name are in the stack

    def close(depth: int) -> None:
        for e in stack[depth:]:
            open_[e.name].pop()
        del stack[depth:]

    def add(raw: str, ends: bool) -> None:
        inner = stack[-1]
        pieces.append((raw, inner.number, ends))
        if not inner.skipped and not inner.link:
            size = len(raw.strip())
            inner.size += size
            inner.main += size * inner.article

    while found := _TOKEN.search(page, at):
        name = (found["name"] or "").lower()
        block = name in _BLOCKS or name in _FURNITURE
        add(page[at : found.start()], block)
        at = found.end()
        if not name:
            continue
        if found["end"]:
            if open_[name]:
                close(open_[name][-1])
            continue
        single = found["attributes"].endswith("/")
        if name in _RAW:
            if not (single and open_["svg"]):
                ended = _ENDS[name].search(page, at)
                at = ended.end() if ended else len(page)
            continue
        if name == "body" and open_["head"]:
            close(open_["head"][0])
        if open_["svg"] and name in _BLOCKS and not open_["foreignobject"]:  # an svg without an end
            close(open_["svg"][0])
        if name in _BLOCKS and stack[-1].name == "p":
            close(len(stack) - 1)
        if name == "li" and stack[-1].name == "li":
            close(len(stack) - 1)
        if name in _VOID or single:
            continue
        elements.append(stack[-1].child(len(elements), name, found["attributes"]))
        elements[-1].titles = int(name == "h1")
        open_[name].append(len(stack))
        stack.append(elements[-1])
    add(page[at:], True)
    return elements, pieces


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text outside furniture."""
    elements, pieces = _read(page)
    for e in reversed(elements[1:]):
        elements[e.parent].size += e.size
        elements[e.parent].main += e.main
        elements[e.parent].titles += e.titles
    root = elements[0]
    for e in elements[1:]:
        if e.named is _TITLED:
            holds = e.titles > 0
        elif e.named in _NEVER:
            holds = e.main == root.main > 0
        else:
            holds = 2 * e.main > root.main or 2 * e.size > root.size
        e.skipped = e.skipped or elements[e.parent].skipped or e.named is not None and not holds
    out = _Blocks()
    for raw, number, ends in pieces:
        e = elements[number]
        out.add(raw, e.skipped, e.link)
        if ends:
            out.cut(e.article, e.place)
    return out.blocks


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of `page`: blocks between surges and dives, joined by a space."""
    blocks = blocks_of(page)
    # Runs of blocks: menus, and the text between menus.
    groups = [list(group) for _, group in groupby(blocks, lambda b: not b.size)]
    runs: list[tuple[bool, list[Block]]] = []
    for i, run in enumerate(groups):
        menu = not run[0].size and len(frozenset().union(*(b.links for b in run))) > 1
        if menu and 0 < i < len(groups) - 1 and run[0].place:
            menu = not run[0].place == run[-1].place == groups[i - 1][-1].place == groups[i + 1][0].place
        if runs and not menu and not runs[-1][0]:
            runs[-1][1].extend(run)
        else:
            runs.append((menu, run))

    def most(run: list[Block]) -> int:
        sizes = [b.size for b in run]
        return max(sum(sizes[i : i + window]) for i in range(len(sizes)))

    sums = [most(run) for _, run in runs]
    limit = min(surge, max(sums, default=0) / 2)
    surges = [i for i, (menu, _) in enumerate(runs) if not menu and sums[i] >= limit]
    kept: list[Block] = []
    for i in range(surges[0], surges[-1] + 1) if surges else ():
        menu, run = runs[i]
        if not menu or {run[0].place, run[-1].place} & {runs[i - 1][1][-1].place, runs[i + 1][1][0].place}:
            kept += run
    return " ".join(b.text for b in kept)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """`page_id`, `url`, `text` of every row; a null or empty page has the empty text.

    Rows are independent of each other, so repeated rows and ties need no rule.  An empty table
    gives an empty one.  Only `page_id`, `url` and `column` are read: other columns, whatever
    their names, are left out.  End tags of elements that are not open are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) if page else "" for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(column))
    return rows.mapInArrow(run, "page_id long, url string, text string")
