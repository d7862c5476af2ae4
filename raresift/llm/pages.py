"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Text lengths (without link text) are summed over sliding
windows of lines. Text surges where a window passes a threshold and dives where a window is empty. Inside an article
element that holds enough of the page's text all such stretches are kept, and the short lines between them. Elsewhere
stretches are joined where only removed furniture lies between them or where they share a container, and the joined
stretches with most text are kept. Elements that are page furniture by their name, class, id or role (menus, headers,
footers, sidebars, notices, adverts, forms, comments) are left out. An element that only its words, or the names of a
form or a header, mark is kept if it holds half of the page's unlinked text or more (``KEPT_SHARE``; nine tenths for reader
comments): a wrapper around the article is no furniture. Words count within one class token, and not in tokens that deny
them (``with-sidebar``), name a topic (``tag-advertising``) or a part of an article (``entry-header``). Runs of link-only lines between stretches are no
text.

Defined cases: null and empty pages give empty text; unclosed and crossing tags end with their parent; an element of
furniture that is never closed is not dropped; a tag is matched with its end in one pass; equal rows give equal rows; further columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from raresift.llm.text import prepare


WINDOW = 3
SURGE_CHARS = 80
#: A page's article element is trusted as the place of the main text if it holds this share of all text.
ARTICLE_SHARE = 0.3
#: An element with this share of all unlinked text is no furniture, whatever its words say; and for words of comments.
KEPT_SHARE = 0.5
KEPT_COMMENTS = 0.9

# Element names of HTML.
RAW = "script style noscript template iframe svg math object canvas audio video select textarea title head".split()
FURNITURE = "nav footer aside dialog menu button".split()
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead tr ul"
).split()
#: Elements that hold paragraphs.
CONTAINERS = "article blockquote center dd div fieldset main section td".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
CELLS = ("br", "wbr")

#: Words in a class, an id or a role that mark furniture.
MARKS = (
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager "
    "header masthead topbar footer bottom colophon copyright sidebar aside rail widget widgets "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login "
    "share sharing social follow related recommended recommendations trending "
    "comment comments commentlist respond reply replies disqus discussion form search searchform "
    "contentinfo complementary dialog hidden"
).split()
COMMENTS = "comment comments commentlist respond reply replies disqus discussion".split()
#: In one class token with a mark: what denies it, what makes it a topic (in front), what makes it a part of an article.
DENIED = "with without no not non has have to".split()
TOPICS = "tag category topic".split()
PARTS = "entry post article content story".split()

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^<>])*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*>",
    re.S,
)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_MARKS, _RAW, _FURNITURE, _BLOCKS, _VOID = map(frozenset, (MARKS, RAW, FURNITURE, BLOCKS, VOID))
_COMMENTS, _DENIED, _TOPICS, _PARTS = map(frozenset, (COMMENTS, DENIED, TOPICS, PARTS))
_CONTAINERS = frozenset(CONTAINERS)


@dataclass
class Line:
    text: str
    weight: int  # characters outside links
    article: int = 0  # number of the outermost article element around, or 0
    container: int = 0  # number of the element that holds the line's paragraph, or 0
    furniture: bool = False  # an empty line where furniture stood


@dataclass
class _State:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    lines: list[Line] = field(default_factory=list)
    held: list[tuple[str, int]] = field(default_factory=list)  # open containers

    def flush(self, article: int) -> None:
        if self.parts:
            text = _SPACE.sub(" ", unescape("".join(self.parts))).strip()
            if text:
                self.lines.append(Line(text, max(0, len(text) - self.linked), article, self.held[-1][1] if self.held else 0))
        self.parts, self.linked = [], 0

    def gap(self, furniture: bool = False) -> None:
        self.lines.extend(Line("", 0, furniture=furniture) for _ in range(WINDOW))

    def enter(self, name: str, number: int) -> None:
        self.held.append((name, number))

    def leave(self, name: str) -> None:
        for place in range(len(self.held) - 1, -1, -1):
            if self.held[place][0] == name:
                del self.held[place:]
                return


def _marks(value: str, in_article: bool) -> set[str]:
    """Words of furniture in a class, an id or a role."""
    found: set[str] = set()
    for token in value.split():
        parts = _SPLIT.split(_CAMEL.sub("-", token).lower())
        marks = _MARKS.intersection(parts)
        if marks == {"header"} and (in_article or not _PARTS.isdisjoint(parts)):
            continue
        if marks and _DENIED.isdisjoint(parts) and parts[0] not in _TOPICS:
            found |= marks
    return found


def _is_furniture(name: str, attributes: str, in_article: bool, share: float) -> bool:
    """``share``: what the element holds of the page's unlinked text."""
    if name in _FURNITURE:
        return True
    if name in ("html", "body", "main", "article"):
        return False
    marks = {name} if name == "form" or (name == "header" and not in_article) else set()
    for found in _ATTRIBUTE.finditer(attributes):
        key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _UNSEEN.search(value)):
            return True
        if key in ("class", "id", "role"):
            marks |= _marks(value, in_article)
    return bool(marks) and share < (KEPT_SHARE if _COMMENTS.isdisjoint(marks) else KEPT_COMMENTS)


def _ends(tags: list[tuple]) -> dict[int, int]:
    """Index of the tag that closes each element, by the index of its own tag."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for place, (_, _, closes, name, _) in enumerate(tags):
        if not closes:
            opened.setdefault(name, []).append(place)
        elif opened.get(name):
            ends[opened[name].pop()] = place
    return ends


def _unlinked(page: str, tags: list[tuple]) -> list[int]:
    """Characters of text outside links before each tag, and in the whole page."""
    found, total, at, linked = [], 0, 0, False
    for start, end, closes, name, _ in [*tags, (len(page), len(page), False, "", "")]:
        if not linked:
            total += len(page[at:start].strip())
        found.append(total)
        at = end
        if name == "a" or name in _BLOCKS:
            linked = name == "a" and not closes
    return found


def _tags(page: str) -> list[tuple]:
    """Start, end, whether it closes, name and attributes of each tag; the content of raw elements belongs to the tag."""
    found: list[tuple] = []
    open_ended: set[str] = set()  # raw elements that nothing closes from here on
    at = 0
    while (match := _TAG.search(page, at)) is not None:
        name = (match[2] or "").lower()
        end = match.end()
        if name in _RAW and not match[1] and not match[0].endswith("/>"):
            close = None if name in open_ended else _RAW_END[name].search(page, end)
            if close is not None:
                end = close.end()
            else:
                open_ended.add(name)
                end = len(page) if name in ("script", "style") else end
            found.append((match.start(), end, False, "", ""))
        else:
            found.append((match.start(), end, bool(match[1]), name, match[3] or ""))
        at = max(end, match.start() + 1)
    return found


def page_lines(page: str) -> list[Line]:
    """The text lines of a page in order, with empty lines where furniture stood."""
    tags = _tags(page)
    ends, before = _ends(tags), _unlinked(page, tags)
    state = _State()
    at, place, depth, article, link_from = 0, 0, 0, 0, None
    while place < len(tags):
        start, end, closes, name, attributes = tags[place]
        if start > at:
            state.parts.append(page[at:start])
        at = end
        place += 1
        if name in CELLS:
            state.parts.append(" ")
        elif name == "a":
            if not closes:
                link_from = len(state.parts)
            elif link_from is not None:
                state.linked += sum(map(len, state.parts[link_from:]))
                link_from = None
        elif (
            (last := ends.get(place - 1)) is not None
            and name not in _VOID
            and name != ""
            and _is_furniture(name, attributes, depth > 0, (before[last] - before[place - 1]) / max(1, before[-1]))
        ):
            state.flush(article)
            link_from = None
            if depth == 0:
                state.gap(furniture=True)
            at, place = tags[last][1], last + 1
        elif name in _BLOCKS:
            state.flush(article)
            link_from = None
            if name in _CONTAINERS:
                state.leave(name) if closes else state.enter(name, place)
            if name in ("article", "main"):
                state.gap()
                depth = depth - 1 if closes and depth else depth + (not closes)
                article = (article or place) if depth else 0
    if at < len(page):
        state.parts.append(page[at:])
    state.flush(article)
    return state.lines


def _trusted(lines: list[Line]) -> int:
    """Number of the article element that is trusted, or 0."""
    sizes: dict[int, int] = {}
    for line in lines:
        sizes[line.article] = sizes.get(line.article, 0) + line.weight
    whole = sum(sizes.values())
    inside = whole - sizes.pop(0, 0)
    return max(sizes, key=sizes.get) if inside > 0 and inside >= ARTICLE_SHARE * whole else 0


def _stretches(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """First and end line of each stretch between a surge and a dive."""
    sums = [sum(weights[place : place + window]) for place in range(len(weights))]
    if not sums or max(sums) == 0:
        return []
    threshold = min(surge, max(sums))
    found = []
    place = 0
    while place < len(sums):
        if sums[place] < threshold:
            place += 1
            continue
        first = place
        while first > 0 and weights[first - 1] > 0:  # short lines on the way up
            first -= 1
        last = place
        while last < len(sums) and sums[last] > 0:
            last += 1
        found.append((first, last))
        place = last + 1
    return found


def _groups(lines: list[Line], stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last stretch of each group of stretches that belong together."""
    held = [{line.container for line in lines[first:last] if line.weight} for first, last in stretches]
    ends: dict[int, int] = {}  # the last stretch of each container
    for number, containers in enumerate(held):
        ends.update(dict.fromkeys(containers - {0}, number))
    groups = []
    start = reach = 0
    for number, containers in enumerate(held):
        if number > reach:
            between = lines[stretches[number - 1][1] : stretches[number][0]]
            near = all(line.furniture or line.weight for line in between) or containers & held[number - 1]
            if not near:
                groups.append((start, reach))
                start = number
            reach = number
        reach = max([reach, *(ends[container] for container in containers if container)])
    return [*groups, (start, reach)]


def main_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE_CHARS) -> list[str]:
    """All stretches of the trusted article; without one, the joined stretches that enclose most text."""
    article = _trusted(lines)
    if article:
        lines = [line if line.article == article else Line("", 0) for line in lines]
    weights = [line.weight for line in lines]
    stretches = _stretches(weights, window, surge)
    if not stretches:
        return []
    groups = [(0, len(stretches) - 1)] if article else _groups(lines, stretches)
    sizes = [sum(weights[stretches[a][0] : stretches[b][1]]) for a, b in groups]
    a, b = groups[sizes.index(max(sizes))]
    inside = {place for first, last in stretches[a : b + 1] for place in range(first, last)}
    places = range(stretches[a][0], stretches[b][1])
    return [lines[place].text for place in places if lines[place].text and (weights[place] or place in inside)]


def main_text(page: str | None) -> str:
    return "\n\n".join(main_lines(page_lines(page))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page. A scan and nothing else."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page.as_py()) for page in batch.column(2)]
            sizes = pa.array([len(text) for text in found], pa.int64())
            arrays = [batch.column(0), batch.column(1), pa.array(found, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(
        pages[id_col].cast("bigint").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        pages[html_col].cast("string").alias("html"),
    )
    return chosen.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
