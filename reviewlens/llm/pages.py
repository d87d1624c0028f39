"""Main text of web pages: nearest-URL page differencing.

Pages of a host that are neighbours by URL path are aligned line by line by
their longest common subsequence; lines that several neighbours have come from the
site's layout and are deleted. Parsing adds evidence: elements that are no main text
are never lines, a line aligns only with one in the same kind of landmark, and lines
of an article go only where all pages nearby begin or end theirs with them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from html import unescape
from itertools import takewhile, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.common import table

#: URLs that come to the driver to cut the order of URLs into blocks of so many pages, and the most blocks.
SAMPLE, BLOCK_PAGES, MOST_BLOCKS = 20_000, 50, 10_000
#: Pages that share more than MUCH of the text are copies, and no evidence of layout, if they share so much of what is no layout.
MUCH, COPY_SHARE = 0.5, 0.8
#: Different pages on either side among which a neighbour is sought that is no copy.
REACH = 4
#: Lines of so many characters are prose: those in a landmark always stay, and pages that share mostly such lines are copies.
PROSE = 100
#: Pages, and bytes (about) of pages, alignments and texts, that a host keeps for copies to come besides pages still in use.
KEPT_PAGES, KEPT_BYTES = 64, 8_000_000
#: Rows of a batch that are Python objects at a time.
COMPARED_ROWS = 64

#: A tag ends at the first ">" outside quoted values; another "<" before it means that there was no tag.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"'=]++|=\s*+(?:"[^"]*"|'[^']*'|)|["'])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_TELLING = re.compile("class|id|role|style|hidden", re.I)
_RAW = frozenset(("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "xmp"))
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inline markup, which need not be nested rightly and is not followed.
_INLINE = frozenset("a abbr b big cite code em font i kbd mark nobr q s samp small strike strong sub sup tt u".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul caption option".split()
)
#: An opening tag of one of these ends an open element of the same set.
_SIBLINGS = {name: group for group in ({"li"}, {"dd", "dt"}, {"td", "th"}, {"tr"}, {"option"}) for name in group}
_LEFT_OUT = frozenset("nav footer aside select dialog menu head object audio video canvas map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_HINTS = frozenset(
    "nav navbar navigation menu menus sidebar ad ads adv advert adverts advertisement advertising sponsor sponsored promo "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share "
    "sharing social related recommended comment comments respond replies disqus breadcrumb breadcrumbs footer pagination "
    "pager login signup toolbar widget widgets skip search searchbox form masthead topbar".split()
)
_OUTER_HINTS = frozenset(("header", "head"))
#: Ids name places in a text as well. These are hints on every element, the others on plain containers outside landmarks only.
_ID_HINTS = frozenset("ad ads sidebar cookie cookies newsletter share sharing related comments respond disqus".split())
_CONTAINERS = frozenset("div ul ol span table td".split())
#: A class like "has-sidebar" tells of another element.
_OTHERS = frozenset("has no not with without".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LANDMARKS = ("article", "main")
#: Text outside left-out elements that an article needs to be the page's article if a hint is on or around it.
PRINCIPAL = 1 / 3

_TEXT, _BREAK, _OPEN, _CLOSE = range(4)


def _hinted(name: str, attributes: str, inside: bool) -> bool:
    """Whether the attributes of an element tell that it is no main text; ``inside`` a landmark fewer do."""
    if name in ("html", "body") or not _TELLING.search(attributes):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "role" and value in _ROLES) or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key not in ("class", "id") or name in _HEADINGS:
            continue
        allowed = _HINTS if inside else _HINTS | _OUTER_HINTS
        if key == "id" and (inside or name not in _CONTAINERS):
            allowed = _ID_HINTS
        for word in value.split():
            parts = re.split(r"[^a-z0-9]+", word)
            if parts[0] not in _OTHERS and not allowed.isdisjoint(parts):
                return True
    return False


class _Element:
    """A landmark, or an element that may be left out: from event ``start`` to ``end``, its own end tag seen if ``closed``."""

    __slots__ = ("name", "sure", "hint", "parent", "start", "end", "closed", "landmark", "chars")

    def __init__(self, name: str, sure: bool, hint: bool, parent: _Element | None, start: int):
        self.name, self.sure, self.hint, self.parent, self.start = name, sure, hint, parent, start
        self.end, self.closed, self.landmark, self.chars = -1, False, -1, 0

    def bounds(self) -> tuple[int, int]:
        """Without an own end tag, it ends at the first landmark inside."""
        return self.start, self.end if self.closed or self.landmark < 0 else self.landmark


def _events(html: str) -> tuple[list[tuple], list[_Element]]:
    """Texts, block bounds, and ends of noted elements, in one pass whose time grows with the length only."""
    events: list[tuple] = []
    elements: list[_Element] = []
    #: Open elements: name and, for noted ones, the element; how many of each name are open; noted ones alone.
    stack: list[tuple[str, _Element | None]] = []
    opened: dict[str, int] = defaultdict(int)
    noted: list[_Element] = []
    at, size = 0, len(html)

    def close(own: bool) -> None:
        name, element = stack.pop()
        opened[name] -= 1
        if element:
            noted.pop()
            element.end, element.closed = len(events), own
            events.append((_CLOSE, element))
        if name in _BLOCKS:
            events.append((_BREAK, None))

    while at < size:
        less = html.find("<", at)
        if less < 0:
            events.append((_TEXT, html[at:]))
            break
        if less > at:
            events.append((_TEXT, html[at:less]))
        following = html[less + 1 : less + 2]
        if following in ("!", "?"):
            ends = ("-->", 3) if html.startswith("<!--", less) else (">", 1)
            found = html.find(ends[0], less + 2 if ends[1] == 3 else less)
            at = found + ends[1] if found >= 0 else size
            continue
        tag = _TAG.match(html, less)
        if not tag:
            events.append((_TEXT, "<"))
            at = less + 1
            continue
        at = tag.end()
        name, attributes = tag[2].lower(), tag[3]
        if tag[1]:
            if opened[name]:
                while stack[-1][0] != name:
                    close(False)
                close(True)
            elif name in _BLOCKS:
                events.append((_BREAK, None))
            continue
        if name in _RAW:
            if not attributes.endswith("/"):
                end = _RAW_END[name].search(html, at)
                at = end.end() if end else size
            continue
        block = name in _BLOCKS
        if block and stack:
            if stack[-1][0] == "p":
                close(False)
            if stack and stack[-1][0] in _SIBLINGS.get(name, ()):
                close(False)
        if block:
            events.append((_BREAK, None))
        elif name == "br":
            events.append((_TEXT, " "))
        if name in _VOID:
            continue
        inside = any(opened[mark] for mark in _LANDMARKS)
        sure = name in _LEFT_OUT or (name == "header" and not inside)
        hint = name == "form" or (bool(attributes) and _hinted(name, attributes, inside))
        landmark = name in _LANDMARKS
        element = None
        if sure or hint or landmark or name == "button":
            element = _Element(name, sure, hint, noted[-1] if noted else None, len(events))
            if landmark:
                for above in reversed(noted):
                    if above.landmark >= 0:
                        break
                    above.landmark = len(events)
            elements.append(element)
            noted.append(element)
            events.append((_OPEN, element))
        elif name in _INLINE and not opened[name]:
            continue
        stack.append((name, element))
        opened[name] += 1
    while stack:
        close(False)
    return events, elements


def _left_out(events: list[tuple], elements: list[_Element]) -> dict[int, int]:
    """Where an element begins that is no main text, and where it ends.

    Navigation, footers and the like always are. What is only hinted at by
    attributes is not if it holds a ``main`` or the page's article, or, in a page
    without these, more than half of the text.
    """
    out = dict(element.bounds() for element in elements if element.sure)
    watched = [element for element in elements if not element.sure]
    starts = {element.start: element for element in watched}
    ends = {element.end: element for element in watched}
    chars, until = 0, 0
    for place, (kind, value) in enumerate(events):
        if place in starts:
            starts[place].chars -= chars
        elif place in ends:
            ends[place].chars += chars
        if place >= until and place in out:
            until = out[place]
        if kind == _TEXT and place >= until:
            chars += len(value)

    # Parents come before their children: where left-out ancestors end, and whether any has a hint.
    above: dict[int, tuple[int, bool]] = {0: (0, False)}
    marks = []
    for element in elements:
        covered, hinted = above[id(element.parent) if element.parent else 0]
        above[id(element)] = max(covered, element.bounds()[1] if element.sure else 0), hinted or element.hint
        if element.name in _LANDMARKS and element.start >= covered and not element.sure:
            marks.append((element, hinted or element.hint))
    articles = [(e, hinted) for e, hinted in marks if e.name == "article"]
    able = [e for e, hinted in articles if not hinted] or [e for e, _ in articles if e.chars >= PRINCIPAL * chars]
    principal = max(able, key=lambda e: e.chars, default=None)
    bodies = [e for e, _ in marks if e.name == "main"] + ([principal] if principal else [])
    kept: set[int] = set()
    for body in bodies:
        while body and id(body) not in kept:
            kept.add(id(body))
            body = body.parent
    for element in watched:
        if element.hint and id(element) not in kept and (bodies or 2 * element.chars <= chars):
            start, end = element.bounds()
            out[start] = max(end, out.get(start, 0))
    return out


def page_lines(html: str | None) -> list[tuple[str, str]]:
    """Lines of a page in order, with the landmark they stand in ("article", "main" or "").

    A line is the text of a block with character references decoded and white
    space turned into single spaces. A block of nothing but buttons is none.
    """
    events, elements = _events(html or "")
    out = _left_out(events, elements) if elements else {}
    lines: list[tuple[str, str]] = []
    words: list[str] = []
    depth = {"article": 0, "main": 0, "button": 0}
    until, text = 0, False

    def end_block() -> None:
        if text:
            line = " ".join(unescape("".join(words)).split())
            if line:
                lines.append((line, "article" if depth["article"] else "main" if depth["main"] else ""))
        words.clear()

    for place, (kind, value) in enumerate(events):
        if place < until:
            continue
        if place in out:
            until = out[place]
        elif kind == _TEXT:
            words.append(value)
            text = text or (not depth["button"] and not value.isspace())
        elif kind == _BREAK:
            end_block()
            text = False
        elif value.name in depth:
            if value.name != "button":
                end_block()
                text = False
            depth[value.name] += 1 if kind == _OPEN else -1
    end_block()
    return lines


def common_lines(left: list[int], right: list[int]) -> set[int]:
    """Positions of ``left`` in a longest common subsequence with ``right``."""
    begin, end, shift = 0, len(left), len(right)
    while begin < end and begin < shift and left[begin] == right[begin]:
        begin += 1
    found = set(range(begin))
    while end > begin and shift > begin and left[end - 1] == right[shift - 1]:
        end, shift = end - 1, shift - 1
        found.add(end)
    places = defaultdict(list)
    for place in range(shift - 1, begin - 1, -1):
        places[right[place]].append(place)
    # Smallest last place of a common subsequence of each length, and the chain that leads there.
    lasts: list[int] = []
    chains: list[tuple] = []
    for position in range(begin, end):
        for place in places.get(left[position], ()):
            length = bisect_left(lasts, place)
            chain = (position, chains[length - 1] if length else None)
            if length == len(lasts):
                lasts.append(place)
                chains.append(chain)
            elif place < lasts[length]:
                lasts[length], chains[length] = place, chain
    chain = chains[-1] if chains else None
    while chain:
        found.add(chain[0])
        chain = chain[1]
    return found


class _Page:
    """The lines of a page; copies in a group of pages are one object."""

    __slots__ = ("lines", "marks", "hashes", "size", "plain", "known")

    def __init__(self, lines: str, marks: str):
        self.lines = lines.split("\n") if marks else []
        self.marks = marks
        self.hashes = [hash(pair) for pair in zip(self.lines, marks, strict=True)]
        self.size = sum(map(len, self.lines))
        self.plain = hash(re.sub("[0-9]+", "0", lines))
        self.known: dict[_Page, set[int]] = {}

    def shared(self, other: _Page) -> set[int]:
        """Lines that ``other`` has as well in the same order."""
        if other not in self.known:
            self.known[other] = common_lines(self.hashes, other.hashes)
        return self.known[other]

    def chars(self, places: set[int]) -> int:
        return sum(len(self.lines[i]) for i in places)

    def is_copy(self, other: _Page, reach: list[_Page]) -> bool:
        """Whether the two hold the same text, that is, share nearly all that is no layout.

        Layout is what this page has in common with the page in reach that it
        shares least with. If no page tells layout and text apart, as all share
        as much, pages are copies that share nearly all, and mostly prose.
        """
        if self.plain == other.plain:
            return True
        both = self.shared(other)
        much = self.chars(both)
        if much <= MUCH * min(self.size, other.size):
            return False
        layouts = [self.shared(page) for page in reach if page is not other and page.plain != self.plain]
        layout = min(layouts, key=self.chars, default=both)
        if self.chars(layout) < COPY_SHARE * much:
            body = set(range(len(self.lines))) - layout
            return self.chars(both & body) >= COPY_SHARE * self.chars(body)
        prose = self.chars({i for i in both if len(self.lines[i]) >= PROSE})
        return much >= COPY_SHARE * max(self.size, other.size) and prose > MUCH * much

    def frame(self, other: _Page) -> tuple[set[int], set[int]]:
        """Lines in landmarks from the first one, and from the last one, up to where ``other`` differs."""
        own, its = ([i for i, mark in enumerate(page.marks) if mark != "-"] for page in (self, other))
        found = []
        for pairs in (zip(own, its, strict=False), zip(reversed(own), reversed(its), strict=False)):
            same = takewhile(lambda pair: self.hashes[pair[0]] == other.hashes[pair[1]], pairs)
            found.append({i for i, _ in same})
        return found[0], found[1]

    def main_text(self, before: list[_Page], after: list[_Page]) -> tuple[str, int]:
        """The text, and the lines deleted; the pages before and after with the nearest first.

        Witnesses are the nearest page on either side that is no copy, and the
        next one (at the ends of a host all from one side). Outside landmarks a
        line is layout if two witnesses have it, or the only one. In a landmark it
        has to be short, and all pages in reach that are no copies, three at
        least, must begin or end their landmarks with it and all lines beyond.
        """
        reach = before + after
        sides = [[page for page in side if not self.is_copy(page, reach)] for side in (before, after)]
        others = [page for pair in zip_longest(*sides) for page in pair if page]
        shared = [self.shared(page) for page in others[:3]]
        held = Counter(i for lines in shared for i in lines)
        gone = {i for i, n in held.items() if self.marks[i] == "-" and n >= min(2, len(shared))}
        if len(shared) == 3:
            frames = [self.frame(page) for page in others]
            alike = set.intersection(*(first for first, _ in frames)) | set.intersection(*(last for _, last in frames))
            gone |= {i for i in alike.intersection(*shared) if len(self.lines[i]) < PROSE}
        return "\n\n".join(line for i, line in enumerate(self.lines) if i not in gone), len(gone)


class _Host:
    """The pages of a host in order, as a stream: rows leave when enough different pages behind them are known."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], _Page] = {}
        self.recent: dict[int, _Page] = {}
        #: Rows of equal pages next to each other: rows, page, digest, pages before, pages behind by digest.
        self.waiting: deque[tuple[list[tuple], _Page, int, list[_Page], dict[int, _Page]]] = deque()
        self.settled: dict[tuple, tuple[str, int]] = {}
        self.kept = 0

    def _forget(self) -> None:
        """Drops all that can be computed again, but for the pages in use.

        Pages hold each other by their alignments, and would stay long after
        the host is done with them if these were not dropped first.
        """
        for page in self.known.values():
            page.known.clear()
        held = {id(page) for page in self.recent.values()} | {id(entry[1]) for entry in self.waiting}
        self.known = {key: page for key, page in self.known.items() if id(page) in held}
        self.settled.clear()
        self.kept = 0

    def add(self, row: tuple, digest: int, own: bool, content: tuple[str, str]) -> Iterator[tuple]:
        """Takes a row (page_id, url); gives rows with their text and the number of lines deleted."""
        if len(self.known) > KEPT_PAGES or self.kept > KEPT_BYTES:
            self._forget()
        if content not in self.known:
            self.known[content] = _Page(*content)
            self.kept += 2 * len(content[0])
        page = self.known[content]
        last = self.waiting[-1] if self.waiting else None
        if own and last and last[1] is page and last[2] == digest:
            last[0].append(row)
            return
        # Rows before the last one with this digest have seen it.
        for entry in reversed(self.waiting):
            if entry[2] == digest:
                break
            if len(entry[4]) < REACH:
                entry[4].setdefault(digest, page)
        before = [self.recent[d] for d in reversed(self.recent) if d != digest][:REACH]
        self.recent.pop(digest, None)
        self.recent[digest] = page
        if len(self.recent) > REACH + 1:
            del self.recent[next(iter(self.recent))]
        if own:
            self.waiting.append(([row], page, digest, before, {}))
        while self.waiting and len(self.waiting[0][4]) >= REACH:
            yield from self._settle()

    def rest(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._settle()
        self._forget()

    def _settle(self) -> Iterator[tuple]:
        rows, page, _, before, after = self.waiting.popleft()
        key = (page, *before, None, *after.values())
        if key not in self.settled:
            aligned = sum(map(len, page.known.values()))
            text, _ = self.settled[key] = page.main_text(before, list(after.values()))
            self.kept += 2 * len(text) + 64 * (sum(map(len, page.known.values())) - aligned)
        for row in rows:
            yield (*row, *self.settled[key])


def _edges(rows: list[tuple], last: bool = False) -> list[tuple]:
    """Of rows (host, path, id, digest) the first or last ones with another digest each, so many as a page next to them may need."""
    best: dict[tuple, tuple] = {}
    for row in sorted(set(rows), reverse=last):
        best.setdefault((row[0], row[3]), row)
        if len(best) > REACH:
            break
    return list(best.values())


def _context(ends: dict[int, list[tuple]]) -> dict[tuple, list[int]]:
    """The blocks that a row has to be sent to besides its own, as pages there may need it."""
    sent = defaultdict(list)
    for last in (True, False):
        carried: list[tuple] = []
        for block in sorted(ends, reverse=not last):
            edge = min(ends[block]) if last else max(ends[block])
            for row in carried:
                if row[0] == edge[0]:
                    sent[row].append(block)
            carried = _edges(carried + ends[block], last)
    return dict(sent)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The main texts of parsed pages, which come by block, host and their order there."""
    types: list[pa.DataType] = []

    def sent(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(done), 256):
            columns = zip(*done[start : start + 256], strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_shared"])

    done: list[tuple] = []
    host, at = _Host(), None
    for batch in batches:
        types[:] = (batch.schema.field("page_id").type, pa.string(), pa.string(), pa.int64())
        for start in range(0, batch.num_rows, COMPARED_ROWS):
            part = batch.slice(start, COMPARED_ROWS)
            for page_id, address, name, _, _, digest, block, own, lines, marks in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (block, name) != at:
                    done += host.rest()
                    host, at = _Host(), (block, name)
                done += host.add((page_id, address), digest, own, (lines, marks))
                if len(done) >= 256:
                    yield from sent(done)
                    done = []
    yield from sent([*done, *host.rest()])


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_shared (lines deleted as a neighbour has them).

    Neighbours are the nearest pages of the host before and after in the order of
    path and key that are no copies. That order is cut into blocks, which also
    get the pages beyond their ends that theirs may need, so that blocks change
    no result. A null html is an empty page, a null URL stands in a host of its
    own. Repeated rows are pages as well.
    """
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(text, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    # Markup may differ between copies, as in links with a session.
    digest = F.xxhash64(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "<[^>]*>", ""))
    rows = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), digest.alias("digest"), F.col(html).alias("html"),
    )
    places = rows.select("host", "path", "id")
    count = places.count()
    every = max(1, count // SAMPLE)
    sample = places.where(F.pmod(F.xxhash64("host", "path", "id"), F.lit(every)) == 0).distinct()
    order = sorted((r.host, r.path, r.id) for r in sample.toLocalIterator())
    blocks = max(1, min(MOST_BLOCKS, count // BLOCK_PAGES, len(order)))
    bounds = [order[i * len(order) // blocks] for i in range(1, blocks)]
    kinds = dict(rows.dtypes)
    names = ["page_id", "url", "host", "path", "id", "digest", "block", "own", "lines", "marks"]
    parsed_schema = (
        f"page_id {kinds['page_id']}, url string, host string, path string, id string, digest bigint, block int, own boolean, "
        "lines string, marks string"
    )
    place_names = ["host", "path", "id", "digest"]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and last rows of each block, with another digest each."""
        found: dict[int, list[tuple]] = defaultdict(list)
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in place_names), strict=True):
                held = found[bisect_right(bounds, row[:3])]
                held.append(row)
                if len(held) > 64:
                    held[:] = _edges(held) + _edges(held, True)
        kept = [(*row, block) for block, held in found.items() for row in {*_edges(held), *_edges(held, True)}]
        for start in range(0, len(kept), 10_000):
            columns = zip(*kept[start : start + 10_000], strict=True)
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*place_names, "block"])

    context: dict[tuple, list[int]] = {}
    if bounds:
        schema = "host string, path string, id string, digest bigint, block int"
        found = rows.select(*place_names).mapInArrow(ends, schema).repartition("block").mapInArrow(ends, schema)
        edges = defaultdict(list)
        for r in found.toLocalIterator():
            edges[r.block].append(tuple(r)[:4])
        context = _context(edges)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                keys = list(zip(*(part.column(name).to_pylist() for name in place_names), strict=True))
                found = [page_lines(value) for value in part.column("html").to_pylist()]
                out = [(i, bisect_right(bounds, k[:3]), True) for i, k in enumerate(keys)]
                for i, k in enumerate(keys):
                    if k in context and k not in sent:
                        sent.add(k)
                        out += [(i, block, False) for block in context[k]]
                lines = pa.array(["\n".join(line for line, _ in lines) for lines in found], pa.string())
                marks = pa.array(["".join(mark[:1] or "-" for _, mark in lines) for lines in found], pa.string())
                at, blocks, own = zip(*out, strict=True)
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(name).take(at) for name in names[:6]),
                        pa.array(blocks, pa.int32()), pa.array(own, pa.bool_()), lines.take(at), marks.take(at),
                    ],
                    names,
                )

    parsed = rows.mapInArrow(parse, parsed_schema)
    parsed = parsed.repartition("block").sortWithinPartitions("block", "host", "path", "id", "digest", "lines")
    return parsed.mapInArrow(_compare, f"page_id {kinds['page_id']}, url string, text string, n_shared bigint")


def op5_main_text(spark: SparkSession, sf: str) -> DataFrame:
    found = extract_main_text(table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_shared")
