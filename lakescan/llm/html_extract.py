"""Main text of web pages by tree scoring.

A page is read once, tag by tag; what opens and closes is kept as a tree of numbered elements, and text as blocks that
know their innermost block element. Paragraph blocks pass points for length and commas, less their share of link text,
to their ancestors: all to the container, a half to the next, and half of that to each one above. The container with the
most points, discounted by its own link density, is the main one (of equal ones the innermost, last one); siblings with
enough points are kept with it. Points and sizes are summed once over the tree, from its leaves up, and the stack of open
elements is looked up by name, so that the work grows with a page's length, however deep it is nested.
Elements that hold no article text by kind or role, and lists that are mostly links, are left out before. So are those
with such a name (class or id), unless they hold the article or most of the page: see _by_name.

Null and empty pages give an empty text. Unclosed, stray and misnested tags are closed as browsers do. Repeated rows
and ids are each extracted. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

from pyspark.sql import DataFrame

from .common import map_texts

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>",
    re.S,
)
_OPEN_END = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAMES_IN = re.compile(r"class|id", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {k: re.compile(f"</{k}(?=[\\s/>])", re.I) for k in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")}
DROPPED = frozenset("head nav footer aside form button select option dialog menu noscript template svg math object canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
PARAGRAPHS = frozenset("p li pre blockquote td th dd dt figcaption caption summary address h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_BY_NAME = frozenset("html body article main".split())
#: What an element by name is not dropped for.
HOLDERS = frozenset(("article", "main"))
#: What its score is multiplied by if it holds none of them, but most of the page.
LESS = 0.75
#: What closes an open element of its kind, up to which ancestors.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "a": (("a",), ("td", "th", "table", "div", "p")),
}
P_SCOPE = frozenset("table td th caption button object html body".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promoted promotion banner banners
    side sidebar sidebars sidenav rail widget widgets comment comments commentlist commentary disqus reply replies respond responses discussion
    cookie cookies consent gdpr notice notices disclaimer alert alerts newsletter subscribe subscription signup popup popups modal overlay paywall toast
    share sharing shares social related recommended recommendations breadcrumb breadcrumbs pagination pager
    menu menus nav navbar navigation masthead topbar toolbar footer foot colophon copyright login search skip""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())


class _Page:
    def __init__(self):
        self.tags, self.parents, self.dropped = ["#root"], [-1], [False]
        self.named: list[int] = []  # block elements that their name speaks against, outer before inner
        self.clean: set[int] = set()  # article and main elements that their name does not speak against
        self.stack, self.links = [0], 0
        self.blocks: list[tuple[int, str, int]] = []  # innermost block element, text, characters of it in links
        self.text: list[str] = []
        self.linked = 0
        self.depths: dict[str, list[int]] = defaultdict(list)  # places of open elements in the stack, by name
        self.of_blocks = [0]  # those of block elements

    def block_of(self) -> int:
        return self.stack[self.of_blocks[-1]]

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((self.block_of(), text, self.linked))
            self.text, self.linked = [], 0

    def say(self, raw: str) -> None:
        if not self.dropped[self.stack[-1]]:
            text = html.unescape(raw) if "&" in raw else raw
            self.text.append(text)
            if self.links:
                self.linked += len(text.strip())

    def pop_to(self, depth: int) -> None:
        """Close the elements from that place of the stack on."""
        if self.of_blocks[-1] >= depth:
            self.flush()
        for n in self.stack[depth:]:
            self.depths[self.tags[n]].pop()
            self.links -= self.tags[n] == "a"
        while self.of_blocks[-1] >= depth:
            self.of_blocks.pop()
        del self.stack[depth:]

    def innermost(self, names) -> int:
        return max((d[-1] for x in names if (d := self.depths.get(x))), default=0)

    def find(self, names, scope, inline: bool = False) -> int | None:
        """The innermost open element with one of the names, up to the scope; inline: not across block elements."""
        depth = self.innermost(names)
        if not depth or self.innermost(scope) > depth or (inline and self.of_blocks[-1] > depth):
            return None
        return depth

    def open(self, tag: str, rest: str) -> None:
        if tag in CLOSES and (depth := self.find(*CLOSES[tag])) is not None:
            self.pop_to(depth)
        if tag not in INLINE:
            if (depth := self.find(("p",), P_SCOPE)) is not None:
                self.pop_to(depth)
            if tag in HEADINGS and self.tags[self.stack[-1]] in HEADINGS:
                self.pop_to(len(self.stack) - 1)
            self.flush()
        parent = self.stack[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        self.dropped.append(self.dropped[parent] or self.drops(tag, rest))
        if tag in HOLDERS or (tag not in NEVER_BY_NAME and not self.dropped[-1]):
            if _NAMES_IN.search(rest) and self.by_name(rest):
                if tag in INLINE:
                    self.dropped[-1] = True
                elif tag not in HOLDERS:
                    self.named.append(len(self.tags) - 1)
            elif tag in HOLDERS:
                self.clean.add(len(self.tags) - 1)
        self.depths[tag].append(len(self.stack))
        if tag not in INLINE:
            self.of_blocks.append(len(self.stack))
        self.stack.append(len(self.tags) - 1)
        self.links += tag == "a"

    def drops(self, tag: str, rest: str) -> bool:
        if tag in DROPPED:
            return True
        if tag == "header":  # of an article, headings are part of the text
            return not any(self.depths.get(x) for x in HOLDERS)
        if not rest.strip(" /"):
            return self.tags[self.stack[-1]] == "header" and tag not in HEADINGS and tag not in INLINE and tag not in ("div", "hgroup")
        own = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
        if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
            return True
        if tag in NEVER_BY_NAME:
            return False
        return own.get("role", "").lower() in ROLES

    def by_name(self, rest: str) -> bool:
        own = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
        names = {x.lower() for k in ("class", "id") for x in _NAME_PART.findall(own.get(k, ""))}
        return bool(names & NAMES)

    def close(self, tag: str) -> None:
        if (depth := self.find((tag,), (), inline=tag in INLINE)) is not None:
            self.pop_to(depth)

    def read(self, page: str) -> None:
        at, size, last = 0, len(page), page.rfind(">")
        while at < size:
            m = _TAG.search(page, at) if at <= last else _OPEN_END.search(page, at)  # no tag ends behind the last >
            if m is None:
                self.say(page[at:])
                break
            if m.start() > at:
                self.say(page[at : m.start()])
            at = m.end()
            name = m.re is _TAG and (m["name"] or m["name2"])
            if not name:
                if m.group().startswith("<![CDATA["):
                    self.say(m.group()[9:].removesuffix("]]>"))
                continue
            tag, rest = name.lower(), m["rest"] if m["name"] else m["rest2"]
            if m["end"] or m["end2"]:
                self.close(tag)
            elif tag in RAW:
                self.flush() if tag not in INLINE else None
                end = RAW[tag].search(page, at)
                at = size if end is None else (page.find(">", end.end()) + 1 or size)
            elif tag == "br":
                self.say(" ")
            elif tag == "hr":
                self.flush()
            elif tag not in VOID:
                self.open(tag, rest)
        self.flush()


def _points(text: str, links: int) -> float:
    return ((len(text) >= 25) + text.count(",") + min(len(text) / 100, 3)) * (1 - links / max(len(text), 1))


def _summed(parents: list[int], own: dict[int, float]) -> list[float]:
    """For each element the sum over itself and all below; parents come before their children."""
    out = [0.0] * len(parents)
    for n, x in own.items():
        out[n] = x
    for n in range(len(parents) - 1, 0, -1):
        out[parents[n]] += out[n]
    return out


def _under(parents: list[int], some: set[int]) -> list[bool]:
    """Whether an element is one of them or below one."""
    out = [False] * len(parents)
    for n in range(1, len(parents)):
        out[n] = out[parents[n]] or n in some
    return out


def _by_name(p: _Page) -> tuple[set[int], set[int]]:
    """(elements to leave out for their name, others with such a name that hold most of the page, but no article).

    An element stays if an article or main in it has more points than any around or beside it that is in no such element
    but those around both; or, if there is none with points, if it holds more than half of all points of the page.
    If nothing is outside of such elements and none stays, the one with most points does.
    """
    if not p.named:
        return set(), set()
    parents, named = p.parents, set(p.named)
    points: dict[int, float] = defaultdict(float)
    for owner, text, links in p.blocks:
        if p.tags[owner] not in HEADINGS:
            points[owner] += _points(text, links)
    inside = _summed(parents, points)
    own = [points.get(n, 0.0) for n in range(len(parents))]  # less what is in named elements below
    for n in range(len(parents) - 1, 0, -1):
        if n not in named:
            own[parents[n]] += own[n]
    held = [own[n] if n in p.clean else 0.0 for n in range(len(parents))]  # most points of a clean element in it
    for n in range(len(parents) - 1, 0, -1):
        held[parents[n]] = max(held[parents[n]], held[n])
    over = [0] * len(parents)  # the innermost named element around, or itself; 0: none
    for n in range(1, len(parents)):
        over[n] = n if n in named else over[parents[n]]
    at: dict[int, float] = defaultdict(float)  # most points of a clean element directly in a named one
    for c in p.clean:
        at[over[c]] = max(at[over[c]], own[c])
    rival: dict[int, float] = {0: 0.0}
    stays = set()
    for n in p.named:
        up = over[parents[n]]
        rival[n] = max(rival[up], at[up])
        if held[n] > rival[n] or (not rival[n] and 2 * inside[n] > inside[0]):
            stays.add(n)
    outside = any(x for n, x in points.items() if not over[n])
    if not outside and not stays and inside[0]:
        stays = {max(p.named, key=lambda n: (inside[n], -n))}
    return named - stays, {n for n in stays if not held[n]}


def _sizes(parents: list[int], blocks) -> tuple[list[float], list[float]]:
    """Characters, and those in links, of each element and all below."""
    sizes, linked = defaultdict(float), defaultdict(float)
    for owner, text, links in blocks:
        sizes[owner] += len(text)
        linked[owner] += links
    return _summed(parents, sizes), _summed(parents, linked)


def blocks_of(page: str | None) -> list[str]:
    """The article's blocks in page order."""
    if not page:
        return []
    p = _Page()
    p.read(page)
    left_out, less = _by_name(p)
    gone = _under(p.parents, left_out)
    return choose(p.tags, p.parents, [x for x in p.blocks if not gone[x[0]]], less)


def choose(tags: list[str], parents: list[int], blocks: list[tuple[int, str, int]], less: set[int]) -> list[str]:
    """The texts of the blocks of the best container and its siblings; less: elements whose names lower their score."""
    sizes, linked = _sizes(parents, blocks)
    gone = _under(parents, {n for n, tag in enumerate(tags) if tag in LISTS and linked[n] > 0.6 * sizes[n]})
    blocks = [x for x in blocks if not gone[x[0]]]
    sizes, linked = _sizes(parents, blocks)
    given: dict[int, float] = defaultdict(float)  # what an element gets directly
    for owner, text, links in blocks:
        if tags[owner] not in HEADINGS:
            given[parents[owner] if tags[owner] in PARAGRAPHS else owner] += _points(text, links)
    score = [given.get(n, 0.0) for n in range(len(tags))]
    for n in range(len(tags) - 1, 0, -1):
        score[parents[n]] += score[n] / 2
    reached = set(given)
    for n in range(len(tags) - 1, 0, -1):
        if n in reached:
            reached.add(parents[n])
    final = {n: score[n] * (1 - linked[n] / max(sizes[n], 1)) * (LESS if n in less else 1) for n in reached if n > 0}
    if not final:
        return [t for _, t, links in blocks if 2 * links <= len(t)]
    best = max(final, key=lambda n: (final[n], n))
    n = parents[best]
    while n > 0:  # the article that it is most of holds its headings too
        if tags[n] in HOLDERS and 2 * sizes[best] >= sizes[n]:
            best, final[n] = n, max(final.get(n, 0), final[best])
            break
        n = parents[n]
    kept, least = {best}, 0.25 * final[best]
    kept.update(n for n, s in final.items() if parents[n] == parents[best] and s >= least)
    for owner, text, links in blocks:
        if parents[owner] == parents[best] and tags[owner] == "p" and len(text) > 80 and 4 * links < len(text):
            kept.add(owner)
    there = _under(parents, kept)
    return [text for owner, text, _ in blocks if there[owner]]


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks_of(page))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of (page_id, url, html)."""

    def make():
        def step(texts, keys):
            found = [main_text(t) for t in texts]
            return keys | {"text": found, "n_chars": [len(t) for t in found]}

        return step

    return map_texts(pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html"), ["page_id", "url"], "html", make, "page_id long, url string, text string, n_chars long")
