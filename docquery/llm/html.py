"""One HTML page as blocks of text and as hashed element subtrees (per page, inside tasks).

A page is read in four linear passes: tags to a tree with the usual implied
ends, marks on elements that are furniture by tag, role, class or id, the
blocks of text in page order, and hashes of subtrees from those of their
children. All are loops over flat lists, so that depth is no concern.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from itertools import accumulate

import xxhash

# The names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption hr address".split())
BLOCKS = PROSE | frozenset("html head body article main section div nav header footer aside form fieldset details summary dialog center hgroup menu search noscript template legend option".split())
#: Starts that end an open p, and starts that end an open element unless one of the others is open within it.
IN_HEAD = frozenset("base link meta title style script noscript template head".split())
ENDS_P = BLOCKS - frozenset("html head body dd dt li tr td th thead tbody tfoot caption option".split())
CELLS, ROWS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
IMPLIED |= {x: (("thead", "tbody", "tfoot"), ("table",)) for x in ROWS}

#: What is no text of an article: by tag, by role, and by a part of a class or id.
TAGS = frozenset("head nav footer aside form dialog menu search noscript template svg math canvas object audio video button select datalist label fieldset legend script style textarea title xmp iframe noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
PARTS = frozenset(
    """nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs skip sitemap sidebar aside rail widget widgets
    footer foot colophon copyright ad ads advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promoted promotion
    cookie cookies consent gdpr notice notices alert popup modal overlay toast paywall newsletter subscribe subscription signup login search form
    share sharing social related recommended recommendations trending comment comments commentlist respond replies disqus discussion""".split()
)
HEADER_PARTS = frozenset("header masthead topbar logo".split())
#: Parts that make a header one of the article.
OWN_PARTS = frozenset("article post entry page content title".split())
MAIN_ROLES = frozenset(("main", "article"))

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.IGNORECASE) for t in RAW}

#: Links, their share of the text, and letters a link of a list that is taken for a menu where no article is marked.
MENU_LINKS, MENU_SHARE, MENU_LETTERS = 3, 0.6, 60


@dataclass
class Page:
    """blocks with whether they are the article's by structure, and element subtrees as (hash, first block, block after the last)."""

    blocks: list[str] = field(default_factory=list)
    own: list[bool] = field(default_factory=list)
    subtrees: list[tuple[int, int, int]] = field(default_factory=list)


@dataclass
class Tree:
    """Elements in page order: an element's descendants are the ones up to its `last`. events: texts as (element, text), starts as (element, None), ends as (-element - 1, None)."""

    tags: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    events: list[tuple[int, str | None]] = field(default_factory=list)


class _Builder:
    def __init__(self):
        self.tree, self.stack, self.places, self.blocks = Tree(), [], {}, []
        self.start("#page", "")

    def start(self, tag: str, attributes: str) -> None:
        t, number = self.tree, len(self.tree.tags)
        t.tags.append(tag)
        t.attributes.append(attributes)
        t.parents.append(self.stack[-1] if self.stack else -1)
        t.last.append(number)
        t.events.append((number, None))
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(number)

    def place(self, *tags: str) -> int:
        """Place on the stack of the innermost open element of these tags, -1 for none."""
        return max((held[-1] for t in tags if (held := self.places.get(t))), default=-1)

    def close(self, place: int) -> None:
        """End the open elements from a place of the stack on."""
        t = self.tree
        while len(self.stack) > place:
            number = self.stack.pop()
            self.places[t.tags[number]].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            t.last[number] = len(t.tags) - 1
            t.events.append((-number - 1, None))

    def open(self, tag: str, attributes: str) -> None:
        if tag not in IN_HEAD:
            self.end("head")
        if tag in ENDS_P and (at := self.place("p")) > 0:
            self.close(at)
        if tag in IMPLIED:
            ended, within = IMPLIED[tag]
            at = self.place(*ended)
            if at > self.place(*within):
                self.close(at)
        self.start(tag, attributes)
        if tag in VOID:
            self.close(len(self.stack) - 1)

    def end(self, tag: str) -> None:
        at = self.place(tag)
        if at <= 0:
            return
        # the end of an inline element does not end blocks, nor does one in a cell end what holds its table
        if tag not in BLOCKS and self.blocks and self.blocks[-1] > at:
            return
        if tag not in ("table", "html", "body") and tag not in ROWS and tag != "tr" and self.place(*CELLS) > at:
            return
        self.close(at)


def tree_of(source: str) -> Tree:
    b, at = _Builder(), 0
    while at < len(source):
        found = TOKEN.search(source, at)
        text = source[at : found.start() if found else len(source)]
        if text:
            if b.tree.tags[b.stack[-1]] == "head" and not text.isspace():
                b.end("head")
            b.tree.events.append((b.stack[-1], html.unescape(text) if "&" in text else text))
        if not found:
            break
        at, tag = found.end(), (found[2] or "").lower()
        if tag and found[1]:
            b.end(tag)
        elif tag:
            b.open(tag, found[3])
            if tag in RAW:
                over = RAW_END[tag].search(source, at)
                at = over.start() if over else len(source)
                b.close(len(b.stack) - 1)
    b.close(0)
    return b.tree


def _names(attributes: str) -> tuple[frozenset, frozenset]:
    """Parts of class and id, and roles."""
    parts, roles = set(), set()
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if name.lower() in ("class", "id"):
            parts |= {p.lower() for p in PART.findall(value)}
        elif name.lower() == "role":
            roles |= set(value.lower().split())
        elif value.lower() == "articlebody":
            roles.add("article")
    return frozenset(parts), frozenset(roles)


def _marks(t: Tree) -> tuple[list[bool], list[bool]]:
    """Per element: whether it lies in furniture, and whether in a marked article."""
    known: dict[str, tuple[frozenset, frozenset]] = {}
    names = [known.setdefault(a, _names(a)) if "=" in a else (frozenset(), frozenset()) for a in t.attributes]
    starts = [tag in ("article", "main") or bool(roles & MAIN_ROLES) for tag, (_, roles) in zip(t.tags, names, strict=True)]
    # running counts of marked articles and of the largest headings, to ask what an element holds
    mains, heads = [0], [0]
    for tag, start in zip(t.tags, starts, strict=True):
        mains.append(mains[-1] + start)
        heads.append(heads[-1] + (tag in ("h1", "h2")))
    out, inside = [], []
    for i, tag in enumerate(t.tags):
        parts, roles = names[i]
        up = t.parents[i]
        within = up >= 0 and inside[up]
        holds = mains[t.last[i] + 1] > mains[i + 1]
        if tag in ("html", "body", "#page") or holds:
            wrong = tag == "head"
        elif tag in TAGS or roles & ROLES or parts & PARTS:
            wrong = True
        else:
            header = tag == "header" or (bool(parts & HEADER_PARTS) and tag not in HEADINGS)
            titled = heads[t.last[i] + 1] > heads[i] and (within or bool(parts & OWN_PARTS))
            wrong = header and not titled
        out.append(wrong or (up >= 0 and out[up]))
        inside.append(within or (starts[i] and not out[i]))
    return out, inside


def _menus(t: Tree, out: list[bool]) -> None:
    """Marks lists of short links as furniture."""
    letters, linked, links = ([0] * len(t.tags) for _ in range(3))
    of_link = []
    for i, tag in enumerate(t.tags):
        of_link.append(tag == "a" or (i > 0 and of_link[t.parents[i]]))
        links[i] += tag == "a"
    for i, text in t.events:
        if text:
            n = len(text.strip())
            letters[i] += n
            linked[i] += n * of_link[i]
    for i in range(len(t.tags) - 1, 0, -1):
        for counts in (letters, linked, links):
            counts[t.parents[i]] += counts[i]
    for i, tag in enumerate(t.tags):
        listed = tag in ("ul", "ol", "dl", "div", "section", "table", "td") and links[i] >= MENU_LINKS
        out[i] = out[i] or (i > 0 and out[t.parents[i]]) or (listed and linked[i] >= MENU_SHARE * letters[i] and linked[i] <= MENU_LETTERS * links[i])


def _hash(tag: str, children: list[int]) -> int:
    digest = xxhash.xxh3_64(tag)
    for child in children:
        digest.update(child.to_bytes(8, "little"))
    return digest.intdigest()


def page_of(source: str | None) -> Page:
    """Blocks and subtrees of a page.

    Subtrees are elements that are blocks, hold text and are not the page
    itself, but for prose of a marked article (its paragraphs, lists, tables)
    and for what holds over half of the article's text: a site repeats
    furniture, and copies of an article are no furniture.
    """
    page = Page()
    if not source:
        return page
    t = tree_of(source)
    out, inside = _marks(t)
    marked = any(x and not y and s for (x, y), s in (((inside[i], out[i]), text.strip()) for i, text in t.events if text))
    if not marked:
        _menus(t, out)
    children: dict[int, list[int]] = {}
    first, letters, spans = {}, {}, []
    held: tuple[list[str], list[str]] = ([], [])  # furniture within a block goes beside it

    def flush() -> int:
        for own in (True, False):
            text = " ".join("".join(held[own]).split()) if held[own] else ""
            held[own].clear()
            if text:
                page.blocks.append(text)
                page.own.append(own)
        return len(page.blocks)

    for i, text in t.events:
        number = i if i >= 0 else -i - 1
        tag = t.tags[number]
        if text is not None:
            held[not out[number] and (inside[number] or not marked)].append(text)
            words = " ".join(text.split())
            if words:
                children.setdefault(number, []).append(xxhash.xxh3_64_intdigest(words))
        elif i >= 0:
            if tag in BLOCKS:
                first[number] = flush()
            elif tag == "br":
                held[True].append(" ")
                held[False].append(" ")
        else:
            parts = children.pop(number, None)
            if tag in BLOCKS:
                end = flush()
            if parts is None or number == 0:
                continue
            mine = _hash(tag, parts)
            children.setdefault(t.parents[number], []).append(mine)
            if tag in BLOCKS and tag not in ("html", "body") and end > first[number] and not (inside[number] and tag in PROSE and not out[number]):
                spans.append((mine, first[number], end))
    flush()
    upto = [0, *accumulate(len(text) * own for text, own in zip(page.blocks, page.own, strict=True))]  # letters of the article before each block
    page.subtrees = [(h - (1 << 64) if h >> 63 else h, a, z) for h, a, z in spans if 2 * (upto[z] - upto[a]) <= upto[-1]]
    return page
