"""A small, forgiving reading of HTML pages: tokens, a tree of elements, names, and text blocks."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

# Element names by their nature in HTML, and words of class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body button html legend option select summary td th tr tbody thead tfoot".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
RAW = "script|style|noscript|template|textarea|title|svg|math|iframe|object"
NOT_TEXT = frozenset("head script style noscript template nav aside form button select option textarea iframe object svg math dialog menu input label fieldset".split())
EDGES = frozenset("header footer".split())
NOT_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion promotions nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social comment comments commentlist discussion replies reply respond disqus related "
    "recommended recommendations widget widgets toolbar pagination pager form search skip tracking".split())
EDGE_WORDS = frozenset("header masthead footer topbar colophon".split())
MAIN_WORDS = frozenset("article content main post entry story".split())

_RAW = re.compile(rf"<({RAW})\b", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW.split("|")}
_TAG = re.compile(r"</?[a-zA-Z]")
_LIMIT = re.compile("['\">]")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    tag: str
    words: frozenset[str]
    role: str = ""
    children: list["Element | str"] = field(default_factory=list)

    @property
    def key(self) -> str:
        return ".".join([self.tag, *sorted(self.words)])

    def elements(self) -> Iterator["Element"]:
        return (c for c in self.children if isinstance(c, Element))


def start_of(token: str, tag: str) -> Element:
    words, role = [], ""
    for m in _MARK.finditer(token):
        value = next(v for v in m.groups()[1:] if v is not None) if any(v is not None for v in m.groups()[1:]) else ""
        if m.group(1).lower() == "role":
            role = value.lower()
        else:
            words += [w.lower() for w in _PART.findall(value)]
    return Element(tag, frozenset(words), role)


class TagEnds:
    """Where a tag ends that is read on from some place: behind the next > outside quotation marks, or -1. All
    answers come from one pass backwards, so that broken tags don't make a page read again and again."""

    def __init__(self, page: str) -> None:
        self.at = [m.start() for m in _LIMIT.finditer(page)]
        self.end = [-1] * (len(self.at) + 1)
        later: dict[str, int] = {}
        for i in range(len(self.at) - 1, -1, -1):
            mark = page[self.at[i]]
            if mark == ">":
                self.end[i] = self.at[i] + 1
            else:
                if mark in later:
                    self.end[i] = self.end[later[mark] + 1]
                later[mark] = i

    def after(self, place: int) -> int:
        return self.end[bisect_left(self.at, place)]


def tokens(page: str) -> Iterator[str]:
    """Tags and the texts between them, without comments, declarations and elements whose content is no markup.
    A < that begins none of them is text. Linear in the page's length."""
    ends = TagEnds(page)
    last = page.rfind(">")
    at, size = 0, len(page)
    while at < size:
        if page[at] != "<":
            to = page.find("<", at)
            to = size if to < 0 else to
            yield page[at:to]
        elif page.startswith("<!--", at):
            to = page.find("-->", at + 4)
            to = size if to < 0 else to + 3
        elif (raw := _RAW.match(page, at)) and (to := ends.after(raw.end())) >= 0:
            close = _RAW_END[raw.group(1).lower()].search(page, to)
            to = close.end() if close else size
        elif page.startswith(("<!", "<?"), at) and at + 2 <= last:
            to = page.find(">", at + 2) + 1
        elif (tag := _TAG.match(page, at)) and (to := ends.after(tag.end())) >= 0:
            yield page[at:to]
        else:
            to = at + 1
            yield "<"
        at = to


def tree_of(page: str) -> Element:
    """The page's elements; unclosed and stray tags are mended as browsers do in simple cases. Iterative."""
    root = Element("", frozenset())
    stack = [root]
    opened: dict[str, list[int]] = {}  # places in the stack by tag, so that no tag searches a deep stack

    def last_of(tags: tuple[str, ...]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def cut(at: int) -> None:
        for e in stack[at:]:
            opened[e.tag].pop()
        del stack[at:]

    def close(tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        at = last_of(tags)
        if at and at > last_of(tuple(t for t in until if t not in tags)):
            cut(at)

    for token in tokens(page):
        if token[0] != "<" or len(token) == 1:
            stack[-1].children.append(token)
            continue
        tag = _NAME.match(token).group(1).lower()
        if token[1] == "/":
            if at := last_of((tag,)):
                cut(at)
            continue
        if tag in CLOSES_P:
            close(("p",), ("table", "button", "article", "section", "div", "li", "td", "blockquote"))
        if tag in IMPLIED:
            close(IMPLIED[tag], SCOPES.get(tag, ()))
        element = start_of(token, tag)
        stack[-1].children.append(element)
        if tag not in VOID and not token.endswith("/>"):
            opened.setdefault(tag, []).append(len(stack))
            stack.append(element)
    return root


def not_text(e: Element, inside: bool) -> bool:
    """Is the element no part of the article by its names? ``inside``: it stands in the main element, where
    headers and footers may be the article's own."""
    if e.tag in NOT_TEXT or e.words & NOT_TEXT_WORDS or e.role in ("navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "form"):
        return True
    return e.tag == "footer" or not inside and (e.tag in EDGES or bool(e.words & EDGE_WORDS))


def named_main(e: Element) -> int:
    """2 for elements that say they are the article, 1 for those that may hold it."""
    if e.tag == "article" or "article" in e.words:
        return 2
    return 1 if e.tag == "main" or e.role == "main" or e.words & MAIN_WORDS else 0


def blocks(e: Element, skip: frozenset[int] = frozenset()) -> Iterator[str]:
    """Texts of the blocks below an element, in page order; elements in ``skip`` (by id) are left out."""
    held: list[str] = []
    work: list = [e]
    while work:
        x = work.pop()
        if isinstance(x, str):
            held.append(x)
        elif x is None:
            if text := " ".join(html.unescape("".join(held)).split()):
                yield text
            held = []
        elif id(x) in skip:
            if x.tag in BLOCKS:
                work.append(None)
        elif x.tag == "br":
            held.append(" ")
        else:
            edge = [None] if x.tag in BLOCKS else []
            work += edge + x.children[::-1] + edge
    if text := " ".join(html.unescape("".join(held)).split()):
        yield text


def size_of(e: Element) -> tuple[int, int]:
    """Characters of text below an element, and those of them inside links."""
    total = linked = 0
    work: list[tuple[Element, bool]] = [(e, False)]
    while work:
        x, link = work.pop()
        link |= x.tag == "a"
        for c in x.children:
            if isinstance(c, str):
                n = len(c.strip())
                total += n
                linked += n * link
            else:
                work.append((c, link))
    return total, linked
