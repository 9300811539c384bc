"""Text lines of one HTML page, and what marks them as part of the article or not.

A line is the text of one block. Three things are known of it: whether it lies in
an element that is never part of an article (menu, footer, form, advert, ...),
whether it lies in an element that announces the article, and whether it is prose
there (a paragraph, a heading, a list item, ...).
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element names of HTML by their role here.
NEVER = frozenset(
    "head nav header footer aside form button select menu dialog iframe object noscript".split()
)
RAW = "script|style|template|textarea|svg|math|noframes|xmp"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt"
    " fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main"
    " menu nav ol option p pre section select summary table tbody tfoot thead title tr ul".split()
)
SPACES = frozenset(["br", "td", "th", "img", "input", "wbr"])
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
PROSE = frozenset(
    "p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt figcaption caption tr summary".split()
)
ARTICLE = frozenset(["article", "main"])
ARTICLE_ROLES = frozenset(["main", "article", "articlebody"])
# Whole class names, ids or roles that mark an element as no part of the article.
MARKS = frozenset(
    "nav navigation navbar menu header masthead footer sidebar aside complementary contentinfo"
    " banner ad ads advert advertisement sponsor sponsored promo cookie cookies consent notice"
    " newsletter subscribe share sharing social related recommended comment comments respond"
    " discussion breadcrumb breadcrumbs pagination login signup search popup modal dialog widget"
    " skip toolbar tags"
    " cookie-notice cookie-banner cookie-bar cookie-consent cookies-notice site-header"
    " site-footer page-footer main-nav main-menu main-navigation site-navigation nav-bar"
    " nav-menu side-bar ad-banner ad-container ad-slot share-buttons social-links social-share"
    " related-posts related-articles comment-list comment-form comments-area search-form"
    " search-box skip-link widget-area newsletter-signup".split()
)
# These hold the article, whatever they are called.
HOLDERS = frozenset(["html", "body", "main", "article"])

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*)>"""
    r"|<[!?][^>]*>|</[^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


@dataclass
class Line:
    text: str
    never: bool
    article: bool
    prose: bool


def _marks(name: str, rest: str) -> tuple[bool, bool]:
    """Whether an element is never article, and whether it announces one."""
    never, article = name in NEVER, name in ARTICLE
    for attribute, value in ATTRIBUTE.findall(rest) if "=" in rest else ():
        words = value.strip("\"'").lower().replace("_", "-").split()
        if attribute.lower() in ("role", "itemprop"):
            article |= bool(ARTICLE_ROLES.intersection(words))
        if name not in HOLDERS and attribute.lower() != "itemprop":
            never |= bool(MARKS.intersection(words))
    return never, article and not never


def lines_of(page: str) -> list[Line]:
    """The non-empty lines of a page in order. White space inside a block is one
    space; character references are decoded."""
    lines: list[Line] = []
    # Open elements that matter: (name, never, article); how many of each mark.
    stack: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    never = article = 0
    block = ""

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                lines.append(Line(text, never > 0, article > 0, block in PROSE))
            held.clear()

    for token in TOKEN.finditer(page):
        text = token["text"]
        if text is not None:
            held.append(text)
            continue
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if name in SPACES:
            held.append(" ")
        if name in BLOCKS or name in NEVER:
            flush()
            block = "" if token["close"] else name
        if name in VOID or (token["rest"] or "").endswith("/"):
            continue
        if not token["close"]:
            of_never, of_article = _marks(name, token["rest"])
            if name in BLOCKS or of_never or of_article:
                if of_never:
                    flush()
                stack.append((name, of_never, of_article))
                never += of_never
                article += of_article
        elif any(name == opened for opened, _, _ in stack):
            while stack:
                opened, of_never, of_article = stack[-1]
                if of_never and never:
                    flush()
                stack.pop()
                never -= of_never
                article -= of_article
                if opened == name:
                    break
    flush()
    return lines


def candidates(page: str) -> list[tuple[str, bool]]:
    """(line, whether it may be deleted if a neighbouring page has it too).

    Lines in elements that are never article are no candidates. Prose stays,
    whatever the neighbours hold, where an element announces the article.
    """
    lines = [line for line in lines_of(page) if not line.never]
    return [(x.text, not (x.article and x.prose)) for x in lines]


def common_lines(one: list[int], other: list[int]) -> list[int]:
    """Places in ``one`` of a longest common subsequence with ``other``."""
    places: dict[int, list[int]] = {}
    for at in range(len(other) - 1, -1, -1):
        places.setdefault(other[at], []).append(at)
    ends: list[int] = []  # smallest end in ``other`` of a common run of each length
    links: list[tuple] = []
    for at, line in enumerate(one):
        for place in places.get(line, ()):
            low, high = 0, len(ends)
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if ends[middle] < place else (low, middle)
            link = (at, links[low - 1] if low else None)
            if low == len(ends):
                ends.append(place)
                links.append(link)
            else:
                ends[low], links[low] = place, link
    found, link = [], links[-1] if links else None
    while link:
        found.append(link[0])
        link = link[1]
    return found[::-1]
