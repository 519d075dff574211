"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Menus, forms, notices and the like
are told by their place. The first pass judges every other block by itself: link
density, length and density of stop words, in an article element as outside of
one. Short and doubtful blocks stay undecided; in the second pass they take the
label of the nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from lectern.llm.common import col, map_text

# Element names of HTML, and frequent function words of English, German, French and Spanish.
RAW = frozenset("script style noscript template svg math iframe object embed canvas audio video select textarea button option datalist title head".split())
CUT = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
) - {"br"}
HOLDS = frozenset("address blockquote article aside main section div nav header footer form menu ul ol dl table figure details dialog fieldset search li td".split())
OUTSIDE = frozenset("nav aside footer form menu dialog search fieldset".split())
VOID = frozenset("area base br col hr img input link meta source track wbr".split())
OUTSIDE_NAME = re.compile(
    r"(?:(?<![^\s])|(?<=[_-])(?<!has-)(?<!with-)(?<!no-)(?<!has_)(?<!with_)(?<!no_))"
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|side-?bar|widget|masthead|topbar|cookies?|consent|notice|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommend\w*|trending|comments?|comment-?list|replies|reply|disqus|respond|pagination|pager|copyright|skip-?link|toolbar|toc)(?=$|[\s_-]|\d)"
    r"|(?<![^\s])(?:(?:site|page|top|main|global)[_-]?)?(?:header|footer|tags)(?![^\s])",
    re.I,
)
COMMENT_NAME = re.compile(r"(?<![^\s])(?:comments?|repl(?:y|ies)|respond|disqus|advert\w*|ads?|promo\w*|related|sponsor\w*)(?=$|[\s_-]|\d)", re.I)
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content)(?:[\s_-]?(?:body|content|text|main))?(?=$|\s)", re.I)
OUTSIDE_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which will with you
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war was wie wir zu zum zur
    au aux avec ce cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous à
    al como con de del el ella en entre era es esta este la las lo los más me mi muy no o para pero por que se ser si sin sobre su sus también un una y ya""".split()
)
#: Limits of the first pass: characters of a short and of a long block, link density (of any block, and of a whole list of links), density of stop words.
SHORT, LONG, LINKS, ALL_LINKS, STOP_LOW, STOP_HIGH = 70, 200, 0.33, 0.9, 0.05, 0.25
#: The same densities for blocks of an article element, whose long blocks may be lists of names or figures.
STOP_INSIDE = 0.02

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: A tag's attributes up to its >, as HTML reads them: a quote counts only where a value starts. The group is a quote that nothing closes, with which the match runs to the page's end.
_REST = re.compile(
    r"""(?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|(["'])[\s\S]*+|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+)?+)?+)*+"""
)


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    heading: bool
    outside: bool  # in a menu, footer, advert, form ...
    inside: bool  # in an article or main element


def _tag_end(page: str, at: int) -> int:
    """Index of the > that ends the tag whose name ends at at, past quoted values of any length; of the next > after a quote that the page never closes; -1 if there is none."""
    end = page.find(">", at)
    if end < 0 or page.find("=", at, end) < 0:
        return end
    rest = _REST.match(page, at)
    if rest.end() < len(page):
        return rest.end()
    return page.find(">", rest.start(1)) if rest[1] else -1


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in page order; markup that is cut off at the page's end is dropped."""
    out: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element; whether it or one around it is outside of the article; whether one around an outside part is inside; whether any is inside
    depth: Counter[str] = Counter()  # elements of the stack by name
    link = 0
    heading = own = False  # of the block that is open: is it a heading, does its own name put it outside

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                _, outside, inside, _ = stack[-1] if stack else ("", False, False, False)
                out.append(Block(text, len(_SPACE.sub(" ", html.unescape("".join(links))).strip()), heading, own or outside, inside))
            parts.clear()
            links.clear()

    def text(piece: str) -> None:
        if piece:
            parts.append(piece)
            if link:
                links.append(piece)

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", lt) or page.startswith("<!", lt) or page.startswith("<?", lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        closing = page.startswith("</", lt)
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            text("<")
            at = lt + 1
            continue
        end = _tag_end(page, name.end())
        if end < 0:
            break
        tag, at = name[0].lower(), end + 1
        if tag in RAW:
            if not closing and tag != "head" and not page.startswith("/>", end - 1):
                stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif tag in ("script", "style", "textarea", "title"):
                    at = size
            elif tag == "head":
                close()
            continue
        if tag == "a":
            link = 0 if closing else 1
        elif tag in ("br", "img", "wbr") and tag != "wbr":
            text(" ")
        elif tag in CUT:
            close()
            link = 0
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            named = {} if closing else {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(page[lt:end])}
            labels = f"{named.get('class', '')} {named.get('id', '')}"
            own = tag not in HOLDS and bool(OUTSIDE_NAME.search(labels))
            if tag in HOLDS:
                if closing:
                    while depth[tag]:  # a closing tag without its element is passed over; one with it closes all that is open inside
                        last = stack.pop()[0]
                        depth[last] -= 1
                        if last == tag:
                            break
                else:
                    role = named.get("role", "").lower()
                    around, within, any_inside = stack[-1][1:] if stack else (False, False, False)
                    inside = tag in ("article", "main") or role in ("main", "article") or named.get("itemprop", "").lower() == "articlebody" or bool(MAIN_NAME.search(labels))
                    outside = tag in OUTSIDE or role in OUTSIDE_ROLE or tag == "header" and not any_inside or bool(OUTSIDE_NAME.search(labels)) or named.get("aria-hidden", "").lower() == "true" or "display:none" in named.get("style", "").replace(" ", "").lower()
                    if tag in ("article", "main"):  # blog software names its articles by their tags and categories
                        outside = bool(COMMENT_NAME.search(labels))
                    inside = inside and not outside
                    # Nothing inside of an outside part is article.
                    stack.append((tag, around or outside, within or inside and not around, any_inside or inside))
                    depth[tag] += 1
    close()
    return out


def first_pass(b: Block, has_article: bool) -> bool | None:
    """Whether a block is main text, by itself; None if it can't be told.

    What stands outside by place isn't, nor what stands around a page's article.
    Blocks of links aren't. Long blocks with stop words are, long ones almost
    without them aren't, though in an article element, whose text may be a list
    of names or figures, they are left to their neighbours, as short ones are.
    """
    if b.outside or has_article and not b.inside:
        return False
    size = len(b.text)
    links = b.link_chars / size
    if links > (ALL_LINKS if b.inside else LINKS):
        return False
    if size < SHORT or b.heading:
        return None if b.inside or not b.link_chars else False
    words = b.text.lower().split()
    density = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if links > LINKS:  # a text with long links in its article
        return True if density >= STOP_HIGH else None
    if density >= (STOP_INSIDE if b.inside else STOP_HIGH):
        return True
    if b.inside:
        return None
    if density >= STOP_LOW:
        return True if size > LONG else None
    return False


def second_pass(labels: list[bool | None], headings: list[bool], inside: bool) -> list[bool]:
    """Undecided blocks take the label of the nearest decided ones, that of the nearer if the two sides differ.

    A heading goes with what follows it. Where all blocks stand in an article
    (inside), sides that differ, or no decided block at all, leave a block in.
    """
    n, far = len(labels), len(labels) + 1
    before, after = [far] * n, [far] * n
    for k in range(n):
        before[k] = 0 if labels[k] is not None else before[k - 1] + 1 if k and before[k - 1] < far else far
    for k in range(n - 1, -1, -1):
        after[k] = 0 if labels[k] is not None else after[k + 1] + 1 if k + 1 < n and after[k + 1] < far else far
    out = []
    for k, label in enumerate(labels):
        if label is None:
            left = labels[k - before[k]] if before[k] < far else None
            right = labels[k + after[k]] if after[k] < far else None
            if left is None and right is None:
                label = inside
            elif left is None or right is None or left == right:
                label = right if left is None else left
            elif headings[k]:
                label = right
            else:
                label = inside or before[k] != after[k] and (left if before[k] < after[k] else right)
        out.append(bool(label))
    return out


def main_text(page: str) -> str:
    """The article's blocks in page order, one a line; empty if there are none."""
    found = blocks(page)
    article = [b for b in found if b.inside and not b.outside]
    asked = article or found  # of an article, only its own blocks are neighbours
    labels = second_pass([first_pass(b, bool(article)) for b in asked], [b.heading for b in asked], bool(article))
    return "\n".join(b.text for b, main in zip(asked, labels, strict=True) if main)


def extract(df: DataFrame, *, keep: dict[str, Column], page: str = "html") -> DataFrame:
    """keep's columns, text (the main text; empty if none) and n_chars (its code points) for each row of df.

    Null and empty pages have no text; text outside of any tag is a page of its
    own. Equal rows give equal rows; other columns are ignored. Row-local, in
    time linear in the page.
    """

    def start():
        def work(pages: list[bytes]) -> dict:
            texts = [main_text(p.decode("utf-8", "replace")) for p in pages]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_text(df, col(page), keep, {"text": "string", "n_chars": "bigint"}, start)
