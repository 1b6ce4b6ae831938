"""Main text of web pages by line-block distribution.

Markup is stripped into blocks, one line each, and each line weighs as much as its text is long, several times that inside
an article element. Parts of a page that are not its article (menus, headers, footers, sidebars, notices, adverts, forms,
comments: by element, role, class or id) are stripped with their markup, and lines made of links weigh nothing. The sums over
sliding windows of lines surge where running text begins and dive to nothing where it ends, as a stretch of empty lines
stands where a stripped part or an article begins or ends. The surges inside articles and those outside are weighed against each
other, and the heavier side is the main text: all text between a surge and its dive, and the short lines that stand
beside it in the same element, cut off from it by something stripped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Lines in a window, and the sum from which a window is a surge.
WINDOW = 3
SURGE = 80
#: How much more a sign weighs inside an article element.
IN_ARTICLE = 4
#: A line weighs nothing if more than this share of its text is links.
LINKED = 0.5

# Elements by their role in a page.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp noembed noframes".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button select datalist fieldset head map".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
ARTICLE = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice nav navbar navigation menu breadcrumb breadcrumbs masthead header footer sidebar aside widget "
    "widgets related recommended recommendations share sharing social comment comments commentlist disqus reply replies "
    "respond newsletter subscribe subscription signup signin login popup modal overlay pagination pager toolbar skip".split()
)

# Before a name, these say something of the element itself: an entry's header, a column without sidebar.
ABOUT = frozenset("no has with without entry post article".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<=\s)(hidden)(?=[\s/>]|\Z)", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE) for name in RAW}


def _set_aside(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no part of the page's main text."""
    if name in BOILERPLATE or (name == "header" and not in_article):
        return True
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for key, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        key = key.lower()
        if bare or key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "role" and value.lower().strip() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
        if key in ("class", "id") and name not in ("html", "body"):
            for word in value.split():
                parts = re.split(r"[-_:.]+", _CAMEL.sub("-", word))
                lowered = [p.lower() for p in parts]
                if name in ARTICLE:
                    # Of the article itself only a name that is wholly one of these counts, as a comment's.
                    if len(lowered) == 1 and lowered[0] in NAMES:
                        return True
                elif lowered[0] in NAMES or (lowered[-1] in NAMES and lowered[0] not in ABOUT):
                    return True
    return False


Line = tuple[str, int, bool, int]


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order: text, weight, inside an article, and the element they stand in (of an article: the outermost).

    Stripped parts and the ends of articles leave empty lines of weight 0.
    """
    found: list[Line] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, set aside, article
    places = [0]  # of the open elements: their own number, or that of the article around them
    open_names: dict[str, int] = {}
    aside = articles = links = elements = 0
    at = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                weight = 0 if linked > LINKED * len(text) else len(text)
                found.append((text, weight, articles > 0, places[-1]))
            parts.clear()
        linked = 0

    def gap() -> None:
        found.extend([("", 0, False, -1)] * WINDOW)

    def pop_to(name: str) -> None:
        nonlocal aside, articles
        while stack:
            top, is_aside, is_article = stack.pop()
            places.pop()
            open_names[top] -= 1
            if is_aside:
                aside -= 1
                parts.clear()
                if not aside:
                    gap()
            articles -= is_article
            if is_article and not articles:
                gap()
            if top == name:
                return

    size = len(page)
    while at < size:
        markup = page.find("<", at)
        text_end = size if markup < 0 else markup
        if text_end > at and not aside:
            text = page[at:text_end]
            parts.append(text)
            if links:
                linked += len(text.strip())
        if markup < 0:
            break
        match = _MARKUP.match(page, markup)
        if not match:  # a lone sign
            if not aside:
                parts.append("<")
            at = markup + 1
            continue
        at = match.end()
        name = match.group(2) or match.group(5)
        if not name:
            continue
        name = name.lower()
        closing = bool(match.group(1) or match.group(4))
        if name in BLOCKS and not aside:
            close_block()
        if closing:
            if name == "a":
                links = max(0, links - 1)
            elif open_names.get(name):
                pop_to(name)
            continue
        attributes = match.group(3) if match.group(2) else match.group(6)
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name == "a":
            links += 1
        if name == "body":  # a head left open ends here
            if open_names.get("head"):
                pop_to("head")
        if name in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
            pop_to(name)  # an end tag left out
        set_aside = _set_aside(name, attributes, articles > 0)
        # Inline elements are followed only where they are set aside, paragraphs likewise: others may stay open.
        if set_aside or (name in BLOCKS and name not in ("p", "li", "dt", "dd", "tr", "td", "th", "option")):
            if set_aside and not aside:
                close_block()
                gap()
            is_article = name in ARTICLE and not set_aside and not aside
            if is_article and not articles:
                gap()
            elements += 1
            places.append(places[-1] if articles else elements)
            stack.append((name, set_aside, is_article))
            open_names[name] = open_names.get(name, 0) + 1
            aside += set_aside
            articles += is_article
    if not aside:
        close_block()
    return found


def main_text(page: str | None) -> str:
    """The text of the heavier side, in page order, a block to a line; empty for null, empty or textless pages.

    A page without any surge has its highest stretch for a surge.
    """
    lines = lines_of(page or "")
    weights = [weight * IN_ARTICLE if inside else weight for _, weight, inside, _ in lines]
    stretches = surges(weights)
    if not stretches:
        # Without weight, links at most.
        return "\n".join(text for text, *_ in lines if text)
    totals = {True: 0, False: 0}
    for begin, end in stretches:
        for i in range(begin, end):
            totals[lines[i][2]] += weights[i]
    side = totals[True] >= totals[False]
    kept, places = set(), set()
    for begin, end in stretches:
        heavy = [i for i in range(begin, end) if weights[i] and lines[i][2] == side]
        if heavy:
            kept.update(range(heavy[0], heavy[-1] + 1))
            for i in heavy:
                places.add(lines[i][3])
    for i, (text, weight, inside, place) in enumerate(lines):
        # What stands beside the text: all of an article; elsewhere lines that are not links.
        if text and inside == side and place in places and (inside or weight):
            kept.add(i)
    return "\n".join(lines[i][0] for i in sorted(kept) if lines[i][0] and lines[i][2] == side)


def surges(weights: list[int]) -> list[tuple[int, int]]:
    """From where the window's sum rises above nothing to where it dives to nothing again, if it surges between.

    If it nowhere does, the highest such stretch; none without weight.
    """
    sums, total = [], 0
    for i, weight in enumerate(weights):
        total += weight - (weights[i - WINDOW] if i >= WINDOW else 0)
        sums.append(total)  # of the window that ends here
    found: list[tuple[int, int]] = []
    best: tuple[int, list[tuple[int, int]]] = (0, [])
    i, size = 0, len(sums)
    while i < size:
        j = i
        while j < size and sums[j]:
            j += 1
        height = max(sums[i:j], default=0)
        if height >= SURGE:
            found.append((i, j))
        elif height > best[0]:
            best = (height, [(i, j)])
        i = max(j, i + 1)
    return found or best[1]


def extract(pages: DataFrame) -> DataFrame:
    """``row`` (every input column) and ``text`` of every page, from its whole html.

    Null and empty html give an empty text. Character references are decoded, white space inside a block becomes one
    space; nothing is cut. Rows are kept one for one, repeated ones alike; an empty table gives an empty result; other
    columns may have any names. Rows are independent, so this is one pass without a shuffle.
    """
    rows = pages.select(F.struct("*").alias("row"), F.col("html").cast("string").alias("html"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return rows.mapInArrow(run, schema)
