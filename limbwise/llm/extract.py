"""Main text of web pages by line-block distribution (operator 4).

Markup is stripped, one line per block element; script, style and the like go with their content. Every line has a weight, the length of
its text; it is zero in menus, headers, footers, sidebars, notices, adverts, forms and reader comments
(known by element, role, or a class or id that is made of role words alone), and outside the article or main element where a page has
one. Headers inside an article belong to it. An element is not set aside when the only article or main element stands in it, or, unless it is
a navigation, footer or comments element beside other text, when it holds more than half of the text of its article or page. In pages without article and main, link text has no weight. Weights are summed over a sliding window of
``WINDOW`` lines. Text begins where the sum surges to a threshold and ends where it dives to zero; in
pages that mark their article any weight is a surge, in others ``SURGE`` characters are needed. Articles and runs of which
more than half is link text are teasers and left out beside others. Lines without weight are dropped inside a run too.

Character references are decoded once, white space in a block becomes one blank, blocks are joined by a line feed.
``br`` is white space. Null or empty html, or a page without main text: an empty text. Repeated rows get equal
texts. Pages are handled one by one whole, so a long page costs only its own length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, SURGE = 3, 60
_SKIPPED = "script|style|noscript|template|title|svg|math|iframe|object|textarea|select|button|canvas|audio|video"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_SKIPPED})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)>|<[!?/][^>]*>", re.S | re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_HOLDERS = frozenset(
    "address article aside blockquote body center details dialog div dl fieldset figure footer form head header html main menu nav ol section "
    "table tbody td tfoot th thead tr ul span p li a h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav footer aside form menu dialog head".split())
_CLOSED_BY = {"p": _BLOCKS, "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}
_NAMED = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_ROLE = re.compile(
    r"ads?|adverts?|advertis\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|"
    r"sidebar|complementary|menu|nav|navbar|navigation|breadcrumbs?|footer|contentinfo|header|masthead|topbar|toolbar|comments?|commentlist|"
    r"respond|repl(?:y|ies)|disqus|social|share|sharing|related|recommend\w*|widgets?|login|signup|search|pagination|pager|copyright|"
    r"legal|disclaimer")
_HEADS = frozenset(["header", "masthead", "banner"])
#: Words beside role words in a name that do not change what it says: "site-footer" is a footer, "has-sidebar" is no sidebar
_NEUTRAL = frozenset(
    "site main page top bottom left right upper lower box list area bar inner outer wrap wrapper container block section content group item items "
    "link links icon icons button buttons slot unit primary secondary global mobile desktop sticky fixed posts articles stories form".split())
#: Kept aside even with most of the text, if there is other text
_FIRM = re.compile(r"nav|navbar|navigation|menu|footer|contentinfo|comments?|commentlist|respond|repl(?:y|ies)|disqus")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)


def _roles(attributes: str) -> set[str]:
    """Role words of an element; a name counts when it is made of them and neutral words alone."""
    out: set[str] = set()
    for m in _NAMED.finditer(attributes):
        value = m[2].strip("\"'").lower().replace("_", "-").replace("side-bar", "sidebar").replace("sign-up", "signup")
        for name in ["-".join(value.split())] if m[1].lower() == "aria-label" else value.split():
            words = [w for w in name.split("-") if w and not w.isdigit() and w not in _NEUTRAL]
            if all(_ROLE.fullmatch(w) for w in words):
                out.update(words)
    return out


def _aside(name: str, attributes: str, inside: bool) -> tuple[bool, int]:
    """Is an element set aside; does it stay so with most of the text: 0 no, 1 if there is other text, 2 yes."""
    if name in _ASIDE or name == "header" and not inside:
        return True, 0 if name == "form" else 2
    if name in ("body", "html", "main") or not attributes:
        return False, 0
    roles = _roles(attributes)
    if inside:
        roles -= _HEADS
    return bool(roles), int(any(_FIRM.fullmatch(r) for r in roles))


def lines_of(html: str) -> list[tuple[str, int, int, int]]:
    """Lines of a page: text, length without link text, number of the region it stands in, and is it set aside.

    Region 0 is the page, -1 a main element, others are article elements in page order.
    """
    out: list[tuple[str, int, int, tuple[int, ...] | None]] = []
    stack: list[tuple[str, tuple[int, ...] | None, int]] = []     # name, elements set aside around it (None: hidden), region
    aside, region, articles, links = (), 0, 0, 0
    firm: list[int] = []                        # of each element set aside: does it stay so with most of the text
    within: list[int] = []                      # the region it stands in
    around: dict[int, tuple[int, ...]] = {}     # elements set aside around a region
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join([p for p, _ in parts])).split())
            if text:
                plain = "".join([p for p, linked in parts if not linked])
                out.append((text, len(text) if plain is text else len(" ".join(unescape(plain).split())), region, aside))
            parts.clear()

    def close(at: int) -> None:
        nonlocal aside, region, links
        if any(s[0] in _BLOCKS for s in stack[at:]):
            flush()
        links -= sum(s[0] == "a" for s in stack[at:])
        del stack[at:]
        aside, region = (stack[-1][1], stack[-1][2]) if stack else ((), 0)
    at = 0
    for token in _TOKEN.finditer(html):
        if token.start() > at:
            parts.append((html[at:token.start()], links > 0))
        at = token.end()
        name = (token[3] or token[6] or "").lower()
        if not name:
            continue
        if token[2] or token[5]:
            if name in _BLOCKS:
                flush()
            if name in _HOLDERS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
            continue
        if name == "br":
            parts.append((" ", links > 0))
        if name in _BLOCKS:
            flush()
            if name == "body":
                stack[:] = [s for s in stack if s[0] != "head"]
                aside = stack[-1][1] if stack else ()
            while stack and name in _CLOSED_BY.get(stack[-1][0], ()):
                close(len(stack) - 1)
        if name in _HOLDERS and name not in _VOID and not (token[4] or token[7] or "").endswith("/"):
            now, here, attributes = aside, region, token[4] or token[7] or ""
            if aside is not None:
                if name == "head" or attributes and name not in ("body", "html", "main") and _HIDDEN.search(attributes):
                    now = None
                else:
                    is_aside, stays = _aside(name, attributes, region > 0)
                    if is_aside:
                        now = (*aside, len(firm))
                        firm.append(stays)
                        within.append(region)
            if now is None:
                pass
            elif name == "article" and region <= 0:
                articles += 1
                here = articles
                around[here] = now
            elif name == "main" and region == 0:
                here = -1
                around[here] = now
            stack.append((name, now, here))
            aside, region = now, here
            links += name == "a"
    if at < len(html):
        parts.append((html[at:], links > 0))
    flush()
    return settled(out, firm, within, around)


def settled(lines: list, firm: list[int], within: list[int], around: dict[int, tuple[int, ...]]) -> list[tuple[str, int, int, int]]:
    """Lines with the elements set aside around them replaced by whether that holds."""
    shown = [x for x in lines if x[3] is not None]
    free: set[int] = set()      # elements that are not set aside after all
    sizes: dict[int, int] = {}
    for text, _, region, _ in shown:
        sizes[region] = sizes.get(region, 0) + len(text)
    marked = {r: n for r, n in sizes.items() if r > 0} or {r: n for r, n in sizes.items() if r == -1}
    if marked and all(around[r] for r in marked):
        free.update(around[max(marked, key=lambda r: marked[r])])
    has_article = any(r > 0 and free.issuperset(around[r]) for r in marked)
    total: dict[int, int] = {}
    held = [0] * len(firm)
    for _, plain, region, aside in shown:
        for r in {0, region}:
            total[r] = total.get(r, 0) + plain
        for i in aside:
            held[i] += plain
    for level in (0, 1):
        free.update(i for i, n in enumerate(held) if firm[i] <= level and (within[i] > 0 or not has_article) and 2 * n > total.get(max(within[i], 0), 0))
        if any(free.issuperset(x[3]) for x in shown):
            break
    return [(text, plain, region, aside is None or not free.issuperset(aside)) for text, plain, region, aside in lines]


def teaser(plain: int, text: int) -> bool:
    return 2 * plain < text


def weights(lines: list[tuple[str, int, int, int]]) -> tuple[list[int], bool]:
    """Weight of every line, and does the page mark its article."""
    sums: dict[int, tuple[int, int]] = {}
    for text, plain, region, aside in lines:
        if not aside:
            n, m = sums.get(region, (0, 0))
            sums[region] = (n + plain, m + len(text))
    articles = {r for r in sums if r > 0}
    if articles:
        chosen = {r for r in articles if not teaser(*sums[r])} or articles
    else:
        chosen = {-1} if -1 in sums else set()
    if chosen:
        return [0 if aside or region not in chosen else len(text) for text, _, region, aside in lines], True
    return [0 if aside else plain for _, plain, _, aside in lines], False


def runs(weight: list[int], surge: int) -> list[tuple[int, int]]:
    """Lines from each surge of the windowed sum to the next dive to zero."""
    found, begin, n = [], None, len(weight)
    for i in range(n):
        total = sum(weight[i:i + WINDOW])
        if begin is None and total >= surge:
            begin = i
        elif begin is not None and total == 0:
            found.append((begin, i))
            begin = None
    if begin is not None:
        found.append((begin, n))
    return found


def main_text(html: str | None) -> str:
    if not html:
        return ""
    lines = lines_of(html)
    weight, marked = weights(lines)
    found = runs(weight, 1 if marked else SURGE)
    if not marked:
        length = [0 if aside else len(text) for text, _, _, aside in lines]
        found = [(a, b) for a, b in found if not teaser(sum(weight[a:b]), sum(length[a:b]))] or found
    return "\n".join([lines[i][0] for a, b in found for i in range(a, b) if weight[i]])


@F.pandas_udf(T.StringType())
def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(main_text)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    return pages.select("page_id", "url", extracted("html").alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
