"""Main text of HTML pages by the distribution of text over lines.

Markup is stripped first: a tokenizer walks the page once and writes one line per block with text (a block-level tag or line
break ends a line, an inline tag doesn't), with character references decoded and white space folded. Tags only take
lengths away: an element that is never article text (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments, known by tag, role, class or id) is one line of length 0; so is a line that is mostly links;
and so is each line outside of article and main where these hold half of the page's text or more. The sums of the lengths
over sliding windows of WINDOW lines then show the dive points (windows without text) and, between two of them, whether
there is a surge (a window that reaches SURGE characters, or half of the page's highest window where that is less).
From a surge's first to its last line all text is kept, so that short paragraphs stay; what doesn't surge goes.

White space is what str.split takes for it: non-breaking and other Unicode spaces too.

Defined results: null html or no main text gives the empty text; pages of any length are read whole; unclosed tags end
with their parents or at the page's end; repeated rows are treated alike; other columns are carried along, those named
main_text and n_chars are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
MOST_LINKS = 0.5
#: Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
SELF_CLOSING = frozenset("p li option dt dd tr td th".split())
#: Elements and names that are never article text.
OUTSIDE = frozenset("head nav header footer aside form script style noscript template svg iframe object select button textarea dialog menu canvas audio video".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?|consent|notices?|alert|popup|modal|overlay|sidebar\w*|side|menu\w*|nav|navi|navigation|navbar|breadcrumbs?|header|footer|masthead|topbar|comments?|commentlist|disqus|replies|respond|related|recommended|share|sharing|social|newsletter|subscribe|subscription|signup|login|search|form|widget|pagination|pager|skip|toolbar|copyright|disclaimer)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
NEVER_BY_NAME = frozenset("html body article main".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*/?)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _left_out(tag: str, attributes: str) -> bool:
    if tag in OUTSIDE:
        return True
    if tag in NEVER_BY_NAME or "=" not in attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if value.lower().strip() in ROLES if name.lower() == "role" else NAMES.search(value):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """Lines (text, characters outside of links, inside article or main) of a page.

    Blocks without text leave none; an element that is left out leaves one without text.
    """
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = inside = links = 0
    out_tag, out_depth = "", 0

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append((text, max(0, len(text) - linked), inside > 0))
        parts, linked = [], 0

    at, size = 0, len(page)
    # no tag ends behind the last >: a search there would try every < up to the page's end
    last = page.rfind(">") + 1
    while at < size:
        m = TOKEN.search(page, at, last)
        if m and m.end() == last and m[0].startswith("<!--") and not m[0].endswith("-->"):
            break  # a comment that isn't closed
        text = page[at : m.start()] if m else page[at:]
        if text and not out_tag:
            parts.append(text)
            if links:
                linked += len(" ".join(html.unescape(text).split()))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and tag in RAW:  # its content isn't markup
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if out_tag:
            if not closing and (tag == "main" or tag == "article" and out_tag in ("head", "nav", "header")):
                out_tag = ""  # it was never closed
            elif tag == out_tag and tag not in VOID and not attributes.endswith("/"):
                out_depth += -1 if closing else 0 if tag in SELF_CLOSING else 1
                if out_depth > 0:
                    continue
                out_tag = ""
                continue
            elif closing and (tag in ("article", "main", "body") or out_tag in SELF_CLOSING and tag not in INLINE):
                out_tag = ""
            else:
                continue
        if tag == "a":
            links = 0 if closing else 1
        if tag not in INLINE:
            close()
        if tag in ("article", "main"):
            inside = max(0, inside + (-1 if closing else 1))
        elif not closing and tag not in VOID and not attributes.endswith("/") and _left_out(tag, attributes):
            out_tag, out_depth = tag, 1
            lines.append(("", 0, inside > 0))
    close()
    return lines


def main_text(page: str) -> str:
    lines = lines_of(page)
    told = sum(len(text) for text, *_ in lines)
    within = sum(len(text) for text, _, inside in lines if inside)
    if within and 2 * within >= told:
        lengths = [len(text) if inside else 0 for text, _, inside in lines]
    else:
        lengths = [len(text) if own >= MOST_LINKS * len(text) else 0 for text, own, _ in lines]
    sums = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    surge = min(SURGE, max(sums, default=0) / 2)
    kept, since, surged = [], [], False
    for (text, *_), n, total in zip(lines, lengths, sums, strict=True):
        if not total:  # a dive
            kept += since if surged else []
            since, surged = [], False
            continue
        surged = surged or total >= surge
        if n:
            since.append(text)
    return "\n".join(kept + (since if surged else []))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with main_text and n_chars instead of the html column."""

    def texts(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in it:
            yield pd.Series([main_text(x) if x else "" for x in batch.tolist()], dtype=object)

    got = pages.withColumn("main_text", F.pandas_udf(texts, "string")(F.col(column)))
    return got.withColumn("n_chars", F.length("main_text").cast("long")).drop(column)
