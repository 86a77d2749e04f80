"""HTML extraction by two-pass block rules.

The whole page is scanned once into text blocks. Pass 1 decides each block on its own: what stands in a menu, header,
footer, sidebar, notice, advert, form or reader comment is boilerplate; of the rest, link density, length and stop-word
density make it good, bad, near-good or short. An article or main element is evidence and no verdict: in one, running
text is good at a smaller length, a block without stop words is near-good instead of bad (it may be a table, code, or a
language without a list), and a block of links is bad only in a row of such blocks (a list of links) and short alone.
Pass 2 gives ambiguous blocks the label of their nearest decided neighbours; in an article only neighbours of that
article count, both sides must be bad to make a block bad, and where none is decided the article's blocks are good.
Where a whole page has no good block, its undecided blocks are good.

Defined results: null html is empty; a page without main text gives an empty string; unclosed and stray tags are
tolerated (an unclosed script or style hides the rest of the page, as in browsers; no other element does); character references are decoded; white space inside a block is one space; repeated rows come back once
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Blocks from this many characters on can be decided alone.
SHORT, LONG = 70, 200
LINKS_BAD, LINKS_ALONE = 0.35, 0.8
STOP_LOW, STOP_HIGH = 0.12, 0.22

STOP_WORDS = frozenset(
    (
        "the of and to in a is that for it with as was on be by at this are from or an have not but they his her you we "
        "der die und das ist von mit den zu im ein eine nicht sich auch für auf dem des als an es wie bei oder aus sie er "
        "le la les de et du un une est pour dans que qui sur avec pas par ce il elle au aux ne se plus sont ou "
        "el los las y en por con para no del al lo su una como más pero sus este esta o son fue ha si"
    ).split()
)
_SKIPPED = frozenset("script style noscript template head title svg iframe object select option datalist textarea button canvas audio video map".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BAD_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Names that say what a container's text is, and names of places in a layout. A wrapper may be named after a place
#: that it merely makes room for, so an article or main element inside one of those counts again.
_BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|share|sharing|social|related|recommended|comments?|commentlist|respond|reply|replies|"
    r"disqus|newsletter|subscribe|signup|popup|modal|overlay|login)(?=$|[\s_-])",
    re.IGNORECASE,
)
_PLACE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:banner|notice|alert|side-?bar|menu|nav|navbar|navigation|footer|header|masthead|breadcrumbs?|pagination|pager|widget|toolbar|search)(?=$|[\s_-])",
    re.IGNORECASE,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    article: int
    heading: bool
    label: str = ""


def _bad_container(tag: str, attributes: str, in_article: bool) -> int:
    """2 where the container's text is no main text, 1 where only its name hints at a place, else 0."""
    if tag in _BAD_TAGS or (tag == "header" and not in_article):
        return 2
    if not attributes.strip():
        return 0
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in _BAD_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return 2
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return 2
    if tag in ("body", "html", "main"):
        return 0
    names = f"{found.get('class', '')} {found.get('id', '')}"
    return 2 if _BAD_NAMES.search(names) else int(bool(_PLACE_NAMES.search(names)))


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, with what their containers say about them."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = []  # tag, bad, article, skipped
    pieces: list[tuple[str, bool]] = []
    links, articles, heading = 0, 0, False
    bad, article, skipped = 0, 0, False

    def flush() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join(html.unescape("".join(t for t, _ in pieces)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(t for t, inside in pieces if inside)).split()))
                out.append(Block(text, linked, bad > 0, article, heading))
            pieces = []

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not skipped:
            pieces.append((text, links > 0))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _BLOCKS:
            flush()
            heading = not closing and tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if tag == "br":
            pieces.append((" ", links > 0))
        elif tag == "a":
            links = max(0, links - 1) if closing else 1
        elif tag in _VOID:
            continue
        elif tag in _RAW and not closing:
            close = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end if tag in ("script", "style") else at
        elif tag == "p":
            links = 0
        elif tag in _BLOCKS or tag in _SKIPPED:
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                links = 0
            else:
                if tag in ("article", "main") and not article:
                    articles += 1
                    inside = articles
                    bad = bad if bad > 1 else 0
                else:
                    inside = article
                stack.append((tag, max(bad, _bad_container(tag, m[3], article > 0)), inside, skipped or tag in _SKIPPED))
            _, bad, article, skipped = stack[-1] if stack else ("", 0, 0, False)
    flush()
    return out


def _alone(b: Block, in_list: bool) -> str:
    """Pass 1: good, bad, near or short, from what the block itself shows."""
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    links, n = b.linked / len(b.text), len(b.text)
    if b.bad or in_list or (links > LINKS_BAD and not b.article):
        return "bad"
    if links > LINKS_ALONE:
        return "short"
    if n < SHORT:
        return "bad" if b.linked and not b.article else "short"
    if stops >= STOP_HIGH and links <= LINKS_BAD:
        return "good" if n >= LONG or b.article else "near"
    return "near" if stops >= STOP_LOW or b.article else "bad"


def classify(found: list[Block]) -> None:
    """Label every block good or bad."""
    linked = [b.linked > LINKS_ALONE * len(b.text) and not b.heading for b in found]
    n = len(found)
    for i, b in enumerate(found):
        beside = [j for j in (i - 1, i + 1) if 0 <= j < n and linked[j] and found[j].article == b.article]
        b.label = _alone(b, linked[i] and bool(beside))
    decided = [b.label if b.label in ("good", "bad") else "" for b in found]

    def nearest(i: int, step: int) -> str:
        j = i + step
        while 0 <= j < n and (not found[i].article or found[j].article == found[i].article and not found[j].bad):
            if decided[j]:
                return decided[j]
            j += step
        return ""

    for i, b in enumerate(found):
        if decided[i]:
            continue
        sides = {nearest(i, -1), nearest(i, 1)} - {""}
        if b.article:
            b.label = "bad" if sides == {"bad"} else "good"
        elif sides == {"good"} or (b.label == "near" and "good" in sides):
            b.label = "good"
        elif b.heading and nearest(i, 1) == "good":
            b.label = "good"
        else:
            b.label = "bad"
    if not any(b.label == "good" for b in found):  # nothing to inherit from: what no rule speaks against stays
        for b, known in zip(found, decided):
            b.label = known or "good"


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify(found)
    return " ".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; row-local, no shuffle."""

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in column], dtype="object")

    return pages.select("page_id", "url", text_of("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
