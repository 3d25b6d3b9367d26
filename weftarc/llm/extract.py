"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped to lines, one for each block-level element. A line weighs its characters, those in links by ``LINK`` of
them. Markup only changes weights: a line in a container of menus, headers, footers, sidebars, notices, adverts, forms or
reader comments (told by element, role, class or id) weighs nothing and stands as one empty line for the whole container;
outside of the article that a page marks, lines weigh nothing, and inside ``MARKED`` times as much. Where no article is
marked, lines most of which is link text weigh nothing. Weights are summed over windows of ``WINDOW`` lines; the text
surges where a window becomes positive after empty ones and dives where a window is empty again. What stands between a
surge and its dive is kept if some window there has at least ``SURGE``, or if it has the most of all.

Defined cases: a null or empty html gives an empty text; an element that is never closed ends with what contains it or
with the page; an unfinished tag at the end is dropped; white space is what str.split() splits on; <br> is white space;
rows that repeat give equal rows; null ids and URLs are kept; further columns are ignored; nothing is capped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftarc.llm.common import arrow, slices

WINDOW, SURGE, LINKS = 3, 60, 0.5
LINK, MARKED = 0.5, 64

TOKEN = re.compile(r"<!--(?:-?>|.*?--!?>|.*)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
ASIDE = frozenset("nav footer aside form menu dialog search button select fieldset object svg canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: Words of a class or id that tell a container beside the article.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted menu nav navbar navigation breadcrumb breadcrumbs sidebar widget "
    "widgets related recommended share sharing social cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search "
    "comment comments discussion disqus reply replies respond footer masthead copyright disclaimer toolbar pagination pager taboola outbrain paywall".split()
)
AROUND = frozenset("has have with without no is".split())  # `has-sidebar` is said of what is around one
NEVER = frozenset("html body article main".split())  # have no such meaning by their class, comments aside
COMMENTS = frozenset("comment comments reply replies".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Line:
    text: str
    article: bool
    main: bool
    links: int


def _beside(name: str, attributes: str, inside: bool) -> bool:
    """Whether a start tag opens a container beside the article; inside: it stands in the marked article."""
    if name in ASIDE or name == "header" and not inside:
        return True
    if not attributes.strip():
        return False
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(attributes)}
    names = [[w.lower() for w in WORDS.findall(n)] for k in ("class", "id") for n in found.get(k, "").split()]
    words = {w for n in names if n and n[0] not in AROUND for w in n}
    if name in NEVER:
        return name != "body" and bool(words & COMMENTS)
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    return found.get("role", "").lower() in ROLES or bool(words & BESIDE) or not inside and "header" in words


def lines(page: str, forms: bool = True, told: bool = True) -> list[Line | None]:
    """The text lines of a page in order, with None where a container beside the article stood.

    forms: False takes a form for an ordinary container, as pages do that stand in one as a whole. told: False takes all
    containers for ordinary ones, so that only text and link lengths and the marked article are left to go by.
    """
    out: list[Line | None] = []
    parts: list[str] = []
    article = main = link = links = depth = within = 0
    skip = ""
    at = 0

    def flush() -> None:
        nonlocal links
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Line(text, article > 0, main > 0, links))
            parts.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text and not skip:
            text = entities.unescape(text)
            parts.append(text)
            if link:
                links += len(text.strip())

    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        if not m[4]:
            break  # an unfinished tag
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if skip:
            if closing:
                depth -= name == skip
                if name in ("article", "main", "body", "html"):
                    within -= 1
                over = depth <= 0 or within < 0
            else:
                depth += name == skip and name != "p" and name not in VOID
                within += name in ("article", "main")
                over = skip == "p" and name in BLOCKS
            if not over:
                continue
            ended = closing and name == skip
            skip = ""
            out.append(None)
            if ended:
                continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if closing:
            article -= name == "article" and article > 0
            main -= name == "main" and main > 0
            link -= name == "a" and link > 0
            continue
        if told and name not in VOID and _beside(name, m[3] or "", article + main > 0) and (forms or name not in ("form", "fieldset")):
            flush()
            out.append(None)
            skip, depth, within = name, 1, 0
            continue
        article += name == "article"
        main += name == "main"
        link += name == "a"
        if name in BLOCKS:
            link = 0 if name != "a" and not article else link
    else:
        add(page[at:])
    flush()
    return out


def weigh(found: list[Line | None], marks: bool = True) -> list[float]:
    """The weights of lines. marks: False takes no article for marked."""
    mark = next((k for k in ("article", "main") if marks and any(x and getattr(x, k) for x in found)), None)
    if mark:
        return [MARKED * (len(x.text) - LINK * min(x.links, len(x.text))) if x and getattr(x, mark) else 0.0 for x in found]
    return [len(x.text) - LINK * x.links if x and x.links <= LINKS * len(x.text) else 0.0 for x in found]


def spans(weights: list[float], window: int = WINDOW) -> list[tuple[int, int, float]]:
    """(surge, dive, largest window) of each stretch, by the sums of all windows of so many lines.

    A stretch is a longest run of windows with weight: from the first line with weight in them to behind the last.
    """
    sums = [0.0] * (window - 1) + list(weights) + [0.0] * (window - 1)
    sums = [sum(sums[i : i + window]) for i in range(len(weights) + window - 1)]  # window i ends with line i
    found, start = [], None
    for i, s in enumerate([*sums, 0.0]):
        if s > 0 and start is None:
            start = i
        elif s <= 0 and start is not None:
            found.append((start, i - window + 1, max(sums[start:i])))  # the last line with weight left the window
            start = None
    return found


def main_text(page: str | None, told: bool = True, marks: bool = True) -> str:
    """The blocks of the article, joined by an empty line."""
    if not page:
        return ""
    for forms in (True, False):
        if text := _kept(lines(page, forms, told), marks):
            return text
    return ""


def _kept(found: list[Line | None], marks: bool = True) -> str:
    weights = weigh(found, marks)
    stretches = spans(weights)
    most = max((p for *_, p in stretches), default=0)
    kept = [(a, b) for a, b, p in stretches if p >= SURGE or p == most]
    return "\n\n".join(found[i].text for a, b in kept for i in range(a, b) if weights[i])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html"):
        texts = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as (page_id, url, text, n_chars)."""
    return arrow(_extract, pages.selectExpr("cast(page_id as bigint) page_id", "url", "html"), "page_id long, url string, text string, n_chars long")


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
