"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Lines of menus, headers, footers,
sidebars, notices, adverts, forms and comments count as empty, by element and by class or id;
where the page marks its article and a window inside it surges, lines outside it do too, and
those inside weigh ``MARKED`` times their length. On every page text lengths are summed over
sliding windows of lines: where a sum reaches ``SURGE`` there is a body of text, which reaches
both ways to where the sums fall below ``DIVE``. Every body is kept, in page order, with the
short paragraphs and headings its windows take in. A page without a surge keeps its marked
lines, or all if none are marked.

Null, empty and text-free pages give the empty text. Each input row gives one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from .shared import table

#: Lines in a window, and the characters in one at which a body of text begins.
WINDOW, SURGE = 3, 80
#: The characters in a window below which a body ends, and in a line below which it is cut from a body's edge unless it is a paragraph, heading or the like.
DIVE, SCRAP = 40, 10
#: How much more a character inside a marked article weighs.
MARKED = 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>|\Z", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "math", "object", "video", "audio", "canvas")}
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_DROP = frozenset("nav footer aside form head button menu dialog fieldset label".split())
#: Elements of running text: a short line of theirs still belongs to the body it adjoins.
_SOLID = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption caption td th".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end may be left out: they end with the next block, so they are not kept open.
_LOOSE = frozenset("p li dd dt td th tr option tbody thead tfoot html body".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banners?|breadcrumbs?|byline-ads|comments?|commentlist|cookies?|consent|disclaimer|disqus|footers?|gdpr|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo\w*|recommend\w*|related|replies|respond|share|sharing|sidebar\w*|signup|site-?header|skip-link|social|sponsor\w*|subscribe|toolbar|widgets?)(?:$|[\s_-])",
    re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu alert dialog".split())


def _judge(tag: str, attributes: str) -> str:
    """'drop', 'main' or ''. """
    if tag in _DROP:
        return "drop"
    main = tag in ("article", "main")
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and _NAMED.search(value) and tag not in ("body", "html", "article", "main"):
            return "drop"
        if name == "role" and value.lower() in _ROLES or name == "hidden" and not value or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return "drop"
        main |= name == "role" and value.lower() == "main" or name == "itemprop" and value.lower() == "articlebody"
    return "main" if main else ""


def lines(html: str) -> list[tuple[str, bool, int, bool]]:
    """(text, inside a marked article, link characters, in an element of running text) of each line; dropped ones are empty."""
    out: list[tuple[str, bool, int, bool]] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, str]] = []
    drop = main = anchor = 0
    loose = ""  # a dropped element whose end may be missing
    solid = False

    def flush() -> None:
        nonlocal linked
        line = " ".join(unescape("".join(text)).split()) if text else ""
        out.append((line, main > 0, min(linked, len(line)), solid))
        text.clear()
        linked = 0

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        piece = html[at : m.start() if m else end]
        if piece and not drop and not loose:
            text.append(piece)
            if anchor:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW and not closing:
            at = _RAW[tag].search(html, at).end()
            continue
        if tag in _BLOCK:
            flush()
            solid = tag in _SOLID and not closing or tag == "br" and solid
            if loose and (tag == loose or not closing or tag not in _LOOSE):
                loose = ""
        if tag == "a":
            anchor = 0 if closing else 1
        if tag in _VOID:
            continue
        if closing:
            if any(t == tag for t, _ in stack):
                while stack:
                    t, kind = stack.pop()
                    drop -= kind == "drop"
                    main -= kind == "main"
                    if t == tag:
                        break
            continue
        kind = _judge(tag, m[3])
        if tag == "header" and not main:
            kind = "drop"
        if tag in _LOOSE:
            loose = tag if kind == "drop" else loose
        elif tag in _BLOCK or kind:
            stack.append((tag, kind))
            drop += kind == "drop"
            main += kind == "main"
    flush()
    return out


def bodies(found: list[tuple[str, int, bool]]) -> list[str]:
    """The lines of every body of text among (line, weight, solid): from each surge, both ways, to where the sums dive."""
    sums = [sum(weight for _, weight, _ in found[i : i + WINDOW]) for i in range(max(len(found) - WINDOW, 0) + 1)]
    out, i, done = [], 0, 0
    while i < len(sums):
        j = i
        while j < len(sums) and sums[j] >= DIVE:
            j += 1
        if j > i and max(sums[i:j]) >= SURGE:
            begin, stop = max(i, done), min(j - 1 + WINDOW, len(found))
            while not found[begin][2] and found[begin][1] < SCRAP:
                begin += 1
            while not found[stop - 1][2] and found[stop - 1][1] < SCRAP:
                stop -= 1
            out += [line for line, _, _ in found[begin:stop]]
            done = stop
        i = max(j, i + 1)
    return out


def main_text(html: str | None) -> str:
    """The page's main text, blocks joined by one space."""
    if not html:
        return ""
    found = lines(html)
    # a paragraph or heading inside the mark is text however short: only other lines can make the sums dive there
    article = [(line, max(MARKED * len(line), DIVE * solid), solid) for line, inside, _, solid in found if line and inside]
    if kept := bodies(article):
        return " ".join(kept)
    # no mark, or nothing surges inside it: the lines of the whole page; those that are mostly links are menus
    page = [(line, len(line) - links, solid) for line, _, links, solid in found if line and not (links and 2 * links >= len(line))]
    return " ".join(bodies(page) or [line for line, _, _ in article or page])


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its code points of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
