"""Main text of web pages by the line-block distribution.

Markup is stripped to lines, one per block, those of menus, adverts, footers and comments too. A line's weight is its length
without link text, times what markup says of it; weights are summed over a sliding window of lines. The page's own sums
give the threshold: where their logarithms fall into two classes that are far apart (``threshold``), it lies between
them, else it is zero. Text surges where the sum rises above the threshold and dives where it falls to it and stays there
for a window or until a gap; the lines between are a region (``regions``). All regions are the main text. A region is
stretched to lines of its article, to headings and paragraphs right before it, and to lines of paragraphs and lists after it, up to
a gap or a line without weight; short lines between two regions belong to the text if they aren't links.

What markup says, as factors of weights: lines in ``article`` or ``main`` count ``INSIDE`` times where these weigh a tenth
of the rest at least. Lines in elements whose class, id or role says sidebar, widget, header and the like count ``LOW``
times, for each of them. Lines in page headers, menus, asides, footers and forms have no weight outside an ``article`` or
``main`` of theirs, nor have those of adverts, notices, reader comments and links to other articles, unless their names say
"has", "no" or "with", or name an article as well, or they hold a ``main``. The factor that most of the weighted text has
is the page's own: a wrapper around all of it may be called sidebar. Lines of lesser factors don't ride on their
neighbours: they belong to a region only by their own weight. Lines of copyright notices have no weight outside articles.

Inside an article, asides, forms and elements named as adverts and the like make no lines; there only names that say
nothing else count (``class="ad"``, not ``class="social-history"``). Scripts, styles and hidden elements make none
anywhere. Nothing else is dropped or cut. Character references are decoded once, white space inside a block becomes one
blank, blocks are joined by a line feed; ``br`` ends a block. Should no text be left, the page is read without names.

Defined results: null or empty html, and pages without text, give an empty text; unclosed elements, comments and
quotes end with the page; tag soup and plain text are read as far as they go, whole and in time proportional to their
length, however long. Pages are worked off one by one, so repeated rows and null ids do no harm; an empty table gives no
rows. Only id, url and html are read, other columns may have any names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import map_batches, table

WINDOW = 3
CONTRAST = 4.0  # how many times as high sums of text must be, on average, for lower ones to be none
INSIDE, LOW, INSIDE_SHARE = 100.0, 0.01, 10

#: Fixed lists of element names.
RAW = "script|style|noscript|template|textarea|title|svg|math|iframe|object|canvas|audio|video|select"
BLOCKS = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = BLOCKS - {"br", "hr", "html", "body", "head"} | {"span", "a", "b", "i", "em", "strong", "label", "small"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = {"nav", "aside", "footer", "form", "button", "menu", "dialog", "search", "fieldset", "head"}
ARTICLE = {"article", "main"}
#: Of the dropped elements those that part a page's regions; others may stand between paragraphs of one text.
PAGE_PARTS = {"nav", "header", "footer", "menu", "head"}
#: Fixed list of words in class, id or role that mark what isn't article text.
MARKS = set(
    "nav navbar navigation menu menubar topbar header masthead footer bottombar sidebar aside complementary contentinfo widget ad ads adv advert advertisement adverts banner "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing "
    "social related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments disqus reply replies respond discussion search searchform toolbar".split()
)
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^'\">]*+(?:\"[^\"]*+\"[^'\">]*+|'[^']*+'[^'\">]*+)*+|[^>]*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Fixed list of words beside which "header" names the head of an article, not of the page.
OF_ARTICLE = {"article", "post", "entry", "story", "content", "main"}
#: Marks of what isn't the main text however much of it there is, and words that say that such a mark is about a wrapper's parts.
NEVER_MAIN = set(
    "comment comments disqus reply replies respond discussion ad ads adv advert advertisement adverts sponsor sponsored promo promotion cookie cookies consent gdpr "
    "popup modal overlay related recommended recommendations".split()
)
ABOUT_PARTS = {"has", "with", "no", "without", "open", "closed", "enabled", "disabled"}
#: Of the marks those that say enough as a whole name, in an article and on elements that hold single blocks too.
WHOLE_NAMES = set(
    "ad ads adv advert advertisement adverts sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup paywall "
    "share sharing sidebar breadcrumb breadcrumbs pagination pager comment comments disqus related recommended recommendations".split()
)
#: Those that say enough as a part of a name too, beside words that only name a place for them.
PART_WORDS = set("ad ads advert advertisement cookie comment comments newsletter share sharing sponsored".split())
PLACES = set("area areas section list box wrapper wrap container block bar buttons button links slot unit post entry article site page user reader inline top bottom side social inner main google".split())
#: Names of single blocks that may as well be about their text.
ABOUT_TEXT = set("share sharing related recommended comment comments notice consent".split())
#: Blocks of running text.
PROSE = set("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th caption figcaption".split())
SINGLE = set("p h1 h2 h3 h4 h5 h6 li td th dt dd span a b i em strong label small caption figcaption blockquote pre".split())
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)|.{0,80}\ball rights reserved\b", re.I)
BROKEN_TAG = re.compile(r"<(?=[a-zA-Z/!?])")


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by lower-case name; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def names_of(attributes: dict[str, str]) -> list[set[str]]:
    """The lower-case words of each name in class, id and role."""
    return [{p.lower() for p in PART.findall(name)} for key in ("class", "id", "role") for name in attributes.get(key, "").split()]


def marks_of(words: set[str]) -> set[str]:
    """Words of a name that say that the element isn't article text."""
    return words & MARKS - ({"header"} if words & OF_ARTICLE else set())


def is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(NOT_SHOWN.search(attributes.get("style", "")))


def is_marked(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether class, id or role say that the element isn't article text."""
    if not attributes:
        return False
    if not inside and name not in SINGLE:
        return any(marks_of(words) for words in names_of(attributes))
    given = [part for key in ("class", "id", "role") for part in attributes.get(key, "").split()]
    if any(part.lower() in WHOLE_NAMES and not (name in SINGLE and part.lower() in ABOUT_TEXT) for part in given):
        return True
    return name not in SINGLE and any(words & PART_WORDS and words <= PART_WORDS | PLACES for words in names_of(attributes))


def never_main(names: list[set[str]]) -> bool:
    """Whether an element of these names isn't the main text however much it holds."""
    if not any(marks_of(words) & NEVER_MAIN and not words & ABOUT_PARTS for words in names):
        return False
    return not any(words & OF_ARTICLE and not marks_of(words) for words in names)


class Line(NamedTuple):
    text: str
    weight: int  # characters outside links
    inside: bool  # an article
    depth: int  # named elements around it that make it count less; -1 if it has no weight at all
    prose: bool  # a block of running text


GAP = Line("", 0, False, 0, False)


def page_lines(page: str, by_name: bool = True) -> list[Line]:
    """Lines of text. Blank ones stand around articles, parts of the page and marked elements."""
    lines: list[Line] = []
    parts: list[str] = []
    linked, in_link, inside, dropping = 0, 0, 0, 0
    # Open elements outside articles: marked by name; without weight; and of the latter those that an article may stand in.
    low, never, parted = 0, 0, 0
    open_elements: list[tuple[str, str, int]] = []  # name, what it is (see above, or dropped), blank lines that it leaves
    n_open: Counter[str] = Counter()
    block_now = ""

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                weightless = never or parted and not inside
                lines.append(Line(text, max(0, len(text) - linked), inside > 0, -1 if weightless else low + (parted > 0), block_now in PROSE))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        """Close the elements from the k-th on."""
        nonlocal in_link, inside, dropping, low, never, parted
        for name, what, blank in reversed(open_elements[k:]):
            n_open[name] -= 1
            if what == "dropped":
                dropping -= 1
                continue
            if dropping:
                continue
            if what:
                end_line()
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in ARTICLE:
                end_line()
                inside = max(0, inside - 1)
            low, never, parted = low - (what == "low"), never - (what == "never"), parted - (what == "part")
            if not inside:
                lines.extend([GAP] * (WINDOW if name in ARTICLE else blank))
        del open_elements[k:]

    at, m, ends = 0, None, page.rfind(">") + 1  # beyond the last bracket no tag ends
    for m in TOKEN.finditer(page, 0, ends):
        if m.start() > at and not dropping:
            parts.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        block = name in BLOCKS
        if block and not dropping:
            end_line()
        if m[2]:
            if n_open[name]:
                close(next(k for k in range(len(open_elements) - 1, -1, -1) if open_elements[k][0] == name))
            if block:
                block_now = next((n for n, _, _ in reversed(open_elements[-4:]) if n in BLOCKS), "")
            continue
        if block and open_elements and open_elements[-1][0] == "p":
            close(len(open_elements) - 1)  # a block ends an open paragraph
        if block and name != "br":
            block_now = name
        if name in VOID or name not in CONTAINERS and name != "head" or m[4].endswith("/"):
            continue
        what = ""
        if not dropping:
            attributes = {} if not m[4] or m[4].isspace() else attributes_of(m[4])
            part = name in DROPPED or name == "header" and not inside
            marked = by_name and name != "header" and (name not in ARTICLE or inside > 0) and is_marked(name, attributes, inside > 0)
            if attributes and is_hidden(attributes) or inside and (name in DROPPED or marked):
                what = "dropped"
            elif by_name and (marked or part) and never_main(names_of(attributes)):
                what = "never"
            elif part:
                what = "part"
            elif marked:
                what = "low"
        blank = 0 if not what else WINDOW if name in PAGE_PARTS else 1
        if what and not dropping:
            end_line()
        open_elements.append((name, what, blank))
        n_open[name] += 1
        if what == "dropped":
            dropping += 1
        if dropping:
            continue
        low, never, parted = low + (what == "low"), never + (what == "never"), parted + (what == "part")
        if name == "a":
            in_link += 1
        elif name in ARTICLE:
            if not inside:
                lines.extend([GAP] * WINDOW)
            inside += 1
            if name == "main" and never:  # a wrapper after all, whatever its name
                low, never = low + never, 0
                open_elements[:] = [(n, "low" if w == "never" else w, b) for n, w, b in open_elements]
    left_open = m is not None and m.end() == ends and (m[0].startswith("<!--") and not m[0].endswith("-->") or m[1] and not re.search(rf"</{m[1]}\s*>\Z", m[0], re.I))
    if not left_open and not dropping:
        tag = BROKEN_TAG.search(page, ends)
        parts.append(page[at : tag.start() if tag else len(page)])
    end_line()
    return lines


def threshold(sums: list[float]) -> float:
    """What parts the sums of text from lower ones: none (0) unless the two classes that their logarithms fall into, by the
    greatest variance between classes, lie apart by a factor of ``CONTRAST``."""
    ordered = sorted(math.log(x) for x in sums if x > 0)
    total, best, cut, below = sum(ordered), 0.0, 0, 0.0
    for k in range(1, len(ordered)):
        below += ordered[k - 1]
        if ordered[k] > ordered[k - 1]:
            apart = below / k - (total - below) / (len(ordered) - k)
            if k * (len(ordered) - k) * apart * apart > best:
                best, cut, means = k * (len(ordered) - k) * apart * apart, k, -apart
    return math.exp((ordered[cut - 1] + ordered[cut]) / 2) if cut and means >= math.log(CONTRAST) else 0.0


def window_sums(weights: list[float], window: int = WINDOW) -> list[float]:
    """For each line the weight of the window that begins there."""
    return [sum(weights[k : k + window]) for k in range(len(weights))]


def surges(weights: list[float], blank: list[bool], least: float = 0.0, window: int = WINDOW) -> list[tuple[int, int]]:
    """Line ranges between a surge (the window's sum rises above ``least``) and the next dive: it is no higher, for a whole
    window or until lines without weight or the end of a gap."""
    sums, found, begin = window_sums(weights, window), [], None
    low = 0  # for how many lines the sum has been low
    for k, ahead in enumerate(sums):
        if begin is None:
            if weights[k] and ahead > least:
                begin, low = k, 0
            continue
        low = 0 if ahead > least else low + 1
        if not ahead or low == window:
            end = k + 1 - low if ahead else k
            found.append((begin, end))
            begin = None
    if begin is not None:
        found.append((begin, len(weights)))
    trimmed = []
    for a, b in found:
        while b > a and (blank[b - 1] or not weights[b - 1]):
            b -= 1
        if b > a:
            trimmed.append((a, b))
    return trimmed


def joined(found: list[tuple[int, int]], weights: list[float], blank: list[bool], window: int = WINDOW) -> list[tuple[int, int]]:
    """Regions with what lies between two of them, if it is neither a gap nor links."""
    out: list[tuple[int, int]] = []
    for a, b in found:
        between = range(out[-1][1], a) if out else ()
        gaps = [k for k in between if blank[k]]
        if between and all(weights[k] for k in between if not blank[k]) and len(gaps) < window:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def regions(weights: list[float], blank: list[bool], least: float = 0.0, window: int = WINDOW, lesser: list[bool] | None = None) -> list[tuple[int, int]]:
    """Line ranges between surges and dives, with what joins them. Lines of a lesser factor are passed over, and in no range."""
    seen = [k for k in range(len(weights)) if not (lesser and lesser[k])]
    found = surges([weights[k] for k in seen], [blank[k] for k in seen], least, window)
    out: list[tuple[int, int]] = []
    for a, b in joined(found, [weights[k] for k in seen], [blank[k] for k in seen], window):
        for k in seen[a:b]:
            if out and out[-1][1] == k and k > seen[a]:
                out[-1] = (out[-1][0], k + 1)
            else:
                out.append((k, k + 1))
    return out


def stretched(found: list[tuple[int, int]], lines: list[Line], weights: list[float]) -> list[tuple[int, int]]:
    """Regions with the rest of their articles, and with the running text right before and after them."""
    text = [bool(x.text) and w > 0 for x, w in zip(lines, weights, strict=True)]
    out, done = [], 0
    for a, b in found:
        while a > done and (text[a - 1] and (lines[a - 1].prose or lines[a - 1].inside) or lines[a - 1].inside and bool(lines[a - 1].text)):
            a -= 1
        while b < len(lines) and (text[b] and (lines[b].prose or lines[b].inside) or lines[b].inside and bool(lines[b].text)):
            b += 1
        if b > max(a, done):
            out.append((max(a, done), b))
        done = max(done, b)
    return out


def weighted(lines: list[Line]) -> tuple[list[float], list[bool], bool]:
    """The lines' weights, whether they are of a factor less than that of most of the text, and whether articles hold the text."""
    plain = [0 if x.depth < 0 or not x.inside and COPYRIGHT.match(x.text) else x.weight * LOW ** min(x.depth, 100) for x in lines]
    article = sum(len(x.text) * LOW ** min(x.depth, 100) for x in lines if x.inside and x.depth >= 0)
    marked = article > 0 and INSIDE_SHARE * article >= sum(w for x, w in zip(lines, plain, strict=True) if not x.inside)
    factors = [0.0 if x.depth < 0 else LOW ** min(x.depth, 100) * (INSIDE if marked and x.inside else 1) for x in lines]
    weights = [max(1, x.weight) * f if marked and x.inside else f and w * (f / LOW ** min(x.depth, 100)) for x, w, f in zip(lines, plain, factors, strict=True)]
    held: Counter[float] = Counter()
    for w, f in zip(weights, factors, strict=True):
        held[f] += w
    own = max(held, key=lambda f: held[f], default=0.0)
    return weights, [bool(x.text) and f < own / 2 for x, f in zip(lines, factors, strict=True)], marked


def text_of(lines: list[Line]) -> str:
    """The lines of the regions that hold the main text."""
    weights, lesser, marked = weighted(lines)
    blank = [not x.text for x in lines]
    most = max((w for w, low in zip(weights, lesser, strict=True) if not low), default=0.0)
    shown = [0.0 if low and w <= most / CONTRAST else w for w, low in zip(weights, lesser, strict=True)]  # a lesser line counts by its own weight
    passed = [low and w <= most / CONTRAST for w, low in zip(weights, lesser, strict=True)]
    sums = window_sums(shown)
    within = min((s for x, s, low in zip(lines, sums, lesser, strict=True) if marked and x.inside and not low), default=math.inf)
    least = min(threshold(sums), 0.99 * within)  # a short article beside a long one is no lower text
    found = stretched(regions(shown, blank, least, lesser=passed), lines, shown)
    return "\n".join(lines[k].text for a, b in found for k in range(a, b) if not blank[k])


def main_text(page: str | None) -> str:
    """The main text of one page."""
    page = page or ""
    return text_of(page_lines(page)) or text_of(page_lines(page, by_name=False))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""

    def extract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return map_batches(rows, extract, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))
