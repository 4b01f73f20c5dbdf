"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block elements. What stands in menus, page headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments, by element, role, or a name in its class or id, is decided
against from the start; a name counts whole or joined with words of page furniture, so cookie-notice does and
share-price does not, and names that an article's own parts may have need the looks of boilerplate there as well. The first pass decides the other blocks that show what they are: mostly link text is
boilerplate; enough stop words, or mere length, is text. The second pass gives each block still undecided, such
as headings and short lines, the label of the nearest decided block of its own region (the next one on a tie).
A region is an article or main element, or else the page; where articles have text, the rest of the page has none.

End tags that HTML lets out are implied: what can't stand in a head ends it; list items, terms, rows, cells, row groups,
options, headings and paragraphs end at their next sibling or where their list or table does, and an end tag reaches
no further than its table cell. A form that holds an article, or page furniture, is the page's frame and drops nothing.

Defined results: null and empty pages, and pages without main text, give the empty string; other unclosed elements end
with the page, unclosed tags and comments at its end are dropped; a char reference cut short stays as it is; rows
that repeat and null ids each give a row; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK_DENSITY = 0.5
STOP_DENSITY = 0.2
STOP_LENGTH = 40
LONG = 200

#: Frequent words of the languages served; fixed values.
STOP_WORDS = frozenset(
    """the of and to in a is that it for on was be with as by this are from or at an not have but
    de la le les et des un une du en est que dans qui pour pas au sur ne se par avec il ce plus son sont
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass
    el los las y del se por con no una su para lo como más pero sus al o este sí""".split()
)

BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th
    thead title tr ul""".split()
)
#: Elements that hold no main text. header counts only outside articles.
DROPPED = frozenset("aside button dialog footer form head header iframe menu nav noscript object select svg template".split())
RAW = "script|style|textarea|title|noscript|iframe|template|svg"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What a head may hold; anything else ends it.
HEAD_PARTS = frozenset("base link meta noscript script style template title head html".split())
#: Which open elements a start tag ends, and inside which it seeks them: the optional end tags of HTML. Fixed values.
_ITEM_SCOPE = (BLOCKS | DROPPED) - frozenset("address div p li dd dt".split())
_TABLE = frozenset(["table", "template", "html"])
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), _ITEM_SCOPE),
    "dd": (frozenset(["dd", "dt"]), _ITEM_SCOPE),
    "dt": (frozenset(["dd", "dt"]), _ITEM_SCOPE),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
    "td": (frozenset(["td", "th"]), _TABLE | {"tr"}),
    "th": (frozenset(["td", "th"]), _TABLE | {"tr"}),
    "tr": (frozenset(["tr", "td", "th", "caption"]), _TABLE | {"thead", "tbody", "tfoot"}),
    **dict.fromkeys(["thead", "tbody", "tfoot"], (frozenset(["thead", "tbody", "tfoot", "tr", "caption"]), _TABLE)),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: These start tags end an open paragraph.
ENDS_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr
    main menu nav ol p pre section summary table ul li dd dt""".split()
)
P_SCOPE = frozenset("button caption html object table td template th".split())
#: An end tag reaches no further than these.
CELLS = frozenset("td th caption table template object html".split())
#: Parts of a page's frame: a form that holds one is no form of the text.
FRAME = frozenset("article aside footer header main nav".split())
#: Names in a class, id or role that mark what an element holds; fixed values.
MARKS = frozenset(
    """ad ads advert advertisement adverts adsense adbox banner banners breadcrumb breadcrumbs consent contentinfo cookie cookies disclaimer
    footer gdpr masthead menu menus menubar modal nav navbar navigation navigationbar newsletter notice notices pagination paywall
    popup promo promoted promotion sidebar sponsor sponsored subscribe teaser toolbar topbar complementary""".split()
)
#: Names that may be those of the article's own parts as well: inside an article, such a block must also look like boilerplate. Fixed values.
WEAK_MARKS = frozenset("alert login overlay related search share sharing signup skip social warning widget widgets".split())
COMMENT_MARKS = frozenset("comment comments commentlist respond replies disqus".split())
HEADER_MARKS = frozenset("header site-header page-header siteheader pageheader".split())
#: What a name that marks may be joined with and still say the same: cookie-notice, related-posts, but not share-price. Fixed values.
FURNITURE = frozenset(
    """area articles bar block bottom box button buttons col column container content cta dropdown fixed form global group header holder icon icons
    inner input item items left link links list main menu message mobile module overlay page panel placeholder policy post posts primary reader
    right row secondary section site slot stories sticky thread top unit user wrap wrapper""".split()
)


def marks_in(value: str, marks: frozenset[str]) -> bool:
    """Whether a name in the value, as a whole or as a compound with nothing but FURNITURE and other marks, is one of the marks."""
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if any(w in marks for w in words) and all(w in marks or w in MARKS or w in WEAK_MARKS or w in COMMENT_MARKS or w in FURNITURE for w in words):
            return True
    return False


_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|$)", re.I)
_SPACE = re.compile(r"\s+")


def _holds_none(name: str, attrs: str, in_article: bool) -> str:
    """Why an element holds no main text: "element", "form", "mark", "weak" (if it looks like it), "comment", or nothing."""
    if name == "form":
        return "form"
    if name in DROPPED and not (name == "header" and in_article):
        return "element"
    if name in ("html", "body") or not attrs.strip():
        return ""
    found = ""
    for kind, a, b, c in _ATTR.findall(attrs):
        kind, value = kind.lower(), (a or b or c).lower()
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "element"
        if kind in ("class", "id", "role"):
            if marks_in(value, COMMENT_MARKS):
                return "comment"
            if name in ("article", "main"):
                continue
            if marks_in(value, MARKS) or not in_article and (set(value.split()) & HEADER_MARKS or marks_in(value, WEAK_MARKS)):
                found = "mark"
            elif not found and marks_in(value, WEAK_MARKS):
                found = "weak"
    return found


def blocks(page: str) -> list[tuple[str, int, str, int]]:
    """(text, region, why dropped, characters in links) in page order; region 0 is the page itself."""
    out: list[tuple[str, int, str, int]] = []
    text: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, int, str]] = []  # element, region, why it is dropped
    region, why, regions, in_link, forms = 0, "", 0, False, 0
    frames: set[str] = set()  # forms around parts of the page

    def end() -> None:
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            out.append((joined, region, why, len(_SPACE.sub(" ", html.unescape("".join(links))).strip())))
        text.clear()
        links.clear()

    def cut(i: int) -> None:
        """End the i-th open element and what is in it."""
        nonlocal region, why
        del stack[i:]
        region, why = stack[-1][1:] if stack else (0, "")

    def implied(name: str) -> None:
        """End what a start tag of this name ends."""
        ends, scope = IMPLIED_ENDS.get(name, (frozenset(), frozenset()))
        last = -1
        for i in range(len(stack) - 1, -1, -1) if ends else ():
            if stack[i][0] in ends:
                last = i
                if name not in ("tr", "thead", "tbody", "tfoot", "optgroup"):
                    break
            elif stack[i][0] in scope:
                break
        if last >= 0:
            cut(last)
        if name in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    cut(i)
                    break
                if stack[i][0] in P_SCOPE:
                    break
        if name in HEADINGS and stack and stack[-1][0] in HEADINGS:
            cut(len(stack) - 1)

    at = 0
    for m in _TOKEN.finditer(page):
        piece = page[at : m.start()]
        at = m.end()
        if stack and stack[-1][0] == "head" and (piece.strip() or (m["name"] or "head").lower() not in HEAD_PARTS):
            end()
            cut(len(stack) - 1)
        if piece:
            text.append(piece)
            if in_link:
                links.append(piece)
        if not (name := m["name"]):
            if m["raw"] and m["raw"].lower() == "title":
                end()
            continue
        name = name.lower()
        if name == "a":
            in_link = not m["close"]
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in BLOCKS and name not in DROPPED:
            if m["close"] or name in VOID or not m["attrs"].strip():
                continue
            if not _holds_none(name, m["attrs"], region > 0):
                continue
        if name in BLOCKS or name in DROPPED:
            end()
            in_link = False
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    cut(i)
                    break
                if stack[i][0] in CELLS and name not in CELLS | {"tr", "thead", "tbody", "tfoot"}:
                    break
        elif name in BLOCKS and name in VOID:
            implied(name)
        elif name not in VOID and not m["attrs"].endswith("/"):
            implied(name)
            own = _holds_none(name, m["attrs"], region > 0)
            if name in FRAME:
                frames.update(w for _, _, w in stack if w.startswith("form"))
            if own == "form":
                forms += 1
                own = f"form{forms}"
            if name in ("article", "main") and not own:
                regions += 1
                region = regions
                why = "" if why in ("mark", "weak") or why.startswith("form") else why
            why = own if not why or own and (why == "weak" or why.startswith("form")) else why
            stack.append((name, region, why))
    if stack and stack[-1][0] == "head" and page[at:].strip():
        cut(len(stack) - 1)
    if tail := page[at:]:
        text.append(tail)
        if in_link:
            links.append(tail)
    end()
    return [(t, r, ("" if w in frames else "element") if w.startswith("form") else w, n) for t, r, w, n in out]


def nearest(labels: list[bool | None]) -> list[bool | None]:
    """Labels, the undecided ones taken from the nearest decided one, the next on a tie; two sweeps."""
    n = len(labels)
    back: list[tuple[int, bool | None]] = []
    last, label = -1, None
    for i, own in enumerate(labels):
        if own is not None:
            last, label = i, own
        back.append((i - last if label is not None else 2 * n, label))
    out = list(labels)
    ahead, label = 2 * n, None
    for i in range(n - 1, -1, -1):
        if labels[i] is not None:
            ahead, label = i, labels[i]
        elif back[i][1] is not None or label is not None:
            out[i] = label if label is not None and ahead - i <= back[i][0] else back[i][1]
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    labels: list[bool | None] = []
    for text, _, why, in_links in found:  # first pass
        words = text.lower().split()
        stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words)
        if why not in ("", "weak") or in_links > LINK_DENSITY * len(text):
            labels.append(False)
        elif len(text) >= LONG or len(text) >= STOP_LENGTH and stops >= STOP_DENSITY * len(words):
            labels.append(True)
        else:
            labels.append(False if why else None)
    regions: dict[int, list[int]] = {}
    for i, block in enumerate(found):
        if block[2] in ("", "weak"):
            regions.setdefault(block[1], []).append(i)
    articles = any(labels[i] is not False for region, own in regions.items() if region for i in own)
    kept = []
    for region, own in regions.items():  # second pass
        if not (articles and not region):
            # in a region without a decided block everything is text
            kept += [i for i, label in zip(own, nearest([labels[i] for i in own])) if label is not False]
    return "\n".join(found[i][0] for i in sorted(kept))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def op8_html(pages: DataFrame) -> DataFrame:
    """Main text of every page and its length."""
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
