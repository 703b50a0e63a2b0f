"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. What belongs to the page and not to the article is left out by
its element, role or class: menus, headers and footers of the page, sidebars, notices, adverts, forms, comments,
scripts and styles. The first pass classes each remaining block by its length, the share of its characters in links and
the share of its words that are stop words: good, bad, or ambiguous. The second pass gives an ambiguous block
the class of its nearest decided neighbours; between a good and a bad one the nearer decides. Neighbours are asked in the
block's own ``article`` or ``main`` element first, where a block without decided neighbours is good; elsewhere it is bad.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by an
empty line in page order.

Cases. Null html counts as empty and gives an empty text. Truncated pages are read as far as they go; an unclosed
comment, script or style runs to the end. After a tag whose quotes never close, tags end at the next ``>``. References to no
character are one replacement character. Repeated rows are extracted as often. The scanner only moves on, so that
long and broken pages take time in proportion to their length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from curator.llm.spread import map_arrow

SHORT, LONG, LINKS, STOP_LOW, STOP_HIGH = 70, 200, 0.4, 0.12, 0.25

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
PLAIN = re.compile(r"[^\"'>]*")
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
#: Those of them that may end in their start tag.
FOREIGN = frozenset(["svg", "math"])
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

#: Elements that start a new block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be missing: they end at the next block.
LOOSE = frozenset("p li dd dt td th tr tbody thead tfoot option optgroup".split())
#: Elements that are not the article.
OUTSIDE = frozenset("nav footer aside form head button dialog menu fieldset search".split())
INSIDE = frozenset(["article", "main"])
#: Elements whose class does not take them out, as it often describes the layout.
FRAME = frozenset(["html", "body", "main", "article"])
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id values that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription comment comments commentlist disqus reply replies respond sidebar sidebars widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social related recommended recommendations toolbar pagination pager login signup register search skip copyright disclaimer".split()
)
#: Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    (
        "the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two him see could no been its who now my than first may over such our "
        "le la les de des du et à un une en est que qui dans pour pas au sur se ce il elle par avec ne sont plus ou mais son sa ses aux cette ont été nous vous ils on leur y comme tout fait si "
        "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein "
        "el los las y que en un una ser al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos del se no para por con su"
    ).split()
)
WORD = re.compile(r"[^\W\d_]+")
GOOD, BAD, AMBIGUOUS = 1, 0, -1


def taken_out(tag: str, rest: str, inside: bool) -> bool:
    """True if an element's name or attributes say that it is not part of the article."""
    if tag in OUTSIDE or tag == "header" and not inside:
        return True
    if not rest or rest.isspace():
        return False
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return tag not in FRAME
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and tag not in FRAME and not MARKS.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, element, is an end tag, attributes) of what is between ``<`` and ``>``; element None: nothing but to be left out.

    Every search starts where the last one ended or is made once a page.
    """
    at, quotes, last = page.find("<"), True, page.rfind(">")
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield at, len(page) if end < 0 else end + 3, None, False, ""
            at = -1 if end < 0 else page.find("<", end + 3)
            continue
        if at > last:
            at = page.find("<!--", at)  # nothing else can be complete
            continue
        if page[at + 1] in "!?":
            end = page.find(">", at) + 1
            yield at, end, None, False, ""
            at = page.find("<", end)
            continue
        closing = page[at + 1] == "/"
        name = NAME.match(page, at + 1 + closing)
        if name is None:
            at = page.find("<", at + 1)
            continue
        tag = name[0].lower()
        if tag in RAW and not closing:
            end = page.find(">", at) + 1
            if page[end - 2] != "/" or tag not in FOREIGN:
                stop = RAW_END[tag].search(page, end)
                end = stop.end() if stop else len(page)
            yield at, end, None, False, ""
            at = page.find("<", end)
            continue
        end = PLAIN.match(page, name.end()).end() if quotes else page.find(">", name.end())
        while quotes and end < len(page) and page[end] != ">":
            close = page.find(page[end], end + 1)
            if close < 0:
                end = len(page)
                break
            end = PLAIN.match(page, close + 1).end()
        if end == len(page):
            quotes, end = False, page.find(">", name.end())
        yield at, end + 1, tag, closing, page[name.end() : end]
        at = page.find("<", end + 1)


def decoded(text: str) -> str:
    """``text`` with its character references decoded, in time in proportion to its length."""
    if "&#" in text:
        text = re.sub(r"&#0++(?=[0-9])", "&#", text)
        text = re.sub(r"&#[0-9]{8,};?|&#[xX]0*+[0-9a-fA-F]{7,};?", "\ufffd", text)
    return html.unescape(text)


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, characters in links, number of the innermost article or 0) of every block that was not taken out."""
    out: list[tuple[str, int, int]] = []
    open_: list[tuple[str, bool, int]] = []  # element, taken out, article
    opened: Counter[str] = Counter()  # elements in it
    parts: list[str] = []
    linked = links = articles = 0
    loose_out = None  # an element with a missing end tag that is taken out
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(decoded("".join(parts)).split())
        if text:
            out.append((text, linked, open_[-1][2] if open_ else 0))
        parts.clear()
        linked = 0

    for start, end, tag, closing, rest in tokens(page):
        if start > at and loose_out is None and not (open_ and open_[-1][1]):
            piece = page[at:start]
            parts.append(piece)
            linked += len(piece.strip()) if links > 0 else 0
        at = end
        if tag is None:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag in BLOCK:
            flush()
            links = 0
            loose_out = None
        if closing:
            while opened[tag]:
                name = open_.pop()[0]
                opened[name] -= 1
                if name == tag:
                    break
            continue
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        _, out_now, article = open_[-1] if open_ else ("", False, 0)
        gone = out_now or taken_out(tag, rest, article > 0)
        if tag in LOOSE:
            loose_out = tag if gone and not out_now else None
            continue
        if tag in INSIDE and not gone:
            articles += 1
            article = articles
        if tag in BLOCK or gone:
            open_.append((tag, gone, article))
            opened[tag] += 1
    if at < len(page) and loose_out is None and not (open_ and open_[-1][1]):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!?][^<>]*\Z", rest)  # a tag that the page's end cut off
        parts.append(rest[: cut.start()] if cut else rest)
    flush()
    return out


def first_pass(text: str, linked: int, inside: bool) -> int:
    """Class of a block by its length, link density and stop-word density."""
    n = len(text)
    if linked > LINKS * n:
        return BAD
    if n < SHORT:
        return BAD if "©" in text else AMBIGUOUS
    words = WORD.findall(text.lower())
    share = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if share >= STOP_HIGH or share >= STOP_LOW and n >= LONG:
        return GOOD
    return AMBIGUOUS if share >= STOP_LOW or inside else BAD


def second_pass(classes: list[int], article: list[int]) -> list[int]:
    """Ambiguous blocks get the class of the nearest decided block, of their own article if it has one."""
    n = len(classes)
    out = list(classes)
    before, after = [(-1, BAD)] * n, [(-1, BAD)] * n
    for order, found in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, tuple[int, int]] = {}
        for i in order:
            found[i] = last.get(article[i], (-1, BAD))
            if classes[i] != AMBIGUOUS:
                last[article[i]] = (i, classes[i])
    for i, c in enumerate(classes):
        if c == AMBIGUOUS:
            near = [(abs(j - i), -k, k) for j, k in (before[i], after[i]) if j >= 0]
            out[i] = min(near)[2] if near else GOOD if article[i] else BAD
    return out


def extract(page: str) -> list[str]:
    """The blocks of the main text."""
    found = blocks(page)
    article = [a for *_, a in found]
    classes = second_pass([first_pass(t, k, a > 0) for t, k, a in found], article)
    return [t for (t, *_), c in zip(found, classes) if c == GOOD]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_blocks of every page."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            found = [extract(h or "") for h in part.column("html").to_pylist()]
            texts = ["\n\n".join(x) for x in found]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int32())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(pages.select("page_id", "url", "html"), batch, f"page_id {kind}, url string, text string, n_chars long, n_blocks int")
