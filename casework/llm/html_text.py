"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. Pass one judges each block alone: by the element it
lies in (menus, footers, forms, adverts and the like are never text), its share of link text, its
length and its share of stop words. Blocks that this leaves open, mostly short ones, take in pass
two the label of the nearest decided block of their region; a tie means text. A region is an
article or main element if those hold at least half of the text that pass one decides on, and then
nothing else is kept; otherwise they are no evidence, and the page is one region.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm import arrays

MIN_LENGTH, MIN_STOP_SHARE, MAX_LINK_SHARE = 70, 0.2, 0.5

# HTML's element names by use, and common words of four languages.
_RAW = frozenset("script style noscript template textarea iframe title svg math canvas object video audio".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split())
_NEVER_TEXT = frozenset("nav footer aside form head menu dialog select button fieldset".split())
_NOT_KEPT_OPEN = frozenset("p hr html".split())  # close by themselves, or never matter
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notification alert popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead toolbar share sharing social related recommended recommendations comment "
    "comments reply replies respond disqus widget login signin signup search pagination pager copyright disclaimer "
    "skip".split())
_HEAD_NAMES = frozenset("header topbar".split())  # a page's head, but not an article's
_OWN_NAMES = frozenset("comment comments reply ad ads advert advertisement sponsored promo related".split())
_WITHOUT = frozenset("with has no without hide".split())
_STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the
    their they this to was were which who will with you
    aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in
    ist mit nach nicht noch oder sich sie sind so über um und von vor war wie wird zu zum zur
    à au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour qu
    que qui sa se ses son sont sur un une vous
    al como con de del el ella en entre es esta este fue ha la las le lo los más mi muy no nos o para pero por que se
    ser si sin sobre su sus un una y ya""".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|"[^"]{0,4096}+"|'[^']{0,4096}+'|["'=])*+)>""",
    re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")  # values are read whole
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


def _named(value: str, names: frozenset) -> bool:
    """Whether a class or id is called one of ``names``; ``with-sidebar`` is not."""
    for one in value.split():
        parts = [p.lower() for p in _PART.findall(one)]
        if parts and parts[0] not in _WITHOUT and not names.isdisjoint(parts):
            return True
    return False


def _never_text(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _NEVER_TEXT or (tag == "header" and not in_article):
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden":
            return True
        if name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id"):
            if tag in ("article", "main"):
                if _named(value, _OWN_NAMES):
                    return True
            elif tag not in ("body", "html") and (
                    _named(value, _NAMES) or (not in_article and _named(value, _HEAD_NAMES))):
                return True
    return False


class _Block:
    __slots__ = ("text", "links", "region", "barred")

    def __init__(self, text: str, links: int, region: int, barred: bool):
        self.text, self.links, self.region, self.barred = text, links, region, barred


def blocks(page: str) -> list[_Block]:
    """The page's blocks in order; region 0 is outside every article."""
    out: list[_Block] = []
    text: list[str] = []
    open_tags: list[tuple[str, bool, int]] = []  # name, barred, region
    in_link = breaks = link_length = regions = place = 0

    def add(piece: str) -> None:
        nonlocal breaks, link_length
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if not piece.isspace():
                breaks = 0
            if in_link:
                link_length += len("".join(piece.split()))

    def end_block() -> None:
        nonlocal in_link, link_length, breaks
        whole = " ".join("".join(text).split())
        if whole:
            _, barred, region = open_tags[-1] if open_tags else ("", False, 0)
            out.append(_Block(whole, link_length, region, barred))
        text.clear()
        in_link = breaks = link_length = 0

    while True:
        m = _TAG.search(page, place)
        if m is None:
            add(page[place:])
            break
        add(page[place : m.start()])
        place = m.end()
        if m[2] is None:
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in _RAW and not closing:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, place)
                place = close.end() if close else len(page)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            breaks += 1
            text.append(" ")
            if breaks == 2:
                end_block()
        elif tag in _BLOCK or tag == "button":
            end_block()
        if tag in _VOID or tag in _NOT_KEPT_OPEN or (tag not in _BLOCK and tag != "button"):
            continue
        if closing:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    del open_tags[i:]
                    break
        elif tag == "body":
            open_tags = [("body", False, 0)]
        elif not attributes.endswith("/"):
            _, barred, region = open_tags[-1] if open_tags else ("", False, 0)
            if tag in ("article", "main") and not region:
                regions += 1
                region = regions
            barred = barred or _never_text(tag, attributes, region > 0)
            open_tags.append((tag, barred, region))
    end_block()
    return out


def _alone(block: _Block) -> bool | None:
    """Text, not text, or open, by the block alone."""
    if block.barred:
        return False
    length = len(block.text)
    if block.links > MAX_LINK_SHARE * length:
        return False
    if length < MIN_LENGTH:
        return None
    words = _WORD.findall(block.text.lower())
    stops = sum(w in _STOP_WORDS for w in words)
    return True if words and stops >= MIN_STOP_SHARE * len(words) else None


def main_text(page: str | None) -> str:
    """The page's text blocks, two line breaks between them; null has none."""
    found = blocks(page or "")
    labels = [_alone(b) for b in found]
    if any(b.region and not b.barred for b in found):
        inside, outside = (sum(len(b.text) for b, is_text in zip(found, labels) if is_text and bool(b.region) == held)
                           for held in (True, False))
        if inside >= outside:  # the page says where its text is
            labels = [x for b, x in zip(found, labels) if b.region]
            found = [b for b in found if b.region]
        else:
            for b in found:
                b.region = 0
    out = []
    for region in sorted({b.region for b in found}):
        at = [i for i, b in enumerate(found) if b.region == region and not b.barred]
        # A line of links decides its neighbours among menus, but not inside an article.
        decided = np.array([j for j, i in enumerate(at) if labels[i] or (labels[i] is False and not region)])
        for j, i in enumerate(at):
            if labels[i] is None and len(decided):
                far = np.abs(decided - j)
                labels[i] = any(labels[at[k]] for k in decided[far == far.min()])
            elif labels[i] is None:
                labels[i] = True  # nothing in the region is decided: short, but all there is
        out += [i for i in at if labels[i]]
    return "\n\n".join(found[i].text for i in sorted(out))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html, …).

    A null or empty page has an empty text. Character references are decoded, white space inside a
    block becomes one space. Nothing else is dropped or cut, whatever the length; repeated rows and
    null ids are rows like any other; other columns are ignored; an empty table gives an empty
    result. Pages are independent, so the work is one pass without a shuffle.
    """
    names = ["page_id", "url", "text", "n_chars"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.string(), pa.int64()])))

    def run(batches):
        for batch in batches:
            for block in arrays.blocks(batch.column("html")):
                part = slice(block.first, block.first + len(block))
                texts = [main_text(t) for t in batch.column("html")[part].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id")[part], batch.column("url")[part], pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
