"""Main-text extraction from HTML by two passes of block rules.

Method. A page becomes a list of blocks. The first pass decides each block by
its link density, its length and its share of stop words: link-dense blocks are
bad, long enough ones with stop words are good, short ones stay ambiguous. In
the second pass an ambiguous block inherits the label of the nearest decided
block of its section. Parts that the markup itself names as no article (menus,
headers, footers, asides, forms, adverts, notices, reader comments, scripts and
styles) are left out before; if the page marks an article, blocks outside it
are bad. A class or id counts as a name if all its words do (``cookie-notice``), or the
others only say where it stands (``left-sidebar``); ``ad-free`` and ``page-with-sidebar``
name no such part. A page of which nothing is left that way is read again without
what sets its outermost parts apart, if the first pass then finds a good block.

Defined cases. A null page or one without text gives the empty text. Unclosed,
unmatched and cut-off tags are tolerated: a part ends with its parent at the latest, and
an article ends a menu or header left open before it; text outside any element is a block.
Repeated rows give repeated results; an empty table gives an empty result.
Only the columns named are read, so that others can't clash.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# HTML element names by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("script style noscript template iframe object svg math canvas audio video title textarea select button".split())
APART = set("nav footer aside form dialog menu fieldset".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ITEMS = set("li dt dd tr td th option".split())
# Words in class and id names, and roles, of parts that are no article.
APART_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu sidebar breadcrumb breadcrumbs "
    "footer header masthead comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login social share sharing related recommended recommendations widget widgets toolbar pagination pager copyright legal disclaimer skip".split()
)
# Words in class and id names that only say where or how a part stands.
PLACE_NAMES = set("main site page post article entry left right top bottom primary secondary global container wrapper wrap inner outer box area block section list item items group content link links text title body bar panel mobile desktop inline sticky fixed col column div".split())
COMMENT_NAMES = set("comment comments reply replies respond".split())
APART_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = set(
    "the of and to in a is was for on that with as it by at from be are this which or an not have has had were but they his her you he she we their its "
    "der die das und den dem des von mit sich ist im ein eine zu auf für nicht als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de du et en un une des est que qui dans pour par sur au aux pas ne se ce il elle plus avec son sa ou "
    "el los las y del que una por con para se su al lo como más pero sus está".split()
)

#: Characters from which a block is long, the link density from which it is bad, and the stop words' share from which it is good.
LONG, LINKED, STOPPED = 70, 0.33, 0.08

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?""", re.S)
_ATTR = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    section: int
    main: bool
    good: bool | None = None


def _judged(tag: str, attrs: str, in_main: bool) -> tuple[bool, bool, bool]:
    """Of an element that begins: is it dropped, set apart, or the article?"""
    names: set[str] = set()
    hidden = False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in _NAME.findall(token)}
                if words <= APART_NAMES | PLACE_NAMES:
                    names |= words & APART_NAMES
            continue
        value = value.lower()
        if key == "role" and value in APART_ROLES:
            names.add("nav")
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    if tag in ("html", "body", "main"):
        return False, False, tag == "main"
    if tag == "article":
        return hidden, bool(names & COMMENT_NAMES), True
    return tag in DROPPED or hidden, tag in APART or tag == "header" or bool(names), False


def blocks(page: str, outermost: bool = True) -> list[Block]:
    """The page's blocks in order, without what its markup sets apart (but for its ``outermost`` such parts, if these shall stay)."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool, bool]] = []  # (tag, left out, section, in the article, in a part set apart)
    buffer: list[str] = []
    linked, links, sections, breaks, at = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text and not (stack and stack[-1][1]):
                out.append(Block(text, linked, stack[-1][2] if stack else 0, bool(stack and stack[-1][3])))
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal links
        if any(x[0] not in INLINE or x[1] != (stack[k - 1][1] if k else False) for x in stack[k:]):
            flush()
        links -= sum(x[0] == "a" for x in stack[k:])
        del stack[k:]

    def said(raw: str) -> None:
        nonlocal linked, breaks
        if raw and not (stack and stack[-1][1]):
            text = entities.unescape(raw)
            buffer.append(text)
            if links and text.strip():
                linked += len(text.strip())
            if text.strip():
                breaks = 0

    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                said(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if m[1] or m[4]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None:
                pop_to(k)
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                buffer.append(" ")
            continue
        if tag in ("script", "style", "title", "textarea", "iframe", "noscript", "template"):
            close = re.compile(rf"</{tag}[^>]*+>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            # A block ends an open paragraph, and an item the open item before it.
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in INLINE), None)
            if k is not None and (stack[k][0] == "p" or stack[k][0] == tag and tag in ITEMS):
                pop_to(k)
        left, section, main, within = stack[-1][1:] if stack else (False, 0, False, False)
        dropped, apart, article = _judged(tag, m[3] or m[6] or "", main)
        if article and left and next(x[0] for x in stack if x[1]) in ("nav", "menu", "header"):
            left = within = False  # these hold no article: they were left open
        if tag == "header" and main and not dropped:
            apart = False  # an article's own header holds its title; what else it has is judged as blocks are
        if article:
            sections += 1
            section = sections
        if (dropped or apart) and not left:
            flush()
        if tag == "a":
            links += 1
        stack.append((tag, left or dropped or apart and (outermost or within), section, main or article, within or apart))
    flush()
    return out


def first_pass(b: Block) -> bool | None:
    """Good, bad or (None) ambiguous, by the block alone."""
    n = len(b.text)
    if b.linked > LINKED * n:
        return False
    if n < LONG:
        return None
    words = _WORD.findall(b.text.lower())
    share = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    return True if b.main or share >= STOPPED else None


def judge(found: list[Block]) -> None:
    """Both passes over the blocks of a page."""
    for b in found:
        b.good = first_pass(b)
    if any(b.main and b.good for b in found) or any(b.main and b.good is None for b in found):
        for b in found:
            b.good = b.good if b.main else False
    decided = [(i, b.section, b.good) for i, b in enumerate(found) if b.good is not None]
    before: dict[int, tuple[int, bool]] = {}
    after: list[tuple[int, bool] | None] = [None] * len(found)
    seen: dict[int, tuple[int, bool]] = {}
    known = {i: (s, g) for i, s, g in decided}
    good = {s for _, s, g in decided if g}
    for i in range(len(found) - 1, -1, -1):
        after[i] = seen.get(found[i].section)
        if i in known:
            seen[known[i][0]] = (i, known[i][1])
    for i, b in enumerate(found):
        if i in known:
            before[known[i][0]] = (i, known[i][1])
            continue
        near = [(abs(i - j), not g, g) for j, g in (x for x in (before.get(b.section), after[i]) if x)]
        # Equally near: the good one. Without a good block, what the page marks as its article is good.
        b.good = min(near)[2] if near and (b.section in good or not b.main) else True


def extract(page: str | None) -> str:
    """The main text: good blocks in page order, joined by an empty line."""
    found = blocks(page or "")
    judge(found)
    if page and not any(b.good for b in found):
        found = blocks(page, outermost=False)
        if not any(first_pass(b) for b in found):
            return ""
        judge(found)
    return "\n\n".join(b.text for b in found if b.good)


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, ``text`` and ``n_chars`` (code points) of every page."""

    def run(batches):
        for batch in batches:
            text = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], [id_col, url_col, "text", "n_chars"])

    types = dict(df.dtypes)
    src = df.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("h"))
    return map_arrow(src, run, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long")
