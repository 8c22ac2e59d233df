"""Main text of web pages by two passes over their blocks.

The page is cut into blocks at the tags in BLOCK_TAGS; a block is the text between two of them, with the character references
of each piece of text decoded on its own and white space made one space. br and inline tags don't cut a block. A block carries its
length, the share of its characters inside links, its density of stop words, and what it lies in.

First pass. A block inside an element that never belongs to the article is boilerplate: one of OUTSIDE_TAGS, or
one with a part of its class, id or role in OUTSIDE_NAMES; inside an article or main element only a container counts, all of
whose name's parts stand in INSIDE_NAMES or COMMON_PARTS (so comments go, but not an entry's header or a price of shares).
Other blocks inside an article or main element are text, but for those that are all link: three or more of one tag in a row are a menu,
fewer stay undecided. Elsewhere: a block with too many link characters, or a short one that begins with a copyright sign, is boilerplate;
a long one with enough stop words is text; a long one with few, or one with the middle share, is near text or boilerplate; short ones
stay undecided. Second pass: an undecided block takes the label of the nearest decided blocks:
text if both are text; if they differ, near-text neighbours count as the nearer side, and an article's inside as text. A
heading goes with the block after it. At a page's ends the edge counts as boilerplate.

Stop words are the most frequent function words of English, French, German, Spanish and Italian.

Cases: a null or empty page has an empty text; a comment, tag, script or reference that is never closed ends with
the page; repeated rows are treated each; null ids and urls stay null; an empty table gives an empty
table; other columns aren't read, so their names can't clash. Time is linear in a page's length.
"""

from __future__ import annotations

import html
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

# Tags that begin or end a block.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
# Elements whose text is never read.
SKIP_TAGS = frozenset("script style noscript template iframe object svg canvas textarea select button title head math audio video".split())
RAW_TAGS = frozenset("script style textarea title".split())
# Elements that aren't part of the article.
OUTSIDE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
# Parts of class, id and role names of what isn't part of the article.
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr header legal masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended related reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription teaser toc toolbar widget widgets".split()
)
# The same inside an article, and the parts that may stand beside them in a name.
INSIDE_NAMES = OUTSIDE_NAMES - frozenset("banner header legal masthead search teaser".split())
COMMON_PARTS = frozenset("area articles bar block box buttons container content entries form group items links list module panel posts section thread wrap wrapper".split())
CONTAINERS = frozenset("article aside details div dl fieldset figure ol section table ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Start tags that end open elements, and the elements beyond which they end none.
IMPLIED_ENDS = {
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("td", "th", "tr"), ("table",)),
    "tbody": (("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",)),
    "thead": (("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",)),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Function words.
STOP_WORDS = frozenset(
    """the of and to a in is it that for on with as was at by be this from or are an not his her you which have had but they all were their one we there been has will would can if no more when who what so up out about into than them its our
    le la les de des du et un une en que qui dans pour par sur au aux ce cette il elle est pas ne se avec plus sont ou son sa ses nous vous mais comme
    der die das und ein eine einer eines den dem des zu mit von im ist nicht auf für sich auch als an aus bei nach wie so es sie er wir aber oder wird werden
    el los las y una unos del al con por para es su sus lo como más pero no le ha si sin sobre este esta entre cuando muy
    il lo gli di che è e per non una sono con del della dei al alla anche come più ma nel si da""".split()
)
MAX_LINKS, LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH = 0.2, 70, 200, 0.08, 0.15
ALL_LINK, MENU = 0.9, 3

_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_NAME = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
# the rest of a tag; a quote counts only as the first character of a value, and only if it is closed
_REST = re.compile(r"""(?:[^>=]++|=[ \t\r\n\f]*+(?:"[^"]*+"|'[^']*+')?+)*+>""")


class Block:
    __slots__ = ("chars", "label", "links", "parts", "place", "tag", "text")

    def __init__(self, tag: str, place: str):
        self.tag, self.place, self.parts, self.chars, self.links = tag, place, [], 0, 0
        self.text, self.label = "", ""


def _tag_end(page: str, at: int) -> int:
    """The place after the '>' of a tag; quoted values may hold another."""
    m = _REST.match(page, at)
    return m.end() if m else len(page)


def _is_outside(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element isn't part of the article; inside: it lies in one."""
    if tag == "header" and inside:  # an article's own heading
        return False
    if tag in OUTSIDE_TAGS:
        return True
    if tag in ("article", "main", "body", "html") and not inside:
        return False
    names = [(m[1] or m[2] or m[3] or "").lower() for m in _NAME.finditer(attributes)]
    if not inside:
        return any(p in OUTSIDE_NAMES for n in names for p in _PART.findall(n))
    if tag not in CONTAINERS:
        return False
    each = [set(_PART.findall(n)) for name in names for n in name.split()]
    return any(parts & INSIDE_NAMES and parts <= INSIDE_NAMES | COMMON_PARTS for parts in each)


def blocks(page: str) -> list[Block]:
    """The page's blocks with a text, in order. place: 'out', 'in' or ''."""
    out: list[Block] = []
    open_: list[tuple[str, str]] = []  # elements, with 'skip', 'out', 'in' or ''
    where: dict[str, list[int]] = {}  # the places in open_ of each tag
    open_blocks: list[int] = []  # and of tags in BLOCK_TAGS
    depth = {"skip": 0, "out": 0, "in": 0, "a": 0}
    block = Block("", "")

    def close_block(tag: str) -> Block:
        if block.parts:
            text = " ".join("".join(block.parts).split())
            if text:
                block.text, block.chars = text, len(text)
                out.append(block)
        return Block(tag, "out" if depth["out"] else "in" if depth["in"] else "")

    def add(text: str) -> None:
        if text and not depth["skip"]:
            text = html.unescape(text)
            block.parts.append(text)
            if depth["a"]:
                block.links += len(text.strip())

    def last(tag: str) -> int:
        return where[tag][-1] if where.get(tag) else -1

    def close_from(i: int) -> None:
        for x, kind in reversed(open_[i:]):
            where[x].pop()
            depth["a"] -= x == "a"
            if kind:
                depth[kind] -= 1
        del open_[i:]
        while open_blocks and open_blocks[-1] >= i:
            open_blocks.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        name = m[2]
        if name is None:
            if page.startswith("<!--", m.start()):
                stop = page.find("-->", m.end())
                at = n if stop < 0 else stop + 3
            else:
                stop = page.find(">", m.end())
                at = n if stop < 0 else stop + 1
            continue
        tag = name.lower()
        at = _tag_end(page, m.end())
        if m[1]:  # an end tag closes what was opened since its element
            if tag in BLOCK_TAGS or tag in SKIP_TAGS:
                block = close_block("") if tag in BLOCK_TAGS else block
            i = last(tag)
            if i >= 0 and (tag in BLOCK_TAGS or tag in SKIP_TAGS or not open_blocks or open_blocks[-1] < i):
                close_from(i)
            if tag in BLOCK_TAGS:
                block = Block("", "out" if depth["out"] else "in" if depth["in"] else "")
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID_TAGS:
            if tag in BLOCK_TAGS:
                block = close_block("")
            continue
        if tag in RAW_TAGS:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            block = close_block("") if tag in BLOCK_TAGS else block
            at = _tag_end(page, close.end()) if close else n
            continue
        if page[at - 2 : at] == "/>" and tag not in BLOCK_TAGS:
            continue
        outside = _is_outside(tag, page[m.end() : at], depth["in"] > 0)
        kind = "skip" if tag in SKIP_TAGS else "out" if outside else "in" if tag in ("article", "main") else ""
        if tag in ("p", "li"):  # these need no end tag
            if open_blocks and open_[open_blocks[-1]][0] == tag:
                close_from(open_blocks[-1])
        elif tag in IMPLIED_ENDS:
            ends, within = IMPLIED_ENDS[tag]
            outer = max(map(last, within))
            inner = [i for x in ends if (i := last(x)) > outer]
            if inner:
                close_from(min(inner))
        if tag == "body":  # whatever the head left open ends here
            close_from(0)
            depth.update(skip=0, out=0, a=0)
            depth["in"] = 0
        where.setdefault(tag, []).append(len(open_))
        if tag in BLOCK_TAGS:
            open_blocks.append(len(open_))
        open_.append((tag, kind))
        depth["a"] += tag == "a"
        if kind:
            depth[kind] += 1
        if tag in BLOCK_TAGS:
            if kind == "in" or kind == "out":
                depth[kind] -= 1  # the block before isn't inside
                block = close_block("")
                depth[kind] += 1
                block = Block(tag, "out" if depth["out"] else "in" if depth["in"] else "")
            else:
                block = close_block(tag)
        elif kind == "out":
            block = close_block(tag)
    close_block("")
    return out


def label(found: list[Block]) -> None:
    """Sets label of each block to 'text' or 'boilerplate'."""
    for b in found:
        links = b.links / b.chars
        if b.place == "out":
            b.label = "boilerplate"
        elif b.place == "in":
            b.label = "linked" if links >= ALL_LINK else "text"
        elif links > MAX_LINKS or b.chars < LENGTH_HIGH and b.text.startswith("©"):
            b.label = "boilerplate"
        elif b.chars < LENGTH_LOW:
            b.label = "boilerplate" if links else "short"
        else:
            words = b.text.lower().split()
            stops = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)
            if stops >= STOP_HIGH:
                b.label = "text" if b.chars >= LENGTH_HIGH else "near"
            else:
                b.label = "near" if stops >= STOP_LOW else "boilerplate"
    for (linked, _), run in itertools.groupby(found, lambda b: (b.label == "linked", b.tag)):
        run = list(run) if linked else []
        if len(run) >= MENU:
            for b in run:
                b.label = "boilerplate"
    n = len(found)
    decided = ("text", "boilerplate")
    before, after, last, last_near = [("boilerplate", False)] * n, [("boilerplate", False)] * n, "boilerplate", False
    for i in range(n):
        before[i] = (last, last_near)
        if found[i].label in decided:
            last, last_near = found[i].label, False
        elif found[i].label == "near":
            last_near = True
    last, last_near = "boilerplate", False
    for i in range(n - 1, -1, -1):
        after[i] = (last, last_near)
        if found[i].label in decided:
            last, last_near = found[i].label, False
        elif found[i].label == "near":
            last_near = True
    for i, b in enumerate(found):
        if b.label in decided:
            continue
        (p, p_near), (q, q_near) = before[i], after[i]
        if b.label == "near":
            b.label = "text" if "text" in (p, q) else "boilerplate"
        elif b.tag in HEADINGS:
            b.label = "text" if q == "text" or q_near else "boilerplate"
        elif p == q:
            b.label = p
        elif b.place == "in":
            b.label = "text"
        else:
            b.label = "text" if (p == "boilerplate" and p_near) or (q == "boilerplate" and q_near) else "boilerplate"


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    label(found)
    return "\n\n".join(b.text for b in found if b.label == "text")


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The kept columns, text and n_chars of each page."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.as_py()) for x in b.column(len(keep))]
        return pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*map(str, range(len(keep))), "t", "n"])

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)
    return arrow_map(pages.select(*keep, html_col), one, f"{kinds}, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
