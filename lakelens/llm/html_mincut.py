"""Main-text extraction as a minimum cut between content and boilerplate.

A page becomes a row of text blocks and a set of regions, the elements whose
tag, role, class or id says what they hold. A linear classifier over a block's
wording, links and tag gives a bounded log-odds, which is the capacity of the
block's edge to the content or the boilerplate terminal; a region's mark is
that of the region. Neighbouring blocks, blocks of one parent, blocks and the
region they stand in, and regions inside each other are tied by smoothness
edges of the same scale. The maximum flow's source side is the content: a
block's own wording can never outweigh a firm region around it, while a region
that only a loose name marks gives way to enough prose, and a form or a region
that a name of layouts marks is firm only if most of the text stands elsewhere.
A page without any content is cut once more with a milder classifier.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, slices

#: A quoted value ends where white space, / or > follows the quote, so that a stray quote spoils one tag at most.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|textarea)(?=[\s/>])[^<>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|svg|iframe|object|select|button)(?=[\s/>])[^<>]*+>"
    r"|</?([a-zA-Z][\w:-]*)((?:=\s*+\"[^\"]*+\"(?=[\s/>])|=\s*+'[^']*+'(?=[\s/>])|[^<>])*+)>|<[!?/][^<>]*+>|([^<]++|<)",
    re.S | re.I,
)
#: End tags of the elements that are skipped only up to their own end.
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in "noscript template svg iframe object select button".split()}
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?<![\w-])hidden\b(?!\s*=\s*[\"']?(?:false|until))|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

#: Tags that begin and end a block, tags without content, and tags that stand outside the text.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE_TAGS = frozenset("nav aside footer menu dialog head title fieldset label search".split())
FIELD_TAGS = frozenset("input select textarea button label fieldset".split())
#: Names of regions outside the text, firm and loose ones, of regions of content, and of roles.
FIRM_NAMES = frozenset("ad ads advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer disqus footer gdpr masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies reply respond sharing sidebar signup sponsor sponsored subscribe subscription toolbar".split())
LOOSE_NAMES = frozenset("banner form modal search share social topbar trending widget".split())
COMMENT_NAMES = frozenset("comment comments commentlist replies reply respond disqus".split())
#: Firm names of what stands outside the text however much it holds; other firm names are also those of layouts.
APART_NAMES = COMMENT_NAMES | frozenset("ad ads advert adverts advertisement advertisements advertising cookie cookies consent disclaimer gdpr newsletter promo promoted promotion related signup sponsor sponsored subscribe subscription".split())
#: Words behind which a name says what a layout has or lacks.
LAYOUT_WORDS = frozenset("after before below beside free has hide is no non not show under with without".split())
CONTENT_NAMES = frozenset("article body content entry main post story text".split())
#: Words that, after a name of a region, still name the region.
HOLDERS = frozenset("area articles bar block body bottom box buttons center column container content footer group header holder inner item items label left link links list module outer panel post posts right row section slot stories strip text title top unit wrap wrapper zone".split())
FIRM_ROLES = frozenset("navigation contentinfo complementary search menu menubar dialog alertdialog form".split())
CONTENT_ROLES = frozenset("main article".split())

#: Kinds of regions; of the last three, the whole page tells which of the others they are: a form, one that only a name marks, an article in such a one.
NONE, FIRM, LOOSE, ARTICLE, MAIN, NAMED, FORM, HINT, INNER = range(9)


@dataclass(frozen=True)
class Weights:
    """The classifier's weights (evidence for content is positive), its bound, and the capacities of all other edges."""

    bias: float = -0.8
    heading: float = 0.4
    paragraph: float = 0.6
    item: float = -0.3
    words: float = 0.06  # of up to 30 words
    stops: float = 0.5  # of up to three sentence ends
    links: float = -2.5  # of the share of linked characters
    bound: float = 2.0  # of a block's evidence
    firm: float = 3.0  # tie of a block to a region of a firm mark
    loose: float = 2.5
    main: float = 2.5
    named: float = 1.0
    loose_mark: float = 4.5  # evidence of a loose region, however much it holds
    adjacent: float = 0.6
    sibling: float = 0.4
    across: float = 0.1  # neighbours of different regions, regions inside each other
    second: float = 1.0  # bias added for a page without any content at first


class Block:
    """A run of text; ``region`` is the number of the marked element around it, 0 for none."""

    __slots__ = ("parts", "linked", "chars", "region", "tag", "parent")

    def __init__(self, region: int, tag: str, parent: int):
        self.parts, self.linked, self.chars = [], 0, 0
        self.region, self.tag, self.parent = region, tag, parent

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def name_kind(token: str) -> int:
    """What a whole class or id token says: a name of a region, alone, last, or followed by words that name its holder; nothing behind a word of layouts."""
    parts = [p.lower() for p in _PARTS.findall(token)]
    if not parts:
        return NONE
    for names, kind in ((FIRM_NAMES, FIRM), (LOOSE_NAMES, LOOSE)):
        at = next((i for i, p in enumerate(parts) if p in names), None)
        if at is not None and not LAYOUT_WORDS & set(parts[:at]) and (parts[-1] in names or all(p in names or p in HOLDERS for p in parts[at:])):
            return HINT if kind == FIRM and not APART_NAMES & set(parts) else kind
    return NAMED if len(parts) <= 2 and parts[-1] in CONTENT_NAMES else NONE


def element_kind(tag: str, attributes: str, inside: int) -> int:
    """The kind of region that an element opens inside one of kind ``inside``, NONE if it is none of its own."""
    if inside == FIRM:
        return NONE  # all that is in it is outside the text
    kinds = {FIRM} if tag in OUTSIDE_TAGS else set()
    if tag == "header" and inside not in (ARTICLE, MAIN):
        kinds.add(FIRM)
    if attributes and tag not in ("html", "body"):
        if _HIDDEN.search(attributes):
            kinds.add(FIRM)
        for what, *values in _NAMES.findall(attributes):
            for token in "".join(values).split():
                if what.lower() == "role":
                    kinds.add(HINT if token in FIRM_ROLES else MAIN if token in CONTENT_ROLES else NONE)
                elif tag not in ("article", "main"):
                    kinds.add(name_kind(token))
                elif COMMENT_NAMES & {p.lower() for p in _PARTS.findall(token)}:
                    kinds.add(name_kind(token))
    if FIRM in kinds:
        return FIRM
    if inside == HINT:
        return INNER if tag in ("article", "main") else NONE
    if tag == "form":
        return FORM
    if HINT in kinds and not kinds & {NAMED, MAIN}:
        return HINT
    if inside == LOOSE:
        return NONE
    if tag in ("article", "main"):
        return ARTICLE if tag == "article" else MAIN
    if LOOSE in kinds:
        return LOOSE
    if inside in (ARTICLE, MAIN, INNER):
        return NONE
    return MAIN if MAIN in kinds else NAMED if NAMED in kinds else NONE


def settle(found: list[tuple[Block, str]], regions: list[tuple[int, int]], fields: set[int]) -> list[tuple[int, int]]:
    """The regions once the page is read, and their blocks in those that remain.

    A form with fields is firm, and so is a region that only a name of a layout
    marks, unless they hold most of the page's text (over half, over two thirds) and no article
    stands outside. A name around all text, with other regions inside, says nothing.
    The only article of a page is one even in such a region. All inside a firm region is firm.
    """
    chars = [0] * len(regions)
    for b, t in found:
        r = b.region
        while r:
            chars[r] += len(t)
            r = regions[r][1]
    total = sum(len(t) for _, t in found)
    articles = sum(kind in (ARTICLE, MAIN, INNER) for kind, _ in regions)
    beside = [sum(kind in (ARTICLE, MAIN) for kind, _ in regions)] * len(regions)  # articles outside each region
    for kind, r in regions:
        while kind in (ARTICLE, MAIN) and r:
            beside[r] -= 1
            r = regions[r][1]
    out = [regions[0]]
    stays = [0]  # the region that stands for each
    for r, (kind, around) in enumerate(regions[1:], 1):
        outer = stays[around]
        if kind == FORM:
            kind = FIRM if r in fields and (beside[r] or 2 * chars[r] <= total) else NONE
        elif kind == HINT:
            kind = FIRM if beside[r] or 3 * chars[r] <= 2 * total else NONE
        elif kind == NAMED and chars[r] == total and len(regions) > 2:
            kind = NONE
        elif kind == INNER:
            kind = ARTICLE if articles == 1 or out[outer][0] != FIRM else NONE
            outer = outer if out[outer][0] != FIRM or kind == NONE else 0
        elif out[outer][0] == FIRM:
            kind = NONE
        stays.append(r if kind != NONE else outer)
        out.append((kind, outer))
    for b, _ in found:
        b.region = stays[b.region]
    return out


def blocks(page: str) -> tuple[list[tuple[Block, str]], list[tuple[int, int]]]:
    """The page's non-empty text blocks in order, with their text, and (kind, region around it) of every region.

    Of elements outside the text, an unclosed script, style or textarea runs to
    the end of the page; another one that is unclosed or closes itself skips its
    tag alone. Every step takes the same time at any depth of nesting.
    """
    regions: list[tuple[int, int]] = [(NONE, 0)]
    # of each open element: tag, region, whether in a link, place of the nearest block element, parent for siblings
    stack: list[tuple[str, int, bool, int, int]] = [("", 0, False, 0, 0)]
    places: dict[str, list[int]] = {}  # places of the open elements of a tag
    out: list[Block] = []
    current: Block | None = None  # of the open block, in the region where it began
    beside: Block | None = None  # of a part of it that stands in another region
    serial, at = 0, 0
    unclosed: set[str] = set()
    fields: set[int] = set()  # forms that hold one

    def kind_around(region: int) -> int:
        """The kind of the nearest region that is no form."""
        while regions[region][0] == FORM:
            region = regions[region][1]
        return regions[region][0]

    def field(region: int) -> None:
        while region and regions[region][0] != FORM:
            region = regions[region][1]
        fields.add(region)

    def close(upto: int) -> None:
        while len(stack) > upto:
            places[stack.pop()[0]].pop()

    while m := _TOKEN.search(page, at):
        at = m.end()
        if m[2] is not None:
            name = m[2].lower()
            if name in FIELD_TAGS:
                field(stack[-1][1])
            if not m[0].endswith("/>") and name not in unclosed:
                if end := _ENDS[name].search(page, at):
                    at = end.end()
                else:
                    unclosed.add(name)
            continue
        if m[5] is not None:
            _, region, linked, block, parent = stack[-1]
            blank = m[5].isspace()
            if current is None:
                if blank:
                    continue
                current, beside = Block(region, stack[block][0], parent), None
                out.append(current)
            into = current
            if current.region != region:
                if beside is None or beside.region != region:
                    if blank:
                        continue
                    beside = Block(region, current.tag, current.parent)
                    out.append(beside)
                into = beside
            into.parts.append(m[5])
            into.chars += len(m[5])
            if linked:
                into.linked += len(m[5])
            continue
        if m[3] is None:
            if m[1] and m[1].lower() == "textarea":
                field(stack[-1][1])
            continue  # comment, declaration or an element outside the text
        tag = m[3].lower()
        is_block = tag in BLOCK_TAGS
        if is_block:
            current = None
        elif tag == "br" and current is not None:
            current.parts.append(" ")
        block = stack[-1][3]
        if m[0][1] == "/":
            if (open_ := places.get(tag)) and (is_block or open_[-1] > block):  # an inline end tag closes nothing outside its block
                close(open_[-1])
            continue
        if is_block and block:
            name = stack[block][0]
            if name == "p" or name == tag and tag in ("li", "dt", "dd", "tr", "td", "th") or tag == "tr" and name in ("td", "th"):
                close(block)
                if tag == "tr" and stack[-1][3] and stack[stack[-1][3]][0] == "tr":
                    close(stack[-1][3])
        _, region, linked, block, parent = stack[-1]
        if tag in FIELD_TAGS:
            field(region)
        if tag in VOID_TAGS or m[0].endswith("/>"):
            continue
        if (kind := element_kind(tag, m[4] or "", kind_around(region))) != NONE:
            regions.append((kind, region))
            region = len(regions) - 1
        serial += 1
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, region, linked or tag == "a", len(stack) if is_block else block, serial if is_block and tag not in ("p", "li") else parent))
    found = [(b, t) for b in out if (t := b.text())]
    return found, settle(found, regions, fields)


def evidence(b: Block, text: str, w: Weights) -> float:
    """The classifier's log-odds that a block is content by its wording, links and tag, within the bound."""
    e = w.bias + w.words * min(30, text.count(" ") + 1) + w.stops * min(3, sum(map(text.count, ".!?。！？")))
    e += w.links * b.linked / max(1, b.chars)
    if b.tag in ("p", "pre", "blockquote", "dd", "td"):
        e += w.paragraph
    elif b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        e += w.heading
    elif b.tag in ("li", "dt", "th"):
        e += w.item
    return w.bound * math.tanh(e / w.bound)


def graph(found: list[tuple[Block, str]], regions: list[tuple[int, int]], w: Weights) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal capacities and smoothness edges of blocks (first) and regions (after them, in order)."""
    n = len(found)
    gain = [evidence(b, t, w) for b, t in found] + [0.0] * len(regions)
    tie = {FIRM: w.firm, LOOSE: w.loose, ARTICLE: w.firm, MAIN: w.main, NAMED: w.named}
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    held = [0] * len(regions)
    for i, (b, _) in enumerate(found):
        if i:
            edges.append((i - 1, i, w.adjacent if found[i - 1][0].region == b.region else w.across))
        if b.parent in last and found[last[b.parent]][0].region == b.region:
            edges.append((last[b.parent], i, w.sibling))
        last[b.parent] = i
        if b.region:
            edges.append((i, n + b.region, tie[regions[b.region][0]]))
            held[b.region] += 1
    for r, (kind, around) in enumerate(regions):
        if kind == LOOSE:
            gain[n + r] = -w.loose_mark
        elif kind != NONE:
            gain[n + r] = (-1 if kind == FIRM else 1) * tie[kind] * (held[r] + 1)
        if around:
            edges.append((n + r, n + around, w.across))
    return gain, edges


def source_side(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut, by maximum flow.

    A positive ``gain`` is an edge from the source, a negative one an edge to
    the sink; ``edges`` join two nodes with a capacity both ways. Flow is pushed
    along shortest paths of one length at a time, a blocking flow each time.
    """
    n, tiny = len(gain), 1e-9
    arcs: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, c in edges:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to += (b, a)
        room += (c, c)
    supply, demand = [max(0.0, g) for g in gain], [max(0.0, -g) for g in gain]
    while True:
        level = [-1] * n
        wave = [i for i in range(n) if supply[i] > tiny]
        for i in wave:
            level[i] = 0
        depth = 0
        while wave and not any(demand[i] > tiny for i in wave):
            depth += 1
            further = []
            for a in wave:
                for k in arcs[a]:
                    if room[k] > tiny and level[to[k]] < 0:
                        level[to[k]] = depth
                        further.append(to[k])
            wave = further
        if not wave:
            return [x >= 0 for x in level]
        for a in wave:
            if demand[a] <= tiny:
                level[a] = -1  # of the last level only ends count
        place = [0] * n
        for s in range(n):
            if supply[s] <= tiny or level[s] != 0:
                continue
            path: list[int] = []
            a = s
            while True:
                if level[a] == depth and demand[a] > tiny:
                    flow = min(supply[s], demand[a], *(room[k] for k in path)) if path else min(supply[s], demand[a])
                    supply[s] -= flow
                    demand[a] -= flow
                    cut = len(path)
                    for i, k in enumerate(path):
                        room[k] -= flow
                        room[k ^ 1] += flow
                        if room[k] <= tiny and i < cut:
                            cut = i
                    if supply[s] <= tiny:
                        break
                    if cut < len(path):
                        a = to[path[cut] ^ 1]
                        del path[cut:]
                    continue
                own = arcs[a]
                while place[a] < len(own):
                    k = own[place[a]]
                    if room[k] > tiny and level[to[k]] == level[a] + 1 <= depth:
                        break
                    place[a] += 1
                if place[a] < len(own) and level[a] < depth:
                    path.append(own[place[a]])
                    a = to[path[-1]]
                    continue
                level[a] = -1  # a dead end
                if not path:
                    break
                a = to[path.pop() ^ 1]


def extract(page: str, w: Weights = Weights()) -> tuple[str, int, int]:
    """Main text, number of blocks, number of content blocks."""
    found, regions = blocks(page)
    content = source_side(*graph(found, regions, w))
    if found and not any(content[: len(found)]):  # a short page without marks
        content = source_side(*graph(found, regions, replace(w, bias=w.bias + w.second)))
    kept = [t for (_, t), c in zip(found, content) if c]
    return "\n".join(kept), len(found), len(kept)


def extract_pages(pages: DataFrame, weights: Weights = Weights(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, text, n_blocks and n_content_blocks.

    A null or empty page, or one without content, gives an empty text. Pages of
    any length and depth are read whole; unclosed tags end where a sibling
    begins, and a stray quote in a tag ends with the tag; extra columns are
    ignored; repeated rows and rows without an id are extracted alike; an empty table gives an empty result.
    """
    importable(pages.sparkSession)
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [extract(h or "", weights) for h in b.column(2).to_pylist()]
            text, n, k = zip(*got)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(k, pa.int64())], names=["id", "url", "text", "n_blocks", "n_content_blocks"])

    kinds = [src.schema[c].dataType.simpleString() for c in ("id", "url")]
    return src.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_blocks long, n_content_blocks long").withColumnsRenamed({"id": id_col, "url": url_col})
