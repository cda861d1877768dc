"""Main text of HTML pages by a minimum cut over their blocks and elements.

A page is cut into blocks of text.  A linear classifier gives each block a cost
for either label, content or boilerplate, by its words, links and ending; and
each element whose tag or names say something a cost for each block in it.  These
costs are the capacities to the two terminals.  Smoothness edges charge for
labels that differ: between a block and the nearest such element around it, or
such an element and the next one around it, as much as the outer one says of the
blocks concerned; between neighbours, the more the closer they are in the DOM;
and between one parent's consecutive children.  No block carries what is said
of the elements around it: that reaches it as flow.  The minimum cut of the graph, found
by maximum flow, is the labelling of least total cost; the content blocks joined
are the main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from termloom.llm._common import chunks

# Element names by their role in HTML.
RAW = "script|style|textarea|title|iframe|xmp|noframes"  # up to their own end tag
DROPPED = frozenset("noscript template svg math object canvas select button audio video datalist".split())  # up to their end tag or their parent's
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption summary caption legend hr option".split())
SPACES = frozenset(("br", "wbr", "img", "input"))
BAD_TAGS = frozenset("nav footer aside form menu dialog head fieldset search legend option".split())
GOOD_TAGS = frozenset(("article", "main"))
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adslot adbox sponsor sponsored promo promotion banner sidebar sidebars aside menu nav navbar navigation "
    "topnav footer masthead topbar toolbar breadcrumb breadcrumbs pagination pager comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget widgets skip print tags tagcloud".split()
)
WEAK_NAMES = frozenset("header head meta form top bottom links list rail info byline caption".split())
GOOD_NAMES = frozenset("article articlebody content main maincontent post entry story body text page hentry".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
NAME = re.compile(r"[^a-z0-9]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Weights of the classifier, in units of cost: of a block's own features, then of elements for each block in them; and of the smoothness edges.
BIAS, PER_LOG_WORD, SENTENCE, LINKED, HEADING, ITEM = -1.2, 0.5, 0.8, -4.0, 1.0, -0.4
ARTICLE, OUTSIDE, GOOD_NAME, WEAK_NAME, BAD = 4.0, -3.0, 2.0, -3.0, -12.0
NEAR, SIBLING = 0.8, 0.6


class Block(NamedTuple):
    text: str
    cost: float  # above 0: costs so much to call it boilerplate; below: to call it content
    parent: int  # the innermost element
    depth: int
    around: int  # the innermost element that something is said of, -1 if none


class Element(NamedTuple):
    cost: float  # for each block in it
    around: int
    article: bool  # the page's article begins here


def _names_cost(attributes: str) -> tuple[float, bool]:
    """The cost that an element's names say for each block in it; whether it is the article body."""
    if not attributes or attributes.isspace():
        return 0.0, False
    cost, body, bad = 0.0, False, False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            bad = True
        elif key == "role":
            body |= value.lower() in ("main", "article")
            bad |= value.lower() in BAD_ROLES
        elif key == "itemprop":
            body |= value.lower() == "articlebody"
            bad |= value.lower() == "comment"
        elif key in ("class", "id"):
            hits, good, weak = False, False, False
            for word in value.split():
                parts = [p for p in NAME.split(HUMP.sub("-", word).lower()) if p]
                hit = any(p in BAD_NAMES for p in parts) and not (parts and parts[0] in ("has", "with", "no", "is"))
                hits |= hit
                good |= not hit and any(p in GOOD_NAMES for p in parts)
                weak |= any(p in WEAK_NAMES for p in parts)
            bad |= hits
            cost += GOOD_NAME * (good and not hits) + WEAK_NAME * (weak and not good and not hits)
    return BAD if bad else cost, body


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The non-empty blocks of a page in order, and the elements that something is said of."""
    out: list[Block] = []
    said: list[Element] = []
    # open containers: (tag, element of ``said`` around, inside an article, inside a bad element, number)
    stack: list[tuple[str, int, bool, bool, int]] = [("", -1, False, False, 0)]
    parts: list[str] = []
    dropped: list[str] = []  # the open elements from a dropped one on
    linked, link, leaf, leaf_cost, number, at = 0, 0, "", 0.0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            words = text.count(" ") + 1
            cost = BIAS + PER_LOG_WORD * words.bit_length() + leaf_cost
            cost += SENTENCE if text[-1] in ".!?…:;\"”»’'" else 0
            cost += LINKED * min(1.0, linked / len(text))
            cost += HEADING if leaf[:1] == "h" and leaf != "hr" else ITEM if leaf == "li" else 0
            out.append(Block(text, cost, stack[-1][4], len(stack), stack[-1][1]))
        linked = 0

    for m in TOKEN.finditer(page):
        if m.start() > at and not dropped:
            piece = page[at : m.start()]
            parts.append(piece)
            if link:
                linked += len(piece)
        at = m.end()
        tag = m[3]
        if tag is None:
            parts.append(" " if m[1] and not dropped else "")
            continue
        tag = tag.lower()
        closing = bool(m[2])
        if dropped:
            if not closing:
                if tag in DROPPED or tag in BLOCKS:
                    dropped.append(tag)
                continue
            if tag in dropped:
                del dropped[len(dropped) - 1 - dropped[::-1].index(tag) :]
                continue
            if tag != leaf and all(t[0] != tag for t in stack[1:]):
                continue
            dropped.clear()  # the end tag of an element around
        if tag in DROPPED:
            if not closing and not (tag in ("svg", "math") and m[4].endswith("/")):
                parts.append(" ")
                dropped.append(tag)
        elif tag == "a":
            link = 0 if closing else 1
        elif tag in SPACES:
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            leaf, leaf_cost = "", 0.0
            if tag in LEAVES:
                if not closing:
                    leaf, leaf_cost = tag, _names_cost(m[4])[0]
            elif closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                if tag == "body":  # a head that was never closed ends here
                    del stack[1:]
                _, around, article, bad, _ = stack[-1]
                cost, body = _names_cost(m[4]) if tag not in ("html", "body") else (0.0, False)
                if tag in BAD_TAGS or tag == "header" and not article:
                    cost = BAD
                if tag == "article" and cost < 0 and any(t[0] == "article" for t in stack):
                    cost = BAD
                bad |= cost <= BAD
                begins = (body or tag in GOOD_TAGS) and not bad and not article
                article |= begins
                cost += ARTICLE if begins else 0
                number += 1
                if cost or begins:
                    said.append(Element(cost, around, begins))
                    around = len(said) - 1
                stack.append((tag, around, article, bad, number))
            link = 0 if tag != "li" and closing else link
    if at < len(page) and not dropped:
        parts.append(page[at:])
    flush()
    return out, said


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels of least cost: a node pays |cost| for the label its sign speaks against, an edge its weight if its ends differ.

    Maximum flow from the positive costs to the negative ones, by blocking flows
    over shortest paths; what the source still reaches is content.
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]
    ends = [(source, v, c, 0.0) for v, c in enumerate(costs) if c > 0]
    ends += [(v, sink, -c, 0.0) for v, c in enumerate(costs) if c < 0]
    ends += [(a, b, w, w) for a, b, w in edges if a != b and w > 0]
    for a, b, there, back in ends:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += (b, a)
        room += (there, back)
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = [source]
        for v in queue:
            for e in out[v]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * len(out)  # edges of each node that lead nowhere any more
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            own = out[v]
            while turn[v] < len(own):
                e = own[turn[v]]
                if room[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            if turn[v] < len(own):
                path.append(own[turn[v]])
                v = to[path[-1]]
            elif path:
                v = to[path.pop() ^ 1]
                turn[v] += 1
            else:
                break


def graph(found: list[Block], said: list[Element]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal costs and smoothness edges; the blocks come first, then the elements, then what is outside the article, if there is one."""
    n, m = len(found), len(said)
    outside = m if any(e.article for e in said) else -1
    inside, apart = [0] * (m + 1), [0] * (m + 1)  # blocks in each element, and those of them outside an article
    for b in found:
        inside[b.around] += 1
        apart[b.around] += 1
    for i in range(m - 1, -1, -1):
        inside[said[i].around] += inside[i]
        apart[i] = 0 if said[i].article else apart[i]
        apart[said[i].around] += apart[i]
    costs = [b.cost for b in found] + [e.cost * k for e, k in zip(said, inside)] + [OUTSIDE * apart[m]]
    edges, last = [], {}
    for i, b in enumerate(found):
        if b.around >= 0:
            edges.append((i, n + b.around, abs(said[b.around].cost)))
        elif outside >= 0:
            edges.append((i, n + outside, -OUTSIDE))
        if i:
            far = 0 if b.parent == found[i - 1].parent else 1 + abs(b.depth - found[i - 1].depth)
            edges.append((i - 1, i, NEAR / (1 + far)))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    for i, e in enumerate(said):
        if e.around >= 0:
            edges.append((n + i, n + e.around, abs(said[e.around].cost) * inside[i]))
        elif outside >= 0:
            edges.append((n + i, n + outside, -OUTSIDE * apart[i]))
    return costs, edges


def extract(page: str) -> str:
    """The main text of a page; blocks are joined by an empty line."""
    found, said = blocks(page)
    keep = minimum_cut(*graph(found, said))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every row; null html is empty and so is its text.

    A page without content blocks gives an empty text; blocks that either label
    would cost as much are left out. Whole pages of any length count. Repeated
    rows stay repeated; an empty table gives no rows; other columns, whatever
    their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunks(batches, "html"):
            text = [extract(x.decode("utf-8", "replace")) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(pages["page_id"], pages["url"], pages["html"].cast("binary").alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string")
