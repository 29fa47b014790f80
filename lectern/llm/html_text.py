"""Main text of web pages by minimum-cut labelling of their blocks.

A page is a row of blocks. A linear classifier (``WEIGHTS``) gives each block a cost for being called content and
one for being called boilerplate; they are the capacities of its edges to the two terminals. All neighbours in
page order, and blocks with a near common ancestor, are tied by smoothness edges, the more the nearer they are in the
tree. The maximum flow between the terminals leaves the cheapest labelling: what the source still reaches is content.
So a paragraph of one word stays between long ones, and a long advert in a row of links goes with them.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?][^>]*>", re.S)
#: Elements whose content is never shown as text.
_SILENT = {"script", "style", "noscript", "template", "svg", "annotation", "annotation-xml", "head", "title", "iframe", "audio", "video", "textarea", "select", "datalist", "option"}
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "msub", "msup", "msubsup", "munder", "mover", "semantics"}
#: Elements that hold page furniture, and those that hold the article.
_FURNITURE = {"nav", "footer", "aside", "form", "menu", "button", "dialog", "fieldset", "search"}
_ARTICLE = {"article", "main"}
#: Words in class, id and role that tell of either.
_BAD = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|banners?|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|foot\w*|side-?bars?|widgets?|comment\w*|disqus|repl(?:y|ies)|responses?|respond|reactions?|discussion|cookies?|consent|notices?|alerts?|popup|modal|newsletter|subscri\w*|sign-?up|login|social|share\w*|sharing|related|recommend\w*|pager|pagination|toolbar|copyright|legal|skip|search|tags?|masthead|topbar|complementary|contentinfo|navigation)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main\w*|body|story|post(?:-?(?:content|body|text))?|entry(?:-?\w+)?|text|page-?content)(?:$|[\s_-])", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|page-?header|site-?header|banner)(?:$|[\s_-])", re.I)
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPACE = re.compile(r"\s+")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: The classifier: what each feature of a block adds to its gain (above 0: content). Integers, so that flows are exact.
WEIGHTS = {
    "block": -30, "word": 2, "sentence": 15, "comma": 3, "heading": 16, "paragraph": 4, "item": -10, "item_of_text": 8, "linked": -100, "rights": -60,
    "article": 24, "unmarked": 22, "outside": -40, "body_class": 20, "outside_body": -15, "furniture": -100, "furniture_class": -100, "header": -70,
}
MOST_WORDS, MOST_COMMAS = 30, 5
#: Smoothness between neighbours that are siblings, less by the fourth power of their distance in the tree, so that neighbours
#: of different containers hardly pull; and to the last block of the same parent and grandparent. Between a block in furniture
#: and one outside it, and between a block of links and one of text, an edge has a part of its capacity only.
SMOOTH_NEXT, SMOOTH_PARENT, SMOOTH_GRANDPARENT, CONTRAST = 40, 16, 8, 8
#: A block with a larger share of linked text is a block of links.
MOST_LINKED = 0.5
#: An element with so much of the page's (or the article's) text is layout, whatever its class says.
MOST_TEXT = 0.6


class Block:
    __slots__ = ("text", "linked", "path", "tag")

    def __init__(self, text, linked, path, tag):
        self.text, self.linked, self.path, self.tag = text, linked, path, tag


class Element:
    __slots__ = ("tag", "up", "bad", "good", "head", "size")

    def __init__(self, tag, up):
        self.tag, self.up, self.bad, self.good, self.head, self.size = tag, up, 0, False, False, 0


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page in order, each with the share of linked text and its ancestors' numbers, and the elements."""
    out: list[Block] = []
    elements = [Element("", 0)]
    stack: list[tuple[str, int]] = [("", 0)]
    parts: list[str] = []
    linked = in_link = 0
    at, raw = 0, None

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts)).replace("\x00", "")).strip()
            if text:
                path = [n for t, n in stack if t not in _INLINE]
                out.append(Block(text, linked / max(1, sum(map(len, parts))), path, elements[path[-1]].tag))
            parts.clear()
        linked = 0

    while at < len(page):
        if raw is not None:
            close = re.compile(rf"</{raw[0]}(?=[\s/>])[^>]*>", re.I).search(page, at)
            # One that is closed in itself, as in XML, hides nothing where no end follows.
            at, raw = (close.end() if close else at if raw[1] else len(page)), None
            continue
        m = _TOKEN.search(page, at)
        chunk = page[at : m.start() if m else len(page)]
        if chunk:
            parts.append(chunk)
            linked += len(chunk) if in_link else 0
        if m is None:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if name in _SILENT:
            if not m[1] and name != "head" and (name in _RAW or not m[3].endswith("/")):
                raw = name, m[3].endswith("/")
            if name not in ("svg", "annotation", "annotation-xml"):
                flush()
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            elif name == "br":
                parts.append(" ")
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if name not in _INLINE:
                flush()
            if depth:
                if name in _INLINE and any(t not in _INLINE for t, _ in stack[depth + 1 :]):
                    continue  # an inline element doesn't close blocks that were opened in it
                del stack[depth:]
            if name == "a":
                in_link = 0
            continue
        if name not in _INLINE:
            flush()
            if name in _CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] not in _INLINE:
                        break
            elif name in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] == name:
                stack.pop()
        e = Element(name, stack[-1][1])
        if name in _FURNITURE:
            e.bad = WEIGHTS["furniture"]
        elif name == "header":
            e.head = True
        if m[3] and name not in _INLINE:
            told = " ".join(a.strip("\"'") for a in _ATTR.findall(m[3]))
            if told:
                if _BAD.search(told):
                    e.bad = min(e.bad, WEIGHTS["furniture_class"])
                elif _HEADER.search(told):
                    e.head = True
                elif _GOOD.search(told):
                    e.good = True
        stack.append((name, len(elements)))
        elements.append(e)
        if name == "a":
            in_link = 1
    flush()
    return out, elements


def graph(page: str) -> tuple[list[Block], list[int], list[tuple[int, int, int]]]:
    """Blocks, the gain of calling each content, and the smoothness edges (a, b, capacity)."""
    bs, elements = parse(page)
    total = 0
    for b in bs:
        n = int(len(b.text) * (1 - b.linked))
        total += n
        for k in b.path:
            elements[k].size += n

    def above(k: int) -> list[int]:
        out = [k]
        while k:
            k = elements[k].up
            out.append(k)
        return out

    def is_layout_tag(e: Element) -> bool:
        return e.tag in ("", "html", "body")

    # The article: main, or the largest article element that isn't in furniture unless it is most of the page.
    mains = [k for k, e in enumerate(elements) if e.tag == "main" and e.size]
    articles = [k for k, e in enumerate(elements) if e.tag == "article" and e.size and (2 * e.size > total or not any(elements[j].bad for j in above(k) if not is_layout_tag(elements[j])))]
    top = max(mains or articles, key=lambda k: elements[k].size, default=None)
    held = set(above(top)) if top is not None else set()
    inner = set(mains or articles)
    body = any(e.good and e.size > 0.3 * total for e in elements)
    # What the ancestors tell, from the outside in: furniture, inside the article, inside a body by its class.
    told: list[tuple[int, bool, bool]] = []
    for k, e in enumerate(elements):
        bad, inside, good = told[e.up] if k else (0, False, False)
        inside = inside or k in inner
        layout = is_layout_tag(e) or k in held or (e.size > MOST_TEXT * total if top is None else inside and e.size > MOST_TEXT * elements[top].size)
        if not layout:
            bad = min(bad, e.bad, WEIGHTS["header"] if e.head and not inside else 0)
        told.append((bad, inside, good or e.good))
    gain = []
    for b in bs:
        bad, inside, good = told[b.path[-1]]
        words = b.text.count(" ") + 1
        g = WEIGHTS["block"] + WEIGHTS["word"] * min(words, MOST_WORDS) + WEIGHTS["comma"] * min(b.text.count(","), MOST_COMMAS) + int(WEIGHTS["linked"] * b.linked) + bad
        if words > 3 and b.text[-1] in ".!?…:\"”»":
            g += WEIGHTS["sentence"]
        if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            g += WEIGHTS["heading"]
        elif b.tag in ("p", "blockquote", "pre"):
            g += WEIGHTS["paragraph"]
        elif b.tag in ("li", "dt", "dd", "td", "th", "label"):
            g += WEIGHTS["item_of_text" if inside or (top is None and not good and not body) else "item"]
        if top is not None:
            g += WEIGHTS["article"] if inside else WEIGHTS["outside"]
        elif good:
            g += WEIGHTS["body_class"]
        elif body:
            g += WEIGHTS["outside_body"]
        else:
            g += WEIGHTS["unmarked"]
        if not inside and _RIGHTS.match(b.text):
            g += WEIGHTS["rights"]
        gain.append(g)
    edges, last = [], {}
    marked = [(told[b.path[-1]][0] < 0, b.linked > MOST_LINKED) for b in bs]

    def tie(j: int, i: int, weight: int) -> None:
        edges.append((j, i, weight if marked[i] == marked[j] else weight // CONTRAST))

    for i, b in enumerate(bs):
        if i:
            a, z = bs[i - 1].path, b.path
            same = 0
            for x, y in zip(a, z, strict=False):
                if x != y:
                    break
                same += 1
            # 0 for two blocks of one element, 1 for siblings.
            apart = max(1, max(len(a), len(z)) - same)
            tie(i - 1, i, SMOOTH_NEXT // apart**4)
        for k, weight in ((-2, SMOOTH_PARENT), (-3, SMOOTH_GRANDPARENT)):
            up = b.path[k] if len(b.path) >= -k else None
            if up is not None and up:
                j = last.get((k, up))
                if j is not None and j != i - 1:
                    tie(j, i, weight)
                last[k, up] = i
    return bs, gain, edges


def min_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of the nodes on the source's side. gain: source less sink capacity of each node; edges: (a, b, capacity) both ways.

    Flow is sent in phases: all nodes are levelled by their distance from those that still have some, and it is then sent along levels until none gets through.
    """
    n = len(gain)
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in edges:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += (b, a)
        room += (c, c)
    excess = list(gain)  # above 0: what the source can still send here; below 0: what the sink still takes
    while True:
        level = [0 if x > 0 else -1 for x in excess]
        queue, met = deque(i for i, x in enumerate(excess) if x > 0), False
        sources = list(queue)
        while queue:
            i = queue.popleft()
            met = met or excess[i] < 0
            for e in out[i]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not met:
            return [x >= 0 for x in level]
        following = [0] * n
        for s in sources:
            path: list[int] = []
            i = s
            while excess[s] > 0:
                if excess[i] < 0:
                    flow = min(excess[s], -excess[i], *(room[e] for e in path))
                    excess[s] -= flow
                    excess[i] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, i = [], s
                    continue
                while following[i] < len(out[i]):
                    e = out[i][following[i]]
                    if room[e] > 0 and level[to[e]] == level[i] + 1:
                        break
                    following[i] += 1
                if following[i] < len(out[i]):
                    path.append(e)
                    i = to[e]
                elif path:
                    i = to[path.pop() ^ 1]
                    following[i] += 1
                else:
                    break


def main_text(page: str) -> str:
    """The blocks of the page that the cut calls content, joined by newlines."""
    bs, gain, edges = graph(page)
    return "\n".join(b.text for b, keep in zip(bs, min_cut(gain, edges), strict=True) if keep)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Null and empty pages have an empty text; null ids and repeated rows are kept; further columns are left
    aside; an empty table gives no rows. Pages are worked on one by one, without a shuffle, and whole, however long. A block
    whose two labels cost the same is content if content reaches it by an edge, else boilerplate.
    """
    common.small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch):
        found = [main_text(t) for t in common.texts(batch)]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return common.map_batches(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
