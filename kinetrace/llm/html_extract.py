"""Main text of web pages by a minimum cut between content and boilerplate.

A tolerant scanner turns a page into blocks of text, each with its place in the element tree. A
classifier weighs either label of a block by its length, punctuation, share of link text and kind,
and by the tags and class names above it: these costs are the capacities from the source and to the
sink. Neighbouring blocks are joined by smoothness edges, the stronger the closer they stand in the
tree and weak across the border of a menu, an advert or an article. The minimum cut (maximum flow)
is the cheapest labelling. Costs and edges are of one size: a short line is boilerplate by itself
and content between paragraphs, and a long one between menu entries goes with them. Blocks that no
neighbours can outvote are settled first, which leaves the cut unchanged; the flow runs over the rest.

Scanning takes time in proportion to the page, whatever its markup: elements point to their parents
and carry what their blocks need, and ends of tags are looked up in a table of `>` and quotes.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# HTML element names by role. RAW contents are no markup and never shown as text.
RAW = frozenset("script style template iframe title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
UNSEEN = frozenset("head select datalist canvas audio video".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset address button label".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
# Words of class and id names, split at punctuation and capitals.
BOILER_WORDS = frozenset("ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer footnav gdpr masthead menu menubar nav navbar navigation newsletter notice outbrain overlay pager pagination paywall popup promo promoted promotion recommended related replies reply sidebar signup sponsor sponsored subscribe subscription taboola teaser topbar widget widgets".split())
DOUBTFUL_WORDS = frozenset("banners byline captcha chat credits disclaimer discussion dropdown feedback form header legal links login meta modal notification popular privacy recommendation respond responses search share sharing skip social tags toolbar trending".split())
CONTENT_WORDS = frozenset("article articlebody body content entry main mainbody post postbody story text".split())

# Costs: evidence of the elements above a block, and of the block itself.
CONTENT, BOILER, DOUBTFUL, HEADER, LEAST = 2.2, -4.5, -1.8, -2.5, -8.0
BLANK, PER_WORD, MOST_WORDS, LINKED, STOP, PARAGRAPH, HEADING = -4.0, 0.12, 25, -3.0, 0.8, 0.8, 3.5
# Weights of edges: neighbours, more by their distance in the tree, across a border, next but one.
EDGE_NEXT, EDGE_NEAR, EDGE_BORDER, EDGE_SKIP = 1.2, 1.2, 0.1, 0.4

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ENDS = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Block:
    __slots__ = ("text", "links", "element", "tag")

    def __init__(self, text: str, links: int, element: _Element | None, tag: str):
        self.text, self.links, self.element, self.tag = text, links, element, tag


class _Element:
    """An open element: its parent, and what it hands on to the blocks below it."""

    __slots__ = ("tag", "parent", "depth", "evidence", "border", "unseen", "linked", "block", "inline")

    def __init__(self, tag: str, attrs: str, parent: _Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 1
        self.unseen = tag in UNSEEN or (parent is not None and parent.unseen)
        self.linked = tag == "a" or (parent is not None and parent.linked)
        self.block = self if tag in BLOCK else parent.block if parent else None
        self.inline: Counter | None = Counter() if tag in BLOCK else None  # open inline elements right below
        boiler, content, doubtful = tag in BOILER_TAGS, tag in CONTENT_TAGS, False
        for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                if tag not in ("body", "html"):
                    words = {w.lower() for w in _WORDS.findall(value)}
                    boiler |= not words.isdisjoint(BOILER_WORDS)
                    doubtful |= not words.isdisjoint(DOUBTFUL_WORDS)
                    content |= not words.isdisjoint(CONTENT_WORDS)
            elif name == "role":
                boiler |= value.lower() in BOILER_ROLES
                content |= value.lower() in ("main", "article")
            elif name == "itemprop":
                content |= value.lower() in ("articlebody", "text")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
                self.unseen = True
        above = parent.evidence if parent else 0.0
        if tag in CONTENT_TAGS:  # an article may stand inside anything
            above = CONTENT + 0.25 * min(above, 0.0)
        elif content and not (boiler or doubtful):
            above = min(CONTENT, above + CONTENT)
        if boiler:
            above += BOILER
        elif doubtful:
            above += DOUBTFUL
        elif tag == "header":
            above += HEADER
        self.evidence, self.border = max(LEAST, above), boiler or doubtful or tag in CONTENT_TAGS or tag == "header"


class _Ends:
    """Where tags end: at the first > that is outside quotes, or the first of all if there is none.

    A quote without a partner is an ordinary character. Quotes from which no end was found are
    remembered, so that no part of a page is searched again and again.
    """

    def __init__(self, page: str):
        self.at, self.kind = [], []
        for m in _ENDS.finditer(page):
            self.at.append(m.start())
            self.kind.append(m[0])
        n = len(self.at)
        self.partner, self.close, last, end = [n] * n, [n] * (n + 1), {}, n
        for k in range(n - 1, -1, -1):
            self.partner[k] = last.get(self.kind[k], n)
            last[self.kind[k]] = k
            end = k if self.kind[k] == ">" else end
            self.close[k] = end
        self.endless: set[int] = set()

    def find(self, start: int) -> int:
        """The place of the > that ends the tag begun before start; -1 if there is none."""
        first = k = bisect_left(self.at, start)
        n, passed = len(self.at), []
        while k < n and k not in self.endless:
            if self.kind[k] == ">":
                return self.at[k]
            passed.append(k)
            k = self.partner[k] + 1 if self.partner[k] < n else k + 1
        self.endless.update(passed)
        return self.at[self.close[first]] if self.close[first] < n else -1


class _Reader:
    """The open elements and the text of the block that is being read."""

    def __init__(self):
        self.top: _Element | None = None
        self.open: Counter = Counter()
        self.out: list[Block] = []
        self.parts: list[str] = []
        self.links = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text and not (self.top and self.top.unseen):
                block = self.top.block if self.top else None
                self.out.append(Block(text, self.links, self.top, block.tag if block else ""))
            self.parts.clear()
        self.links = 0

    def text(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if self.top and self.top.linked:
                self.links += len(text)

    def pop(self) -> None:
        e, self.top = self.top, self.top.parent
        self.open[e.tag] -= 1
        if e.inline is None and e.block:
            e.block.inline[e.tag] -= 1

    def pop_to(self, element: _Element) -> None:
        while self.top is not element:
            self.pop()
        self.pop()

    def close(self, tag: str) -> None:
        if self.open[tag] > 0 and (tag in BLOCK or not self.top.block or self.top.block.inline[tag] > 0):
            while self.top.tag != tag:  # inline elements don't close across blocks
                self.pop()
            self.pop()

    def start(self, tag: str, attrs: str) -> None:
        if tag == "body":
            while self.top:
                self.pop()
        elif tag in BLOCK:
            # an open paragraph ends, and what is left open inside it
            if self.top and self.top.block and self.top.block.tag == "p":
                self.pop_to(self.top.block)
            for closing in CLOSES.get(tag, ()):
                if self.top and self.top.block and self.top.block.tag == closing:
                    self.pop_to(self.top.block)
        self.top = _Element(tag, attrs, self.top)
        self.open[tag] += 1
        if self.top.inline is None and self.top.block:
            self.top.block.inline[tag] += 1


def blocks(page: str) -> list[Block]:
    """Blocks of visible text in page order; white space collapsed, references decoded."""
    reader, ends, at = _Reader(), _Ends(page), 0
    while True:
        begin = page.find("<", at)
        if begin < 0:
            reader.text(page[at:])
            break
        reader.text(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            if end < 0:
                break
            at = end + 3
            continue
        m = _TAG.match(page, begin)
        if m is None:
            end = page.find(">", begin) if page[begin + 1 : begin + 2] in ("!", "?", "/") else -1
            at = end + 1 if end >= 0 else begin + 1
            if end < 0:
                reader.text("<")
            continue
        end = ends.find(m.end())
        if end < 0:
            reader.text(page[begin:])
            break
        tag, attrs, at = m[1].lower(), page[m.end() : end], end + 1
        if tag == "br":
            reader.text(" ")
            continue
        if tag in BLOCK:
            reader.flush()
        if page[begin + 1] == "/":
            reader.close(tag)
        elif tag in RAW:
            done = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if done is None:
                break
            end = page.find(">", done.end())
            if end < 0:
                break
            at = end + 1
        elif tag not in VOID:
            reader.start(tag, attrs)
    reader.flush()
    return reader.out


def preference(block: Block) -> float:
    """How much the classifier prefers the label content (below 0: boilerplate)."""
    words = block.text.count(" ") + 1
    share = min(1.0, block.links / max(1, len(block.text)))
    score = BLANK + PER_WORD * min(words, MOST_WORDS) + LINKED * share
    score += STOP * (block.text[-1] in ".!?…:;\"”»") + PARAGRAPH * (block.tag in ("p", "blockquote", "pre")) + HEADING * (block.tag in ("h1", "h2", "h3"))
    if block.element:
        score += block.element.evidence
        if block.tag == "h1" and block.element.block.parent and block.element.block.parent.tag == "header":
            score -= HEADER
    return score


def edges(items: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours, more where their elements are close, and to the next but one."""
    out = []
    for i in range(len(items) - 1):
        a, b, distance, border = items[i].element, items[i + 1].element, 0, False
        while a is not b:  # up to the first common element; adds up to one walk around the tree
            if b is None or (a is not None and a.depth >= b.depth):
                border |= a.border
                a = a.parent
            else:
                border |= b.border
                b = b.parent
            distance += 1
        out.append((i, i + 1, EDGE_BORDER if border else EDGE_NEXT + EDGE_NEAR / max(1, distance - 1)))
        if i + 2 < len(items) and _parent(items[i]) is _parent(items[i + 2]) and not border:
            out.append((i, i + 2, EDGE_SKIP))
    return out


def _parent(block: Block) -> _Element | None:
    return block.element.parent if block.element else None


def minimum_cut(scores: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """The labels (True: content) of least cost: a label against a score costs its size, an edge
    between different labels its weight. Ties go to boilerplate."""
    n = len(scores)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in links:
        near[i].append((j, w))
        near[j].append((i, w))
    label: list[bool | None] = [None] * n
    pull = list(scores)
    free = [sum(w for _, w in x) for x in near]
    todo = deque(range(n))
    while todo:  # no neighbours can outvote these
        i = todo.popleft()
        if label[i] is None and abs(pull[i]) > free[i]:
            label[i] = pull[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    pull[j] += w if label[i] else -w
                    free[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i in _source_side({i: pull[i] for i in rest}, [(i, j, w) for i, j, w in links if label[i] is None and label[j] is None]):
            label[i] = True
    return [bool(x) for x in label]


def _source_side(pull: dict[int, float], links: list[tuple[int, int, float]]) -> set[int]:
    """Nodes that the source reaches after a maximum flow (blocking flows on level graphs)."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: {} for i in (*pull, source, sink)}
    for i, score in pull.items():
        a, b, w = (source, i, score) if score > 0 else (i, sink, -score)
        room[a][b], room[b][a] = w, room[b].get(a, 0.0)
    for i, j, w in links:
        room[i][j] = room[i].get(j, 0.0) + w
        room[j][i] = room[j].get(i, 0.0) + w
    tiny = 1e-9
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, w in room[a].items():
                if w > tiny and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return {i for i in level if i >= 0}
        ways = {a: list(room[a]) for a in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                flow = min(room[x][y] for x, y in zip(path, path[1:], strict=False))
                for x, y in zip(path, path[1:], strict=False):
                    room[x][y] -= flow
                    room[y][x] += flow
                cut = next(k for k in range(len(path) - 1) if room[path[k]][path[k + 1]] <= tiny)
                del path[cut + 1 :]
                continue
            while ways[a] and not (room[a][ways[a][-1]] > tiny and level.get(ways[a][-1]) == level[a] + 1):
                ways[a].pop()
            if ways[a]:
                path.append(ways[a][-1])
            else:
                path.pop()
                if path:
                    ways[path[-1]].pop()


def main_text(page: str | None) -> str:
    """The main text of one page: content blocks joined by line feeds; '' for null or empty pages."""
    items = blocks(page or "")
    if not items:
        return ""
    keep = minimum_cut([preference(b) for b in items], edges(items))
    return "\n".join(b.text for b, k in zip(items, keep, strict=True) if k)


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of every page with text and n_chars (its code points).

    Null and empty pages give ''; repeated rows give equal texts; broken markup is read as far as
    it makes sense and never fails; a page of any length takes time in proportion to it and memory
    of some hundred bytes a tag. Columns text and n_chars are replaced.
    """
    keep = [c for c in keep if c not in ("text", "n_chars")]
    df = pages.select(*dict.fromkeys([*keep, "html"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 500):
                batch = whole.slice(lo, 500)
                texts = [main_text(x) for x in batch.column(batch.schema.get_field_index("html")).to_pylist()]
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    fields = [f for f in df.schema.fields if f.name in keep]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
