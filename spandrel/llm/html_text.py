"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks with their open elements. A logistic classifier gives each block a chance of
being content; its two costs (negative log chances) become the capacities to the terminals, and smoothness
edges join blocks that follow each other and blocks that are neighbours below the same DOM node, heavier the
deeper their common ancestor. The minimum cut, found by maximum flow, is the labelling of least total cost.

The classifier is fitted on a bounded sample of pages (`TRAIN_PAGES`) with labels taken from the pages' own
semantic elements; half of the sample is fitted with those elements hidden, so that wording features carry
pages without them. Scripts, styles, titles, templates and form elements are left out while reading; one that is not
closed within its parent ends at the next block-level tag. All other elements' text is page text, formulas and
fallback contents included. Reading a page takes time in proportion to its length, however its tags are nested,
left open or cut off.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pages on which the classifier is fitted, about; only counts of feature patterns reach the driver.
TRAIN_PAGES = 1000
#: Elements whose content is not page text: scripts, styles, titles, inert templates and the parts of forms.
HIDDEN = frozenset("script style template title form textarea select button option datalist".split())
#: Of these, the ones whose content is no markup, and those within which another of their kind cannot open.
RAW = frozenset("script style title textarea".split())
SINGLE = frozenset("form button select option".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id and role that name parts other than the article.
PARTS = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|notices?|popup|modal|overlay|alert|newsletter|subscribe"
    r"|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toc|masthead|header|footer|copyright|comments?|replies|disqus|respond"
    r"|share|sharing|social|related|recommend(?:ed|ations)?|widget|toolbar|login|search|tags|skip)(?:$|[^a-z])"
)
MAIN = re.compile(r"(?:^|[^a-z])(?:article|main|content|entry|post|story|body-?text)(?:$|[^a-z])")
_OFF, _ON = frozenset("nav aside footer menu".split()), frozenset("article main".split())
#: A comment, declaration or tag. Quantifiers are possessive and alternatives exclusive, so no character is tried twice.
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*+)|<!\[CDATA\[(?:.*?\]\]>|.*+)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?|[\"'])*+)(?:>|\Z)",
    re.DOTALL,
)
_RAW_END = {t: re.compile(rf"</{t}\s*+>", re.IGNORECASE) for t in RAW}
_RAW_END["title"] = re.compile(r"</title\s*+>|<(?:/head|body|svg|title)(?=[\s/>])", re.IGNORECASE)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPACE = re.compile(r"[\s\x00]+")
#: Implied ends: an opening tag closes an open element of these, up to a container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_CONTAINERS = frozenset("article aside body div footer header main nav section table ul ol dl blockquote td".split())
_P = frozenset(("p",))
_CLOSABLE = frozenset("p li dt dd tr td th".split())


@dataclass
class Node:
    tag: str
    parent: "Node | None"
    depth: int
    off: bool
    on: bool
    #: Tags open here, up to the nearest container, that an opening tag may close.
    closable: frozenset[str] = frozenset()


@dataclass
class Tag:
    start: int
    end: int
    name: str
    closing: bool
    names: str
    #: Of a left-out element: the index of the tag from which reading goes on, and whether the tag before is its end.
    resume: int = -1
    ended: bool = False


@dataclass
class Block:
    text: str
    links: int
    node: Node


def tags_of(page: str) -> list[Tag]:
    """The page's tags in order, other markup as tags without a name; content that is no markup is part of its opening tag."""
    out, position, unended = [], 0, set()
    while m := _TOKEN.search(page, position):
        name, end = (m[2] or "").lower(), m.end()
        closing = bool(m[1])
        if name in RAW and not closing and name not in unended:
            stop = _RAW_END[name].search(page, end)
            if stop is None:
                unended.add(name)
            elif stop[0][:7].lower() == "</title" or name != "title":
                out.append(Tag(m.start(), stop.end(), name, False, "", len(out) + 1, True))
                position = stop.end()
                continue
        attributes = m[3] or ""
        out.append(Tag(m.start(), end, name, closing, attributes))
        position = end
    return out


def _leave_out(tags: list[Tag]) -> None:
    """Sets where reading goes on after each left-out element.

    One that is closed within its parent ends with its own end tag. Another, or one within which a tag of its kind
    opens that cannot, ends at the next block-level tag, or at the page's end.
    """
    n = len(tags)
    block_after, following = [n] * (n + 1), n
    for k in range(n - 1, -1, -1):
        block_after[k] = following
        if tags[k].name in BLOCKS or tags[k].name == "body":
            following = k
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    for k, tag in enumerate(tags):
        name = tag.name
        if tag.resume >= 0 or not (name in BLOCKS or name in HIDDEN) or name in VOID:
            continue
        if not tag.closing:
            if name in HIDDEN:
                tag.resume = block_after[k]
                if name in SINGLE and opened.get(name):
                    for other, j in reversed(stack):
                        if other == name:
                            tags[j].resume = min(tags[j].resume, k)
                            break
            stack.append((name, k))
            opened[name] = opened.get(name, 0) + 1
        elif opened.get(name):
            while True:
                last, j = stack.pop()
                opened[last] -= 1
                if last == name:
                    break
            if name in HIDDEN and not (name in SINGLE and tags[j].resume < block_after[j]):
                tags[j].resume, tags[j].ended = k + 1, True


def blocks_of(page: str | None) -> list[Block]:
    """The page's text blocks in order, white space collapsed and character references decoded."""
    root = Node("html", None, 0, False, False)
    node, anchors, links, parts, out, at = root, 0, 0, [], [], 0
    page = page or ""
    opened: dict[str, int] = {}

    def flush() -> None:
        nonlocal links
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(Block(text, links, node))
        parts.clear()
        links = 0

    def push(piece: str) -> None:
        nonlocal links
        parts.append(piece)
        links += len(piece) if anchors else 0

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent

    tags = tags_of(page)
    _leave_out(tags)
    k = 0
    while k < len(tags):
        t = tags[k]
        if t.start > at:
            push(page[at : t.start])
        at, k = t.end, k + 1
        tag = t.name
        if tag in HIDDEN:
            if tag in BLOCKS or tag == "title":
                flush()
            if not t.closing:
                k = t.resume
                at = tags[k - 1].end if t.ended else tags[k].start if k < len(tags) else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            anchors = 0 if t.closing else 1
        if tag not in BLOCKS:
            continue
        flush()
        if t.closing:
            if opened.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
        elif tag not in VOID:
            closes = _CLOSES.get(tag, _P)
            up = node
            while closes & up.closable and up.tag not in _CONTAINERS:
                if up.tag in closes:
                    leave(up.parent)
                up = up.parent
            if node.tag in closes and node is not root:
                leave(node.parent)
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(t.names)).lower() if "=" in t.names else ""
            if names and MAIN.search(names):  # the head of an article is no page header
                names = names.replace("header", "")
            off = node.off or tag in _OFF or tag == "header" and not node.on or bool(names and PARTS.search(names))
            on = node.on or tag in _ON or bool(names and MAIN.search(names))
            closable = frozenset() if tag in _CONTAINERS else node.closable
            node = Node(tag, node, node.depth + 1, off, on, closable | {tag} if tag in _CLOSABLE else closable)
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        push(page[at:])
    flush()
    return out


def features(block: Block, hide: bool = False) -> tuple[int, ...]:
    """Small integers, so that equal patterns can be counted."""
    text, n = block.text, len(block.text)
    return (
        1,
        0 if hide else int(block.node.off),
        0 if hide else int(block.node.on and not block.node.off),
        int(block.node.tag in ("p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6")),
        int(block.node.tag in ("li", "td", "th", "dd", "dt")),
        min(4, 4 * block.links // max(n, 1)),
        min(8, int(math.log2(n + 1))),
        int(text[-1] in ".!?:;\"'”»)"),
        int("©" in text or "all rights reserved" in text.lower()),
    )


WIDTH = 9
#: Costs without any labelled page: elements decide, then paragraphs and length against links.
PRIOR = (-1.0, -6.0, 6.0, 1.5, -0.5, -1.0, 0.2, 0.5, -3.0)


def fit(patterns: list[tuple[tuple[int, ...], int, int]], steps: int = 300) -> tuple[float, ...]:
    """Logistic weights from (pattern, label, count), shrunk towards PRIOR."""
    if len({y for _, y, _ in patterns}) < 2:
        return PRIOR
    x = np.array([p for p, _, _ in patterns], float)
    y, c = (np.array([p[k] for p in patterns], float) for k in (1, 2))
    prior = np.array(PRIOR)
    w, shrink, c = prior.copy(), 0.02, c / c.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + shrink * np.eye(WIDTH)
        step = np.linalg.solve(hessian, x.T @ (c * (p - y)) + shrink * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def sample_of(pages: DataFrame, limit: int = TRAIN_PAGES) -> DataFrame:
    """About `limit` pages, picked by a hash of the whole row, so that the files' layout has no say."""
    share = min(1.0, limit / max(pages.count(), 1))
    u = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns]), 11).cast("double") * F.lit(2.0**-53)
    return pages.filter(u < share)


def train(pages: DataFrame, text: str = "html", limit: int = TRAIN_PAGES) -> tuple[float, ...]:
    """Weights from about `limit` pages; blocks inside articles against other parts.

    A task reads `limit` pages of the sample at most. Only counts of feature patterns, which are few, reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        pages = 0
        for batch in batches:
            part = batch.column(0).slice(0, limit - pages).to_pylist() if pages < limit else []
            pages += len(part)
            for b in (b for page in part for b in blocks_of(page) if b.node.off or b.node.on):
                for hide in (False, True):
                    k = (features(b, hide), int(b.node.on and not b.node.off))
                    seen[k] = seen.get(k, 0) + 1
        if seen:
            yield pa.RecordBatch.from_pydict({"x": [list(k[0]) for k in seen], "y": [k[1] for k in seen], "n": list(seen.values())}, _COUNTS)

    common.small_batches(pages.sparkSession)
    counted = sample_of(pages, limit).select(text).mapInArrow(count, "x array<long>, y long, n long")
    rows = counted.groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    return fit(sorted((tuple(r["x"]), r["y"], r["n"]) for r in rows))


_COUNTS = pa.schema({"x": pa.list_(pa.int64()), "y": pa.int64(), "n": pa.int64()})


def _common_depth(a: Node, b: Node) -> int:
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a.depth


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: following blocks, and following blocks below the same parent node."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1].node
            near = _common_depth(a, b.node) / max(a.depth, b.node.depth, 1)
            edges.append((i - 1, i, 0.2 + near))
        parent = id(b.node.parent)
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, 0.5))
        last[parent] = i
    return edges


def minimum_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: cost[i] is what label True costs over False; an edge costs its weight when cut.

    A node whose own cost outweighs all its edges is settled and its edges move to its neighbours' terminals;
    maximum flow (Dinic) settles the rest. On a tie a node is True.
    """
    n = len(cost)
    cost, label = list(cost), [None] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(cost[i]) > sum(near[i].values()):
            label[i] = cost[i] < 0
            for j, w in near[i].items():
                cost[j] += -w if label[i] else w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        content = _flow(left, cost, near)
        for i in left:
            label[i] = i in content
    return label


def _flow(left: list[int], cost: list[float], near: list[dict[int, float]]) -> set[int]:
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {source: {}, sink: {}} | {i: dict(near[i]) for i in left}
    for i in left:
        a, b = (source, i) if cost[i] <= 0 else (i, sink)
        room[a][b] = abs(cost[i])
        room[b].setdefault(a, 0.0)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, r in room[u].items():
                if r > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            break
        todo = {u: iter(list(room[u])) for u in level}
        ahead = {u: next(todo[u], None) for u in level}  # the arc that a node tries: once given up, it stays so in this phase
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                push = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    room[a][b] -= push
                    room[b][a] = room[b].get(a, 0.0) + push
                path = path[: next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if room[a][b] <= 1e-12) + 1]
                continue
            v = ahead[u]
            if v is None:
                path.pop()
                if path:
                    ahead[path[-1]] = next(todo[path[-1]], None)
            elif room[u][v] > 1e-12 and level.get(v, -9) == level[u] + 1:
                path.append(v)
            else:
                ahead[u] = next(todo[u], None)
    reach_sink, queue = {sink}, deque([sink])
    while queue:
        v = queue.popleft()
        for u in room[v]:
            if u not in reach_sink and room[u].get(v, 0.0) > 1e-12:
                reach_sink.add(u)
                queue.append(u)
    return {i for i in left if i not in reach_sink}


def main_text(page: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    blocks = blocks_of(page)
    cost = []
    for b in blocks:
        score = sum(w * x for w, x in zip(weights, features(b), strict=True))
        cost.append(-max(-12.0, min(12.0, score)))
    keep = minimum_cut(cost, edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, weights: tuple[float, ...] | None = None, column: str = "html") -> DataFrame:
    """`pages` with main_text for every row. A null or empty page, or one without content, gives an empty text.

    Pages are read whole; rows are neither merged nor split, and a column of this name is replaced.
    """
    common.require(pages, column)
    weights = train(pages, column) if weights is None else weights
    common.small_batches(pages.sparkSession)
    pages = pages.drop("main_text")
    at = pages.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p, weights) for p in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "main_text"])

    return pages.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + ", main_text string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = common.read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
