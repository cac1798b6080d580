"""Main text of web pages by minimum cut.

A page is cut into blocks of text. A hand-set log-linear classifier over tags, class names, link density, length
and punctuation gives each block two costs, the capacities of its edges to the content and the boilerplate
terminal; neighbours in page order and blocks under one parent are tied by smoothness edges that weaken with distance
in the DOM. The minimum cut, found by maximum flow, labels all blocks of a page at once. Blocks whose terminal
edge outweighs all ties are settled first, which is exact and leaves most pages no flow to compute. Elements that aren't open
are never searched for, so a page of misnested tags takes time in proportion to its length.

Defined results: null, empty and markup-only pages give an empty text; unclosed and misnested tags are repaired as browsers
do for paragraphs and lists; a tag cut off at the end of a page is dropped; unknown character references stay as they are;
every row gives one row, repeated rows too; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "math", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "button", "label", "caption", "legend", "summary"}
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "nav", "aside", "footer", "header", "main", "body", "form"}
_AWAY = {"nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "button": -5.0, "dialog": -6.0, "header": -5.0, "label": -4.0, "fieldset": -5.0, "figcaption": -0.5}
_TOWARDS = {"article": 3.0, "main": 2.0}
_BAD = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|banner|sponsor\w*|promo\w*|cookies?\w*|consent|gdpr|notices?|alert|comments?|respond|reply|replies|disqus|sidebar|side-?bar|widgets?|menu|nav|navbar|navigation|navi|breadcrumbs?|footer|foot|header|head|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|subscribe|subscription|newsletter|popup|modal|overlay|pagination|pager|login|signin|signup|register|search|form|copyright|legal|disclaimer|toc|tags|skip\w*|author-?box|outbrain|taboola)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|contents|post|entry|story|main|text|body|prose)(?:$|[\s_-])", re.I)
_OWN = {"p": 1.0, "h1": 1.5, "h2": 1.0, "h3": 1.0, "h4": 0.5, "h5": 0.5, "h6": 0.5, "blockquote": 1.0, "pre": 1.0, "li": 0.0, "td": 0.2, "dd": 0.2}
SMOOTH, FADE = 1.2, 0.45


class _Node:
    __slots__ = ("block", "depth", "name", "parent", "weight")

    def __init__(self, name: str, attrs: str, parent: _Node | None):
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 0
        self.block = self if parent is None or name in _BLOCK else parent.block  # the nearest block element
        own = _AWAY.get(name, 0.0) + _TOWARDS.get(name, 0.0)
        if attrs:
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs))
            if names and _BAD.search(names) and name not in ("body", "html"):
                own -= 6.0
            elif names and _GOOD.search(names):
                own += 1.5
            if _HIDDEN.search(attrs):
                own -= 8.0
        self.weight = (parent.weight if parent else 0.0) + own


class Block:
    """A run of text under one block element."""

    __slots__ = ("cost", "linked", "node", "text")

    def __init__(self, text: str, linked: int, node: _Node):
        self.text, self.node = text, node
        self.linked = linked / max(1, len(text))
        words = text.count(" ") + 1
        score = -0.5 + max(-12.0, min(6.0, node.weight)) + _OWN.get(node.name, 0.0) - 4.0 * min(1.0, self.linked)
        score += 0.6 * math.log(1 + words / 8) + (0.5 if text[-1] in ".!?:;\"')" else 0.0)
        if words < 25 and re.search(r"©|\(c\)|copyright|all rights reserved", text, re.I):
            score -= 2.0
        self.cost = score


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    root = _Node("#", "", None)
    stack, parts, linked, link_depth = [root], [], 0, 0
    open_: Counter[str] = Counter()  # elements of the stack by name, so that what isn't open is never looked for

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, stack[-1].block))
        parts, linked = [], 0

    def pop_to(i: int) -> None:
        nonlocal link_depth
        for n in stack[i:]:
            open_[n.name] -= 1
            link_depth -= n.name == "a"
        del stack[i:]

    def nearest(names: set[str]) -> int:
        """The place of the nearest open element of a name, if no scope lies between; else 0."""
        if not any(open_[n] for n in names):
            return 0
        i = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name in names or stack[k].name in _SCOPE), 0)
        return i if i and stack[i].name in names else 0

    at, low = 0, None
    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
            if link_depth:
                linked += len(text.strip())
        if not m:
            break
        at = max(m.end(), m.start() + 1)
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if not m[1]:
            if name in _RAW and not m[3].endswith("/") and name != "head":
                low = low or page.lower()
                if len(low) != len(page):  # a letter whose lower case is longer
                    low = re.sub(r"[A-Z]", lambda x: x[0].lower(), page)
                end = low.find("</" + name, at)
                close = page.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(page)
                parts.append(" ")
                continue
            if name in _VOID:
                parts.append(" ") if name in ("br", "wbr", "img") else None
                if name == "hr":
                    flush()
                continue
            if name in _BLOCK:
                flush()
                i = nearest({"p"}) if name in _CLOSES_P else 0
                if i:
                    pop_to(i)
            closes = _SELF_CLOSING.get(name)
            i = nearest(closes) if closes else 0
            if i:
                pop_to(i)
            if not m[3].endswith("/"):
                stack.append(_Node(name, m[3], stack[-1]))
                open_[name] += 1
                link_depth += name == "a"
        else:
            i = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name) if open_[name] else 0
            if name in _BLOCK:
                flush()
            if i:
                pop_to(i)
    flush()
    return out


def _distance(a: _Node, b: _Node) -> int:
    """Edges on the DOM path between two elements."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def min_cut(gain: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the sum of max(0, -gain) of content, max(0, gain) of boilerplate and the ties cut; a
    block indifferent at the minimum is boilerplate."""
    n = len(gain)
    gain, label = list(gain), [None] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in ties:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    todo = deque(range(n))
    while todo:  # a terminal edge that outweighs all ties decides its block, whose ties then count as terminal ones
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) > sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    for i in range(n):
        if label[i] is None:
            part, todo_ = [i], [i]
            label[i] = False
            while todo_:  # undecided blocks that ties hang together
                for j in near[todo_.pop()]:
                    if label[j] is None:
                        label[j] = False
                        part.append(j)
                        todo_.append(j)
            for j in _source_side(part, gain, near):
                label[j] = True
    return label


def _source_side(part: list[int], gain: list[float], near: list[dict[int, float]]) -> list[int]:
    """Blocks on the content side of the minimum cut: maximum flow by layers, each layering filled with blocking flow."""
    place = {b: k for k, b in enumerate(part)}
    n = len(part)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((forth, back))

    for b, k in place.items():
        edge(s, k, gain[b], 0.0) if gain[b] > 0 else edge(k, t, -gain[b], 0.0)
        for j, w in near[b].items():
            if b < j:
                edge(k, place[j], w, w)
    least = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [b for b, k in place.items() if level[k] >= 0]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if cap[e] <= least)
                u = to[path[full] ^ 1]
                del path[full:]
                continue
            while turn[u] < len(out[u]):
                e = out[u][turn[u]]
                if cap[e] > least and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(out[u]):
                path.append(out[u][turn[u]])
                u = to[path[-1]]
            elif path:
                level[u] = -1  # leads nowhere
                u = to[path.pop() ^ 1]
                turn[u] += 1
            else:
                break


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line."""
    found = blocks(page or "")
    ties, under = [], {}
    for i, b in enumerate(found):
        if i:
            ties.append((i - 1, i, SMOOTH * FADE ** max(0, _distance(found[i - 1].node, b.node) - 2)))
        parent = b.node.parent or b.node
        before = under.get(id(parent))
        if before is not None and before != i - 1:
            ties.append((before, i, SMOOTH / 2))
        under[id(parent)] = i
    labels = min_cut([b.cost for b in found], ties)
    return "\n".join(b.text for b, content in zip(found, labels) if content)


def _extract(batches):
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
