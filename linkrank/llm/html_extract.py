"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks at block-level tags. A classifier gives each block log-odds for being content, whose
size is the capacity to one of the two terminals. Smoothness edges join blocks that follow each other and blocks with
their DOM container, and containers with theirs. The minimum cut between the terminals separates content from
boilerplate; blocks on the content side make the text.

The classifier has two parts. What an author marked (``nav``, ``article``, ``class="sidebar"``) has fixed weights, since it
is a statement of its own. What a text looks like (link share, number of words, end, tag) is learned by logistic
regression: marked blocks teach the look of unmarked ones. The capacity of an edge is learned as well: the log-odds that two such
neighbours have one label. :func:`train` fits both to a bounded sample of at most ``TRAIN_PAGES`` pages; the sample counts as
``SAMPLE_WEIGHT`` blocks against the written starting weights, so that one host's habits don't outweigh all others.
Without a sample, the starting weights hold.

Before the flow is computed, every node whose own cost outweighs all its edges is labelled, which is exact (no cut of
the edges can pay for the other label), and its edges are folded into its neighbours' costs; what remains is small.

Rules: character references are decoded, white space inside a block becomes one space, blocks are joined by a line
feed. A ``br`` is white space. A head ends where the HTML standard ends it, with or without a tag. Scripts, styles, comments, form controls and the head have no text;
formulas have theirs, without annotations. A null or empty page,
or one without content, gives an empty text. Unclosed and stray tags are accepted; a tag or script that is cut off at the
end of the page has no text. Nothing is dropped for its length. Repeated rows are extracted alike, an empty table gives no
rows, and columns other than page_id, url and html play no part.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrank.llm.common import bound_batches, map_arrow

# Tags of HTML by their role.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text alone up to the end tag, or to the end of the page.
RAW_TAGS = ("script", "style", "iframe", "textarea", "title")
#: Without text up to their own end tag; without one, they are a tag alone.
SKIPPED_TAGS = frozenset("noscript template svg annotation annotation-xml object select".split())
#: Start tags that may stand in the head; any other one, or text, ends it. Start tags before which svg and math must have ended.
HEAD_TAGS = frozenset("base basefont bgsound link meta title noscript noframes script style template".split())
BREAKOUT_TAGS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HIDDEN_TAGS = frozenset("button option datalist canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Log-odds of what an author marked, for content (positive) or boilerplate (negative).
TAG_MARKS = {"article": 9.0, "main": 5.0, "nav": -20.0, "footer": -20.0, "aside": -20.0, "form": -20.0, "menu": -20.0, "dialog": -20.0, "header": -11.0, "fieldset": -10.0}
#: A header inside an article is its own.
ARTICLE_HEADER = -1.5
# Words of classes, ids and roles by what they name, and the log-odds of each group.
NAME_WORDS = {
    "text": "article articlebody post entry story content main text body prose",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay paywall subscribe subscription newsletter signup login",
    "comment": "comment comments disqus reply replies respond discussion reader reactions",
    "navigation": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sitemap skip",
    "side": "sidebar side rail widget widgets related recommended recommendations trending popular teaser share sharing social follow tags",
    "frame": "footer header masthead copyright legal colophon toolbar topbar",
}
NAME_MARKS = {"text": 1.5, "ad": -20.0, "notice": -20.0, "comment": -22.0, "navigation": -20.0, "side": -20.0, "frame": -19.0}
#: Words that add nothing to the others of a name. A name with any other word may mean something else: its mark counts ``FAINT`` of the whole.
PLAIN_WORDS = frozenset("area articles bar bottom block box column container global group id inner item items js left link links list module news outer page panel primary posts region right row secondary section site slot stories title top unit wrap wrapper zone".split())
FAINT = 0.2

# Starting log-odds of a text's look, by feature and value; the bounds of the first two features.
LINK_BOUNDS, WORD_BOUNDS = (0.01, 0.2, 0.5, 0.8), (4, 8, 15, 40)
START = {
    "always": [1.5],
    "links": [0.0, -0.5, -2.0, -3.5, -5.0],
    "words": [-1.0, -0.5, 0.2, 1.5, 2.0],
    "ends": [0.0, 0.8],
    "copyright": [0.0, -3.0],
    "kind": [0.0, 0.8, 0.8, 0.0],
}
#: Starting capacities between neighbours of one container, between others, and between containers; bounds of learned ones.
EDGES, EDGE_BOUNDS = {"within": 1.0, "across": 0.4, "containers": 0.3}, (0.2, 2.0)
#: Pages that the classifier learns from at most, and so many blocks that they count as.
TRAIN_PAGES, SAMPLE_WEIGHT = 3000, 200.0

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_raw_end = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.IGNORECASE) for t in RAW_TAGS}
_attribute = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_name_words = re.compile(r"[a-z]+")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")
_no_display = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_group = {w: group for group, words in NAME_WORDS.items() for w in words.split()}


def name_marks(name: str) -> set[tuple[str, float]]:
    """The mark that a class, id or role gives, and how much it counts."""
    words = _name_words.findall(_camel.sub(" ", name).lower())
    groups = {_group[w] for w in words if w in _group}
    if not groups:
        return set()
    strongest = min(groups, key=NAME_MARKS.get) if groups != {"text"} else "text"
    return {(strongest, 1.0 if all(w in _group or w in PLAIN_WORDS for w in words) else FAINT)}


def attribute_marks(attributes: str) -> tuple[set[tuple[str, float]], bool]:
    """Marks of a tag's names, and whether it is hidden."""
    marks, hidden = set(), False
    for m in _attribute.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role", "itemprop"):
            for name in value.split():
                marks |= name_marks(name)
        hidden = hidden or key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and bool(_no_display.search(value)))
    return marks, hidden


class _Node:
    __slots__ = ("tag", "parent", "marks", "evidence", "taught", "hidden", "link", "article", "block")

    def __init__(self, tag: str, parent: "_Node | None", attributes: str):
        self.tag, self.parent = tag, parent
        inside = bool(parent and parent.article)
        self.article = tag == "article" or inside
        fresh: dict[str, float] = {}
        if tag in TAG_MARKS:
            fresh["article header" if tag == "header" and inside else tag] = 1.0
        hidden = tag in HIDDEN_TAGS
        if attributes:
            names, off = attribute_marks(attributes)
            hidden = hidden or off
            if tag not in ("html", "body"):
                for name, share in names:
                    fresh["name " + name] = max(share, fresh.get("name " + name, 0.0))
        self.marks: dict[str, float] = parent.marks if parent else {}
        if any(share > self.marks.get(mark, 0.0) for mark, share in fresh.items()):
            self.marks = {**self.marks, **{m: max(x, self.marks.get(m, 0.0)) for m, x in fresh.items()}}
        if parent and self.marks is parent.marks:
            self.evidence, self.taught = parent.evidence, parent.taught
        else:
            costs = [x * _mark_cost(m) for m, x in self.marks.items()]
            self.evidence = sum(costs)
            # one plain mark of boilerplate decides what the block teaches, then one of content
            self.taught = False if min(costs, default=0.0) <= -5.0 else True if max(costs, default=0.0) >= 3.0 else None
        self.hidden = hidden or bool(parent and parent.hidden)
        self.link = tag == "a" or bool(parent and parent.link)
        self.block = tag in BLOCK_TAGS


def _mark_cost(mark: str) -> float:
    return ARTICLE_HEADER if mark == "article header" else NAME_MARKS[mark[5:]] if mark.startswith("name ") else TAG_MARKS[mark]


def _tokens(page: str) -> list[tuple[int, int, str | None, bool, str]]:
    """(start, end, name, closing, attributes) of each tag; a raw element is one token, a comment one without a name."""
    out, at, foreign = [], 0, False
    while m := _token.search(page, at):
        name, closing, attributes, at = m[2] or m[5], bool(m[1] or m[4]), m[3] or m[6] or "", m.end()
        if name is not None:
            name = name.lower()
            if name in ("svg", "math"):
                foreign = not closing and not attributes.endswith("/")
            elif name in BREAKOUT_TAGS:
                foreign = False
            # inside svg and math, a raw element may close itself
            elif name in _raw_end and not closing and not (foreign and attributes.endswith("/")):
                end = _raw_end[name].search(page, at)
                at = end.end() if end else len(page)
        out.append((m.start(), at, name, closing, attributes))
    return out


def _skips(page: str, tokens: list[tuple[int, int, str | None, bool, str]]) -> dict[int, tuple[int, int]]:
    """For start tags of elements without text, where reading goes on: number of the next token, position in the page."""
    out: dict[int, tuple[int, int]] = {}
    opened: dict[str, list[int]] = {t: [] for t in (*SKIPPED_TAGS, "foreignobject")}
    heads = []
    for k, (start, end, name, closing, attributes) in enumerate(tokens):
        if name in opened:
            if closing:
                if opened[name]:
                    out[opened[name].pop()] = (k + 1, end)
            elif not (name in ("svg", "math", "foreignobject") and attributes.endswith("/")):
                opened[name].append(k)
        elif name in BREAKOUT_TAGS and not closing and not opened["foreignobject"]:
            opened["svg"].clear()
        if name == "head" and not closing:
            heads.append(k)
    for head in heads:
        k, at = head + 1, tokens[head][1]
        while k < len(tokens):
            start, end, name, closing, _ = tokens[k]
            if page[at:start].strip() or (name is not None and (name in ("head", "body", "html", "br") if closing else name not in HEAD_TAGS)):
                break
            k, at = out.get(k, (k + 1, end))
        out[head] = (k, at)
    return out


def blocks_of(page: str) -> list[tuple[str, float, _Node]]:
    """Text, share of it inside links, and container of each block, in page order."""
    root = _Node("#root", None, "")
    stack, blocks = [root], []
    parts: list[tuple[str, bool]] = []

    def flush(container: _Node) -> None:
        if parts:
            text = " ".join("".join([t for t, _ in parts]).split())
            if text:
                total = sum([len(t) for t, _ in parts])
                blocks.append((text, sum([len(t) for t, link in parts if link]) / total, container))
            parts.clear()

    def container_of(node: _Node) -> _Node:
        while not node.block and node.parent is not None:
            node = node.parent
        return node

    tokens = _tokens(page)
    skips = _skips(page, tokens)
    at = following = 0
    for k, (start, end, name, closing, attributes) in enumerate(tokens):
        if k < following:
            continue
        if start > at:
            top = stack[-1]
            if not top.hidden:
                parts.append((html_lib.unescape(page[at:start]), top.link))
        following, at = skips.get(k, (k + 1, end))
        if name is None or not closing and (name in SKIPPED_TAGS or name in _raw_end or name == "head"):
            continue
        if closing:
            if name in BLOCK_TAGS:
                flush(container_of(stack[-1]))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if name not in BLOCK_TAGS and stack[k].block:
                    break
            continue
        if name in BLOCK_TAGS:
            flush(container_of(stack[-1]))
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in HEADINGS:
                _close_implied(stack, name)
        elif name == "br":
            parts.append((" ", stack[-1].link))
        if name not in VOID_TAGS and not attributes.endswith("/"):
            stack.append(_Node(name, stack[-1], attributes))
    rest = page[at:]
    if rest and not stack[-1].hidden:
        parts.append((html_lib.unescape(rest), stack[-1].link))
    flush(container_of(stack[-1]))
    return blocks


# Which open tags a new tag ends, and where the search for them stops.
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table tbody thead tfoot div section article body #root".split())


def _close_implied(stack: list[_Node], name: str) -> None:
    ends = _IMPLIED.get(name, ("p",))
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in ends:
            del stack[k:]
            return
        if stack[k].tag in _SCOPE or (ends != ("p",) and stack[k].tag in ("ul", "ol", "dl", "table")) or (stack[k].block and ends == ("p",)):
            return


def look_of(text: str, links: float, node: _Node) -> tuple[int, ...]:
    """The value of each feature in ``START``, in that order."""
    words = text.count(" ") + 1
    kind = 1 if node.tag == "p" else 2 if node.tag in HEADINGS else 3 if node.tag in ("li", "dt", "dd", "td", "th") else 0
    return (0, sum([links >= x for x in LINK_BOUNDS]), sum([words >= x for x in WORD_BOUNDS]), int(text[-1] in ".!?…。؟\"”»"), int("©" in text or "All rights reserved" in text), kind)


@dataclass(frozen=True)
class Model:
    """Log-odds of each feature's values, in the order of ``START``, and capacities of the edges."""

    look: tuple[tuple[float, ...], ...] = tuple(tuple(x) for x in START.values())
    within: float = EDGES["within"]
    across: float = EDGES["across"]

    def log_odds(self, text: str, links: float, node: _Node) -> float:
        return node.evidence + sum([of[value] for of, value in zip(self.look, look_of(text, links, node))])


def _lessons(page: str | None) -> Counter:
    """What a page's marks teach: (look, label) of blocks, and (kind of neighbours, whether their labels are one)."""
    seen: Counter = Counter()
    blocks = blocks_of(page) if page else []
    for text, links, node in blocks:
        if node.taught is not None:
            seen["look", ",".join(map(str, look_of(text, links, node))), node.taught] += 1
    holders = holders_of(blocks)
    for (_, _, a), (_, _, b), x, y in zip(blocks, blocks[1:], holders, holders[1:]):
        if a.taught is not None and b.taught is not None:
            seen["edge", "within" if x is y else "across", a.taught == b.taught] += 1
    return seen


def train(pages: DataFrame) -> Model:
    """Learn from at most ``TRAIN_PAGES`` pages, chosen by a hash of their id; the driver gets counts of looks, of which there are few."""
    total = pages.count()
    if not total:
        return Model()
    place = F.crc32(F.concat_ws("|", F.lit("sample"), F.col("page_id").cast("string"), F.col("url").cast("string")).cast("binary")) / F.lit(2.0**32)
    # a hash below this share keeps about twice the sample, of which the smallest make it exact
    near = pages.select(F.col("html").cast("string").alias("html"), place.alias("place")).where(F.col("place") < min(1.0, (2.0 * TRAIN_PAGES + 50) / total))
    sample = near.orderBy("place").limit(TRAIN_PAGES).select("html")
    bound_batches(pages.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                seen.update(_lessons(page))
        if seen:
            yield pa.record_batch([pa.array([k[i] for k in seen]) for i in range(3)] + [pa.array(list(seen.values()), pa.int64())], ["part", "code", "label", "n"])

    sums = sample.mapInArrow(count, "part string, code string, label boolean, n long").groupBy("part", "code", "label").agg(F.sum("n").alias("n")).collect()
    return fit({(r["part"], r["code"], r["label"]): r["n"] for r in sums})


def fit(seen: dict[tuple[str, str, bool], int]) -> Model:
    """Logistic regression from the starting weights, by Newton's method, and the edges' log-odds."""
    sizes = [len(x) for x in START.values()]
    start = np.array([w for x in START.values() for w in x])
    offsets = np.cumsum([0, *sizes[:-1]])
    looks = [(code, label, n) for (part, code, label), n in sorted(seen.items()) if part == "look"]
    weights = start.copy()
    if looks:
        x = np.zeros((len(looks), len(start)))
        for row, (code, _, _) in enumerate(looks):
            x[row, offsets + np.array([int(v) for v in code.split(",")])] = 1.0
        y, n = np.array([label for _, label, _ in looks], float), np.array([n for _, _, n in looks], float)
        n *= min(1.0, SAMPLE_WEIGHT / n.sum())
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ weights))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(start)), x.T @ (n * (p - y)) + weights - start)
            weights -= step
            if abs(step).max() < 1e-9:
                break
    edges = {}
    for kind in ("within", "across"):
        one, two = seen.get(("edge", kind, True), 0), seen.get(("edge", kind, False), 0)
        share = min(1.0, SAMPLE_WEIGHT / (one + two)) if one + two else 0.0
        rest = float(np.exp(EDGES[kind]))  # ten neighbours of the starting log-odds
        odds = (one * share + 10 * rest / (1 + rest)) / (two * share + 10 / (1 + rest))
        edges[kind] = float(np.clip(np.log(odds), *EDGE_BOUNDS))
    return Model(tuple(tuple(float(w) for w in weights[o : o + k]) for o, k in zip(offsets, sizes)), **edges)


def label(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum-cut labels: True on the source (content) side. unary > 0 favours content, an edge is paid if it is cut.

    A node without any preference is boilerplate.
    """
    n = len(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    cost, out = list(unary), [None] * n
    weight = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if out[i] is not None or abs(cost[i]) <= weight[i] and near[i]:
            continue
        out[i] = cost[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            weight[j] -= w
            cost[j] += w if out[i] else -w
            todo.append(j)
        near[i] = {}
    left = [i for i in range(n) if out[i] is None]
    if left:
        content = _source_side({i: cost[i] for i in left}, near)
        for i in left:
            out[i] = i in content
    return out


def _source_side(cost: dict[int, float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow (shortest augmenting paths)."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {source: {}, sink: {}, **{i: dict(near[i]) for i in cost}}
    for i, c in cost.items():
        if c > 0:
            room[source][i], room[i][source] = c, 0.0
        elif c < 0:
            room[i][sink], room[sink][i] = -c, 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, r in room[i].items():
                if r > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return {i for i in level if i >= 0}
        edges = {i: iter(list(room[i])) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                push = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= push
                    room[b][a] = room[b].get(a, 0.0) + push
                path = [source]
                edges[source] = iter(list(room[source]))
                continue
            for j in edges[i]:
                if room[i].get(j, 0.0) > 1e-12 and level.get(j, -1) == level[i] + 1:
                    path.append(j)
                    break
            else:
                level[i] = -1
                path.pop()
                if path:
                    edges[path[-1]] = iter(list(room[path[-1]]))


def _around(node: _Node) -> _Node | None:
    """The nearest block-level element around a node."""
    up = node.parent
    while up is not None and not up.block:
        up = up.parent
    return up


def holders_of(blocks: list[tuple[str, float, _Node]]) -> list[_Node | None]:
    """The container of each block: its element if that has other blocks as well, else the one around it."""
    shared: set[int] = set()
    seen: set[int] = set()
    for _, _, node in blocks:
        (shared if id(node) in seen else seen).add(id(node))
        up = _around(node)
        while up is not None and id(up) not in shared:
            shared.add(id(up))
            up = _around(up)
    return [node if id(node) in shared else _around(node) for _, _, node in blocks]


def graph_of(blocks: list[tuple[str, float, _Node]], model: Model) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Log-odds of the blocks, then 0 for each container; and the smoothness edges."""
    unary = [model.log_odds(*b) for b in blocks]
    holders = holders_of(blocks)
    # neighbours in one container share the capacity between the edge that joins them and the way through the container
    edges = [(i, i + 1, model.within / 2 if holders[i] is holders[i + 1] else model.across) for i in range(len(blocks) - 1)]
    numbers: dict[int, int] = {}
    for i, up in enumerate(holders):
        below, capacity = i, model.within / 2
        while up is not None and up.tag not in ("body", "html", "#root"):
            fresh = id(up) not in numbers
            at = numbers.setdefault(id(up), len(unary))
            if fresh:
                unary.append(0.0)
            edges.append((below, at, capacity))
            if not fresh:
                break
            below, capacity, up = at, EDGES["containers"], _around(up)
    return unary, edges


def main_blocks(page: str | None, model: Model = Model()) -> list[tuple[str, bool]]:
    """Every block of the page and whether it is content."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return []
    labels = label(*graph_of(blocks, model))
    return [(text, labels[i]) for i, (text, _, _) in enumerate(blocks)]


def main_text(page: str | None, model: Model = Model()) -> str:
    return "\n".join([text for text, content in main_blocks(page, model) if content])


def extract_pages(pages: DataFrame, model: Model = Model()) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""

    def build():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h, model) for h in batch.column(2).to_pylist()]
            return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return apply

    return map_arrow(pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].alias("html")), build, "page_id long, url string, text string, n_chars long", rows=500)
