"""Main text of web pages by a tree-structured graphical model over the page's nodes.

Every element and every run of text is in one of three states: other, content or mixed
(it holds both). A node has a potential from how it looks: its tag, length, share of
links, sentence marks, siblings and place. Each parent and child share one that says how
their states go together. Both are learned from labelled pages: pages whose elements
name their purpose. Names are the labels and never a look, so what is learned holds for
pages that name nothing; where an element of a page does name its purpose, that element
is taken as observed. Sum-product messages up and down the tree carry what is observed
and what is seen to every node and give its marginal.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.session import materialise

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
# What HTML itself fixes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Inside these nothing is text of the page.
SILENT = frozenset("head script style title template noscript svg math canvas object iframe select textarea button option".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: A start tag that ends an open element of these names, up to the nearest of the limits.
ENDS = {
    **{name: ({"p"}, {"td", "th", "button"}) for name in BLOCK - {"html", "body", "li", "td", "th", "tr", "dd", "dt"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Names by which elements state their purpose: the labels of the labelled pages.
CONTENT_NAMES = frozenset("article main articlebody".split())
OTHER_NAMES = frozenset(
    "nav menu footer header aside form ad ads advert adverts advertisement banner breadcrumb breadcrumbs byline comment "
    "comments commentlist consent cookie cookies copyright disqus login masthead meta modal navbar navigation newsletter "
    "notice notices overlay pager pagination popup promo promoted related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)


#: Boxes whose tag says nothing.
PLAIN = frozenset("div span section #root".split())
_MARKS = re.compile(r"[.!?;:,\u3002\uff0c]")
_NO_NAMES: frozenset[str] = frozenset()
#: Looks that a task remembers.
PLACES = 100_000


@dataclass(slots=True)
class Node:
    parent: int
    tag: str
    names: frozenset[str] = frozenset()
    text: str = ""
    block: int = -1


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)


def parse(source: str) -> Page:
    """Nodes in page order; text nodes carry the number of the block they belong to."""
    page = Page([Node(-1, "#root")])
    nodes, opened, tags = page.nodes, [0], ["#root"]
    silent, block, at, end = 0, 0, 0, len(source)

    def close(depth: int) -> int:
        del opened[depth:]
        left = sum(tag in SILENT for tag in tags[depth:])
        del tags[depth:]
        return left

    while at < end:
        m = _TOKEN.search(source, at)
        begin, after = m.span() if m else (end, end)
        if begin > at and not silent:
            raw = source[at:begin]
            nodes.append(Node(opened[-1], "#text", _NO_NAMES, html.unescape(raw) if "&" in raw else raw, block))
        at = after
        if m is None or not m[1]:
            continue
        tag = m[1].lower()
        is_block = tag in BLOCK
        block += is_block
        if source[begin + 1] == "/":
            if tag in tags:
                depth = len(tags) - 1 - tags[::-1].index(tag)
                # An inline end tag doesn't close blocks inside it.
                if is_block or BLOCK.isdisjoint(tags[depth + 1 :]):
                    silent -= close(depth)
            continue
        if tag == "br":
            if not silent:
                nodes.append(Node(opened[-1], "#text", _NO_NAMES, " ", block))
            continue
        if tag in ENDS:
            ended, limits = ENDS[tag]
            cell = tag in ("td", "th", "tr")
            for depth in range(len(tags) - 1, 0, -1):
                name = tags[depth]
                if name in ended:
                    silent -= close(depth)
                    break
                if name in limits or not cell and name in BLOCK:
                    break
        if is_block and "head" in tags and tag != "html":
            silent -= close(tags.index("head"))
        if tag in ("html", "body") and tag in tags:
            continue
        names = _NO_NAMES
        if m[2]:
            values = " ".join(x or y or z for x, y, z in _NAMES.findall(m[2]))
            names = frozenset(p.lower() for p in _PARTS.findall(values)) if values else names
        nodes.append(Node(opened[-1], tag, names))
        if tag in VOID or m[0].endswith("/>") and not is_block:
            continue
        if tag in RAW:
            ending = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = ending.end() if ending else end
            continue
        opened.append(len(nodes) - 1)
        tags.append(tag)
        silent += tag in SILENT
    return page


def purposes(page: Page) -> list[int]:
    """1 where the nearest naming element says content, 0 where it or any above says otherwise, else -1."""
    found: list[int] = []
    for node in page.nodes:
        above = found[node.parent] if node.parent >= 0 else -1
        own = {node.tag, *node.names}
        found.append(0 if above == 0 or own & OTHER_NAMES else 1 if above == 1 or own & CONTENT_NAMES else -1)
    return found


def labels(page: Page) -> list[int]:
    """The state of every node as far as names tell: 0, 1, 2 where both are below, else -1."""
    found = purposes(page)
    below = [set() for _ in found]
    for i in range(len(found) - 1, 0, -1):
        if found[i] >= 0:
            below[i].add(found[i])
        below[page.nodes[i].parent] |= below[i]
    return [state if state >= 0 or below[i] != {0, 1} else 2 for i, state in enumerate(found)]


def observed(page: Page) -> list[int]:
    """The state that an element states by its own name, unless one above says otherwise; else -1."""
    found = purposes(page)
    stated = []
    for node, state in zip(page.nodes, found):
        above = found[node.parent] if node.parent >= 0 else -1
        own = {node.tag, *node.names}
        stated.append(state if state != above and (own & OTHER_NAMES or own & CONTENT_NAMES) else -1)
    return stated


def merged(page: Page) -> list[int]:
    """The variable of every node, and so the number of its first node: an only child that is a plain box shares its parent's."""
    children = [0] * len(page.nodes)
    for node in page.nodes[1:]:
        children[node.parent] += 1
    variable = list(range(len(page.nodes)))
    for i, node in enumerate(page.nodes):
        if i and node.tag in PLAIN and not node.names and children[node.parent] == 1:
            variable[i] = variable[node.parent]
    return variable


def _grade(value: float, steps: tuple[float, ...]) -> int:
    return sum(value >= step for step in steps)


#: What a look is made of; the tag of a plain box says nothing.
LOOK = ("tag", "length", "links", "marks", "children", "alike", "place", "depth")


def looks(page: Page, variable: list[int]) -> list[tuple]:
    """How each node looks, in few grades per trait, so that nodes of many pages look the same.

    The place is the share of the page's text that comes before; merged boxes add no depth.
    """
    nodes, n = page.nodes, len(page.nodes)
    length, linked, marks, children, before = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    depth, in_link, alike, read = [0] * n, [False] * n, {}, 0
    for i in range(1, n):
        node = nodes[i]
        before[i] = read
        depth[i] = depth[node.parent] + (variable[i] == i)
        in_link[i] = in_link[node.parent] or node.tag == "a"
        children[node.parent] += 1
        key = (node.parent, node.tag)
        alike[key] = alike.get(key, 0) + 1
        if node.tag == "#text":
            length[i] = len(node.text.strip())
            read += length[i]
            linked[i] = length[i] if in_link[i] else 0
            marks[i] = len(_MARKS.findall(node.text))
    for i in range(n - 1, 0, -1):
        parent = nodes[i].parent
        length[parent] += length[i]
        linked[parent] += linked[i]
        marks[parent] += marks[i]
    found = []
    for i, node in enumerate(nodes):
        size = length[i]
        found.append((
            "" if node.tag in PLAIN else node.tag, min(size.bit_length(), 12),
            _grade(linked[i] / size, (0.01, 0.25, 0.5, 0.9)) if size else 0, _grade(100 * marks[i] / size, (0.01, 0.5, 1.0, 3.0)) if size else 0,
            _grade(children[i], (1, 2, 4, 10)), _grade(alike.get((node.parent, node.tag), 0), (2, 4, 10)), 4 * before[i] // (read + 1), min(depth[i], 6),
        ))
    return found


#: Traits that an element is judged by, and a run of text. What is seen in a text isn't counted again for the elements around it.
SEEN = {"element": ("links", "children", "alike", "depth"), "text": ("length", "links", "marks", "place")}


def features(look: tuple, hide_tag: bool = False) -> list[str]:
    """The names that have weights; a text's length counts also together with its links and marks."""
    tag, length, links, marks = look[:4]
    if tag == "#text":
        row = ["kind:text", f"text:{length}:{links}:{marks}"]
    else:
        row = ["kind:element"] + ([f"tag:{tag}"] if tag and not hide_tag else [])
    kind = "text" if tag == "#text" else "element"
    return row + [f"{kind}.{name}:{look[LOOK.index(name)]}" for name in SEEN[kind]]


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit: pages and looks of labelled nodes, chosen by a hash, and names that get a weight, most frequent first."""

    pages: int = 2_000
    looks: int = 200_000
    names: int = 5_000


#: Log potential of what is observed, and of a state that can't be.
SAID, NEVER = 60.0, -50.0
#: Before anything is learned: long text with sentence marks and few links is content.
PRIOR = {
    **{f"text.length:{i}": (0.0, 0.5 * (i - 6), 0.0) for i in range(13)},
    **{f"{k}.links:{i}": (0.0, -1.0 * i, 0.0) for k in ("text", "element") for i in range(5)},
    "text.marks:0": (0.0, -1.0, 0.0),
}


@dataclass(frozen=True)
class Model:
    #: Per feature a weight for each state: other, content, mixed.
    weights: dict[str, tuple[float, float, float]]
    #: Log potential of [parent's state][child's state].
    pairs: tuple[tuple[float, float, float], ...]

    def potential(self, look: tuple) -> tuple[float, float, float]:
        rows = [self.weights[f] for f in features(look) if f in self.weights]
        if look[0] == "#text":
            rows.append((0.0, 0.0, NEVER))
        return tuple(sum(r[s] for r in rows) for s in range(3))


class Reader:
    """A model at work in one task."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def levels(self, page: Page) -> list[list[float]]:
        """Each variable's own log potential: how its nodes look, and what they say about themselves."""
        if len(self.known) > PLACES:
            self.known.clear()
        found = [[0.0, 0.0, 0.0] for _ in page.nodes]
        variables = merged(page)
        for i, (variable, look, state) in enumerate(zip(variables, looks(page, variables), observed(page))):
            level = self.known.get(look)
            if level is None:
                level = self.known[look] = self.model.potential(look)
            own = found[variable]
            if variable == i:
                own[:] = level
            if state >= 0:
                own[state] += SAID
        return found

    def marginals(self, page: Page) -> list[tuple[float, float, float]]:
        """Each node's chances of being other, content and mixed: messages from the leaves to the root and back."""
        variable, n = merged(page), len(page.nodes)
        level = self.levels(page)
        parent = [variable[node.parent] if i else -1 for i, node in enumerate(page.nodes)]
        first = [i for i in range(1, n) if variable[i] == i]
        (a0, a1, a2), (b0, b1, b2), (c0, c1, c2) = self.model.pairs
        up = [(0.0, 0.0, 0.0)] * n
        for i in reversed(first):  # children come after their parent
            x, y, z = level[i]
            up[i] = (_log_sum(a0 + x, a1 + y, a2 + z), _log_sum(b0 + x, b1 + y, b2 + z), _log_sum(c0 + x, c1 + y, c2 + z))
            above = level[parent[i]]
            above[0] += up[i][0]
            above[1] += up[i][1]
            above[2] += up[i][2]
        for i in first:
            above, own, sent = level[parent[i]], level[i], up[i]
            x, y, z = above[0] - sent[0], above[1] - sent[1], above[2] - sent[2]
            own[0] += _log_sum(a0 + x, b0 + y, c0 + z)
            own[1] += _log_sum(a1 + x, b1 + y, c1 + z)
            own[2] += _log_sum(a2 + x, b2 + y, c2 + z)
        chances = {}
        for i in [0, *first]:
            total = _log_sum(*level[i])
            chances[i] = tuple(math.exp(v - total) for v in level[i])
        return [chances[v] for v in variable]

    def main_text(self, source: str | None) -> str:
        if not source:
            return ""
        page = parse(source)
        blocks: dict[int, list[str]] = {}
        for node, chance in zip(page.nodes, self.marginals(page)):
            if node.tag == "#text" and chance[1] >= 0.5:
                blocks.setdefault(node.block, []).append(node.text)
        joined = (_SPACE.sub(" ", "".join(parts)).strip() for _, parts in sorted(blocks.items()))
        return "\n\n".join(text for text in joined if text)


def _log_sum(x: float, y: float, z: float) -> float:
    top = max(x, y, z)
    return top + math.log(math.exp(x - top) + math.exp(y - top) + math.exp(z - top))


def _labelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for source in frame["html"]:
            page = parse(source or "")
            state, variable = labels(page), merged(page)
            for i, look in enumerate(looks(page, variable)):
                if state[i] >= 0 and variable[i] == i:
                    above = state[page.nodes[i].parent] if i else -1
                    rows.append((state[i], above, "|".join(map(str, look))))
        yield pd.DataFrame(rows, columns=["label", "above", "look"])


def _parsed(look: str) -> tuple:
    tag, *grades = look.split("|")
    return (tag, *map(int, grades))


def _descend(looks_: list[tuple], label: np.ndarray, times: np.ndarray, names: list[str]) -> dict[str, tuple]:
    """Softmax regression from the prior; every look counts with its tag and once more without."""
    place = {name: i for i, name in enumerate(names)}
    rows = [features(look) for look in looks_] + [features(look, hide_tag=True) for look in looks_]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([place.get(f, len(names)) for r in rows for f in r])
    start = np.array([PRIOR.get(name, (0.0, 0.0, 0.0)) for name in names] + [(0.0, 0.0, 0.0)])
    fitted, wanted = start.copy(), np.eye(3)[np.concatenate([label, label])]
    weight = (np.concatenate([times, times]) / (2 * times.sum()))[:, None]
    for _ in range(300):
        level = np.stack([np.bincount(row, fitted[column, s], len(rows)) for s in range(3)], axis=1)
        chance = np.exp(level - level.max(axis=1, keepdims=True))
        error = (chance / chance.sum(axis=1, keepdims=True) - wanted) * weight
        slope = np.stack([np.bincount(column, error[row, s], len(names) + 1) for s in range(3)], axis=1)
        # Few looks keep the prior unless the pages speak against it.
        fitted -= 1.5 * (slope + 2e-4 * (fitted - start))
    return dict(zip(names, map(tuple, fitted[:-1].tolist())))


def fit(pages: DataFrame, limits: Limits = Limits()) -> Model:
    """Learn both potentials from a bounded number of labelled pages, each at most once.

    Nodes are counted in Spark by how they look and by label, so the descent on the
    driver sees distinct looks only. Pages that name nothing have no labels; without any
    labelled page the prior decides.
    """
    keyed = pages.select("html", F.xxhash64("html").alias("key")).where("html IS NOT NULL")
    chosen = materialise(keyed.select("key").distinct().orderBy("key").limit(limits.pages))
    # The keys are at most limits.pages.
    rows = keyed.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("html").alias("html"))
    nodes = materialise(rows.select("html").mapInPandas(_labelled, "label int, above int, look string"))
    counted = nodes.groupBy("label", "look").count().orderBy(F.xxhash64("look", "label")).limit(limits.looks).collect()
    weights = dict(PRIOR)
    if counted:
        seen = [_parsed(r["look"]) for r in counted]
        times = np.array([r["count"] for r in counted], dtype=float)
        total: dict[str, float] = {}
        for look, count in zip(seen, times):
            for name in features(look):
                total[name] = total.get(name, 0.0) + count
        names = sorted(total, key=lambda name: (-total[name], name))[: limits.names]
        weights |= _descend(seen, np.array([r["label"] for r in counted]), times, names)
    pairs = {(r["above"], r["label"]): r["count"] for r in nodes.where("above >= 0").groupBy("above", "label").count().collect()}
    joint = np.array([[pairs.get((a, b), 0) + 1.0 for b in range(3)] for a in range(3)])
    joint /= joint.sum()
    log = np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0)))
    # What is mixed holds anything but lies in nothing else.
    log[2, :2] = 0.0
    # Counts of few pages aren't certainties.
    log = np.clip(log, -6.0, 6.0)
    return Model(weights, tuple(map(tuple, log.tolist())))


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A block is the text between tags of block elements; ``br`` counts as a space.
    References are decoded, white space becomes one space, blocks are joined by an
    empty line. A page cut off anywhere is read as far as it goes. Null html is an
    empty page, its text is empty. Repeated rows each get the same result. Other
    columns are not read. No shuffle: a page is read where it lies.
    """
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model)
        for frame in frames:
            texts = [reader.main_text(source) for source in frame["html"]]
            yield pd.DataFrame({
                "page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts,
                "n_chars": [len(t) for t in texts],
            })

    return pages.select("page_id", "url", "html").mapInPandas(rows, "page_id bigint, url string, text string, n_chars bigint")
