"""Main text of HTML pages by minimum-cut labelling.

A page is parsed into text blocks (runs of inline content between block tags)
and regions: elements whose tag, class, id or role says content or boilerplate.
Blocks and regions are the nodes of a graph.

* Terminal capacities: a linear classifier over a block's own text and tag
  (length, link share, sentence end, digits, capitals, heading) gives the cost
  of labelling it content or boilerplate.  It is fitted on a bounded sample of
  pages, whose blocks inside strong regions are the labelled rows; too few of
  them leave the default weights.  A strong region's capacity grows with its
  blocks, so that it stands; a weak one (contradicting hints, wrappers) is one
  fixed cost, which the blocks in it can outweigh.
* Smoothness edges: a block and its innermost region, a weak region and the one
  around it, neighbouring blocks (less the farther they are apart in the DOM) and
  blocks of one container.

Max-flow gives the cheapest labelling; the source side is content.  Nodes whose
own cost exceeds all edges at them have the same label in every minimum cut, so
they are labelled first and join the terminals; the flow runs on the rest and
the result is an exact minimum.

Parsing takes time and memory in proportion to the page, whatever its nesting.

Edge cases: null and empty pages have no text.  Unclosed tags, comments and
elements end where the page ends; a tag that the page cuts off is dropped.  Pages
of any length are read whole.  Repeated rows are extracted one by one.  An empty
table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import bounded_batches
from relspark.llm.learning import logistic
from relspark.llm.textops import slices

#: Element kinds of HTML.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
CLOSES_P = BLOCKS - frozenset("body html button option legend summary td th tr tbody thead tfoot caption title".split())
#: What ends an open element of the kind, and where the search for it stops.
SIBLINGS = {"li": "li", "dt": "term", "dd": "term", "tr": "row", "td": "cell", "th": "cell", "option": "option"}
LISTS = frozenset("ul ol menu dl table select".split())
SCOPE = frozenset("ul ol menu dl table tbody thead tfoot tr div section article main body html td th".split())

#: What class, id and role words and tags say of a block.
CONTENT_TAGS = frozenset(["article", "main"])
BOILER_TAGS = frozenset(["nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "option", "fieldset", "search", "noscript", "template"])
CONTENT_WORDS = frozenset("article articlebody content post entry story main body text page".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adbox adsense banner sponsor sponsored promo promoted promotion sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs topbar masthead footer cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations trending comment comments disqus reply replies respond discussion widget toolbar pagination pager copyright legal disclaimer alert search form complementary contentinfo skip".split()
)
#: Class names that begin so say what is not there; such elements hold both kinds.
NEGATIONS = frozenset("no non not without hide with has".split())
WRAPPERS = frozenset("wrapper wrap container layout site grid row inner outer".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<(?=/?[A-Za-z])[^>]*\Z""", re.DOTALL)
_ATTR = re.compile(r"""(class|id|role|style|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>|</{x}\Z", re.IGNORECASE) for x in RAW}

#: Smoothness: of neighbours in page order, of blocks of one container, of a block and its region, of a region and the one around it.
ADJACENT, SAME_CONTAINER, IN_CONTENT, IN_BOILER, NESTED = 0.8, 0.6, 3.5, 8.0, 1.0
#: A weak region's own cost.
WEAK = 4.0
#: Classifier: default weights of :func:`features` and the bias, and the range of costs.
WEIGHTS = np.array([1.0, -5.0, 0.5, 0.0, 0.0, 0.0])
BIAS = -0.7
LOWEST, HIGHEST = -5.0, 3.0
#: The fit: pages and bytes at most, and labelled blocks of each kind at least.
FIT_PAGES, FIT_BYTES, FIT_LEAST = 600, 6 << 20, 200


class Region:
    """An element that says what it holds: ``side`` 1 content, -1 boilerplate."""

    __slots__ = ("outer", "side", "strong")

    def __init__(self, side, strong, outer):
        self.side, self.strong, self.outer = side, strong, outer


class Block:
    __slots__ = ("container", "gap", "linked", "region", "tag", "text")

    def __init__(self, text, linked, container, gap, tag, region):
        self.text, self.linked, self.container, self.gap, self.tag, self.region = text, linked, container, gap, tag, region


class _Node:
    __slots__ = ("around", "block", "depth", "home", "link", "number", "open", "region", "tag")

    def __init__(self, tag, number, parent, region, link, at):
        self.tag, self.number, self.region, self.link, self.block = tag, number, region, link, tag in BLOCKS
        self.depth = parent.depth + self.block if parent else 0
        #: The innermost block element, and the number of the one around it.
        self.home = self if self.block or not parent else parent.home
        self.around = parent.home.number if parent else 0
        opened = parent.open if parent else {}
        kind = "p" if tag == "p" else SIBLINGS.get(tag)
        if tag in LISTS:
            opened = {}
        elif tag in SCOPE and "p" in opened:
            opened = {k: v for k, v in opened.items() if k != "p"}
        self.open = opened | {kind: at} if kind else opened


def _region(tag: str, attrs: str, outer: Region | None) -> Region | None:
    """The region that the element opens, or the one that it is in."""
    inside = outer.side if outer else 0
    if inside < 0 and outer.strong:
        return outer
    content, boiler, wrapper = tag in CONTENT_TAGS, tag in BOILER_TAGS or tag == "header" and inside <= 0, False
    sure = boiler
    if attrs and tag not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "style":
                sure = sure or bool(HIDDEN.search(value))
            elif name == "hidden" or name == "aria-hidden":
                sure = sure or value.lower() != "false"
            else:
                for part in value.split():
                    words = [w.lower() for w in _WORDS.findall(part)]
                    if not words or words[0] in NEGATIONS:
                        continue
                    wrapper = wrapper or not WRAPPERS.isdisjoint(words)
                    if not BOILER_WORDS.isdisjoint(words) or "header" in words and inside <= 0:
                        boiler = True
                    elif not CONTENT_WORDS.isdisjoint(words):
                        content = True
    if sure:
        return Region(-1, True, outer)
    if boiler:
        about = tag == "article" and not wrapper and _comment(attrs)
        return Region(-1, about or not content and not wrapper, outer)
    if content and inside <= 0:
        return Region(1, True, outer)
    return outer


def _comment(attrs: str) -> bool:
    """Whether an article element is a reader's comment."""
    return any(w.lower() in ("comment", "comments", "reply", "replies") for m in _ATTR.finditer(attrs) for w in _WORDS.findall(m[2] or m[3] or m[4] or ""))


def blocks(page: str) -> list[Block]:
    """The text blocks of the page, in order, outside head, scripts, styles and the like."""
    root = _Node("", 0, None, None, False, 0)
    stack, out, parts, linked, opened = [root], [], [], 0, Counter()
    number, at, n, in_head, lowest = 0, 0, len(page), False, 0

    def flush():
        nonlocal parts, linked, lowest
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text and not in_head:
                top = stack[-1]
                home = top.home
                gap = home.depth + (out[-1].gap[1] if out else 0) - 2 * min(lowest, home.depth)
                around = home.number if home.tag in ("div", "section", "article", "main", "body", "") else home.around
                out.append(Block(text, min(linked, len(text)), around, (gap, home.depth), home.tag, top.region))
                lowest = home.depth
        parts, linked = [], 0

    def add(text):
        nonlocal linked
        if text:
            parts.append(text)
            if stack[-1].link:
                linked += len(text)

    def pop_to(k):
        nonlocal lowest
        if any(x.block for x in stack[k:]):
            flush()
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]
        lowest = min(lowest, stack[-1].depth)

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, close, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if close:
            if tag == "head":
                flush()
                in_head = False
            if opened[tag]:
                pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in RAW and not attrs.endswith("/"):
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br" or tag in VOID:
            if tag in BLOCKS:
                flush()
            add(" ")
            continue
        if tag == "head":
            in_head = True
        elif tag == "body" and in_head:
            flush()
            in_head = False
        if tag in CLOSES_P and "p" in stack[-1].open:
            pop_to(stack[-1].open["p"])
        kind = SIBLINGS.get(tag)
        if kind:
            before = max(stack[-1].open.get(kind, 0), stack[-1].open.get("cell", 0) if kind == "row" else 0)
            if before:
                pop_to(before)
        if tag in BLOCKS:
            flush()
        parent = stack[-1]
        region = _region(tag, attrs, parent.region)
        if attrs.endswith("/") and tag not in BLOCKS:
            continue
        number += 1
        stack.append(_Node(tag, number, parent, region, tag == "a" or parent.link and tag not in BLOCKS, len(stack)))
        opened[tag] += 1
    flush()
    return out


def features(b: Block) -> list[float]:
    """Of the block alone: length, link share, sentence end, digits, capitals, heading."""
    t = b.text
    n = len(t)
    return [min(2.5, n / 60), b.linked / n, float(t[-1] in ".!?…\"'"), sum(map(str.isdigit, t)) / n, sum(map(str.isupper, t)) / n, float(len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit())]


def fit(pages: list[str]) -> tuple[np.ndarray, float]:
    """Weights and bias from the blocks inside strong regions."""
    x, y = [], []
    for page in pages:
        for b in blocks(page):
            if b.region is not None and b.region.strong:
                x.append(features(b))
                y.append(b.region.side > 0)
    if min(sum(y), len(y) - sum(y)) < FIT_LEAST:
        return WEIGHTS, BIAS
    return logistic(np.array(x), np.array(y, float))


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness of blocks: neighbours, weaker by DOM distance, and the last block of the same container."""
    out, last = [], {}
    for i, b in enumerate(found):
        near = last.get(b.container)
        if i:
            out.append((i - 1, i, ADJACENT / (1 + max(0, b.gap[0] - 2)) + (SAME_CONTAINER if near == i - 1 else 0)))
        if near is not None and near != i - 1:
            out.append((near, i, SAME_CONTAINER))
        last[b.container] = i
    return out


def graph(found: list[Block], model: tuple[np.ndarray, float] = (WEIGHTS, BIAS)) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Own gains of content over boilerplate and smoothness edges: blocks first, then their regions."""
    own = np.clip(np.array([features(b) for b in found], float).reshape(-1, len(WEIGHTS)) @ model[0] + model[1], LOWEST, HIGHEST).tolist()
    ties = edges(found)
    place: dict[int, int] = {}
    held: list[tuple[Region, int]] = []

    def node(r: Region) -> int:
        if id(r) not in place:
            place[id(r)] = len(own) + len(held)
            held.append((r, 0))
        return place[id(r)]

    weight: Counter = Counter()
    for i, b in enumerate(found):
        if b.region is not None:
            k, w = node(b.region), IN_CONTENT if b.region.side > 0 else IN_BOILER
            ties.append((k, i, w))
            weight[k] += w
    for r, _ in held:  # grows while regions around regions are met
        if not r.strong and r.outer is not None:
            ties.append((node(r.outer), place[id(r)], NESTED))
            weight[place[id(r.outer)]] += NESTED
    own += [r.side * (1 + weight[place[id(r)]] if r.strong else WEAK) for r, _ in held]
    return own, ties


def min_cut(own: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: ``own`` is the gain of True over False, ties are paid when their ends differ."""
    n = len(own)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in ties:
        near[i].append((j, w))
        near[j].append((i, w))
    pull, free = list(own), [sum(w for _, w in x) for x in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(pull[i]) > free[i]:
            label[i] = pull[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    free[j] -= w
                    pull[j] += w if label[i] else -w
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = max_flow({i: pull[i] for i in rest}, {i: {j: w for j, w in _merged(near[i]) if label[j] is None} for i in rest})
        for i in rest:
            label[i] = i in side
    return label


def _merged(pairs):
    out: dict[int, float] = {}
    for j, w in pairs:
        out[j] = out.get(j, 0) + w
    return out.items()


def max_flow(pull: dict[int, float], caps: dict[int, dict[int, float]]) -> set[int]:
    """The source side of a minimum cut by shortest augmenting paths from all sources at once.

    Positive pulls are capacities from the source, negative ones to the sink;
    ``caps`` holds the residual capacities between nodes, both ways.
    """
    eps = 1e-9
    supply = {i: p for i, p in pull.items() if p > eps}
    demand = {i: -p for i, p in pull.items() if p < -eps}
    while True:
        came: dict[int, int | None] = {i: None for i, s in supply.items() if s > eps}
        queue, end = deque(came), None
        while queue:
            i = queue.popleft()
            if demand.get(i, 0) > eps:
                end = i
                break
            for j, c in caps[i].items():
                if c > eps and j not in came:
                    came[j] = i
                    queue.append(j)
        if end is None:
            return set(came)
        path, i = [], end
        while came[i] is not None:
            path.append((came[i], i))
            i = came[i]
        flow = min(supply[i], demand[end], *(caps[a][b] for a, b in path)) if path else min(supply[i], demand[end])
        supply[i] -= flow
        demand[end] -= flow
        for a, b in path:
            caps[a][b] -= flow
            caps[b][a] = caps[b].get(a, 0) + flow


def extract(page: str | None, model: tuple[np.ndarray, float] = (WEIGHTS, BIAS)) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    keep = min_cut(*graph(found, model))
    return " ".join(b.text for b, k in zip(found, keep) if k)


def _run(model):
    def run(batches):
        for part in slices(batches, "html"):
            texts = [extract(x, model) for x in part.column(2).to_pylist()]
            texts_ok = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts_ok, pa.string()), pa.array([len(t) for t in texts_ok], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def sample_pages(rows: DataFrame, max_pages: int, max_bytes: int) -> list[str]:
    """Distinct pages in the order of a hash of their text, as many as fit; a page of more than a 50th of the bytes is left out."""
    sized = rows.select(F.md5("html").alias("o"), F.octet_length("html").alias("n")).where(f"n BETWEEN 1 AND {max_bytes // 50}").distinct().orderBy("o").limit(max_pages).collect()
    picked, total = [], 0
    for r in sorted(sized, key=lambda r: r.o):
        if total + r.n <= max_bytes:
            picked.append((r.o,))
            total += r.n
    if not picked:
        return []
    keys = rows.sparkSession.createDataFrame(picked, "o string")
    got = rows.where(F.octet_length("html") <= max_bytes // 50).select(F.md5("html").alias("o"), "html").join(F.broadcast(keys), "o").dropDuplicates(["o"]).collect()
    return [r.html for r in sorted(got, key=lambda r: r.o)]


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", fit_pages: int = FIT_PAGES, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """Per row: page_id, url, text, n_chars.  The classifier sees ``fit_pages`` pages and ``fit_bytes`` bytes at most."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    model = fit(sample_pages(rows, fit_pages, fit_bytes))
    return rows.mapInArrow(_run(model), "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
