"""Main text of web pages: content or boilerplate by a minimum cut."""

from __future__ import annotations

import pickle
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh_names

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg canvas object select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A start tag of the left ends an open element of the right, up to the nearest of its containers.
ENDED = {
    **{t: {"p"} for t in BLOCKS - {"body", "html", "head", "option"}},
    "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"},
    "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"},
}
CONTAINERS = frozenset("table ul ol dl div section article aside nav main header footer form body html td th".split())
NEVER = frozenset("nav footer form".split())
WHOLE = frozenset("html body main article".split())  # their names tell of the page, not of a part of it
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright footer gdpr header masthead menu modal nav navbar navigation newsletter notice pager pagination popup "
    "promo promoted related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar widget".split()
)
MAIN_WORDS = frozenset("article body content entry main post story text".split())
FADE = 0.8  # a name counts less with each element between it and the text
HARD = 1e6

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL
)
_LOOSE_TAG = re.compile(r"</?[a-zA-Z][^>]*(?:>|\Z)")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_STATE = re.compile(r"\b(?:has|with|without|no)[-_]\S+")  # such names tell what an element holds or lacks
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    path: tuple[int, ...]  # numbers of the open elements, outermost first
    tags: tuple[str, ...]
    names: tuple[frozenset[str], ...]  # words of each open element's class, id and role


def blocks(html: str) -> list[Block]:
    """Runs of text between block tags, with the elements around them; references are decoded."""
    found: list[Block] = []
    stack: list[tuple[str, int, frozenset[str]]] = []
    pieces: list[str] = []
    linked = links = number = at = 0

    def flush() -> None:
        nonlocal pieces, linked
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            found.append(Block(text, linked, *(tuple(s[k] for s in stack) for k in (1, 0, 2))))
        pieces, linked = [], 0

    def said(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if links:
            linked += len(text)

    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            said(html[at:])
            break
        if lt > at:
            said(html[at:lt])
        m = _TAG.match(html, lt) or _LOOSE_TAG.match(html, lt)
        if not m:
            said("<")
            at = lt + 1
            continue
        at = m.end()
        if m.re is _LOOSE_TAG or m[2] is None:
            continue
        closing, tag = m[1], m[2].lower()
        if not closing and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else (len(html) if tag in ("script", "style") else at)
            if tag == "title" or tag in BLOCKS:
                flush()
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br" or tag == "wbr":
            pieces.append(" " if tag == "br" else "")
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        ended = ENDED.get(tag, ())
        while stack and stack[-1][0] in ended:
            stack.pop()
        if tag not in VOID and not m[3].endswith("/"):
            named = " ".join(x.strip("\"'") for x in _NAMED.findall(m[3]))
            words = frozenset(_WORD.findall(_STATE.sub("", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower())))
            number += 1
            stack.append((tag, number, words))
    flush()
    return found


def _named(b: Block, words: frozenset[str], low: int, high: int) -> float:
    """1 if the nearest of the elements low to high is named with one of the words, less the farther off it is."""
    parts = [names for tag, names in zip(b.tags[low:high], b.names[low:high], strict=True) if tag not in WHOLE]
    return max((FADE**k for k, names in enumerate(reversed(parts)) if names & words), default=0.0)


def features(b: Block, article: bool) -> list[float]:
    """What the classifier knows of a block; article tells whether the page has one."""
    inside, n, deep = set(b.tags), len(b.text), len(b.tags)
    holder = max((i for i, t in enumerate(b.tags) if t in ("article", "main")), default=-1)
    return [
        1.0,
        float(holder >= 0),
        float(article and "article" not in inside),
        float(bool(inside & {"aside", "menu", "dialog"})),
        float("header" in inside and holder < 0),
        _named(b, ASIDE_WORDS if holder < 0 else ASIDE_WORDS - {"header"}, holder + 1, deep),
        _named(b, ASIDE_WORDS, 0, max(holder, 0)),
        _named(b, MAIN_WORDS, holder + 1, deep),
        min(b.linked / n, 1.0),
        min(np.log1p(n) / 6, 1.5),
        float(b.text[-1] in ".!?\"'”»…"),
        min(b.text.count(",") / 4, 1.0),
        float(b.tags[-1:] in (("p",), ("blockquote",), ("pre",))),
        float(b.tags[-1:] == ("li",)),
        float(bool(b.tags) and b.tags[-1] in ("h1", "h2", "h3", "h4", "h5", "h6")),
    ]


# The labelled table: pages whose blocks are marked + for content and - for boilerplate.
LABELLED = (
    '<body><header><div class="logo">-Daily News</div><ul class="menu"><li><a>-Home</a><li><a>-World</a></ul></header>'
    '<div class="cookie-notice">-We use cookies to improve this site. <a>Accept</a></div><main><article><h1>+A title of some '
    "words</h1><p>+First paragraph, with a comma, of an article about a thing that happened.</p><p>+Short one.</p>"
    '<div class="ad">-Buy this now, it is cheap!</div><ul><li>+An item of a list, in the article.</li><li>+Another</li></ul>'
    "<blockquote>+Someone said this about it.</blockquote><p>+Last.</p></article></main><aside><h3>-Related</h3><ul><li><a>-Other "
    'story here</a></ul></aside><section class="comments"><h2>-Comments</h2><p>-I do not agree with this at all, sorry.</p></section>'
    "<form><p>-Sign up for our newsletter, it is free.</p></form><footer><p>-Copyright by us, all rights reserved.</p></footer></body>",
    '<body><nav><a>-Start</a> <a>About</a></nav><div class="content"><h2>+Heading of the text</h2><p>+This page has no article tag, '
    "but its text is long enough to be known, with commas, and full stops.</p><p>+It goes on like this for a while, and then it "
    'ends here.</p><p>+Yes.</p></div><div class="sidebar"><p>-Popular posts of the week, chosen by us.</p><a>-One</a></div>'
    '<div id="footer"><a>-Terms</a> <a>Privacy</a></div></body>',
    "<body><div><a>-Home</a> <a>Shop</a> <a>Contact</a></div><div><p>+A plain page in which nothing but the text itself tells what "
    "is content, as it has many words, and few links.</p><p>+A second paragraph follows, it is long as well, and has a <a>link</a> "
    "in it.</p></div><div><ul><li><a>-More</a><li><a>-Links</a></ul></div><div>-2019 Example Ltd</div></body>",
    '<body><div class="banner">-Summer sale, up to half off!</div><article><header><h1>+Title inside the article</h1></header>'
    "<p>+Text of it.</p><table><tr><td>+Cell</td><td>+Other cell</td></tr></table><p>+Fine.</p>"
    '<div class="share">-Share this</div></article><div class="related">-You may also like these stories.</div>'
    '<div class="comment-list"><p>-Great read, thank you for it.</p></div><footer>-Imprint</footer></body>',
    '<body class="has-sidebar single-post"><div class="page with-header"><article class="post social"><div class="post-header"><h1>'
    '+A title under a header name</h1></div><div class="widget"><p>+This part has the name of a widget, but it is a long text of '
    "the article, with commas, and full stops, as its neighbours are.</p><p>+It goes on, and says more of the same thing, at "
    'length.</p></div><p>+Then it ends.</p><div class="widget"><a>-More</a></div></article><aside><p>-Popular posts of the week, '
    "chosen by us.</p></aside><p>-Text after the article, which is none of it.</p></div></body>",
    '<body><article><h1>+The story</h1><p>+Its text, in full.</p></article><div class="related"><article><h3>-Other story</h3><p>'
    "-What it is about.</p></article></div></body>",
    '<body class="no-comments"><header><h1>-Site</h1><p>-A line about the site</p></header><article><p>+Short text here.</p><div '
    'class="comments"><p>-I disagree.</p><p>-Me too!</p></div><aside>-Related</aside><p>+And its end.</p></article></body>',
    "<body><p>+Only a paragraph, nothing else, but a whole one.</p></body>",
    "<body><h1>+A title</h1><p>+One line of text follows the title here.</p></body>",
)


def fit(rounds: int = 100, ridge: float = 0.02) -> np.ndarray:
    """Weights of a logistic classifier of blocks, learned from LABELLED by Newton's method."""
    pages = [blocks(page) for page in LABELLED]
    y = np.array([float(b.text[0] == "+") for page in pages for b in page])
    for page in pages:
        for b in page:
            b.text = b.text[1:]
    x = np.array([features(b, has_article(page)) for page in pages for b in page])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def has_article(page: list[Block]) -> bool:
    return any("article" in b.tags for b in page)


def costs(page: list[Block], weights: np.ndarray) -> list[float]:
    """For each block, what calling it boilerplate costs over calling it content (log odds).

    Only text under nav, footer and form is boilerplate for certain. Names, asides, headers and articles
    are features of the classifier, so the cut weighs them against the text and its neighbours.
    """
    article = has_article(page)
    return [
        -HARD if NEVER & set(b.tags) else float(np.clip(np.dot(features(b, article), weights), -20, 20)) for b in page
    ]


def smoothness(page: list[Block]) -> list[tuple[int, int, float]]:
    """Edges: neighbours on the page, the stronger the more elements they share; and siblings farther off."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(page):
        if i:
            shared = 0
            for x, y in zip(page[i - 1].path, b.path, strict=False):
                if x != y:
                    break
                shared += 1
            edges.append((i - 1, i, 0.25 + shared / max(len(page[i - 1].path), len(b.path), 1)))
        parent = b.path[-2] if len(b.path) > 1 else 0
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, 0.5))
        last[parent] = i
    return edges


def min_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost: a block called boilerplate pays cost > 0, content pays -cost < 0,
    and an edge between different labels pays its weight. True is content; ties are boilerplate.

    Blocks whose own cost outweighs all their edges are settled first, which leaves the rest exact: the
    edge of a settled neighbour is a cost of one's own. What stays open is cut by max-flow.
    """
    n = len(cost)
    cost = list(cost)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(cost[i]) <= sum(near[i].values()) and (near[i] or cost[i] > 0):
            continue
        label[i] = cost[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            cost[j] += w if label[i] else -w
            queue.append(j)
        near[i] = {}
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        reached = _flow(open_, cost, near)
        for i in open_:
            label[i] = i in reached
    return [bool(x) for x in label]


def _flow(nodes: list[int], cost: list[float], near: list[dict[int, float]]) -> set[int]:
    """Max-flow by shortest augmenting paths (Dinic); the nodes on the source's side of the cut."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        if cost[i] > 0:
            room[source][i], room[i][source] = cost[i], 0.0
        else:
            room[i][sink], room[sink][i] = -cost[i], 0.0
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
            return set(level) - {source}
        ways = {i: iter(list(room[i])) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                push = min(room[a][b] for a, b in zip(path[:-1], path[1:], strict=True))
                for a, b in zip(path[:-1], path[1:], strict=True):
                    room[a][b] -= push
                    room[b][a] += push
                cut = next(k for k in range(len(path) - 1) if room[path[k]][path[k + 1]] <= 1e-12)
                # the saturated edge's start may have other ways; what follows it is tried anew
                del path[cut + 1 :]
                continue
            for j in ways[i]:
                if level.get(j) == level[i] + 1 and room[i][j] > 1e-12:
                    path.append(j)
                    break
            else:
                path.pop()


def main_text(html: str, weights: np.ndarray) -> str:
    page = blocks(html)
    keep = min_cut(costs(page, weights), smoothness(page))
    return "\n".join(b.text for b, k in zip(page, keep, strict=True) if k)


@lru_cache(maxsize=1)
def _loaded(data: bytes) -> np.ndarray:
    return pickle.loads(data)


def _extract(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _loaded(data)
        for batch in batches:
            texts = [main_text(h, weights) for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"]
            )

    return run


def extract(pages: DataFrame) -> DataFrame:
    """All columns of pages but html, and text (string) and n_chars (long, code points).

    The main text's blocks in page order, one a line; white space inside a block is one space, also a
    <br>. Null and empty html, and pages without main text, give an empty text. Unclosed, crossed and
    broken tags are taken as browsers mostly do; unclosed comments and scripts run to the end. Repeated
    rows repeat; columns named like the results are replaced; an empty table gives an empty one. Pages
    are read whole; a page of very deep nesting takes time and memory with the square of its depth.
    """
    own = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    (whole,) = fresh_names(pages, "whole")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema.fields if f.name in own)
    out = arrow_map(
        pages.select(F.coalesce(F.col("html").cast("string"), F.lit("")).alias(whole), *own),
        _extract(pickle.dumps(fit())),
        f"{schema}text string",
    )
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
