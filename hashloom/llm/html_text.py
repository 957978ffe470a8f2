"""Main text of web pages: blocks labelled by a minimum cut between content and boilerplate."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm.common import table
from hashloom.llm.registry import query

#: Pages that the block classifier is trained on at most.
TRAINING_PAGES = 200
#: Capacity of the edge between neighbouring blocks that lie side by side, and between siblings apart.
NEIGHBOURS, SIBLINGS = 1.0, 0.25

# Fixed values of HTML: elements that start a block, have no end tag, and hold no text of the page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " section select summary table tbody td template tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset(
    "script style noscript template head title iframe object svg canvas audio video button input select option"
    " textarea datalist annotation annotation-xml".split()
)
#: All that a head may hold; its end tag may be omitted, so whatever else comes ends an open head.
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements and words of class, id and role that tell what a part of a page is for.
CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_TAGS = frozenset("nav aside footer form menu dialog".split())
CONTENT_WORDS = frozenset("article content entry main post story".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent"
    " contentinfo cookie cookies copyright discussion disqus footer form gdpr login masthead menu modal nav navbar"
    " navigation newsletter notice notices pager pagination paywall popup promo promoted recommended related replies"
    " reply respond search share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split()
)
#: Of these, the words for a part that is no article of its page even if it is made of article elements.
FIRM_WORDS = frozenset(
    "ad ads advert advertisement advertising comment comments discussion disqus promo promoted recommended related replies"
    " reply respond sponsor sponsored teaser".split()
)
#: Words that say nothing in an id.  An id with any other word names a place to link to ("related-work"), no purpose.
PLAIN_WORDS = frozenset(
    "site page main top bottom left right area section wrapper wrap container box block list bar inner outer posts articles"
    " links item items primary secondary global content".split()
)
#: How a reader's comment, and the small print of a page, begin or read where no element or class tells.
REPLY = re.compile(r"@?(?=\w*[\d_])\w+ (?:said|says|wrote|writes|commented|replied|answered)\b[^.!?]{0,40}:")
SMALL_PRINT = re.compile(
    r"^(?:©|\(c\) |copyright\b)|\ball rights reserved\b|\b(?:we|site) uses? cookies\b|\baccept (?:all )?cookies\b"
    r"|\b(?:sign up|subscribe) (?:for|to) our\b",
    re.IGNORECASE,
)
SMALL_PRINT_CHARS = 400
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

FEATURES = (
    "one", "content", "boilerplate", "site_header", "words", "links", "sentence", "heading", "bare", "reply", "small_print"
)
#: Weights before training; training moves them as far as the sampled pages give reason to.
PRIOR = np.array([-1.0, 6.0, -9.0, -5.0, 0.4, -3.0, 0.5, 0.5, 1.5, -12.0, -3.0])
#: A text on so many sampled pages of one host, and on none of another, is taken for a part of the site, if it has so many words: shorter ones meet by chance.
REPEATED, REPEATED_WORDS = 3, 4


def _words(value: str) -> frozenset:
    return frozenset(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())) - {""}


class _Blocks(HTMLParser):
    """The text blocks of a page in order, each with what its ancestors say about it.

    Open elements are kept as a stack; an end tag closes up to its element, one without is ignored, a new
    paragraph or list item closes an open one, and what can't be in a head closes an open head.  Every
    element knows the state it hands down, so deep nesting costs nothing extra.  Classes of html and body
    name what a page has, not what the whole of it is for: they make nothing boilerplate or a site header.

    An article or main element is content whatever its layout classes, and inside a form or a part whose class
    speaks of layout; navigation, asides, footers, comments, adverts and related pages stay boilerplate.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # tag, number, silent, content, firm boilerplate, site header, links, heading, loose boilerplate
        self._stack = [("", 0, False, False, False, False, False, False, False)]
        self._elements = 0
        self._parts: list[str] = []
        self._linked = 0
        self._owner = self._stack[0]
        self._depth = 0
        self._lowest = 0
        self.blocks: list[tuple] = []  # text, state, linked characters, depth, lowest depth since the last, parent

    def _end_block(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            parent = self._stack[-2][1] if len(self._stack) > 1 else 0
            self.blocks.append((text, self._owner, self._linked, self._depth, self._lowest, parent))
            self._lowest = self._depth
        self._parts, self._linked = [], 0

    def _end_head(self) -> None:
        while any(open_[0] == "head" for open_ in self._stack):
            self._pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body" or (self._stack[-1][0] == "head" and tag not in HEAD_TAGS):
            self._end_head()
        if tag in VOID_TAGS:
            if tag == "br":
                self._parts.append(" ")
            elif tag == "hr":
                self._end_block()
            return
        if tag in BLOCK_TAGS:
            self._end_block()
            if tag in ("p", "li") and self._stack[-1][0] == tag:
                self._pop()
            elif self._stack[-1][0] == "p":
                self._pop()
        top = self._stack[-1]
        words = frozenset()
        for key, value in attrs:
            if value and key in ("class", "role"):
                words |= _words(value)
            elif value and key == "id":
                named = _words(value)
                purpose = named <= PLAIN_WORDS | BOILERPLATE_WORDS | {"header"}
                words |= named if purpose else named & CONTENT_WORDS
        element = tag in CONTENT_TAGS
        content = element or bool(words & CONTENT_WORDS)
        page = tag in ("html", "body")
        firm = (tag in BOILERPLATE_TAGS and tag != "form") or (not page and bool(words & FIRM_WORDS))
        loose = tag == "form" or (not page and not element and bool(words & BOILERPLATE_WORDS))
        firm, loose = top[4] or firm, loose or (top[8] and not element)
        header = (tag == "header" or (not page and "header" in words)) and not top[3]
        hidden = any(key == "hidden" or (key == "aria-hidden" and value == "true") for key, value in attrs)
        self._elements += 1
        self._stack.append(
            (
                tag,
                self._elements,
                top[2] or tag in SILENT_TAGS or hidden,
                (top[3] or content) and not (firm or loose),
                firm,
                top[5] or header,
                top[6] or tag == "a",
                top[7] or tag in HEADINGS,
                loose,
            )
        )

    def _pop(self) -> None:
        self._stack.pop()
        self._lowest = min(self._lowest, len(self._stack))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and tag not in ("p", "div", "span"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID_TAGS:
            return
        for up in range(len(self._stack) - 1, 0, -1):
            if self._stack[up][0] == tag:
                if tag in BLOCK_TAGS or any(open_[0] in BLOCK_TAGS for open_ in self._stack[up:]):
                    self._end_block()
                while len(self._stack) > up:
                    self._pop()
                return
            if self._stack[up][0] in ("body", "article", "main", "section") and tag not in BLOCK_TAGS:
                return  # a stray inline end tag doesn't reach beyond its section

    def handle_data(self, data: str) -> None:
        if self._stack[-1][0] == "head" and data.strip(" \t\n\f\r"):
            self._end_head()
        top = self._stack[-1]
        if top[2]:
            return
        if not self._parts or not "".join(self._parts).strip():
            self._owner, self._depth = top, len(self._stack)
        self._parts.append(data)
        if top[6]:
            self._linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._end_block()


def blocks_of(html: str) -> list[tuple]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    return parser.blocks


def features(blocks: list[tuple]) -> np.ndarray:
    rows = []
    bare = not any(state[3] for _, state, *_ in blocks)
    opening: dict[int, bool] = {}
    for text, state, linked, _, _, parent in blocks:
        reply = REPLY.match(text) is not None
        # an element that begins with a comment holds a thread of them
        opening.setdefault(parent, reply)
        rows.append(
            (
                1.0,
                state[3],
                state[4] or state[8],
                state[5] and not state[3],
                np.log1p(text.count(" ") + 1),
                min(1.0, linked / len(text)),
                text[-1] in ".!?…\"'”»",
                state[7],
                bare,
                reply or opening[parent],
                len(text) <= SMALL_PRINT_CHARS and SMALL_PRINT.search(text) is not None,
            )
        )
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES))


def repetition(pages: list[list[tuple]], hosts: list) -> list[np.ndarray]:
    """Labels of the blocks of each page that no feature contains: 0 for a text that REPEATED pages of one host have and none
    of another, 1 for one that a single page has, -1 for the rest.  What several hosts have is quoted or copied.  A page of
    which repeated texts are the greater part is a copy too, and its blocks have no label."""
    owners: dict[str, set] = {}
    counts: Counter = Counter()
    for host, blocks in zip(hosts, pages):
        for text in {block[0] for block in blocks}:
            counts[text] += 1
            owners.setdefault(text, set()).add(host)
    labels = []
    for blocks in pages:
        alone = np.array([len(owners[block[0]]) == 1 for block in blocks], dtype=bool)
        times = np.array([counts[block[0]] for block in blocks], dtype=int)
        lengths = np.array([len(block[0]) for block in blocks], dtype=int)
        long = np.array([block[0].count(" ") + 1 >= REPEATED_WORDS for block in blocks], dtype=bool)
        found = np.where((times >= REPEATED) & alone & long, 0, np.where(times == 1, 1, -1))
        labels.append(np.full(len(blocks), -1) if 2 * lengths[times > 1].sum() > lengths.sum() else found)
    return labels


def train(pages: list[tuple], rounds: int = 8, looseness: float = 1.0) -> np.ndarray:
    """Weights of the block classifier: logistic regression around PRIOR by Newton's method.

    ``pages`` are (host, html); a page without host is a site of its own.  Labels come from repetition.  Comments, adverts and links are often on one page only without being
    content, so a text of one page is an example of content only where it is no comment, small print, mere link or part
    marked as boilerplate.  ``looseness`` is the variance of the weights around their prior.
    """
    pages = list(dict.fromkeys(pages))
    hosts = [host or number for number, (host, _) in enumerate(pages)]
    blocks = [blocks_of(html) for _, html in pages]
    every = np.concatenate([np.zeros((0, len(FEATURES))), *map(features, blocks)])
    labels = np.concatenate([np.zeros(0, dtype=int), *repetition(blocks, hosts)])
    doubtful = every[:, [2, 3, 9, 10]].any(axis=1) | (every[:, 5] > 0.5)
    used = (labels == 0) | ((labels == 1) & ~doubtful)
    spoken, labels = every[used], labels[used]
    weights = PRIOR.copy()
    if not len(spoken):
        return weights
    # A page gives many blocks like each other: the sample weighs as much as a hundred blocks.
    scale = min(1.0, 100 / len(spoken))

    def loss(some: np.ndarray) -> float:
        margin = (1 - 2 * labels) * (spoken @ some)
        return scale * np.logaddexp(0, margin).sum() + ((some - PRIOR) ** 2).sum() / (2 * looseness)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(spoken @ weights, -30, 30)))
        gradient = scale * spoken.T @ (labels - p) - (weights - PRIOR) / looseness
        curvature = scale * (spoken.T * (p * (1 - p))) @ spoken + np.eye(len(weights)) / looseness
        step = np.linalg.solve(curvature, gradient)
        # Newton's whole step overshoots where most blocks are far from the boundary.
        for _ in range(30):
            if loss(weights + step) <= loss(weights):
                weights = weights + step
                break
            step = step / 2
    return weights


# -- minimum cut -----------------------------------------------------------------------------------


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    A node of positive gain is tied to the source by that capacity, one of negative gain to the sink;
    cutting an edge costs its capacity.  Shortest augmenting paths in layers (Dinic), without recursion.
    Nodes that either side may have go to the sink.
    """
    source, sink = len(gain), len(gain) + 1
    target: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(gain) + 2)]

    def tie(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(target))
        target.append(b)
        room.append(forth)
        out[b].append(len(target))
        target.append(a)
        room.append(back)

    for node, value in enumerate(gain):
        if value > 0:
            tie(source, node, value, 0.0)
        elif value < 0:
            tie(node, sink, -value, 0.0)
    for a, b, capacity in edges:
        tie(a, b, capacity, capacity)
    least = 1e-9
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue:
            node = queue.popleft()
            for edge in out[node]:
                if room[edge] > least and level[target[edge]] < 0:
                    level[target[edge]] = level[node] + 1
                    queue.append(target[edge])
        if level[sink] < 0:
            return [level[node] >= 0 for node in range(len(gain))]
        following = [0] * len(out)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                pushed = min(room[edge] for edge in path)
                cut = 0
                for place, edge in enumerate(path):
                    room[edge] -= pushed
                    room[edge ^ 1] += pushed
                for place, edge in enumerate(path):
                    if room[edge] <= least:
                        cut = place
                        break
                node = target[path[cut] ^ 1]
                del path[cut:]
                continue
            while following[node] < len(out[node]):
                edge = out[node][following[node]]
                if room[edge] > least and level[target[edge]] == level[node] + 1:
                    break
                following[node] += 1
            if following[node] < len(out[node]):
                path.append(out[node][following[node]])
                node = target[path[-1]]
            elif path:
                level[node] = -1
                node = target[path.pop() ^ 1]
                following[node] += 1
            else:
                break


def extract(html: str, weights: np.ndarray = PRIOR) -> str:
    """The content blocks of a page, joined by an empty line."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    gain = (features(blocks) @ weights).tolist()
    edges, last_child = [], {}
    for number, (_, _, _, depth, lowest, parent) in enumerate(blocks):
        if number:
            # Steps up from the last block to the element that holds both, and down to this one.
            steps = (blocks[number - 1][3] - min(lowest, depth)) + (depth - min(lowest, depth))
            edges.append((number - 1, number, NEIGHBOURS / (1 + max(0, steps))))
        before = last_child.get(parent)
        if before is not None and before != number - 1:
            edges.append((before, number, SIBLINGS))
        last_child[parent] = number
    kept = minimum_cut(gain, edges)
    return "\n\n".join(block[0] for block, keep in zip(blocks, kept) if keep)


def _extracted(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(html or "", weights) for html in batch.column("html").to_pylist()]
            lengths = pa.array([len(text) for text in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), lengths],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def main_texts(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The block classifier is trained on a bounded sample of pages: half of them those with the smallest hash of
    page_id, half whole sites, by the hash of the host; every whole page is extracted.  A page that is null, empty or without content has the
    empty text.  Null ids and urls are kept; repeated rows are extracted each; an empty table gives no
    rows.  Broken markup is read as far as it goes: what is not closed ends with its parent.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    host = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    usable = rows.where(F.col("html").isNotNull() & F.col("page_id").isNotNull())
    # Ids first: every task would send its first pages to the driver otherwise.
    keys = usable.select("page_id", host.alias("host"))
    some = keys.orderBy(F.xxhash64("page_id"), "page_id").limit(training_pages - training_pages // 2)
    sites = keys.where(F.col("host") != "").orderBy(F.xxhash64("host"), "host", F.xxhash64("page_id"), "page_id")
    ids = {row["page_id"] for row in some.union(sites.limit(training_pages // 2)).collect()}
    # several rows may share an id
    sample = usable.where(F.col("page_id").isin(list(ids))).orderBy("page_id", F.xxhash64("html")).limit(training_pages)
    weights = train([(row["host"], row["html"]) for row in sample.select(host.alias("host"), "html").collect()])
    return rows.mapInArrow(_extracted(weights), "page_id long, url string, text string, n_chars long")


@query()
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
