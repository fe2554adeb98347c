"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks of text. What a block's ancestors, links, length and punctuation say for or against content is
its terminal capacity; neighbours in page order and blocks of one parent are joined by smoothness edges, the stronger the
nearer they are in the tree. The minimum cut labels all blocks at once: clear evidence decides, and doubtful blocks follow
their surroundings.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noframes xmp noembed".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
#: A start tag that ends an open element, up to the nearest of the elements that hold it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Elements, roles and words of classes and ids whose content isn't the article.
BOILER_TAGS = set("nav footer aside form button select menu dialog noscript template svg canvas object audio video head".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
BOILER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar side rail menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead topbar toolbar related "
    "recommended recommendations share sharing social widget pagination pager search legal copyright disclaimer skip hidden".split()
)
COMMENT_WORDS = set("comment comments commentlist reply replies respond disqus".split())
MAIN_TAGS = {"article", "main"}
MAIN_WORDS = set("article content post entry story main body text".split())

# Weights of the evidence, in hundredths.
STRONG, IN_MAIN, OUT_OF_MAIN, IN_NAMED_MAIN, LINKED, PARAGRAPH, HEADING, SENTENCE, PER_DOUBLING = 900, 400, 200, 200, 300, 60, 40, 60, 40
BIAS = -120
# Smoothness: neighbours in page order (divided by their distance in the tree), and blocks of one parent.
ADJACENT, SIBLING = 80, 60

_TOKEN = re.compile(
    r"<!--(?:(?!-->).)*+(?:-->|\Z)"
    r"|<(?P<slash>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[A-Za-z/!?][^>]*+(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_WORD = re.compile(r"[a-z]+")


@dataclass
class Element:
    """An open element: what it says about the text in it."""

    name: str
    parent: int
    depth: int
    #: 2 for what can't hold the article, 1 where a class or id says so, which an article inside overrules.
    boiler: int
    main: bool
    named: bool
    link: bool


@dataclass
class Block:
    text: str
    parent: int
    tag: str
    linked: int


@dataclass
class Page:
    """Blocks of text in page order, and the elements that they stand in."""

    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)} if rest.strip() else {}


def parse(source: str) -> Page:
    """Cut a page into blocks. Unclosed, misnested and cut-off markup is taken as a browser would, about; scripts, styles, titles
    and comments vanish. A tag that the end of the page cuts off is markup."""
    page = Page([Element("", -1, 0, 0, False, False, False)])
    elements = page.elements
    at, parts, linked, block_parent = 0, [], 0, 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            page.blocks.append(Block(text, block_parent, elements[block_parent].name, linked))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked, block_parent
        if not text:
            return
        if not parts:
            block_parent = at
            while elements[block_parent].name in INLINE:
                block_parent = elements[block_parent].parent
        text = html.unescape(text)
        parts.append(text)
        if elements[at].link:
            linked += len(text.strip())

    position = 0
    while True:
        found = _TOKEN.search(source, position)
        add(source[position : found.start() if found else len(source)])
        if not found:
            break
        position = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if found["slash"]:
            if name not in INLINE:
                flush()
            open_at = at
            while open_at > 0 and elements[open_at].name != name:
                open_at = elements[open_at].parent
            if open_at > 0:
                at = elements[open_at].parent
            continue
        if name not in INLINE:
            flush()
            # A block ends an open paragraph.
            holder = at
            while elements[holder].name in INLINE:
                holder = elements[holder].parent
            if elements[holder].name == "p" and name != "br":
                at = elements[holder].parent
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE).search(source, position)
            position = end.start() if end else len(source)
            if end:
                close = source.find(">", position)
                position = len(source) if close < 0 else close + 1
            continue
        if name in CLOSES:
            ended, holders = CLOSES[name]
            probe, last = at, None
            while probe > 0 and elements[probe].name not in holders:
                if elements[probe].name in ended:
                    last = probe
                probe = elements[probe].parent
            if last is not None:
                at = elements[last].parent
        above, has = elements[at], _attributes(found["rest"])
        words = set(_WORD.findall(f"{has.get('class', '')} {has.get('id', '')}".lower()))
        hidden = "hidden" in has or has.get("aria-hidden") == "true" or "display:none" in has.get("style", "").replace(" ", "")
        header = name == "header" and not above.main
        hard = hidden or header or name in BOILER_TAGS or has.get("role", "") in BOILER_ROLES or bool(words & COMMENT_WORDS)
        if name in MAIN_TAGS:
            boiler = 2 if hard or above.boiler == 2 else 0
        else:
            # A page's root may carry any class.
            own = 2 if hard else int(bool(words & BOILER_WORDS) and name not in {"html", "body"})
            boiler = max(above.boiler, own)
        elements.append(
            Element(
                name,
                at,
                above.depth + 1,
                boiler,
                above.main or name in MAIN_TAGS or has.get("role") == "main",
                above.named or bool(words & MAIN_WORDS) and name not in {"html", "body"},
                above.link or name == "a",
            )
        )
        at = len(elements) - 1
    flush()
    return page


def evidence(block: Block, home: Element, has_main: bool) -> int:
    """Above zero for content: what labelling the block as boilerplate costs; below zero the other way."""
    words = block.text.count(" ") + 1
    score = BIAS + PER_DOUBLING * (words.bit_length() - 1)
    score += PARAGRAPH if block.tag in {"p", "blockquote", "pre"} else HEADING if re.fullmatch("h[1-6]", block.tag) else 0
    score += SENTENCE if block.text[-1] in ".!?:;…。！？\"'”»" else 0
    score -= LINKED if 2 * block.linked > len(block.text) else 0
    score += IN_MAIN if home.main else -OUT_OF_MAIN if has_main else IN_NAMED_MAIN if home.named else 0
    return score - STRONG if home.boiler else score


def minimum_cut(unary: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labels with the least cost: ``unary`` where a label goes against its sign, and an edge's weight where its ends differ.

    A node whose own evidence outweighs all of its edges is settled by it, and its edges become evidence for its neighbours;
    what remains is solved by augmenting flow over shortest paths. Ties are boilerplate.
    """
    n = len(unary)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    score, loose = list(unary), [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(score[i]) > loose[i]:
            label[i] = score[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    score[j] += w if label[i] else -w
                    loose[j] -= w
                    queue.append(j)
    core = [i for i in range(n) if label[i] is None]
    content = _flow(core, score, near, label) if core else set()
    return [i in content if x is None else x for i, x in enumerate(label)]


def _flow(core: list[int], score: list[int], near: list[dict[int, int]], label: list[bool | None]) -> set[int]:
    """The nodes on the source's side of a minimum cut among the unsettled ones."""
    spare = {i: {j: w for j, w in near[i].items() if label[j] is None} for i in core}
    source = {i: score[i] for i in core if score[i] > 0}
    sink = {i: -score[i] for i in core if score[i] < 0}

    while True:
        # Distances from the source over what is left of the capacities.
        level = dict.fromkeys((i for i, c in source.items() if c > 0), 0)
        queue = deque(level)
        while queue:
            i = queue.popleft()
            for j, c in spare[i].items():
                if c > 0 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not any(sink.get(i, 0) > 0 for i in level):
            return set(level)
        # A blocking flow: walks that only go to the next distance, each edge given up once it leads nowhere.
        left = {i: iter(list(spare[i])) for i in level}
        for first in [i for i, c in source.items() if c > 0]:
            path = [first]
            while path and source[first] > 0:
                i = path[-1]
                if sink.get(i, 0) > 0:
                    push = min([source[first], sink[i], *(spare[a][b] for a, b in zip(path, path[1:]))])
                    source[first] -= push
                    sink[i] -= push
                    for a, b in zip(path, path[1:]):
                        spare[a][b] -= push
                        spare[b][a] += push
                    path, left_again = [first], None
                    continue
                for j in left[i]:
                    if spare[i][j] > 0 and level.get(j) == level[i] + 1:
                        path.append(j)
                        break
                else:
                    path.pop()


def _distance(elements: list[Element], a: int, b: int) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a != b:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        steps += 1
    return steps


def content_blocks(source: str | None) -> list[str]:
    """The blocks of a page that are content, in page order, white space collapsed. Null and empty pages have none."""
    if not source:
        return []
    page = parse(source)
    blocks, elements = page.blocks, page.elements
    has_main = any(e.main and not e.boiler for e in elements)
    unary = [evidence(b, elements[b.parent], has_main) for b in blocks]
    edges, by_parent = [], {}
    for i, block in enumerate(blocks):
        if i:
            weight = ADJACENT // (1 + _distance(elements, blocks[i - 1].parent, block.parent))
            if weight:
                edges.append((i - 1, i, weight))
        over = elements[block.parent].parent
        if over in by_parent:
            edges.append((by_parent[over], i, SIBLING))
        by_parent[over] = i
    return [b.text for b, good in zip(blocks, minimum_cut(unary, edges)) if good]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id``, ``url``, ``text`` and ``n_blocks`` for each row of ``pages``.

    The text is the content blocks joined by a space; a page without content has an empty one. Nothing is cut off, however
    long the page is. Repeated rows each give a row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(2)
            found = [content_blocks(sources[i].as_py()) for i in range(batch.num_rows)]
            texts = pa.array([" ".join(f) for f in found], pa.string())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), texts, pa.array(map(len, found), pa.int64())],
                names=["id", "url", "text", "n_blocks"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_blocks bigint")
