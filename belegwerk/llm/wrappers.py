"""Main text of web pages through wrappers inferred per host.

The pages of a host are aligned one after another. What agrees stays, texts that differ become slots,
neighbours of one kind become a repeated group, and what only some pages have becomes optional: a
regular expression over page tokens without unions. The wrapper then tells which parts are article.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.common import null_safe, spread_rows
from belegwerk.operators.joins import lookup_join
from belegwerk.workspace import Workspace

FAN_IN = 64
# A text without a slot is template text only if this many different pages of the host agree on it,
# and they are most of the host's.
AGREE = 5

# Kinds of elements, and words in class names, ids and roles of what is not article.
BLOCKS = frozenset(
    """html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th
    caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary center""".split()
)
SPACES = frozenset("br hr".split())
SKIPPED = frozenset("script style noscript template svg canvas iframe object select textarea button math".split())
RAW = frozenset("script style textarea title noscript iframe".split())
NOISE_TAGS = frozenset("nav footer aside form fieldset".split())
NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored
    menu nav navbar navigation breadcrumb breadcrumbs pager pagination header masthead topbar footer copyright
    sidebar aside widget related recommended share sharing social toolbar
    comment comments commentlist reply replies respond disqus discussion
    notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup
    login search form complementary contentinfo dialog hidden""".split()
)
MAIN_WORDS = frozenset("content article post entry story main".split())
# First words of class names that tell how a block is laid out or filed, not what it is.
MODIFIERS = frozenset("has with no is not without hide show category tag type format status layout theme js wp".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+)))?")
_NAME = re.compile(r"[a-z]+")
# An open button or list of choices ends here at the latest, though its end tag is missing.
_CONTROL_END = re.compile(r"<(?:p|h[1-6]|article|section|main|ul|ol|dl|table|blockquote|header|footer|nav|aside)\b|</(?:div|section|article|main|body|header|footer|nav|form|li|td|p)\b", re.I)
# Blocks deeper than this stand side by side.
DEEPEST = 100
# For Spark: what a page does not show, and its markup.
_UNSEEN = r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<[a-z/!?][^>]*>"


@dataclass
class Element:
    """A block of a page: its kind, and its parts in order, blocks or pieces of text."""

    kind: str
    parts: list[Element | str] = field(default_factory=list)


def _kind(tag: str, attributes: str) -> str:
    """Tag and what class, id and role say; numbers in names are left out, so they do not part pages.

    A name that begins with a word like has or category is about the layout and says nothing. Of an id only
    known words stay: headings have ids of their own, which would make each a kind.
    """
    if not attributes.strip():
        return tag
    words = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            for token in (a or b or c).split():
                parts = _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
                if len(parts) > 1 and parts[0] in MODIFIERS:
                    continue
                words += parts if name != "id" else [w for w in parts if w in NOISE_WORDS or w in MAIN_WORDS]
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", a or b or c)):
            words.append("hidden")
    return " ".join([tag, *sorted(set(words))]) if words else tag


def _skip(text: str, at: int, tag: str, endless: set[str]) -> int:
    """Where the content of an element that is not shown ends; ``at`` if it has no end, and is passed over."""
    if tag in endless:
        return at
    if tag in ("button", "select"):
        end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(text, at)
        stop = _CONTROL_END.search(text, at)
        return end.end() if end and not (stop and stop.start() < end.start()) else at
    depth = 1
    for found in re.compile(rf"<(/?){re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).finditer(text, at):
        if tag in RAW and not found[1]:
            continue
        depth += -1 if found[1] else int(not found[0].rstrip(">").rstrip().endswith("/"))
        if not depth:
            return found.end()
    endless.add(tag)
    # A script or style without an end hides the rest, as in a browser.
    return len(text) if tag in ("script", "style") else at


def parse(page: str | None) -> Element:
    """The blocks of a page. Markup within a block only leaves its text; line breaks count as a blank.

    Open blocks end as in HTML: a new block ends an open paragraph, a list item or cell its like, and
    an end tag all that is open inside it. Ends of what is not open are passed over.
    """
    root = Element("root")
    stack, text = [root], page or ""
    endless: set[str] = set()
    at = 0

    def add(part: Element | str) -> None:
        """Put a part into the open block, or beside it once blocks are too deep."""
        if len(stack) <= DEEPEST:
            stack[-1].parts.append(part)
            return
        beside = stack[DEEPEST - 1].parts
        if isinstance(part, str):
            if beside[-1] is not stack[-1]:
                stack[-1] = Element(stack[-1].kind)
                beside.append(stack[-1])
            stack[-1].parts.append(part)
        else:
            beside.append(part)

    while True:
        found = _TOKEN.search(text, at)
        piece = text[at : found.start()] if found else text[at:]
        if piece:
            add(piece)
        if not found:
            return root
        at = found.end()
        if not found[2]:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag in SKIPPED or tag == "title":
            if not closing and not found[3].rstrip().endswith("/"):
                at = _skip(text, at, tag, endless)
            continue
        if tag in SPACES:
            add(" ")
        elif tag in BLOCKS:
            if closing:
                names = [e.kind.split(" ", 1)[0] for e in stack]
                if tag in names[1:]:
                    del stack[len(names) - 1 - names[::-1].index(tag) :]
                continue
            _end_open(stack, tag)
            element = Element(_kind(tag, found[3]))
            add(element)
            if not found[3].rstrip().endswith("/"):
                stack.append(element)


_ENDS = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}


def _end_open(stack: list[Element], tag: str) -> None:
    for ended, within in ((("p",), ("div", "article", "section", "td", "li", "body", "blockquote")), *([(_ENDS[tag][0].split(), _ENDS[tag][1])] if tag in _ENDS else [])):
        for i in range(len(stack) - 1, 0, -1):
            name = stack[i].kind.split(" ", 1)[0]
            if name in ended:
                del stack[i:]
                break
            if name in within:
                break


def clean(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


# A wrapper node is [kind, pages, flags, text, children]. Flags: 1 optional, 2 repeated. Text nodes have
# kind '#', and a text while all pages agree, None for a slot; a slot's children are the short texts that
# come up in it, with the pages that have them, of which only the most frequent are kept.
OPTIONAL, REPEATED = 1, 2
SHORT, KEPT_TEXTS = 80, 64


def wrapper_of(element: Element) -> list:
    """The wrapper of one page: neighbours of one kind become a repeated group."""
    children: list[list] = []
    for part in _runs(element):
        if isinstance(part, str):
            node = ["#", 1, 0, part, []]
        else:
            node = wrapper_of(part)
        if children and children[-1][0] == node[0]:
            merge(children[-1], node, True)
            children[-1][2] |= REPEATED
        else:
            children.append(node)
    return [element.kind, 1, 0, None, children]


def _runs(element: Element) -> Iterator[Element | str]:
    """Blocks, and the texts between them that are not blank."""
    pieces: list[str] = []
    for part in [*element.parts, None]:
        if isinstance(part, str):
            pieces.append(part)
            continue
        if pieces and (text := clean(pieces)):
            yield text
        pieces = []
        if part is not None:
            yield part


def _texts(node: list) -> dict[str, int]:
    if node[3] is None:
        return node[4] or {}
    return {node[3]: node[1]} if len(node[3]) <= SHORT else {}


def merge(a: list, b: list, same_page: bool = False) -> None:
    """Align wrapper ``b`` with ``a`` and generalise ``a`` so that it covers both.

    Of neighbours on the ``same_page`` the pages are not added up.
    """
    texts = (_texts(a), _texts(b)) if a[0] == "#" and (a[3] is None or a[3] != b[3]) else None
    a[1] = max(a[1], b[1]) if same_page else a[1] + b[1]
    a[2] |= b[2]
    if a[0] == "#":
        if texts:
            both, more = dict(texts[0]), texts[1]
            for text, n in more.items():
                both[text] = max(both.get(text, 0), n) if same_page else both.get(text, 0) + n
            if len(both) > KEPT_TEXTS:
                both = dict(sorted(both.items(), key=lambda x: -x[1])[:KEPT_TEXTS])
            a[3], a[4] = None, both
        return
    merged: list[list] = []
    for x, y in align([c[0] for c in a[4]], [c[0] for c in b[4]]):
        if y is None:
            node = a[4][x]
            node[2] |= OPTIONAL
        elif x is None:
            node = b[4][y]
            node[2] |= OPTIONAL
        else:
            node = a[4][x]
            merge(node, b[4][y], same_page)
        if merged and merged[-1][0] == node[0]:
            merge(merged[-1], node, True)
            merged[-1][2] |= REPEATED
        else:
            merged.append(node)
    a[4] = merged


def align(a: list[str], b: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """Places of a longest common subsequence side by side, the rest with None, in order."""
    if a == b:
        yield from zip(range(len(a)), range(len(b)))
        return
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            yield i, None
            i += 1
        else:
            yield None, j
            j += 1


def shelter(page: Element) -> set[int]:
    """Ids of the blocks that are around the article, whatever their names say.

    These hold an article or main element; and forms with most of the page's text, around all of a page.
    """
    held: set[int] = set()
    sizes: dict[int, int] = {}
    forms: list[Element] = []

    def walk(element: Element) -> tuple[int, bool]:
        size, marked = 0, False
        for part in element.parts:
            if isinstance(part, str):
                size += len(part.strip())
                continue
            more, inner = walk(part)
            size += more
            # An article that is a comment or a widget marks nothing.
            marked |= inner or (part.kind.split(" ", 1)[0] in ("article", "main") and not is_noise(part.kind, False))
        if marked:
            held.add(id(element))
        sizes[id(element)] = size
        if element.kind.split(" ", 1)[0] in ("form", "fieldset"):
            forms.append(element)
        return size, marked

    total, _ = walk(page)
    return held | {id(f) for f in forms if sizes[id(f)] * 2 > total}


def is_noise(kind: str, in_article: bool, around: bool = False) -> bool:
    """Whether a block's tag or names say that it is no article text; an article's own header is, and so
    is what stands ``around`` an article, but for menus, asides and footers.
    """
    tag, *words = kind.split(" ")
    if around:
        return tag in NOISE_TAGS - {"form", "fieldset"}
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return True
    names = NOISE_WORDS - {"header"} if in_article else NOISE_WORDS
    return tag not in ("html", "body", "main") and not names.isdisjoint(words)


def marks_of(wrapper: list) -> list[str]:
    """What marks the article on pages of a host, best first: 'article', 'main', kinds of blocks.

    Preferred are article elements, then main ones, then blocks named like content; of those the
    ones whose slots stand on more pages, deepest last.
    """
    found: dict[str, list] = {"article": [], "main": [], "named": []}
    around: set[int] = set()

    def holds(node: list) -> bool:
        inner = [holds(c) or (c[0].split(" ", 1)[0] in ("article", "main") and not is_noise(c[0], False)) for c in node[4] if c[0] != "#"]
        if any(inner) or node[0].split(" ", 1)[0] in ("form", "fieldset"):
            around.add(id(node))
        return any(inner)

    holds(wrapper)

    def walk(node: list, depth: int) -> int:
        slots = 0
        for child in node[4]:
            if child[0] == "#":
                slots += child[1] if child[3] is None or child[2] & REPEATED else 0
            elif not is_noise(child[0], False, id(child) in around):
                slots += walk(child, depth + 1)
        tag, *words = node[0].split(" ")
        if tag in ("article", "main"):
            found[tag].append((slots, -depth, node[0]))
        elif tag in ("div", "section", "td") and ("main" in words or not MAIN_WORDS.isdisjoint(words)):
            found["named"].append((slots, -depth, node[0]))
        return slots

    walk(wrapper, 0)
    named = dict.fromkeys(kind for _, _, kind in sorted(found["named"], reverse=True))
    return [*(tag for tag in ("article", "main") if found[tag]), *named]


def mark_on(page: Element, marks: list[str], around: set[int]) -> str | None:
    """The first of ``marks`` that holds most of the text that any of them holds on this very page; None for its whole body."""
    held: dict[str, int] = dict.fromkeys(marks, 0)

    def walk(element: Element, inside: tuple[str, ...]) -> None:
        for part in _runs(element):
            if isinstance(part, str):
                for mark in inside:
                    held[mark] += len(part)
            elif not is_noise(part.kind, bool(inside), id(part) in around):
                walk(part, tuple({*inside, *{part.kind, part.kind.split(" ", 1)[0]}.intersection(marks)}))

    walk(page, ())
    most = max(held.values(), default=0)
    return next((m for m in marks if held[m] and held[m] * 2 >= most), None)


def template_texts(wrapper: list, whole: bool = False) -> tuple[dict[int, set[str]], set[int]]:
    """The wrapper's template texts by the id of their node, and the ids of all nodes that hold one.

    Template is a text inside the articles, outside of groups, that stands in one place of most of the
    host's different pages, of ``AGREE`` at least. Only if something else in the articles differs:
    else nothing tells template from text. With ``whole``, for pages on which nothing marks an article, all
    that most pages of the host agree on is template, in whatever element and in groups as well: what is left
    are the slots.
    """
    texts: dict[int, set[str]] = {}
    above: set[int] = set()
    slots = 0

    def walk(node: list, inside: bool, repeated: bool) -> bool:
        nonlocal slots
        inside = inside or node[0].split(" ", 1)[0] in ("article", "main")
        holds = False
        for child in node[4]:
            again = repeated or bool(child[2] & REPEATED)
            if child[0] == "#":
                slots += inside and child[3] is None
                if not inside or not (whole or (not again and child[3] is not None and node[0].split(" ", 1)[0] not in ("h1", "p"))):
                    continue
                counts = {child[3]: child[1]} if child[3] is not None else child[4]
                dull = {t for t, n in counts.items() if n >= AGREE and n * 2 > wrapper[1]}
                if dull:
                    texts[id(child)] = dull
                    holds = True
            elif walk(child, inside, again):
                holds = True
        if holds:
            above.add(id(node))
        return holds

    walk(wrapper, whole, False)
    return (texts, above) if slots else ({}, set())


def places(parts: list[Element | str], node: list) -> list[list | None]:
    """The child of a wrapper's node that each part of a page's block stands for."""
    kinds: list[str] = []
    group = []
    for part in parts:
        kind = "#" if isinstance(part, str) else part.kind
        if not kinds or kinds[-1] != kind:
            kinds.append(kind)
        group.append(len(kinds) - 1)
    child: dict[int, list] = {}
    for x, y in align([c[0] for c in node[4]], kinds):
        if x is not None and y is not None:
            child[y] = node[4][x]
    return [child.get(g) for g in group]


def extract(page: str | None, wrapper: list) -> str:
    """The article's blocks in page order, joined by two line feeds, without texts that are template at their place.

    A main heading that stands before the article in the main element belongs to it. On a page that
    nothing marks, the wrapper alone decides: the slots are the text.
    """
    root = parse(page)
    around = shelter(root)
    mark = mark_on(root, marks_of(wrapper), around)
    dull, above = template_texts(wrapper, mark is None)
    out: list[str] = []

    def walk(element: Element, inside: bool, main: bool, node: list | None) -> None:
        parts = list(_runs(element))
        stand = places(parts, node) if node is not None and id(node) in above else [None] * len(parts)
        for part, place in zip(parts, stand):
            if isinstance(part, str):
                if inside and not (place is not None and part in dull.get(id(place), ())):
                    out.append(part)
            elif not is_noise(part.kind, inside, id(part) in around):
                tag = part.kind.split(" ", 1)[0]
                mine = mark is None or part.kind == mark or tag == mark or (main and tag == "h1")
                walk(part, inside or mine, main or tag == "main", place)

    walk(root, mark is None, False, wrapper)
    return "\n\n".join(out)


def host_of(url: str) -> F.Column:
    """The lower-cased host of a URL without a port; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(F.length(host) > 0, host)


def infer(ws: Workspace, pages: DataFrame) -> DataFrame:
    """``host_key, wrapper`` from ``pages(host_key, html)``, over all pages; those of a host with equal texts are one.

    Each task aligns its pages of a host, then the tasks' wrappers are aligned in a tree of at most
    ``FAN_IN`` a step: a wrapper is as large as a page's template, however many pages a host has.
    """
    # 128 bits stand for a page's text; copies collapse in their own task before anything is sent.
    shown = F.regexp_replace(F.coalesce("html", F.lit("")), _UNSEEN, " ")
    shown = F.btrim(F.regexp_replace(shown, r"\s+", " "))
    hashed = pages.select("host_key", "html", F.explode(F.array(shown)).alias("shown"))
    hashed = hashed.select("host_key", "html", F.xxhash64("shown").alias("p"), F.xxhash64(F.lit(7), "shown").alias("q"))
    source = hashed.groupBy("host_key", "p", "q").agg(F.min("html").alias("html")).select("host_key", "html")
    source = source.sortWithinPartitions("host_key")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Hosts come one after another, so a task holds the wrapper of one.
        part = TaskContext.get().partitionId()
        current, known = None, None
        for pdf in batches:
            for host, page in zip(pdf["host_key"], pdf["html"]):
                node = wrapper_of(parse(page))
                if known is not None and host == current:
                    merge(known, node)
                    continue
                if known is not None:
                    yield pd.DataFrame({"host_key": [current], "part": part, "wrapper": [json.dumps(known)]})
                current, known = host, node
        if known is not None:
            yield pd.DataFrame({"host_key": [current], "part": part, "wrapper": [json.dumps(known)]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        nodes = [json.loads(w) for w in pdf["wrapper"]]
        for node in nodes[1:]:
            merge(nodes[0], node)
        return pd.DataFrame({"host_key": pdf["host_key"].iloc[:1], "part": int(pdf["part"].iloc[0]) // FAN_IN, "wrapper": [json.dumps(nodes[0])]})

    schema = "host_key string, part int, wrapper string"
    # Counting the partitions of a shuffled table would run it; there are no more than these.
    table, n = source.mapInPandas(learn, schema), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        n = -(-n // FAN_IN)
        table = table.groupBy("host_key", F.floor(F.col("part") / FAN_IN).alias("slice")).applyInPandas(join, schema)
        if n <= 1:
            return ws.stage(table.select("host_key", "wrapper"), "wrappers")


def main_texts(ws: Workspace, pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    The host is that of the URL; pages without one share a wrapper. A null page is empty and has the
    text ''. Character references are decoded, white space within a block becomes one blank. Repeated
    rows each get a row. A page's text depends on its host's wrapper and on itself only. End tags may be missing:
    an open head ends with the first block, an open button with the next heading, paragraph or list, other
    elements that are not shown are passed over; only an open script or style hides the rest. Names of
    classes that tell the layout, and names of blocks around an article, hide nothing. Blocks nested more than
    ``DEEPEST`` deep stand side by side in page order.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    rows = rows.withColumn("host_key", null_safe(host_of("url")))
    joined = lookup_join(rows, infer(ws, rows), "host_key", "left")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            texts = []
            for page, wrapper in zip(pdf["html"], pdf["wrapper"]):
                if wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = json.loads(wrapper)
                texts.append(extract(page, known[wrapper]))
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    done = spread_rows(joined.select(F.col("page_id").cast("long"), "url", "html", "wrapper"))
    return done.mapInPandas(read, "page_id long, url string, text string, n_chars long")
