"""Main text of web pages by tag-path ratios.

Every block of text has a root-to-leaf path of tags. Text length, punctuation and links are summed
per path and per path prefix; the ratios are smoothed among neighbouring blocks of one parent and
fused into one value per path: what its own blocks hold, what the best box around them holds, and
what tags and attributes say. All paths are compared with one threshold; those above it give the text.
Tags and names only raise or lower a value: an `article` counts as far as it holds the page's text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from html import unescape
from math import sqrt

from pyspark.sql import DataFrame

from footfall.llm.common import map_texts

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HEADING = re.compile(r"h[1-6]\b")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A tag that ends an open one of these, up to the nearest of the second group.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
ASIDE = frozenset("nav header footer aside form button select menu dialog fieldset head".split())
ASIDE_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts adsense sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription"
    " sidebar side aside rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer foot copyright legal comment comments disqus replies reply respond"
    " share sharing social related recommended recommendations trending widget widgets login signup search form toc hidden contentinfo complementary alert".split()
)
#: Words at the end of a name that say nothing by themselves: the word before them decides.
NEUTRAL_NAMES = frozenset(
    "list item items box block wrapper wrap container section area inner outer body content row column col bar panel group links link buttons button text title left right top bottom primary secondary fixed posts thread".split()
)
#: Words before an aside word that make the name a remark on the layout.
LAYOUT_NAMES = frozenset("no without has with".split())
MAIN_NAMES = frozenset("main articlebody mainentity".split())
#: What a path's value is multiplied by: a box beside the text, a name that only mentions one, and
#: the most that an article or main element adds (times the square of its share of the page's value).
BESIDE, MENTIONED, MAIN = 1e-4, 0.5, 20.0
#: Share of the text-weighted mean that a path has to reach.
THRESHOLD = 0.4
LINKED = 0.7


@dataclass
class Paths:
    """Root-to-leaf paths as numbers: each knows its parent's number, which is smaller, and its last tag."""

    known: dict[tuple[int, str], int]
    parent: list[int]
    tag: list[str]
    #: 0: nothing said, 1: a name mentions a box beside the text, 2: the tag or a name is one
    aside: list[int]
    main: list[bool]

    def child(self, parent: int, tag: str, label: str, aside: int, main: bool) -> int:
        at = self.known.get((parent, label))
        if at is None:
            at = self.known[parent, label] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.aside.append(aside)
            self.main.append(main)
        return at


@dataclass
class Block:
    path: int
    parent: int
    text: str
    linked: int


@dataclass
class Open:
    tag: str
    #: the nearest element that is not inline: its path, its number and that of its parent
    path: int
    number: int
    parent: int
    link: bool


def _named(name: str) -> int:
    """2 for the name of a box beside the text (its last telling word), 1 where a name mentions one, else 0."""
    words = [w.lower() for w in NAME.findall(name)]
    if name.lower() in ASIDE_NAMES:
        return 2
    told = [i for i, w in enumerate(words) if w in ASIDE_NAMES]
    if not told:
        return 0
    last = len(words) - 1
    while last > told[-1] and (words[last] in NEUTRAL_NAMES or words[last].isdigit()):
        last -= 1
    return 2 if last == told[-1] and not (last and words[last - 1] in LAYOUT_NAMES) else 1


def _element(tag: str, attrs: str, number: int, parent: Open, paths: Paths) -> Open:
    aside, main, label = 2 * (tag in ASIDE), tag in ("article", "main"), tag
    if "=" in attrs:
        names = [n for m in ATTRIBUTE.finditer(attrs) for v in m.groups() if v for n in v.split()]
        if names:
            main = main or any(n.lower() in MAIN_NAMES for n in names)
            if tag not in ("html", "body", "main"):
                aside = max(aside, *map(_named, names))
            label = f"{tag}.{' '.join(sorted(n.lower() for n in names))}"
    link = tag == "a" or parent.link
    if tag in INLINE and aside < 2:
        return Open(tag, parent.path, parent.number, parent.parent, link)
    return Open(tag, paths.child(parent.path, tag, label, aside, main), number, parent.number, link)


def blocks(html: str) -> tuple[list[Block], Paths]:
    """The blocks of text in page order, with entities decoded and white space collapsed, and their paths."""
    paths = Paths({}, [0], [""], [0], [False])
    stack, found, run = [Open("", 0, 0, 0, False)], [], []
    opened: dict[str, int] = defaultdict(int)
    made = at = linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            run.append(piece)
            if stack[-1].link:
                linked += len(piece.strip())

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            run.clear()
            if text:
                found.append(Block(stack[-1].path, stack[-1].parent, text, min(linked, len(text))))
        linked = 0

    def separate(o: Open) -> bool:
        return o.tag not in INLINE or o.number != stack[-2].number

    def pop(depth: int) -> None:
        while len(stack) > depth:
            if separate(stack[-1]):
                flush()
            opened[stack.pop().tag] -= 1

    def innermost(tags: set[str]) -> int:
        """Depth of the innermost open element of these; 0 where none is open."""
        if not any(opened[t] for t in tags):
            return 0
        return next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag in tags)

    while match := TOKEN.search(html, at):
        add(html[at : match.start()])
        at = match.end()
        tag = match["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if match["close"]:
            if depth := innermost({tag}):
                pop(depth)
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
            if tag not in INLINE:
                flush()
            at = end.end() if end else len(html)
            continue
        if tag in CLOSES_P:
            if depth := innermost({"p"}):
                pop(depth)
        elif tag in ENDS:
            ended, until = ENDS[tag]
            depth = innermost(ended | until)
            if depth and stack[depth].tag in ended and stack[depth].tag not in until:
                pop(depth)
        if tag not in INLINE:
            flush()
        if tag not in VOID and not match["attrs"].endswith("/"):
            made += 1
            inner = _element(tag, match["attrs"], made, stack[-1], paths)
            if tag in INLINE and inner.number == made:
                flush()
            stack.append(inner)
            opened[tag] += 1
    add(html[at:])
    flush()
    return found, paths


def _smooth(values: list[float], parents: list[int]) -> list[float]:
    """Weights 1, 2, 1 over the neighbours that share the parent."""
    out = []
    for i, v in enumerate(values):
        total, weight = 2 * v, 2
        for j in (i - 1, i + 1):
            if 0 <= j < len(values) and parents[j] == parents[i]:
                total, weight = total + values[j], weight + 1
        out.append(total / weight)
    return out


def path_ratios(found: list[Block], paths: Paths) -> tuple[dict[int, float], dict[int, float]]:
    """Per path with text of its own: its ratio before tags and names are heard, and the share of its text inside links.

    The ratio is the geometric mean of what the path's blocks hold and of the best prefix around it.
    """
    size = len(paths.parent)
    n, chars, marks, links = ([0] * size for _ in range(4))
    for b in found:
        n[b.path] += 1
        chars[b.path] += len(b.text)
        marks[b.path] += len(PUNCTUATION.findall(b.text))
        links[b.path] += b.linked
    parents = [b.parent for b in found]
    text = _smooth([chars[b.path] / n[b.path] for b in found], parents)
    punctuation = _smooth([marks[b.path] / n[b.path] for b in found], parents)
    own: dict[int, float] = defaultdict(float)
    for b, t, p in zip(found, text, punctuation, strict=True):
        own[b.path] += t * (1 + p) / n[b.path]
    linked = {k: links[k] / chars[k] for k in own}
    # children have larger numbers than their parents: sums go up, the best prefix comes down
    for k in range(size - 1, 0, -1):
        for sums in (n, chars, marks, links):
            sums[paths.parent[k]] += sums[k]
    around = [0.0] * size
    for k in range(size):
        held = chars[k] / n[k] * (1 + marks[k] / n[k]) * (1 - links[k] / chars[k]) if n[k] else 0.0
        around[k] = max(held, around[paths.parent[k]])
    ratios = {k: sqrt(v * (1 - linked[k]) * around[paths.parent[k]]) for k, v in own.items()}
    for b, follower in zip(reversed(found[:-1]), reversed(found[1:]), strict=True):
        if HEADING.match(paths.tag[b.path]) and b.parent == follower.parent:
            ratios[b.path] = max(ratios[b.path], ratios[follower.path])  # a heading goes with what it heads
    return ratios, linked


def weights(found: list[Block], paths: Paths, ratios: dict[int, float]) -> tuple[list[float], list[bool]]:
    """What tags and names make of each path, and whether it is in a box beside the text.

    A box with half of the page's characters and an article inside is taken for a layout name.
    An article or main element counts by its share of the page's value.
    """
    size = len(paths.parent)
    chars, holds = [0] * size, list(paths.main)
    for b in found:
        chars[b.path] += len(b.text)
    for k in range(size - 1, 0, -1):
        chars[paths.parent[k]] += chars[k]
        holds[paths.parent[k]] |= holds[k] and paths.aside[k] < 2
    weight, beside = [1.0] * size, [False] * size
    for k in range(1, size):
        up = paths.parent[k]
        layout = holds[k] and not paths.main[k] and 2 * chars[k] >= chars[0]
        box = paths.aside[k] == 2 and not layout
        beside[k] = beside[up] or box
        weight[k] = weight[up] * (BESIDE if box else MENTIONED if paths.aside[k] else 1.0)
    value = [0.0] * size
    for b in found:
        value[b.path] += len(b.text) * ratios[b.path] * weight[b.path]
    for k in range(size - 1, 0, -1):
        value[paths.parent[k]] += value[k]
    raised = [1.0] * size
    for k in range(1, size):
        share = value[k] / value[0] if paths.main[k] and value[0] else 0.0
        raised[k] = max(raised[paths.parent[k]], MAIN * share * share)
    return [w * r for w, r in zip(weight, raised, strict=True)], beside


def extract(html: str) -> str:
    """The text of the blocks whose path is above the threshold, joined by line ends; empty where none is."""
    found, paths = blocks(html)
    if not found:
        return ""
    ratios, linked = path_ratios(found, paths)
    weight, beside = weights(found, paths, ratios)
    free = [b for b in found if not beside[b.path]]
    level = THRESHOLD * sum(len(b.text) * ratios[b.path] for b in free) / max(1, sum(len(b.text) for b in free))
    chosen = {k for k, v in ratios.items() if free and v * weight[k] >= level and linked[k] < LINKED}
    return "\n".join(b.text for b in found if b.path in chosen)


def main_text(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Kept columns, text and n_chars of every page.

    Null and empty pages, and pages without content, give an empty text. Plain text without tags is
    one block. Unclosed and misnested tags are closed where their parent ends. Rows stay as they are,
    repeated ones too; an empty table gives an empty one. Time grows with the length of a page, however
    deep its tags are. Input columns named `text` or `n_chars` cannot be kept beside the new ones.
    """

    def make():
        def work(rows: list[str]) -> dict[str, object]:
            texts = [extract(h) for h in rows]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_texts(pages, html, make, "text string, n_chars bigint", keep)
