"""Main-text extraction by tag-path ratios.

Every text node has a path of tags (with class) from the root. Text length and punctuation are aggregated for each path,
divided by its number of texts, smoothed over neighbouring paths in page order, fused by multiplication, and scaled by
what the path's structure says (article elements for, navigation, adverts, forms, comments and the like against); paths
from a threshold on (a share of the standard deviation) are content paths. The characters of content paths choose the
node that holds the main text: the deepest container with most of them, or the article element around it.

Inside of it every text node is judged. Those that structure speaks against go and the rest of their block stays. A block
stays if one of its texts is on a content path. Below the threshold only the short lines that go with content stay: headings,
paragraphs, list items and cells, if the container around them has content of its own (or is the holder); other boxes below
the threshold go, inside an article, too. A short line that is mostly link goes, unless it is a heading. A word of a compound class on a line
element (``related-text`` on a paragraph) is weak evidence, which length and punctuation without links outvote. A page whose
classes say nothing is decided by its ratios alone, and one that is wrapped in a class that speaks against it as a whole
isn't lost, as ratios only compare.

One page is one row and its text goes through one call, in time and memory proportional to the page; nothing is shuffled.

Defined cases: NULL or empty html gives the empty text; broken markup is read as far as it goes (unclosed elements end
with their parent, a tag cut off at the end is dropped); a page without markup is one block; blocks with equal text are
all kept; extra columns pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("noscript script style template".split())
RAW = frozenset("iframe noembed noframes script style template textarea title xmp".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())
ARTICLE = frozenset(("article", "main"))
# Elements that hold a line and no page: they don't become the node that holds the main text.
LINES = frozenset("address blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre table tbody tfoot thead tr ul".split())
# Structure that speaks against article text: elements, words of class or id, roles.
SKIP_TAGS = frozenset("aside button canvas dialog footer form head iframe input menu nav noscript object script select style svg template textarea".split())
SKIP_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# Elements that are a line of text each.
LINE_TAGS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
PUNCTUATION = ".,;:!?…。，、；：！？"

#: Share of the standard deviation of the fused ratios from which a path is content, and weights of the smoothing.
THRESHOLD = 0.4
SMOOTHING = (0.25, 0.5, 0.25)
#: What structure scales a path's ratio by: inside an article element, where it speaks against the path, and where weakly.
FOR, AGAINST, WEAK = 4.0, 0.02, 0.5
#: Characters and punctuation marks from which a block without many links outvotes weak evidence.
LONG, MARKS = 40, 1
#: Share of the content that a container must have to hold the main text.
MASS = 0.75

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Node:
    """An element. ``path`` is a number: equal paths have equal numbers on a page."""

    __slots__ = ("tag", "name", "parent", "against", "weak", "in_article", "mass", "inside", "number", "path", "open_p", "shown", "rich", "line", "container")

    def __init__(self, tag: str, attributes: str, parent: Node | None, number: int, paths: dict[tuple[int, str], int]):
        self.tag, self.parent, self.number = tag, parent, number
        self.in_article = tag in ARTICLE or bool(parent and parent.in_article)
        self.mass, self.inside, self.shown, self.rich = 0.0, False, False, False
        self.name, found = tag, {}
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            found.setdefault(m[1].lower(), (m[2] or "").strip("\"'").lower())
        if "class" in found:
            self.name = f"{tag}.{'.'.join(found['class'].split())}"
        self.against = bool(parent and parent.against) or tag in SKIP_TAGS or (tag == "header" and not self.in_article)
        self.weak = bool(parent and parent.weak)
        # the nearest element that isn't inline, which makes the block, and the nearest that holds more than a line
        self.line = parent.line if parent and tag in INLINE else self
        self.container = parent.container if parent and (tag in INLINE or tag in LINES or tag in LINE_TAGS) else self
        if not self.against and found and tag not in ("html", "body", "article", "main"):
            named = f"{found.get('class', '')} {found.get('id', '')}"
            words = set(_WORDS.findall(named))
            telling = bool(words & SKIP_WORDS)
            if telling and tag in LINE_TAGS and not set(named.split()) & SKIP_WORDS:
                self.weak, telling = True, False
            self.against = telling or ("header" in words and not self.in_article) or found.get("role") in SKIP_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
        self.path = paths.setdefault((parent.path if parent else -1, self.name), len(paths))
        self.open_p = self if tag == "p" else parent.open_p if parent and tag not in SCOPE else None

    def scale(self) -> float:
        return (FOR if self.in_article else 1.0) * (AGAINST if self.against else WEAK if self.weak else 1.0)

    def names(self) -> str:
        out, node = [], self
        while node is not None:
            out.append(node.name)
            node = node.parent
        return "/".join(reversed(out))


class Block:
    """``parts`` are (node, decoded text, its characters without white space, those in links, punctuation marks)."""

    __slots__ = ("parts", "node", "texts", "size")

    def __init__(self, node: Node):
        self.node, self.parts, self.texts, self.size = node, [], [], 0


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of visible text, in order."""
    paths: dict[tuple[int, str], int] = {}
    root = Node("#page", "", None, 0, paths)
    node, count, links, blocks, block = root, 0, 0, [], None
    opened: Counter[str] = Counter()

    def shut(last: Node) -> None:
        """Close the open elements up to and with ``last``."""
        nonlocal node, links
        while node is not last.parent:
            links -= node.tag == "a"
            opened[node.tag] -= 1
            node = node.parent

    def text(raw: str) -> None:
        nonlocal block
        if node.tag in UNSEEN or not raw:
            return
        if block is None:
            block = Block(node)
            blocks.append(block)
        decoded = html.unescape(raw) if "&" in raw else raw
        n = len("".join(decoded.split()))
        marks = sum(map(decoded.count, PUNCTUATION)) if n else 0
        block.parts.append((node, decoded, n, n if links else 0, marks))
        if n:
            block.texts.append((node, n, marks))
            block.size += n

    at = 0
    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in INLINE and tag not in UNSEEN:
            block = None
        if m[1]:  # an end tag closes up to its element, if that is open
            if opened[tag] > 0:
                last = node
                while last.tag != tag:
                    last = last.parent
                shut(last)
            continue
        if tag == "br" and block is not None:
            block.parts.append((node, " ", 0, 0, 0))
        if tag in CLOSES_P:
            if node.open_p is not None:
                shut(node.open_p)
        elif (closes := SIBLINGS.get(tag)) and any(opened[x] > 0 for x in closes):
            last = node
            while last.parent is not None and last.tag not in closes and (last.tag not in SCOPE or (tag in ("td", "th", "tr") and last.tag in ("td", "th"))):
                last = last.parent
            if last.tag in closes:
                shut(last)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else len(page)
        elif tag not in VOID:
            count += 1
            node = Node(tag, m[3], node, count, paths)
            opened[tag] += 1
            links += tag == "a"
    text(page[at:])
    return blocks


def content(blocks: list[Block]) -> dict[int, Node]:
    """Numbers of the paths whose smoothed, fused and scaled ratios reach the threshold, each with a node of that path."""
    chars: dict[int, list] = {}
    for b in blocks:
        for node, n, marks in b.texts:
            got = chars.setdefault(node.path, [0, 0, 0, node])
            got[0] += n
            got[1] += marks
            got[2] += 1
    if not chars:
        return {}
    found = list(chars.values())  # page order of their first text

    def smooth(x: list[float]) -> list[float]:
        padded = [x[0], *x, x[-1]]
        return [sum(w * padded[i + k] for k, w in enumerate(SMOOTHING)) for i in range(len(x))]

    length, marks = (smooth([f[k] / f[2] for f in found]) for k in (0, 1))
    fused = [a * (1 + b) * f[3].scale() for a, b, f in zip(length, marks, found, strict=True)]
    mean = sum(fused) / len(fused)
    limit = THRESHOLD * (sum((x - mean) ** 2 for x in fused) / len(fused)) ** 0.5
    return {p: f[3] for (p, f), x in zip(chars.items(), fused, strict=True) if x >= limit}


def content_paths(blocks: list[Block]) -> set[str]:
    """The content paths by their names."""
    return {node.names() for node in content(blocks).values()}


def holder_of(blocks: list[Block], chosen: dict[int, Node]) -> Node:
    """The node that holds the main text; marks the nodes inside of it."""
    seen: list[Node] = []
    total = 0.0
    for b in blocks:
        for node, n, _ in b.texts:
            if node.path in chosen:
                node.mass += n * node.scale()
                total += n * node.scale()
            while node is not None and not node.shown:
                node.shown = True
                seen.append(node)
                node = node.parent
    seen.sort(key=lambda x: x.number)  # parents come before their children
    for node in reversed(seen):
        if node.parent is not None:
            node.parent.mass += node.mass
    holder = seen[0]
    for node in seen:  # at most one child of a holder has so much
        if node.parent is holder and node.mass >= MASS * total:
            holder = node
    while holder.parent is not None and (holder.tag in INLINE or holder.tag in LINES):
        holder = holder.parent
    around = holder
    while around is not None and around.tag not in ARTICLE:
        around = around.parent
    holder = around or holder
    for node in seen:
        node.inside = node is holder or bool(node.parent and node.parent.inside)
    return holder


def extract(page: str | None) -> str:
    """The main text: blocks joined by line feeds, white space inside a block as one space."""
    blocks = [b for b in blocks_of(page) if b.size] if page else []
    if not blocks:
        return ""
    chosen = content(blocks)
    holder = holder_of(blocks, chosen)
    for b in blocks:
        for node, _, _ in b.texts:
            if node.path in chosen:
                node.container.rich = True
    lines = (_SPACE.sub(" ", "".join(kept(b, chosen, holder))).strip("\x20\t\n\r\x0b\x0c") for b in blocks)
    return "\n".join(x for x in lines if x)


def kept(block: Block, chosen: dict[int, Node], holder: Node) -> list[str]:
    """The parts of a block that belong to the main text."""
    mine = [p for p in block.parts if p[0].inside and (p[0].path in chosen or not p[0].against)]
    size, linked, marks = (sum(p[k] for p in mine) for k in (2, 3, 4))
    if not size:
        return []
    own = next(p[0] for p in mine if p[2])
    told = size >= LONG and marks >= MARKS
    heavy = 2 * linked > size and own.line.tag not in HEADINGS
    if own.weak:
        stays = told and not heavy
    elif any(p[0].path in chosen for p in mine if p[2]):
        stays = told or not heavy  # smoothing lifts a link beside a long paragraph
    else:
        stays = not heavy and own.line.tag in LINE_TAGS and (own.container.rich or own.container is holder)
    return [p[1] for p in mine] if stays else []


def main_text(page: Column) -> Column:
    """Main text of an html column; never NULL."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([extract(x if isinstance(x, str) else None) for x in pages], dtype=object)

    return extracted(page)
