"""Operator 5: main text of HTML pages by composite text density.

A page becomes a tree.  Every node gets a density: characters per tag, adjusted for
the characters and tags inside links; tags that only mark words up count as text.  A
node's sum is the total of its children's densities, and the node with the largest sum
is the centre of the main text.  The smallest density on the path from the body to it
is the threshold: the text grows from the centre to an ancestor where the ancestor
adds children that reach the threshold, from the first to the last such child and
the headings before it.

Scripts, styles, controls, menus, asides and footers never count.  Elements that by tag,
role, class or id are headers, sidebars, notices, adverts, forms or comments are left out
unless they are wrappers: they hold most of the page's text in paragraphs, and no other
paragraph or article of the page shows that the text is elsewhere.  Where such a name may
also be the article's own ("related", "notice"), the element is no centre while there is
another one, and leaves if it is less dense than the threshold or mostly links.  A section
of an article that has a heading of its own and paragraphs, but no links and no controls,
is the article's whatever its name, unless that names adverts, sidebars, notices or
comments.  Names count on containers, not on paragraphs and headings, and not after
words like has- or no-.

One pass over the pages, no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rosterlake.llm.support import text_of

# Elements of HTML by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style noscript template iframe object svg canvas audio video math head title map".split())
CONTROLS = frozenset("button select textarea input nav menu dialog datalist option footer aside".split())
APART = frozenset("header form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored navbar nav navigation menu menus breadcrumb "
    "breadcrumbs footer masthead sidebar cookie cookies consent gdpr newsletter share sharing social comment comments commentlist discussion disqus".split()
)
DOUBTFUL_WORDS = frozenset(
    "promo promotion banner header aside widget widgets related recommended notice notices notification alert popup modal overlay subscribe "
    "subscription signup login reply replies respond form search pagination pager skip skiplink toolbar".split()
)
FOREIGN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored sidebar cookie cookies consent gdpr newsletter "
    "comment comments commentlist discussion disqus notice notices notification reply replies respond".split()
)
#: Elements whose text shows where the page's text is, and elements that only a form has.
WRITTEN = frozenset("p article main pre blockquote".split())
FORM_PARTS = frozenset("form button select textarea input".split())
#: Words after which the next one says what the rest of the page has.
MODIFIERS = frozenset("has have with without no not is in under after before".split())
#: Levels of elements that are kept apart, as in browsers; deeper ones join the last.
DEEPEST = 512
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class Node:
    """apart: 0 part of the page; 1 left out if sparse or mostly links; 2 left out unless it is a wrapper; 3 left out.  foreign: by name never the article's."""

    __slots__ = ("tag", "parts", "apart", "parent", "depth", "chars", "tags", "link_chars", "link_tags", "density", "total", "foreign")

    def __init__(self, tag: str, parent: Node | None, apart: int, foreign: bool = False):
        self.tag, self.parent, self.apart, self.foreign = tag, parent, apart, foreign
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node) and p.apart < 2]

    def linked(self) -> bool:
        return 2 * self.link_chars > self.chars


def names_of(value: str) -> set[str]:
    """The words of a class or id, but for those that a modifier goes before."""
    found = set()
    for name in value.split():
        words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        found.update(w for at, w in enumerate(words) if not MODIFIERS.intersection(words[:at]))
    return found


def set_apart(tag: str, attributes: list[tuple[str, str | None]], in_article: bool) -> int:
    """How far an element is set apart by what it says of itself."""
    if tag in SILENT or tag in CONTROLS:
        return 3
    if tag in APART and not (tag == "header" and in_article):
        return 2
    if tag in ("html", "body", "article", "main"):
        return 0
    most = 0
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value or ""):
            return 2
        if not value:
            continue
        if name == "role" and value.lower() in APART_ROLES:
            most = 2
        if name in ("class", "id") and tag in BLOCK and tag != "p" and tag not in HEADINGS:
            names = names_of(value)
            most = max(most, 2 if names & APART_WORDS else 1 if names & DOUBTFUL_WORDS else 0)
    return most


class TreeBuilder(HTMLParser):
    """Builds the tree, closing what HTML lets an author leave open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, 0)
        self.open: Counter = Counter()
        self.articles = 0
        self.body = False

    def parse_marked_section(self, i, report=1):
        """A section like <![if ...]> is a comment in HTML."""
        return self.parse_bogus_comment(i)

    def _leave(self, node: Node) -> None:
        """Close the elements from the one at hand up to and with node."""
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _close(self, tags: set[str], within: set[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        node, last = self.at, None
        while node.parent is not None and node.tag not in within:
            if node.tag in tags:
                last = node
            node = node.parent
        if last:
            self._leave(last)

    def handle_starttag(self, tag, attrs):
        if tag == "html" or tag == "body" and self.body:
            return
        if tag in BLOCK:
            self._close({"p"}, {"body", "td", "th", "div", "article", "section", "main", "li", "blockquote", "button"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag == "body":
            self.body = True
            while self.at is not self.root:
                self._leave(self.at)
        apart = set_apart(tag, attrs, self.open["article"] + self.open["main"] > 0)
        foreign = bool(apart) and any(v and not FOREIGN_WORDS.isdisjoint(names_of(v)) for k, v in attrs if k in ("class", "id"))
        node = Node(tag, self.at, apart, foreign)
        self.at.parts.append(node)
        if tag not in VOID and node.depth < DEEPEST:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "path", "iframe"):
            self._leave(self.at)

    def handle_endtag(self, tag):
        if tag in ("html", "body") or not self.open[tag]:
            return
        node = self.at
        while node.tag != tag:
            if node.tag in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "tfoot"):
                return
            node = node.parent
        self._leave(node)

    def handle_data(self, data):
        self.at.parts.append(data)


_RAW = re.compile(r"<(?:!--|(script|style|textarea|title)\b)", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "title")}


def without_raw(html: str) -> str:
    """The page without comments and without elements whose content is no markup; one that is left open reaches to the end."""
    out, at = [], 0
    while found := _RAW.search(html, at):
        out.append(html[at : found.start()])
        if found[1]:
            end = _RAW_END[found[1].lower()].search(html, found.end())
            at = end.end() if end else len(html)
        elif html.startswith((">", "->"), found.end()):
            at = html.index(">", found.end()) + 1
        else:
            end = html.find("-->", found.end())
            at = end + 3 if end >= 0 else len(html)
        out.append(" " if found[1] else "")
    out.append(html[at:])
    return "".join(out)


def tree(html: str) -> Node:
    """The page's body, or all of it if it has none.

    A tag that is not closed by the end of the page is left out; the text after its
    first > is read on, or its end is that of the page.  What the parser cannot read
    in an odd page is taken as text without its tags.
    """
    builder, rest = TreeBuilder(), without_raw(html)
    for _ in range(50):
        try:
            builder.feed(rest)
            rest = builder.rawdata
            if not re.match(r"<[a-zA-Z/!?]", rest):
                builder.close()
                rest = ""
        except (AssertionError, ValueError, IndexError):
            rest = builder.rawdata
        if not rest or ">" not in rest:
            break
        builder.rawdata, rest = "", rest.split(">", 1)[1]
    else:
        builder.handle_data(re.sub(r"<[^>]*>?", " ", rest))
    root = builder.root
    return next((p for p in root.parts if isinstance(p, Node) and p.tag == "body"), root)


def _ordered(root: Node) -> list[Node]:
    """The nodes below root that are not left out, parents first."""
    out = [root]
    for node in out:
        out.extend(node.children())
    return out


def measure(root: Node) -> list[Node]:
    """Counts, densities and sums of every node; the nodes, parents first."""
    nodes = _ordered(root)
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.total = 0.0
    for node in reversed(nodes):
        node.chars += sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        if node.tag == "a":
            node.link_chars = node.chars
        if node is not root:
            parent = node.parent
            parent.chars += node.chars
            parent.tags += node.tags + (node.tag in BLOCK or node.tag == "a")
            parent.link_chars += node.link_chars
            parent.link_tags += node.link_tags + (node.tag == "a")
    share = root.link_chars / max(root.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - node.link_chars, 1) * lc + share * c + math.e)  # 1 or more, as its argument is e or more
            node.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 1.3))
    for node in nodes:
        node.total = sum(c.density for c in node.children() if c.tag in BLOCK)
    return nodes


def settle(root: Node) -> None:
    """Keep what is set apart by name but wraps the page's text, or is a section of the article; leave the rest of it out for good."""
    order = [root]
    for node in order:
        order.extend(p for p in node.parts if isinstance(p, Node) and p.apart < 3)
    # Of each node and what is below it: text outside links, text in paragraphs, whether it has links, controls, main and article elements.
    held, told, linked, controls, holds = {}, {}, {}, {}, {}
    for node in reversed(order):
        key = id(node)
        text = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        nodes = [p for p in node.parts if isinstance(p, Node)]
        below = [id(p) for p in nodes if p.apart < 3]
        held[key] = 0 if node.tag == "a" else text + sum(held[i] for i in below)
        told[key] = held[key] if node.tag in WRITTEN else sum(told[i] for i in below)
        linked[key] = node.tag == "a" and text > 0 or any(linked[i] for i in below)
        controls[key] = any(p.tag in FORM_PARTS for p in nodes) or any(controls[i] for i in below)
        holds[key] = {node.tag} & {"main", "article"} | set().union(*(holds[i] for i in below))
    inside = {id(root): False}
    for node in order[1:]:
        inside[id(node)] = inside[id(node.parent)] or node.parent.tag in ("article", "main")
        headed = any(isinstance(p, Node) and p.tag in HEADINGS for p in node.parts)
        if node.apart in (1, 2) and not node.foreign and inside[id(node)] and node.tag in ("section", "div"):
            if headed and told[id(node)] and not linked[id(node)] and not controls[id(node)]:
                node.apart = 0

    def open_below(top: Node) -> tuple[int, set[str]]:
        """Text in paragraphs that is not set apart, and the main and article elements that hold it, below top."""
        text, tags, stack = 0, set(), [top]
        while stack:
            node = stack.pop()
            if node.tag in WRITTEN:
                text += told[id(node)]
                tags |= {node.tag} & {"main", "article"}
            stack.extend(p for p in node.parts if isinstance(p, Node) and not p.apart)
        return text, tags

    text, tags = open_below(root)
    for node in order:
        key = id(node)
        if not node.apart or 2 * held[key] <= held[id(root)] or not (told[key] or holds[key]):
            continue
        if not text or not node.foreign and (holds[key] if not tags else "main" in holds[key] and "main" not in tags):
            node.apart = 0
            more = open_below(node)
            text, tags = text + more[0], tags | more[1]
    for node in order:
        if node.apart == 1 and node.foreign and text and not inside[id(node)]:
            node.apart = 2


def centre(nodes: list[Node]) -> tuple[Node, list[Node | str]]:
    """The node of the main text and those of its parts that belong to it."""
    body = nodes[0]
    doubted: set[int] = set()
    for node in nodes[1:]:
        if node.apart or id(node.parent) in doubted:
            doubted.add(id(node))
    best = max((n for n in nodes if id(n) not in doubted), key=lambda n: n.total)
    if not best.total:
        best = max(nodes, key=lambda n: n.total)
    if not best.total:
        return body, body.parts
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    for node in nodes:
        if node.apart == 1 and (node.density < threshold or node.linked()):
            node.apart = 3

    def dense(part: Node | str, core: Node | None) -> bool:
        if isinstance(part, str) or part.apart > 1 or not part.chars:
            return False
        if part is core or part.tag == "p":
            return True
        return part.density >= threshold and not part.linked()

    def span(node: Node, core: Node | None) -> tuple[int, int]:
        """The range of a node's parts from the first to the last dense one, with the headings before."""
        at = [i for i, p in enumerate(node.parts) if dense(p, core)]
        if not at:
            return 0, len(node.parts)
        first, last = at[0], at[-1] + 1
        before = first - 1
        while before >= 0 and (isinstance(node.parts[before], str) and not node.parts[before].strip() or isinstance(node.parts[before], Node) and (node.parts[before].tag in HEADINGS or not node.parts[before].chars or node.parts[before].apart > 1)):
            if isinstance(node.parts[before], Node) and node.parts[before].tag in HEADINGS:
                first = before
            before -= 1
        return first, last

    chosen, parts = best, best.parts
    if best is body:
        first, last = span(body, None)
        parts = body.parts[first:last]
    for inner, parent in zip(path, path[1:]):
        first, last = span(parent, inner)
        added = [p for p in parent.parts[first:last] if isinstance(p, Node) and p is not inner and p.apart < 2 and p.chars]
        if inner.tag in ("article", "main") or not added:
            if inner.tag not in ("article", "main") and parent is not body and chosen is inner:
                continue
            break
        chosen, parts = parent, parent.parts[first:last]
    return chosen, parts


def blocks(node: Node, parts: list[Node | str]) -> list[str]:
    """The text of a node's parts by block, white space turned into single spaces."""
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(buffer).split()):
            out.append(text)
        buffer.clear()

    stack: list[tuple[Node | str, bool]] = [(p, False) for p in reversed(parts)]
    while stack:
        part, left = stack.pop()
        if isinstance(part, str):
            buffer.append(part)
        elif left:
            flush()
        elif part.apart > 1:
            continue
        elif part.tag == "br":
            buffer.append(" ")
        else:
            if part.tag in BLOCK:
                flush()
                stack.append((part, True))
            stack.extend((p, False) for p in reversed(part.parts))
    flush()
    return out


def main_text(html: str) -> str:
    """The main text of one page; empty if it has none."""
    body = tree(html)
    settle(body)
    return " ".join(blocks(*centre(measure(body))))


def extract(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The key columns and main_text of every page.

    A null page counts as empty and has an empty text; a page without text too.  Pages of
    any length are read whole, in time in proportion to their length; no page, however
    malformed, ends the job (tree says what is done with it).
    Repeated rows are each extracted; an empty table gives an empty result; columns
    other than keys are left out.
    """
    schema = T.StructType([*(pages.schema[k] for k in keys), T.StructField("main_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(len(keys))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], texts], names=schema.names)

    return pages.select(*keys, text_of(html).alias("html")).mapInArrow(run, schema)
