"""Main text of HTML pages by tree scoring.

The page is parsed into a tree. Every paragraph passes points to its ancestors, for its length and its
commas: all to its parent, half to the grandparent, a quarter and so on further up, so that one pass over the tree
adds them up, however deep it is. A paragraph is any block
without blocks inside, be it a p or a div, and bare text between blocks or double line breaks, whose parent is the element
it stands in. Points of a paragraph and of a container are discounted by their link density, the share of characters that lie in links. The
container with the most points is the main text, and with it those siblings that look like parts of it: siblings with a
fifth of its points; headings, paragraphs, lists and tables of any length with few links; and all else with few
links that lies between two kept siblings. A heading with none of these after it goes. What holds menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or reader comments is left out, by element or by the words of its class and id (a marked
element that holds the page's h1 or main element is a wrapper and stays). A best container inside an article or
main element stands for the whole of it; of several article elements, the one with the best container.

Inside an article or main element words of class and id are weaker evidence, since they also name an article's own sections
(``id="related-work"``). There an id, or a class of several words, that has none but the ``WEAK`` words drops an element
only if a quarter of it is links, a form is inside or it holds no paragraph; an id on a heading or a paragraph never
does, a class only by other words than these. An article's own header stays if it holds a heading.

Text is then cut into blocks at block elements; white space inside a block becomes one space.

Defined cases: NULL, empty or text-free html gives the empty text; a page without paragraphs falls back to its body;
unclosed and stray tags are repaired the way browsers do for paragraphs, list items and table cells; repeated
rows give repeated rows; an empty table gives an empty result; other columns are dropped unless carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake.llm.tables import slices

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option
p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("""aside audio button canvas dialog footer form head header iframe input label math menu nav noscript
object option script select style svg template textarea title video""".split())
PARAGRAPHS = frozenset("p pre td blockquote dd li h2 h3 h4".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Siblings of the best container that are text by their element, however short.
TEXTUAL = PARAGRAPHS | HEADINGS | frozenset("ul ol dl table figure".split())
MANY_LINKS = 0.25
LONG_TEXT = 80
#: Words of a class, id or role that mark what is not the article.
NOT_ARTICLE = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment
comments comentarios commentaires consent cookie cookies disqus discussion footer gdpr header login masthead menu
menus modal nav navbar navigation newsletter notice notices notification outbrain pagination pager paywall popup
promo promoted promotion recommended related replies reply respond search share sharing shoutbox sidebar sidebars signup
social sponsor sponsored subscribe subscription taboola toolbar tooltip widget widgets complementary
contentinfo alert alertdialog""".split())
#: Those of them that name sections of articles too.
WEAK = frozenset("""ad ads alert banner discussion login notice notices notification promotion related replies reply
respond search share sharing social widget widgets""".split())
#: An open element that the start of another one closes.
CLOSED_BY = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
             "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
             "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "option": frozenset({"option"})}
#: Elements whose inside a start tag cannot close from.
SCOPES = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}),
          "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"}),
          "p": frozenset({"table", "td", "th", "button", "object"}), "option": frozenset({"select"})}

_NAME_WORDS = regex.compile(r"[\p{Ll}\p{Lu}][\p{Ll}]*|\p{Lu}+")
_COMMAS = regex.compile(r"[,،、，]")


class Node:
    __slots__ = ("tag", "parent", "children", "out", "weak", "within", "foreign", "points", "chars", "linked", "order")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.out, self.weak = tag, parent, False, False
        # inside an article or main element; inside a drawing or formula
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))
        self.foreign = parent is not None and (parent.foreign or parent.tag in ("svg", "math"))
        self.children: list[Node | str] = []
        self.points, self.chars, self.linked, self.order = 0.0, 0, 0, 0


class Tree(HTMLParser):
    """Builds nodes; text is kept as strings among a node's children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.nodes = [self.root]
        self.open: Counter = Counter()

    def handle_starttag(self, tag: str, attrs) -> None:
        self._close_open(tag)
        node = Node(tag, self.at)
        mark = _mark(attrs, node)
        node.out, node.weak = tag in LEFT_OUT or mark == SURE, mark == PERHAPS
        node.order = len(self.nodes)
        self.at.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        # in drawings and formulas a tag can close itself; in html the slash means nothing
        if self.at.order == len(self.nodes) - 1 and (tag in ("svg", "math") or self.at.foreign):
            self._leave(self.at)

    def _leave(self, node: Node) -> None:
        """Close a node and all that is open inside it."""
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[node.tag] -= 1
        self.at = node.parent

    def _close_open(self, tag: str) -> None:
        for open_tag, closers in CLOSED_BY.items():
            if tag not in closers or not self.open[open_tag]:
                continue
            node = self.at
            while node.parent is not None and node.tag != open_tag and node.tag not in SCOPES[open_tag] \
                    and not (node.tag in BLOCKS and open_tag == "p"):
                node = node.parent
            if node.tag == open_tag:
                self._leave(node)

    def unmark_wrappers(self) -> None:
        """Elements left out for their class or id alone stay if the page's h1 or main element is inside; headers of articles
        stay if a heading is."""
        holds, titles = set(), set()
        for node in reversed(self.nodes[1:]):
            if node.tag in ("h1", "main") or node.order in holds:
                holds.add(node.parent.order)
            if node.tag in HEADINGS or node.order in titles:
                titles.add(node.parent.order)
            if node.order in holds:
                node.out, node.weak = node.out and node.tag in LEFT_OUT, False
            if node.tag == "header" and node.within and node.order in titles:
                node.out = False

    def weigh_marks(self) -> None:
        """Decide the weak marks, by links, forms and paragraphs inside; measures nodes on the way."""
        _measure(self)
        forms, prose = set(), set()
        for node in reversed(self.nodes[1:]):
            if node.tag in ("form", "input", "textarea", "select") or node.order in forms:
                forms.add(node.parent.order)
            if node.chars and (node.tag == "p" or node.chars >= LONG_TEXT and node.tag in PARAGRAPHS) or node.order in prose:
                prose.add(node.parent.order)
        for node in self.nodes:
            if node.weak and node.tag not in PARAGRAPHS | HEADINGS and (
                    node.order in forms or node.order not in prose or node.linked >= MANY_LINKS * node.chars):
                node.out = True

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag in BLOCKS and tag not in BLOCKS:
                return
            node = node.parent
        if node.parent is not None:
            self._leave(node)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


NO, PERHAPS, SURE = range(3)


def _mark(attrs, node: Node) -> int:
    """Whether the element's own attributes say that it is not part of the article."""
    tag, found = node.tag, NO
    if tag in ("html", "body", "main") or tag == "article" and not node.within:
        return NO
    text = tag in HEADINGS or tag in ("p", "li", "td")
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return SURE
        if name == "style" and value and regex.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return SURE
        if name not in ("class", "id", "role") or not value or (name == "id" and tag in HEADINGS):
            continue
        for one in value.split():
            words = [w.lower() for w in _NAME_WORDS.findall(one)]
            marks = [w for w in words if w in NOT_ARTICLE]
            if not marks:
                continue
            if not node.within:
                return SURE
            sure = any(w not in WEAK for w in marks) and (name != "id" or not text)
            if sure or (name != "id" and len(words) == 1 and not text):
                return SURE
            found = PERHAPS if not text else found
    return found


def _measure(tree: Tree) -> None:
    """Characters and linked characters of every node, without what is left out, from the leaves up."""
    for node in reversed(tree.nodes):
        if node.out:
            node.chars = node.linked = 0
            continue
        own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        inner = [c for c in node.children if isinstance(c, Node)]
        node.chars = own + sum(c.chars for c in inner)
        node.linked = node.chars if node.tag == "a" else sum(c.linked for c in inner)


def _holders(tree: Tree) -> list[bool]:
    """For every node, whether a block that is not left out lies inside it."""
    holds = [False] * len(tree.nodes)
    for node in reversed(tree.nodes):
        if node.parent is not None and not node.out and (node.tag in BLOCKS or holds[node.order]):
            holds[node.parent.order] = True
    return holds


def _runs(node: Node, holds: list[bool]) -> list[str]:
    """The texts directly in a node, cut at the blocks inside it and at double line breaks."""
    found: list[str] = []
    words: list[str] = []
    breaks = 0

    def end_run() -> None:
        text = " ".join("".join(words).split())
        if text:
            found.append(text)
        words.clear()

    todo = node.children[::-1]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            words.append(item)
            breaks = 0 if item.strip() else breaks
        elif item.out:
            continue
        elif item.tag == "br":
            words.append(" ")
            breaks += 1
            if breaks == 2:
                end_run()
        elif item.tag in BLOCKS or holds[item.order]:
            end_run()
        else:
            todo.extend(reversed(item.children))
    end_run()
    return found


def _score(tree: Tree, holds: list[bool]) -> dict[int, float]:
    """Discounted points of every container."""
    hidden = [False] * len(tree.nodes)
    for node in tree.nodes[1:]:
        hidden[node.order] = node.out or hidden[node.parent.order]
        if hidden[node.order] or not node.chars or not (node.tag in BLOCKS or holds[node.order]):
            continue
        runs = _runs(node, holds)
        own = holds[node.order] or (len(runs) > 1 and node.tag not in PARAGRAPHS)
        points = sum(1 + len(_COMMAS.findall(t)) + min(3.0, len(t) / 100) for t in (runs if own else [" ".join(runs)]) if t)
        points *= 1 - node.linked / node.chars
        (node if own else node.parent).points += points
    # a node's points are those passed to it and half of what its children have
    for node in reversed(tree.nodes[1:]):
        node.parent.points += node.points / 2
    tree.root.points = 0.0
    return {n.order: n.points * (1 - n.linked / n.chars) for n in tree.nodes if n.points and n.chars}


def _enclosing(node: Node) -> Node | None:
    """The nearest article or main element around a node."""
    up = node.parent
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    return up


def blocks(nodes: list[Node | str]) -> list[str]:
    """The text blocks below some nodes, in page order, each with single spaces."""
    found: list[str] = []
    words: list[str] = []

    def end_block() -> None:
        text = " ".join("".join(words).split())
        if text:
            found.append(text)
        words.clear()

    todo: list[tuple[Node | str | None, bool]] = [(n, False) for n in reversed(nodes)]
    while todo:
        item, closing = todo.pop()
        if isinstance(item, str):
            words.append(item)
        elif closing:
            end_block()
        elif not item.out:
            if item.tag in ("br", "wbr", "img"):
                words.append(" ")
            if item.tag in BLOCKS or item.tag == "#root":
                end_block()
                todo.append((item, True))
            todo.extend((c, False) for c in reversed(item.children))
    end_block()
    return found


def main_text(html: str | None) -> str:
    """The article of a page: blocks of the best container and its like siblings."""
    if not html or not html.strip():
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    tree.unmark_wrappers()
    tree.weigh_marks()
    _measure(tree)
    scores = _score(tree, _holders(tree))
    if not scores:
        return "\n".join(blocks([tree.root]))
    best = min(scores, key=lambda k: (-scores[k], k))
    top = tree.nodes[best]
    while (whole := _enclosing(top)) is not None:
        top = whole
    if top.tag in ("article", "main"):
        return "\n".join(blocks([top]))
    return "\n".join(blocks(_with_siblings(tree, top, scores)))


def _few_links(item: Node | str) -> bool:
    if isinstance(item, str):
        return bool(item.strip())
    return not item.out and item.chars > 0 and item.linked / item.chars < MANY_LINKS


def _with_siblings(tree: Tree, top: Node, scores: dict[int, float]) -> list[Node | str]:
    """The best container and what beside it is part of the article, in page order."""
    beside = top.parent.children if top.parent else [top]
    titled = set()  # what holds an h1
    for node in reversed(tree.nodes):
        if node.parent is not None and not node.out and (node.tag == "h1" or node.order in titled):
            titled.add(node.parent.order)
    limit = scores[top.order] / 5
    sure = [i for i, x in enumerate(beside) if isinstance(x, Node) and not x.out and (
        x is top or scores.get(x.order, 0) >= limit or (_few_links(x) and (x.tag in TEXTUAL or x.order in titled)))]
    last = max(i for i in sure if beside[i].tag not in HEADINGS)
    whole = {i for i in sure if i <= last}
    return [x for i, x in enumerate(beside) if i in whole or (sure[0] < i < last and _few_links(x))]


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, text) for every page."""
    names = [id_col, *carry]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in names] + [T.StructField("text", T.StringType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for rows in slices(batch, "_html"):
                texts = [main_text(h) for h in rows.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(names))), pa.array(texts, pa.string())],
                                                 schema.names)

    rows = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], F.col(html_col).alias("_html"))
    return rows.mapInArrow(run, schema)
