"""Main text of HTML pages by composite text density.

A page becomes a tree of elements. Scripts, styles, navigation, headers,
footers, asides, forms, adverts, notices and reader comments are left out by
their element, role or class names. On what remains every node gets its
composite density (characters per tag, adjusted for link characters and link
tags); a node's density sum adds its children's densities. The node with the
largest sum leads: the smallest density on its path from the body is the
threshold, and every subtree that reaches it gives its maximum-sum node. If the
leading node lies in an article or main element, all articles beside it (or the
main element) are chosen instead, and the threshold tells which of them, and
which parts inside, are lists of links and left out. Text of the chosen nodes
is returned block by block.

Pages are independent of each other: one narrow pass, a page at a time."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of the article.
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option input textarea "
                    "iframe object embed svg canvas audio video map dialog menu datalist".split())
#: Elements that flow inside a block; every other element starts a block of its own.
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark meter nobr "
                   "output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a start tag closes when they are open in the same container.
_P = frozenset(["p"])
_CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
           "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
           "thead": frozenset(["tr", "td", "th", "thead", "tbody"]), "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]),
           "tfoot": frozenset(["tr", "td", "th", "thead", "tbody"]), "option": frozenset(["option"])}
_SCOPE = {"li": frozenset(["ul", "ol"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
_TABLE = frozenset(["table"])
#: Words of a class, id or role that mark a part as not belonging to the article.
NOISE = frozenset("""ad ads advert adverts advertisement advertisements advertising adbox adslot adsense banner banners sponsor
sponsored promo promotion nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager sidebar rail widget widgets
header footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications announcement alert
popup modal overlay newsletter subscribe subscription signup login share sharing social comments comment commentlist disqus
respond replies reply related recommended recommendations teaser outbrain taboola copyright legal disclaimer banner contentinfo
complementary search searchform skip form forms""".split())
#: Those of them that no element inside the part speaks against.
COMMENTS = frozenset("comments comment commentlist disqus respond replies reply".split())
#: Those of them that are subjects of texts, too: beside a word that is neither noise nor a ``PLAIN`` one they name what a
#: part is about ("related-work", "legal-history", "search-results").
SUBJECTS = frozenset("""related legal search copyright disclaimer share sharing social recommended login promotion rail menu form
forms notification notifications subscription alert banner""".split())
#: Words of names that say how a part looks or where it stands, not what it is about.
PLAIN = frozenset("""a area article articles aside bar bars block body bottom box btn button buttons card cards col column columns
container content contents div entry field fields flex footer global grid group header heading icon icons id img image inner
inside item items js l layout left line link links list lists local m main module modules navbar news next on outer page pages
panel part parts popular post posts prev primary r read region right row s secondary section sections site slot small sm md lg
stories story sub tab tabs text title toggle top ul unit view views web wide wrap wrapper x xl xs""".split())
#: Words that, in the same name, turn a header into the article's own.
ARTICLE = frozenset("article content main post entry story body".split())
#: Words that make a name speak of something else than the part itself ("page-with-sidebar").
ABOUT = frozenset("with has have no without is".split())
_CENTRE = frozenset(["article", "main", "h1"])
_FORMS = frozenset(["form", "forms"])
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
#: Elements that can stand in the head; any other start tag ends it.
_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template".split())
#: Blocks that are parts of an article, never all of it.
_PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr td th tbody thead blockquote pre figure figcaption".split())


class Node:
    __slots__ = ("tag", "names", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total",
                 "centre", "size", "linked", "best")

    def __init__(self, tag: str, names: str, parent: "Node | None"):
        self.tag, self.names, self.parent = tag, names, parent
        self.children: list = []  # nodes and strings


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", "", None)
        self.open: Counter = Counter()  # elements on the path to the current one, by tag

    def _leave_to(self, node):
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _close_head(self, tag):
        """An omitted ``</head>``; an omitted ``<body>`` begins with the element or text that ends the head."""
        self._leave_to(next(a for a in _ancestors(self.at) if a.tag == "head").parent)
        if tag not in ("body", "frameset") and not self.open["body"]:
            self.handle_starttag("body", [])

    def _close_p(self):
        at = self.at if self.open["p"] else None
        while at is not None and at.tag not in ("#root", "table", "td", "th", "button", "object", "caption"):
            if at.tag == "p":
                self._leave_to(at.parent)
                return
            at = at.parent

    def handle_starttag(self, tag, attrs):
        if self.open["head"] and (tag == "body" or tag not in _HEAD and not (self.open["noscript"] or self.open["template"])):
            self._close_head(tag)
        if tag in ("html", "body") and self.open[tag]:
            return
        if tag not in INLINE:
            self._close_p()
        closes = _CLOSES.get(tag)
        if closes and any(self.open[t] for t in closes):
            scope, at, found = _SCOPE.get(tag, _TABLE), self.at, None
            while at is not None and at.tag not in scope:
                if at.tag in closes:
                    found = at
                at = at.parent
            if found is not None:
                self._leave_to(found.parent)
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
        if any(k == "hidden" or (k == "aria-hidden" and v == "true") or
               (k == "style" and v and "display:none" in v.replace(" ", "").lower()) for k, v in attrs):
            names += " hidden-part"
        node = Node(tag, names, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        at = self.at
        if not self.open[tag]:
            return
        while at is not None and at.tag != tag:
            # an inline end tag does not close the block it stands in
            if tag in INLINE and at.tag not in INLINE:
                return
            at = at.parent
        if at is not None and at.parent is not None:
            self._leave_to(at.parent)

    def handle_data(self, data):
        if self.at.tag == "head" and data.strip():
            self._close_head("#text")
        self.at.children.append(data)


def _ancestors(node):
    while node is not None:
        yield node
        node = node.parent


def parse(html: str) -> Node:
    builder = _Builder()
    try:
        builder.feed(html)
        builder.close()
    except AssertionError:  # the library's parser gives up on some broken declarations: keep what it has
        pass
    return builder.root


def weigh(root: Node) -> None:
    """For every node, in one pass: whether an element of ``_CENTRE`` lies below it, the
    characters below it (without those of elements that are always left out), and those of them in links."""
    for node in _post_order(root):
        node.centre, node.size, node.linked = False, 0, 0
        below = [c for c in node.children if not isinstance(c, str)]
        node.centre = any(c.centre or c.tag in _CENTRE for c in below)
        if node.tag not in DROPPED or node.tag in ("form", "button"):
            node.size = sum(len("".join(c.split())) for c in node.children if isinstance(c, str)) + sum(c.size for c in below)
            node.linked = node.size if node.tag == "a" else sum(c.linked for c in below)


def is_noise(node: Node, in_article: bool, most: bool = False) -> bool:
    """True for a part that does not belong to the article's text: by its
    element, or by a name that says so. A name does not condemn a part that
    holds the article, a main element or a first heading, unless it speaks of
    reader comments. Inside the article (or of a section) it does not condemn a part that is about
    something of that name, as other words in it tell, unless most of the part is links. A form that holds
    one of those, or ``most`` of the
    page's text, is judged like a plain div; a button in running text is a part of it."""
    if node.tag == "form":
        if not most and not node.centre:
            return True
    elif node.tag == "button" and node.parent.tag in _PARTS and any(isinstance(c, str) and c.strip() for c in node.parent.children):
        pass
    elif node.tag in DROPPED:
        return True
    if node.tag == "header" and not in_article:
        return True
    if not node.names or node.tag in ("html", "body", "main"):
        return False
    hits = set()
    for name in node.names.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words >= {"hidden", "part"}:
            return True
        if words & ABOUT:
            continue
        hit = words & NOISE - (_FORMS if node.tag == "form" else frozenset())
        if hit == {"header"} and (words & ARTICLE or in_article and words == hit):
            continue
        if hit and hit <= SUBJECTS and words - NOISE - PLAIN and (in_article or node.tag == "section") and 3 * node.linked < node.size:
            continue
        hits |= hit
    if not hits:
        return False
    return bool(hits & COMMENTS) or not (node.tag == "article" and hits <= {"header", "search"} or node.centre)


def prune(root: Node) -> None:
    """Remove noise parts from the tree, in place."""
    weigh(root)
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not is_noise(c, inside, 2 * c.size > root.size)]
        stack.extend((c, inside) for c in node.children if not isinstance(c, str))


def _post_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str))
    return out[::-1]


def measure(body: Node) -> None:
    """Characters, tags, link characters and link tags of every subtree, and
    from them composite densities and density sums. The logarithm's base is
    moved by a factor e, which keeps it above 1 on pages without a link; text
    that stands directly in a node counts in its sum like a child of density
    characters per tag."""
    nodes = _post_order(body)
    for node in nodes:
        node.chars = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        below = [c for c in node.children if not isinstance(c, str)]
        node.chars += sum(c.chars for c in below)
        node.tags = sum(c.tags + 1 for c in below)
        node.centre = any(c.centre or c.tag in _CENTRE for c in below)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
        else:
            node.link_chars = sum(c.link_chars for c in below)
            node.link_tags = sum(c.link_tags + (c.tag == "a") for c in below)
    whole = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(1, c - lc) * lc + whole * c + math.e)
            node.density = c / t * max(0.0, math.log(max(1e-9, c / max(1, lc) * t / lt)) / (1 + math.log(base)))
        node.total = sum(x.density for x in node.children if not isinstance(x, str))
        if any(isinstance(x, str) and x.strip() for x in node.children):
            node.total += sum(len(x.strip()) for x in node.children if isinstance(x, str)) / t
        node.best = node
        for x in reversed(node.children):
            if not isinstance(x, str) and x.best.total > node.best.total:
                node.best = x.best


def select(body: Node) -> list[Node]:
    """Content nodes in page order; none for a body without text."""
    measure(body)
    if not body.chars:
        return []
    best = body.best
    # headings and paragraphs beside a single chosen block belong to the same container
    while best is not body and (best.tag in INLINE or best.tag in _PARTS):
        best = best.parent
    threshold = min(n.density for n in _ancestors_to(best, body))
    marked = _marked(best, body)
    if marked:  # the author has marked where the article begins and ends: the threshold judges what stands inside
        found = [n for n in marked if n.chars and not _is_links(n, threshold)]
        for n in found:
            _drop_links(n, threshold)
        return found
    chosen: list[Node] = []
    stack = [(body, best, set(_ancestors_to(best, body)))]
    while stack:
        node, top, path = stack.pop()
        if node is top:
            chosen.append(node)
            continue
        for c in reversed(node.children):
            if isinstance(c, str):
                continue
            if c in path:
                stack.append((c, top, path))
            elif c.density >= threshold and c.chars:
                stack.append((c, c.best, set(_ancestors_to(c.best, c))))
            elif c.chars:
                stack.append((c, None, set()))
    return chosen


def _marked(best: Node, body: Node) -> list[Node]:
    """The outermost articles around and beside ``best``, all of those in its
    main element (in the body without one), or the main element itself if
    ``best`` lies in no article; none without such an element."""
    path = list(_ancestors_to(best, body))
    main = next((a for a in reversed(path) if a.tag == "main"), None)
    if all(a.tag != "article" for a in path):
        return [main] if main is not None else []
    outer = next(a for a in reversed(path) if a.tag == "article")
    scope = main if main is not None and any(a is main for a in _ancestors_to(outer, body)) else body
    found, stack = [], [scope]
    while stack:
        node = stack.pop()
        if node.tag == "article":
            found.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return found


def _is_links(node: Node, threshold: float) -> bool:
    """True for a list of links: below the threshold, several links, and most of the text in them."""
    return node.density < threshold and node.link_tags > 1 and 2 * node.link_chars > node.chars


def _drop_links(root: Node, threshold: float) -> None:
    """Remove lists of links from a marked part, in place; a part that holds a centre is looked into."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or c.tag in INLINE
                         or not _is_links(c, threshold) or c.centre]
        stack.extend(c for c in node.children if not isinstance(c, str))


def _ancestors_to(node: Node, top: Node) -> Iterator[Node]:
    for a in _ancestors(node):
        yield a
        if a is top:
            return


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node, in page order, white space collapsed and trimmed."""
    out: list[str] = []
    parts: list[str] = []

    def flush():
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is None:
            flush()
        elif x.tag in INLINE:
            if x.tag == "br":
                parts.append(" ")
            stack.extend(reversed(x.children))
        else:
            flush()
            stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def main_text(html: str | None) -> str:
    """Main text of a page; empty for null, empty or text-free pages."""
    if not html:
        return ""
    root = parse(html)
    prune(root)
    body = next((n for n in reversed(_post_order(root)) if n.tag == "body"), root)
    return "\n".join(b for n in select(body) for b in blocks(n))


def text_column(html: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(h) for h in s], dtype=object)
    return run.asNondeterministic()(html)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per row of ``pages``: the ``keep`` columns, ``text`` (empty if
    none) and ``n_chars``, its code points. Repeated rows stay repeated."""
    out = pages.select(*[F.col(c) for c in keep], text_column(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
