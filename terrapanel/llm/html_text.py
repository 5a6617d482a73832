"""Main text of web pages by site template removal.

Every page is read once into a tree of elements. Two hashes of an element's
subtree are counted per host over distinct pages. The *exact* hash (tag and
text of all it holds) tells what recurs word by word. The *shape* hash (tag,
class and id words, tags of its children) tells boxes that recur with other
words: lists of links, and elements whose class or id names something that is
not the article. Subtrees that recur on many pages of a host are its template
and are deleted. Within the main content element (``article`` or ``main``) that
holds for boxes (``BOXES``) and marked elements, not for single passages, which
articles share.

Elements that are never article text (menus, forms, scripts ...) are deleted by
tag or role; the header of an article is part of it. A class or id word deletes
only where the counts confirm it: a whole token (``comments``, ``cookie-notice``)
on any host with too few pages to count, and where its shape recurs; a word
within a longer name (``search-history``) only where its shape recurs in short
texts or lists of links. Neither takes the page's main text away (``_spare``).
If a page has a main content element, its text is the page's text, unless it is
small beside the prose around it; otherwise what is left of the body is.

A subtree recurs if it is on ``MIN_SHARE`` of the host's pages or, whatever
the size of the host, on ``ENOUGH_PAGES``. Templates are matched by a join on
(host, subtree), so the number of a host's template subtrees has no bound.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm.common import checkpoint, small_side

#: A template subtree is on at least so many pages, and on this share of a host's pages or on ``ENOUGH_PAGES``.
MIN_PAGES, MIN_SHARE = 5, 0.2
ENOUGH_PAGES = 20
#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset(
    "script style textarea title noscript iframe xmp noembed noframes template head nav header footer aside form button select option input svg canvas object video audio menu dialog fieldset".split()
)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msubsup msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(("article", "main"))
#: Within the main content, only these can be template.
BOXES = frozenset("div section ul ol dl table figure".split())
#: The main elements of a page are stray if its other blocks of ``PROSE`` characters or more hold over ``STRAY`` times their text.
PROSE, STRAY = 80, 4
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A paragraph ends where one of these begins.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: An open element (key) that ends where one of its own kind (values) begins.
ENDS_SAME = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"},
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark what is not article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside header masthead topbar footer colophon cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup comment comments respond discussion disqus replies share sharing social related recommended widget widgets toolbar pagination pager skip login search".split()
)
#: Words that say no more than where a box stands or what holds it.
NEUTRAL = frozenset("area bar block bottom box button buttons container global icon icons inner item items left link links list main outer page primary right secondary section site top wrap wrapper".split())
#: A marked element of so many characters at most, or one whose links hold half of its text, is template if its shape recurs.
SHORT = 200
#: An unmarked box is a list of links if it has so many that hold this share of its text.
LINKS, LINK_SHARE = 3, 0.6
_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"""(?:"[^"]*"?|'[^']*'?|([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?)""")
_MARK = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marked(attrs: str, main: bool) -> tuple[int, str]:
    """How an element's attributes name something other than text: 3 by role
    or as hidden, 2 if a whole class or id does (all its words are marks, or
    say where it stands), 1 if a word within one does (for article and main,
    such words don't count), else 0; and its class and id words in order."""
    level, seen, names = 0, set(), []
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in seen:
            continue  # the first of equal names holds
        seen.add(name)
        match name:
            case "role":
                if value.lower() in ROLES:
                    return 3, ""
            case "hidden":
                return 3, ""
            case "aria-hidden":
                if value.lower() == "true":
                    return 3, ""
            case "class" | "id":
                for token in value.split():
                    names.append(token)
                    words = {m.lower() for m in _MARK.findall(token)}
                    if token.lower() in MARKS or not main and words & MARKS and words <= MARKS | NEUTRAL:
                        level = 2
                    elif not main and words & MARKS:
                        level = max(level, 1)
    return level, " ".join(names)


class Element:
    """An element: its tag, whether it is never text, how its class or id
    marks it, its class and id words, and its parts in order (strings and
    elements)."""

    __slots__ = ("dropped", "mark", "names", "parts", "tag")

    def __init__(self, tag: str, dropped: bool, mark: int = 0, names: str = ""):
        self.tag, self.dropped, self.mark, self.names, self.parts = tag, dropped or mark == 2, 0 if dropped else mark, names, []


def _spare(root: Element) -> None:
    """Take back the marks by class or id that would cost the page its main
    text: of what holds an h1, of what holds over half of the text and is
    marked by a word within a class or id only, and, if no article or main is
    left unmarked, of the marked ones and what holds them."""
    order, todo = [], [(root, False, False)]
    while todo:
        element, inside, under = todo.pop()
        if element.dropped and not element.mark:
            continue
        marked = under or element.mark > 0
        order.append((element, inside, marked))
        inside |= element.tag in MAIN
        todo += [(p, inside, marked) for p in element.parts if isinstance(p, Element)]
    if not any(e.mark for e, _, _ in order):
        return
    chars, has_h1, has_main = {}, set(), set()
    clean = False
    for element, inside, marked in reversed(order):  # parts before what holds them
        here = [p for p in element.parts if isinstance(p, Element)]
        chars[id(element)] = sum(chars.get(id(p), 0) if isinstance(p, Element) else len("".join(p.split())) for p in element.parts)
        if element.tag == "h1" or any(id(p) in has_h1 for p in here):
            has_h1.add(id(element))
        if not inside and (element.tag in MAIN or any(id(p) in has_main for p in here)):
            has_main.add(id(element))
        clean |= element.tag in MAIN and not marked and chars[id(element)] > 0
    for element, inside, _ in order:
        most = element.mark == 1 and 2 * chars[id(element)] > chars[id(root)]
        main = not clean and id(element) in has_main and not inside
        if element.mark and (most or main or element.tag not in MAIN and id(element) in has_h1):
            element.dropped, element.mark = False, 0


def tree(source: str) -> Element:
    """The elements of a page. Tags that are left open end with their parent,
    paragraphs and list items also where the next begins; closing tags
    without an open element are ignored."""
    root = Element("", False)
    stack, at = [root], 0
    while True:
        m = _TAG.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text:
            stack[-1].parts.append(html.unescape(text))
        if not m:
            _spare(root)
            return root
        at = m.end()
        if m["cdata"]:
            stack[-1].parts.append(m["cdata"])
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
            continue
        if name in ENDS_P:
            _end(stack, "p", HEADINGS | {"button", "td", "th", "li", "div", "section", "article", "main", "body"})
        for kind, by in ENDS_SAME.items():
            if name in by:
                _end(stack, kind, {"ul", "ol", "dl", "table", "select"} | ({"tr"} if kind in ("td", "th") and name in ("td", "th") else set()))
        attrs = m["attrs"] or ""
        mark, names = _marked(attrs, name in MAIN) if attrs and name not in ("html", "body") else (0, "")
        # an article's own header holds its headline
        never = name in DROPPED and not (name == "header" and any(e.tag in MAIN for e in stack))
        element = Element(name, never or mark == 3, mark, names)
        stack[-1].parts.append(element)
        if name in VOID or attrs.rstrip().endswith("/") and name in ("svg", "path", "use"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        stack.append(element)


def _end(stack: list[Element], tag: str, within: set[str] | frozenset[str]) -> None:
    """Close the open ``tag``, unless one of ``within`` was opened after it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in within:
            return


def mains(root: Element) -> list[Element]:
    """The outermost main content elements."""
    found, todo = [], [root]
    while todo:
        element = todo.pop()
        if element.dropped:
            continue
        if element.tag in MAIN:
            found.append(element)
            continue
        todo += [p for p in reversed(element.parts) if isinstance(p, Element)]
    return found


def _chars(element: Element) -> int:
    """Characters of text in an element, without what is never text."""
    total, todo = 0, [element]
    while todo:
        for part in todo.pop().parts:
            if not isinstance(part, Element):
                total += len("".join(part.split()))
            elif not part.dropped:
                todo.append(part)
    return total


def _shape(element: Element) -> int:
    """Hash of the tag, the class and id words and the children's tags."""
    from xxhash import xxh64

    children: list[str] = []
    for part in element.parts:
        if isinstance(part, Element) and part.tag not in INLINE and children[-1:] != [part.tag]:
            children.append(part.tag)
    return xxh64("\0".join(["shape", element.tag, element.names, *children]).encode("utf-8", "surrogatepass")).intdigest() - (1 << 63)


def subtree_hashes(root: Element) -> dict[int, list[Element]]:
    """Hash and elements of every block subtree with text, and of the shapes
    that may recur with other words: marked elements and lists of links.
    Without inline elements: they are parts of a sentence. Within the main
    content only ``BOXES`` that hold at most half of its text, and marked
    elements: passages that pages share are paragraphs of the article."""
    from xxhash import xxh64

    out: dict[int, list[Element]] = {}
    inner = {id(m) for m in mains(root)}

    def visit(element: Element, within: int = 0) -> tuple[bytes, int, int, int]:
        """Hash, characters, characters of links and links; ``within``: the
        characters of the main element around it, if any."""
        h, chars, linked, links = xxh64(element.tag.encode()), 0, 0, 0
        for part in element.parts:
            if isinstance(part, Element):
                if part.dropped:
                    if part.mark:
                        out.setdefault(_shape(part), []).append(part)
                    continue
                if id(part) in inner:
                    visit(part, _chars(part))
                    continue
                digest, n, m, k = visit(part, within)
                h.update(b"<" + digest)
                chars, linked, links = chars + n, linked + m, links + k
            elif words := part.split():
                h.update(b"=" + " ".join(words).encode("utf-8", "surrogatepass"))
                chars += sum(map(len, words))
        if element.tag == "a":
            linked, links = chars, 1
        if within:
            counts = element.tag in BOXES and 2 * chars <= within
        else:
            counts = element.tag not in INLINE and element.tag not in ("", "html", "body") and id(element) not in inner
        if chars and counts:
            key = xxh64(b"main" + h.digest()).intdigest() if within else h.intdigest()
            out.setdefault(key - (1 << 63), []).append(element)
        named = element.mark == 1 and (chars <= SHORT or 2 * linked >= chars) and 2 * chars <= (within or 2 * chars)
        listed = not within and element.tag in BOXES and links >= LINKS and linked >= LINK_SHARE * chars
        if chars and (named or listed):
            out.setdefault(_shape(element), []).append(element)
        return h.digest(), chars, linked, links

    _deep(visit, root)
    return out


def _deep(visit, root: Element):
    """Call a recursive function with room for very deep pages."""
    import sys

    depth, todo = 0, [(root, 1)]
    while todo:
        element, d = todo.pop()
        depth = max(depth, d)
        todo += [(p, d + 1) for p in element.parts if isinstance(p, Element)]
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 2 * depth + 1000))
    try:
        return visit(root)
    finally:
        sys.setrecursionlimit(before)


def blocks(root: Element, deleted: frozenset[int] = frozenset()) -> list[str]:
    """The text blocks that are left, in page order; ``deleted``: ids (in the
    sense of ``id``) of template elements."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    def visit(element: Element) -> None:
        if element.dropped or id(element) in deleted:
            return
        own = element.tag not in INLINE
        if own:
            flush()
        if element.tag in ("br", "wbr"):
            line.append(" " if element.tag == "br" else "")
        for part in element.parts:
            if isinstance(part, Element):
                visit(part)
            else:
                line.append(part)
        if own:
            flush()

    def of(tops: list[Element]) -> list[str]:
        out.clear()
        for top in tops:
            _deep(visit, top)
            flush()
        return out.copy()

    if not (found := mains(root)):
        return of([root])
    own, every = of(found), of([root])
    prose = sum(len(text) for text in (Counter(every) - Counter(own)).elements() if len(text) >= PROSE)
    return every if prose > STRAY * sum(map(len, own)) else own


def main_text(source: str, template: frozenset[int] | set[int] = frozenset(), judged: bool = False) -> str:
    """The article of a page, given the subtree hashes of its site's template
    and whether the site has enough pages to judge by them: then a whole class
    or id word deletes only what they confirm. A page that is template all
    through (copies of one page) keeps its text."""
    root = tree(source)
    found = subtree_hashes(root) if template or judged else {}
    deleted = frozenset(id(e) for h, same in found.items() if h in template for e in same)
    if judged:
        for same in found.values():
            for e in same:
                if e.mark == 2 and id(e) not in deleted:
                    e.dropped = False
    return "\n".join(blocks(root, deleted) or blocks(root))


def host(url: Column) -> Column:
    """Lower-case host of a URL, without port; the empty string if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame, *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, enough_pages: int = ENOUGH_PAGES) -> tuple[DataFrame, DataFrame]:
    """(``key``, ``template``: array of subtree hashes) of ``pages`` (``key``,
    ``host``, ``html``), stored: the template subtrees that a page has.
    Pages without one are left out; pages with one key must be equal. Besides
    the hosts (``judged_host``) with pages enough to judge by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[*subtree_hashes(tree(source or "")), 0] for source in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["key", "host", "subtrees"])

    # the hash 0 stands for the page itself: its count is the host's pages
    seen = checkpoint(pages.select("key", "host", "html").mapInArrow(run, "key long, host string, subtrees array<long>"), "subtrees")
    rows = seen.select("key", "host", F.explode("subtrees").alias("subtree"))
    counts = checkpoint(rows.groupBy("host", "subtree").agg(F.count("*").alias("n")), "subtree-counts")
    total = counts.where(F.col("subtree") == 0).select("host", F.col("n").alias("pages"))
    often = counts.where((F.col("subtree") != 0) & (F.col("n") >= min_pages)).join(total, "host")
    often = checkpoint(often.where((F.col("n") >= enough_pages) | (F.col("n") >= min_share * F.col("pages"))).select("host", "subtree"), "template-subtrees")
    found = rows.join(small_side(often), ["host", "subtree"])
    known = checkpoint(found.groupBy("key").agg(F.sort_array(F.collect_set("subtree")).alias("template")), "templates")
    return known, checkpoint(total.where(F.col("pages") >= min_pages).select(F.col("host").alias("judged_host")), "judged-hosts")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, enough_pages: int = ENOUGH_PAGES) -> DataFrame:
    """(id column, ``url``, ``text``, ``n_chars``) of every row.

    A null html is empty and gives an empty text. Pages without a host count
    as one site. Repeated rows stay repeated, and count as pages of their
    host.
    """
    id_, url, body = (F.col(f"`{c}`") for c in (id_col, url_col, html_col))
    rows = pages.select(id_.alias("_id"), url.alias("url"), F.coalesce(body, F.lit("")).alias("html"), host(url).alias("host"))
    rows = rows.withColumn("key", F.xxhash64("host", "html"))
    known, hosts = templates(rows, min_pages=min_pages, min_share=min_share, enough_pages=enough_pages)
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source, set(t or ()), judged) for source, t, judged in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    # stored templates are broadcast if they are small; else the planner
    # shuffles both sides and splits a page with very many copies
    seen = rows.join(small_side(known), "key", "left").join(small_side(hosts), F.col("host") == F.col("judged_host"), "left")
    return seen.select("_id", "url", "html", "template", F.col("judged_host").isNotNull().alias("judged")).mapInArrow(run, schema)
