"""Main text of web pages: what a host's pages do not share.

A page is parsed into a tree of elements. The hashes of all its subtrees (tag, attributes, text, children)
are counted per host in Spark, over the whole page as it came, and subtrees that recur across many pages of
the host are deleted. So are subtrees of the same shape (tags and classes, without texts and link targets),
if they look like furniture: mostly links, or short and outside the marked article. Names are an addition, for hosts of few pages and for parts that change from page to
page: elements whose tag, role, id or class marks them as menus, headers, footers, sidebars, notices,
adverts, forms, comments and the like are deleted, and of the rest the article (``article``, else ``main``)
is taken, or the whole body where a page marks neither. Subtrees are hashed again without the elements
that names delete, so one that differs only in these is found too.

Inside a marked article single paragraphs and headings are not looked up: an article that quotes what
others quote stays whole. Outside one, every block is. A marked article and what is around it stay.

Defined results: null, empty and textless pages have an empty text; a null url belongs to the host ''.
Identical pages count once in a host's statistics, so a host of copies does not lose its text. Tags that
are never closed end with the page; end tags without a start are ignored. Repeated rows are treated alike.
Pages are read whole, in time that grows with their length: an unclosed quote or tag is looked for once.
Extra columns are ignored. An empty table gives an empty result.

A subtree is a template by an absolute number of different pages, however large the host is. Short single
blocks (a cell, an item, a heading of fewer than WORDS words) may be content that recurs by chance, so they
need MANY pages, or on a small host SHARE of its pages. Templates meet pages by (host, hash); what one
page gets is bounded by its own subtrees, not by those of its host.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Workspace, small
from tallyforge.llm.urlfilter import parts

#: A subtree is a template if it is on so many different pages of its host.
PAGES = 5
#: A block of fewer words that is no container: if it is on so many pages, or on PAGES and this share of them.
WORDS, MANY, SHARE = 8, 100, 0.2
#: Blocks of fewer words outside a marked article may be templates by their shape.
SHORT = 30
#: Tables up to so many rows are broadcast; larger ones are joined by a shuffle.
SMALL = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of their own, or with text that is no prose.
DROPPED = frozenset("script style noscript template svg math head title nav header footer aside form button select option textarea iframe object video audio canvas dialog menu label fieldset".split())
BLOCKS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr body html details summary hgroup center".split())
CONTAINERS = frozenset("div section ul ol dl table aside blockquote figure details address center".split())
#: Looked up outside a marked article, and inside one.
OUTSIDE = BLOCKS | CONTAINERS | frozenset("nav header footer form label fieldset dialog menu".split())
INSIDE = CONTAINERS | frozenset("nav header footer form fieldset dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Raw elements hold no shape; a plain paragraph or heading has the same shape everywhere.
DROPPED_RAW = RAW | frozenset(["head"])
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr html body pre blockquote".split())
_VALUE = re.compile(r"""\s*\b(?:href|src|srcset|title|alt|value|content|data-[\w-]*|id)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_ROLE = re.compile(r"""\brole\s*=\s*["']?(?:navigation|banner|contentinfo|complementary|search|alert|dialog|menu|menubar|form)\b""", re.I)
_HIDDEN = re.compile(r"""(?:\s|^)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.I)
_MARK = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adbox|banner|promo|promotion|sponsor|sponsored|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|"
    r"cookies?|consent|gdpr|notice|notification|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|comments?|commentlist|disqus|replies|respond|related|recommended|"
    r"search|searchbox|widget|skip|pagination|pager|toc)(?:$|[\s_-])", re.I,
)
_ASIDE_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|related|recommended|promo|teaser|sponsored|ads?|advert)(?:$|[\s_-])", re.I)
_NAMED = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_TAG_PART = re.compile(r"[>\"']")
#: A start tag that ends an open element of these first.
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
_P_ENDS = BLOCKS - frozenset("body html".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "whole", "shape")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.kids, self.hash, self.whole, self.shape = tag, attrs, [], None, None, None


class _Scanner:
    """Tokens of a page in linear time: what was looked for in vain once is not looked for again.

    Quotes in a tag hide a ``>``. Where a tag with quotes never ends, its ``<`` is text, and quotes count no
    more in the rest of the page.
    """

    def __init__(self, source: str):
        self.source, self.quotes, self.ends = source, True, True

    def stop(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` has its ``>``, or -1."""
        find = self.source.find
        start = at
        while self.quotes:
            m = _TAG_PART.search(self.source, at)
            if m is None:
                self.quotes = False
            elif m.group() == ">":
                return m.start()
            else:
                close = find(m.group(), m.end())
                if close < 0:
                    self.quotes = False
                else:
                    at = close + 1
        return self.plain(start)

    def plain(self, at: int) -> int:
        """The next ``>``, or -1."""
        found = self.source.find(">", at) if self.ends else -1
        self.ends = found >= 0
        return found

    def tokens(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, slash, tag, attributes); the tag is empty for comments and the like, None for a ``<`` that is text."""
        source, at = self.source, 0
        while (start := source.find("<", at)) >= 0:
            m = _TAG.match(source, start)
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(source)
                yield start, at, "", "", ""
            elif m or source.startswith(("<!", "<?"), start):
                end = self.stop(m.end()) if m else self.plain(start)
                at = end + 1 if end >= 0 else start + 1
                if end < 0:
                    yield start, at, "", None, ""
                else:
                    yield start, at, m.group(1) if m else "", m.group(2).lower() if m else "", source[m.end() : end] if m else ""
            else:
                at = start + 1
                yield start, at, "", None, ""
            at = max(at, self.skip)

    skip = 0


def parse(source: str) -> Node:
    """A tree of elements; text is kept with its character references still in it."""
    root = Node("html", "")
    stack, at, add = [root], 0, root.kids.append
    open_: dict[str, int] = {}
    raw_end: dict[str, bool] = {}
    scanner = _Scanner(source)

    def cut(i: int) -> None:
        for n in stack[i:]:
            open_[n.tag] -= 1
        del stack[i:]

    for start, end, slash, tag, attrs in scanner.tokens():
        if start < at:
            continue  # inside raw text
        if start > at:
            add(source[at:start])
        at = end
        if not tag:
            if tag is None:
                add("<")
            continue
        if slash:
            if open_.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        cut(i)
                        add = stack[-1].kids.append
                        break
            continue
        if tag in ("html", "body"):
            continue  # one of each, as the root
        wanted = CLOSES.get(tag, frozenset())
        if tag in _P_ENDS:
            wanted = wanted | {"p"}
        if any(open_.get(w) for w in wanted):
            for i in range(len(stack) - 1, 0, -1):
                name = stack[i].tag
                if name in wanted:
                    cut(i)
                    add = stack[-1].kids.append
                    break
                if name in BLOCKS or name in DROPPED:
                    break
        node = Node(tag, attrs)
        add(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(source, at) if raw_end.get(tag, True) else None
            raw_end[tag] = close is not None
            stop = close.start() if close else len(source)
            node.kids.append(source[at:stop])
            at = scanner.skip = close.end() if close else stop
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
            add = node.kids.append
    if at < len(source):
        add(source[at:])
    return root


def unwanted(node: Node) -> bool:
    if node.tag in DROPPED:
        return True
    if not node.attrs or node.tag == "main":
        return False
    if node.tag == "article":
        return any(_ASIDE_ARTICLE.search("".join(g)) for g in _NAMED.findall(node.attrs))
    if _HIDDEN.search(node.attrs) or _ROLE.search(node.attrs):
        return True
    return any(_MARK.search("".join(g)) for g in _NAMED.findall(node.attrs))


def prune(root: Node) -> tuple[list[Node], bool]:
    """Deletes unwanted elements; the marked articles, else the root. Deep pages need no recursion.

    An element around a marked article stays whatever it is called.
    """
    around: set[int] = set()
    met: set[int] = set()
    path: list = [(root, 0)]
    ancestors: list[Node] = []
    while path:
        node, depth = path.pop()
        del ancestors[depth:]
        if node.tag in ("article", "main") and not unwanted(node):
            for a in reversed(ancestors):
                if id(a) in met:
                    break
                met.add(id(a))
                if not (a.tag == "article" and unwanted(a)):
                    around.add(id(a))
            continue
        ancestors.append(node)
        path += [(k, depth + 1) for k in node.kids if isinstance(k, Node) and k.kids]
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        node.kids = [k for k in node.kids if isinstance(k, str) or id(k) in around or not unwanted(k)]
        if node.tag in found and not inside:
            found[node.tag].append(node)
        todo += [(k, inside or node.tag == "article") for k in reversed(node.kids) if isinstance(k, Node)]
    for tag in ("article", "main"):
        if found[tag]:
            return found[tag], True
    return [root], False


def marked_articles(root: Node) -> tuple[set[int], set[int]]:
    """Of the page as it came: ids of the elements that ``prune`` may take as marked articles, and of those around them."""
    tops, around = set(), set()
    path: list = [(root, 0)]
    ancestors: list[Node] = []
    while path:
        node, depth = path.pop()
        del ancestors[depth:]
        if node.tag in ("article", "main") and not unwanted(node):
            tops.add(id(node))
            for a in reversed(ancestors):
                if id(a) in around:
                    break
                around.add(id(a))
        ancestors.append(node)
        path += [(k, depth + 1) for k in node.kids if isinstance(k, Node) and k.kids]
    return tops, around


def hashes(tops: list[Node], inside: bool, articles: tuple[set[int], set[int]]) -> set[int]:
    """Hashes of the subtrees that may be templates, as signed 64-bit numbers; sets ``hash``, None where it may not be one.

    Those of short blocks are odd, all others even.
    """
    out: set[int] = set()
    marked, around = articles
    for top in tops:
        order, todo = [], [(top, inside)]
        while todo:
            node, within = todo.pop()
            within = within or id(node) in marked
            order.append((node, within))
            todo += [(k, within) for k in node.kids if isinstance(k, Node)]
        values: dict[int, bytes] = {}
        words: dict[int, int] = {}
        for node, within in reversed(order):  # children before parents
            h = xxhash.xxh3_64(f"{node.tag}\x00{node.attrs}".encode("utf-8", "surrogatepass"))
            blank, n = True, 0
            for k in node.kids:
                if isinstance(k, str):
                    n += len(k.split())
                    h.update(b"\x01" + " ".join(k.split()).encode("utf-8", "surrogatepass"))
                    blank = blank and not k.strip()
                else:
                    n += words[id(k)]
                    h.update(b"\x02" + values[id(k)])
                    blank = False
            value = h.intdigest()
            values[id(node)], words[id(node)] = value.to_bytes(8, "little"), n
            value = value & ~1 | (n < WORDS and node.tag not in INSIDE)
            may = node is not top and not blank and id(node) not in marked and id(node) not in around and node.tag in (INSIDE if within else OUTSIDE)
            node.hash = (value - (1 << 64) if value >> 63 else value) if may else None
            if may:
                out.add(node.hash)
    return out


def shapes(root: Node, articles: tuple[set[int], set[int]]) -> set[int]:
    """Hashes of subtrees without their texts and link targets: menus and boxes that are filled anew for each page.

    Only what looks like furniture has one, outside marked articles: subtrees of two words or more with more
    words in links than outside; and, where the page marks its article, blocks of fewer than SHORT words. Sets
    ``shape``.
    """
    out: set[int] = set()
    marked, around = articles
    order: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if id(node) not in marked:
            order.append(node)
            todo += [k for k in node.kids if isinstance(k, Node)]
    values: dict[int, tuple[bytes, int, int]] = {}
    for node in reversed(order):
        h = xxhash.xxh3_64(f"{node.tag}\x00{_VALUE.sub('', node.attrs)}".encode("utf-8", "surrogatepass"))
        words = linked = 0
        for k in node.kids:
            if isinstance(k, str):
                n = len(k.split())
                words += n
                if n:
                    h.update(b"\x01")
            elif id(k) in values:
                own, n, m = values[id(k)]
                words, linked = words + n, linked + m
                h.update(b"\x02" + own)
        linked = words if node.tag == "a" else linked
        value = h.intdigest()
        values[id(node)] = value.to_bytes(8, "little"), words, linked
        furniture = 2 * linked > words > 1 or (marked and 0 < words < SHORT)
        if node is not root and id(node) not in around and node.tag in OUTSIDE - _PLAIN and furniture and node.tag not in DROPPED_RAW:
            node.shape = (value - (1 << 64) if value >> 63 else value) & ~1
            out.add(node.shape)
    return out


def parsed(source: str | None) -> tuple[list[Node], bool, set[int]]:
    """What names leave of a page, whether it is a marked article, and the hashes of all possible templates.

    ``whole`` of a node is its hash in the page as it came, ``hash`` that without what names delete.
    """
    root = parse(source or "")
    articles = marked_articles(root)
    found = hashes([root], False, articles) | shapes(root, articles)
    todo = [root]
    while todo:
        node = todo.pop()
        node.whole = node.hash
        todo += [k for k in node.kids if isinstance(k, Node)]
    tops, marked = prune(root)
    return tops, marked, found | hashes(tops, marked, articles)


def text_of(tops: list[Node], templates: frozenset[int] | set[int]) -> str:
    """Blocks in page order, one a line. Pieces between block boundaries are joined, then white space is closed up."""
    blocks: list[str] = []
    piece: list[str] = []

    def end() -> None:
        if piece:
            words = html.unescape("".join(piece)).split()
            if words:
                blocks.append(" ".join(words))
            piece.clear()

    for top in tops:
        todo: list = [top]
        while todo:
            node = todo.pop()
            if node is None:
                end()
            elif isinstance(node, str):
                piece.append(node)
            elif templates and (node.whole in templates or node.hash in templates or node.shape in templates):
                end()
            elif node.tag == "br":
                piece.append(" ")
            else:
                block = node.tag in BLOCKS
                if block:
                    end()
                    todo.append(None)
                todo += reversed(node.kids)
        end()
    return "\n".join(blocks)


def deleted(source: str | None, templates: frozenset[int] | set[int]) -> tuple[int, int]:
    """Characters of a page's text that templates delete, and those that names delete of the rest."""
    whole, root = parse(source or ""), parse(source or "")
    articles = marked_articles(root)
    hashes([root], False, articles)
    shapes(root, articles)
    todo = [root]
    while todo:
        node = todo.pop()
        node.whole = node.hash
        todo += [k for k in node.kids if isinstance(k, Node)]
    for tree in (whole, root):
        todo = [tree]
        while todo:
            node = todo.pop()
            node.kids = [k for k in node.kids if isinstance(k, str) or k.tag not in DROPPED_RAW]
            todo += [k for k in node.kids if isinstance(k, Node)]
    everything, left = len(text_of([whole], frozenset())), len(text_of([root], templates))
    return everything - left, left - len(extract(source, templates))


def page_hashes(source: str | None) -> list[int]:
    """The hashes of the page's possible templates."""
    return sorted(parsed(source)[2])


def extract(source: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    if templates:
        return text_of(parsed(source)[0], templates)
    return text_of(prune(parse(source or ""))[0], templates)


def _hash_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [page_hashes(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["host", "page", "found"])


def _host():
    return parts(F.col("url"))[0]


def _key():
    """What tells the different pages of a host apart."""
    return F.xxhash64(F.coalesce("html", F.lit("")))


def _subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, found): the possible templates of each different page."""
    seen = pages.select(_host().alias("host"), _key().alias("page"), "html").mapInArrow(_hash_pages, "host string, page long, found array<long>")
    return seen.groupBy("host", "page").agg(F.first("found").alias("found"))


def templates(pages: DataFrame, least: int = PAGES) -> DataFrame:
    """(host, template, n): subtrees on at least ``least`` different pages of the host; template null counts its pages.

    Counts are summed before the shuffle, by host and hash, so a large host is no large task.
    """
    return _counted(_subtrees(pages), least)


def _counted(each: DataFrame, least: int) -> DataFrame:
    counted = each.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "found")).alias("template")).groupBy("host", "template").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= least) | F.col("template").isNull())


def page_templates(pages: DataFrame, space: Workspace, least: int = PAGES, share: float = SHARE, many: int = MANY) -> DataFrame:
    """(_host, _page, _templates) of the pages that have any."""
    each = space.save(_subtrees(pages))
    counted = space.save(_counted(each, least))
    totals = counted.where("template is null").select(F.col("host").alias("_host"), F.col("n").alias("total"))
    sure = (F.col("template").bitwiseAND(F.lit(1).cast("long")) == 0) | (F.col("n") >= many) | (F.col("n") >= share * F.col("total"))
    often = space.save(counted.where("template is not null").join(totals, F.col("host") == F.col("_host")).where(sure).select(F.col("host").alias("_host"), F.col("template").alias("_template")))
    met = each.select("host", "page", F.explode("found").alias("template")).join(small(often, SMALL), (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template")))
    return space.save(met.groupBy(F.col("host").alias("_host"), F.col("page").alias("_page")).agg(F.collect_set("template").alias("_templates")))


def extract_text(pages: DataFrame, least: int = PAGES, share: float = SHARE, many: int = MANY) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars."""
    space = Workspace(pages.sparkSession, "html")
    by_page = page_templates(pages, space, least, share, many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(source, frozenset(found or ())) for source, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host().alias("_h"), _key().alias("_p"))
    return (
        rows.join(small(by_page, SMALL // 5), (F.col("_h") == F.col("_host")) & (F.col("_p") == F.col("_page")), "left").select("page_id", "url", "html", "_templates")
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")
    )
