"""HTML extraction by wrapper induction.

Each page is parsed into a tree. Its skeleton is the tree of block elements, where equal siblings are one node, so
pages of one layout have one skeleton however many paragraphs they hold. Of each host, the commonest skeleton is
the reference; every other skeleton is aligned to it by simple tree matching, and over the host's different pages
(copies of a page count once) each aligned node counts its pages, its text and whether the text is always the same.
Nodes with one text on MIN_PAGES pages and SHARE of the host's pages at least are template; the others are varying slots.
The content is the smallest block of the reference that holds DOMINANT of the varying text outside links, with its
title; a page's main text is what it has in the block that is aligned to the content, without template nodes.

Names are a help only: elements, roles, classes and ids by which pages mark menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are left out anywhere; an element that the page marks as its article replaces the
content if it has DOMINANT of the content's text, or if there is no content, and nothing inside it is template.

Statistics are combined by host, skeleton and node before they are shuffled, so a host with a third of all pages is as
cheap as any other. The wrappers (a row a host) are broadcast only if they are counted to be few, and joined by salted host
otherwise. Parsing is linear in the page and no step recurses, so nesting and unclosed tags cost nothing more.

Defined cases: a null or empty page has the text ''; a page without a host shares the wrapper of all such pages;
a host of fewer than MIN_PAGES different pages has no template and no content, so what its pages mark as their article counts, or else
all that isn't left out by name; repeated rows give equal rows; a tag that is never closed is markup up to the end of the page;
other malformed pages are parsed as far as they go. A kept column named text gives way to the result; other extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, cut, table

MIN_PAGES = 3  # different pages of a host, before a text that is always the same is template
SHARE = 0.5  # of the host's different pages that have such a text at least
DOMINANT = 0.7  # of the varying text that the content holds
FEW_HOSTS = 20_000  # wrappers that may be broadcast
FEW_BYTES = 16 << 20
SALTS = 64

# Element kinds of HTML, and names by which pages mark what isn't their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre section summary table tbody thead tfoot tr caption ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "legend", "summary"}
KEEPS_P = frozenset("td th li button object".split())  # a p outside them stays open
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table select menu dir".split())
TITLES = frozenset("h1 h2 header hgroup".split())
NOT_TEXT = frozenset("head script style noscript template nav footer aside form button select option textarea input label menu iframe object embed svg canvas audio video title dialog map".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar tablist".split())
NOT_NAMES = frozenset(
    "nav navbar navigation menu menus submenu sidebar sidenav aside footer header masthead topbar breadcrumb breadcrumbs crumbs ad ads adv advert adverts advertisement "
    "advertising adsense banner promo promotion promoted sponsor sponsored sponsors cookie cookies consent gdpr notice notices popup modal subscribe "
    "subscription newsletter signup login share sharing social related recommended recommendations comment comments disqus reply replies respond toolbar "
    "pagination pager".split()
)
NOT_OUTSIDE = frozenset("foot notification alert overlay widget widgets skip copyright legal search status note".split())  # names and roles, left out where no article is around them
HEADERS = frozenset({"header", "masthead", "banner"})
OWN_HEADER = frozenset("article post entry story content title".split())
IN_ARTICLES = frozenset({"comment", "comments", "reply", "replies", "ad", "ads", "advert", "promo", "sponsored", "related"})  # articles that are none

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
OPENS = re.compile(r"/?[A-Za-z]")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))|(?=[\s/]|\Z))", re.I)
WORD = re.compile(r"[a-z0-9]+")
NUMBERED = re.compile(r"^[0-9]|[0-9]{3}")  # names that count elements say nothing of their kind
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    names: tuple[str, ...] = ()
    role: str = ""
    hidden: bool = False
    items: list = field(default_factory=list)  # texts and nodes in order
    p: Node | None = None  # the open p that a block closes
    item: Node | None = None  # the nearest item or list, itself included
    article: bool = False  # whether an article is around it
    out: bool = False  # whether it, or what is around it, is left out

    def __post_init__(self) -> None:
        up = self.parent
        self.p = self if self.tag == "p" else up.p if up is not None and self.tag not in KEEPS_P else None
        self.item = self if self.tag in ITEMS or self.tag in LISTS else up.item if up is not None else None

    def settle(self) -> None:
        """What names say, once the attributes are known."""
        up = self.parent
        self.article = up.article or _is_article(up)
        self.out = up.out or self.tag not in ("html", "body") and left_out(self)

    @property
    def sign(self) -> str:
        return ".".join((self.tag, *(w for w in self.names if not NUMBERED.search(w))))


def parse(page: str) -> Node:
    root = at = Node("#root", None)
    open_: dict[str, int] = {}
    pos, size = 0, len(page)

    def leave(to: Node) -> Node:
        up = at
        while up is not to:
            open_[up.tag] -= 1
            up = up.parent
        return to

    while pos < size:
        low = page.find("<", pos)
        if low < 0:
            at.items.append(unescape(page[pos:]))
            break
        if low > pos:
            at.items.append(unescape(page[pos:low]))
        if page.startswith("<!--", low):
            end = page.find("-->", low + 4)
            pos = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", low):
            end = page.find("]]>", low + 9)
            at.items.append(page[low + 9 : size if end < 0 else end])
            pos = size if end < 0 else end + 3
            continue
        if page[low + 1 : low + 2] in ("!", "?"):
            end = page.find(">", low)
            pos = size if end < 0 else end + 1
            continue
        if not OPENS.match(page, low + 1):
            at.items.append("<")
            pos = low + 1
            continue
        m = TAG.match(page, low)
        if m is None:  # never closed
            break
        pos, tag = m.end(), m[2].lower()
        if m[1]:
            if open_.get(tag):
                up = at
                while up.tag != tag:
                    up = up.parent
                at = leave(up.parent)
            continue
        if tag in CLOSES_P and at.p is not None:
            at = leave(at.p.parent)
        if tag in ITEMS:
            up, own = at.item, ITEMS[tag]
            while up is not None and up.tag not in own and up.tag not in LISTS:
                up = up.parent.item
            if up is not None and up.tag in own:
                if tag == "tr" and up.tag != "tr":  # a cell ends with its row
                    while up.tag != "tr" and up.parent.item is not None and up.parent.item.tag not in LISTS:
                        up = up.parent.item
                at = leave(up.parent)
        node = Node(tag, at)
        if m[3] and not m[3].isspace():
            given = {}
            for name, *values in ATTRIBUTE.findall(m[3]):
                given.setdefault(name.lower(), next((v for v in values if v), ""))
            named = CAMEL.sub(" ", given.get("class", "") + " " + given.get("id", "")).lower()
            node.names = tuple(dict.fromkeys(WORD.findall(named)))
            node.role = given.get("role", "").lower()
            node.hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true"
        node.settle()
        at.items.append(node)
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, pos)
            close = page.find(">", end.end()) if end else -1
            pos = size if close < 0 else close + 1
        elif tag not in VOID and not m[3].endswith("/"):
            at = node
            open_[tag] = open_.get(tag, 0) + 1
    return root


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role in ("article", "main")


def left_out(node: Node) -> bool:
    """Whether the page marks the node as something besides its article."""
    if node.tag in NOT_TEXT or node.hidden or node.role in NOT_ROLES or not node.article and node.role in NOT_OUTSIDE:
        return True
    found = NOT_NAMES.intersection(node.names) if node.article else (NOT_NAMES | NOT_OUTSIDE).intersection(node.names)
    if node.tag == "header" and not found:
        return not node.article
    if found and found <= HEADERS and (node.article or OWN_HEADER.intersection(node.names)):
        return False
    if node.tag in ("article", "main"):
        return node.tag == "article" and bool(found & IN_ARTICLES)
    return bool(found)


# --- skeletons --------------------------------------------------------------------------------------------------


@dataclass(eq=False)
class Tree:
    sign: str = ""
    below: dict = field(default_factory=dict)  # by sign, in order of first appearance
    number: int = 0  # in the order of writing
    last: int = 0  # the greatest number at or below it


def numbered(tree: Tree) -> tuple[str, list[Tree]]:
    """The tree written as text, its nodes in order."""
    out, nodes, stack = [], [], []
    at, it = tree, iter(tree.below.values())
    tree.number = 0
    nodes.append(tree)
    out.append("(")
    while True:
        child = next(it, None)
        if child is None:
            out.append(")")
            at.last = len(nodes) - 1
            if not stack:
                return "".join(out), nodes
            at, it = stack.pop()
            continue
        child.number = len(nodes)
        nodes.append(child)
        out += (child.sign, "(")
        stack.append((at, it))
        at, it = child, iter(child.below.values())


def skeleton(root: Node) -> tuple[Tree, dict[Node, Tree]]:
    """The tree of block elements, equal siblings once, and the place of each block element in it."""
    top = Tree()
    place = {root: top}
    stack = [(root, top, iter(root.items))]
    while stack:
        node, into, items = stack[-1]
        for x in items:
            if isinstance(x, Node):
                below = into
                if x.tag in BLOCK:
                    below = place[x] = into.below.setdefault(x.sign, Tree(x.sign))
                stack.append((x, below, iter(x.items)))
                break
        else:
            stack.pop()
    return top, place


def read(text: str) -> Tree:
    """The tree that numbered() wrote, with numbers."""
    top = Tree()
    stack = [top]
    for sign, bracket in re.findall(r"([^()]*+)([()])", text[1:-1]):
        if bracket == "(":
            stack.append(stack[-1].below.setdefault(sign, Tree(sign)))
        else:
            stack.pop()
    numbered(top)
    return top


def _alike(a: str, b: str) -> int:
    """0 if the elements can't be matched, 2 if their classes and ids are the same as well."""
    return 0 if a.split(".", 1)[0] != b.split(".", 1)[0] else 1 + (a == b)


def _matched(a: Tree, b: Tree):
    """A step of simple tree matching: asks for the matches of pairs of children, gives (size, [(child, child, what is below)])."""
    xs, ys = list(a.below.values()), list(b.below.values())
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    how: dict[tuple[int, int], tuple[int, list]] = {}
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            same, most = _alike(x.sign, y.sign), max(best[i][j + 1], best[i + 1][j])
            if same:
                n, below = yield x, y
                how[i, j] = (n + same, below)
                most = max(most, best[i][j] + n + same)
            best[i + 1][j + 1] = most
    i, j, found = len(xs), len(ys), []
    while i and j:
        if (i - 1, j - 1) in how and best[i][j] == best[i - 1][j - 1] + how[i - 1, j - 1][0]:
            found.append((xs[i - 1], ys[j - 1], how[i - 1, j - 1][1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1], found


def tree_match(a: Tree, b: Tree) -> tuple[int, dict[int, int]]:
    """Simple tree matching: the largest order-keeping match of children, level by level. (size, number in a -> number in b)."""
    stack, value = [_matched(a, b)], None
    while stack:
        try:
            pair = stack[-1].send(value)
            stack.append(_matched(*pair))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    to, rest = {0: 0}, [value[1]]
    while rest:
        for x, y, below in rest.pop():
            to[x.number] = y.number
            rest.append(below)
    return value[0], to


def blocks(root: Node, place: dict[Node, Tree], marked: bool) -> Iterator[tuple[Tree, str, int, Node]]:
    """(place, text as one run, characters in links, block element) of what isn't left out, in page order; with marked, of
    that too, but for what is never text."""
    run: list[str] = []
    linked = 0
    at = root

    def flush():
        nonlocal run, linked
        text = " ".join("".join(run).split())
        was, run, linked = linked, [], 0
        return (place[at], text, was, at) if text else None

    stack = [(root, root, iter(root.items), False)]  # node, the block element it is in
    while stack:
        node, block, items, in_link = stack[-1]
        for x in items:
            if isinstance(x, str):
                run.append(x)
                linked += len(x) if in_link else 0
                continue
            if x.out and not (marked and (x.tag not in NOT_TEXT or x.tag in ("nav", "footer", "aside", "form", "menu", "dialog"))):
                run.append(" ")
                continue
            own = block
            if x.tag in BLOCK:
                if got := flush():
                    yield got
                own = at = x
            elif x.tag in ("br", "td", "th", "img"):
                run.append(" ")
            stack.append((x, own, iter(x.items), in_link or x.tag == "a"))
            break
        else:
            stack.pop()
            if node.tag in BLOCK:
                if got := flush():
                    yield got
                at = stack[-1][1] if stack else root
    if got := flush():
        yield got


def articles(root: Node, every: list[tuple]) -> list[Node]:
    """The outermost elements that the page marks as its article, or else as its main part, and that hold some of every block."""
    held = set()
    for *_, node in every:
        while node is not None and node not in held:
            held.add(node)
            node = node.parent
    for wanted in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if wanted in (node.tag, node.role):
                found.append(node)
            else:
                stack += reversed([x for x in node.items if isinstance(x, Node) and x in held and not x.out])
        if found:
            return found
    return []


def _inside(every: list[tuple], tops: set[Node]) -> list[bool]:
    """Whether each block lies in one of the nodes."""
    known: dict[Node | None, bool] = {None: False}
    out = []
    for *_, node in every:
        way = []
        while node not in known and node not in tops:
            way.append(node)
            node = node.parent
        found = known.get(node, node in tops)
        known.update(dict.fromkeys(way, found))
        out.append(found)
    return out


@dataclass
class Wrapper:
    """Of a host: the reference, the numbers of its template nodes, the number of its content (none: -1)."""

    tree: Tree
    constant: frozenset[int]
    content: int


def main_text(page: str, wrapper: Wrapper | None) -> str:
    root = parse(page)
    top, place = skeleton(root)
    every = list(blocks(root, place, False))
    marks = articles(root, every)
    marked = _inside(every, set(marks))
    if wrapper is not None:
        numbered(top)
        to = tree_match(top, wrapper.tree)[1]
        inside = _inside(every, {n for n, t in place.items() if wrapper.content >= 0 and to.get(t.number) == wrapper.content})
        held = sum(len(b[1]) for b, ok in zip(every, inside) if ok)
        both = sum(len(b[1]) for b, ok, m in zip(every, inside, marked) if ok and m)
        if held and both < DOMINANT * held or not held and not marks:  # else the page's own mark is sharper
            return "\n".join(b[1] for b, ok in zip(every, inside) if (ok or not held) and to.get(b[0].number) not in wrapper.constant)
    return "\n".join(b[1] for b, ok in zip(every, marked) if ok or not marks)


# --- wrappers of hosts ------------------------------------------------------------------------------------------


def host_of(url: str = "url"):
    bare = F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    return F.lower(F.regexp_extract(bare, r"^//(?:[^/@?#]*@)?([^/:?#]*)", 1))


SLOT = pa.struct([("slot", pa.int32()), ("h", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64()), ("marked", pa.bool_())])


def slots_of(page: str) -> tuple[str, list[dict]]:
    """The page's skeleton as text, and what its nodes hold."""
    root = parse(page)
    top, place = skeleton(root)
    shape, _ = numbered(top)
    per: dict[int, list] = {}
    for at, text, linked, node in blocks(root, place, True):
        s = per.setdefault(at.number, [[], 0, 0, node.out])
        s[0].append(text)
        s[1] += len(text)
        s[2] += linked
    return shape, [{"slot": k, "h": xxhash.xxh64_intdigest("\n".join(t)) >> 1, "chars": n, "linked": c, "marked": out} for k, (t, n, c, out) in per.items()]


def content_of(tree: Tree, slots: dict[int, tuple[int, bool, str]]) -> int:
    """The number of the smallest block with DOMINANT of the varying text and its title; slots: number -> (varying text outside links, whether left out)."""
    nodes = numbered(tree)[1]
    mass = [0] * (len(nodes) + 1)
    for k, n in slots.items():
        mass[k] += n
    total = sum(mass)
    if not total:
        return -1
    upto = [0]
    for m in mass:
        upto.append(upto[-1] + m)
    under = lambda t: upto[t.last + 1] - upto[t.number]
    at = tree
    while True:
        rich = [c for c in at.below.values() if under(c) >= DOMINANT * total and c.below]
        titled = any(c.sign.split(".", 1)[0] in TITLES and under(c) for c in at.below.values() if c not in rich)
        if not rich or titled:
            return at.number
        at = rich[0]


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, reference, constant, content): a row a host of MIN_PAGES different pages or more."""
    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).withColumn("page", F.xxhash64(F.coalesce("html", F.lit(""))))
    # hosts of few rows have no wrapper, so their pages needn't be parsed for one; pages are never dealt by host
    many = cut(rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES).select("host"))
    if many.count() <= FEW_HOSTS:
        rows = rows.join(F.broadcast(many), "host", "left_semi")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [slots_of(page.as_py() or "") for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(SLOT)), batch.column(2)], names=["host", "shape", "slots", "page"])

    read_ = arrow_batches(rows).mapInArrow(each, "host string, shape string, slots array<struct<slot:int,h:long,chars:long,linked:long,marked:boolean>>, page long").dropDuplicates(["host", "page"])  # copies of a page say nothing of its host
    nodes = read_.select("host", "shape", F.explode_outer("slots").alias("s")).groupBy("host", "shape", "s.slot").agg(
        F.count("*").alias("pages"), F.min("s.h").alias("low"), F.max("s.h").alias("high"), F.coalesce(F.sum("s.chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum("s.linked"), F.lit(0)).alias("linked"), F.coalesce(F.min("s.marked"), F.lit(False)).alias("marked")
    )
    nodes = cut(nodes)
    shapes = nodes.groupBy("host", "shape").agg(F.max("pages").alias("n"))
    reference = shapes.groupBy("host").agg(F.max(F.struct("n", "shape"))["shape"].alias("reference"), F.sum("n").alias("all")).where(F.col("all") >= MIN_PAGES)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, last, tree = [], None, None
            known: dict[str, dict[int, int]] = {}
            for shape, ref, slot in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if last != ref:
                    known, last, tree = {}, ref, read(ref)
                if shape not in known:
                    known[shape] = tree_match(read(shape), tree)[1]
                to.append(known[shape].get(slot))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(to, pa.int32())], names=[*batch.schema.names[3:], "to"])

    keep = ["host", "pages", "low", "high", "chars", "linked", "marked"]
    met = nodes.where(F.col("slot").isNotNull()).join(reference, "host").select("shape", "reference", "slot", *keep, "all")
    met = arrow_batches(met).mapInArrow(aligned, "host string, pages long, low long, high long, chars long, linked long, marked boolean, all long, to int")
    sums = [F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("marked").alias("marked"), F.max("all").alias("all")]
    slots = met.where(F.col("to").isNotNull()).groupBy("host", "to").agg(*sums)
    same = (F.col("pages") >= MIN_PAGES) & (F.col("pages") >= SHARE * F.col("all")) & (F.col("low") == F.col("high"))
    mass = F.when(same | F.col("marked"), 0).otherwise(F.greatest(F.col("chars") - 2 * F.col("linked"), F.lit(0)))
    # at most the nodes of one page
    made = slots.groupBy("host").agg(F.sort_array(F.collect_list(F.when(same, F.col("to")))).alias("constant"), F.collect_list(F.struct("to", mass.alias("mass"))).alias("slots"))
    joined = reference.join(made, "host", "left").select("host", "reference", F.coalesce("constant", F.array().cast("array<int>")).alias("constant"), F.coalesce("slots", F.array().cast("array<struct<to:int,mass:long>>")).alias("slots"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [content_of(read(ref.as_py()), {s["to"]: s["mass"] for s in slots.as_py()}) for ref, slots in zip(batch.column(1), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int32())], names=["host", "reference", "constant", "content"])

    return joined.mapInArrow(told, "host string, reference string, constant array<int>, content int")


def extract(pages: DataFrame, keep: list[str], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The columns to keep and text: the main text of every page."""
    keep = [c for c in keep if c.lower() != "text"]
    made = cut(wrappers(pages, url_col, html_col))
    size = made.agg(F.count("*"), F.coalesce(F.sum(F.length("reference") + 4 * F.size("constant")), F.lit(0))).first()
    inner = [f"_{i}" for i in range(len(keep))]  # so that no name of theirs clashes with one made here
    rows = pages.select(*[F.col(c).alias(i) for c, i in zip(keep, inner)], F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host"))
    if size[0] <= FEW_HOSTS and size[1] <= FEW_BYTES:
        joined = rows.join(F.broadcast(made), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)))
        salted = made.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = rows.join(salted, ["host", "salt"], "left")
    joined = joined.select(*inner, "html", "reference", "constant", "content")
    schema = joined.select(*inner).withColumn("text", F.lit("")).schema
    width = len(keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            texts = []
            for page, ref, constant, content in zip(*(batch.column(width + i) for i in range(4)), strict=True):
                ref = ref.as_py()
                key = (ref, content.as_py(), tuple(constant.as_py() or ()))
                if ref is not None and key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = Wrapper(read(ref), frozenset(key[2]), key[1])
                texts.append(main_text(page.as_py() or "", known.get(key)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string())], names=schema.names)

    found = arrow_batches(joined).mapInArrow(each, schema)
    return found.select(*[F.col(i).alias(c) for c, i in zip(keep, inner)], "text")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
