"""HTML extraction by site template removal.

A tolerant tokenizer makes the element tree of a page.  Every element subtree has two hashes: of its content (names,
classes, text) and of its shape alone (names, classes, share of links; runs of like children count once).  Spark counts
on how many pages of its host each hash occurs (copies of a page, by its main text, are one page), and what occurs on
many of them is a template of that host: by content anywhere but in the text blocks of an article, by shape only outside
the main part (or among links, if nothing marks that part) and only where the shape says something.  A page's text is
its main part without template subtrees.  Elements that are boilerplate by their kind (menus, page headers and footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) go too, which serves hosts of few pages.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, free_name, materialize, table, text_or_empty

#: A template's share of the host's pages, and the least number of pages.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.25, 5
#: Rows of the template table up to which it is broadcast; beyond, pages and templates are joined by host, a host's pages in ``SALTS`` parts.
BROADCAST_ROWS, SALTS = 100_000, 32

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style textarea title xmp iframe noembed noframes".split()}
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split()
)
#: What an opening tag closes first, up to the given ancestors.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: Elements that never hold text of the page, and elements and roles that are boilerplate by kind.
HIDDEN = frozenset("head script style noscript template iframe object svg canvas button select textarea input title noembed noframes".split())
BOILERPLATE = frozenset("nav aside form dialog menu search footer".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of classes and ids that tell boilerplate; those of reader comments; those of content.
COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
BOILERPLATE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies copyright footer masthead menu modal nav navbar navigation newsletter notice "
    "notification overlay pagination popup promo promoted promotion related share sharing sidebar sidenav signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Of these, words that the class of a text block may have for its subject, and those that the class of a whole container may have.
SUBJECT_WORDS = frozenset(
    "banner copyright footer masthead menu nav navbar navigation notice notification overlay promo promotion related share sharing sidebar sidenav social sponsor toolbar topbar widget".split()
)
CONTAINER_SUBJECTS = frozenset("related share sharing social sponsor".split())
#: Characters from which on a paragraph that is mostly no link makes a container of such a class a part of the article.
PROSE_CHARS = 80
CONTENT_WORDS = frozenset("article content entry main post story text body".split())
#: Words beside a word of boilerplate that only say where or how it stands; and those that make of it a state of something else, as in has-sidebar.
PLACE_WORDS = frozenset("area bar block bottom box button buttons container form group header inner item left links list page primary right secondary section site thread title top wrap wrapper".split())
STATE_WORDS = frozenset("allowed closed disabled enabled free has hide is layout no not off on open ready show supports with without".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())
PARAGRAPHS = frozenset("p blockquote pre".split())
SECTIONING = frozenset("nav aside footer header form dialog menu search".split())
WORDS = re.compile(r"[a-z]+")
#: Kinds of elements: text, never text, boilerplate by element or role, by a class that says nothing else, by a word of a class, reader comments, header.
PLAIN, NEVER, ELEMENT, CLASS, WORD, COMMENTS, HEADER = range(7)


@lru_cache(1 << 16)
def kind_of_label(label: str) -> int:
    """What the class and id of an element say: one of PLAIN, CLASS, WORD, COMMENTS."""
    found = PLAIN
    for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", label).lower().split():
        words = frozenset(WORDS.findall(token))
        if not words & BOILERPLATE_WORDS:
            if words and words <= CONTENT_WORDS:
                return PLAIN
        elif words & STATE_WORDS or words & CONTENT_WORDS and words & {"wrap", "wrapper", "container"}:
            continue
        elif words & COMMENT_WORDS and words <= BOILERPLATE_WORDS | PLACE_WORDS | CONTENT_WORDS:
            found = COMMENTS
        elif found != COMMENTS:
            found = CLASS if words <= BOILERPLATE_WORDS | PLACE_WORDS | CONTENT_WORDS or found == CLASS else WORD
    return found


@lru_cache(1 << 16)
def told_by(label: str) -> frozenset[str]:
    """The words of boilerplate in a class and id."""
    return BOILERPLATE_WORDS.intersection(WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", label).lower()))


class Node:
    __slots__ = ("tag", "label", "role", "kind", "parent", "children", "hash", "shape", "size", "link", "holds", "prose")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.label = self.role = ""
        self.hash = self.shape = self.size = self.link = 0
        self.holds = False  # an article or main part
        self.prose = False  # a paragraph of PROSE_CHARS, mostly no link
        hidden = False
        if "=" in attributes or "hidden" in attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            self.label = f"{found.get('class', '')} {found.get('id', '')}".strip()
            self.role = found.get("role", "").lower()
            hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        if tag in ("html", "body", "main", "#root") or self.role == "main":
            self.kind = PLAIN
        elif tag in HIDDEN or hidden:
            self.kind = NEVER
        elif tag in BOILERPLATE or self.role in BOILERPLATE_ROLES:
            self.kind = ELEMENT
        else:
            self.kind = kind_of_label(self.label) if self.label else PLAIN
            if tag == "article" and self.kind == WORD:
                self.kind = PLAIN
            if tag == "header" and self.kind == PLAIN:
                self.kind = HEADER

    def is_subject(self) -> bool:
        """Whether its class may name what a text of an article is about: that of a text block, or of a container of prose."""
        if self.tag in TEXT_BLOCKS:
            return 2 * self.link < self.size and told_by(self.label) <= SUBJECT_WORDS
        return self.prose and told_by(self.label) <= CONTAINER_SUBJECTS

    def is_main(self) -> bool:
        return self.tag in ("article", "main") or self.role == "main"


def parse(page: str) -> Node:
    """The element tree: children are nodes and strings.  Time is linear in the page, whatever is left open."""
    root = Node("#root", None)
    stack = [root]
    depths: dict[str, list[int]] = {}  # of the open elements of each name
    blocks = [0]  # depths of the open blocks

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            depths[node.tag].pop()
            if node.tag in BLOCKS:
                blocks.pop()

    position = 0
    while True:
        m = TOKEN.search(page, position)
        if position < (m.start() if m else len(page)):
            stack[-1].children.append(page[position : m.start() if m else len(page)])
        if not m:
            return root
        position = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            # a closing tag does not reach out of a block when it belongs to inline text
            if (open_ := depths.get(tag)) and (tag in BLOCKS or open_[-1] > blocks[-1]):
                close_to(open_[-1])
            elif tag == "p":
                stack[-1].children.append(Node("p", stack[-1]))
            continue
        if tag in BLOCKS and tag not in ("html", "body", "head") and stack[blocks[-1]].tag == "p":
            close_to(blocks[-1])  # a block ends the paragraph it stands in
        if closes := CLOSES.get(tag):
            limit = max((d[-1] for t in closes[1] if (d := depths.get(t))), default=0)
            ends = max((d[-1] for t in closes[0] if (d := depths.get(t))), default=0)
            if ends > limit:
                close_to(min(d for t in closes[0] for d in depths.get(t, ()) if d > limit) if tag == "tr" else ends)
        child = Node(tag, stack[-1], m[3])
        stack[-1].children.append(child)
        if tag in RAW:
            end = RAW[tag].search(page, position)
            child.children.append(page[position : end.start() if end else len(page)])
            if not end:
                return root
            position = page.find(">", end.end()) + 1 or len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            depths.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append(child)


def in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in node.children if type(c) is Node]
    return out


def measure(root: Node) -> list[Node]:
    """Set the hashes, text sizes, ``holds`` and ``prose`` of all elements; returns them, parents first.  What never is text counts for nothing."""
    order = in_order(root)
    for node in reversed(order):
        if node.kind == NEVER:
            continue
        content, shape, size, link = [node.tag, node.label], [node.tag, re.sub(r"\d+", "#", node.label)], 0, 0
        for c in node.children:
            if type(c) is Node:
                if c.kind != NEVER:
                    size += c.size
                    link += c.link
                    content.append(f"#{c.hash:x}")
                    if c.tag in BLOCKS and shape[-1] != (mark := f"#{c.shape:x}"):
                        shape.append(mark)
                    node.prose = node.prose or c.prose
                if c.holds or c.is_main() and c.kind != COMMENTS and c.size:
                    node.holds = True
            elif text := " ".join(c.split()):
                size += len(text)
                content.append(text)
        node.size, node.link = size, size if node.tag == "a" else link
        node.prose = node.prose or node.tag in PARAGRAPHS and size >= PROSE_CHARS and 2 * node.link < size
        shape[0] += "@" if 2 * node.link >= size > 0 else ""
        node.hash = xxhash.xxh3_64_intdigest("\x00".join(content).encode("utf-8", "replace")) >> 1
        node.shape = xxhash.xxh3_64_intdigest("\x00".join(shape).encode("utf-8", "replace"), 1) >> 1
    return order


def dropped(node: Node, in_article: bool, whole: int, by_class: bool = True) -> bool:
    """Whether an element of a main text of ``whole`` characters is boilerplate by its kind.

    A class that says nothing but boilerplate drops an element, one that says more only an element without an article
    and with less than half of the text.  In an article, neither drops what may have the class for its subject.
    """
    kind = node.kind
    if kind == PLAIN or kind == NEVER:
        return kind == NEVER
    if kind == HEADER:
        return not in_article and not node.holds
    if kind == ELEMENT:
        return node.tag != "form" or not (node.holds or 2 * node.size >= whole)
    if not by_class or in_article and kind != COMMENTS and node.is_subject():
        return False
    return kind != WORD or 2 * node.size < whole and not node.holds


def main_parts(root: Node) -> list[Node]:
    """The elements that hold the main text: outermost articles and main elements, else containers marked as content that hold half of the text; may be none.

    What stands beside an article in a main element belongs to the text as well.
    """

    def collect(strict: bool) -> list[list[Node]]:
        found: list[list[Node]] = [[], []]
        stack = [(root, 2)]
        while stack:
            node, above = stack.pop()
            if node.kind == NEVER or node.kind == COMMENTS or strict and node is not root and dropped(node, above < 2, 1 << 62):
                continue
            level = 0 if node.is_main() else 1 if node.tag in ("div", "section", "td") and any(t in CONTENT_WORDS for t in WORDS.findall(node.label.lower())) else 2
            if level < above and node.size:
                found[level].append(node)
            if level:
                stack += [(c, min(level, above)) for c in reversed(node.children) if type(c) is Node]
        return found

    found = collect(True)
    if not found[0] and root.holds:
        found = collect(False)  # all articles stand in what looks like boilerplate
    return found[0] or (found[1] if 2 * sum(n.size for n in found[1]) >= root.size > 0 else [])


def bulk(root: Node) -> Node:
    """The smallest container of more than half of the text that is no link."""
    node, whole = root, root.size - root.link
    while True:
        inner = next((c for c in node.children if type(c) is Node and c.tag in BLOCKS and c.tag not in TEXT_BLOCKS and 2 * (c.size - c.link) > whole), None)
        if inner is None:
            return node
        node = inner


class Page:
    """A parsed page with its main parts.  ``by_kind=False`` leaves all removal to templates: no kind of element goes, and text outside the main parts stays."""

    def __init__(self, html: str, by_kind: bool = True):
        self.root, self.by_kind = parse(html), by_kind
        self.order = measure(self.root)
        self.parts = main_parts(self.root)
        #: what templates by shape leave alone: the main parts, whatever they hold, and whatever holds them; of unmarked main parts, links may go
        self.kept_shapes: set[int] = set()
        self.part_of: dict[int, Node] = {}
        tops = self.parts or [bulk(self.root)]
        for top in tops:
            node = top
            while node is not None and id(node) not in self.kept_shapes:
                self.kept_shapes.add(id(node))
                node = node.parent
            for node in in_order(top)[1:]:
                if self.parts:
                    self.part_of[id(node)] = top
                if self.parts or 2 * node.link < node.size:
                    self.kept_shapes.add(id(node))

    def content_may_go(self, node: Node) -> bool:
        """A template by content: in an article only a container with less than half of its text, elsewhere what holds less than half of the page's text."""
        part = self.part_of.get(id(node))
        if part is not None and part.is_main():
            return node.tag in BLOCKS and node.tag not in TEXT_BLOCKS and 2 * node.size < part.size
        if self.parts:
            return part is not None and 2 * node.size < part.size or part is None and id(node) not in self.kept_shapes
        return 2 * node.size < self.root.size

    def shape_may_go(self, node: Node) -> bool:
        """A template by shape: outside the main part, and of a shape that says something."""
        return id(node) not in self.kept_shapes and node.tag in BLOCKS and node.tag not in TEXT_BLOCKS and bool(node.label or node.tag in SECTIONING or 2 * node.link >= node.size)

    def candidates(self) -> set[int]:
        """The hashes of all subtrees that may be templates."""
        found: set[int] = set()
        for node in self.order:
            if node.size and node is not self.root:
                if self.content_may_go(node):
                    found.add(node.hash)
                if self.shape_may_go(node):
                    found.add(node.shape)
        return found

    def is_template(self, node: Node, templates: frozenset[int]) -> bool:
        return node.hash in templates and self.content_may_go(node) or node.shape in templates and self.shape_may_go(node)

    def blocks(self, top: Node, templates: frozenset[int], by_class: bool) -> list[str]:
        out: list[str] = []
        current: list[str] = []

        def close():
            if text := " ".join(entities.unescape("".join(current)).split()):
                out.append(text)
            current.clear()

        in_article, whole = top.is_main(), top.size
        stack: list = [top]
        while stack:
            node = stack.pop()
            if node is None:
                close()
            elif type(node) is str:
                current.append(node)
            elif node is not top and ((dropped(node, in_article, whole, by_class) if self.by_kind else node.kind == NEVER) or templates and self.is_template(node, templates)):
                current.append(" ")
            elif node.tag in ("br", "td", "th", "wbr"):
                current.append("" if node.tag == "wbr" else " ")
                stack += reversed(node.children)
            elif node.tag in BLOCKS:
                close()
                stack.append(None)
                stack += reversed(node.children)
            else:
                stack += reversed(node.children)
        close()
        return out

    def text(self, templates: frozenset[int] = frozenset()) -> str:
        """The main text: blocks joined by two line feeds.  Classes are not heeded where nothing would be left."""
        tops = self.parts if self.parts and self.by_kind else [self.root]
        for by_class in (True, False):
            if text := "\n\n".join(b for top in tops for b in self.blocks(top, templates, by_class)):
                return text
        return ""


def subtrees(html: str) -> tuple[int, set[int]]:
    """A hash of the main text of a page, and the distinct hashes of its subtrees that may be templates of its host."""
    page = Page(html)
    return xxhash.xxh3_64_intdigest(page.text().encode("utf-8", "replace")) >> 1, page.candidates()


def main_text(html: str, templates: frozenset[int] = frozenset(), by_kind: bool = True) -> str:
    return Page(html, by_kind).text(templates)


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_templates(pages: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES, url: str = "url", html: str = "html") -> DataFrame:
    """host, templates (hashes of subtrees, by content or shape, on at least ``share`` and ``least`` of the host's pages).

    Pages of a host with the same main text count as one: what copies of a page repeat is its content.  A host has at most (subtrees of a page) / ``share`` of them, however many pages it has.
    """

    def run(batches):
        for batch in batches:
            hosts, bodies, hashes = [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist()):
                body, found = subtrees(page)
                found.add(-1)  # counts the page itself
                hosts += [host] * len(found)
                bodies += [body] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(bodies, pa.int64()), pa.array(hashes, pa.int64())], names=["host", "body", "h"])

    counts = pages.select(host_of(url).alias("host"), text_or_empty(html).alias("page")).mapInArrow(run, "host string, body long, h long").distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    counts = materialize(counts.filter((F.col("n") >= least) | (F.col("h") == -1)), "html-counts")
    total = counts.filter("h = -1").select("host", F.col("n").alias("pages"))
    found = counts.filter("h <> -1").join(total, "host").filter(F.col("n") >= F.lit(share) * F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("templates"))
    found = materialize(found, "html-templates")
    discard(counts)
    return found


def extract(pages: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES, url: str = "url", html: str = "html", by_kind: bool = True) -> DataFrame:
    """``pages`` without ``html``, with text (main text) and n_chars (code points).

    Null or empty html gives an empty text; pages without a url share one host.  Copies of a page count as one page and are
    extracted each; very long and very deep pages take time linear in their length.  An empty table gives an empty result.
    Existing columns text and n_chars are replaced.
    """
    bound_batches(pages.sparkSession)
    templates = site_templates(pages, share, least, url, html)
    n = templates.agg(F.sum(F.size("templates"))).first()[0] or 0
    host, found, page, salt = (free_name(pages, c) for c in ("host", "templates", "page", "salt"))
    kept = pages.drop(*({"text", "n_chars"} - {html, url})).withColumn(host, host_of(url)).withColumn(page, text_or_empty(html)).drop(html)
    table_ = templates.select(F.col("host").alias(host), F.col("templates").alias(found))
    if n <= BROADCAST_ROWS:
        joined = kept.join(F.broadcast(table_), host, "left").drop(host)
    else:
        salted = table_.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = kept.withColumn(salt, F.pmod(F.xxhash64(page), F.lit(SALTS)).cast("int")).join(salted, [host, salt], "left").drop(host, salt)
    schema = joined.drop(found, page).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            last, known = None, frozenset()
            texts = []
            for body, hashes in zip(batch.column(page).to_pylist(), batch.column(found).to_pylist()):
                if hashes != last:
                    last, known = hashes, frozenset(hashes or ())
                texts.append(main_text(body, known, by_kind))
            keep = [i for i, c in enumerate(batch.schema.names) if c not in (found, page)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
