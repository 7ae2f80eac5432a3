"""Main text of web pages by wrapper induction.

A page is parsed into a tree, in which neighbours of the same kind (rows of a list,
paragraphs) count as one repeated node. Trees of a host are aligned by simple tree matching
and merged into a template, each source of a host once wherever its copies lie, first per
partition of the distinct trees, then per host; a template stays small however many pages
a host has. Nodes whose text is the same on nearly all pages are
the template's own, the others are slots. Content is what fills slots inside the node that
holds most of the varying text, without menus, notices and the like.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import in_pieces

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|button|title)\b"
    r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|[^<]+|<",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Elements without content, and elements that end a paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot"
    " th thead tr ul".split()
)
#: Elements and name parts of what is not the main text.
SIDE_TAGS = set("aside dialog footer form head header menu nav".split())
SIDE_NAMES = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie"
    " cookies copyright disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice"
    " notices pagination popup promo promotion related respond search share sharing sidebar social sponsor sponsored"
    " subscribe toolbar widget widgets".split()
)
MAIN_NAMES = set("article content entry main maincontent post story".split())
#: Elements that a start tag of the same group closes.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot"}

#: A text on so many of a host's pages belongs to the template, from so many different pages on.
CONSTANT_SHARE, CONSTANT_PAGES = 0.8, 5
#: Texts that a slot counts (by a sketch that can't miss one on more than 1/9 of the pages).
COUNTED_TEXTS = 8
#: Children beyond which a node's children are grouped by kind, whatever their order.
MOST_CHILDREN = 48
#: Sources of which a task remembers that it has their tree; beyond it starts anew.
REMEMBERED_PAGES = 200_000


class Node:
    """An element of a page; ``children`` are nodes and strings."""

    __slots__ = ("tag", "label", "children", "kind")

    def __init__(self, tag: str, label: str):
        self.tag, self.label = tag, label
        self.children: list[Node | str] = []
        self.kind: Kind | None = None


def parse(source: str) -> Node:
    """A forgiving parse: unclosed elements end where their parents do."""
    root = Node("", "")
    open_nodes = [root]
    for m in _TOKEN.finditer(source):
        text = m.group(0)
        if text[0] != "<" or text == "<":
            open_nodes[-1].children.append(text)
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            for depth in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[depth].tag == tag:
                    del open_nodes[depth:]
                    break
                if tag not in BLOCKS and open_nodes[depth].tag in BLOCKS:
                    break
            continue
        if tag in BLOCKS:
            # A block ends the open paragraph, and a list item the one before it.
            ends = _CLOSES.get(tag, set()) | {"p"}
            for depth in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[depth].tag in ends:
                    del open_nodes[depth:]
                    break
                if open_nodes[depth].tag in _SCOPES or (open_nodes[depth].tag in BLOCKS and tag not in _CLOSES):
                    break
        names = " ".join(x for found in _NAMES.findall(m.group(4)) for x in found if x).lower() if m.group(4) else ""
        node = Node(tag, f"{tag} {re.sub(r'[0-9]+', '0', names)}".strip())
        open_nodes[-1].children.append(node)
        if tag not in VOID and not m.group(4).rstrip().endswith("/"):
            if len(open_nodes) < 200:
                open_nodes.append(node)
    return root


class Kind:
    """A node of a template: what aligned nodes of one or many pages have in common."""

    __slots__ = ("label", "pages", "repeated", "mass", "linked", "texts", "children", "content", "into")

    def __init__(self, label: str):
        self.label = label
        self.pages, self.repeated, self.mass, self.linked = 1, False, 0, 0
        self.texts: dict[str, int] = {}
        self.children: list[Kind] = []
        self.content: bool | None = None
        self.into: Kind | None = None  # what it was merged into

    def dump(self) -> list:
        return [self.label, self.pages, self.repeated, self.mass, self.linked, self.texts, [c.dump() for c in self.children]]

    @classmethod
    def load(cls, data: list) -> Kind:
        kind = cls(data[0])
        kind.pages, kind.repeated, kind.mass, kind.linked, kind.texts = data[1:6]
        kind.children = [cls.load(c) for c in data[6]]
        return kind


def kinds(node: Node, in_link: bool = False) -> Kind:
    """The tree of a page with repeated neighbours as one; nodes learn their kind."""
    kind = Kind(node.label)
    own = "".join(c for c in node.children if isinstance(c, str)).strip()
    link = in_link or node.tag == "a"
    if own:
        kind.mass = len(own)
        kind.linked = len(own) if link else 0
        kind.texts = {xxhash.xxh3_64_hexdigest(own.encode()): 1}
    found: list[Kind] = []
    by_label: dict[str, Kind] = {}
    many = sum(isinstance(c, Node) for c in node.children) > MOST_CHILDREN
    for child in node.children:
        if isinstance(child, str):
            continue
        other = kinds(child, link)
        before = by_label.get(other.label) if many else (found[-1] if found and found[-1].label == other.label else None)
        if before is None:
            found.append(other)
            by_label[other.label] = other
            child.kind = other
        else:
            merge(before, other, siblings=True)
            before.repeated = True
            child.kind = before
    kind.children = found
    node.kind = kind
    return kind


def tree_match(a: Kind, b: Kind) -> int:
    """Simple tree matching: nodes of the largest common top-down tree, in order."""
    if a.label != b.label:
        return 0
    row = [0] * (len(b.children) + 1)
    for x in a.children:
        above = row
        row = [0]
        for j, y in enumerate(b.children):
            best = max(above[j + 1], row[j])
            if x.label == y.label:
                best = max(best, above[j] + tree_match(x, y))
            row.append(best)
    return 1 + row[-1]


def aligned(a: list[Kind], b: list[Kind]) -> list[tuple[Kind | None, Kind | None]]:
    """Children side by side by simple tree matching, in an order that suits both."""
    if len(a) == len(b) and all(x.label == y.label for x, y in zip(a, b)):
        return list(zip(a, b))
    weight = {(i, j): tree_match(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if x.label == y.label}
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + weight.get((i, j), 0))
    out: list[tuple[Kind | None, Kind | None]] = []
    i = j = 0
    while i < len(a) and j < len(b):
        w = weight.get((i, j), 0)
        if w and best[i][j] == best[i + 1][j + 1] + w:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    out += [(x, None) for x in a[i:]]
    return out + [(None, y) for y in b[j:]]


def merge(a: Kind, b: Kind, siblings: bool = False) -> Kind:
    """Merge ``b`` into ``a``; as siblings they are one page's, else other pages'."""
    b.into = a
    if not siblings:
        a.pages += b.pages
    a.repeated |= b.repeated
    a.mass, a.linked = a.mass + b.mass, a.linked + b.linked
    for text, count in b.texts.items():
        a.texts[text] = a.texts.get(text, 0) + count
    if len(a.texts) > COUNTED_TEXTS:
        # Misra-Gries: what is taken from all is at most the count that falls out.
        cut = sorted(a.texts.values(), reverse=True)[COUNTED_TEXTS]
        a.texts = {t: c - cut for t, c in a.texts.items() if c > cut}
    pairs = aligned(a.children, b.children)
    a.children = [merge(x, y, siblings) if x and y else (x or y) for x, y in pairs]
    return a


# -- what is content -----------------------------------------------------------------


def _names(label: str) -> set[str]:
    return set(re.split(r"[^a-z]+", label.partition(" ")[2])) - {""}


def _is_side(kind: Kind) -> bool:
    tag = kind.label.partition(" ")[0]
    return tag in SIDE_TAGS or bool(_names(kind.label) & SIDE_NAMES)


def _is_main(kind: Kind) -> bool:
    tag = kind.label.partition(" ")[0]
    return tag in ("article", "main") or bool(_names(kind.label) & MAIN_NAMES)


def _varying(kind: Kind) -> int:
    """Varying text outside links below a node, without what is at the side."""
    if _is_side(kind):
        return 0
    own = 0 if _constant(kind, kind.pages) else kind.mass - kind.linked
    return own + sum(map(_varying, kind.children))


def _constant(kind: Kind, pages: int) -> bool:
    """Whether nearly all pages have the same text here."""
    if kind.repeated or pages < CONSTANT_PAGES or not kind.texts:
        return False
    return max(kind.texts.values()) >= CONSTANT_SHARE * pages


def _main_nodes(kind: Kind) -> list[Kind]:
    if _is_side(kind):
        return []
    inside = [m for c in kind.children for m in _main_nodes(c)]
    if _is_main(kind) and _varying(kind):
        tag = kind.label.partition(" ")[0]
        # An article inside a content area is the narrower answer.
        articles = [m for m in inside if m.label.partition(" ")[0] == "article"]
        return articles if articles and tag != "article" else [kind]
    return inside


def decide(root: Kind) -> Kind:
    """Mark the template's nodes whose own text is content."""
    main = _main_nodes(root)
    articles = [m for m in main if m.label.partition(" ")[0] == "article"]
    main = articles or main
    if not main:
        node = root
        while True:
            total = _varying(node)
            heavy = [c for c in node.children if not c.repeated and total and _varying(c) >= 0.8 * total]
            if not heavy:
                break
            node = heavy[0]
        main = [node]
    chosen = set(map(id, main))

    def mark(kind: Kind, inside: bool, side: bool, in_text: bool) -> None:
        inside, side = inside or id(kind) in chosen, side or _is_side(kind)
        # A word in bold or a link inside a text is part of it, however often it occurs.
        inline = in_text and kind.label.partition(" ")[0] not in BLOCKS
        kind.content = inside and not side and (inline or not _constant(kind, kind.pages))
        for child in kind.children:
            mark(child, inside, side, kind.mass > 0 or inline)

    mark(root, False, False, False)
    return root


def _transfer(page: Kind, template: Kind) -> None:
    page.content = template.content
    for x, y in aligned(page.children, template.children):
        if x is None:
            continue
        if y is None:
            # Only a page that the template has not seen.
            _inherit(x, bool(page.content) and not _is_side(x))
        else:
            _transfer(x, y)


def _inherit(kind: Kind, content: bool) -> None:
    kind.content = content
    for child in kind.children:
        _inherit(child, content and not _is_side(child))


def content_text(source: str, template: Kind) -> str:
    """The main text of a page whose host has the (decided) template."""
    root = parse(source)
    _transfer(kinds(root), template)
    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    def walk(node: Node) -> None:
        block = node.tag in BLOCKS
        kind = node.kind
        while kind.into is not None:
            kind = kind.into
        if block:
            end_block()
        if node.tag == "br":
            line.append(" ")
        for child in node.children:
            if isinstance(child, Node):
                walk(child)
            elif kind.content:
                line.append(child)
        if block:
            end_block()

    walk(root)
    end_block()
    return "\n".join(blocks)


# -- in Spark ------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without port; empty for null or odd addresses."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _dumped(kind: Kind) -> bytes:
    return zlib.compress(json.dumps(kind.dump(), separators=(",", ":")).encode(), 1)


def _loaded(blob: bytes) -> Kind:
    return Kind.load(json.loads(zlib.decompress(blob)))


def host_templates(pages: DataFrame) -> DataFrame:
    """host, template: one merged tree per host (JSON). ``pages`` has host and html.

    Pages with the same source count once per host: copies say nothing about what varies.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()
        for batch in in_pieces(batches, "html"):
            rows = []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                mark = xxhash.xxh3_128_digest(source.encode())
                if (host, mark) in seen:
                    continue
                # Only saves work; what a task forgets is found equal later.
                if len(seen) >= REMEMBERED_PAGES:
                    seen.clear()
                seen.add((host, mark))
                rows.append((host, mark, _dumped(kinds(parse(source)))))
            columns = list(zip(*rows)) or [[]] * 3
            kinds_of = [pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_of)], ["host", "mark", "tree"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Kind] = {}
        for batch in batches:
            for host, tree in zip(batch.column("host").to_pylist(), batch.column("tree").to_pylist()):
                page = _loaded(tree)
                found[host] = merge(found[host], page) if host in found else page
        blobs = [_dumped(k) for k in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(blobs, pa.binary())], ["host", "template"])

    def merged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        blobs = sorted(rows.column("template").to_pylist())
        total = _loaded(blobs[0])
        for blob in blobs[1:]:
            total = merge(total, _loaded(blob))
        return pa.table([pa.array([key[0].as_py()]), pa.array([json.dumps(total.dump(), separators=(",", ":"))])], names=["host", "template"])

    once = (
        pages.select("host", "html")
        .mapInArrow(trees, "host string, mark binary, tree binary")
        .groupBy("host", "mark")
        .agg(F.first("tree").alias("tree"))
    )
    # In an order that does not depend on how the pages were split.
    parts = once.sortWithinPartitions("host", "mark").mapInArrow(partial, "host string, template binary")
    return parts.groupBy("host").applyInArrow(merged, "host string, template string")


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of the text).

    Null sources count as empty and give an empty text. Pages without a proper address
    share the template of the empty host. A host with few pages has no constant texts, so
    only the names and places of nodes decide there. Repeated rows give repeated results;
    an empty table gives no rows. Nothing is cut off.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    templates = host_templates(rows).withColumnRenamed("host", "template_host")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Kind] = {}
        for batch in in_pieces(batches, "html"):
            texts = []
            hosts, blobs = batch.column("host").to_pylist(), batch.column("template")
            for i, (host, source) in enumerate(zip(hosts, batch.column("html").to_pylist())):
                if host not in known:
                    if len(known) > 1_000:
                        known.clear()
                    known[host] = decide(Kind.load(json.loads(blobs[i].as_py())))
                texts.append(content_text(source, known[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    joined = rows.join(templates, F.col("host") == F.col("template_host")).select("page_id", "url", "host", "html", "template")
    return joined.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
