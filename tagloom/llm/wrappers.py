"""HTML extraction by wrapper induction: pages of a host are aligned as trees, and what stays the same is template.

1. Each page is read into a tree of its block elements, labelled by tag, id and class, in which neighbours
   of one label are merged. Such skeletons are counted for each host over all pages.
2. A host's skeletons are merged, the commonest first, into one template tree by simple tree matching: of
   two equally labelled nodes the children are aligned in order so that the most nodes match. All are merged,
   in lots by their hash, lots of lots and then by host, so that no task holds all of a hot host's.
3. Each page is aligned with its host's template, and the texts of each template node are counted over all
   distinct pages: pages of one main part (see 4) count once, for an article may be repeated. A text that
   most pages of a node share is constant, that is template.
4. The main text is what is left: the blocks of varying slots. Constants go wherever they are, within
   <article> and <main> too. Only what varies is told by names, for slots of navigation, headers, footers,
   sidebars, notices, adverts, forms and comments vary as well on many hosts: the main part of a page is
   what no such element holds, and within <article> or <main> if it has one. A block that consists of links
   is navigation if its links' targets are constant, counted as texts are; other link lists are content.

Wrappers are small (a tree and some hashes) and joined by host; the join broadcasts them if they are small
altogether. Defined results: a null or empty page has no text; a null url belongs to the host ""; unclosed
elements end with their parents, and elements nested beyond DEEPEST are read as part of the outermost such
element; without constants (a host of few pages) the names decide alone. Repeated pages each give a row.
Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .urls import host_of

DEEPEST, SHARED, LINKED, FEWEST, BROADCAST_BYTES = 80, 0.6, 0.6, 5, 32 << 20
#: Tells a node from its texts in counts.
WHOLE = 1 << 32
#: Into so many lots a host's skeletons are dealt, step by step; each number divides the one before.
LOTS = (4096, 64, 1)

#: Elements that make blocks, that hold no text to show, that close an open paragraph or sibling, and that stand alone.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = set("script style template noscript iframe svg math object canvas audio video head title textarea select option button datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
#: Elements, roles and parts of names that tell what is not the article.
ASIDE = set("nav footer aside form menu dialog".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
NAMES = set("nav navbar navigation menu menubar sidebar aside footer ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup share sharing social comment comments reply replies respond disqus breadcrumb breadcrumbs related recommended recommendations pagination pager widget popup modal overlay login search toolbar masthead topbar copyright skip".split())
HEADS = {"header", "head", "masthead"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">]++)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("label", "children", "aside", "main", "id")

    def __init__(self, label: str, aside: bool = False, main: bool = False):
        self.label, self.children, self.aside, self.main, self.id = label, [], aside, main, -1


def described(tag: str, rest: str, inside_main: bool) -> tuple[str, bool, bool]:
    """An element's label, whether its name says that it is not the article, and whether it is hidden."""
    if not rest.strip(" /"):
        return tag, tag in ASIDE or tag == "header" and not inside_main, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
    name, own = found.get("class", ""), found.get("id", "")
    parts = {p.lower() for p in SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{name} {own}").lower()) if p}
    aside = tag in ASIDE or bool(parts & NAMES) or found.get("role", "").lower() in ROLES or not inside_main and (tag == "header" or bool(parts & HEADS))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    label = tag + ("." + ".".join(sorted(name.split())) if name.strip() else "") + (f"#{re.sub(r'[0-9]+', '0', own)}" if own else "")
    return label, aside and tag not in ("html", "body", "article", "main"), hidden


#: Tags whose attributes are at most so long are remembered, so many of them in a worker.
SHORT, REMEMBERED = 200, 20_000


class Described(dict):
    """(tag, attributes, inside <article> or <main>) -> what described tells of it."""

    def __missing__(self, key: tuple[str, str, bool]) -> tuple[str, bool, bool]:
        out = described(*key)
        if len(key[1]) <= SHORT:
            if len(self) > REMEMBERED:
                self.clear()
            self[key] = out
        return out


remembered = Described()


def read(page: str) -> tuple[Node, list[tuple[list[Node], str, float, list[str]]]]:
    """A page's tree of block elements, and its blocks of text: their elements from the root down, text, share of the text in links, and targets of these."""
    root = Node("html")
    stack: list[tuple[str, Node | None]] = [("html", root)]
    blocks: list[tuple[list[Node], str, float, list[str]]] = []
    held: list[tuple[str, str | None]] = []
    links: list[str] = []
    at, silent = 0, 0

    def ended() -> None:
        if held:
            text = " ".join(html.unescape("".join([t for t, _ in held])).split())
            if text:
                linked = [x for x in held if x[1] is not None]
                share = sum(len(t) for t, _ in linked) / sum(len(t) for t, _ in held) if linked else 0.0
                blocks.append(([n for _, n in stack if n], text, share, list(dict.fromkeys(to for t, to in linked if t.strip()))))
            held.clear()

    def popped(upto: int) -> None:
        nonlocal silent
        for tag, node in stack[upto:]:
            if node:
                ended()
                break
        for tag, _ in stack[upto:]:
            silent -= tag[0] == "!"
            if tag.lstrip("!") == "a":
                links.pop()
        del stack[upto:]

    while m := TAG.search(page, at):
        if m.start() > at and not silent:
            held.append((page[at : m.start()], links[-1] if links else None))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0].lstrip("!") == tag), 0)
            if found and (tag in BLOCKS or not any(n for _, n in stack[found + 1 :])):
                popped(found)
            continue
        if tag in ("html", "body", "head"):
            continue
        if tag in VOID:
            if tag == "br" and not silent:
                held.append((" ", None))
            elif tag == "hr":
                ended()
            continue
        if tag in RAW or tag in SILENT:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if tag in RAW or close:
                at = close.end() if close else len(page) if tag in ("script", "style") else at
            continue
        if tag in BLOCKS:
            ended()
            closes = CLOSES.get(tag, set()) | ({"p"} if tag not in ("td", "th") else set())
            for i in range(len(stack) - 1, 0, -1):
                name, node = stack[i]
                if name.lstrip("!") in closes:
                    popped(i)
                elif node and (name in SCOPES.get(tag, ()) or name.lstrip("!") not in closes and tag not in SCOPES):
                    break
        if m[3] or tag in BLOCKS:
            inside = any([n.main for _, n in stack if n])
            label, aside, hidden = remembered[tag, m[3], inside]
        else:
            label, aside, hidden = tag, False, False
        node = None
        if (tag in BLOCKS or aside) and len(stack) < DEEPEST:
            ended()
            node = Node(label, aside, tag in ("article", "main"))
            next(n for _, n in reversed(stack) if n).children.append(node)
        if len(stack) < 4 * DEEPEST:
            stack.append(("!" + tag if hidden else tag, node))
            silent += hidden
            if tag == "a":
                links.append(next((h[2] or h[3] or h[4] or "" for h in ATTRIBUTE.finditer(m[3]) if h[1].lower() == "href"), ""))
    if at < len(page) and not silent:
        held.append((page[at:], links[-1] if links else None))
    ended()
    return root, blocks


def matched(a: Node, b: Node, memo: dict) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: how many nodes of two trees match, and which children go together."""
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    if a.label != b.label:
        memo[key] = (0, [])
        return memo[key]
    rows, cols = len(a.children), len(b.children)
    best = [[0] * (cols + 1) for _ in range(rows + 1)]
    for i, x in enumerate(a.children, 1):
        above, here = best[i - 1], best[i]
        for j, y in enumerate(b.children, 1):
            most = above[j] if above[j] > here[j - 1] else here[j - 1]
            if x.label == y.label:
                most = max(most, above[j - 1] + matched(x, y, memo)[0])
            here[j] = most
    i, j, pairs = rows, cols, []
    while i and j:
        x, y = a.children[i - 1], b.children[j - 1]
        w = matched(x, y, memo)[0] if x.label == y.label else 0
        if w and best[i][j] == best[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            pairs.append((a.children[i], b.children[j]))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    memo[key] = (1 + best[rows][cols], pairs[::-1])
    return memo[key]


def merged(a: Node, b: Node, memo: dict | None = None) -> Node:
    """a with what only b has put between its children."""
    memo = {} if memo is None else memo
    partner = {id(y): x for x, y in matched(a, b, memo)[1]}
    out, i = [], 0
    for y in b.children:
        if x := partner.get(id(y)):
            while a.children[i] is not x:
                out.append(a.children[i])
                i += 1
            out.append(merged(x, y, memo))
            i += 1
        else:
            out.append(y)
    a.children = out + a.children[i:]
    return a


def folded(node: Node) -> tuple:
    """A tree as nested tuples (label, children), neighbours of one label merged; the tree itself changes."""
    return frozen(collapsed(node))


def collapsed(node: Node) -> Node:
    out: list[Node] = []
    for c in node.children:
        collapsed(c)
        if out and out[-1].label == c.label:
            merged(out[-1], c)
        else:
            out.append(c)
    node.children = out
    return node


def frozen(node: Node) -> tuple:
    return node.label, tuple(frozen(c) for c in node.children)


def thawed(shape) -> Node:
    out = Node(shape[0])
    out.children = [thawed(c) for c in shape[1]]
    return out


def numbered(tree: Node) -> Node:
    n, todo = 0, [tree]
    while todo:
        node = todo.pop()
        node.id, n = n, n + 1
        todo += reversed(node.children)
    return tree


def induced(shapes: list[tuple[str, int]]) -> str:
    """The template of skeletons (as JSON) with their counts, the commonest first."""
    tree = None
    for shape, _ in sorted(shapes, key=lambda x: (-x[1], x[0])):
        other = thawed(json.loads(shape))
        tree = merged(tree, other) if tree else other
    return json.dumps(frozen(tree))


class Aligner:
    """Finds the template node of each element of a page; remembers pages' shapes."""

    def __init__(self):
        self.templates: dict[str, Node] = {}

    def places(self, template: str, root: Node) -> dict[int, int]:
        """id() of each of the page's elements -> template node."""
        if template not in self.templates:
            if len(self.templates) > 1000:
                self.templates.clear()
            self.templates[template] = numbered(thawed(json.loads(template)))
        out, todo, memo = {}, [(root, self.templates[template])], {}
        while todo:
            node, slot = todo.pop()
            out[id(node)] = slot.id
            # Neighbours of one label stand for one node of the template.
            runs: list[list[Node]] = []
            for c in node.children:
                if runs and runs[-1][0].label == c.label:
                    runs[-1].append(c)
                else:
                    runs.append([c])
            heads = Node(node.label)
            heads.children = [r[0] for r in runs]
            memo[id(heads)] = heads  # keeps it, and so its id, while memo is used
            partner = {id(x): y for x, y in matched(heads, slot, memo)[1]}
            todo += [(c, partner[id(r[0])]) for r in runs if id(r[0]) in partner for c in r]
        return out


def pages_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, Node, list]]:
    for row in batch.to_pylist():
        yield row, *read(row["html"] or "")


def skeletons(pages: DataFrame) -> DataFrame:
    """host, shape, n: the skeletons of all pages."""

    def run(batches):
        found = Counter()
        for b in batches:
            for row, root, _ in pages_of(b):
                found[row["host"], json.dumps(folded(root))] += 1
        if found:
            yield pa.RecordBatch.from_pylist([{"host": h, "shape": s, "n": n} for (h, s), n in found.items()])

    return pages.mapInArrow(run, "host string, shape string, n long").groupBy("host", "shape").agg(F.sum("n").alias("n"))


def wrappers(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> host, template, constants: the hashes "node:crc32" of texts that most pages of a node share."""
    def induce(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"host": r["host"], "lot": r["lot"], "shape": induced([(s["shape"], s["n"]) for s in r["shapes"]]), "n": sum(s["n"] for s in r["shapes"])} for r in b.to_pylist()], schema=pa.schema([("host", pa.string()), ("lot", pa.int64()), ("shape", pa.string()), ("n", pa.int64())]))

    merging = skeletons(pages).withColumn("lot", F.crc32(F.col("shape").cast("binary")))
    for lots in LOTS:
        grouped = merging.groupBy("host", (F.col("lot") % lots).alias("lot")).agg(F.collect_list(F.struct("shape", "n")).alias("shapes"))
        merging = grouped.mapInArrow(induce, "host string, lot long, shape string, n long")
    templates = written(merging.select("host", F.col("shape").alias("template")))

    def count(batches):
        aligner = Aligner()
        for b in batches:
            found = {}
            for row, root, blocks in pages_of(b):
                if part := main_part(blocks):
                    places = aligner.places(row["template"], root)
                    key = row["host"], int.from_bytes(hashlib.blake2b("\n".join(x[1] for x in part).encode(), digest_size=8).digest(), "little", signed=True)
                    items = sorted(counted_of(part, places))
                    found[key] = min(found.get(key, items), items)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([k for _, k in found], pa.int64()), pa.array(found.values(), pa.list_(pa.int64()))], ["host", "main", "items"])

    distinct = joined(pages, templates).mapInArrow(count, "host string, main long, items array<long>").groupBy("host", "main").agg(F.min("items").alias("items"))
    counted = distinct.select("host", F.explode("items").alias("item")).groupBy("host", "item").agg(F.count("*").alias("pages"))
    counted = counted.select("host", F.shiftright("item", 33).alias("node"), F.when(F.col("item").bitwiseAND(WHOLE) > 0, -1).otherwise(F.col("item").bitwiseAND(WHOLE - 1)).alias("crc"), "pages")
    whole = counted.filter("crc = -1").select(F.col("host").alias("h"), F.col("node").alias("m"), F.col("pages").alias("all_pages"))
    texts = counted.filter((F.col("crc") >= 0) & (F.col("pages") >= FEWEST))
    constant = texts.join(whole, (F.col("host") == F.col("h")) & (F.col("node") == F.col("m"))).filter(F.col("pages") > F.col("all_pages") * SHARED)
    constants = constant.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "node", "crc"))), " ").alias("constants"))
    return templates.join(constants, "host", "left").withColumn("constants", F.coalesce("constants", F.lit("")))


def joined(pages: DataFrame, by_host: DataFrame) -> DataFrame:
    """pages with their host's row, which is broadcast if all of them are small; else adaptive execution splits hot hosts."""
    size = by_host.agg(F.sum(sum((F.octet_length(c) for c, kind in by_host.dtypes if kind == "string"), F.lit(0)))).first()[0] or 0
    return pages.join(F.broadcast(by_host) if size <= BROADCAST_BYTES else by_host, "host")


def main_part(blocks: list[tuple[list[Node], str, float, list[str]]]) -> list[tuple[list[Node], str, float, list[str]]]:
    """The blocks that names do not tell to be something else, and of these the ones within <article> or <main> if there are any."""
    kept = [x for x in blocks if not any(n.aside for n in x[0])]
    return [x for x in kept if any(n.main for n in x[0])] or kept


def targets(block: tuple[list[Node], str, float, list[str]]) -> list[int]:
    """The hashes of the targets of a block that consists of links."""
    return [zlib.crc32(b"\0" + t.encode()) for t in block[3]] if block[2] >= LINKED else []


def counted_of(part: list[tuple[list[Node], str, float, list[str]]], places: dict[int, int]) -> set[int]:
    """A page's template nodes, their texts and targets as numbers: the node, a bit for the node itself, and the text's or target's hash."""
    placed = [(places[id(x[0][-1])], x) for x in part if id(x[0][-1]) in places]
    return {node << 33 | crc for node, x in placed for crc in (WHOLE, zlib.crc32(x[1].encode()), *targets(x))}


def main_text(blocks: list[tuple[list[Node], str, float, list[str]]], places: dict[int, int], constants: set[str]) -> str:
    out = []
    for x in main_part(blocks):
        node, links = places.get(id(x[0][-1]), -1), targets(x)
        if f"{node}:{zlib.crc32(x[1].encode())}" not in constants and not (links and all(f"{node}:{t}" in constants for t in links)):
            out.append(x[1])
    return "\n".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    rows = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    wrapped = joined(rows, written(wrappers(rows.select("host", "html"))))

    def run(batches):
        aligner = Aligner()
        for b in batches:
            texts = []
            for row, root, blocks in pages_of(b.select(["html", "template", "constants"])):
                texts.append(main_text(blocks, aligner.places(row["template"], root), set(row["constants"].split())))
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return wrapped.select("page_id", "url", "html", "template", "constants").mapInArrow(run, "page_id long, url string, text string, n_chars long")
