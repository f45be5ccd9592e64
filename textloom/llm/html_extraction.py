"""Main text of web pages by wrapper induction.

Pages of a host share a wrapper. Each page's block elements form a tree in which neighbours of equal shape are one repeated node.
The most frequent tree of a host is its reference; every other tree is aligned with it by simple tree matching (the matching
of most nodes that keeps labels, parents and the order of siblings). A text that stands in one and the same node on at least
``TEMPLATE_SHARE`` of a host's different pages (and ``TEMPLATE_PAGES`` of them) is template; what varies is content. Pages with the
same body count once, so copies of an article never turn it into template.

Varying menus, adverts and the like are told by their element, class, id or role; the content is then taken from the article or
main element, or from the element that holds most running text. Character references are decoded, white space inside
a block is one space, blocks are joined by one newline in page order.

A null or empty page has an empty text. A null url, or one without a host, belongs to the empty host. Repeated pages are extracted
each. Extra columns are kept where ``keep`` names them. An empty table gives an empty result.
"""

from __future__ import annotations

import html as html_entities
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, saved
from .url_filter import host_and_path

TEMPLATE_SHARE = 0.5
TEMPLATE_PAGES = 3
SALTS = 16
MAX_DEPTH = 120

# Element names of the HTML standard by their use here, and common names of page parts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {  # an open element of this name ends where one of these begins
    "p": BLOCK - {"body", "head", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
KEEPS_OPEN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
DROPPED = set("head nav footer aside form button select option label dialog menu fieldset object canvas audio video".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PARTS = set(
    "nav navbar navigation menu sidebar ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus reply replies respond share sharing "
    "social related recommended recommendations newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination "
    "pager footer masthead toolbar widget widgets skip search copyright legal disclaimer hidden teaser teasers trending".split()
)
ROLES = set("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
MAIN_NAMES = set("article content post entry story main articlebody".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^>]*>",
    re.DOTALL,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    name: str
    attributes: str
    parent: Node | None
    depth: int = 0
    children: list = field(default_factory=list)  # nodes and texts
    shape: str = ""
    slot: int = 0

    def attribute_values(self) -> dict[str, str]:
        if "=" not in self.attributes and " hidden" not in self.attributes:
            return {}
        found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(self.attributes)}
        if re.search(r"\shidden(\s|>|/|=)", self.attributes):
            found["hidden"] = found.get("hidden") or "hidden"
        return found


def parse(page: str) -> Node:
    """Element tree of a page; unclosed and stray tags are put right by a few rules of the standard."""
    root = Node("#root", "", None)
    at, end, here = 0, len(page), root
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at : m.start()])
        tag, at = m.group(), m.end()
        if tag[1] in "!?":
            if tag.startswith("<![CDATA["):
                here.children.append(tag[9:].removesuffix("]]>"))
            continue
        name = _NAME.match(tag)[1].lower()
        if tag[1] == "/":
            n = here
            while n is not None and n.name != name:
                n = n.parent
            if n is not None and n.parent is not None:
                here = n.parent
            continue
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}[^>]*>", re.IGNORECASE).search(page, at)
            if not tag.endswith("/>"):
                at = close.end() if close else (end if name in ("script", "style") else at)
            continue
        n = here
        while n is not None and n.name != "#root":
            if name in CLOSED_BY.get(n.name, ()):
                here = n.parent
                break
            if n.name in KEEPS_OPEN.get(name, ()) or n.name in ("article", "body", "div", "section", "main", "blockquote", "table"):
                break
            n = n.parent
        node = Node(name, tag, here, here.depth + 1)
        here.children.append(node)
        # Elements nested deeper than any layout needs stay side by side; their texts are kept.
        if name not in VOID and not tag.endswith("/>") and node.depth < MAX_DEPTH:
            here = node
    return root


def _label(n: Node) -> str:
    values = n.attribute_values()
    own = ".".join(sorted(set(re.sub(r"\d+|[(),]", "", f"{values.get('class', '')} {values.get('id', '')}").split())))
    return f"{n.name}.{own}" if own else n.name


def shape(root: Node) -> list:
    """Folded tree ``[label, kids]`` of the block elements; sets each element's slot, its number in the folded tree."""

    def blocks(n: Node) -> Iterator[Node]:
        for c in n.children:
            if isinstance(c, Node):
                if c.name in BLOCK:
                    yield c
                else:
                    yield from blocks(c)

    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append((n, list(blocks(n))))
        stack.extend(order[-1][1])
    kids_of = {id(n): kids for n, kids in order}
    for n, kids in reversed(order):
        runs = [k.shape for i, k in enumerate(kids) if i == 0 or k.shape != kids[i - 1].shape]
        n.shape = _label(n) + (f"({','.join(runs)})" if runs else "")

    count = 0

    def number(same: list[Node]) -> list:
        nonlocal count
        for n in same:
            n.slot = count
        count += 1
        out, groups = [_label(same[0]), []], []
        for n in same:
            kids, i = kids_of[id(n)], 0
            runs: list[list[Node]] = []
            for k in kids:
                if runs and runs[-1][0].shape == k.shape:
                    runs[-1].append(k)
                else:
                    runs.append([k])
            for i, r in enumerate(runs):
                if i < len(groups):
                    groups[i] += r
                else:
                    groups.append(list(r))
        out[1] = [number(g) for g in groups]
        return out

    return number([root])


def as_text(tree: list) -> str:
    return tree[0] + (f"({','.join(map(as_text, tree[1]))})" if tree[1] else "")


def from_text(text: str) -> list:
    root = ["", []]
    stack = [root]
    for token in re.split(r"([(),])", text):
        if token == "(":
            stack.append(stack[-1][1][-1])
        elif token == ")":
            stack.pop()
        elif token and token != ",":
            stack[-1][1].append([token, []])
    return root[1][0]


def _numbered(tree: list, out: list | None = None) -> list:
    out = [] if out is None else out
    out.append(tree)
    for k in tree[1]:
        _numbered(k, out)
    return out


def _in_order(left: list[int], right: list[int], weigh: Callable[[int, int], int], pairs: bool) -> tuple[int, list[tuple[int, int]]]:
    """Largest weight of pairs of siblings that keep their order, and the places of the pairs if asked for.

    Every row of sums follows from the one before. Only one in ``step`` of them is held, and those between are made again on the way back.
    """
    kinds = {y: i for i, y in enumerate(dict.fromkeys(right))}
    columns = [kinds[y] for y in right]
    known: dict[int, list | np.ndarray] = {}
    wide = len(right) > 100  # whole rows are faster as arrays there; the sums are the same

    def after(row, x: int):
        if x not in known:
            each = [weigh(x, y) for y in kinds]
            known[x] = np.array(each, np.int32) if wide else [each[c] for c in columns]
        if wide:
            return np.concatenate([[0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + known[x][columns]))])
        return [0, *accumulate(map(max, row[1:], map(add, row, known[x])), max)]

    step = math.isqrt(len(left)) + 1
    row, held = np.zeros(len(right) + 1, np.int32) if wide else [0] * (len(right) + 1), []
    for i, x in enumerate(left):
        if pairs and i % step == 0:
            held.append(row)
        row = after(row, x)
    found, size, j = [], int(row[-1]), len(right)
    for first in reversed(range(0, len(left) if pairs else 0, step)):
        rows = [held.pop()]
        for x in left[first : first + step]:
            rows.append(after(rows[-1], x))
        i = len(rows) - 1
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((first + i, j))
    return size, found


def match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest matching and its pairs of node identities.

    Trees of equal shape have one number, so the sizes of two shapes are worked out once, however often they meet.
    """
    numbers: dict[tuple, int] = {}
    number: dict[int, int] = {}
    shapes: list[tuple[str, list[int], int]] = []  # label, children and nodes
    sizes: dict[tuple[int, int], int] = {}

    def count(tree: list) -> int:
        kids = [count(k) for k in tree[1]]
        own = number[id(tree)] = numbers.setdefault((tree[0], *kids), len(shapes))
        if own == len(shapes):
            shapes.append((tree[0], kids, 1 + sum(shapes[k][2] for k in kids)))
        return own

    def size(x: int, y: int) -> int:
        (name, left, nodes), (other, right, _) = shapes[x], shapes[y]
        if x == y or name != other:
            return nodes if x == y else 0
        if not left or not right:
            return 1
        found = sizes.get((x, y))
        if found is None:
            found = _in_order(left, right, size, False)[0] + 1
            if len(sizes) > 1_000_000:
                sizes.clear()
            sizes[x, y] = found
        return found

    if a[0] != b[0]:
        return 0, []
    count(a), count(b)
    pairs, rest = [], [(a, b)]
    while rest:
        x, y = rest.pop()
        pairs.append((id(x), id(y)))
        if number[id(x)] == number[id(y)]:
            rest += zip(x[1], y[1])
        elif x[1] and y[1]:
            rest += [(x[1][i], y[1][j]) for i, j in _in_order(*([number[id(k)] for k in n[1]] for n in (x, y)), size, True)[1]]
    return len(pairs), pairs


_ALIGNED: dict[tuple[str, str], list[int]] = {}


def align(own: str, reference: str) -> list[int]:
    """Wrapper slot of each slot of a tree; a node without a partner has a slot of its own, below zero."""
    import xxhash

    key = (own, reference)
    if key not in _ALIGNED:
        if len(_ALIGNED) > 20_000:
            _ALIGNED.clear()
        a, b = from_text(own), from_text(reference)
        to = {id(n): i for i, n in enumerate(_numbered(b))}
        partner = {x: to[y] for x, y in match(a, b)[1]}
        out, path = [], {id(a): a[0]}
        for n in _numbered(a):
            for k in n[1]:
                path[id(k)] = f"{path[id(n)]}/{k[0]}"
            out.append(partner.get(id(n), -1 - (xxhash.xxh64_intdigest(path[id(n)]) >> 2)))
        _ALIGNED[key] = out
    return _ALIGNED[key]


@dataclass(slots=True)
class Block:
    text: str
    slot: int
    linked: int  # characters inside links
    part: bool  # inside a menu, an advert, a footer ...
    inside: tuple[Node, ...]  # elements around it that may be the content


def _part(n: Node, in_article: bool) -> bool:
    if n.name in DROPPED:
        return True
    values = n.attribute_values()
    if not values:
        return False
    if values.get("role", "").lower() in ROLES or "hidden" in values or values.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")):
        return True
    if n.name in ("html", "body", "main") or (n.name == "article" and not in_article and "comment" not in values.get("class", "")):
        return False
    return any(w.lower() in PARTS for w in _NAMES.findall(f"{values.get('class', '')} {values.get('id', '')}"))


def _header(n: Node) -> bool:
    return n.name == "header" or "header" in [w.lower() for w in _NAMES.findall(n.attribute_values().get("class", ""))]


def _main(n: Node) -> bool:
    return n.name in ("article", "main", "body", "div", "section", "td")


def blocks(root: Node) -> list[Block]:
    """All texts of a page, block by block in page order."""
    out: list[Block] = []
    text: list[str] = []
    linked = 0

    def flush(slot: int, part: bool, inside: tuple[Node, ...]) -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", html_entities.unescape("".join(text))).strip()
            if whole:
                out.append(Block(whole, slot, linked, part, inside))
            text.clear()
        linked = 0

    def walk(n: Node, slot: int, part: bool, head: bool, link: bool, inside: tuple[Node, ...]) -> None:
        nonlocal linked
        for c in n.children:
            if isinstance(c, str):
                text.append(c)
                if link:
                    linked += len(c.strip())
                continue
            if c.name == "br":
                text.append("\n")
                continue
            in_article = any(x.name == "article" for x in inside)
            own_part = part or _part(c, in_article)
            own_head = head or _header(c)
            # Of a header only a heading inside an article belongs to the text.
            hidden = own_part or (own_head and not (in_article and c.name in HEADINGS))
            around = (*inside, c) if _main(c) else inside
            if c.name in BLOCK:
                flush(slot, part or (head and n.name not in HEADINGS), inside)
                walk(c, c.slot, own_part, own_head and c.name not in HEADINGS, link, around)
                flush(c.slot, hidden, around)
            elif own_part and not part:
                flush(slot, part or head, inside)
                walk(c, slot, True, own_head, link, inside)
                flush(slot, True, inside)
            else:
                walk(c, slot, own_part, own_head, link or c.name == "a", inside)

    walk(root, root.slot, False, False, False, (root,))
    flush(root.slot, False, (root,))
    return out


def content(found: list[Block]) -> list[Block]:
    """The blocks of the main text: those in the article, or else where most of the running text is."""
    rest = [b for b in found if not b.part]
    if not rest:
        return []
    mass: dict[int, int] = {}
    nodes: dict[int, Node] = {}
    for b in rest:
        for n in b.inside:
            nodes[id(n)] = n
            mass[id(n)] = mass.get(id(n), 0) + max(0, len(b.text) - 2 * b.linked)
    for wanted in ("article", "main", "role", "named"):
        def fits(n: Node) -> bool:
            values = n.attribute_values()
            if wanted == "role":
                return values.get("role") == "main" or "articleBody" in values.get("itemprop", "")
            if wanted == "named":
                return bool(MAIN_NAMES & {w.lower() for w in re.split(r"[^a-zA-Z]+", f"{values.get('class', '')} {values.get('id', '')}")})
            return n.name == wanted

        some = [i for i, n in nodes.items() if fits(n) and mass[i] > 0]
        if some:
            top = max(some, key=lambda i: mass[i])
            return [b for b in rest if any(id(n) == top for n in b.inside)]
    total = max(mass.values())
    deep = {i: len([1 for _ in _ancestors(nodes[i])]) for i in mass}
    top = max((i for i in mass if mass[i] >= 0.7 * total), key=lambda i: deep[i])
    return [b for b in rest if any(id(n) == top for n in b.inside) and 2 * b.linked <= len(b.text)]


def _ancestors(n: Node) -> Iterator[Node]:
    while n.parent is not None:
        n = n.parent
        yield n


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def digest(text: str) -> int:
    import xxhash

    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def key_of(slot: int, text_digest: int) -> int:
    """One number for a text in a wrapper slot."""
    return digest(f"{slot} {text_digest}")


def features(pages: DataFrame, html: str, url: str) -> DataFrame:
    """One row per host and page body: ``host, body, tree, slots, texts`` (hashes of the texts that stand in the slots)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, trees, slots, texts = [], [], [], []
            for page in b.column(1).to_pylist():
                root = parse(page or "")
                trees.append(as_text(shape(root)))
                found = blocks(root)
                bodies.append(digest("\n".join(x.text for x in content(found))))
                kept = {(x.slot, digest(x.text)) for x in found if not x.part}
                slots.append([s for s, _ in kept])
                texts.append([t for _, t in kept])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(bodies, pa.int64()), pa.array(trees, pa.string()), pa.array(slots, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.int64()))],
                names=["host", "body", "tree", "slots", "texts"],
            )

    rows = pages.select(host_and_path(url)[0].alias("host"), F.col(html).alias("html"))
    rows = rows.mapInArrow(run, "host string, body bigint, tree string, slots array<int>, texts array<bigint>")
    # Pages with the same body count once; each task sends one of them.
    return rows.groupBy("host", "body").agg(F.min(F.struct("tree", "slots", "texts")).alias("page")).select("host", "body", "page.*")


def wrappers(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One row per host: ``host, reference, template`` (keys of the constant texts in their wrapper slots)."""
    bound_batches(pages.sparkSession)
    seen = saved(features(pages, html, url), "page-features")
    trees = seen.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"))
    hosts = saved(
        trees.groupBy("host").agg(F.max_by("tree", F.struct("n", "tree")).alias("reference"), F.sum("n").alias("pages")), "hosts"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, keys = [], []
            for row in b.to_pylist():
                to = align(row["tree"], row["reference"])
                own = {key_of(to[s], t) for s, t in zip(row["slots"], row["texts"])}
                host += [row["host"]] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(keys, pa.int64())], names=["host", "key"])

    texts = seen.join(hosts, "host").select("host", "tree", "reference", "slots", "texts").mapInArrow(run, "host string, key bigint")
    counts = texts.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TEMPLATE_PAGES)
    constant = counts.join(hosts.select("host", "pages"), "host").where(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    # At least TEMPLATE_SHARE of a host's pages hold each text, so a host has few.
    template = constant.groupBy("host").agg(F.collect_list("key").alias("template"))
    return saved(hosts.join(template, "host", "left").select("host", "reference", "template"), "wrappers")


def extract(
    pages: DataFrame, wrapped: DataFrame | None = None, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url")
) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars``.

    Pages meet their host's wrapper in a join whose key is salted, so a host with a third of all pages is many keys; while the
    wrappers' files are below the session's threshold Spark broadcasts them and the pages stay where they are.
    """
    bound_batches(pages.sparkSession)
    wrapped = wrappers(pages, html, url) if wrapped is None else wrapped
    many = wrapped.select(F.col("host").alias("_host"), "reference", "template", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64(F.col(url), F.octet_length(F.col(html))), F.lit(SALTS)).cast("int")
    rows = pages.select(
        *[F.col(k).alias(f"_keep_{i}") for i, k in enumerate(keep)], F.col(html).alias("_html"), host_and_path(url)[0].alias("_host"), salt.alias("_salt")
    ).join(many, ["_host", "_salt"], "left").drop("_host", "_salt")
    kinds = [(k, rows.schema[f"_keep_{i}"].dataType.simpleString()) for i, k in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_html", "reference", "template")]
            for page, reference, template in zip(*columns):
                root = parse(page or "")
                tree = as_text(shape(root))
                found = content(blocks(root))
                if template:
                    to, constant = align(tree, reference), set(template)
                    found = [x for x in found if key_of(to[x.slot], digest(x.text)) not in constant]
                texts.append("\n".join(x.text for x in found))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    return rows.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in kinds) + ", text string, n_chars bigint")
