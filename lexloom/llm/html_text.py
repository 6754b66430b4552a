"""HTML main text by wrapper induction.

Every page becomes a DOM of its block elements in which runs of like siblings are one repeated node.  Per host the most
common structure is the reference; every other structure is aligned with it by simple tree matching (largest
label-preserving, order-preserving map of the two trees).  Counts over all pages of the host then tell, for each
reference node, whether its text is the same on all pages that have it (template) or varies (slot).

The content region is the least block container of all varying slots; where more than the article varies from page to
page (menus and adverts do), the article or main element that holds a slot is taken instead, and nodes in boilerplate
roles (menus, headers, footers, sidebars, notices, adverts, forms, comments, by tag and class words) hold no slot.  From
the region go the template nodes: those with one text on at least ``SUPPORT`` different pages of the host, for fewer tell
nothing.  Templates alone cannot give right results: copies of a page make its article constant, and a page alone on its
host has no slot; such pages keep all that roles do not exclude.

The unit of alignment is a distinct (host, structure), so a host with any share of the pages costs partial sums only; a
structure's string is sent once and its hash with each node.

Edge cases: a null or empty html gives an empty text; a url without host counts as host ''; unclosed and unknown tags
are tolerated; of equally common structures the greatest string is the reference; trees deeper than ``DEPTH``, or of more
than ``NODES`` nodes, are not aligned with others and use their own slots, templates and roles; pages of any length are
read whole; repeated rows give a row each; an empty table gives an empty result; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

DEPTH, NODES = 100, 3000
#: Different pages (by a sketch of 64 bits) on which a template has the same text.
SUPPORT = 8
#: Rules up to this many travel to the tasks as one broadcast dictionary; more are joined.
MAX_RULES = 50_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: A start tag of the key closes an open element of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table"}
_NONE = (1 << 63) - 1
#: Blocks that hold running text, never a region of their own.
LEAVES = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "dt", "dd", "pre", "blockquote", "figcaption", "caption", "ul", "ol", "dl", "tbody", "thead"}
#: Blocks that hold running text, never a region of their own.
LEAVES = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "dt", "dd", "pre", "blockquote", "figcaption", "caption", "ul", "ol", "dl", "tbody", "thead"}
#: Blocks that hold running text, never a region of their own.
LEAVES = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "dt", "dd", "pre", "blockquote", "figcaption", "caption", "ul", "ol", "dl", "tbody", "thead"}
#: Blocks that hold running text, never a region of their own.
LEAVES = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "dt", "dd", "pre", "blockquote", "figcaption", "caption", "ul", "ol", "dl", "tbody", "thead"}
#: Blocks that hold running text, never a region of their own.
LEAVES = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "dt", "dd", "pre", "blockquote", "figcaption", "caption", "ul", "ol", "dl", "tbody", "thead"}
#: Roles that are never main text, by tag and by words of class, id and role.
DROP_TAGS = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head"}
DROP_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer",
    "sidebar", "aside", "complementary", "contentinfo", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "comment", "comments", "disqus", "reply", "replies",
    "share", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form", "toolbar", "pager", "pagination", "widget",
}
ATTR = re.compile(r"\b(class|id|role|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


class Node:
    __slots__ = ("drop", "kids", "tag", "texts")

    def __init__(self, tag: str, drop: bool):
        self.tag, self.drop, self.kids, self.texts = tag, drop, [], []


def _role(tag: str, attrs: str) -> bool:
    if tag in DROP_TAGS:
        return True
    if attrs and not attrs.isspace():
        for m in ATTR.finditer(attrs):
            if m[1].lower() == "hidden":
                return True
            value = m[2] or m[3] or m[4] or ""
            if DROP_WORDS & set(re.findall(r"[a-z]+", value.lower())) and not (tag in ("article", "main", "body", "html")):
                return True
    return False


def parse(html: str) -> Node:
    """Tree of block elements; ``texts`` of a node are its own blocks, as (number of kids before, text)."""
    root = Node("#", False)
    stack, buf = [root], []

    def flush() -> None:
        if buf:
            if text := " ".join("".join(buf).split()):
                stack[-1].texts.append((len(stack[-1].kids), text))
            buf.clear()

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            buf.append(entities.unescape(html[at:]))
            break
        if m.start() > at:
            buf.append(entities.unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in INLINE:
            if not m[1] and _role(tag, m[3]):  # an inline element in a dropped role, such as an advert's span
                flush()
                stack.append(Node(tag, True))
                stack[-2].kids.append(stack[-1])
            elif m[1] and stack[-1].tag == tag:
                flush()
                stack.pop()
            continue
        if tag in RAW and not m[1]:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
            buf.append(" ")
            continue
        if tag in VOID:
            if tag == "br":
                buf.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if stack[-1].tag == "p":
            stack.pop()
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SCOPE:
                    break
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                    break
        node = Node(tag, _role(tag, m[3]))
        stack[-1].kids.append(node)
        if not m[3].rstrip().endswith("/"):
            stack.append(node)
    flush()
    return root


def compress(root: Node) -> tuple[tuple, list[list[Node]]]:
    """Structure (label, kids) in which runs of like siblings are one kid, and the nodes behind each structure node in preorder."""
    order, todo = [], [root]
    while todo:
        order.append(n := todo.pop())
        todo.extend(n.kids)
    made: dict[int, tuple[tuple, list]] = {}
    for n in reversed(order):
        kids: list[tuple[tuple, list]] = []
        for k in n.kids:
            shape, behind = made.pop(id(k))
            if kids and kids[-1][0] == shape:
                kids[-1] = (shape, [a + b for a, b in zip(kids[-1][1], behind, strict=True)])
            else:
                kids.append((shape, behind))
        made[id(n)] = ((n.tag + "!" * n.drop, tuple(s for s, _ in kids)), [[n]] + [x for _, b in kids for x in b])
    return made[id(root)]


def write(shape: tuple) -> str:
    """A structure as text: label(kid kid)."""
    out, todo = [], [shape]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            out.append(x[0] + "(")
            todo.append(")")
            todo.extend(reversed(x[1]))
    return "".join(out)


def read(sig: str) -> tuple[list[str], list[list[int]], int]:
    """Labels and kids of a written structure in preorder, and its depth."""
    labels, kids, stack, deep = [], [], [], 0
    for label in re.findall(r"([^()]+)\(|\)", sig):
        if not label:
            stack.pop()
            continue
        if stack:
            kids[stack[-1]].append(len(labels))
        stack.append(len(labels))
        labels.append(label)
        kids.append([])
        deep = max(deep, len(stack))
    return labels, kids, deep


@lru_cache(maxsize=4096)
def match(a: str, b: str) -> dict[int, int]:
    """Simple tree matching: node of structure a -> node of structure b."""
    (la, ka, da), (lb, kb, db) = read(a), read(b)
    if a == b:
        return {k: k for k in range(len(la))}
    if max(da, db) > DEPTH or max(len(la), len(lb)) > NODES:
        return {}
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def best(x: int, y: int) -> tuple[int, list[tuple[int, int]]]:
        if la[x] != lb[y]:
            return 0, []
        if (x, y) not in memo:
            p, q = ka[x], kb[y]
            m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
            for i in range(len(p)):
                for j in range(len(q)):
                    m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + best(p[i], q[j])[0])
            pairs, i, j = [], len(p), len(q)
            while i and j:
                if m[i][j] == m[i - 1][j]:
                    i -= 1
                elif m[i][j] == m[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((p[i], q[j]))
            memo[x, y] = m[-1][-1] + 1, pairs
        return memo[x, y]

    out, todo = {}, [(0, 0)] if best(0, 0)[0] else []
    while todo:
        x, y = todo.pop()
        out[x] = y
        todo.extend(best(x, y)[1])
    return out


def region(sig: str, varies: set[int]) -> list[int]:
    """Nodes of a structure whose text is the content, given its varying slots."""
    labels, kids, _ = read(sig)
    up = {k: p for p, ks in enumerate(kids) for k in ks}

    def line(k: int) -> list[int]:
        out = [k]
        while out[-1] in up:
            out.append(up[out[-1]])
        return out

    lines = {k: line(k) for k in range(len(labels))}
    open_ = [k for k in lines if not any(labels[x].endswith("!") for x in lines[k])]
    slots = [k for k in open_ if k in varies] or open_
    for tag in ("article", "main"):
        if found := [k for k in open_ if labels[k] == tag and not any(labels[x] == tag for x in lines[k][1:]) and any(k in lines[s] for s in slots)]:
            return found
    common = None
    for s in slots:
        held = set(lines[s])
        common = lines[s] if common is None else [x for x in common if x in held]
    common = [x for x in common or [0] if labels[x] not in LEAVES]
    return common[:1] or [0]


def template(sig: str, varies: set[int], constant: set[int]) -> list[int]:
    """Constant nodes of a structure no part of which varies, the uppermost of each."""
    labels, kids, _ = read(sig)
    live = [k in varies for k in range(len(labels))]
    for k in range(len(labels) - 1, -1, -1):
        live[k] = live[k] or any(live[x] for x in kids[k])
    return [k for k in sorted(constant) if not live[k]]


def _text(nodes: list[Node]) -> str:
    out: list[str] = []
    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.drop:
            parts: list = []
            at = 0
            for before, text in x.texts:
                parts += x.kids[at:before]
                at = before
                parts.append(text)
            parts += x.kids[at:]
            todo.extend(reversed(parts))
    return "\n".join(out)


def _own(n: Node) -> str:
    return "\n".join(t for _, t in n.texts)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and structure of a batch: its string, at node 0, and for each node (a run's texts together) pages, least and greatest text hash, and a sketch of the different pages."""
    import xxhash

    for b in batches:
        seen: dict[tuple[str, str], list] = {}
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            shape, behind = compress(parse(html or ""))
            each = [xxhash.xxh64_intdigest(t) >> 1 if (t := "\n\n".join(filter(None, map(_own, ns)))) else None for ns in behind]
            low, high = [_NONE if x is None else x for x in each], [x or 0 for x in each]
            bit = 1 << xxhash.xxh64_intdigest(repr(each)) % 63
            sig = write(shape)
            s = seen.setdefault((host, sig), [0, low, high, 0])
            seen[host, sig] = [s[0] + 1, list(map(min, s[1], low)), list(map(max, s[2], high)), s[3] | bit]
        rows = [(host, _key(sig), None if k else sig, n, k, lo[k], hi[k], bits) for (host, sig), (n, lo, hi, bits) in seen.items() for k in range(len(lo))]
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "k", "sig", "n", "node", "lo", "hi", "bits"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        host, sig, ref, nodes = (b.column(k).to_pylist() for k in range(4))
        rows = []
        for h, s, r, xs in zip(host, sig, ref, nodes, strict=True):
            to = match(s, r)
            rows += [(h, to[x["node"]], x["lo"], x["hi"], x["bits"]) for x in xs if x["node"] in to]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["host", "node", "lo", "hi", "bits"])


def _kinds(nodes: list[dict]) -> tuple[set[int], set[int]]:
    """Varying and constant nodes: a text in one place on SUPPORT different pages is constant, on fewer it is neither."""
    varies = {x["node"] for x in nodes if x["lo"] < x["hi"]}
    return varies, {x["node"] for x in nodes if x["lo"] == x["hi"] and x["bits"].bit_count() >= SUPPORT}


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        host, sig, ref, told, nodes = (b.column(k).to_pylist() for k in range(5))
        keys, rules, outs = [], [], []
        for s, r, t, own in zip(sig, ref, told, nodes, strict=True):
            back = {y: x for x, y in match(s, r).items()}
            varies, constant = _kinds(t or [])
            here, alone = {back[k] for k in varies if k in back}, _kinds([x for x in own if x["node"] not in set(back.values())])
            found = [back[k] for k in region(r, varies) if k in back]
            labels = read(s)[0]
            keys.append(_key(s))
            rules.append(sorted(found if found and labels[found[0]] not in ("#", "html", "body") else region(s, here | (set() if back else alone[0]))))
            outs.append(template(s, here | alone[0], {back[k] for k in constant if k in back} | alone[1]))
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(keys, pa.int64()), pa.array(rules, pa.list_(pa.int32())), pa.array(outs, pa.list_(pa.int32()))], ["host", "k", "rule", "out"])


def _key(sig: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(sig) >> 1


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, k, rule, out): for every host and structure the structure nodes that are content, and those in them that are template."""
    rows = pages.select("host", "html").mapInArrow(_stats, "host string, k long, sig string, n long, node int, lo long, hi long, bits long")
    by = checkpoint(rows.groupBy("host", "k", "node").agg(F.max("sig").alias("sig"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("bits").alias("bits")))
    ref = by.where("node = 0").groupBy("host").agg(F.max(F.struct("n", "sig"))["sig"].alias("ref"))
    node = F.struct("node", "lo", "hi", "bits")
    shapes = by.groupBy("host", "k").agg(F.max("sig").alias("sig"), F.collect_list(node).alias("nodes")).join(ref, "host")
    told = shapes.select("host", "sig", "ref", "nodes").mapInArrow(_align, "host string, node int, lo long, hi long, bits long")
    told = told.groupBy("host", "node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("bits").alias("bits")).groupBy("host").agg(F.collect_list(node).alias("told"))
    return shapes.join(told, "host", "left").select("host", "sig", "ref", "told", "nodes").mapInArrow(_decide, "host string, k long, rule array<int>, out array<int>")


def _extractor(rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            given = zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True) if rules is None else [None] * len(b)
            for host, html, rule in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), given, strict=True):
                shape, behind = compress(parse(html or ""))
                content, out = rules.value[host, _key(write(shape))] if rules is not None else rule
                for k in out:
                    for n in behind[k]:
                        n.drop = True
                texts.append(_text([n for k in content for n in behind[k]]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k = [_key(write(compress(parse(x or ""))[0])) for x in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k, pa.int64())], ["page_id", "url", "host", "html", "k"])


def extract(pages: DataFrame, max_rules: int = MAX_RULES, induced: bool = True) -> DataFrame:
    """(page_id, url, text) for every row; without induction every page is judged by roles alone."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.regexp_extract(F.lower("url"), HOST, 1), F.lit("")).alias("host"), F.col("html").cast("string").alias("html"))
    if not induced:
        return p.mapInArrow(_by_roles, "page_id long, url string, text string")
    rules = checkpoint(wrappers(p))
    out = "page_id long, url string, text string"
    if rules.count() <= max_rules:
        found = {(r["host"], r["k"]): (r["rule"], r["out"]) for r in rules.collect()}
        return p.mapInArrow(_extractor(pages.sparkSession.sparkContext.broadcast(found)), out)
    keyed = p.mapInArrow(_keys, "page_id long, url string, host string, html string, k long")
    return keyed.join(rules, ["host", "k"]).select("page_id", "url", "host", "html", "rule", "out").mapInArrow(_extractor(None), out)


def _by_roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for html in b.column(3).to_pylist():
            shape, behind = compress(parse(html or ""))
            texts.append(_text([n for k in region(write(shape), set()) for n in behind[k]]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
