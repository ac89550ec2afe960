"""HTML extraction by wrapper induction over the pages of a host."""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.llm.common import bounded, read, settled, stored

#: A node is template if it is the same on SHARE of the pages that have its slot, on at least PAGES different ones.
PAGES, SHARE = 4, 0.8

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CAMEL = re.compile(r"([a-z])([A-Z])")

#: Fixed values of the HTML standard.
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "select", "title", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"html", "body", "p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "fieldset", "details", "summary", "hr", "header", "footer", "nav", "aside", "form", "center", "menu", "dialog", "head", "hgroup", "search", "legend"}
_ENDS_LIKE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"})}
#: Elements, roles and words in class names that stand around an article.
_AROUND = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "button", "search", "fieldset"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
_NAMES = {"nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "masthead", "topbar", "footer", "footers", "sidebar", "sidebars", "aside", "widget", "widgets", "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "sponsor", "sponsors", "sponsored", "promo", "promos", "promotion", "banner", "banners", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "notifications", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "related", "recommended", "recommendations", "pagination", "pager", "toolbar", "copyright", "form", "search", "skip", "paywall", "teaser", "teasers"}
#: Of these names, those that are also words of subjects: they count only beside words of layouts (``ad-slot``, not ``social-studies``).
_SUBJECTS = {"social", "notice", "notices", "share", "sharing", "form", "search", "reply", "replies", "banner", "banners", "menu", "menus", "related", "respond", "copyright", "login", "ad", "sponsor", "sponsors", "promotion", "consent", "footers"}
_LAYOUT = {"slot", "box", "bar", "block", "container", "wrapper", "wrap", "inner", "outer", "top", "bottom", "left", "right", "middle", "main", "site", "page", "list", "item", "items", "area", "section", "panel", "primary", "secondary", "global", "link", "links", "icon", "icons", "button", "buttons", "content", "post", "posts", "article", "articles", "entry", "body", "text", "unit", "units", "row", "col", "column", "grid", "group", "media", "widget", "small", "large", "fixed", "sticky", "mobile", "desktop", "user", "reader", "news", "stories", "tools", "actions", "zone", "placeholder", "frame", "module", "region", "info", "note", "line", "bottombar", "rail", "id", "js", "ui", "c", "m", "l", "s", "x", "js", "new", "your", "our", "by", "for", "us"}
_HEADS = {"header", "headers"}
_DIVIDES = {"html", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form"}
_WITH = {"with", "has", "no", "without", "is", "js"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}


class Node:
    """An element with block children, or (tag '#') a run of inline text."""

    __slots__ = ("tag", "label", "role", "kids", "text", "linked", "shape", "digest", "size", "dropped")

    def __init__(self, tag: str, label: str = "", role: str = ""):
        self.tag, self.label, self.role = tag, label or tag, role
        self.kids: list[Node] = []
        self.text, self.linked, self.dropped = "", 0, False


def names_around(parts: list[str]) -> bool:
    """Whether the words of a class name or id are those of something around an article."""
    found = _NAMES.intersection(parts)
    return bool(found - _SUBJECTS) or bool(found) and all(x in _NAMES or x in _LAYOUT or x in _HEADS or not x or x.isdigit() for x in parts)


def look(tag: str, attrs: str) -> tuple[str, str]:
    """Label of an element (its tag and class names) and its role: '' (may hold content), 'around' or 'head'."""
    role = "around" if tag in _AROUND else "head" if tag in _HEADS else ""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return tag, role
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    names = f"{got.get('class', '')} {got.get('id', '')}".split()
    if tag not in ("html", "body", "article", "main") or any(x in {"comment", "comments", "ad", "ads", "teaser", "related"} for x in names):
        if "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", "")) or got.get("role", "").lower() in _ROLES:
            role = "around"
        for name in names:
            parts = re.split(r"[^a-z0-9]+", _CAMEL.sub(r"\1-\2", name).lower())
            if parts[0] not in _WITH:
                role = "around" if names_around(parts) else role or ("head" if _HEADS.intersection(parts) else "")
    return (f"{tag}.{'.'.join(sorted(got.get('class', '').split()))}" if got.get("class") else tag), ("main" if got.get("role", "").lower() == "main" and not role else role)


def parse(html: str) -> Node:
    """The page's tree of block elements; comments, scripts, styles and the like are left out, references decoded, white space folded."""
    root = Node("#root")
    stack, inline = [root], []  # open block elements; open inline elements
    run: list[str] = []
    linked, links = [0], 0

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                leaf = Node("#")
                leaf.text, leaf.linked = text, min(len(text), linked[0])
                stack[-1].kids.append(leaf)
        linked[0] = 0

    def close(at: int) -> None:
        flush()
        del stack[at:]

    at, hidden = 0, 0
    find, n = _TAG.search, len(html)
    while at < n:
        m = find(html, at)
        s = html[at : m.start() if m else n]
        if s:
            s = entities.unescape(s) if "&" in s else s
            run.append(s)
            if links:
                linked[0] += len(s.strip())
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, end, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in _RAW and not end:
            if not attrs.rstrip().endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = stop.end() if stop else n
            if tag == "select":
                run.append(" ")
        elif tag == "br":
            run.append(" ")
        elif tag not in _BLOCK:
            if tag == "a":
                links = 0 if end else 1
            elif tag in ("button", "label", "option") or not end and tag not in _VOID and attrs and look(tag, attrs)[1] == "around":
                # an inline element that holds no content: its own node, closed by its end tag
                if end:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == tag:
                            close(k)
                            break
                else:
                    flush()
                    node = Node(tag, "", "around")
                    stack[-1].kids.append(node)
                    stack.append(node)
            elif end:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag in _BLOCK:
                        break
        elif end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            else:
                flush()
        else:
            flush()
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK and stack[k].tag not in _HEADINGS:
                    break
            if tag in _ENDS_LIKE:
                like, scope = _ENDS_LIKE[tag]
                last = 0
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in scope:
                        break
                    if stack[k].tag in like:
                        last = k
                if last:
                    del stack[last:]
            if tag in ("html",) and len(stack) > 1 or tag == "body" and any(x.tag == "body" for x in stack):
                continue
            label, role = look(tag, attrs)
            node = Node(tag, label, role)
            stack[-1].kids.append(node)
            if tag not in _VOID and not (attrs.rstrip().endswith("/") and tag == "hr"):
                stack.append(node)
    flush()
    if "<form" in html or "<FORM" in html:
        unwrap(root)
    return root


def preorder(root: Node) -> list[Node]:
    """All nodes below and including ``root`` in page order, however deep; reversed, children come before parents."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.kids))
    return out


def unwrap(root: Node) -> None:
    """A form around a whole page, as some servers write it, isn't one: it holds an article, a main element or a first heading."""
    holding: set[int] = set()
    for node in reversed(preorder(root)):
        if any(x.tag in ("article", "main", "h1") or id(x) in holding for x in node.kids):
            holding.add(id(node))
            if node.tag == "form" and node.role == "around":
                node.role = ""


def outline(root: Node) -> list:
    """[label, digest of all below, children] of a tree without its head."""
    made: dict[int, list] = {}
    for node in reversed(preorder(root)):
        if node.tag == "#":
            made[id(node)] = ["#", xxhash.xxh64_intdigest(node.text), []]
        else:
            kids = [made[id(x)] for x in node.kids if x.tag != "head"]
            made[id(node)] = [node.label, xxhash.xxh64_intdigest(f"{node.label}({','.join(str(x[1]) for x in kids)})"), kids]
    return made[id(root)]


def nodes_of(o: list) -> list[list]:
    """Nodes of an outline in page order."""
    out, todo = [], [o]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(reversed(x[2]))
    return out


def anchored(x: list[list], y: list[list]) -> list[tuple[int, int]]:
    """Places in two lists of siblings that map onto each other because they are equal in all below and alone so in either, in order."""
    at: dict[int, list[list[int]]] = {}
    for side, kids in enumerate((x, y)):
        for i, k in enumerate(kids):
            at.setdefault(k[1], [[], []])[side].append(i)
    both = sorted((i[0], j[0]) for i, j in at.values() if len(i) == len(j) == 1)
    ends: list[int] = []  # the longest run of rising places in y (patience sorting)
    last: list[int] = []
    before = [-1] * len(both)
    for k, (_, j) in enumerate(both):
        n = bisect.bisect_left(ends, j)
        ends[n:] = [j] if n == len(ends) else [j, *ends[n + 1 :]]
        last[n:] = [k] if n == len(last) else [k, *last[n + 1 :]]
        before[k] = last[n - 1] if n else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(both[k])
        k = before[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[list, list]]:
    """Simple tree matching of two outlines: pairs of nodes, with labels, parents and order kept.

    Siblings equal in all below are matched first; between them, and at the ends, the longest common sequence of labels is matched, level by
    level from the roots, by a table of one byte per pair of siblings that are left. No call nests, so depth doesn't matter.
    """
    out: list[tuple[list, list]] = []
    todo = [(a, b)] if a[0] == b[0] else []
    while todo:
        p, q = todo.pop()
        if p[1] == q[1]:
            out += zip(nodes_of(p), nodes_of(q), strict=True)
            continue
        out.append((p, q))
        x, y = p[2], q[2]
        fixed = [*anchored(x, y), (len(x), len(y))]
        i = j = 0
        for m, n in fixed:
            todo += [(x[i + r], y[j + c]) for r, c in in_order([k[0] for k in x[i:m]], [k[0] for k in y[j:n]])]
            if m < len(x):
                todo.append((x[m], y[n]))
            i, j = m + 1, n + 1
    return out


def in_order(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists of labels; equal ends are taken off first."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    u, v = x[head : len(x) - tail], y[head : len(y) - tail]
    out = [(i, i) for i in range(head)]
    if u and v:
        code = {w: k for k, w in enumerate(dict.fromkeys([*u, *v]))}
        cv = np.array([code[w] for w in v])
        best = np.zeros(len(v) + 1, dtype=np.int32)
        rises = np.zeros((len(u), len(v)), dtype=bool)  # whether the best of (i, j) is over that of (i, j - 1)
        for i, w in enumerate(u):
            got = np.maximum(best[1:], best[:-1] + (cv == code[w]))
            best = np.concatenate([[0], np.maximum.accumulate(got)]).astype(np.int32)
            rises[i] = best[1:] > best[:-1]
        i, j, pairs = len(u) - 1, len(v) - 1, []
        while i >= 0 and j >= 0:
            if not rises[i, j]:
                j -= 1
            elif u[i] == v[j]:
                pairs.append((head + i, head + j))
                i, j = i - 1, j - 1
            else:
                i -= 1
        out += reversed(pairs)
    return out + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]


def slots(root: Node, path: int, out: list[tuple[int, int, list[Node]]]) -> tuple[int, bool]:
    """Adds (slot, digest of all below, nodes) of the elements with text below a node, without its head, and of text beside elements.

    A slot is the path of labels from the root. Returns the node's digest and whether it has text.
    """
    paths, order, todo = {id(root): path}, [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        kids = [x for x in node.kids if x.tag != "head"]
        for x in kids:
            paths[id(x)] = xxhash.xxh64_intdigest(f"{paths[id(node)]}/{x.label}") >> 1
        todo.extend(reversed(kids))
    got: dict[int, tuple[int, bool]] = {}
    for node in reversed(order):
        if node.tag == "#":
            got[id(node)] = xxhash.xxh64_intdigest(node.text) >> 1, True
            continue
        kids = [x for x in node.kids if x.tag != "head"]
        for x in kids:
            d, some = got[id(x)]
            if some and (x.tag != "#" or len(kids) > 1):
                out.append((paths[id(x)], d, [x]))
        got[id(node)] = xxhash.xxh64_intdigest(f"{node.label}({','.join(str(got[id(x)][0]) for x in kids)})") >> 1, any(got[id(x)][1] for x in kids)
    return got[id(root)]


def layout(node: Node, depth: int = 4) -> str:
    """Labels of the elements that divide a page, down to ``depth``, with runs of equal ones as one; plain elements of content don't count."""
    kids: list[str] = []
    for x in node.kids:
        if x.tag in _DIVIDES or "." in x.label:
            one = layout(x, depth - 1) if depth > 1 else x.label
            if not kids or kids[-1] != one:
                kids.append(one)
    return f"{node.label}({','.join(kids)})"


def lengths(root: Node) -> dict[int, int]:
    """Characters of text below each node that are neither template nor around an article, by the node's id."""
    out: dict[int, int] = {}
    for node in reversed(preorder(root)):
        out[id(node)] = 0 if node.dropped or node.role == "around" else len(node.text) + sum([out[id(x)] for x in node.kids])
    return out


def articles(root: Node, tag: str) -> list[Node]:
    """Outermost elements of a tag below ``root``, outside what stands around articles."""
    out, todo = [], list(reversed(root.kids))
    while todo:
        x = todo.pop()
        if x.role == "around":
            continue
        if x.tag == tag or tag == "main" and x.role == "main":
            out.append(x)
        else:
            todo.extend(reversed(x.kids))
    return out


def blocks(root: Node, inside: bool) -> list[str]:
    """Texts below ``root`` in page order, without template, what is around articles and (outside of one) lists of links."""
    counts: dict[int, tuple[int, int, int]] = {}  # links, characters, linked characters
    for node in [] if inside else reversed(preorder(root)):
        below = [counts[id(x)] for x in node.kids]
        counts[id(node)] = tuple(map(sum, zip((int(bool(node.linked)), len(node.text), node.linked), *below, strict=True)))
    out: list[str] = []
    todo = [(x, root, False) for x in reversed(root.kids)]
    while todo:
        x, parent, head = todo.pop()
        if x.dropped or x.role == "around":
            continue
        if x.tag == "#":
            if not head or parent.tag in _HEADINGS:
                out.append(x.text)
            continue
        if not inside and x.tag in ("ul", "ol", "div", "section", "table", "p"):
            links, total, linked = counts[id(x)]
            if links >= 3 and linked >= 0.8 * total > 0:
                continue  # a list of links
        inner = head or x.role == "head"
        todo.extend([(y, x, inner) for y in reversed(x.kids)])
    return out


def extract(html: str, template: set[tuple[int, int, int]] | None = None) -> str:
    """Main text of a page: blocks in page order joined by line feeds. ``template``: (layout, slot, digest) of the constant nodes of its
    host; layout 0: of all layouts."""
    root = parse(html)
    if template:
        found: list[tuple[int, int, list[Node]]] = []
        slots(root, 0, found)
        group = xxhash.xxh64_intdigest(layout(root)) >> 1
        for slot, d, nodes in found:
            if (0, slot, d) in template or (group, slot, d) in template:
                for node in nodes:
                    node.dropped = True
    size = lengths(root)
    for tag in ("article", "main"):
        found = [x for x in articles(root, tag) if not template or size[id(x)]]
        if found:
            top = max(found, key=lambda x: size[id(x)])
            if tag == "main" and (inner := [x for x in articles(top, "article") if not template or size[id(x)]]):
                top = max(inner, key=lambda x: size[id(x)])
            return "\n".join(blocks(top, True))
    return "\n".join(blocks(root, False))


def host(url: Column) -> Column:
    """Host of a URL in lower case; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def induce(pages: DataFrame, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """(url, html) -> (host, template: array of (layout, slot, digest)) of the hosts that have constant nodes.

    Every page counts, equal ones of a host once, so copies of a page make nothing constant. For each slot the pages that have it are
    counted, and those on which it holds a node of each digest: of each layout of a host (pages whose dividing elements are alike), and of
    all its pages. A node is template where its share of either is large enough. Tasks send sums; no task holds a host.
    """

    return settled(pages.sparkSession, lambda: _induce(pages, least, share), "templates")


def _induce(pages: DataFrame, least: int, share: float) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = []
                for s in part.column(1).to_pylist():
                    root, found = parse(s or ""), []
                    d, _ = slots(root, 0, found)
                    pairs = sorted({x[:2] for x in found})
                    rows.append((xxhash.xxh64_intdigest(layout(root)) >> 1, d, np.array(pairs, dtype=np.int64).tobytes()))
                cols = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), type=t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["host", "layout", "page", "slots"])

    t = pages.select(host(F.col("url")).alias("host"), "html").filter("host <> ''")
    t, _ = stored(t.mapInArrow(sketch, "host string, layout long, page long, slots binary").distinct(), "outlines")

    def count(of: int) -> DataFrame:
        """Pages by host, layout and slot (of = 1), or by digest as well (of = 2); each task sends sums."""
        names = ["host", "layout", "slot", "digest", "n"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: dict[tuple, int] = {}

            def sent() -> pa.RecordBatch:
                cols = list(zip(*[(*k, n) for k, n in counts.items()], strict=True)) or [[] for _ in names]
                counts.clear()
                return pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.string() if i == 0 else pa.int64()) for i, c in enumerate(cols)], names=names)

            for batch in batches:
                for h, g, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    pairs = np.frombuffer(raw, dtype=np.int64).reshape(-1, 2).tolist()
                    for slot, d in pairs if of == 2 else [(x, 0) for x in {x for x, _ in pairs}]:
                        key = (h, g, slot, d)
                        counts[key] = counts.get(key, 0) + 1
                if len(counts) > 200_000:
                    yield sent()
            yield sent()

        return t.select("host", "layout", "slots").mapInArrow(run, "host string, layout long, slot long, digest long, n long")

    all_ = Window.partitionBy("host", "slot", "digest")
    same = count(2).withColumn("all", F.sum("n").over(all_)).filter(F.col("all") >= least)
    same, _ = stored(same.groupBy("host", "layout", "slot", "digest").agg(F.sum("n").alias("n"), F.first("all").alias("all")), "votes")
    have, _ = stored(count(1).groupBy("host", "layout", "slot").agg(F.sum("n").alias("have")), "slots")
    total = have.groupBy("host", "slot").agg(F.sum("have").alias("have_all"))
    votes = same.join(have, ["host", "layout", "slot"]).join(total, ["host", "slot"])
    whole = F.col("all") >= share * F.col("have_all")
    one = (F.col("n") >= least) & (F.col("n") >= share * F.col("have"))
    votes = votes.filter(whole | one).select("host", F.struct(F.when(whole, 0).otherwise(F.col("layout")).cast("long").alias("layout"), "slot", "digest").alias("x")).distinct()
    return votes.groupBy("host").agg(F.collect_list("x").alias("template"))


def main_text(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars.

    Pages are split over tasks whatever their host; wrappers are broadcast while they are few, else both are dealt by host and
    Spark splits large ones. On each page, template nodes of its host or layout are left out; of the rest, the article with most
    text (else the main element, else all) gives its blocks, without navigation, headers (their headings stay), footers, asides,
    forms, adverts, notices and comments, known by element, role or class name. Null html: empty text. Pages without
    a host, or of a host with fewer than PAGES different ones, have no template.
    """
    wrappers = induce(pages) if wrappers is None else wrappers
    few = bounded(wrappers.withColumnRenamed("host", "_host"), 2000)
    t = pages.select("page_id", "url", "html", host(F.col("url")).alias("_h")).join(few, F.col("_h") == F.col("_host"), "left").select("page_id", "url", "html", "_host", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[tuple[int, int, int]]] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                out = []
                for i, (s, h) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    if h and h not in known:
                        if len(known) > 200:
                            known.clear()
                        known[h] = {(x["layout"], x["slot"], x["digest"]) for x in part.column(4)[i].as_py()}
                    out.append(extract(s or "", known[h] if h else None))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, type=pa.string()), pa.array(map(len, out), type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return t.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of all pages.

    Null or empty html: empty text and 0. Repeated pages: a row each. Null or odd urls: pages without a template. Pages of any depth and length:
    whole. Other columns don't matter. Empty table: empty result.
    """
    return main_text(read(spark, sf_dir, "pages"))
