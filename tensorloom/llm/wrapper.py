"""HTML extraction by wrapper induction.

Pages of a host share a template.  Each page's DOM tree is aligned with reference trees of its host by simple tree
matching (the largest order-preserving match of equally labelled nodes).  Matched nodes that hold the same text on both
pages are constant, those that hold different texts vary.  What is counted of a host's nodes, over all its pages, says
which are template: constant on SHARE of at least LEAST compared pages that have them.  What varies is content; the region
is the deepest node that holds HOLD of the host's varying text.

References are chosen for each host before counting, up to REFERENCES pages, so the result doesn't depend on how pages
are dealt; pages that equal a reference aren't compared with it, and a page of constants alone keeps them.  Tasks count in
tables of node paths, so counts of different tasks add up; paths name tag, class and id, and repeated siblings share one.

A page's blocks are its text without template nodes and without what markup or naming declares to be no content: scripts,
styles, menus, headers, footers, sidebars, forms, notices, adverts and reader comments (adverts vary from page to page, so
that constants alone don't tell them).  A name declares by its whole or by its first or last part, not by what it tells of
its surroundings (has-sidebar) or of content (entry-header), nor within running text where it may be of content; no node
counts as declared that holds the page's main or article, or (but for adverts, comments and hidden parts) the host's region.

Null or empty html: empty text.  Null urls are one host.  Repeated rows each give a row.  Hosts of one page have no
template.  Deep or broken markup is read without recursion; unclosed blocks end where the next begins, and a quote that
nothing closes is an ordinary character.  Tags that the end cuts off are dropped.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import json
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

LEAST, SHARE, HOLD = 5, 0.8, 0.9
#: Hosts whose templates are broadcast; more are joined.
BROADCAST_HOSTS = 5_000
#: A host's reference pages; they are broadcast up to so many characters, and joined beyond.  A task keeps some parsed.
REFERENCES, BROADCAST_CHARS, REFERENCE_BYTES = 3, 32 << 20, 2 << 20
SLICE = 4 << 20

#: Tags by role, as HTML defines them.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NOISE_TAGS = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "svg", "math", "object", "canvas", "audio", "video", "menu", "fieldset", "label"} | RAW
BLOCK = {"html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "caption", "thead", "tbody", "tfoot", "tr", "ul", "head"}
#: A start tag closes these if they are open (up to the given scope).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "html", "nav", "aside", "header", "footer", "form", "blockquote", "figure"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}
#: Words of class and id names that declare a part to be no content.
NOISE_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "banner", "breadcrumb", "breadcrumbs", "byline-share", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus",
    "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "related", "reply", "respond", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget",
}
#: Of these, declarations that a host's varying text overrules where it is within; as tags and roles, too.
SOFT_NAMES = {"banner", "footer", "header", "login", "masthead", "menu", "modal", "notice", "notices", "overlay", "popup", "promo", "related", "share", "sharing", "sidebar", "skip", "social", "subscribe", "subscription", "toolbar", "topbar", "widget"}
SOFT_TAGS = {"header", "footer", "aside", "form", "dialog", "menu", "fieldset", "label"}
SOFT_ROLES = {"banner", "contentinfo", "complementary", "dialog", "form", "menu"}
HEADER_NAMES = {"header", "banner", "masthead"}
#: Parts of names that tell what a node has beside it, or of what it is a header.
BESIDE = {"has", "have", "no", "not", "non", "with", "without", "hide", "show", "is", "after", "before"}
OF_CONTENT = {"article", "blog", "chapter", "content", "entry", "post", "recipe", "review", "section", "single", "story"}
SOFT, HARD = 1, 2
#: Attributes as HTML reads them: a quote opens a value only right after "="; one that nothing closes is an ordinary character.
_VALUE = r"\"[^\"]*\"|'[^']*'|[^\s>]*"
_NAME = r"=?[^\s/>=]+|="
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[\s/]+|(?:{_NAME})(?:\s*=\s*(?:{_VALUE}))?)*+)(>|\Z)", re.S)
ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: Blocks of running text: an inline part within them is part of a sentence, whatever its name.
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "dd", "dt", "figcaption"}


class Node:
    __slots__ = ("tag", "name", "noise", "kids", "text", "path", "hash", "parent", "shape", "whole")

    def __init__(self, tag: str, name: str, noise: int, parent):
        self.tag, self.name, self.noise, self.parent = tag, name, noise, parent
        self.kids: list = []  # nodes and strings, in order
        self.path = self.text = self.hash = self.shape = self.whole = None


@lru_cache(1 << 16)
def _named(name: str, within_content: bool) -> int:
    """Whether a class or id name declares no content: the whole name, or its first or last part."""
    low = name.lower()
    parts = [w.lower() for w in re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", name) if w]
    if low in NOISE_NAMES:
        said = {low}
    elif not parts or BESIDE & set(parts):
        return 0
    else:
        said = {parts[0], parts[-1]} & NOISE_NAMES
        if OF_CONTENT & set(parts):
            said -= HEADER_NAMES
    if within_content:
        said -= HEADER_NAMES
    return (HARD if said - SOFT_NAMES else SOFT) if said else 0


def _declared(tag: str, attrs: str, within_content: bool) -> tuple[str, int]:
    """A node's label, and whether it is declared to be no content: SOFT where a host's varying text may overrule that."""
    noise = 0
    if tag in NOISE_TAGS or (tag == "header" and not within_content):
        noise = SOFT if tag in SOFT_TAGS else HARD
    if not attrs or attrs.isspace() or attrs == "/":
        return tag, noise
    got = {}
    for k, a, b, c in ATTR.findall(attrs):
        got.setdefault(k.lower(), a or b or c)
    names = f"{got.get('class', '')} {got.get('id', '')}".split()
    if tag not in ("html", "body", "main", "article"):
        noise = max(noise, *(_named(n, within_content) for n in names), 0)
    role = got.get("role", "").lower()
    if role in ROLES and not (role == "banner" and within_content):
        noise = max(noise, SOFT if role in SOFT_ROLES else HARD)
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", got.get("style", ""), re.I):
        noise = HARD
    if tag in ("html", "body"):
        noise = 0
    return tag + "".join(f".{n}" for n in names[:3] if not re.search(r"\d", n)), noise


def _lift(contents: list[tuple[Node, bool]]) -> None:
    """No node is noise that holds the page's main or, where none is outside of noise, its articles; but articles named as
    comments or the like, or among what is named so, are none of the page's."""

    def above(x):
        while x.parent is not None:
            x = x.parent
            yield x

    for tag in ("main", "article"):
        of = [x for x, named in contents if x.tag == tag and not named]
        if not of:
            continue
        if all(x.noise or any(y.noise for y in above(x)) for x in of):
            for x in of:
                up = [x, *above(x)]
                if tag == "main" or not any(y.noise == HARD and y.name != y.tag and any(_named(n, False) == HARD for n in y.name.split(".")[1:]) for y in up):
                    for y in up:
                        y.noise = 0
        if any(not x.noise and not any(y.noise for y in above(x)) for x in of):
            return


def parse(html: str) -> Node:
    """A tree of blocks and of inline parts that carry a name; other inline tags are transparent."""
    root = Node("#", "#", 0, None)
    at, pos, content = root, 0, 0
    contents: list[tuple[Node, bool]] = []  # each main and article, and whether its own name declares it to be none
    n = len(html)
    while pos < n:
        m = TOKEN.search(html, pos)
        text = html[pos : m.start()] if m else html[pos:]
        if text:
            at.kids.append(text)
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                at.kids.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if not m[4]:
            break  # a tag that the end cuts off
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK or tag in CLOSES or tag in NOISE_TAGS:
                x = at
                while x.parent is not None and x.tag != tag and not (tag in ("p", "li", "td", "th", "tr", "dt", "dd") and x.tag in SCOPE):
                    x = x.parent
                if x.tag == tag and x.parent is not None:
                    while at is not x.parent:
                        content -= at.tag in ("article", "main")
                        at = at.parent
            elif at.tag == tag:
                at = at.parent
            continue
        if tag == "br":
            at.kids.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(html, pos)
            pos = end.end()
            at.kids.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                at.kids.append(Node("hr", "hr", HARD, at))
            continue
        if tag in BLOCK or tag in CLOSES:
            shut = {"p"} | CLOSES.get(tag, set()) if tag in BLOCK or tag in ("td", "th") else CLOSES[tag]
            x, last = at, None
            while x.parent is not None and x.tag not in SCOPE:
                if x.tag in shut:
                    last = x
                x = x.parent
            if last is None and at.tag not in BLOCK | set(CLOSES) | {"#"} and tag in BLOCK:
                x = at  # an inline part that a block begins in stays open around it
            if last is not None:
                at = last.parent
        name, noise = _declared(tag, m[3], content > 0)
        if noise == SOFT and at.tag in RUNNING and tag not in BLOCK and tag not in CLOSES and tag not in NOISE_TAGS:
            noise = 0
        if tag not in BLOCK and tag not in CLOSES and not noise and name == tag:
            continue
        if tag not in BLOCK and tag not in CLOSES and not noise:
            continue
        node = Node(tag, name, noise, at)
        at.kids.append(node)
        if tag in ("main", "article"):
            contents.append((node, any(_named(n, True) == HARD for n in name.split(".")[1:])))
        if not m[3].rstrip().endswith("/") or tag in BLOCK:
            at = node
            content += tag in ("article", "main")
    _lift(contents)
    return root


def _walk(root: Node):
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack += [k for k in reversed(x.kids) if isinstance(k, Node)]


def squeeze(text: str) -> str:
    return " ".join(htmllib.unescape(text).split())


def label(root: Node) -> list[Node]:
    """Paths and own texts of all nodes outside hard noise; in paths, nodes of soft noise end in "!"."""
    root.path = ""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        own = squeeze(" ".join(k for k in x.kids if isinstance(k, str)))
        x.text, x.hash = own, hashlib.md5(own.encode()).hexdigest()[:12] if own else ""
        out.append(x)
        for k in reversed(x.kids):
            if isinstance(k, Node) and k.noise != HARD:
                k.path = f"{x.path}/{k.name}{'!' if k.noise else ''}"
                stack.append(k)
    return out


def _kids(x: Node) -> list[Node]:
    return [k for k in x.kids if isinstance(k, Node) and k.noise != HARD]


def _heaviest(n: int, m: int, row, pairs: bool = True) -> tuple[int, list[tuple[int, int]]]:
    """The weight of a heaviest order-preserving match of n and m things, and its pairs; row(i): i's weight with each of the m."""
    if n * m <= 256:
        w = [[0] * (m + 1)]
        for i in range(n):
            last, now = w[-1], [0]
            for j, x in enumerate(row(i)):
                now.append(max(last[j + 1], now[j], last[j] + x))
            w.append(now)
        total, up, left = w[-1][-1], lambda i, j: w[i][j] == w[i - 1][j], lambda i, j: w[i][j] == w[i][j - 1]
    else:
        last, ups, lefts = np.zeros(m + 1, np.int64), [], []
        for i in range(n):
            now = last.copy()
            np.maximum(now[1:], last[:-1] + np.asarray(row(i), np.int64), out=now[1:])
            np.maximum.accumulate(now, out=now)
            if pairs:  # a bit a cell
                ups.append(np.packbits(now == last))
                lefts.append(np.packbits(now[1:] == now[:-1]))
            last = now
        bit = lambda bits, k: bool(bits[k >> 3] >> (7 - (k & 7)) & 1)
        total, up, left = int(last[-1]), lambda i, j: bit(ups[i - 1], j), lambda i, j: bit(lefts[i - 1], j - 1)
    got = []
    i, j = (n, m) if pairs else (0, 0)
    while i and j:
        if up(i, j):
            i -= 1
        elif left(i, j):
            j -= 1
        else:
            i, j = i - 1, j - 1
            got.append((i, j))
    return total, got


class Shapes:
    """Subtrees by their labels alone.  What simple tree matching finds depends on them only, so it is found once for each
    pair of shapes, and subtrees of one shape match whole: pages of any size are matched."""

    MOST = 200_000

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.names: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.found: dict[tuple[int, int], int] = {}

    def full(self) -> bool:
        return len(self.ids) + len(self.found) > self.MOST

    def add(self, root: Node) -> None:
        """Give each node its shape, and a hash of its labels and texts."""
        for x in reversed(list(_walk(root))):
            if x.noise == HARD:
                continue
            kids = _kids(x)
            key = (x.name, *(k.shape for k in kids))
            if key not in self.ids:
                self.ids[key] = len(self.ids)
                self.names.append(x.name)
                self.kids.append(key[1:])
                self.sizes.append(1 + sum(self.sizes[k] for k in key[1:]))
            x.shape, x.whole = self.ids[key], hash((x.name, x.hash, *(k.whole for k in kids)))

    def most(self, a: int, b: int) -> int:
        """Nodes of a largest match of two shapes."""
        if a == b:
            return self.sizes[a]
        if self.names[a] != self.names[b]:
            return 0
        stack = [(a, b)]
        while stack:
            p = stack[-1]
            if p in self.found:
                stack.pop()
                continue
            x, y = self.kids[p[0]], self.kids[p[1]]
            i, k = _ends(x, y)
            same = sum(self.sizes[z] for z in (*x[:i], *x[len(x) - k :]))
            x, y = x[i : len(x) - k], y[i : len(y) - k]
            more = [(u, v) for u in set(x) for v in set(y) if u != v and self.names[u] == self.names[v] and (u, v) not in self.found]
            if more:
                stack += more
                continue
            self.found[p] = 1 + same + _heaviest(len(x), len(y), self._rows(x, y), False)[0]
            stack.pop()
        return self.found[a, b]

    def _rows(self, x, y):
        known: dict[int, list[int]] = {}

        def row(i):
            u = x[i]
            if u not in known:
                of = {v: self.most(u, v) for v in set(y)}
                known[u] = [of[v] for v in y]
            return known[u]

        return row


def _ends(x, y) -> tuple[int, int]:
    """How many things at the start, and at the end of the rest, two sequences share."""
    n = min(len(x), len(y))
    i = next((i for i in range(n) if x[i] != y[i]), n)
    return i, next((k for k in range(n - i) if x[-1 - k] != y[-1 - k]), n - i)


def match(a: Node, b: Node, shapes: Shapes | None = None) -> list[tuple[Node, Node]]:
    """Simple tree matching: pairs of nodes of a largest match that keeps order and labels.

    Of the largest matches of two lists of children, one with the most equal subtrees."""
    if shapes is None:
        shapes = Shapes()
        shapes.add(a)
        shapes.add(b)
    if a.name != b.name:
        return []
    out, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        out.append((x, y))
        cx, cy = _kids(x), _kids(y)
        if x.shape == y.shape:
            stack += zip(cx, cy, strict=True)
            continue
        whole = [k.whole for k in cx], [k.whole for k in cy]
        i, k = _ends(*whole)
        if not set(whole[0][i : len(cx) - k]) & set(whole[1][i : len(cy) - k]):  # no texts to prefer: shapes will do
            p, q = _ends([z.shape for z in cx[i : len(cx) - k]], [z.shape for z in cy[i : len(cy) - k]])
            i, k = i + p, k + q
        stack += zip(cx[:i], cy[:i], strict=True)
        stack += zip(cx[len(cx) - k :], cy[len(cy) - k :], strict=True)
        cx, cy = cx[i : len(cx) - k], cy[i : len(cy) - k]
        if not cx or not cy:
            continue
        rows, most = shapes._rows([z.shape for z in cx], [z.shape for z in cy]), min(len(cx), len(cy)) + 1
        pairs = _heaviest(len(cx), len(cy), lambda i, cx=cx, cy=cy, rows=rows, most=most: [w * most + (cx[i].whole == z.whole) for w, z in zip(rows(i), cy, strict=True)])[1]
        stack += ((cx[i], cy[j]) for i, j in pairs)
    return out


def match_by_path(a: list[Node], b: list[Node]) -> list[tuple[Node, Node]]:
    """Pairs of nodes of one path, in page order: a cruder match, which induction doesn't use."""
    of = defaultdict(list)
    for x in reversed(a):
        of[x.path].append(x)
    return [(of[y.path].pop(), y) for y in b if of.get(y.path)]


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_COUNTS = pa.schema([("host", pa.string()), ("path", pa.string()), ("text", pa.string()), ("seen", pa.int64()), ("same", pa.int64()), ("varying", pa.int64()), ("alone", pa.int64())])
_COUNTED = "host string, path string, text string, seen long, same long, varying long, alone long"


def host_column(url: str):
    """What host_of gives."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def references(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(host, html): of each of REFERENCES classes of a host's pages, by hash of html, the page of smallest id."""
    rows = pages.where(F.length(html_col) > 0).select(host_column(url_col).alias("host"), F.col(id_col).alias("id"), F.md5(F.col(html_col).cast("binary")).alias("md5"), F.col(html_col).alias("html"))
    least = rows.groupBy("host", F.pmod(F.xxhash64("md5"), F.lit(REFERENCES)).alias("class")).agg(F.min(F.struct("id", "md5")).alias("least")).select("host", F.col("least.md5").alias("md5"))
    return rows.join(least, ["host", "md5"]).groupBy("host", "md5").agg(F.first("html").alias("html")).select("host", "html")


def _induce(url_col: str, html_col: str, known: dict[str, list[bytes]] | None):
    """Counts of each host's node paths, against its references: `known`, or those of the rows."""

    def run(batches):
        parsed: dict[str, list] = {}
        held, shapes = 0, Shapes()
        counts: dict[tuple[str, str, str], list[int]] = defaultdict(lambda: [0, 0, 0, 0])

        def flush():
            rows = [{"host": h, "path": p, "text": t, "seen": c[0], "same": c[1], "varying": c[2], "alone": c[3]} for (h, p, t), c in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_pylist(rows, schema=_COUNTS)

        for b in slices(batches, html_col, SLICE):
            own = b.column("_references") if known is None else None
            for i, (url, html) in enumerate(zip(b.column(url_col).to_pylist(), b.column(html_col).to_pylist(), strict=True)):
                host = host_of(url)
                if host not in parsed:
                    texts = [zlib.decompress(x).decode() for x in known.get(host, ())] if known is not None else own[i].as_py() or []
                    if held > REFERENCE_BYTES:
                        parsed, held, shapes = {}, 0, Shapes()
                    held += sum(map(len, texts))
                    parsed[host] = [(t, parse(t)) for t in texts]
                    for _, ref in parsed[host]:
                        label(ref)
                        shapes.add(ref)
                others = [r for r in parsed[host] if r[0] != html]
                if not others:
                    continue
                root = parse(html or "")
                nodes = label(root)
                shapes.add(root)
                same = {id(y) for _, ref in others for x, y in match(ref, root, shapes) if y.text and x.hash == y.hash}
                alone = int(len(parsed[host]) == 1)
                for p in {x.path for x in nodes if x.text}:
                    c = counts[host, p, ""]
                    c[0] += 1
                    c[3] = alone
                for p, t in {(x.path, x.hash) for x in nodes if id(x) in same}:
                    counts[host, p, t][1] += 1
                for x in nodes:  # nodes that no reference holds alike vary
                    if x.text and id(x) not in same:
                        counts[host, x.path, ""][2] += len(x.text)
                if shapes.full():
                    parsed, held, shapes = {}, 0, Shapes()
            if len(counts) > 50_000:
                yield flush()
        if counts:
            yield flush()

    return run


def region_of(varying: dict[str, int]) -> str:
    """The deepest path that holds HOLD of the varying text; outside of declared noise, unless that text is within it."""

    def deepest(of: dict[str, int]) -> str:
        total = sum(of.values())
        held: dict[str, int] = defaultdict(int)
        for p, n in of.items():
            parts = p.split("/")
            for i in range(1, len(parts) + 1):
                held["/".join(parts[:i])] += n
        return max((p for p, n in held.items() if n >= HOLD * total), key=lambda p: (p.count("/"), p)) if total else ""

    every = deepest(varying)
    return every if "!" in every else deepest({p: n for p, n in varying.items() if "!" not in p})


def blocks_of(root: Node, region: str, template: set[tuple[str, str]]) -> list[str]:
    """Texts of the page's blocks that are neither template nor declared to be no content, in page order."""
    nodes = label(root)
    if "!" in region:  # the host's varying text is within declared noise, which therefore is none
        lifted = [x for x in nodes if x.noise and (region + "/").startswith(x.path + "/")]
        for x in lifted:
            x.noise = 0
    return _texts(root, template) or _texts(root, set())  # a page of constants alone is its own content


def _texts(root: Node, template: set[tuple[str, str]]) -> list[str]:
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        if t := squeeze("".join(now)):
            out.append(t)
        now.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.noise:
            if x.tag in BLOCK:
                end()
            else:
                now.append(" ")
        elif x.path is not None and x.text and (x.path, x.hash) in template:
            end()
            # what is constant are the node's own words, not the parts within it
            stack += [None, *(k for k in reversed(x.kids) if isinstance(k, Node))]
        else:
            if x.tag in ("td", "th"):
                now.append(" ")
            elif x.tag in BLOCK or x is root:
                end()
                stack.append(None)
            stack += reversed(x.kids)
    end()
    return out


def _extract(keep: list[str], url_col: str, html_col: str, templates: dict[str, dict] | None):
    def run(batches):
        for b in slices(batches, html_col, SLICE):
            hosts = [host_of(u) for u in b.column(url_col).to_pylist()]
            own = b.column("_template").to_pylist() if templates is None else None
            texts, known = [], {}
            for i, (host, html) in enumerate(zip(hosts, b.column(html_col).to_pylist(), strict=True)):
                t = known.get(host)
                if t is None:
                    raw = templates.get(host) if templates is not None else own[i]
                    raw = json.loads(raw) if raw else {"region": "", "template": []}
                    t = known[host] = (raw["region"], {tuple(x) for x in raw["template"]})
                texts.append("\n".join(blocks_of(parse(html or ""), *t)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return run


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(host, template json): the content region's path, and paths and text hashes of template nodes."""
    refs = materialize(references(pages, id_col, url_col, html_col), "references")
    size = refs.agg(F.countDistinct("host").alias("hosts"), F.sum(F.length("html")).alias("chars")).first()
    rows, known = pages.select(url_col, html_col), None
    if size.hosts <= BROADCAST_HOSTS and (size.chars or 0) <= BROADCAST_CHARS:
        known = defaultdict(list)
        for r in refs.orderBy("host", "html").toLocalIterator():
            known[r.host].append(zlib.compress(r.html.encode()))
        known = dict(known)
    else:
        of = refs.groupBy(F.col("host").alias("_host")).agg(F.sort_array(F.collect_list("html")).alias("_references"))
        rows = rows.withColumn("_host", host_column(url_col)).join(of, "_host", "left").select(url_col, html_col, "_references")
    counts = rows.mapInArrow(_induce(url_col, html_col, known), _COUNTED)
    by_text = counts.groupBy("host", "path", "text").agg(*(F.sum(c).alias(c) for c in ("seen", "same", "varying")), F.max("alone").alias("alone"))
    # each text of a path is judged by its own count of pages; "" holds the path's
    texts = F.collect_list(F.when(F.col("text") != "", F.struct("text", "same")))
    by_path = by_text.groupBy("host", "path").agg(F.sum("seen").alias("seen"), F.sum("varying").alias("varying"), F.max("alone").alias("alone"), texts.alias("texts"))
    # a host's only reference is compared with none, and agrees with itself
    constant = F.filter("texts", lambda t: (t.same + F.col("alone") >= LEAST) & (t.same + F.col("alone") >= SHARE * (F.col("seen") + F.col("alone"))))
    rows = by_path.groupBy("host").agg(F.collect_list(F.when(F.col("varying") > 0, F.struct("path", "varying"))).alias("varying"), F.flatten(F.collect_list(F.transform(constant, lambda t: F.struct(F.col("path").alias("path"), t.text.alias("text"))))).alias("template"))

    def finish(batches):
        for b in batches:
            made = [json.dumps({"region": region_of({v["path"]: v["varying"] for v in r["varying"]}), "template": sorted([t["path"], t["text"]] for t in r["template"])}) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(made, pa.string())], names=["host", "template"])

    return rows.mapInArrow(finish, "host string, template string")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text: a row per row."""
    templates = materialize(induce(pages, url_col, html_col, id_col), "templates")
    out = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)), "text string"])
    few = templates.limit(BROADCAST_HOSTS + 1).collect()
    rows = pages.select(id_col, url_col, html_col)
    if len(few) <= BROADCAST_HOSTS and sum(len(r.template) for r in few) <= 64 << 20:
        known = {r.host: r.template for r in few}
        return rows.mapInArrow(_extract([id_col, url_col], url_col, html_col, known), out)
    told = rows.withColumn("_host", host_column(url_col)).join(templates.select(F.col("host").alias("_host"), F.col("template").alias("_template")), "_host", "left")
    return told.select(id_col, url_col, html_col, "_template").mapInArrow(_extract([id_col, url_col], url_col, html_col, None), out)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract_text(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
