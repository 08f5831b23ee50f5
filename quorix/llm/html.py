"""Main text of web pages, by removing what a site repeats.

Each page becomes a tree of elements. A subtree's hash covers its tags, attributes
and text. Spark counts, for each host, beside how many different texts a subtree
stands: pages count once for each set of long texts outside of it, so copies of a
page count as one and don't delete their own text. A subtree that stands on enough pages
of its host, in number and in share (or 1,000 of them), is part of the site's template and is deleted, as are elements whose tag,
role or class says that they aren't article text (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments). Where a page has an
article or main element, the text is what is left in it; else what is left of the
body. In an article or main element only containers of blocks may be template, never
lone paragraphs or headings.

Counts meet pages in one of two ways: few enough recurring subtrees go to all
executors as sorted hashes; more of them are joined by salted host, so a host with
a third of all pages is spread over tasks.

Defined results: null and empty html give empty text; broken markup is read as
browsers mostly do (a new paragraph ends an open one, an end tag without a start is
skipped, what is open at the end is closed); null urls count as one host; repeated
pages count once; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorix import ship
from quorix.llm.common import chunks, stored, table

#: A subtree is template if it stands on so many pages of its host, and on this share of them.
PAGES, SHARE = 3, 0.1
#: So many pages are enough on any host.
ENOUGH = 1000
MASK = (1 << 64) - 1
#: Recurring subtrees that may go to all executors: 16 MB of hashes.
BROADCAST = 2_000_000
SALTS = 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never article text.
DROP = frozenset("script style noscript template nav footer aside form button select option input textarea iframe svg canvas object embed head title dialog menu noembed noframes datalist audio video map".split())
#: Text of these stands in a block of its own.
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "body", "html"}
INLINE = frozenset("a abbr b big cite code em font i mark q s small span strike strong sub sup tt u".split())
#: What may be template inside an article, where it holds blocks.
CONTAINERS = frozenset("center details div dl fieldset ol section table ul".split())
#: Same-level elements that end each other, and what keeps them apart.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_WORDS = "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead sidebar widget aside cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus reply replies discussion pagination pager toolbar skip copyright legal disclaimer".split()
_CLASS = re.compile(r"(?:^|[\s_\-])(?:" + "|".join(_WORDS) + r")(?:$|[\s_\-0-9])", re.I)
_START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?(?=[a-zA-Z]))")
_TOKEN = re.compile(r"<!--|<!\[CDATA\[|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME_END, _SPECIAL = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
_ATTR = re.compile(r"(?<![^\s=/\"'<>])([^\s=/\"'<>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))", re.S)


class _Next:
    """Where a pattern stands first from a place on; places only grow, so a page is read once."""

    def __init__(self, pattern: re.Pattern, page: str):
        self.pattern, self.page, self.asked, self.found = pattern, page, 0, -1

    def __call__(self, at: int) -> int:
        if self.found < at:
            m = self.pattern.search(self.page, at)
            self.found = m.start() if m else len(self.page)
        return self.found


def tokens(page: str):
    """(start, end, tag or None, whether it closes, attributes) of comments, declarations and tags, in linear time.

    A tag ends at the first > outside of quotes; where there is none its < is text. ``send`` an end to go on from there.
    """
    size, at, after, match = len(page), 0, 0, _TOKEN.match
    while (start := page.find("<", after)) >= 0:
        if m := match(page, start):
            if m[2]:
                found = (start, m.end(), m[2].lower(), m[1] == "/", m[3])
            elif m[0] in ("<!--", "<![CDATA["):
                end = page.find("-->" if m[0] == "<!--" else "]]>", m.end())
                found = (start, size if end < 0 else end + 3, None, False, "")
            else:
                found = (start, m.end(), None, False, "")
            at = after = (yield found) or found[1]
        elif _START.match(page, start):
            break  # never closed: from here on with more care
        else:
            after = start + 1
    else:
        return
    name_end, special, gt = _Next(_NAME_END, page), _Next(_SPECIAL, page), page.rfind(">")
    outcome: dict[int, int] = {}

    def end_of(q: int) -> int:
        """The > that ends a tag whose attributes start at q, or -1."""
        seen, r = [], special(q)
        while True:
            if r in outcome:
                out = outcome[r]
                break
            seen.append(r)
            if r >= size or page[r] == ">":
                out = r if r < size else -1
                break
            close = page.find(page[r], r + 1)
            if close < 0:
                out = -1
                break
            m = _SPECIAL.search(page, close + 1)
            r = m.start() if m else size
        for r in seen:
            outcome[r] = out
        return out

    while m := _START.search(page, at):
        start, kind, at = m.start(), m[0], m.end()
        if kind in ("<!--", "<![CDATA["):
            end = page.find("-->" if kind == "<!--" else "]]>", at)
            found = (start, size if end < 0 else end + 3, None, False, "")
        elif kind in ("<!", "<?"):
            if start > gt:
                continue
            found = (start, page.index(">", at) + 1, None, False, "")
        else:
            if start > gt:
                continue
            stop = name_end(at)
            end = end_of(stop)
            if end < 0:
                continue
            found = (start, end + 1, page[at:stop].lower(), kind == "</", page[stop:end])
        at = (yield found) or found[1]


class _Open:
    """The elements that are open, and where the last of each tag, of blocks and of what isn't inline stand."""

    def __init__(self, root):
        self.stack, self.where, self.blocks, self.solid, self.lists = [root], {}, [], [], {}

    def push(self, node) -> None:
        tag = node.tag
        kept = self.lists.get(tag)
        if kept is None:
            own = self.where[tag] = []
            kept = self.lists[tag] = [own, *[self.blocks] * (tag in BLOCK), *[self.solid] * (tag not in INLINE)]
        k = len(self.stack)
        self.stack.append(node)
        for places in kept:
            places.append(k)

    def cut(self, k: int) -> None:
        """Close the element at k and all in it."""
        while len(self.stack) > k:
            for places in self.lists[self.stack.pop().tag]:
                places.pop()

    def last(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)


class Node:
    __slots__ = ("tag", "attrs", "children", "hash", "bad")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.hash, self.bad = tag, attrs, [], 0, False


def parse(page: str) -> Node:
    root = Node("#root")
    held, at, size = _Open(root), 0, len(page)
    found, jump = tokens(page), None
    ends: dict[str, _Next] = {}
    while True:
        try:
            start, end, tag, closes, attrs = found.send(jump)
        except StopIteration:
            break
        jump = None
        if start > at:
            held.stack[-1].children.append(page[at:start])
        at = end
        if tag is None:
            continue
        if closes:
            places = held.where.get(tag)
            k = places[-1] if places else 0
            if k and not (tag in INLINE and held.blocks and held.blocks[-1] > k):
                held.cut(k)
            continue
        if tag in CLOSES_P:
            if held.solid and held.stack[held.solid[-1]].tag == "p":
                held.cut(held.solid[-1])
        elif tag in SIBLINGS:
            mates, walls = SIBLINGS[tag]
            k = held.last(mates)
            if k > held.last(walls):
                held.cut(k)
        node = Node(tag, attrs)
        held.stack[-1].children.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            if tag not in ends:
                ends[tag] = _Next(re.compile(rf"</{re.escape(tag)}\s*+/?>", re.I), page)
            stop = ends[tag](at)
            if stop > at:
                node.children.append(page[at:stop])
            at = jump = page.index(">", stop) + 1 if stop < size else size
            continue
        held.push(node)
    if at < size:
        held.stack[-1].children.append(page[at:])
    return root


def order_of(root: Node) -> list[Node]:
    """Elements, each before what is in it."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in node.children if c.__class__ is Node]
    return out


def hash_subtrees(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        parts = [node.tag, " ".join(node.attrs.split())]
        for c in node.children:
            parts.append(f"\x01{c.hash:x}" if c.__class__ is Node else " ".join(c.split()))
        node.hash = xxhash.xxh64_intdigest("\x00".join(parts))


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw else {}


def by_rule(node: Node, within: bool) -> bool:
    """Whether tag, role or class says that this isn't article text; within: inside an article or main element."""
    tag = node.tag
    if tag in DROP:
        return True
    if tag == "header":
        return not within
    if not node.attrs or tag in ("html", "body", "article", "main"):
        return False
    a = attributes(node.attrs)
    if "hidden" in a or re.search(r"(?:^|\s)hidden(?:$|\s)", node.attrs) or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    return bool(_CLASS.search(a.get("class", "")) or _CLASS.search(a.get("id", "")))


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower().removeprefix("www.") if m else ""


def may_go(node: Node, within: bool) -> bool:
    """Whether a recurring subtree of this kind may be template: in an article or main element only containers of blocks."""
    return not within or node.tag in CONTAINERS and any(c.__class__ is Node and c.tag in BLOCK for c in node.children)


def candidates(nodes: list[Node], root: Node) -> tuple[int, dict[int, int]]:
    """A hash of the page's long texts, and the hashes of the subtrees that may be template, each with that of the long texts outside of it.

    Long are the texts of elements that have a quarter of the longest one's length; no candidate holds an article.
    """
    n = len(nodes)
    size, holds, within, raw, texts = [1] * n, [False] * n, [False] * n, [False] * n, [""] * n
    place = {id(node): i for i, node in enumerate(nodes)}
    kids = [[place[id(c)] for c in node.children if c.__class__ is Node] for node in nodes]
    for i, node in enumerate(nodes):
        inside, skip = within[i] or node.tag in ("article", "main"), raw[i] or node.tag in DROP
        for k in kids[i]:
            within[k], raw[k] = inside, skip
        if not skip:
            texts[i] = " ".join(" ".join(c for c in node.children if c.__class__ is str).split())
    for i in range(n - 1, -1, -1):
        size[i] += sum(size[k] for k in kids[i])
        holds[i] = nodes[i].tag in ("article", "main") or any(holds[k] for k in kids[i])
    least = max(1, max(map(len, texts)) / 4)
    sums = [0, *accumulate(xxhash.xxh64_intdigest(t) if len(t) >= least else 0 for t in texts)]
    # The descendants of an element follow it.
    out = {node.hash: (sums[n] - sums[i + size[i]] + sums[i]) & MASK for i, node in enumerate(nodes) if not holds[i] and node.children and node.tag not in ("#root", "html", "body") and may_go(node, within[i])}
    return sums[n] & MASK, out


def text_of(root: Node, nodes: list[Node], template) -> str:
    """Blocks of the page that are neither template nor ruled out, one a line."""
    tops = [n for n in nodes if n.tag in ("article", "main")]
    if tops:
        inner = set()
        for t in tops:
            inner |= {id(n) for n in order_of(t)[1:]}
        tops = {id(t) for t in tops if id(t) not in inner}
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        line = " ".join(entities.unescape("".join(parts)).split())
        if line:
            blocks.append(line)
        parts.clear()

    todo: list = [(root, not tops, False)]
    while todo:
        item, taken, within = todo.pop()
        if item is None:
            flush()
        elif item.__class__ is str:
            if taken:
                parts.append(item)
        else:
            top = bool(tops) and id(item) in tops
            if by_rule(item, within) or not top and may_go(item, within) and item.hash in template:
                continue
            if item.tag in ("br", "wbr"):
                parts.append(" " if item.tag == "br" else "")
                continue
            taken, within = taken or top, within or top
            inside = [(c, taken, within) for c in item.children]
            if item.tag in BLOCK:
                flush()
                todo.append((None, False, False))
            todo += reversed(inside)
    flush()
    return "\n".join(blocks)


def _key(host: str, subtree: int) -> int:
    x = xxhash.xxh64_intdigest(f"{host}\x00{subtree:x}")
    return x - (1 << 64) if x >= 1 << 63 else x


def recurring(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: int = PAGES, share: float = SHARE) -> DataFrame:
    """(host, key): subtrees that stand on enough pages of their host, as a table in the shared folder."""
    ship(pages.sparkSession)
    def run(batches):
        for batch in chunks(batches, "html"):
            found = set()
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = parse(page or "")
                nodes = order_of(root)
                hash_subtrees(nodes)
                host = host_of(url)
                whole, inner = candidates(nodes, root)
                found.add((host, 0, 0, whole))
                for h, rest in inner.items():
                    found.add((host, _key(host, h), 1, rest))
            host, key, kind, rest = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(host), pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(np.array(rest, np.uint64).view(np.int64))], ["host", "key", "kind", "rest"])

    seen = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "host string, key long, kind int, rest long")
    counts = stored(seen.distinct().groupBy("host", "key", "kind").agg(F.count("*").alias("n")), "subtrees")
    often = counts.where((F.col("kind") == 1) & (F.col("n") >= least))
    sizes = counts.where("kind = 0").select(F.col("host").alias("h"), F.col("n").alias("pages"))
    return stored(often.join(sizes, F.col("host") == F.col("h")).where(F.col("n") >= F.least(share * F.col("pages"), F.lit(ENOUGH))).select("host", "key"), "template")


class _Template:
    """Membership of a subtree hash for one host."""

    def __init__(self, host: str, keys):
        self.host, self.keys = host, keys

    def __contains__(self, subtree: int) -> bool:
        key = _key(self.host, subtree)
        if isinstance(self.keys, (set, frozenset)):
            return key in self.keys
        at = int(np.searchsorted(self.keys, key))
        return at < len(self.keys) and self.keys[at] == key


def _extract(url: str | None, page: str | None, keys) -> str:
    root = parse(page or "")
    nodes = order_of(root)
    hash_subtrees(nodes)
    return text_of(root, nodes, _Template(host_of(url), keys))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: int = PAGES, share: float = SHARE, broadcast: int = BROADCAST, name: str = "text") -> DataFrame:
    """pages without html_col, with the main text as a last column; a column of that name is replaced."""
    from pyspark.sql.types import StringType, StructField, StructType

    template = recurring(pages, url_col, html_col, least, share)
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in (html_col, name)]
    rows = pages.select(*kept, F.col(url_col).alias("_quorix_url"), F.col(html_col).alias("_quorix_html"))
    schema = StructType([*rows.schema.fields[: len(kept)], StructField(name, StringType())])
    if template.count() <= broadcast:
        keys = np.sort(template.select("key").toArrow().column(0).to_numpy())
        held = spark.sparkContext.broadcast(keys)

        def run(batches):
            for batch in chunks(batches, "_quorix_html"):
                n = batch.num_columns
                text = [_extract(u, p, held.value) for u, p in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(text, pa.string())], [*kept, name])

        return rows.mapInArrow(run, schema)
    # The host as Python has it, for the join; a host's template is bounded by the subtrees of a page over the share.
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce("_quorix_url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    each = template.groupBy("host").agg(F.collect_list("key").alias("_quorix_keys")).select(F.col("host").alias("_quorix_h"), "_quorix_keys", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_quorix_s"))
    salted = rows.withColumn("_quorix_host", host).withColumn("_quorix_salt", F.pmod(F.xxhash64("_quorix_html"), F.lit(SALTS)).cast("int"))
    both = salted.join(each, (F.col("_quorix_host") == F.col("_quorix_h")) & (F.col("_quorix_salt") == F.col("_quorix_s")), "left").select(*kept, "_quorix_url", "_quorix_html", F.coalesce("_quorix_keys", F.array().cast("array<bigint>")).alias("_quorix_keys"))

    def run_joined(batches):
        for batch in chunks(batches, "_quorix_html"):
            n = batch.num_columns
            text = [_extract(u, p, frozenset(k)) for u, p, k in zip(*(batch.column(n - i).to_pylist() for i in (3, 2, 1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 3], pa.array(text, pa.string())], [*kept, name])

    return both.mapInArrow(run_joined, schema)


def op7_html(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_html": op7_html}
