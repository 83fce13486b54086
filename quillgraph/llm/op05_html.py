"""HTML extraction with site style trees.

The pages of a host are merged into one tree. An element node is a tag with its class and id, at a
place in the children of a style; a style is the sequence of element nodes that are the children of
an element. So an element has a style for each different way in which its pages fill it. The
importance of an element is the entropy of its styles over its pages (base: the number of pages; 1
with one page), or for an element without children 1 less the mean entropy of its contents (the
sentences of its text, and links and images) over its pages: what is on all pages has importance 0,
what is on one has 1. An element with both children and text of its own has the greater of the two.
Composite importance goes bottom-up, (1 - g**l) of an element's own and g**l of the weighted mean of its
styles, l being their number; a style has the mean of its elements.
An element is noise if its composite importance and that of all elements below it in the page are
less than ``THRESHOLD``; the largest such branches are removed, and the text of the rest is extracted.

Pages are counted in parallel whatever their host: the rows of nodes, styles and contents are summed
by keys, so that no task has all rows of an element. Composite importance is a linear sum over the elements below, with a weight
for each step down; it is summed by doubling: each round joins every element with the one it reaches so far, so that a tree of any
depth d takes log2(d) rounds.
Scripts, styles and comments are never content.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as P

THRESHOLD = 0.5
DECAY = 0.9
BROADCAST_NODES = 4_000_000
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S | re.I)
_ATTRIBUTE = re.compile(r"(class|id|href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em font i img kbd mark q s samp small span strong sub sup time u var wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_SCHEMA = "page_id long, url string, text string, removed int"


class Node:
    """An element: its style name, the parts of its content in order (text or Node), and its links and images."""

    __slots__ = ("tag", "name", "parts", "links", "key")

    def __init__(self, tag: str, name: str):
        self.tag, self.name, self.parts, self.links, self.key = tag, name, [], [], 0

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def parse(text: str) -> Node:
    """The tree of a page, of any depth. Broken markup never fails: unclosed elements end with their parents, stray ends are dropped."""
    root = Node("", "")
    stack = [root]
    opened: dict[str, int] = {}  # how often each tag is on the stack, so that a stray end is known without a search
    for match in _TOKEN.finditer(text):
        _, end, tag, rest, words = match.groups()
        if words is not None:
            stack[-1].parts.append(html.unescape(words))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            while opened.get(tag):
                gone = stack.pop().tag
                opened[gone] -= 1
                if gone == tag:
                    break
            continue
        found = {name.lower(): a or b or c for name, a, b, c in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
        if tag in _INLINE:  # inline marks belong to the text of their block
            stack[-1].links += [found[k] for k in ("href", "src") if k in found]
            if tag == "br":
                stack[-1].parts.append("\n")
            continue
        closes = _CLOSES.get(tag, {"p"} if tag in _BLOCK else ())
        if stack[-1].tag in closes:
            opened[stack.pop().tag] -= 1
            if tag == "tr" and stack[-1].tag == "tr":
                opened[stack.pop().tag] -= 1
        node = Node(tag, f"{tag}.{found.get('class', '')}#{found.get('id', '')}")
        stack[-1].parts.append(node)
        if tag not in _VOID and not rest.endswith("/"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    return root


def host_of(url: str | None) -> str:
    """The host of an address in lower case, without user, port and a leading www."""
    match = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s]*)", url or "", re.I)
    host = match[1].rpartition("@")[2].partition(":")[0].lower() if match else ""
    return host.removeprefix("www.")


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def walk(root: Node, host: str):
    """Every element of a page from the root down: (node, key of its parent style or 0, its own style).

    Sets the key of each element: the host, the parent's style, and the place and name in it.
    """
    root.key = _hash(host)
    stack = [(root, 0)]
    while stack:
        node, parent = stack.pop()
        children = node.children()
        style = _hash(node.key, *(c.name for c in children)) if children else 0
        yield node, parent, style
        for place, child in enumerate(children):
            child.key = _hash(style, place, child.name)
        stack.extend((c, style) for c in reversed(children))


def contents(node: Node) -> list[str]:
    """The sentences of an element's own text, and its links and images."""
    text = "".join(p for p in node.parts if isinstance(p, str))
    found = [" ".join(s.split()) for s in _SENTENCE.findall(text)]
    return [s for s in found if s] + [f"@{link}" for link in node.links]


def _nodes(pages: DataFrame) -> DataFrame:
    """(key, parent, style, content, n) of each element of each page; content rows have a hash of one content."""

    def task(batches):
        for batch in batches:
            rows: list[tuple] = []
            for url, text in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                for node, parent, style in walk(parse(text or ""), host_of(url)):
                    rows.append((node.key, parent, style, None, 1))
                    counts: dict[int, int] = {}
                    for c in contents(node):
                        h = _hash(c)
                        counts[h] = counts.get(h, 0) + 1
                    rows.extend((node.key, parent, None, h, n) for h, n in counts.items())
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "parent", "style", "content", "n"])

    return pages.select("url", "html").mapInArrow(task, "key long, parent long, style long, content long, n int")


def importance(pages: DataFrame, decay: float = DECAY) -> DataFrame:
    """(key, importance) of the elements of all hosts, composite."""
    n = F.col("n").cast("double")
    sums = P.checkpointed(_nodes(pages).groupBy("key", "parent", "style", "content").agg(F.sum(n).alias("n"), F.sum(n * F.log(n)).alias("nlog")))
    styles, filled = F.col("content").isNull(), F.col("style") != 0
    # entropy of contents over pages: log(N) - sum(n log n)/N; of styles over pages the same, with one row a page
    of = sums.groupBy("key", "parent").agg(
        F.sum(F.when(styles, F.col("n"))).alias("m"), F.sum(F.when(styles, F.col("n") * F.log("n"))).alias("mlog"), F.count_if(styles & filled).alias("l"),
        F.avg(F.when(~styles, F.log("n") - F.col("nlog") / F.col("n"))).alias("h"),
    )
    base = F.log("m")
    spread = (base - F.col("mlog") / F.col("m")) / base
    leaf = 1 - F.coalesce(F.col("h"), F.lit(0.0)) / base
    own = F.when(F.col("m") <= 1, 1.0).when(F.col("l") == 0, leaf).when(F.col("h").isNull(), spread).otherwise(F.greatest(spread, leaf))
    share = F.when(F.col("l") == 0, 0.0).otherwise(F.pow(F.lit(decay), "l"))
    of = P.checkpointed(of.select("key", "parent", "m", ((1 - share) * own).alias("sum"), share.alias("share")))
    # the weight of an element in the one above: share * (pages with its style / pages) / elements of the style
    above = sums.filter(styles & filled).select(F.col("style").alias("parent"), F.col("key").alias("up"), "n").join(of.select(F.col("key").alias("up"), "m", "share"), "up")
    above = above.join(of.groupBy("parent").agg(F.count("*").alias("c")), "parent").select("parent", "up", (F.col("share") * F.col("n") / F.col("m") / F.col("c")).alias("weight"))
    now = P.checkpointed(of.select("key", "parent", "sum").join(above, "parent", "left").select("key", "sum", "up", "weight"))
    while not now.filter("up is not null").limit(1).isEmpty():
        given = now.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum(F.col("weight") * F.col("sum")).alias("more"))
        further = now.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("weight").alias("times"))
        now = now.join(given, "key", "left").join(further, "up", "left")
        now = P.checkpointed(now.select("key", (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"), F.col("next").alias("up"), (F.col("weight") * F.col("times")).alias("weight")))
    return now.select("key", F.col("sum").alias("importance"))


def text_of(root: Node, host: str, noise) -> tuple[str, int]:
    """The text of the branches that aren't noise, blocks on lines of their own, and how many were removed."""
    order = [node for node, *_ in walk(root, host)]
    low: set[int] = set()  # elements that are noise with all below them
    for node in reversed(order):
        if node.key in noise and all(id(c) in low for c in node.children()):
            low.add(id(node))
    out: list[str] = []
    removed = 0
    stack: list = [root]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif id(item) in low:
            removed += 1
        else:
            out.append("\n")
            stack.append("\n")
            stack.extend(reversed(item.parts))
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), removed


def _among(keys: list[int], low: np.ndarray) -> set[int]:
    """The keys that are in a sorted array."""
    found = np.array(keys, np.int64)
    at = np.minimum(np.searchsorted(low, found), max(len(low) - 1, 0))
    return set(found[low[at] == found].tolist()) if len(low) else set()


def _extract(batches, noise_of):
    for batch in batches:
        texts, removed = [], []
        for row, (url, text) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())):
            if text is None:
                texts.append(None)
                removed.append(0)
                continue
            root, host = parse(text), host_of(url)
            t, r = text_of(root, host, noise_of(batch, row, root, host))
            texts.append(t)
            removed.append(r)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["page_id", "url", "text", "removed"])


def extracted(pages: DataFrame, threshold: float = THRESHOLD, decay: float = DECAY, most: int = BROADCAST_NODES) -> DataFrame:
    """(page_id, url, text, removed): the text of each page without the branches of low importance.

    ``removed`` counts the branches. A null page gives a null text, an empty one an empty text; a page of any length and depth is
    taken whole; pages without a host are one site; a site with a single page loses nothing; an importance equal to the threshold
    stays. Repeated rows count as pages each. Keys of low importance travel to all tasks, eight bytes each, up to ``most`` of them;
    beyond that, each page is joined with its own, with the same result. Other columns are not read; an empty table gives no rows.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    low = P.checkpointed(importance(pages, decay).filter(F.col("importance") < threshold).select("key").distinct())
    if low.count() <= most:
        noise = P.Shared(pages.sparkSession, np.sort(low.toPandas()["key"].to_numpy().astype(np.int64)))
        return pages.mapInArrow(lambda batches: _extract(batches, lambda batch, row, root, host: _among([node.key for node, *_ in walk(root, host)], noise.value)), _SCHEMA)

    def keys(batches):
        for batch in batches:
            urls, htmls = batch.column("url").to_pylist(), batch.column("html").to_pylist()
            found = [[node.key for node, *_ in walk(parse(h or ""), host_of(u))] for u, h in zip(urls, htmls)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "keys"])

    marked = pages.withColumn("id", F.xxhash64("page_id", "url", "html"))
    of = marked.select("id", "url", "html").mapInArrow(keys, "id long, keys array<long>").select("id", F.explode("keys").alias("key"))
    own = of.join(low, "key").groupBy("id").agg(F.collect_set("key").alias("noise"))
    joined = marked.join(own, "id", "left").select("page_id", "url", "html", "noise")
    return joined.mapInArrow(lambda batches: _extract(batches, lambda batch, row, root, host: frozenset(batch.column("noise")[row].as_py() or ())), _SCHEMA)
