"""Main text of web pages by a site style tree.

Pages of one host are merged into a tree of styles: a node is a path of elements with their classes and ids, menus, headers and footers
included. Of each node the first pass counts on how many pages it stands, how its children vary (presentation) and on how many pages
each of its texts stands (content). Pages of one host with equal blocks count as one, so that copies do not look like a template.
Importance is the node's entropy against the logarithm of its page count: a node that shows the same few texts on all pages of a host
carries little, one whose texts are new on each page carries much. To it comes what the markup tells: ARTICLE for what a page marks as its
article, less NOISE for elements that HTML or their names call menus, forms, adverts, comments, ..., less LINKS for the share of a node's
blocks outside an article that are links alone. The second pass removes the branches of low importance from each page and writes what is
left; only elements that are never shown as text (scripts, styles, ...) go without being judged.

Counts are summed by key before they are shuffled, so a host with a third of all pages is no hot key. The nodes to
remove are broadcast while there are at most BROADCAST_NODES; beyond that each page is joined with its own ones.

Defined results: a null or empty html gives an empty text and 0 characters; a null url counts as a host of its own;
broken markup is read as far as it goes, nesting of any depth; repeated rows are extracted each; of a host with one page all that the
markup does not call noise stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

THRESHOLD = 0.35  # importance below which a branch goes
ARTICLE, NOISE, LINKS = 0.2, 1.0, 0.7  # what the markup adds to importance or takes from it
PRESENTATION = 0.1  # weight of a node's presentation against its content
BROADCAST_NODES = 200_000
SCHEMA = "page_id long, url string, text string, n_chars long"

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head script style title noscript template textarea iframe object svg canvas audio video map noembed noframes xmp".split())
NOISY = frozenset("nav footer aside form button select option input label fieldset dialog menu".split())
CONTENT = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY_SAME = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select", "thead": "table", "tbody": "table"}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
# Words in classes and ids that name what is not the article.
NOISE_NAMES = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|masthead|site-?header|header|comments?|disqus|respond|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|widget|toolbar|pagination|pager|tags?|skip|copyright)(?:$|[-_\s\d])", re.I)
NOT_CONTENT = re.compile(r"(?:^|[-_\s])(?:comments?|repl(?:y|ies)|ads?|advert\w*|sidebar|related)(?:$|[-_\s\d])", re.I)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


class Node:
    """An open element: its style node, that one's parent, the styles of its children, and what the markup says of it."""

    __slots__ = ("name", "key", "parent", "children", "hidden", "noise", "article")

    def __init__(self, name: str, key: int, parent: int, hidden: bool, noise: bool, article: bool):
        self.name, self.key, self.parent, self.hidden, self.noise, self.article = name, key, parent, hidden, noise, article
        self.children: list[str] = []


def parse(html: str, host: str = "") -> tuple[list[tuple[int, int, str, bool, bool, bool]], list[tuple[int, str]]]:
    """Blocks (node, its parent, text, in the article, noise, only links) in page order, and each node's (node, child styles). Nodes are
    hashes of host and path, each made from its parent's, so depth costs nothing."""
    root = Node("", hashed(host), 0, False, False, False)
    stack, blocks, nodes = [root], [], []
    opened: dict[str, int] = {}
    piece: list[str] = []
    linked = plain = 0
    owner = root
    at = 0

    def flush() -> None:
        nonlocal linked, plain, piece
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                blocks.append((owner.key, owner.parent, text, owner.article, owner.noise, linked > 0 and plain == 0))
            piece = []
        linked = plain = 0

    def say(raw: str) -> None:
        nonlocal owner, linked, plain
        if stack[-1].hidden or not raw:
            return
        if not piece:
            k = len(stack) - 1
            while k and stack[k].name in INLINE:
                k -= 1
            owner = stack[k]
        text = unescape(raw) if "&" in raw else raw
        piece.append(text)
        if not text.isspace():
            if opened.get("a"):
                linked += 1
            else:
                plain += 1

    def pop() -> None:
        node = stack.pop()
        opened[node.name] -= 1
        if node.name not in INLINE:
            flush()
            if node.children:
                nodes.append((node.key, " ".join(node.children)))

    def close(alike: tuple[str, ...], stop) -> None:
        """Close the nearest open element of these names, unless one that stops the search is nearer."""
        if any(opened.get(x) for x in alike):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in alike:
                    while len(stack) > k:
                        pop()
                    break
                if stop(stack[k].name):
                    break

    skip_to = 0
    for found in TAG.finditer(html):
        begin = found.start()
        if begin < skip_to:
            continue
        if begin > at:
            say(html[at:begin])
        at = found.end()
        closing, name, rest = found.groups()
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name == "br" or name == "p" and not opened.get("p"):
                if piece:
                    piece.append(" ")
                continue
            close((name,), (lambda other: other not in INLINE) if name in INLINE else (lambda other: False))
            continue
        if name in CLOSES_P:
            close(("p",), lambda other: other not in INLINE)
        elif name in CLOSED_BY_SAME:
            stop = CLOSED_BY_SAME[name].split()
            close(("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,), stop.__contains__)
        if name in VOID:
            if name in ("br", "hr") and piece:
                piece.append(" ")
            continue
        top = stack[-1]
        style, hidden, noise = name, top.hidden or name in HIDDEN, top.noise or name in NOISY
        if rest and not rest.isspace() and not hidden and (name not in INLINE or "hid" in rest or "none" in rest):
            own = {a.lower(): b or c or d for a, b, c, d in ATTR.findall(rest)}
            hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
            named = f"{own.get('class', '')} {own.get('id', '')}".strip()
            if named and name not in INLINE:
                style += "." + re.sub(r"\d+", "0", named)
                if name in CONTENT:
                    noise = noise or bool(NOT_CONTENT.search(named))
                elif name not in ("html", "body"):
                    told = NOISE_NAMES.search(named)
                    noise = noise or bool(told) and not (top.article and "header" in told[0].lower())
            noise = noise or own.get("role", "").lower() in ROLES
        noise = noise or name == "header" and not top.article
        if name in INLINE:
            key, parent = top.key, top.parent
        else:
            flush()
            style += "!" if noise else ""
            top.children.append(style)
            key, parent = hashed(str(top.key), style), top.key
        if rest.endswith("/") and name in ("svg", "path"):
            continue
        stack.append(Node(name, key, parent, hidden, noise, top.article or (name in CONTENT and not noise)))
        opened[name] = opened.get(name, 0) + 1
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            skip_to = at = len(html) if end is None else end.start()
    if at < len(html):
        say(html[at:])
    while len(stack) > 1:
        pop()
    flush()
    return blocks, nodes


def hashed(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))


signed = lambda x: x - 2**64 if x >= 2**63 else x
#: Kinds of features: 0 a block stands there (what the markup says), 1 presentation, 2 content, 3 an inner node, 4 a block of links alone, 5 another block.
SEEN, SHAPE, TEXT, INNER, LINKED, PLAIN = range(6)


def page_styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: host, a digest of its blocks, and of each of its features style node, parent, kind, feature."""
    kinds = pa.list_(pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64())]))
    for batch in batches:
        seen: dict = {}
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if not html:
                continue
            host = host_of(url)
            blocks, nodes = parse(html, host)
            digest = xxhash.xxh3_128_digest(repr((blocks, nodes)).encode("utf-8", "surrogatepass"))
            if (host, digest) in seen:
                continue
            own = set()
            for key, parent, text, article, noise, links in blocks:
                own.add((signed(key), signed(parent), SEEN, int(article) + 2 * int(noise)))
                own.add((signed(key), 0, TEXT, signed(hashed(text))))
                own.add((signed(key), 0, LINKED if links and not article else PLAIN, 0))
            for key, children in nodes:
                own.add((signed(key), 0, INNER, 0))
                own.add((signed(key), 0, SHAPE, signed(hashed(children))))
            seen[host, digest] = [dict(zip(("node", "parent", "kind", "feature"), x, strict=True)) for x in own]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([d for _, d in seen], pa.binary()), pa.array(list(seen.values()), kinds)], ["host", "digest", "styles"])


def importance(pages: DataFrame) -> DataFrame:
    """node, importance of the style nodes that have text. pages: page_id, url, html."""
    styles = pages.mapInArrow(page_styles, "host string, digest binary, styles array<struct<node: long, parent: long, kind: int, feature: long>>")
    distinct = styles.groupBy("host", "digest").agg(F.first("styles").alias("styles"))
    counts = distinct.select(F.inline("styles")).groupBy("node", "parent", "kind", "feature").agg(F.count("*").alias("pages"))
    n, log = F.col("pages"), lambda x: F.log(F.greatest(x, F.lit(1)).cast("double"))
    pick = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    nodes = counts.groupBy("node").agg(
        F.max(F.when(F.col("kind") == SEEN, F.col("parent"))).alias("parent"), F.max(F.when(F.col("kind") == SEEN, F.col("feature"))).alias("told"),
        pick(SEEN, n).alias("m"), pick(TEXT, n).alias("texts"), pick(TEXT, n * log(n)).alias("text_sum"),
        pick(INNER, n).alias("m_inner"), pick(SHAPE, -n * log(n)).alias("shape_sum"), pick(SHAPE, n).alias("shapes"),
        F.coalesce(pick(LINKED, n), F.lit(0)).alias("linked"), F.coalesce(pick(PLAIN, n), F.lit(0)).alias("plain"),
    )
    content = F.when(F.col("m") > 1, 1 - F.col("text_sum") / F.col("texts") / log(F.col("m"))).otherwise(1.0)
    # of p = n / m: -sum p log_m p
    shape = F.when(F.col("m_inner") > 1, (log(F.col("m_inner")) + F.col("shape_sum") / F.col("shapes")) / log(F.col("m_inner"))).otherwise(1.0)
    leaves = nodes.filter("m is not null").select("node", "parent", "told", content.alias("content"), (F.col("linked") / (F.col("linked") + F.col("plain"))).alias("links"))
    shapes = nodes.filter("m_inner is not null").select(F.col("node").alias("parent"), shape.alias("shape"))
    markup = ARTICLE * F.col("told").bitwiseAND(1) - NOISE * F.shiftright("told", 1) - LINKS * F.col("links")
    judged = PRESENTATION * F.coalesce("shape", F.lit(1.0)) + (1 - PRESENTATION) * F.col("content") + markup
    return leaves.join(shapes, "parent", "left").select("node", judged.alias("importance"))


def unimportant(pages: DataFrame) -> DataFrame:
    """node: the style nodes whose importance is below the threshold."""
    return importance(pages).filter(F.col("importance") < THRESHOLD).select("node")


def main_text(url: str | None, html: str | None, low) -> str:
    """low: the nodes to remove."""
    return " ".join(text for key, _, text, *_ in parse(html, host_of(url))[0] if signed(key) not in low) if html else ""


def _texts(batch: pa.RecordBatch, lows) -> pa.RecordBatch:
    urls = batch.column(1).to_pylist()
    texts = [main_text(url, html.as_py(), low) for url, html, low in zip(urls, batch.column(2), lows, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def _page_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: key, url, html. The style nodes with text of each page."""
    for batch in batches:
        found = [(key, node) for key, url, html in zip(*(x.to_pylist() for x in batch.columns), strict=True) if html for node in {signed(b[0]) for b in parse(html, host_of(url))[0]}]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["key", "node"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    low = Scratch(spark, "styles").keep(unimportant(own))
    if low.count() <= broadcast_nodes:
        held = spark.sparkContext.broadcast(frozenset(low.toArrow().column(0).to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _texts(batch, [held.value] * batch.num_rows)

        return own.mapInArrow(run, SCHEMA)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _texts(batch, [frozenset(x or ()) for x in batch.column(3).to_pylist()])

    # a node's pages meet it in a plain join, which Spark splits where a node is common; a page's own nodes are bounded by its html
    keyed = own.withColumn("key", F.xxhash64("url", "html"))
    mine = keyed.select("key", "url", "html").mapInArrow(_page_nodes, "key long, node long").distinct().join(low, "node").groupBy("key").agg(F.collect_list("node").alias("low"))
    return keyed.join(mine, "key", "left").select("page_id", "url", "html", "low").mapInArrow(run_joined, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
