"""Main text of web pages by a style tree of each site.

A page's blocks (text between block elements) hang below a path of labels: each block element's name, classes and id. Pages of one
host are merged by these paths, counted in the cluster. A node of the style tree has an importance between 0 and 1, from

- its contents: a text on c of the m pages that have the node has the entropy ``ln c / ln m``; importance is 1 less that, averaged over the
  characters at and below the node;
- its presentation: the entropy of how its pages arrange what is below it;
- what its label says: menus, footers, forms, notices and the like (``DROPPED``, ``WORDS``) have none, whatever they hold. This is all
  that is known of a site with few pages.

Branches of low importance go, and single texts of low importance (``LOW``). Pages that hold the same blocks count once, so that copies of a page are no
boilerplate; inside of an article only what nearly every page repeats goes (``LOW_INSIDE``). Of what is left, an article (or
``main``) is taken alone if there is one; without one, lists of links go too.

What the tree removes is at most a list for each host, of texts that most of its pages share. It is joined to pages by host: as
a broadcast below a measured size, else by a shuffle that skew handling may split. Pages are parsed where they are read, once for the tree and once
for the text, and no site is collected: a host with most of all pages is counted by (host, path, text).

Defined results: null or empty html has the text ""; a null url is a site of its own for each page; unclosed elements end with the page; very long
pages are taken whole; repeated rows give repeated rows; ties cannot arise, as all counts are compared with bounds; an empty table gives no rows; only the
named columns are read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, store

#: Pages that a node must be on before its entropy counts.
LEAST_PAGES = 8
#: Importance at and below which nodes and texts go outside of articles, and texts inside.
LOW, LOW_TEXT, LOW_INSIDE = 0.2, 0.1, 0.02
#: Part of a node's importance that its presentation has.
PRESENTATION = 0.3
#: Share of linked characters above which a block outside of articles is a menu.
LINKED = 0.6
#: Labels of a path: what lies deeper shares its path.
DEPTH = 256
#: Bytes of the removal lists that every task may be sent.
BROADCAST_BYTES = 16 << 20

# Names of HTML elements and words of class names.
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand within a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements without article text.
DROPPED = frozenset("head script style noscript template nav footer aside form fieldset button select textarea title iframe svg canvas object applet menu dialog audio video map datalist noembed noframes xmp".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class names and ids whose elements are not the article.
WORDS = frozenset(
    "ad ads adbox adslot adunit adsense advert adverts advertisement advertising sponsor sponsors sponsored promo promos promotion banner banners sidebar sidebars nav navbar navigation "
    "menu menus submenu footer foot masthead topbar toolbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay "
    "comment comments commentlist commentary disqus replies reply respond discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "pagination pager widget widgets copyright disclaimer search header site-header".split()
)
#: A word after one of these says what a page has, not what the element is.
NEGATING = frozenset("has with no without is".split())
#: Closed by the next one of their kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What an unclosed element is not sought beyond.
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"  # comments
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|[^>=]++)*+)>"  # tags: a quoted value may hold >
    r"|<[!?/][^>]*+>?"  # declarations, and what browsers take for comments
    r"|<[a-zA-Z][^>]*+\Z",  # a tag that the page's end cuts off
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
HEADING = re.compile(r"h[1-6]\Z")
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}


class Block(NamedTuple):
    path: tuple[str, ...]  # labels from the outermost element on
    text: str
    linked: int  # characters in links
    inside: str  # "article", "main" or ""


class Page(NamedTuple):
    blocks: list[Block]
    orders: list[tuple[tuple[str, ...], tuple[str, ...]]]  # paths of nodes, and the labels right below them, in order


def _words(names: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower()) if w]


def _unimportant(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element's label says that it is no article text."""
    if name in DROPPED or attributes.get("role", "").lower() in DROPPED_ROLES:
        return True
    if name in ("html", "body", "main"):
        return False
    for kind in ("class", "id"):
        for one in attributes.get(kind, "").split():
            words = _words(one)
            if any(w in WORDS and not (at and words[at - 1] in NEGATING) for at, w in enumerate(words)):
                return True
    return False


def _label(name: str, attributes: dict[str, str]) -> str:
    """What elements of one style share: numbers in names do not count."""
    names = sorted(attributes.get("class", "").split()) + ["#" + x for x in attributes.get("id", "").split()]
    return ".".join([name, *(re.sub(r"\d+", "0", x) for x in names)])


class _Element:
    """An open element; ``path``: labels of the block elements down to it."""

    __slots__ = ("below", "dropped", "headings", "in_heading", "inside", "label", "name", "path")

    def __init__(self, name: str, label: str, path: tuple[str, ...], dropped: bool, headings: bool, in_heading: bool, inside: str):
        self.name, self.label, self.path, self.dropped, self.headings, self.in_heading, self.inside, self.below = name, label, path, dropped, headings, in_heading, inside, []


def parse(html: str) -> Page:
    """The blocks that labels do not rule out, in page order."""
    stack = [_Element("", "", (), False, False, False, "")]
    open_: dict[str, int] = {}
    blocks: list[Block] = []
    orders: list[tuple[tuple[str, ...], tuple[str, ...]]] = []
    parts: list[str] = []
    linked = at = 0
    end = len(html)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append(Block(stack[-1].path, text, min(linked, len(text)), stack[-1].inside))
        linked = 0

    def close() -> None:
        element = stack.pop()
        open_[element.name] -= 1
        if element.below and element.label:
            orders.append((element.path, tuple(element.below)))

    def read(text: str) -> None:
        nonlocal linked
        top = stack[-1]
        if text and not top.dropped and (not top.headings or top.in_heading):
            text = references.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) if open_.get("a") else 0

    while at < end:
        found = TOKEN.search(html, at)
        if not found:
            read(html[at:])
            break
        read(html[at : found.start()])
        at = found.end()
        name = found[2]
        if not name:
            continue
        name = name.lower()
        if found[1]:  # an end tag
            if open_.get(name):
                if name not in INLINE:
                    flush()
                while stack[-1].name != name:
                    close()
                close()
            elif name in ("br", "p"):
                parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        block = name not in INLINE
        if block:
            flush()
            if open_.get("p") and name not in RAW:
                while stack[-1].name != "p":
                    close()
                close()
            for ended in CLOSES.get(name, ()):
                depth = len(stack) - 1 if open_.get(ended) else 0
                while depth and stack[depth].name not in HOLDS[name] and stack[depth].name != ended:
                    depth -= 1
                if depth and stack[depth].name == ended:
                    while len(stack) > depth:
                        close()
        if name in RAW:
            rest = RAW_ENDS[name].search(html, at)
            at = rest.end() if rest else end
            continue
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed([*ATTRIBUTE.finditer(found[3])])} if "=" in found[3] else {}
        above = stack[-1]
        inside, headings, dropped = above.inside, above.headings, above.dropped
        if not dropped:
            if name == "header" or name != "body" and any("header" in _words(x) for x in attributes.get("class", "").split()):
                dropped, headings = not inside, True  # an article's own header gives its headings
            else:
                dropped = _unimportant(name, attributes)
            if not dropped and (name in ("article", "main") or attributes.get("role") in ("main", "article")):
                inside = "article" if "article" in (inside, name, attributes.get("role")) else "main"
        label, path = "", above.path
        if block:
            label = _label(name, attributes)
            path = (*path, label) if len(path) < DEPTH else path
            if not dropped and (not above.below or above.below[-1] != label):
                above.below.append(label)
        stack.append(_Element(name, label, path, dropped, headings, above.in_heading or bool(HEADING.match(name)), inside))
        open_[name] = open_.get(name, 0) + 1
    flush()
    while len(stack) > 1:
        close()
    return Page(blocks, orders)


def _number(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _path_number(path: tuple[str, ...]) -> int:
    return _number("\x1f".join(path))


def host(url):
    """Column of an address' host in lower case, null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(found != "", found)


#: kind 0: a page has the path; 1: an order below the path; 2: a text at the path.
NODE, ORDER, TEXT = 0, 1, 2


def style_rows(pages: DataFrame) -> DataFrame:
    """``host, page, path, kind, feature, chars, chain, inside`` of ``pages(host, html)``: what each page adds to its site's style tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "page", "path", "kind", "feature", "chars", "chain", "inside"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
        for batch in batches:
            rows = []
            for site, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(html)
                texts = {}
                for b in page.blocks:
                    texts.setdefault((b.path, _number(b.text)), b)
                number = xxhash.xxh64_intdigest(b"".join(f.to_bytes(8, "big", signed=True) for _, f in texts)) - (1 << 63)
                chains = {}
                for path in {p for p, _ in texts}:
                    chains[path] = [_path_number(path[:i]) for i in range(1, len(path) + 1)]
                for (path, feature), b in texts.items():
                    rows.append((site, number, _path_number(path), TEXT, feature, len(b.text), None, bool(b.inside)))
                nodes = {path[:i]: None for path in chains for i in range(1, len(path) + 1)}
                container = {b.path[:i] for b in page.blocks if b.inside for i in range(1, len(b.path) + 1)}
                for path in nodes:
                    rows.append((site, number, _path_number(path), NODE, 0, 0, chains.get(path), path in container))
                for path, order in {o for o in page.orders if o[0] in nodes}:
                    rows.append((site, number, _path_number(path), ORDER, _number("\x1f".join(order)), 0, None, path in container))
            columns = [*zip(*rows, strict=True)] or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return pages.mapInArrow(run, "host string, page long, path long, kind int, feature long, chars long, chain array<long>, inside boolean")


def removals(pages: DataFrame) -> DataFrame:
    """``host, removed``: the nodes (feature 0) and texts of low importance of every site, as a list of structs (path, feature). Stored."""
    seen = style_rows(pages.where(F.col("host").isNotNull())).groupBy("host", "page", "path", "kind", "feature")
    seen = seen.agg(F.max("chars").alias("chars"), F.max("chain").alias("chain"), F.max("inside").alias("inside"))
    counts = seen.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("c"), F.max("chars").alias("chars"), F.max("chain").alias("chain"), F.max("inside").alias("inside"))
    counts = store(counts, "style-counts")
    weight = F.when(F.col("kind") == TEXT, F.col("chars") * F.col("c")).otherwise(0)
    nodes = counts.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == NODE, F.col("c"))).alias("m"),
        F.sum(weight).alias("weight"),
        F.max("chain").alias("chain"),
        F.max("inside").alias("inside"),
        # of the orders: -sum p ln p = ln m - sum c ln c / m
        F.sum(F.when(F.col("kind") == ORDER, F.col("c") * F.log("c"))).alias("ordered"),
    )
    nodes = store(nodes.where("m is not null"), "style-nodes")
    scale = lambda m: F.log(F.greatest(m, F.lit(LEAST_PAGES)))
    many = nodes.where(F.col("m") >= LEAST_PAGES)
    repeated = counts.where((F.col("kind") == TEXT) & (F.col("c") > 1)).select("host", "path", "feature", "c", "chars")
    entropy = F.log("c") / scale(F.col("m"))
    texts = store(repeated.join(nodes.select("host", "path", "m", "inside"), ["host", "path"]).withColumn("entropy", entropy), "style-texts")
    lost = texts.groupBy("host", "path").agg(F.sum(F.col("chars") * F.col("c") * F.col("entropy")).alias("lost"))
    leaves = nodes.where(F.col("weight") > 0).join(lost, ["host", "path"], "left").select("host", F.explode("chain").alias("path"), "weight", F.coalesce("lost", F.lit(0.0)).alias("lost"))
    below = leaves.groupBy("host", "path").agg(F.sum("weight").alias("weight"), F.sum("lost").alias("lost"))
    content = 1 - F.col("lost") / F.col("w")
    presented = F.coalesce((F.log("m") - F.col("ordered") / F.col("m")) / F.log("m"), F.lit(0.0))
    judged = many.join(below.withColumnRenamed("weight", "w"), ["host", "path"]).withColumn("importance", PRESENTATION * presented * content + (1 - PRESENTATION) * content)
    low_nodes = judged.where((F.col("importance") <= LOW) & ~F.col("inside")).select("host", "path", F.lit(0).cast("long").alias("feature"))
    least = F.when(F.col("inside"), F.lit(LOW_INSIDE)).otherwise(F.lit(LOW_TEXT))
    low_texts = texts.where((F.col("m") >= LEAST_PAGES) & (1 - F.col("entropy") <= least)).select("host", "path", "feature")
    return store(low_nodes.unionByName(low_texts).groupBy("host").agg(F.collect_list(F.struct("path", "feature")).alias("removed")), "style-removed")


def main_text(html: str, removed: set[tuple[int, int]]) -> str:
    """The text that is left when ``removed`` nodes (path, 0) and texts (path, feature) are gone."""
    blocks = parse(html).blocks
    if removed:
        known: dict[tuple[str, ...], tuple[int, bool]] = {}
        kept = []
        for b in blocks:
            if b.path not in known:
                known[b.path] = _path_number(b.path), any((_path_number(b.path[:i]), 0) in removed for i in range(1, len(b.path) + 1))
            number, gone = known[b.path]
            if not gone and (number, _number(b.text)) not in removed:
                kept.append(b)
        blocks = kept
    for kind in ("article", "main"):
        if any(b.inside == kind for b in blocks):
            return " ".join(b.text for b in blocks if b.inside == kind)
    return " ".join(b.text for b in blocks if b.linked <= LINKED * len(b.text))


def site_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every row."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), blank(F.col(html_col)).alias("html"))
    gone = removals(rows.select("host", "html"))
    size = gone.agg(F.sum(F.size("removed") * 16 + F.length("host") + 32)).first()[0] or 0
    small = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    joined = rows.join(small, "host", "left").select("id", "url", "html", "removed")
    schema = joined.select("id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, set()
        for batch in batches:
            texts = []
            for html, removed in zip(batch.column(2), batch.column(3), strict=True):
                pairs = removed.as_py()
                if pairs != last:
                    last, known = pairs, {(x["path"], x["feature"]) for x in pairs or ()}
                texts.append(main_text(html.as_py(), known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, schema).toDF(id_col, url_col, "text", "n_chars")


#: The given pages hold their article in an element of that name; of character references they hold these.
SQL = r"""
WITH bodies AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages
), plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|h[1-6]|br|ul|ol|li|div|blockquote|hr)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM bodies
), decoded AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;?', '&', 'g'), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS text FROM plain
)
SELECT page_id, url, text, length(text) AS n_chars FROM decoded
"""
