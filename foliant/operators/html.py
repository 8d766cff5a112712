"""HTML pages as node tables: parsing, safety, units (TR01-TR06, TR09, TR19, FLT02-FLT08, FN39, FN42, JN31, SRC06, AG21-AG22,
RM02-RM06, RM08).

A page is parsed by a grouped Arrow function into rows with pre- and post-order numbers, so that every
ancestor test is a comparison of two numbers.  Everything after the parser is relational.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import has_unsafe_css, has_unsafe_scheme, is_local_asset, markdown_destination, relative_asset, squeeze
from ..storage import materialise

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
DISALLOWED = ["script", "style", "iframe", "object", "embed", "form", "input", "button", "link", "meta", "base", "template"]
PROTECTED = ["math", "cite", "code", "pre", "svg", "img", "object", "a"]
PROTECTED_CLASSES = ["ltx_cite", "ltx_ref", "ltx_equation", "ltx_verbatim"]
NODES = (
    "doc_id string, node_id long, parent_id long, ordinal int, depth int, pre long, post long, type string, tag string,"
    " attrs map<string,string>, text string"
)


_MARK = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_COMMENT_END = re.compile("--!?>")
_TAG_END = re.compile(r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*=+\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style")}


def _events(source: str) -> Iterator[tuple]:
    """(kind, tag, attributes, text) of a page in time linear in it; kinds: text, open, single, close.

    Comments, declarations and instructions are left out, one that never ends with all that follows.  A mark that no
    ``>`` ends is text.  After a tag whose quotes never close, quotes are ordinary characters.
    """
    at, n, last, quotes, text = 0, len(source), source.rfind(">"), True, ""
    while at < n:
        m = _MARK.search(source, at)
        if m is None or (not m[1] and m.end() > last):
            text += unescape(source[at:])
            break
        if at < m.start():
            text += unescape(source[at : m.start()])
        if m[1]:
            end = _COMMENT_END.search(source, m.end())
            at = end.end() if end else n
            continue
        end = _TAG_END.match(source, m.end()) if m[3] and quotes else None
        if m[3] and end is None:
            quotes = False
        at = end.end() if end else source.index(">", m.end()) + 1
        if not m[3]:
            continue
        if text:
            yield "text", None, None, text
            text = ""
        tag = m[3].lower()
        if m[2]:
            yield "close", tag, None, None
            continue
        inner = source[m.end() : at - 1]
        attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(inner)} if inner else {}
        yield "single" if inner.endswith("/") else "open", tag, attrs, None
        if tag in _RAW_END and not inner.endswith("/"):
            end = _RAW_END[tag].search(source, at)
            if at < (end.start() if end else n):
                yield "text", None, None, source[at : end.start() if end else n]
            at = end.end() if end else n
            yield "close", tag, None, None
    if text:
        yield "text", None, None, text


class _Builder:
    """Node rows of one page; end tags without an open element are passed over."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.stack: list[int] = []
        self.counts: list[int] = []
        self.open: Counter = Counter()
        self.clock = 0

    def _add(self, kind: str, tag: str | None, attrs: dict | None, text: str | None) -> int:
        parent = self.stack[-1] if self.stack else None
        ordinal = 0
        if self.counts:
            ordinal, self.counts[-1] = self.counts[-1], self.counts[-1] + 1
        self.clock += 1
        self.rows.append([len(self.rows), parent, ordinal, len(self.stack), self.clock, self.clock, kind, tag, attrs, text])
        return len(self.rows) - 1

    def _close(self) -> None:
        self.counts.pop()
        self.clock += 1
        row = self.rows[self.stack.pop()]
        row[5] = self.clock
        self.open[row[7]] -= 1

    def feed(self, source: str) -> None:
        for kind, tag, attrs, text in _events(source):
            if kind == "text":
                self._add("text", None, None, text)
            elif kind == "close":
                if self.open[tag]:
                    while self.rows[self.stack[-1]][7] != tag:
                        self._close()
                    self._close()
            else:
                if kind == "open" and tag in ("p", "li", "tr", "td", "th") and self.stack and self.rows[self.stack[-1]][7] == tag:
                    self._close()
                at = self._add("element", tag, attrs, None)
                if kind == "open" and tag not in VOID:
                    self.stack.append(at)
                    self.counts.append(0)
                    self.open[tag] += 1
        while self.stack:
            self._close()


_FIELDS = [
    ("doc_id", pa.string()), ("node_id", pa.int64()), ("parent_id", pa.int64()), ("ordinal", pa.int32()), ("depth", pa.int32()), ("pre", pa.int64()), ("post", pa.int64()),
    ("type", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
]
#: Nodes of an output batch, about.
BATCH_NODES = 20_000


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

    for batch in batches:
        for doc, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            b = _Builder()
            b.feed(html or "")
            for row in b.rows:
                if row[8] is not None:
                    row[8] = list(row[8].items())
                held.append([doc, *row])
            if len(held) >= BATCH_NODES:
                yield flush()
    if held:
        yield flush()


def parse_html(pages: DataFrame, doc: str = "doc_id", html: str = "html") -> DataFrame:
    """TR01: pages to node rows; comments are dropped, text is decoded."""
    return pages.select(F.col(doc).cast("string").alias("doc_id"), F.col(html).alias("html")).mapInArrow(_parse, NODES)


def node_table(pages: DataFrame, doc: str = "doc_id", html: str = "html") -> DataFrame:
    """The node rows written out once, for operators that read them several times."""
    return materialise(parse_html(pages, doc, html), "nodes")


def inner_html(nodes: DataFrame) -> DataFrame:
    """TR01: node rows back to text; attributes sorted by name."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(
        F.lit(" "), e["key"], F.lit('="'), F.replace(esc(e["value"]), F.lit('"'), F.lit("&quot;")), F.lit('"'))), "")
    opens = nodes.select("doc_id", F.col("pre").alias("at"), F.when(F.col("type") == "text", esc(F.col("text"))).otherwise(F.concat(F.lit("<"), "tag", attrs, F.lit(">"))).alias("s"))
    ends = nodes.where("type = 'element'").where(~F.col("tag").isin(sorted(VOID))).select("doc_id", F.col("post").alias("at"), F.concat(F.lit("</"), "tag", F.lit(">")).alias("s"))
    parts = F.array_sort(F.collect_list(F.struct("at", "s")))
    return opens.union(ends).groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("html"))


def attr(name: str) -> Column:
    """RM08."""
    return F.try_element_at(F.col("attrs"), F.lit(name))


def has_class(name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attr("class"), r"\s+"), name), F.lit(False))


def _cover(nodes: DataFrame, tops: DataFrame, strict: bool) -> DataFrame:
    """``nodes`` with __cover, the number of tops around each: a running sum of opened less closed ones in page order."""
    own = nodes.select("doc_id", F.col("pre").alias("at"), F.lit(0 if strict else 1).alias("turn"), F.lit(0).alias("d"), F.struct(*nodes.columns).alias("n"))
    end = lambda at, turn, d: F.struct(F.col(at).alias("at"), F.lit(turn).alias("turn"), F.lit(d).alias("d"))
    edges = tops.select("doc_id", F.inline(F.array(end("pre", 1 if strict else 0, 1), end("post", 2, -1))))
    rows = own.union(edges.withColumn("n", F.lit(None).cast(own.schema["n"].dataType)))
    w = W.partitionBy("doc_id").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("c", F.sum("d").over(w)).where("n is not null").select("n.*", F.col("c").alias("__cover"))


def below(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """TR02: nodes strictly inside any of the tops."""
    return _cover(nodes, tops, True).where("__cover > 0").drop("__cover")


def not_below(nodes: DataFrame, tops: DataFrame, strict: bool = False) -> DataFrame:
    """TR02: nodes outside all of the tops (with ``strict`` the tops themselves stay)."""
    return _cover(nodes, tops, strict).where("__cover = 0").drop("__cover")


def _held(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """doc_id, top, held: each top with the nodes strictly inside it, in page order.

    Nodes are numbered in page order and a top holds those between the numbers at its two ends, a slice of its page's
    array: one shuffle, and work that grows with nodes, tops and what they hold, not with their product.
    """
    n = nodes.select("doc_id", F.col("pre").alias("at"), F.lit(0).alias("turn"), F.lit(1).alias("d"), F.struct(*nodes.columns).alias("node"))
    end = lambda at, turn: F.struct(F.col(at).alias("at"), F.lit(turn).alias("turn"), F.lit(0).alias("d"))
    t = tops.select("doc_id", F.struct(*tops.columns).alias("top"), F.monotonically_increasing_id().alias("row"), F.array(end("pre", 1), end("post", 2)).alias("ends"))
    of_node, of_top = n.schema["node"].dataType, t.schema["top"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    edges = t.select("doc_id", "top", "row", F.inline("ends")).select("doc_id", "at", "turn", "d", none(of_node).alias("node"), "top", "row")
    rows = n.withColumns({"top": none(of_top), "row": none("long")}).union(edges)
    w = W.partitionBy("doc_id").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("k", F.sum("d").over(w))
    by = lambda key: lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)
    some = lambda turn, *what: F.collect_list(F.when(F.col("turn") == turn, F.struct(*what)))
    page = rows.groupBy("doc_id").agg(
        F.array_sort(some(0, "k", "node"), by("k")).alias("n"), F.array_sort(some(1, "row", "k", "top"), by("row")).alias("a"), F.array_sort(some(2, "row", "k"), by("row")).alias("b")
    )
    inside = lambda a, b: F.transform(F.slice("n", (a["k"] + 1).cast("int"), (b["k"] - a["k"]).cast("int")), lambda x: x["node"])
    held = F.zip_with("a", "b", lambda a, b: F.struct(a["top"].alias("top"), inside(a, b).alias("held")))
    return page.where(F.size("a") > 0).select("doc_id", F.inline(held))


def pairs_below(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """TR02: (doc_id, top, node) structs of each top with each node strictly inside it; a top without one has a null node."""
    return _held(nodes, tops).select("doc_id", "top", F.explode_outer("held").alias("node"))


def plain_text(nodes: DataFrame, tops: DataFrame, key: str = "node_id", skip: list[str] | None = None, squeezed: bool = True) -> DataFrame:
    """TR03: (squeezed) text inside each top, in page order; subtrees of the skipped tags left out."""
    text = nodes.where("type = 'text'")
    if skip:
        text = not_below(text, nodes.where(F.col("tag").isin(skip)))
    return with_text(text, tops.select("doc_id", "pre", "post", F.col(key).alias("__key")), squeezed).select("doc_id", F.col("__key").alias(key), "text")


def with_text(texts: DataFrame, tops: DataFrame, squeezed: bool = True, name: str = "text") -> DataFrame:
    """TR03: the tops with the (squeezed) text nodes inside each, in page order; still dealt by document."""
    joined = F.array_join(F.transform("held", lambda x: F.coalesce(x["text"], F.lit(""))), "")
    own = [F.col(f"top.{c}").alias(c) for c in tops.columns if c not in ("doc_id", name)]
    return _held(texts.select("doc_id", "pre", "text"), tops).select("doc_id", *own, (squeeze(joined) if squeezed else joined).alias(name))


def sanitize(nodes: DataFrame, local_only: bool = False) -> DataFrame:
    """FLT04-FLT06, RM03: disallowed subtrees go; handlers, unsafe addresses and styles lose their attribute."""
    kept = not_below(nodes, nodes.where(F.col("tag").isin(DISALLOWED)))

    def safe(k: Column, v: Column) -> Column:
        fine = k.rlike(r"^[a-z][a-z0-9:_.\-]*$") & ~k.startswith("on") & ~F.regexp_replace(F.lower(v), r"[\x00-\x20]", "").contains("javascript:")
        address = k.isin("href", "src", "srcset", "poster", "action", "xlink:href")
        fine = fine & (~address | ~has_unsafe_scheme(v)) & ((k != "style") | ~has_unsafe_css(v))
        return fine & (~k.isin("src", "srcset", "poster") | is_local_asset(v)) if local_only else fine

    return kept.withColumn("attrs", F.map_filter("attrs", safe))


def raw_nodes(nodes: DataFrame, tags: list[str]) -> DataFrame:
    """FLT07: nodes that may stand as raw markup: other elements are unwrapped, attributes without a safe value go.

    Links become Markdown destinations, media must be below ``assets/``, any other address and CSS url() a fragment.
    """
    kept = nodes.where((F.col("type") == "text") | F.col("tag").isin([t.lower() for t in tags]))

    def safe(k: Column, v: Column) -> Column:
        outside = F.exists(F.regexp_extract_all(v, F.lit(r"""(?i)url\(\s*['"]?\s*([^'")]*)"""), 1), lambda u: ~u.startswith("#"))
        named = k.rlike(r"(?i)^[a-z][a-z0-9:._\-]*$") & ~F.lower(k).startswith("on") & ~F.lower(k).isin("srcset", "xml:base")
        address = F.lower(k).isin("href", "src", "data", "xlink:href")
        fragment, tag = F.trim(v).startswith("#"), F.col("tag")
        return (
            F.when(~named | outside, None).when(~address, v).when(tag == "a", markdown_destination(v))
            .when((tag == "image") & fragment, F.trim(v))
            .when(tag.isin("img", "image") & (F.lower(k) != "data"), F.when(is_local_asset(relative_asset(F.trim(v))), relative_asset(F.trim(v))))
            .when(fragment, v)
        )

    return kept.withColumn("attrs", F.map_filter(F.transform_values("attrs", safe), lambda k, v: v.isNotNull()))


def svg_problems(nodes: DataFrame, most: int = 5000, depth: int = 128) -> DataFrame:
    """FLT08: documents whose drawing is too large, too deep, or holds active elements or attributes."""
    active = F.col("tag").isin("script", "foreignobject", "animate", "set", "use", "image", "a") | F.exists(
        F.map_keys(F.coalesce("attrs", F.create_map().cast("map<string,string>"))), lambda k: k.startswith("on")
    )
    out = nodes.where("type = 'element'").groupBy("doc_id").agg(
        F.count("*").alias("elements"), F.max("depth").alias("depth"), F.count_if(active).alias("active")
    )
    return out.where((F.col("elements") > most) | (F.col("depth") > depth) | (F.col("active") > 0))


def page_counts(nodes: DataFrame) -> DataFrame:
    """SRC06, AG22: counts of the parts of a page; errors in an appendix (id from A) are not fatal."""
    el = F.col("type") == "element"
    n = lambda test: F.count_if(el & test)
    error = has_class("ltx_ERROR") | has_class("ltx_error")
    return nodes.groupBy("doc_id").agg(
        n(F.col("tag") == "section").alias("sections"), n(F.col("tag") == "p").alias("paragraphs"), n(F.col("tag") == "figure").alias("figures"),
        n(F.col("tag") == "table").alias("tables"), n(F.col("tag") == "math").alias("math"), n(has_class("ltx_bibitem")).alias("bib_entries"),
        n(F.col("tag").isin(HEADINGS)).alias("headings"), n(F.col("tag") == "a").alias("links"),
        n(error & ~F.coalesce(attr("id").startswith("A"), F.lit(False))).alias("fatal_errors"),
    )


def broken_links(nodes: DataFrame) -> DataFrame:
    """JN31: internal links without a target."""
    links = nodes.where("type = 'element'").select("doc_id", F.regexp_extract(F.coalesce(attr("href"), F.lit("")), "^#(.+)$", 1).alias("target")).where("target <> ''")
    ids = nodes.where("type = 'element'").select("doc_id", attr("id").alias("target")).where("target is not null")
    return links.join(ids, ["doc_id", "target"], "left_anti").distinct()


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """AG21."""
    return nodes.where("type = 'element'").groupBy("doc_id", attr("id").alias("id")).agg(F.count("*").alias("n")).where("id is not null and n > 1")


def section_of(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """TR06: the outermost section around each item, else ``front``."""
    s = nodes.where("tag = 'section'").select("doc_id", "pre", "post", "depth", attr("id").alias("id"))
    rows = pairs_below(items.select("doc_id", "pre", "node_id"), s).where("node is not null")
    out = rows.groupBy("doc_id", F.col("node.node_id").alias("node_id")).agg(F.min_by("top.id", "top.depth").alias("section_id"))
    return items.join(out, ["doc_id", "node_id"], "left").withColumn("section_id", F.coalesce("section_id", F.lit("front")))


def section_level(classes: Column) -> Column:
    """RM04."""
    return (
        F.when(classes.contains("ltx_subsubsection"), 4).when(classes.contains("ltx_subsection"), 3)
        .when(classes.contains("ltx_paragraph"), 5).when(classes.contains("ltx_subparagraph"), 6).otherwise(2)
    )


def rebuild_hierarchy(sections: DataFrame, order: str = "pre") -> DataFrame:
    """TR04: parents by level, from the nearest earlier section above."""
    s = sections.select(F.col("doc_id").alias("__d"), F.col(order).alias("__at"), F.col("section_id").alias("__id"), F.col("level").alias("__l"))
    rows = sections.join(s, (sections["doc_id"] == s["__d"]) & (s["__at"] < sections[order]) & (s["__l"] < sections["level"]), "left")
    return rows.groupBy(*[sections[c] for c in sections.columns]).agg(F.max_by("__id", "__at").alias("parent_section_id"))


def opaque_siblings(nodes: DataFrame) -> DataFrame:
    """TR05: the paragraph container of an error and those after it among its siblings."""
    errors = nodes.where(has_class("ltx_ERROR") | has_class("ltx_error"))
    boxes = nodes.where((F.col("tag") == "div") & has_class("ltx_para"))
    hit = pairs_below(errors.select("doc_id", "pre"), boxes).where("node is not null").select("top.*")
    first = hit.groupBy("doc_id", "parent_id").agg(F.min("ordinal").alias("__first"))
    return boxes.join(first, ["doc_id", "parent_id"]).where("ordinal >= __first").drop("__first")


def unit_nodes(nodes: DataFrame, profile: str = "generic") -> DataFrame:
    """FLT02, FLT03: nodes whose text is translated.

    The class-based profile takes titles, paragraphs and notes of scholarly pages; the generic one takes
    headings and paragraphs inside the article.  Bibliographies, figures, tables, opaque regions and page
    furniture are left out, and so are texts without an ASCII letter.
    """
    el = nodes.where("type = 'element'")
    if profile == "classes":
        note = has_class("ltx_note_content")
        own = el.where((F.col("tag").isin(HEADINGS) & has_class("ltx_title")) | ((F.col("tag") == "p") & has_class("ltx_p")) | note)
        own = not_below(own, el.where(has_class("ltx_bibliography") | F.col("tag").isin("figure", "table")), strict=True)
        own = not_below(own, opaque_siblings(nodes))
        own = own.join(below(own.where("tag = 'p'"), el.where(note)).select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")
    else:
        own = below(el.where(F.col("tag").isin([*HEADINGS, "p"])), el.where("tag = 'article'"))
        own = not_below(own, el.where(F.col("tag").isin("nav", "footer", "aside", "form", "figure", "table")))
    out = with_text(nodes.where("type = 'text'"), own, name="source_text").where(F.col("source_text").rlike("[A-Za-z]"))
    kind = F.when(has_class("ltx_note_content"), "footnote").when(has_class("ltx_title_document"), "title").when(F.col("tag").isin(HEADINGS), "heading").otherwise("paragraph")
    w = W.partitionBy("doc_id").orderBy("pre")
    return out.withColumn("kind", kind).withColumn("unit_id", F.format_string("html-%04d", F.row_number().over(w)))


def protected_nodes(nodes: DataFrame) -> DataFrame:
    """FLT04: protected elements, outermost only."""
    own = nodes.where(F.col("tag").isin(PROTECTED) | F.coalesce(F.arrays_overlap(F.split(attr("class"), r"\s+"), F.array(*map(F.lit, PROTECTED_CLASSES))), F.lit(False)))
    return not_below(own, own, strict=True)


def tokenize_units(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """FN42: unit text with protected elements as numbered tokens, and the map from token to text.

    Numbers count up from 1 in page order and pass over tokens that stand literally in the unit's text.
    """
    p = protected_nodes(nodes)
    t = units.select("doc_id", "unit_id", "pre", "post", F.col("source_text").alias("s"))
    own = pairs_below(p.select("doc_id", "pre", "post", "node_id"), t).where("node is not null")
    own = own.select("doc_id", "top.unit_id", "node.node_id", "node.pre", "node.post", F.col("top.s").alias("__s"))
    shown = plain_text(nodes, p)
    own = own.join(shown, ["doc_id", "node_id"])
    rank = F.row_number().over(W.partitionBy("doc_id", "unit_id").orderBy("pre"))
    taken = F.transform(F.regexp_extract_all("__s", F.lit(r"\[\[PTX_(\d{4})\]\]"), F.lit(1)), lambda x: x.cast("int"))
    free = F.filter(F.sequence(F.lit(1), rank + F.size(taken)), lambda k: ~F.array_contains(taken, k))
    own = own.withColumn("token", F.format_string("[[PTX_%04d]]", F.element_at(free, rank)))
    text = nodes.where("type = 'text'")
    free_text = not_below(text, p)
    parts = pairs_below(free_text.select("doc_id", "pre", "text"), t).where("node is not null")
    parts = parts.select("doc_id", "top.unit_id", "node.pre", F.col("node.text").alias("s"))
    parts = parts.unionByName(own.select("doc_id", "unit_id", "pre", F.col("token").alias("s")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "s"))), lambda x: x["s"]), "")
    out = parts.groupBy("doc_id", "unit_id").agg(squeeze(joined).alias("translation_source"))
    maps = own.groupBy("doc_id", "unit_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "text")))).alias("placeholders"))
    return out.join(maps, ["doc_id", "unit_id"], "left")


def table_rows(nodes: DataFrame) -> DataFrame:
    """TR09: cells of each table row in order; a cell spanning k columns is followed by k - 1 blanks."""
    cells = nodes.where(F.col("tag").isin("td", "th"))
    c = cells.join(plain_text(nodes, cells).withColumnRenamed("text", "cell"), ["doc_id", "node_id"])
    span = F.greatest(F.lit(1), F.coalesce(F.try_to_number(attr("colspan"), F.lit("999")).cast("int"), F.lit(1)))
    wide = c.withColumn("cell", F.concat(F.array("cell"), F.array_repeat(F.lit(""), span - 1)))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "cell")))
    return wide.groupBy("doc_id", F.col("parent_id").alias("row_id")).agg(F.flatten(F.transform(parts, lambda x: x["cell"])).alias("cells"))


def math_source(nodes: DataFrame) -> DataFrame:
    """FN39: TeX annotation, else alternative text, else the presentation."""
    m = nodes.where("tag = 'math'")
    a = nodes.where((F.col("tag") == "annotation") & (attr("encoding") == "application/x-tex"))
    tex = plain_text(nodes, a).join(a.select("doc_id", "node_id", "pre"), ["doc_id", "node_id"]).select("doc_id", "pre", "text")
    rows = pairs_below(tex, m.select("doc_id", "node_id", "pre", "post", attr("alttext").alias("alt")))
    rows = rows.select("doc_id", "top.node_id", "top.alt", F.col("node.pre").alias("__p"), F.col("node.text").alias("__tex"))
    best = rows.groupBy("doc_id", "node_id").agg(F.min_by("__tex", "__p").alias("__tex"), F.first("alt").alias("__alt"))
    shown = plain_text(nodes, m, skip=["annotation", "annotation-xml"]).withColumnRenamed("text", "__shown")
    return best.join(shown, ["doc_id", "node_id"]).select("doc_id", "node_id", F.coalesce(F.nullif(F.trim("__tex"), F.lit("")), "__alt", "__shown").alias("tex"))


def citation_metadata(nodes: DataFrame) -> DataFrame:
    """TR19: title, distinct authors in order and date from the meta elements."""
    m = nodes.where("tag = 'meta'").select("doc_id", "pre", attr("name").alias("name"), attr("content").alias("content"))
    authors = F.array_sort(F.collect_list(F.when(F.col("name") == "citation_author", F.struct("pre", "content"))))
    return m.groupBy("doc_id").agg(
        F.max(F.when(F.col("name") == "citation_title", F.col("content"))).alias("title"),
        F.array_distinct(F.transform(authors, lambda x: x["content"])).alias("authors"),
        F.coalesce(F.max(F.when(F.col("name") == "citation_date", F.col("content"))), F.max(F.when(F.col("name") == "citation_online_date", F.col("content")))).alias("date"),
    )


def local_assets(nodes: DataFrame) -> DataFrame:
    """RM05: distinct local references in order."""
    refs = nodes.where("type = 'element'").select("doc_id", F.explode(F.array_compact(F.array(attr("src"), attr("href"), attr("data")))).alias("asset"))
    return refs.where(is_local_asset(F.col("asset"))).distinct().orderBy("doc_id", "asset")


def normalise_scale(width: Column, height: Column, cap: float = 4.0, most_side: int = 8192, most_pixels: int = 32_000_000) -> Column:
    """RM06: the largest scale within the cap, the side and the pixels."""
    return F.least(F.lit(cap), most_side / F.greatest(width, height), F.sqrt(most_pixels / (width * height)))
