"""Pages to Markdown blocks (TR07), and the inline Markdown of their nodes (TR08).

Block structure is relational: which element makes a block, what it inherits (section anchor, bibliography, list
depth) and what belongs to it follow from pre- and post-order numbers.  Inline Markdown is one fold over the nodes of
a page in page order: expressions give each node its text or its marks, and the fold keeps a stack of open elements.
A unit's text has its numbered tokens replaced by the protected elements inside it, in their order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import (
    anchor_id, escape_markdown, inline_anchor, inline_code, is_safe_asset_path, is_safe_math, markdown_destination, strip,
)
from ..storage import materialise
from .html import HEADINGS, attr, below, inner_html, math_source, not_below, pairs_below, plain_text, raw_nodes

# Classes and tags of scholarly pages.
EQUATION_CLASSES = ["ltx_equation", "ltx_equationgroup", "ltx_eqn_table"]
BIBLIOGRAPHY_CLASSES = ["ltx_bibliography", "ltx_biblist"]
AUTHOR_CLASSES = ["ltx_authors", "ltx_date", "ltx_role_affiliation"]
PROTECTED_TAGS = ["math", "cite", "code", "pre", "svg", "img", "object", "a"]
PROTECTED_CLASSES = ["ltx_tag", "ltx_note_mark", "ltx_font_typewriter", "ltx_role_footnote"]
SILENT_TAGS = ["script", "style", "iframe", "form", "input", "button", "textarea"]
TABLE_PARTS = ["table", "thead", "tbody", "tfoot", "tr", "th", "td"]
SVG_TAGS = (
    "svg g path rect circle ellipse line polyline polygon text tspan defs clipPath mask linearGradient radialGradient stop use image title desc"
    " foreignobject body div p span br strong em sup sub a img ul ol li"
).split()
MATH_TAGS = (
    "math semantics annotation annotation-xml mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub"
    " msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mlabeledtr mtr mtd maligngroup malignmark maction"
).split()
TABLE_TAGS = "table thead tbody tfoot tr th td caption colgroup col br span strong em sup sub a img code pre kbd samp".split() + MATH_TAGS + SVG_TAGS

BLOCK = (
    "doc_id string, at long, turn int, sub long, kind string, text string, level int, anchor string, asset string, caption string, label string,"
    " ordered boolean, start int, language string, rows array<array<string>>, text_is_markdown boolean"
)
_FIELDS = [tuple(x.strip().split(" ", 1)) for x in BLOCK.split(", ")]


def _has(classes: list[str]) -> Column:
    return F.arrays_overlap("cls", F.array(*map(F.lit, classes)))


def _blocks(df: DataFrame, kind, turn: int = 0, sub=0, at="pre", markdown=True, **given) -> DataFrame:
    """Rows of block columns; those not given are null."""
    given |= {"kind": kind, "turn": turn, "sub": sub, "at": at if isinstance(at, Column) else F.col(at), "text_is_markdown": markdown}
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select("doc_id", *[col(given.get(n)).cast(t).alias(n) for n, t in _FIELDS[1:]])


def tex_for_markdown(tex: Column, inline: bool) -> Column:
    """FN38: TeX of a page without what Markdown would read: angle signs as relations, no link shapes, paired dollars."""
    out = strip(F.regexp_replace(tex, "\r\n?", "\n"))
    out = F.replace(out, F.lit(r"\lx@sectionsign"), F.lit(r"\S"))
    out = F.regexp_replace(out, r"\\parbox\{[^{}\n]*\}\{", "{")
    out = F.regexp_replace(out, r"\\(?:begin|end)\{flushleft\}", "")
    if inline:
        odd = r"(?<!\\)((?:\\\\)*)\$"
        paired = F.regexp_replace(out, odd + r"((?:[^$\\]|\\.)*)" + r"\$", r"$1\\\\($2\\\\)")
        out = F.when(F.regexp_count(out, F.lit(odd)) % 2 == 0, paired).otherwise(out)
    out = F.replace(F.replace(out, F.lit("<"), F.lit(r"\lt{}")), F.lit(">"), F.lit(r"\gt{}"))
    out = F.replace(out, F.lit("]("), F.lit("]{}("))
    return F.trim(F.regexp_replace(out, r"\s+", " ")) if inline else strip(out)


def markup(nodes: DataFrame, tops: DataFrame, tags: list[str]) -> DataFrame:
    """FLT07: (doc_id, node_id, markup) of each top with all below it as raw markup of safe tags and attributes."""
    keys = tops.select("doc_id", "node_id", "pre", "post")
    own = nodes.join(keys.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").withColumn("__top", F.col("node_id"))
    inside = pairs_below(nodes, keys).where("node is not null").select(F.col("top.node_id").alias("__top"), "node.*")
    both = own.unionByName(inside).withColumn("doc_id", F.concat("doc_id", F.lit("\x01"), "__top")).drop("__top")
    out = inner_html(raw_nodes(both, tags))
    parts = F.split("doc_id", "\x01")
    return out.select(F.get(parts, F.lit(0)).alias("doc_id"), F.get(parts, F.lit(1)).cast("long").alias("node_id"), F.col("html").alias("markup"))


def _marked(nodes: DataFrame, units: DataFrame | None) -> DataFrame:
    """The nodes below each page's first article with their classes, block kinds and inline kinds."""
    first = nodes.where("tag = 'article'").groupBy("doc_id").agg(F.min(F.struct("pre", "post")).alias("a")).select("doc_id", "a.pre", "a.post")
    cls = F.split(F.coalesce(attr("class"), F.lit("")), r"\s+")
    own = below(nodes, first).withColumns({"cls": cls, "id": F.nullif(F.trim(attr("id")), F.lit(""))})
    if units is None:
        own = own.withColumns({"value": F.lit(None).cast("string"), "ids": F.lit(None).cast("array<string>"), "unit": F.lit(False)})
    else:
        shown = F.coalesce(F.nullif(F.trim("japanese"), F.lit("")), F.trim("translation_source"), F.lit(""))
        ids = F.array_sort(F.filter(F.map_keys("placeholders"), lambda k: k.rlike(r"^\[\[PTX_\d{4}\]\]$")))
        u = units.select("doc_id", "node_id", shown.alias("value"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"), F.lit(True).alias("unit"))
        own = own.join(u, ["doc_id", "node_id"], "left").withColumn("unit", F.coalesce("unit", F.lit(False)))
    tag, equation = F.col("tag"), _has(EQUATION_CLASSES)
    block = (
        F.when(tag == "section", None).when(tag.isin(HEADINGS), "heading").when((tag == "p") | F.col("unit"), "paragraph").when(tag == "figure", "figure")
        .when(tag == "table", F.when(equation, "equation").otherwise("table")).when(tag.isin("ul", "ol"), "list")
        .when((tag == "pre") | ((tag == "code") & _has(["ltx_verbatim"])), "code").when(_has(["ltx_listing"]), "listing").when(equation, "equation")
        .when(tag == "math", "math").when(tag == "svg", "svg").when(_has(AUTHOR_CLASSES), "paragraph")
    )
    inline = (
        F.when(F.col("unit"), "unit").when(tag.isin(SILENT_TAGS), "none").when(tag.isin("math", "br", "img", "svg"), tag).when(tag == "a", "link")
        .when(tag.isin("code", "kbd", "samp") | _has(["ltx_font_typewriter"]), "code").when(tag.isin("strong", "b") | _has(["ltx_font_bold"]), "strong")
        .when(tag.isin("em", "i") | _has(["ltx_font_italic"]), "em").when(tag == "del", "del").otherwise("plain")
    )
    slot = tag.isin(PROTECTED_TAGS) | _has(PROTECTED_CLASSES)
    el = F.col("type") == "element"
    return own.withColumns({"block": F.when(el, block), "inline": F.when(el, inline), "slot": el & slot})


def _list_nodes(own: DataFrame, tops: DataFrame) -> DataFrame:
    """Lists that make blocks: top ones, and those that are children of items of such."""
    top = tops.where("block = 'list'")
    parent = own.where("tag in ('li', 'ul', 'ol')").select("doc_id", F.col("node_id").alias("parent_id"), F.col("tag").alias("ptag"))
    good = (F.col("tag").isin("ul", "ol") & (F.col("ptag") == "li")) | ((F.col("tag") == "li") & F.col("ptag").isin("ul", "ol"))
    inside = below(own.where("type = 'element'"), top)
    inside = materialise(inside.join(parent, ["doc_id", "parent_id"], "left"), "in_lists")
    nested = not_below(inside.where(F.col("tag").isin("ul", "ol")), inside.where(~F.coalesce(good, F.lit(False))))
    return nested.drop("ptag").unionByName(top)


_TOKEN = r"\[\[PTX_\d{4}\]\]"
_EVENT = [
    ("doc_id", "string"), ("node_id", "long"), ("at", "long"), ("what", "int"), ("text", "string"), ("open", "string"), ("shut", "string"), ("anchor", "string"),
    ("always", "boolean"), ("slot", "boolean"), ("cut", "boolean"), ("wanted", "boolean"), ("unit", "boolean"), ("pieces", "array<string>"),
    ("tokens", "array<string>"), ("ids", "array<string>"),
]
_WHITE = re.compile(r"[\t\r\n ]+")


def _squeezed(parts: list[str]) -> str:
    return _WHITE.sub(" ", "".join(parts)).strip()


class _Frame:
    """An open element: what is rendered inside it, and for a unit the protected elements."""

    __slots__ = ("row", "parts", "slots", "unit")

    def __init__(self, row: dict, unit: _Frame | None):
        self.row, self.unit = row, unit
        self.parts: list[str] = []
        self.slots: list[str] | None = [] if row["unit"] and unit is None else None

    def inner(self) -> tuple[str, bool]:
        """Markdown of the inside, and whether all tokens found their elements."""
        if self.slots is None:
            return _squeezed(self.parts), True
        ids, tokens = self.row["ids"] or [], self.row["tokens"]
        if len(ids) != len(self.slots):
            ids = [f"[[PTX_{k:04d}]]" for k in range(1, len(self.slots) + 1)]
        known, counts = dict(zip(ids, self.slots, strict=True)), Counter(tokens)
        plain = lambda t: re.sub(r"([\[\]_])", r"\\\1", t)
        filled = [self.row["pieces"][0]]
        for token, piece in zip(tokens, self.row["pieces"][1:], strict=True):
            filled += [known[token] if token in known else plain(token), piece]
        return _squeezed(filled), all(counts[i] == 1 for i in known)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The inner Markdown of the wanted nodes, from events sorted by page and place."""
    doc, stack = None, []
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if row["doc_id"] != doc:
                doc, stack = row["doc_id"], []
            top = stack[-1] if stack else None
            # the unit that takes protected elements only, and nothing else, from here
            unit = None if top is None else top if top.slots is not None else top.unit
            if row["what"] == 1:
                stack.append(_Frame(row, None if row["slot"] else unit))
                stack[-1].parts = []
                continue
            if row["what"] == 0:
                shown, slot, cut = row["text"], row["slot"], row["cut"]
            else:
                frame = stack.pop()
                top = stack[-1] if stack else None
                unit = None if top is None else top if top.slots is not None else top.unit
                own, (inner, sound) = frame.row, frame.inner()
                slot, cut = own["slot"], own["cut"]
                body = own["open"] + inner + own["shut"] if inner else ""
                shown = own["anchor"] + body if inner or own["always"] else ""
                if own["wanted"]:
                    out.append((doc, own["node_id"], inner, sound))
            if top is None or cut:
                continue
            if unit is None:
                top.parts.append(shown)
            elif slot:
                unit.slots.append(shown)
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "node_id", "inner", "sound"])


def inline_markdown(own: DataFrame, tex: DataFrame, drawings: DataFrame, codes: DataFrame, items: DataFrame) -> DataFrame:
    """TR08: (doc_id, node_id, inner, sound): the Markdown inside each node that may make a block.

    ``own`` are marked nodes, ``tex``, ``drawings`` and ``codes`` the TeX, raw markup and code of theirs.  Lists and
    marks of ``items`` (doc_id, node_id) are left out of what holds them.  ``sound`` is false where a unit's tokens do not match its
    protected elements one to one.
    """
    atom = F.col("inline").isin("none", "math", "br", "img", "svg", "code")
    kept = not_below(own, own.where(atom), strict=True)
    apart = own.where(F.col("tag").isin("ul", "ol") | _has(["ltx_tag_item"])).join(items.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi")
    facts = tex.unionByName(drawings, True).unionByName(codes, True).unionByName(apart.select("doc_id", "node_id", F.lit(True).alias("__item")), True)
    facts = facts.groupBy("doc_id", "node_id").agg(*[F.max(c).alias(c) for c in ("tex", "markup", "code", "__item")])
    kept = kept.join(facts, ["doc_id", "node_id"], "left")
    none, empty = F.lit(""), F.array().cast("array<string>")
    anchor = F.coalesce(inline_anchor(F.col("id")), none)
    t = tex_for_markdown(F.coalesce("tex", none), True)
    formula = F.when(t == "", "").when(is_safe_math(t), F.concat(F.lit("$"), t, F.lit("$"))).otherwise(inline_code(t))
    alt = F.replace(escape_markdown(F.coalesce(F.nullif(attr("alt"), none), F.lit("Figure"))), F.lit("\n"), F.lit(" "))
    src = F.trim(F.coalesce(attr("src"), none))
    image = F.when(is_safe_asset_path(src), F.concat(F.lit("!["), alt, F.lit("]("), src, F.lit(")"))).otherwise(alt)
    i = F.col("inline")
    text = (
        F.when(F.col("type") == "text", escape_markdown(F.coalesce("text", none))).when(i == "br", "  \n").when(i == "math", F.concat(anchor, formula))
        .when(i == "img", F.concat(anchor, image)).when(i == "svg", F.concat(anchor, F.coalesce("markup", none)))
        .when((i == "code") & (F.coalesce("code", none) != ""), F.concat(anchor, inline_code(F.col("code")))).otherwise("")
    )
    to = markdown_destination(F.coalesce(attr("href"), none))
    mark = F.when(i == "strong", "**").when(i == "em", "*").when(i == "del", "~~").otherwise("")
    link = (i == "link") & to.isNotNull()
    value = F.coalesce("value", none)
    wanted = F.col("tag").isin([*HEADINGS, "p", "li", "td", "th", "figcaption", "object"]) | F.col("unit") | _has(AUTHOR_CLASSES)
    whole = (F.col("type") == "text") | atom | (F.col("pre") == F.col("post"))
    cut = F.col("__item")
    rows = kept.select(
        "doc_id", "node_id", "pre", "post", F.when(whole, 0).otherwise(1).alias("what"), F.when(whole, text).alias("text"),
        F.when(link, "[").otherwise(mark).alias("open"), F.when(link, F.concat(F.lit("]("), to, F.lit(")"))).otherwise(mark).alias("shut"),
        anchor.alias("anchor"), ((i == "link") | F.col("unit")).alias("always"), "slot", F.coalesce(cut, F.lit(False)).alias("cut"), wanted.alias("wanted"), "unit",
        F.when(F.col("unit"), F.transform(F.split(value, _TOKEN, -1), escape_markdown)).alias("pieces"),
        F.when(F.col("unit"), F.regexp_extract_all(value, F.lit(_TOKEN), F.lit(0))).otherwise(empty).alias("tokens"), "ids",
    )
    shut = [F.lit(None).cast(k).alias(n) if n not in ("doc_id", "node_id", "at", "what") else F.col("post").alias("at") if n == "at" else F.lit(2).alias("what") if n == "what" else F.col(n) for n, k in _EVENT]
    events = rows.withColumn("at", F.col("pre")).select(*[n for n, _ in _EVENT]).union(rows.where("what = 1").select(*shut))
    return events.repartition("doc_id").sortWithinPartitions("doc_id", "at").mapInArrow(_fold, "doc_id string, node_id long, inner string, sound boolean")


def _texts_of_listings(own: DataFrame, tex: DataFrame, tops: DataFrame) -> DataFrame:
    """(doc_id, node_id, text) of each top: its text with formulas as TeX between dollars."""
    math = own.where("tag = 'math'")
    formula = F.when(F.coalesce("tex", F.lit("")) != "", F.concat(F.lit("$"), "tex", F.lit("$"))).otherwise("")
    leaves = not_below(own.where("type = 'text'"), math).select("doc_id", "pre", "text").union(
        math.join(tex, ["doc_id", "node_id"], "left").select("doc_id", "pre", formula)
    )
    rows = pairs_below(leaves, tops.select("doc_id", "pre", "post", "node_id"))
    parts = F.array_sort(F.collect_list(F.struct("node.pre", "node.text")))
    return rows.groupBy("doc_id", F.col("top.node_id").alias("node_id")).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


#: Columns of the listings and tables that become blocks.
_LISTING = ["doc_id", "node_id", "pre", "post", "anchor", "at", "turn", "sub"]
_TABLE = ["doc_id", "node_id", "pre", "post", "anchor", "caption", "at"]


def _listings(own: DataFrame, tex: DataFrame, tops: DataFrame) -> DataFrame:
    """Code blocks of listings (node columns, at, turn, anchor), and the anchors of their lines after each."""
    keys = tops.select(*_LISTING)
    lines = materialise(below(own.where("type = 'element'").where(_has(["ltx_listingline"])), keys).select("doc_id", "node_id", "pre", "post", "id"), "listing_lines")
    shown = _texts_of_listings(own, tex, lines).withColumn("line", F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " "))).drop("text")
    held = pairs_below(lines.join(shown, ["doc_id", "node_id"], "left").select("doc_id", "pre", "line", "id"), keys)
    lined = F.array_sort(F.collect_list(F.struct("node.pre", "node.line", "node.id")))
    found = held.groupBy("doc_id", F.col("top.node_id").alias("node_id")).agg(lined.alias("lines"))
    whole = _texts_of_listings(own, tex, keys).withColumnRenamed("text", "whole")
    k = materialise(keys.join(found, ["doc_id", "node_id"]).join(whole, ["doc_id", "node_id"]), "listing_texts")
    joined = strip(F.array_join(F.transform("lines", lambda x: F.coalesce(x["line"], F.lit(""))), "\n"))
    text = F.coalesce(F.nullif(joined, F.lit("")), strip(F.col("whole")))
    code = _blocks(k, "code", F.col("turn"), F.col("sub"), F.col("at"), False, text=text, anchor=F.col("anchor"), language="text")
    ids = F.array_distinct(F.array_compact(F.transform("lines", lambda x: x["id"])))
    others = k.select("doc_id", "at", "turn", "sub", F.posexplode(F.filter(ids, lambda x: ~F.coalesce(x == F.col("anchor"), F.lit(False)))).alias("n", "line"))
    return code.union(_blocks(others, "paragraph", F.col("turn"), F.col("sub") + 1 + F.col("n"), F.col("at"), False, anchor=F.col("line")))


def _tables(own: DataFrame, inner: DataFrame, tops: DataFrame) -> DataFrame:
    """Table blocks of tables (node columns, at, anchor, caption): rows of cells, or raw markup where a cell spans rows."""
    keys = tops.select(*_TABLE)
    el = own.where("type = 'element'")
    cells = el.where("tag in ('td', 'th')")
    spans = pairs_below(cells.where(~F.coalesce(attr("rowspan"), F.lit("")).isin("", "1")).select("doc_id", "pre"), keys).where("node is not null")
    tall = spans.select("doc_id", F.col("top.node_id").alias("node_id"), F.lit(True).alias("tall")).distinct()
    keys = materialise(keys.join(tall, ["doc_id", "node_id"], "left"), "table_tops")
    high, flat = keys.where("tall"), keys.where("tall is null")
    raw = high.join(markup(own.drop("cls", "id", "value", "ids", "unit", "block", "inline", "slot"), high, TABLE_TAGS), ["doc_id", "node_id"])
    lead = F.when(F.coalesce("caption", F.lit("")) == "", "").otherwise(F.concat(F.lit("*"), "caption", F.lit("*\n\n")))
    out = _blocks(raw, "table", 1, 0, F.col("at"), text=F.concat(lead, "markup"), anchor=F.col("anchor"))
    parts = el.where(F.col("tag").isin(TABLE_PARTS) & F.col("id").isNotNull()).select("doc_id", "pre", "node_id", "id")
    itself = flat.select("doc_id", "node_id", F.struct(*flat.columns).alias("top")).join(
        parts.select("doc_id", "node_id", F.struct(*parts.columns).alias("node")), ["doc_id", "node_id"]
    )
    inside = pairs_below(parts, flat).where("node is not null").union(itself.select("doc_id", "top", "node"))
    first = inside.groupBy("doc_id", F.col("top.at").alias("at"), F.col("top.anchor").alias("a"), F.col("node.id").alias("id")).agg(F.min("node.pre").alias("p"))
    out = out.union(_blocks(first.where("a is null or a <> id"), "paragraph", 0, F.col("p"), F.col("at"), False, anchor=F.col("id")))
    in_rows = el.where("tag = 'tr'").select("doc_id", F.col("node_id").alias("parent_id"))
    shown = cells.join(in_rows, ["doc_id", "parent_id"], "left_semi").join(inner, ["doc_id", "node_id"], "left")
    cell = F.regexp_replace(F.coalesce("inner", F.lit("")), r"(?<!\\)\|", r"\\|")
    wide = F.greatest(F.lit(1), F.when(F.coalesce(attr("colspan"), F.lit("")).rlike(r"^\d{1,3}$"), attr("colspan").cast("int")).otherwise(1))
    row = shown.select("doc_id", F.col("parent_id").alias("node_id"), "ordinal", F.concat(F.array(cell), F.array_repeat(F.lit(""), wide - 1)).alias("cells"))
    row = row.groupBy("doc_id", "node_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "cells"))), lambda x: x["cells"])).alias("cells"))
    rows = pairs_below(el.where("tag = 'tr'").join(row, ["doc_id", "node_id"]).select("doc_id", "pre", "cells"), flat)
    held = rows.groupBy("doc_id", F.col("top.at").alias("at"), F.col("top.anchor").alias("anchor"), F.col("top.caption").alias("caption"), F.col("top.node_id").alias("node_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("node.pre", "node.cells")))), lambda x: x["cells"]).alias("cells")
    )
    return out.union(_blocks(held, "table", 1, 0, F.col("at"), anchor=F.col("anchor"), caption=F.col("caption"), rows=F.col("cells")))


def _equations(own: DataFrame, tex: DataFrame, tops: DataFrame) -> DataFrame:
    """Equation blocks: one a row of an equation table, with the anchors around and inside it before; else one a top."""
    el = own.where("type = 'element'")
    rows = below(el.where((F.col("tag") == "tr") & (_has(["ltx_eqn_row"]) | _has(EQUATION_CLASSES))), tops)
    rows = materialise(not_below(rows, rows, strict=True), "equation_rows")
    with_rows = pairs_below(rows.select("doc_id", "pre"), tops.select("doc_id", "node_id", "pre", "post")).where("node is not null").select("doc_id", "top.node_id").distinct()
    single = tops.join(with_rows, ["doc_id", "node_id"], "left_anti")
    named = el.where("id is not null").select("doc_id", "node_id", "pre", "post", "depth", "id")
    around = pairs_below(rows.select("doc_id", "pre", "node_id"), below(named, tops).unionByName(named.join(tops.select("doc_id", "node_id"), ["doc_id", "node_id"]))).where("node is not null")
    around = around.groupBy("doc_id", F.col("node.node_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("top.depth", "top.id"))), lambda x: x["id"]).alias("around"))
    cols = ["doc_id", "node_id", "pre", "post", "id"]
    units = rows.select(*cols).join(around, ["doc_id", "node_id"], "left").withColumn("of_row", F.lit(True)).unionByName(
        single.select(*cols).withColumns({"around": F.lit(None).cast("array<string>"), "of_row": F.lit(False)})
    )
    units = materialise(units, "equation_units")
    keys = units.select("doc_id", "node_id", "pre", "post")
    group = lambda of, value, name: pairs_below(of, keys).where("node is not null").groupBy("doc_id", F.col("top.node_id").alias("node_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("node.pre", F.col(f"node.{value}").alias("v")))), lambda x: x["v"]).alias(name)
    )
    maths = own.where("tag = 'math'").join(tex.where("tex <> ''"), ["doc_id", "node_id"]).select("doc_id", "pre", tex_for_markdown(F.col("tex"), False).alias("tex"))
    tags = el.where(_has(["ltx_tag_equation"]))
    labels = tags.select("doc_id", "node_id", "pre").join(plain_text(own, tags), ["doc_id", "node_id"]).where("text <> ''").select("doc_id", "pre", "text")
    u = materialise(units.join(group(maths, "tex", "values"), ["doc_id", "node_id"]), "equation_values")
    u = u.join(group(labels, "text", "labels"), ["doc_id", "node_id"], "left").join(group(named.select("doc_id", "pre", "id"), "id", "inside"), ["doc_id", "node_id"], "left")
    empty = F.array().cast("array<string>")
    mine = F.array_compact(F.array("id"))
    targets = F.concat(F.coalesce("around", empty), mine)
    anchor = F.when(F.col("of_row"), F.get(targets, F.size(targets) - 1)).otherwise(F.col("id"))
    u = u.withColumns({"targets": F.when(F.col("of_row"), F.array_distinct(F.concat(targets, F.coalesce("inside", empty)))).otherwise(empty), "anchor": anchor})
    others = u.select("doc_id", "pre", F.posexplode(F.filter("targets", lambda x: ~F.coalesce(x == F.col("anchor"), F.lit(False)))).alias("n", "target"))
    caption = F.nullif(F.array_join(F.transform(F.array_distinct(F.coalesce("labels", empty)), escape_markdown), " "), F.lit(""))
    return _blocks(others, "paragraph", 0, F.col("n"), markdown=False, anchor=F.col("target")).union(
        _blocks(u, "equation", 1, 0, text=F.array_join("values", "\n\\qquad\n"), anchor=F.col("anchor"), caption=caption, markdown=caption.isNotNull())
    )


def _items(own: DataFrame, inner: DataFrame, drawings: DataFrame, lists: DataFrame, items: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Items of lists with depth, number and kind and the drawings inside each; the listings inside."""
    el = own.where("type = 'element'")
    outer = lists.where("block = 'list'").select("doc_id", "pre", "post", "node_id", "depth")
    depth = pairs_below(items.select("doc_id", "pre", "node_id"), outer).where("node is not null")
    depth = depth.groupBy("doc_id", F.col("node.node_id").alias("node_id")).agg(F.count("*").cast("int").alias("level"), F.min_by("top.pre", "top.depth").alias("top_pre"))
    refs = el.where(_has(BIBLIOGRAPHY_CLASSES)).select("doc_id", "pre", "post")
    top = lists.select("doc_id", "node_id", "pre", "post", "cls")
    shelf = below(top, refs).union(top.where(_has(BIBLIOGRAPHY_CLASSES))).select("doc_id", F.col("pre").alias("top_pre"), F.lit(True).alias("shelf")).distinct()
    start = lists.select("doc_id", F.col("node_id").alias("parent_id"), (F.col("tag") == "ol").alias("ordered"),
                         F.when(F.coalesce(attr("start"), F.lit("")).rlike(r"^\d{1,9}$"), attr("start").cast("int")).otherwise(1).alias("first"))
    i = items.join(depth, ["doc_id", "node_id"]).join(shelf, ["doc_id", "top_pre"], "left").join(start, ["doc_id", "parent_id"]).join(inner, ["doc_id", "node_id"], "left")
    number = F.col("first") + F.row_number().over(W.partitionBy("doc_id", "parent_id").orderBy("pre")) - 1
    i = i.withColumns({"number": number, "reference": F.coalesce("shelf", F.lit(False)) | _has(["ltx_bibitem"])})
    full = F.coalesce("inner", F.lit("")) != ""
    i = materialise(i.where(full | F.col("id").isNotNull()).select("doc_id", "pre", "inner", "level", "id", "ordered", "number", "reference"), "numbered_items")
    out = [
        _blocks(i.where(full), F.when(F.col("reference"), "reference").otherwise("list_item"), text=F.col("inner"), level=F.col("level"), anchor=F.col("id"), ordered=F.col("ordered"), start=F.col("number")),
        _blocks(i.where(~full), "paragraph", anchor=F.col("id"), markdown=False),
    ]
    # what is inside an item belongs to the nearest one
    keys = items.select("doc_id", "pre", "post", "depth")
    near = lambda of: pairs_below(of, keys).where("node is not null").groupBy("doc_id", "node").agg(F.max_by("top.pre", "top.depth").alias("at")).select("node.*", "at")
    listing = near(el.where(_has(["ltx_listing"])).select("doc_id", "node_id", "pre", "post", "id"))
    listing = listing.withColumns({"anchor": F.col("id"), "turn": F.lit(1), "sub": F.col("pre")})
    svg = near(el.where("tag = 'svg'").join(drawings, ["doc_id", "node_id"]).select("doc_id", "pre", "markup"))
    return [*out, _blocks(svg.where("markup <> ''"), "figure", 2, F.col("pre"), F.col("at"), text=F.col("markup"))], listing.select(*_LISTING)


def _figures(own: DataFrame, inner: DataFrame, drawings: DataFrame, tops: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Blocks of figures: the first of listing, table, images, drawing, nested figures and text that one has of its
    own; the listings and tables of theirs."""
    el = own.where("type = 'element'")
    figures = below(el.where("tag = 'figure'"), tops).unionByName(tops)
    f = figures.select("doc_id", "node_id", "pre", "post", "depth", "id", "cls")
    text = plain_text(own, el.where("tag = 'object'")).withColumnRenamed("text", "inside")
    things = el.where((F.col("tag").isin("figcaption", "table", "img", "object", "svg", "figure")) | _has(["ltx_listing"]))
    things = things.join(text, ["doc_id", "node_id"], "left").join(inner, ["doc_id", "node_id"], "left").join(drawings, ["doc_id", "node_id"], "left")
    none = F.lit("")
    image = F.col("tag").isin("img", "object") & F.exists(
        F.array(F.when(F.col("tag") == "img", attr("src")).otherwise(attr("data")), attr("alt"), attr("aria-label"), F.col("inside")), lambda x: F.coalesce(x, none) != ""
    )
    label = F.coalesce(F.nullif(attr("alt"), none), F.nullif(attr("aria-label"), none))
    raw = F.trim(F.coalesce(F.when(F.col("tag") == "img", attr("src")).otherwise(attr("data")), none))
    slim = things.select(
        "doc_id", "node_id", "pre", "post", "tag", "id", "inner", "markup", _has(["ltx_listing"]).alias("listing"), image.alias("image"), label.alias("label"),
        F.when(is_safe_asset_path(raw), raw).alias("asset"),
    )
    own_of = pairs_below(slim, f.select("doc_id", "pre", "post", "depth", "node_id")).where("node is not null")
    # the nearest figure owns a thing; a figure is owned by the one around it
    near = own_of.groupBy("doc_id", "node").agg(F.max_by("top.node_id", "top.depth").alias("owner")).select("owner", "node.*")
    near = materialise(near, "owned")
    first = lambda test, what: F.min(F.when(test, F.struct("pre", what)))[what]
    tag = F.col("tag")
    facts = near.groupBy("doc_id", F.col("owner").alias("node_id")).agg(
        F.min(F.when(tag == "figcaption", F.struct("pre", F.coalesce("inner", none).alias("v"), "id"))).alias("cap"),
        first(F.col("listing"), "node_id").alias("listing"), first(tag == "table", "node_id").alias("table"), F.count_if("image").alias("images"),
        first(tag == "svg", "markup").alias("drawing"), F.count_if(tag == "svg").alias("drawings"), F.count_if(tag == "figure").alias("nested"),
    )
    f = f.join(facts, ["doc_id", "node_id"], "left").join(plain_text(own, f), ["doc_id", "node_id"], "left")
    named = F.coalesce(inline_anchor(F.col("cap.id")), none)
    f = f.withColumns({
        "caption": F.nullif(F.concat(named, F.coalesce("cap.v", none)), none), "visual": F.when(_has(["ltx_table"]), "table").otherwise("figure"),
        "case": F.when(F.col("listing").isNotNull(), "listing").when(F.col("table").isNotNull() & (_has(["ltx_table"]) | (F.col("images") == 0)), "table")
        .when(F.col("images") > 0, "images").when(F.col("drawings") > 0, "drawing").when(F.col("nested") > 0, "nested").otherwise("text"),
    })
    f = materialise(not_below(f, f.where(F.col("case").isin("listing", "table", "text")), strict=True), "figures")
    anchor, caption = F.col("anchor"), F.col("caption")
    f = f.withColumnRenamed("id", "anchor")
    case = lambda name: f.where(F.col("case") == name)
    of = lambda col: f.select("doc_id", F.col(col).alias("node_id"), F.col("pre").alias("at"), "anchor", "caption", _has(["ltx_figure"]).alias("pictured"), "case").where(F.col("case") == col).drop("case")
    place = el.select("doc_id", "node_id", "pre", "post", "id")
    listing = place.join(of("listing").select("doc_id", "node_id", "at"), ["doc_id", "node_id"]).withColumns({"anchor": F.col("id"), "turn": F.lit(2), "sub": F.lit(0).cast("long")})
    table = place.join(of("table"), ["doc_id", "node_id"])
    table = table.withColumns({"anchor": F.when(~F.col("pictured"), anchor), "caption": F.when(~F.col("pictured"), caption)})
    shown = near.where("image").withColumn("k", F.row_number().over(W.partitionBy("doc_id", "owner").orderBy("pre")))
    shown = shown.select("doc_id", F.col("owner").alias("node_id"), F.col("pre").alias("p"), "k", "asset", "label", F.coalesce("inner", none).alias("inside"))
    shown = case("images").join(shown, ["doc_id", "node_id"])
    lead, one = F.replace(escape_markdown(F.col("label")), F.lit("\n"), F.lit(" ")), F.col("k") == 1
    words = F.array_distinct(F.array_compact(F.array(F.nullif(lead, none), F.nullif(F.col("inside"), none))))
    words = F.when(F.size(words) > 0, words).otherwise(F.array(F.initcap("visual")))
    words = F.when(one & caption.isNotNull() & ~F.coalesce(F.array_contains(words, caption), F.lit(False)), F.array_append(words, caption)).otherwise(words)
    there = F.col("asset").isNotNull()
    images = _blocks(
        shown, F.col("visual"), 1, F.col("p"), text=F.when(~there, F.array_join(words, "\n\n")), asset=F.col("asset"), label=F.col("label"),
        anchor=F.when(one, anchor), caption=F.when(there & one, caption),
    )
    drawn = F.concat(F.coalesce("drawing", none), F.when(caption.isNull(), "").otherwise(F.concat(F.lit("\n\n*"), caption, F.lit("*"))))
    return [
        _blocks(case("listing").where(anchor.isNotNull() | caption.isNotNull()), "figure", anchor=anchor, caption=caption),
        _blocks(case("table").where(_has(["ltx_figure"])), "figure", -1, anchor=anchor, caption=caption), images,
        _blocks(case("drawing"), F.col("visual"), text=drawn, anchor=anchor), _blocks(case("nested"), "figure", at="post", anchor=anchor, caption=caption),
        _blocks(case("text"), F.col("visual"), text=F.col("text"), anchor=anchor, markdown=False),
    ], listing.select(*_LISTING), table.select(*_TABLE)


def all_blocks(nodes: DataFrame, units: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """TR07: every block in order (``pos``), and (doc_id, problem) of the documents that cannot be shown whole.

    ``nodes`` is a written node table; ``units`` (doc_id, node_id, japanese, translation_source, placeholders) are the
    texts of nodes that have their own.  Problems: a unit whose tokens do not match its protected elements, and a
    document without a heading of level 1.
    """
    own = materialise(_marked(nodes, units), "marked")
    plain = own.drop("cls", "id", "value", "ids", "unit", "block", "inline", "slot")
    handlers = own.where("block is not null")
    tops = materialise(not_below(handlers, handlers, strict=True), "tops")
    # what no page holds costs nothing: its part of the plan is left out
    tests = {"math": F.col("tag") == "math", "svg": F.col("tag") == "svg", "code": F.col("inline") == "code", "tables": F.col("tag") == "table"}
    tests |= {k: F.col("block") == k for k in ("list", "figure", "equation")} | {"listing": _has(["ltx_listing"]), "pre": F.col("block") == "code"}
    there = own.agg(*[F.coalesce(F.max(t), F.lit(False)).alias(k) for k, t in tests.items()]).first()
    nothing = lambda kind: nodes.sparkSession.createDataFrame([], f"doc_id string, node_id long, {kind}")
    tex = materialise(math_source(plain), "tex") if there["math"] else nothing("tex string")
    drawings = materialise(markup(plain, own.where("tag = 'svg'"), SVG_TAGS), "drawings") if there["svg"] else nothing("markup string")
    code = lambda: plain_text(own, own.where("inline = 'code'"), skip=["svg", "annotation", "annotation-xml"], squeezed=False)
    codes = materialise(code().withColumnRenamed("text", "code"), "codes") if there["code"] else nothing("code string")
    lists = materialise(_list_nodes(own, tops), "lists") if there["list"] else None
    items = nothing("pre long")
    if there["list"]:
        items = own.where("tag = 'li'").join(lists.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi")
        items = materialise(items, "items")
    inner = materialise(inline_markdown(own, tex, drawings, codes, items), "inline")
    of = lambda kind: tops.where(F.col("block") == kind)
    with_inner = lambda kind: of(kind).join(inner, ["doc_id", "node_id"]).where("inner <> ''")

    sections = own.where("tag = 'section' and id is not null").select("doc_id", "pre", "post", "depth", "id")
    section = pairs_below(of("heading").select("doc_id", "pre", "node_id"), sections).where("node is not null")
    section = section.groupBy("doc_id", F.col("node.node_id").alias("node_id")).agg(F.max_by("top.id", "top.depth").alias("section"))
    anchor = F.col("id")
    headings = with_inner("heading").join(section, ["doc_id", "node_id"], "left")
    walked = not_below(own.where("type = 'element'"), handlers).where("tag <> 'section'")
    parts = [
        _blocks(headings, "heading", text=F.col("inner"), level=F.substring("tag", 2, 1), anchor=F.coalesce("id", "section")),
        _blocks(with_inner("paragraph"), "paragraph", text=F.col("inner"), anchor=anchor),
        _blocks(walked.unionByName(of("list")).where("id is not null"), "paragraph", -1, anchor=anchor, markdown=False),
    ]
    if there["pre"]:
        code = of("code").drop("text").join(plain_text(own, of("code"), squeezed=False), ["doc_id", "node_id"], "left")
        solid = strip(F.coalesce("text", F.lit(""))) != ""
        parts.append(_blocks(code.where(solid), "code", text=F.col("text"), anchor=anchor, markdown=False))
        parts.append(_blocks(code.where(~solid & F.col("id").isNotNull()), "paragraph", anchor=anchor, markdown=False))
        inside = pairs_below(own.where("tag = 'svg'").join(drawings, ["doc_id", "node_id"]).select("doc_id", "pre", "markup"), of("code").select("doc_id", "pre", "post")).where("node is not null")
        parts.append(_blocks(inside, "figure", 1, F.col("node.pre"), F.col("top.pre"), text=F.col("node.markup")))
    if there["math"]:
        math = of("math").join(tex.where("tex <> ''"), ["doc_id", "node_id"])
        display = F.lower(F.coalesce(attr("display"), F.lit(""))) == "block"
        short = tex_for_markdown(F.col("tex"), True)
        parts.append(_blocks(math.where(display), "equation", text=tex_for_markdown(F.col("tex"), False), anchor=anchor, markdown=False))
        parts.append(_blocks(math.where(~display), "paragraph", text=F.when(is_safe_math(short), F.concat(F.lit("$"), short, F.lit("$"))).otherwise(inline_code(short)), anchor=anchor))
    if there["svg"]:
        parts.append(_blocks(of("svg").join(drawings, ["doc_id", "node_id"]).where("markup <> ''"), "figure", text=F.col("markup"), anchor=anchor))
    listings = [of("listing").withColumns({"anchor": anchor, "at": F.col("pre"), "turn": F.lit(0), "sub": F.lit(0).cast("long")}).select(*_LISTING)]
    tables = [of("table").withColumns({"anchor": anchor, "caption": F.lit(None).cast("string"), "at": F.col("pre")}).select(*_TABLE)]
    # every group is written by itself, which keeps plans small
    groups = [materialise(reduce(DataFrame.union, parts), "block_group")]
    if there["list"]:
        found, listing = _items(own, inner, drawings, lists, items)
        groups.append(materialise(reduce(DataFrame.union, found), "block_group"))
        listings.append(listing)
    if there["figure"]:
        found, listing, table = _figures(own, inner, drawings, of("figure"))
        groups.append(materialise(reduce(DataFrame.union, found), "block_group"))
        listings.append(listing)
        tables.append(table)
    if there["equation"]:
        groups.append(materialise(_equations(own, tex, of("equation")), "block_group"))
    if there["listing"]:
        groups.append(materialise(_listings(own, tex, materialise(reduce(DataFrame.union, listings), "listings")), "block_group"))
    if there["tables"]:
        groups.append(materialise(_tables(own, inner, materialise(reduce(DataFrame.union, tables), "tables")), "block_group"))
    out = reduce(DataFrame.union, groups)

    order = W.partitionBy("doc_id").orderBy("at", "turn", "sub", "kind", "anchor")
    numbered = materialise(out.withColumn("pos", F.row_number().over(order)).drop("at", "turn", "sub"), "blocks")
    titled = numbered.where("kind = 'heading' and level = 1").select("doc_id").distinct()
    untitled = nodes.select("doc_id").distinct().join(titled, "doc_id", "left_anti").select("doc_id", F.lit("no heading of level 1").alias("problem"))
    unsound = inner.where("not sound").select("doc_id", F.concat(F.lit("tokens of node "), "node_id", F.lit(" do not match its protected elements")).alias("problem"))
    return numbered, untitled.union(unsound)


def readable(blocks: DataFrame) -> DataFrame:
    """TR10: anchors that no link of the document points to go, from blocks and texts, and so do blocks left empty."""
    plain = F.when(F.col("kind") != "code", F.concat_ws("\n", "text", "caption", F.array_join(F.flatten("rows"), "\n")))
    links = F.concat(
        F.regexp_extract_all(plain, F.lit(r"(?<!!)\[(?:\\.|[^\]\\])*\]\(#([^\s)]+)\)"), F.lit(1)), F.regexp_extract_all(plain, F.lit(r'(?i)<a\b[^>]*\bhref="#([^"]+)"'), F.lit(1))
    )
    target = F.replace(F.col("t"), F.lit("+"), F.lit("%2B"))
    wanted = blocks.select("doc_id", F.explode(links).alias("t")).select("doc_id", anchor_id(F.coalesce(F.try_url_decode(target), target)).alias("anchor"))
    wanted = wanted.groupBy("doc_id").agg(F.collect_set("anchor").alias("wanted"))  # the link targets of one document
    b = blocks.join(wanted, "doc_id", "left").withColumn("wanted", F.coalesce("wanted", F.array().cast("array<string>")))
    own = anchor_id(F.col("anchor"))
    b = b.withColumn("__a", F.when(F.col("anchor").isNotNull() & F.array_contains("wanted", own), own))
    first = F.row_number().over(W.partitionBy("doc_id", "__a").orderBy("pos")) == 1
    b = b.withColumn("anchor", F.when(F.col("__a").isNotNull() & first, F.col("anchor")))

    def pruned(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(r'<a id="([^"]+)"></a>'), F.lit(1)))
        loose = F.filter(found, lambda x: ~F.array_contains("wanted", x))
        out = F.aggregate(loose, text, lambda t, x: F.replace(t, F.concat(F.lit('<a id="'), x, F.lit('"></a>')), F.lit("")))
        return F.when(text.rlike("(?i)<(?:svg|table)[ >]"), text).otherwise(out)  # raw regions stay as they are

    b = b.withColumns({"text": pruned(F.col("text")), "caption": pruned(F.col("caption")), "rows": F.transform("rows", lambda r: F.transform(r, pruned))})
    some = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    keep = F.col("anchor").isNotNull() | F.col("asset").isNotNull() | (F.coalesce(F.size("rows"), F.lit(0)) > 0) | some("text") | some("caption")
    return b.where(keep).drop("wanted", "__a")


def sound(blocks: DataFrame, problems: DataFrame) -> DataFrame:
    """The readable blocks of the documents without a problem."""
    return readable(blocks.join(problems.select("doc_id").distinct(), "doc_id", "left_anti"))


def project(nodes: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """TR07: the readable blocks of every page that can be shown whole; others have none (see ``all_blocks``)."""
    return sound(*all_blocks(nodes, units))
