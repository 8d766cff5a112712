"""Markdown rendering (TR08, TR10, TR14-TR16, WN17-WN19, SRT02, RM09-RM14, FN35, FN41, SNK03-SNK05, SNK11).

Blocks are rows; each kind is an expression, and a document is an ordered concatenation.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import anchor_core, code_fence, escape_markdown, is_blank, is_safe_asset_path, is_safe_display_math, preferred_text

KINDS = ["heading", "paragraph", "reference", "list_item", "figure", "table", "equation", "code"]


def unique_anchors(blocks: DataFrame, order: str = "pos") -> DataFrame:
    """FN37, WN17: the k-th repeat of an anchor within a document gets ``-k``."""
    b = blocks.withColumn("__base", anchor_core(F.col("anchor")))  # once a block; only what is left empty is looked at again
    b = b.withColumn("__base", F.when(F.col("__base") == "", F.when(~is_blank(F.col("anchor")), "block")).otherwise(F.col("__base")))
    k = F.row_number().over(W.partitionBy("doc_id", "__base").orderBy(order))
    return b.withColumn("anchor", F.when(k == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), k))).drop("__base")


def _lines(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")


def block_markdown(blocks: DataFrame) -> DataFrame:
    """TR14: adds ``body``, the Markdown of each block."""
    trusted = F.coalesce("text_is_markdown", F.lit(False))
    shown = lambda c: F.when(trusted, _lines(c)).otherwise(escape_markdown(_lines(c)))
    text = shown(F.col("text"))
    caption = F.when(is_blank(F.col("caption")), "").otherwise(F.when(trusted, F.trim("caption")).otherwise(
        F.concat(F.lit("*"), shown(F.trim("caption")), F.lit("*"))
    ))
    alt = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("label", "caption", "text")], F.initcap("kind"))
    image = F.when(F.col("asset").isNotNull() & is_safe_asset_path(F.col("asset")), F.concat(
        F.lit("!["), F.replace(escape_markdown(alt), F.lit("\n"), F.lit(" ")), F.lit("]("), F.col("asset"), F.lit(")"))).otherwise("")
    both = lambda a, b: F.concat_ws("\n\n", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    fence = code_fence(_lines(F.col("text")))
    code = lambda lang: F.concat(fence, lang, F.lit("\n"), F.rtrim(_lines(F.col("text")), F.lit("\n")), F.lit("\n"), fence)
    language = F.btrim(F.regexp_replace(F.trim(F.coalesce("language", F.lit(""))), r"[^A-Za-z0-9_+.#-]+", "-"), F.lit("-"))
    indent = F.repeat(F.lit("    "), F.greatest(F.lit(1), F.coalesce("level", F.lit(1))) - 1)
    marker = F.when(F.coalesce("ordered", F.lit(False)), F.concat(F.greatest(F.lit(1), F.coalesce("start", F.lit(1))).cast("string"), F.lit("."))).otherwise("-")
    item = F.rtrim(F.concat(indent, marker, F.lit(" "), F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), indent, F.lit("   ")))))
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    cells = lambda r: F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.replace(shown(c), F.lit("\n"), F.lit("<br>")))
    row = lambda r: F.concat(F.lit("| "), F.array_join(cells(r), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    some = F.coalesce(F.size("rows"), F.lit(0)) > 0
    table = F.when(some & (width > 0), both(caption, F.array_join(F.concat(
        F.array(row(F.get("rows", F.lit(0)))), F.array(rule), F.transform(F.slice("rows", 2, F.greatest(F.lit(1), F.size("rows"))), row)), "\n")))
    tex = F.trim(F.col("text"))
    equation = F.when(image != "", both(image, caption)).when(tex == "", caption).otherwise(both(
        F.when(is_safe_display_math(tex), F.concat(F.lit("$$\n"), tex, F.lit("\n$$"))).otherwise(code(F.lit("tex"))), caption))
    visual = both(image, caption)
    level = F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce("level", F.lit(2))))
    body = (
        F.when(F.col("kind") == "heading", F.rtrim(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)))
        .when(F.col("kind") == "list_item", item).when(F.col("kind") == "equation", equation)
        .when(F.col("kind") == "code", F.when(is_blank(F.col("text")), visual).otherwise(code(language)))
        .when(F.col("kind") == "table", F.coalesce(table, F.coalesce(F.nullif(visual, F.lit("")), text)))
        .when(F.col("kind") == "figure", F.coalesce(F.nullif(visual, F.lit("")), text)).otherwise(text)
    )
    return blocks.withColumn("body", F.btrim(body, F.lit("\n")))


def serialize(blocks: DataFrame, order: str = "pos") -> DataFrame:
    """TR14, WN18, SNK05: (doc_id, markdown): list items on adjacent lines, other blocks apart, one newline at the end."""
    b = block_markdown(unique_anchors(blocks, order))
    mark = F.concat(F.lit('<a id="'), F.col("anchor"), F.lit('"></a>'))
    item = F.regexp_replace("body", r"^(\s*(?:-|\d+\.)\s+)", F.concat(F.lit("$1"), mark))
    with_anchor = F.when(F.col("anchor").isNull(), F.col("body")).when(F.col("body") == "", mark).when(
        F.col("kind") == "list_item", item).otherwise(F.concat(mark, F.lit("\n\n"), F.col("body")))
    b = b.withColumn("body", with_anchor).where("body <> ''")
    w = W.partitionBy("doc_id").orderBy(order)
    lists = (F.lag("kind").over(w) == "list_item") & (F.col("kind") == "list_item")
    sep = F.when(F.lag("kind").over(w).isNull(), "").when(lists, "\n").otherwise("\n\n")
    parts = b.withColumn("piece", F.concat(sep, "body")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, "piece"))).alias("p"))
    return parts.select("doc_id", F.concat(F.rtrim(F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.lit(" \n\t")), F.lit("\n")).alias("markdown"))


def number_lists(items: DataFrame) -> DataFrame:
    """WN19: start plus place within its list, depth from the nesting."""
    w = W.partitionBy("doc_id", "list_id").orderBy("pos")
    return items.withColumn("start", F.coalesce("start", F.lit(1)) + F.row_number().over(w) - 1)


def semantic_order(content: DataFrame) -> DataFrame:
    """SRT02: numeric positions first, visuals before units at a tie, then the index."""
    w = W.partitionBy("doc_id").orderBy(F.col("position").asc_nulls_last(), F.when(F.col("type") == "visual", 0).otherwise(1), "index")
    return content.withColumn("pos", F.row_number().over(w))


def blocks_of_units(units: DataFrame) -> DataFrame:
    """TR15, RM13-RM14: units as blocks; the translation is shown where there is one."""
    kind = F.when(F.col("kind").isin("title", "heading"), "heading").when(F.col("kind") == "list_item", "list_item").when(
        F.col("kind") == "reference", "reference").otherwise("paragraph")
    none = lambda t: F.lit(None).cast(t)
    return units.select(
        "doc_id", "pos", kind.alias("kind"), preferred_text(F.col("japanese"), F.col("original")).alias("text"),
        F.when(F.col("kind") == "title", 1).otherwise(F.least(F.lit(6), F.coalesce("level", F.lit(1)) + 1)).alias("level"),
        F.col("unit_id").alias("anchor"), none("string").alias("asset"), none("string").alias("caption"), none("string").alias("label"),
        F.lit(False).alias("ordered"), none("int").alias("start"), none("string").alias("language"), none("array<array<string>>").alias("rows"),
        F.lit(False).alias("text_is_markdown"),
    )


def prune_anchors(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """TR10: anchors stay only where a link points to them, the first of each."""
    wanted = links.select("doc_id", F.col("target").alias("anchor"), F.lit(True).alias("__w")).distinct()
    b = blocks.join(wanted, ["doc_id", "anchor"], "left")
    first = F.row_number().over(W.partitionBy("doc_id", "anchor").orderBy("pos")) == 1
    return b.withColumn("anchor", F.when(F.col("__w") & first, F.col("anchor"))).drop("__w")


_URL = re.compile(r"https?://[^\s<>\"']+", re.I)


@F.pandas_udf(StringType())
def with_external_links(text: pd.Series) -> pd.Series:
    """FN35: addresses become links; trailing punctuation and unmatched closing brackets stay outside."""

    def escape(t: str) -> str:
        return re.sub(r"([\\`*_\[\]<>|~$])", r"\\\1", t)

    def one(t: str) -> str:
        out, at = [], 0
        for m in _URL.finditer(t):
            out.append(escape(t[at : m.start()]))
            url = m[0].rstrip(".,;:!?。、，；：！？）］】〉》」』")
            while url.endswith(")") and url.count("(") < url.count(")"):
                url = url[:-1]
            host = re.match(r"https?://[^/?#]+", url, re.I)
            out.append(f"[{escape(url)}]({url})" if host else escape(url))
            out.append(escape(m[0][len(url) :]))
            at = m.end()
        return "".join(out) + escape(t[at:])

    return text.map(one, na_action="ignore")


def without_code(markdown: Column) -> Column:
    """TR16: fenced and inline code blanked out before links are looked for."""
    return F.regexp_replace(F.regexp_replace(markdown, r"(?ms)^(`{3,})[^\n]*\n.*?^\1\s*$", ""), r"(?s)(`+)(?!`).+?(?<!`)\1(?!`)", "")


def link_targets(markdown: Column) -> Column:
    """RM11: fragment targets of the links outside code."""
    return F.array_distinct(F.regexp_extract_all(without_code(markdown), F.lit(r"\]\(#([^)\s]+)\)"), F.lit(1)))


def anchors(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(r'<a id="([^"]+)"></a>'), F.lit(1))


def markdown_qa(docs: DataFrame) -> DataFrame:
    """AG23, AG25: duplicate anchors, unresolved links, unlocalised media and emptiness; status."""
    a, links = anchors(F.col("markdown")), link_targets(F.col("markdown"))
    media = F.regexp_extract_all(without_code(F.col("markdown")), F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))
    out = docs.select(
        "doc_id", (F.size(a) - F.size(F.array_distinct(a))).alias("duplicate_anchors"),
        F.array_except(links, a).alias("unresolved"), F.filter(media, lambda m: ~is_safe_asset_path(m)).alias("unlocalised"),
        F.regexp_count("markdown", F.lit(r"(?m)^\$\$$")).alias("display_marks"), (F.trim("markdown") == "").alias("empty"),
    )
    ok = (F.col("duplicate_anchors") == 0) & (F.size("unresolved") == 0) & (F.size("unlocalised") == 0) & ~F.col("empty") & (F.col("display_marks") % 2 == 0)
    return out.withColumn("status", F.when(ok, "passed").otherwise("failed"))


def visual_sheet(visuals: DataFrame) -> DataFrame:
    """SNK11: one HTML card a visual."""
    card = F.format_string('<figure id="%s"><img src="%s"><figcaption>%s</figcaption></figure>', "object_id", "asset", F.coalesce("label", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("page", "object_id", card.alias("card"))))
    return visuals.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["card"]), "\n").alias("html"))


def html_page(blocks: DataFrame, version: str) -> DataFrame:
    """SNK03-SNK04, RM43: a plain HTML page a document with a table of contents and a version stamp."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    level = F.least(F.lit(4), F.coalesce("level", F.lit(2))).cast("string")
    tag = F.when(F.col("kind") == "heading", F.concat(F.lit("h"), level)).when(F.col("kind") == "code", "pre").otherwise("p")
    line = F.concat(F.lit("<"), tag, F.lit(' id="'), F.coalesce("anchor", F.lit("")), F.lit('">'), esc(F.coalesce("text", F.lit(""))), F.lit("</"), tag, F.lit(">"))
    toc = F.when(F.col("kind") == "heading", F.concat(F.lit('<li><a href="#'), F.coalesce("anchor", F.lit("")), F.lit('">'), esc(F.col("text")), F.lit("</a></li>")))
    rows = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), toc.alias("toc"))))
    out = unique_anchors(blocks).groupBy("doc_id").agg(rows.alias("r"))
    join = lambda c: F.array_join(F.array_compact(F.transform("r", lambda x: x[c])), "\n")
    return out.select("doc_id", F.concat(
        F.lit(f'<!DOCTYPE html><meta charset="utf-8"><meta name="generator" content="{version}"><nav><ul>\n'), join("toc"), F.lit("\n</ul></nav>\n"), join("line"), F.lit("\n")
    ).alias("html"))
