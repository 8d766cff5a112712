"""Quality assurance of semantic documents: one query a violation (AG21, AG24, JN35-JN36, RM20, RM30, AG26-AG27, AG29-AG30)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import canonical_reference, is_blank, is_local_asset, squeeze


def _finding(rows: DataFrame, rule: str, subject: str) -> DataFrame:
    return rows.select("doc_id", F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))


def findings(t: dict[str, DataFrame]) -> DataFrame:
    """AG24: (doc_id, rule, subject) over tables documents, blocks, assignments, units, sections, visuals."""
    u, v, a, b, s = t["units"], t["visuals"], t["assignments"], t["blocks"], t["sections"]
    dup = lambda rows, key: rows.groupBy("doc_id", key).agg(F.count("*").alias("n")).where("n > 1")
    expected = a.where(~F.col("hidden") & ~F.col("role").isin("caption", "metadata", "equation"))
    shown = u.select("doc_id", F.explode("source_block_ids").alias("block_id")).union(s.select("doc_id", F.col("title_block_id").alias("block_id")))
    captions = v.select("doc_id", "object_id", F.explode("caption_block_ids").alias("block_id"))
    shared = captions.groupBy("doc_id", "block_id").agg(F.countDistinct("object_id").alias("n")).where("n > 1")
    visible = b.join(a.where("not hidden and role <> 'caption'").select("doc_id", "block_id"), ["doc_id", "block_id"], "left_semi")
    boxes = v.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), F.col("bbox_norm").alias("__v"))
    covered = visible.join(boxes, (visible["doc_id"] == boxes["__d"]) & (visible["page"] == boxes["__p"]) & (G.overlap_ratio(visible["bbox_norm"], boxes["__v"]) >= 0.4), "left_semi")
    labels = v.select("doc_id", canonical_reference(F.col("label")).alias("name")).where("name is not null")
    named = u.select("doc_id", F.explode(F.transform("object_references", canonical_reference)).alias("name")).where("name not like 'equation%'").distinct()
    of_section = u.where("section_id is not null").join(s.select("doc_id", "section_id"), ["doc_id", "section_id"], "left_anti")
    parents = s.where("parent_section_id is not null").select("doc_id", F.col("parent_section_id").alias("section_id"))
    rows = [
        _finding(expected.join(shown, ["doc_id", "block_id"], "left_anti"), "block_not_represented", "block_id"),
        _finding(dup(shown, "block_id"), "block_represented_twice", "block_id"),
        _finding(shown.join(a.where("hidden").select("doc_id", "block_id"), ["doc_id", "block_id"], "left_semi"), "hidden_block_shown", "block_id"),
        _finding(dup(u, "unit_id"), "duplicate_unit", "unit_id"), _finding(dup(s, "section_id"), "duplicate_section", "section_id"),
        _finding(dup(v, "object_id"), "duplicate_visual", "object_id"), _finding(dup(v.where("label is not null"), "label"), "duplicate_label", "label"),
        _finding(shared, "caption_shared", "block_id"), _finding(covered, "text_under_visual", "block_id"),
        _finding(u.where(is_blank(F.col("original"))), "blank_unit", "unit_id"), _finding(of_section, "unknown_section", "unit_id"),
        _finding(parents.join(s.select("doc_id", "section_id"), ["doc_id", "section_id"], "left_anti"), "unknown_parent", "section_id"),
        _finding(named.join(labels, ["doc_id", "name"], "left_anti"), "unresolved_reference", "name"),
        _finding(v.where(~G.is_valid(F.col("bbox_norm"))), "bad_rectangle", "object_id"),
        _finding(v.where(F.col("asset").isNull() | ~is_local_asset(F.col("asset"))), "asset_not_local", "object_id"),
        _finding(v.where(F.size("caption_block_ids") == 0).where("kind <> 'equation'"), "visual_without_caption", "object_id"),
        _finding(u.where("confidence < 0.5"), "low_confidence", "unit_id"),
        _finding(t["documents"].where(is_blank(F.col("title"))), "no_title", "doc_id"),
        _finding(t["documents"].join(u.where("kind in ('paragraph','abstract','list_item')").select("doc_id"), "doc_id", "left_anti"), "no_body", "doc_id"),
    ]
    return reduce(DataFrame.unionByName, rows)


def status(documents: DataFrame, found: DataFrame) -> DataFrame:
    """AG24: passed when a document has no finding; counts a rule otherwise."""
    n = found.groupBy("doc_id").agg(F.count("*").alias("n_findings"), F.sort_array(F.collect_set("rule")).alias("rules"))
    out = documents.select("doc_id").join(n, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"),
                      F.when(F.col("n_findings").isNull(), "passed").otherwise("failed").alias("status"))


def runtime_issues(documents: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """RM20: pages without a size, documents without body text."""
    a = _finding(pages.where("width is null or height is null or width <= 0 or height <= 0"), "page_without_size", "page")
    text = blocks.where(~is_blank(F.col("text"))).select("doc_id")
    return a.unionByName(_finding(documents.join(text, "doc_id", "left_anti"), "no_text", "doc_id"))


def layout_totals(reports: DataFrame, by: list[str]) -> DataFrame:
    """AG26: summed counts and the worst overlap."""
    n = [F.sum(c).cast("long").alias(c) for c in ("warnings", "unresolved", "collisions", "overflows", "shrunk")]
    return reports.groupBy(*by).agg(*n, F.max("worst_overlap").alias("worst_overlap"))


def batch_stats(segments: DataFrame, by: list[str]) -> DataFrame:
    """AG27."""
    return segments.groupBy(*by).agg(F.count("*").alias("segments"), F.sum(F.length("text")).cast("long").alias("characters"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """AG29: nodes whose parent changed, and how many of them are list items."""
    b = before.select("doc_id", "node_id", F.col("parent_id").alias("__p"))
    m = after.join(b, ["doc_id", "node_id"]).where(~F.col("parent_id").eqNullSafe(F.col("__p")))
    return m.groupBy("doc_id").agg(F.count("*").alias("moved_nodes"), F.count_if(F.col("tag") == "li").alias("moved_items"))


def math_roles(math: DataFrame) -> DataFrame:
    """AG30: formulas inline, in rows, displayed, or literal."""
    return math.groupBy("doc_id").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("inline", "row", "display", "literal")])


def unrepresented(expected: DataFrame, represented: DataFrame, by: list[str]) -> DataFrame:
    """JN35: blocks that should stand in the document and do not."""
    return expected.select(*by).distinct().join(represented.select(*by), by, "left_anti")


def distinct_authors(authors: Column) -> Column:
    """RM30: authors without blanks, first spelling of each, in order."""
    plain = F.filter(F.transform(authors, squeeze), lambda a: a != "")
    return F.filter(plain, lambda a, i: ~F.exists(F.slice(plain, 1, i), lambda b: F.lower(b) == F.lower(a)))


def blank_assets(assets: DataFrame, least_bytes: int = 1) -> DataFrame:
    """RM30: assets without content."""
    return assets.where(F.coalesce(F.col("bytes"), F.lit(0)) < least_bytes)
