"""Figures whose left and right panels were found apart (RP13, JN25, GEO10): one picture again, and the text around it mended.

The caption names both sides; exactly one unlabelled neighbour makes the row whole; two or more headings repeated in
the caption prove it and are suppressed, with the sections they had opened; a sentence that the figure had cut in two
is joined.  Where any of this is not unique nothing is changed and the figures are reported (fail closed).  All
merges of a document are decided on its state before them, so their order does not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import squeeze
from ..storage import materialise

# Shares of the page and of rectangles.
LEAST_LEVEL, MOST_GAP, MOST_WIDTH, MOST_CAPTION_GAP = 0.55, 0.22, 0.82, 0.10
HEADER_CHARS, HEADER_SHARE, HEADER_SLACK = (4, 80), 0.65, 0.03
ENDS_SENTENCE = r"[.!?;:)\]}’”]\s*$"
NOT_ANCHORS = ["caption", "equation", "algorithm"]
PROSE = ["abstract", "paragraph"]


@dataclass
class Merged:
    """Tables after the merge, and what was done or left."""

    visuals: DataFrame
    assignments: DataFrame
    sections: DataFrame
    #: doc_id, page, object_id, merged_ids, header_ids, relinked_ids, reparented_ids
    merges: DataFrame
    #: doc_id, object_id of figures that a caption calls left or right and that could not be merged
    unresolved: DataFrame
    #: doc_id, section_id of sections whose parent is gone
    dangling: DataFrame


def _hull(boxes: Column) -> Column:
    edge = lambda f, k: f(F.transform(boxes, lambda b: b[k]))
    return G.rect(edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"))


def spans_both_sides(picture: Column, caption: Column) -> Column:
    """GEO10: one crop already as wide as its caption, centred over it and just above."""
    wide, under = picture["x1"] - picture["x0"], caption["x1"] - caption["x0"]
    shared = F.greatest(F.lit(0.0), F.least(picture["x1"], caption["x1"]) - F.greatest(picture["x0"], caption["x0"]))
    apart = F.abs((picture["x0"] + picture["x1"] - caption["x0"] - caption["x1"]) / 2)
    return (
        (wide >= 0.30) & (under > 0) & (wide >= 0.72 * under) & (shared >= 0.82 * F.least(wide, under)) & (apart <= 0.08)
        & (caption["y0"] - picture["y1"]).between(0.0, 0.12)
    )


def _beside(a: Column, b: Column, caption_top: Column) -> Column:
    """Whether two pictures make one row above the caption."""
    shared = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    flat = F.greatest(F.lit(1e-9), F.least(a["y1"] - a["y0"], b["y1"] - b["y0"]))
    gap = F.greatest(F.lit(0.0), F.greatest(a["x0"], b["x0"]) - F.least(a["x1"], b["x1"]))
    width = F.greatest(a["x1"], b["x1"]) - F.least(a["x0"], b["x0"])
    below = caption_top - F.greatest(a["y1"], b["y1"])
    return (shared >= LEAST_LEVEL * flat) & (gap <= MOST_GAP) & (width <= MOST_WIDTH) & below.between(0.0, MOST_CAPTION_GAP)


def _pairs(visuals: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captioned figures with their one neighbour, and the figures left (doc_id, object_id)."""
    figures = visuals.where("kind = 'figure'")
    words = blocks.select("doc_id", "page", F.col("block_id").alias("caption_id"), F.col("text").alias("c_text"), F.col("bbox_norm").alias("c_box"))
    parts = figures.select("doc_id", "page", "object_id", F.posexplode("caption_ids").alias("n", "caption_id")).join(words, ["doc_id", "page", "caption_id"])
    captions = parts.groupBy("doc_id", "page", "object_id").agg(F.array_sort(F.collect_list(F.struct("n", "c_text", "c_box"))).alias("c")).select(
        "doc_id", "page", "object_id", F.array_join(F.transform("c", lambda x: F.coalesce(x["c_text"], F.lit(""))), " ").alias("caption"),
        _hull(F.transform("c", lambda x: x["c_box"])).alias("caption_box"),
    )
    both = F.col("caption").rlike(r"(?i)\(\s*left\s*\)") & F.col("caption").rlike(r"(?i)\(\s*right\s*\)")
    named = figures.join(captions.where(both), ["doc_id", "page", "object_id"])
    alone = figures.where("coalesce(label, '') = '' and coalesce(size(caption_ids), 0) <= 0").select("doc_id", "page", F.col("object_id").alias("other_id"), F.col("bbox_norm").alias("other_box"))
    near = named.join(alone, ["doc_id", "page"]).where(_beside(F.col("bbox_norm"), F.col("other_box"), F.col("caption_box.y0")))
    found = near.groupBy("doc_id", "object_id").agg(F.collect_list(F.struct("other_id", "other_box")).alias("others"))
    all_ = materialise(named.join(found, ["doc_id", "object_id"], "left"), "panel_candidates")
    n = F.coalesce(F.size("others"), F.lit(0))
    several = all_.where(n > 1).select("doc_id", F.explode(F.array_append(F.transform("others", lambda o: o["other_id"]), F.col("object_id"))).alias("object_id"))
    none = all_.where((n <= 0) & ~spans_both_sides(F.col("bbox_norm"), F.col("caption_box"))).select("doc_id", "object_id")
    one = all_.where(n == 1).select("doc_id", "page", "object_id", "visual_order", "bbox_norm", "caption_ids", "caption", "insert_after", "others.other_id", "others.other_box")
    return one.withColumns({"other_id": F.get("other_id", F.lit(0)), "other_box": F.get("other_box", F.lit(0))}), several.union(none)


def _proved(pairs: DataFrame, blocks: DataFrame, ink: DataFrame | None) -> DataFrame:
    """Pairs with two headings or more that the caption repeats, the first of those that want the same neighbour."""
    text = squeeze(F.coalesce("text", F.lit("")))
    b = blocks.select("doc_id", "page", "block_id", text.alias("h_text"), F.col("bbox_norm").alias("h"))
    whole = _hull(F.array("bbox_norm", "other_box"))
    near = pairs.withColumn("whole", whole).join(b, ["doc_id", "page"])
    shared = F.greatest(F.lit(0.0), F.least("whole.x1", "h.x1") - F.greatest("whole.x0", "h.x0"))
    header = (
        ~F.array_contains("caption_ids", F.col("block_id")) & F.length("h_text").between(*HEADER_CHARS) & F.lower(squeeze(F.col("caption"))).contains(F.lower("h_text"))
        & (shared >= HEADER_SHARE * F.greatest(F.lit(1e-9), F.col("h.x1") - F.col("h.x0")))
        & (F.col("h.y0") >= F.col("whole.y0") - HEADER_SLACK) & (F.col("h.y1") <= F.col("whole.y1") + HEADER_SLACK)
    )
    heads = near.where(header).groupBy("doc_id", "object_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "h"))).alias("heads")).where(F.size("heads") >= 2)
    out = pairs.join(heads, ["doc_id", "object_id"]).withColumns({
        "box": _hull(F.concat(F.array("bbox_norm", "other_box"), F.transform("heads", lambda x: x["h"]))), "header_ids": F.transform("heads", lambda x: x["block_id"]),
    }).drop("heads")
    if ink is not None:  # the inked part of the box, where a renderer has measured it
        out = out.drop("box").join(ink.select("doc_id", "object_id", F.col("bbox_norm").alias("box")), ["doc_id", "object_id"])
    first = F.row_number().over(W.partitionBy("doc_id", "page", "other_id").orderBy("visual_order", "object_id"))
    return out.withColumn("turn", first).where("turn = 1").drop("turn")


def _anchors(merges: DataFrame, ordered: DataFrame, removed: DataFrame) -> DataFrame:
    """Adds to each merge where its headings and its caption stand, the block before it, and the section around that."""
    at = ordered.select("doc_id", "block_id", "at")
    places = lambda ids, f, name: merges.select("doc_id", "object_id", F.explode(ids).alias("block_id")).join(at, ["doc_id", "block_id"]).groupBy("doc_id", "object_id").agg(f("at").alias(name))
    m = merges.join(places("header_ids", F.min, "first"), ["doc_id", "object_id"], "left")
    m = m.join(places(F.concat("header_ids", "caption_ids"), F.max, "last"), ["doc_id", "object_id"], "left")
    gone = removed.select("doc_id", "section_id", F.lit(True).alias("gone"))
    seen = ordered.join(gone, ["doc_id", "section_id"], "left").where("not hidden").select("doc_id", F.col("block_id").alias("b"), "at", "role", F.when(F.col("gone").isNull(), F.col("section_id")).alias("s"))
    before = m.select("doc_id", "object_id", "first").join(seen, "doc_id").where("first is null or at < first").groupBy("doc_id", "object_id").agg(
        F.max_by("s", F.when(F.col("s").isNotNull(), F.col("at"))).alias("fallback"),
        F.max_by("b", F.when(~F.coalesce(F.col("role").isin(NOT_ANCHORS), F.lit(False)), F.col("at"))).alias("anchor"),
    )
    m = m.join(before, ["doc_id", "object_id"], "left")
    return m.withColumn("anchor", F.coalesce("anchor", F.nullif(F.col("insert_after"), F.lit(""))))


def _relinked(merges: DataFrame, ordered: DataFrame, blocks: DataFrame, headers: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """(doc_id, object_id, block_id, at, paragraph, section, previous) of blocks that go on with the anchor's sentence."""
    text = blocks.select("doc_id", "block_id", "text")
    a = ordered.join(text, ["doc_id", "block_id"]).where(~F.col("hidden") & F.col("role").isin(PROSE) & F.col("paragraph_id").isNotNull())
    shown = F.rtrim(F.coalesce("text", F.lit("")))
    a = a.where((shown != "") & ~shown.rlike(ENDS_SENTENCE)).select("doc_id", F.col("block_id").alias("anchor"), F.col("paragraph_id").alias("paragraph"), F.col("section_id").alias("section"))
    moved = ordered.join(fallbacks, ["doc_id", "section_id"], "left").join(headers.withColumn("head", F.lit(True)), ["doc_id", "block_id"], "left")
    moved = moved.where("not hidden and head is null").select("doc_id", "block_id", "at", "role", "paragraph_id", F.coalesce("replaced", "section_id").alias("now"))
    prose = moved.where(F.col("role").isin(PROSE)).join(text, ["doc_id", "block_id"]).select("doc_id", F.struct("at", "block_id", "paragraph_id", "now", "text").alias("next"))
    m = merges.where("last is not null").select("doc_id", "object_id", "anchor", "last", "fallback").join(a, ["doc_id", "anchor"])
    m = m.join(prose, "doc_id").where("next.at > last").groupBy("doc_id", "object_id", "anchor", "fallback", "paragraph", "section").agg(F.min("next").alias("next"))
    same = F.col("next.now").isNull() | F.coalesce(F.col("next.now") == F.col("fallback"), F.lit(False))
    m = m.where(F.ltrim("next.text").rlike(r"^\p{Ll}") & same).withColumn("old", F.coalesce("next.paragraph_id", "next.block_id"))
    rest = ordered.select("doc_id", "block_id", "at", F.coalesce("paragraph_id", "block_id").alias("old"))
    rows = m.join(rest, ["doc_id", "old"]).where("at >= next.at")
    w = W.partitionBy("doc_id", "object_id").orderBy("at")
    return rows.withColumn("previous", F.coalesce(F.lag("block_id").over(w), F.col("anchor"))).select("doc_id", "object_id", "block_id", "at", "paragraph", "section", "previous")


def merge_split_panels(visuals: DataFrame, blocks: DataFrame, assignments: DataFrame, sections: DataFrame, ink: DataFrame | None = None) -> Merged:
    """RP13, JN25.

    visuals: doc_id, page, object_id, visual_order, kind, label, bbox_norm, caption_ids, insert_after; blocks: doc_id,
    page, block_id, text, bbox_norm; assignments: doc_id, page, block_id, reading_order, role, section_id,
    paragraph_id, continues_from, hidden; sections: doc_id, section_id, parent_id, title_id.  ``ink`` (doc_id,
    object_id, bbox_norm) holds rendered extents; a figure that it lacks is not merged.
    """
    pairs, left = _pairs(visuals, blocks)
    pairs = materialise(pairs, "panel_pairs")
    proved = materialise(_proved(pairs, blocks, ink), "panels")
    failed = pairs.join(proved.select("doc_id", "object_id"), ["doc_id", "object_id"], "left_anti")
    unresolved = left.union(failed.select("doc_id", F.explode(F.array("object_id", "other_id")).alias("object_id"))).distinct()

    order = W.partitionBy("doc_id").orderBy("page", "reading_order")
    ordered = materialise(assignments.withColumn("at", F.row_number().over(order)), "ordered")
    headers = proved.select("doc_id", "object_id", F.explode("header_ids").alias("block_id"))
    removed = sections.join(headers.withColumnRenamed("block_id", "title_id"), ["doc_id", "title_id"]).select("doc_id", "section_id", "object_id")
    removed = materialise(removed.groupBy("doc_id", "section_id").agg(F.min("object_id").alias("object_id")), "removed")
    merges = materialise(_anchors(proved, ordered, removed), "merges")
    fallbacks = removed.join(merges.select("doc_id", "object_id", "fallback"), ["doc_id", "object_id"]).select("doc_id", "section_id", F.col("fallback").alias("replaced"), F.lit(True).alias("gone"))
    heads = headers.select("doc_id", "block_id").distinct()
    relinked = materialise(_relinked(merges, ordered, blocks, heads, fallbacks.drop("gone")), "relinked")

    kept = sections.join(removed.select("doc_id", "section_id"), ["doc_id", "section_id"], "left_anti")
    parent = fallbacks.select("doc_id", F.col("section_id").alias("parent_id"), F.col("replaced").alias("new_parent"), F.lit(True).alias("orphan"))
    kept = kept.join(parent, ["doc_id", "parent_id"], "left")
    reparented = kept.where("orphan").select("doc_id", "section_id", "parent_id")
    tree = kept.withColumn("parent_id", F.when(F.col("orphan"), F.col("new_parent")).otherwise(F.col("parent_id"))).select(*sections.columns)
    known = tree.select("doc_id", F.col("section_id").alias("parent_id"))
    dangling = tree.where("parent_id is not null").join(known, ["doc_id", "parent_id"], "left_anti").select("doc_id", "section_id")

    link = relinked.groupBy("doc_id", "block_id").agg(F.min(F.struct("object_id", "paragraph", "section", "previous")).alias("link"))
    out = ordered.join(fallbacks, ["doc_id", "section_id"], "left").join(heads.withColumn("head", F.lit(True)), ["doc_id", "block_id"], "left").join(link, ["doc_id", "block_id"], "left")
    head, linked = F.col("head").isNotNull(), F.col("link").isNotNull()
    section = F.when(F.col("gone"), F.col("replaced")).otherwise(F.col("section_id"))
    out = out.withColumns({
        "role": F.when(head, "noise").otherwise(F.col("role")), "hidden": head | F.col("hidden"),
        "section_id": F.when(head, None).when(linked, F.col("link.section")).otherwise(section),
        "paragraph_id": F.when(head, None).when(linked, F.col("link.paragraph")).otherwise(F.col("paragraph_id")),
        "continues_from": F.when(head, None).when(linked, F.col("link.previous")).otherwise(F.col("continues_from")),
    }).select(*assignments.columns)

    new = merges.select("doc_id", "object_id", F.col("box").alias("__box"), F.col("anchor").alias("__anchor"))
    eaten = merges.select("doc_id", F.col("other_id").alias("object_id"))
    pictures = visuals.join(eaten, ["doc_id", "object_id"], "left_anti").join(new, ["doc_id", "object_id"], "left")
    joined = F.col("__box").isNotNull()
    pictures = pictures.withColumns({
        "bbox_norm": F.coalesce("__box", "bbox_norm"), "insert_after": F.when(joined, F.col("__anchor")).otherwise(F.col("insert_after")),
    }).select(*visuals.columns)

    links = relinked.groupBy("doc_id", "object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "block_id"))), lambda x: x["block_id"]).alias("relinked_ids"))
    moved = reparented.join(removed.select("doc_id", F.col("section_id").alias("parent_id"), "object_id"), ["doc_id", "parent_id"])
    moved = moved.groupBy("doc_id", "object_id").agg(F.sort_array(F.collect_list("section_id")).alias("reparented_ids"))
    none = F.array().cast("array<string>")
    report = merges.join(links, ["doc_id", "object_id"], "left").join(moved, ["doc_id", "object_id"], "left").select(
        "doc_id", "page", "object_id", F.array("other_id", "object_id").alias("merged_ids"), "header_ids",
        F.coalesce("relinked_ids", none).alias("relinked_ids"), F.coalesce("reparented_ids", none).alias("reparented_ids"),
    )
    return Merged(pictures, out, tree, report, unresolved, dangling)
