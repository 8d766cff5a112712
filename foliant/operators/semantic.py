"""Assembly of semantic documents (JN01-JN06, JN32-JN33, AG06-AG07, WN20, SET05-SET06, SRT01-SRT03, SRT08, TR13, FLT01,
FLT09-FLT10, RM42)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import canonical_reference, is_blank, join_source_parts, squeeze
from . import graph

TRANSLATABLE = ["abstract", "paragraph", "list_item", "footnote"]
FRONT = ["title", "author", "affiliation", "metadata"]


def translatable(kind: Column, text: Column) -> Column:
    """FLT01."""
    return kind.isin("heading", "paragraph") & ~is_blank(text)


def with_blocks(assignments: DataFrame, blocks: DataFrame) -> DataFrame:
    """JN01: assignments with their raw blocks."""
    own = [c for c in blocks.columns if c not in assignments.columns]
    return assignments.join(blocks.select("doc_id", "block_id", *[c for c in own if c not in ("doc_id", "block_id")]), ["doc_id", "block_id"])


def partition_role(role: Column, hidden: Column, has_text: Column) -> Column:
    """FLT10: hidden, front, heading, body or other."""
    return (
        F.when(hidden, "hidden").when(role.isin(FRONT), "front").when((role == "heading") & has_text, "heading")
        .when(role.isin([*TRANSLATABLE, "reference"]), "body").otherwise("other")
    )


def units_of_groups(blocks: DataFrame) -> DataFrame:
    """AG06: a unit a paragraph: ordered text, ordered distinct arrays, least confidence, first and last position."""
    row = F.struct("position", "text", "block_id", "page", "citations", "object_references", "confidence", "role", "section_id", "reference_label")
    g = blocks.groupBy("doc_id", "paragraph_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    each = lambda c: F.transform("r", lambda x: x[c])
    flat = lambda c: F.array_distinct(F.flatten(each(c)))
    first = F.get("r", F.lit(0))
    return g.select(
        "doc_id", F.col("paragraph_id").alias("unit_id"), first["role"].alias("kind"), first["section_id"].alias("section_id"),
        join_source_parts(each("text")).alias("original"), each("block_id").alias("source_block_ids"),
        F.array_distinct(each("page")).alias("pages"), flat("citations").alias("citations"),
        flat("object_references").alias("object_references"), F.array_min(each("confidence")).alias("confidence"),
        F.array_min(each("position")).alias("position"), F.array_max(each("position")).alias("end_position"),
        first["reference_label"].alias("reference_label"),
    )


def front_matter(blocks: DataFrame) -> DataFrame:
    """AG07: the texts of each front role in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])
    return blocks.where(F.col("role").isin(FRONT)).groupBy("doc_id", "role").agg(texts.alias("texts"))


def sections_with_titles(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """JN02: section, its title's block, the title without its number."""
    t = blocks.select("doc_id", F.col("block_id").alias("title_block_id"), F.col("text").alias("source_heading"), "page", "reading_order")
    title = squeeze(F.regexp_replace("source_heading", r"^\s*(?:\d+(?:\.\d+)*|[A-Z](?:\.\d+)*)[.)]?\s+", ""))
    return sections.join(t, ["doc_id", "title_block_id"]).withColumn("title", title)


def place_units(units: DataFrame, sections: DataFrame, fallback: str = "sec-unassigned") -> DataFrame:
    """JN03: units of an unknown section go to one synthetic section."""
    known = sections.select("doc_id", "section_id", F.lit(True).alias("__k")).distinct()
    return units.join(known, ["doc_id", "section_id"], "left").withColumn(
        "section_id", F.when(F.col("__k"), F.col("section_id")).otherwise(fallback)
    ).drop("__k")


def captions_of_visuals(visuals: DataFrame, blocks: DataFrame) -> DataFrame:
    """JN04: the text of a visual's caption blocks, in their order."""
    ids = visuals.select("doc_id", "object_id", F.posexplode("caption_block_ids").alias("k", "block_id"))
    rows = ids.join(blocks.select("doc_id", "block_id", "text"), ["doc_id", "block_id"])
    text = join_source_parts(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]))
    found = rows.groupBy("doc_id", "object_id").agg(text.alias("caption"))
    return visuals.join(found, ["doc_id", "object_id"], "left").fillna({"caption": ""})


def anchor_of_visuals(visuals: DataFrame, blocks: DataFrame, units: DataFrame) -> DataFrame:
    """JN05: the unit of the block a visual follows, else the last unit before the visual."""
    of_block = units.select("doc_id", F.col("unit_id").alias("anchor_unit_id"), F.explode("source_block_ids").alias("insert_after_block_id"))
    direct = visuals.join(of_block, ["doc_id", "insert_after_block_id"], "left")
    at = blocks.select("doc_id", F.col("block_id").alias("insert_after_block_id"), F.col("position").alias("__at"))
    u = units.select("doc_id", F.col("unit_id").alias("__u"), F.col("end_position").alias("__e"))
    near = direct.join(at, ["doc_id", "insert_after_block_id"], "left").join(u, "doc_id", "left").where("__e <= __at or __at is null or __e is null")
    best = near.groupBy("doc_id", "object_id").agg(F.max_by("__u", F.struct("__e", "__u")).alias("__before"))
    return direct.join(best, ["doc_id", "object_id"], "left").withColumn("anchor_unit_id", F.coalesce("anchor_unit_id", "__before")).drop("__before")


_VERBS = "shows?|presents?|summari[sz]es?|reports?|lists?|provides?|compares?|contains?|details?|illustrates?|depicts?|outlines?"
_DONE = "shown|presented|summari[sz]ed|reported|listed|provided|compared|illustrated|depicted"


def introduction_score(text: Column, label: Column) -> Column:
    """JN06: how a text introduces a visual: 5 outlined in, 4 as subject, 3 shown in, 2 as shown in, 1 a mention."""
    t, canonical = squeeze(text), canonical_reference(label)
    kind, number = F.regexp_extract(canonical, r"^(\w+) (.+)$", 1), F.regexp_extract(canonical, r"^(\w+) (.+)$", 2)
    word = F.when(kind == "figure", r"(?:Figure|Fig\.)").when(kind == "table", "Table").when(kind == "algorithm", "Algorithm").otherwise(r"(?:Equation|Eq\.)")
    name = F.concat(F.lit(r"(?:appendix\s+)?"), word, F.lit(r"\s*\(?\Q"), number, F.lit(r"\E\)?"))
    hit = lambda before, after: F.regexp_like(t, F.concat(F.lit("(?i)" + before), name, F.lit(after)))
    return (
        F.when((t == "") | (kind == ""), 0).when(hit(r"(?:^|[.!?]\s+)", rf"\s+(?:{_VERBS})\b"), 4)
        .when(hit(r"\b(?:outlined|detailed)\s+(?:directly\s+)?(?:in|by)\s+", r"\b"), 5)
        .when(hit(rf"\b(?:{_DONE})\s+(?:directly\s+)?(?:in|by)\s+", r"\b"), 3)
        .when(hit(r"\b(?:as\s+)?(?:shown|seen|reported|listed|depicted)\s+in\s+", r"\b"), 2).otherwise(1)
    )


def reference_anchors(visuals: DataFrame, units: DataFrame) -> DataFrame:
    """JN06: the unit that introduces each visual (doc_id, object_id, label, position, page).

    Candidates mention the label.  A score of 5 excludes the others; only the closest page counts, up to two
    pages away (further only for a strong introduction that precedes); then the latest mention before the
    visual wins unless the first one after it is more than four positions closer, in which case the last of the
    cluster within three positions of that first one does.
    """
    mentions = units.where(F.col("kind").isin(TRANSLATABLE)).select(
        "doc_id", "unit_id", "original", "pages", "end_position", F.explode(F.array_distinct(F.transform("object_references", canonical_reference))).alias("name")
    )
    v = visuals.withColumn("name", canonical_reference(F.col("label")))
    c = v.join(mentions, ["doc_id", "name"])
    one = W.partitionBy("doc_id", "object_id")
    c = c.withColumn("score", introduction_score(F.col("original"), F.col("label")))
    c = c.withColumn("best", F.max("score").over(one)).where("best < 5 or score = best")
    c = c.withColumn("far", F.coalesce(F.array_min(F.transform("pages", lambda p: F.abs(p - F.col("page")))), F.lit(10**9)))
    c = c.withColumn("near", F.min("far").over(one)).where("far = near").withColumn("before", F.col("end_position") < F.col("position"))
    some_before = F.max("before").over(one)
    fine = F.col("page").isNull() | (F.col("near") < 2) | ((F.col("near") == 2) & F.col("any")) | ((F.col("near") > 2) & (F.col("best") >= 4) & F.col("any"))
    c = c.withColumn("any", some_before).where(fine)
    defining = F.col("name").startswith("figure ") & ~F.col("any") & (F.max(F.when(~F.col("before"), F.col("score"))).over(one) >= 4)
    c = c.withColumn("defining", defining).where("before or not defining or score >= 4")
    first_after = F.min(F.when(~F.col("before"), F.col("end_position"))).over(one)
    last_before = F.max(F.when(F.col("before"), F.col("end_position"))).over(one)
    c = c.withColumns({"first_after": first_after, "last_before": last_before})
    prefers_before = F.col("last_before").isNotNull() & (
        F.col("first_after").isNull() | (F.col("position") - F.col("last_before") <= F.col("first_after") - F.col("position") + 4.0)
    )
    pick = F.when(prefers_before, F.col("before") & (F.col("end_position") == F.col("last_before"))).otherwise(
        ~F.col("before") & (F.col("end_position") <= F.col("first_after") + 3.0)
    )
    return c.where(pick).groupBy("doc_id", "object_id").agg(F.max_by("unit_id", F.struct("end_position", "unit_id")).alias("anchor_unit_id"))


def content_order(units: DataFrame, visuals: DataFrame) -> DataFrame:
    """SRT01, SET06: units and visuals of a document in one numbered sequence; a visual comes first at a tie."""
    u = units.select("doc_id", F.lit("unit").alias("type"), F.col("unit_id").alias("id"), "position", F.lit(None).cast("int").alias("page"), F.lit(None).cast("double").alias("top"))
    v = visuals.select("doc_id", F.lit("visual").alias("type"), F.col("object_id").alias("id"), "position", "page", F.col("bbox_norm.y0").alias("top"))
    w = W.partitionBy("doc_id").orderBy(F.col("position").asc_nulls_last(), F.when(F.col("type") == "visual", 0).otherwise(1), "page", "top", "id")
    return u.unionByName(v).withColumn("ordinal", F.row_number().over(w))


def legacy_order(items: DataFrame) -> DataFrame:
    """SRT03."""
    return items.withColumn("ordinal", F.row_number().over(W.partitionBy("doc_id").orderBy("page", "order", "item_id", "index")))


def translatable_units(documents: DataFrame, sections: DataFrame, units: DataFrame) -> DataFrame:
    """FLT09: title, section titles and body units in order."""
    t = documents.select("doc_id", F.lit("title").alias("unit_id"), F.col("title").alias("original"), F.lit(-1.0).alias("position"))
    s = sections.select("doc_id", "section_id", "title", "position").select(
        "doc_id", F.col("section_id").alias("unit_id"), F.col("title").alias("original"), F.col("position").cast("double").alias("position")
    )
    u = units.where(F.col("kind").isin(TRANSLATABLE)).select("doc_id", "unit_id", "original", F.col("position").cast("double").alias("position"))
    return t.unionByName(s).unionByName(u).where(~is_blank(F.col("original")))


def descendants(sections: DataFrame) -> DataFrame:
    """TR13: (doc_id, ancestor, section_id) pairs, transitive to any depth and safe against cycles."""
    return graph.ancestors(sections.select("doc_id", "section_id", "parent_section_id"), "section_id", "parent_section_id")


def override_pages(base: DataFrame, reviewed: DataFrame, key: list[str]) -> DataFrame:
    """JN32: reviewed pages replace the baseline's rows whole."""
    pages = reviewed.select("doc_id", "page").distinct()
    return base.join(pages, ["doc_id", "page"], "left_anti").unionByName(reviewed, allowMissingColumns=True)


def override_sections(base: DataFrame, reviewed: DataFrame) -> DataFrame:
    """JN32, SRT08: reviewed sections replace those with their id; ordered by the place of their title."""
    kept = base.join(reviewed.select("doc_id", "section_id"), ["doc_id", "section_id"], "left_anti")
    w = W.partitionBy("doc_id").orderBy("page_start", "reading_order")
    return kept.unionByName(reviewed, allowMissingColumns=True).withColumn("ordinal", F.row_number().over(w))


def reanchor(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """WN20: rows whose anchor was suppressed move to the nearest surviving ancestor, null where there is none.

    An anchor without a row in ``parents`` stays.
    """
    to = graph.surviving(parents.select("doc_id", "block_id", "parent_id", "survives"))
    to = to.select("doc_id", F.col("block_id").alias("anchor"), F.col("anchor").alias("__to"), F.lit(True).alias("__known"))
    out = rows.join(to, ["doc_id", "anchor"], "left")
    return out.withColumn("anchor", F.when(F.col("__known"), F.col("__to")).otherwise(F.col("anchor"))).drop("__to", "__known")


def is_references_section(title: Column, heading: Column) -> Column:
    """RM42."""
    p = r"(?i)^\s*(?:\d+[.)]?\s*)?references\s*$"
    return F.coalesce(title.rlike(p), F.lit(False)) | F.coalesce(heading.rlike(p), F.lit(False))


def mention_links(units: DataFrame, targets: DataFrame) -> DataFrame:
    """JN33: citations and object mentions with the anchor of their target, longest labels first."""
    m = units.select("doc_id", "unit_id", F.posexplode(F.array_distinct(F.concat("citations", F.transform("object_references", canonical_reference)))).alias("k", "mention"))
    n = m.withColumn("label", F.lower(F.regexp_replace("mention", r"^\[|\]$", "")))
    t = targets.select("doc_id", F.lower("label").alias("label"), "anchor")
    return n.join(t, ["doc_id", "label"], "left").withColumn("rank", F.row_number().over(
        W.partitionBy("doc_id", "unit_id").orderBy(F.desc(F.length("mention")), "k")
    ))
