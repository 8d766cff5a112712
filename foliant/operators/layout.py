"""Page layout: fonts, furniture, roles, sections, paragraphs, visuals (AG01-AG05, AG18, WN03-WN14, JN12-JN19, FLT11-FLT14,
SRT04-SRT05, SRT09, RM18, RM21-RM23, RM26-RM29, RP01-RP11, RP17-RP18).

All joins are within a page, so they are keyed by document and page and carry their geometric test as a
further condition.  Greedy or dynamic-programming matches work on one page's handful of rows in a grouped
function; their score matrices are native.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import MATH_FONTS, canonical_furniture, caption_match, citations, heading
from ..functions.text import looks_like_equation, object_references, reference_label, section_slug, squeeze

# What starts a caption, ends a numbered equation, and marks mathematics.
CAPTION_START = r"(?i)^(?:Figure|Fig\.|Table|Algorithm)\s+[A-Z0-9]+[.:]"
EQUATION_NUMBER = r"\([0-9]{1,3}\)\s*$"
MATH_MARKS = r"(?U)[=∑∏√∞≤≥≈∈∉⊂⊆→←↔α-ωΑ-Ω]|\b(?:arg|min|max|log|exp|softmax)\b"

TEXT_ROLES = ["paragraph", "list_item", "caption", "reference"]


def body_font(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """AG01: the half-point font size with most characters (500 a block at most); 10 where there is none."""
    half = F.round(F.col("font_max") * 2) / 2
    sizes = blocks.where("font_max > 0").groupBy(by, half.alias("size")).agg(F.sum(F.least(F.length("text"), F.lit(500))).alias("w"))
    best = sizes.groupBy(by).agg(F.max_by("size", F.struct("w", -F.col("size"))).alias("body_font"))
    docs = blocks.select(by).distinct()
    return docs.join(best, by, "left").withColumn("body_font", F.coalesce("body_font", F.lit(10.0)))


def upper_median(values: Column, default: float = 10.0) -> Column:
    """AG03: aggregate, the upper middle element."""
    a = F.array_sort(F.collect_list(values))
    return F.coalesce(F.get(a, (F.size(a) / 2).cast("int")), F.lit(default))


def repeated_furniture(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """AG02: (doc_id, furniture) of lines in the top 7.5 % or bottom 5.5 % of enough pages."""
    band = (F.col("bbox_norm.y0") <= 0.075) | (F.col("bbox_norm.y1") >= 0.945)
    text = blocks.where(band).select("doc_id", "page", canonical_furniture(F.col("text")).alias("furniture")).where("furniture <> ''")
    counts = text.groupBy("doc_id", "furniture").agg(F.countDistinct("page").alias("n"))
    least = pages.groupBy("doc_id").agg(F.greatest(F.lit(2), F.ceil(F.count("*") * 0.12)).alias("least"))
    return counts.join(least, "doc_id").where("n >= least").select("doc_id", "furniture")


def font_evidence(spans: DataFrame, by: list[str]) -> DataFrame:
    """AG04: sizes, the first six fonts, bold, italic and the share of characters in math fonts."""
    n = F.length("text")
    fonts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "font"))), lambda s: s["font"])
    math = F.sum(F.when(F.col("font").rlike(MATH_FONTS), n).otherwise(0)) / F.greatest(F.sum(n), F.lit(1))
    return spans.groupBy(*by).agg(
        F.min("size").alias("font_min"), F.max("size").alias("font_max"), F.slice(F.array_distinct(fonts), 1, 6).alias("fonts"),
        F.bool_or("bold").alias("bold"), F.bool_or("italic").alias("italic"), F.bround(math, 4).alias("math_ratio"),
    )


def line_ratios(spans: DataFrame, by: list[str]) -> DataFrame:
    """AG05, RM21: shares of a line's characters that are bold and that are in math fonts."""
    n = F.length(F.trim("text"))
    share = lambda test: F.coalesce(F.sum(F.when(test, n).otherwise(0)) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0))
    return spans.groupBy(*by).agg(
        share(F.col("bold")).alias("bold_ratio"), share(F.col("font").rlike(MATH_FONTS)).alias("math_ratio"), F.max("size").alias("size")
    )


def block_text(spans: DataFrame, by: list[str]) -> DataFrame:
    """RM26: joined spans with the largest size."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), "")
    return spans.groupBy(*by).agg(squeeze(joined).alias("text"), F.max("size").alias("font_max"), F.bool_or("bold").alias("bold"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """WN03, SRT04: numbers blocks from 1 on each page: spanning ones, the left column, the right column."""
    key = G.reading_key(F.col("bbox"), F.col("page_width"))
    w = W.partitionBy("doc_id", "page").orderBy(key["column"], key["y"], key["x"], "block_id")
    return blocks.withColumn("reading_order", F.row_number().over(w))


def global_position(assignments: DataFrame) -> DataFrame:
    """WN04."""
    w = W.partitionBy("doc_id").orderBy("page", "reading_order", "block_id")
    return assignments.withColumn("position", F.row_number().over(w))


def drop_margins(blocks: DataFrame, top: float = 34.0, bottom: float = 28.0) -> DataFrame:
    """FLT12."""
    return blocks.where((F.col("bbox.y0") >= top) & (F.col("bbox.y1") <= F.col("page_height") - bottom))


def classify(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The roles of blocks: furniture, caption, heading, equation, reference, list item, paragraph (FN17-FN19, AG02)."""
    furniture = repeated_furniture(blocks, pages).withColumn("__f", F.lit(True))
    b = blocks.join(body_font(blocks), "doc_id").withColumn("furniture", canonical_furniture(F.col("text")))
    b = b.join(furniture, ["doc_id", "furniture"], "left")
    text, box = F.col("text"), F.col("bbox_norm")
    band = (box["y0"] <= 0.075) | (box["y1"] >= 0.945)
    b = b.withColumns({
        "__h": heading(text, F.col("font_max"), F.col("bold"), F.col("body_font")),
        "__c": caption_match(text, F.col("font_max"), F.col("body_font")),
        "hidden": band & (F.coalesce("__f", F.lit(False)) | F.trim(text).rlike(r"(?i)^(?:page\s+)?\d{1,4}$")),
    })
    equation = looks_like_equation(text, box, F.col("font_max"), F.col("body_font"), F.col("fonts"), F.col("math_ratio"))
    role = (
        F.when(F.col("hidden"), "furniture").when(F.col("__c").isNotNull(), "caption").when(F.col("__h").isNotNull(), "heading")
        .when(equation, "equation").when(text.rlike(r"(?i)^\s*(?:[•▪◦‣]|[-–—]|\([a-z0-9]+\)|[a-z0-9]+[.)])\s+"), "list_item")
        .otherwise("paragraph")
    )
    conf = F.when(F.col("hidden"), 0.99).when(F.col("__c").isNotNull(), 0.97).when(F.col("__h").isNotNull(), F.col("__h.confidence"))
    return b.withColumns({
        "role": role, "confidence": F.coalesce(conf, F.lit(0.9)), "number": F.col("__h.number"), "level": F.col("__h.level"),
        "caption_kind": F.col("__c.kind"), "caption_label": F.col("__c.label"), "citations": citations(text),
        "object_references": object_references(text), "reference_label": reference_label(text),
    }).drop("__h", "__c", "__f", "furniture", "body_font")


def carry_section(assignments: DataFrame, order: str = "position") -> DataFrame:
    """WN05, WN08: section ids from heading slugs, repeats numbered, carried to the blocks below."""
    is_head = F.col("role") == "heading"
    slugs = assignments.withColumn("__slug", F.when(is_head, section_slug(F.col("number"), F.col("text"))))
    w = W.partitionBy("doc_id", "__slug").orderBy(order)
    k = F.row_number().over(w)
    made = F.when(is_head, F.when(k == 1, F.col("__slug")).otherwise(F.concat("__slug", F.lit("-"), k)))
    out = slugs.withColumn("__own", made).drop("__slug")
    w = W.partitionBy("doc_id").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return out.withColumn("section_id", F.last("__own", ignorenulls=True).over(w)).drop("__own")


def section_parents(sections: DataFrame, order: str = "position") -> DataFrame:
    """WN06: the nearest earlier section of a lower level; references never parent later sections."""
    s = sections.select(F.col("doc_id").alias("__d"), F.col(order).alias("__at"), F.col("section_id").alias("__id"), F.col("level").alias("__l"), F.col("title").alias("__t"))
    s = s.where(~F.lower(F.trim("__t")).rlike(r"^(?:\d+[.)]?\s*)?(?:references|bibliography)$"))
    pairs = sections.join(s, (sections["doc_id"] == s["__d"]) & (s["__at"] < sections[order]) & (s["__l"] < sections["level"]), "left")
    return pairs.groupBy(*[sections[c] for c in sections.columns]).agg(F.max_by("__id", "__at").alias("parent_section_id"))


def parents_by_number(sections: DataFrame) -> DataFrame:
    """WN07: 1.2.3 below 1.2."""
    up = F.nullif(F.regexp_replace("number", r"\.?[^.]+$", ""), F.lit(""))
    s = sections.select("doc_id", F.col("number").alias("__n"), F.col("section_id").alias("parent_section_id")).where("__n is not null")
    s = s.dropDuplicates(["doc_id", "__n"])
    return sections.withColumn("__up", up).join(s.withColumnRenamed("__n", "__up"), ["doc_id", "__up"], "left").drop("__up")


def islands(rows: DataFrame, by: list[str], order: list[str], breaks: Column, out: str) -> DataFrame:
    """WN09-WN12: a running number that grows where ``breaks`` holds (null breaks: the first row)."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__b", F.coalesce(breaks.cast("int"), F.lit(1))).withColumn(
        out, F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")
    ).drop("__b")


def continue_paragraphs(body: DataFrame, order: str = "position") -> DataFrame:
    """WN09: a visible body block continues the paragraph before it when grammar and geometry agree.

    Grammar: it starts in lower case, or the earlier block does not end a sentence.  Geometry: the first body
    block of another page, or close below in the same column, or from the foot of the left column to the
    upper part of the right one.  A heading in between (another section) always breaks.
    """
    w = W.partitionBy("doc_id").orderBy(order)
    lag = lambda c: F.lag(c).over(w)
    x0, y0 = F.col("bbox_norm.x0"), F.col("bbox_norm.y0")
    grammar = F.col("text").rlike(r"^\s*\p{Ll}") | ~lag("text").rlike(r"[.!?;:)\]}”’]\s*$")
    first_of_page = F.row_number().over(W.partitionBy("doc_id", "page").orderBy(order)) == 1
    same_page = lag("page") == F.col("page")
    below = same_page & (F.abs(lag("bbox_norm.x0") - x0) < 0.03) & (lag("bbox_norm.y1") <= y0) & (y0 - lag("bbox_norm.y1") < 0.025)
    column = same_page & (lag("bbox_norm.x0") < 0.5) & (x0 >= 0.5) & (lag("bbox_norm.y1") >= 0.82) & (y0 <= 0.72)
    geometry = (~same_page & first_of_page) | below | column
    breaks = ~(grammar & geometry & lag("section_id").eqNullSafe(F.col("section_id")))
    return islands(body, ["doc_id"], [order], breaks, "paragraph")


def segment_lines(lines: DataFrame, by: list[str], order: str = "ordinal") -> DataFrame:
    """WN11, RM29: segments of a text block: equations, headings and paragraphs apart."""
    kind = (
        F.when((F.col("math_ratio") >= 0.58) & F.col("text").rlike(r"[=≈≤≥∑∏∫]"), "equation")
        .when((F.col("bold_ratio") >= 0.55) & F.col("text").rlike(r"^\s*(?:\d+(?:\.\d+)*|[A-Z])[.)]?\s+[A-Z]"), "heading").otherwise("text")
    )
    out = lines.withColumn("kind", kind)
    w = W.partitionBy(*by).orderBy(order)
    indent = (F.col("x0") - F.lag("x0").over(w)) > 8
    return islands(out, by, [order], (F.lag("kind").over(w) != F.col("kind")) | (F.col("kind") == "heading") | indent, "segment")


def group_equations(blocks: DataFrame, gap: float = 0.018) -> DataFrame:
    """WN12: a new group where the distance to the lowest edge so far exceeds the gap."""
    w = W.partitionBy("doc_id", "page").orderBy("bbox_norm.y0", "block_id")
    low = F.max("bbox_norm.y1").over(w.rowsBetween(W.unboundedPreceding, -1))
    return islands(blocks, ["doc_id", "page"], ["bbox_norm.y0", "block_id"], F.col("bbox_norm.y0") - low > gap, "equation_group")


def nearest_previous(rows: DataFrame, by: list[str], order: str, value: str, keep: Column, out: str) -> DataFrame:
    """WN13: the last value before each row among those that ``keep``."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(F.when(keep, F.col(value)), ignorenulls=True).over(w))


def line_groups(lines: DataFrame, by: list[str]) -> DataFrame:
    """WN14: lines that share a level form a row, ordered left to right."""
    w = W.partitionBy(*by).orderBy("bbox_norm.y0", "bbox_norm.x0")
    out = islands(lines, by, ["bbox_norm.y0", "bbox_norm.x0"],
                  F.col("bbox_norm.y0") > F.max((F.col("bbox_norm.y0") + F.col("bbox_norm.y1")) / 2).over(w.rowsBetween(W.unboundedPreceding, -1)), "row")
    return out.withColumn("place", F.row_number().over(W.partitionBy(*by, "row").orderBy("bbox_norm.x0")))


def previous_context(assignments: DataFrame, k: int = 8) -> DataFrame:
    """WN16: for each page, the last ``k`` assignments before it."""
    pages = assignments.select("doc_id", F.col("page").alias("for_page")).distinct()
    a = assignments.join(pages, "doc_id").where("page < for_page")
    w = W.partitionBy("doc_id", "for_page").orderBy(F.desc("page"), F.desc("reading_order"))
    return a.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def page_confidence(assignments: DataFrame, visuals: DataFrame, unresolved: DataFrame) -> DataFrame:
    """AG18: least confidence of visible blocks and visuals, 0 with an unresolved visual, 1 for an empty page."""
    rows = (
        assignments.select("doc_id", "page", F.when(~F.col("hidden"), F.col("confidence")).alias("c"))
        .unionByName(visuals.select("doc_id", "page", F.col("confidence").alias("c")))
        .unionByName(unresolved.select("doc_id", "page", F.lit(0.0).alias("c")))
    )
    return rows.groupBy("doc_id", "page").agg(F.coalesce(F.min("c"), F.lit(1.0)).alias("confidence"))


def review_pages(pages: DataFrame, threshold: float, most: int | None = None, explicit: list[int] | None = None) -> DataFrame:
    """FLT14: the named pages that exist, else those under the threshold; the first ``most`` of each document."""
    keep = pages.where(F.col("page").isin(explicit)) if explicit else pages.where(F.col("confidence") < threshold)
    if most is None:
        return keep
    return keep.withColumn("__n", F.row_number().over(W.partitionBy("doc_id").orderBy("page"))).where(F.col("__n") <= most).drop("__n")


# --------------------------------------------------------------------------- visuals


def region_candidates(regions: DataFrame) -> DataFrame:
    """FLT11: at least 0.8 % of the page and 45 x 30 points; without a caption at least 7 %."""
    box, page = F.col("bbox"), F.col("page_width") * F.col("page_height")
    share = G.area(box) / page
    large = (share >= 0.008) & (box["x1"] - box["x0"] >= 45) & (box["y1"] - box["y0"] >= 30)
    return regions.where(large & (F.col("captioned") | (share >= 0.07)))


def visual_candidates(drawings: DataFrame, images: DataFrame) -> DataFrame:
    """FLT13: drawings of 0.1 % of the page; images of 0.8 % that no drawing covers by 80 %."""
    d = drawings.where(G.area(F.col("bbox_norm")) >= 0.001)
    i = images.where(G.area(F.col("bbox_norm")) >= 0.008)
    over = d.select(F.col("doc_id").alias("__doc"), F.col("page").alias("__page"), F.col("bbox_norm").alias("__d"))
    test = (i["doc_id"] == over["__doc"]) & (i["page"] == over["__page"]) & (G.overlap_ratio(i["bbox_norm"], over["__d"]) >= 0.8)
    return d.unionByName(i.join(over, test, "left_anti"), allowMissingColumns=True)


def spatial_join(left: DataFrame, right: DataFrame, test, how: str = "inner") -> DataFrame:
    """JN13, JN15, JN17, JN36: rows of one page joined by a test on their rectangles; right columns get ``r_``."""
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    on = (left["doc_id"] == r["r_doc_id"]) & (left["page"] == r["r_page"]) & test(left["bbox_norm"], r["r_bbox_norm"])
    return left.join(r, on, how)


def nearest_caption(regions: DataFrame, captions: DataFrame, most: float = 95.0, table: float = 70.0) -> DataFrame:
    """JN12: the vertically nearest caption that shares a quarter of the width."""
    c = captions.select("doc_id", "page", F.col("block_id").alias("caption_id"), F.col("bbox").alias("__c"))
    a, b = F.col("bbox"), F.col("__c")
    shared = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    far = G.vertical_distance(a, b)
    limit = F.when(F.col("kind") == "table", table).otherwise(most)
    near = regions.join(c, ["doc_id", "page"]).withColumn("__far", far).where(
        (shared >= 0.25 * F.least(a["x1"] - a["x0"], b["x1"] - b["x0"])) & (F.col("__far") <= limit)
    )
    best = near.groupBy("doc_id", "page", "region_id").agg(F.min_by("caption_id", F.struct("__far", "caption_id")).alias("caption_id"))
    return regions.join(best, ["doc_id", "page", "region_id"], "left")


def caption_scores(captions: DataFrame, candidates: DataFrame) -> DataFrame:
    """JN14, GEO04: score of every caption and candidate of a page, rejected pairs left out."""
    c = candidates.select("doc_id", "page", "candidate_id", F.col("bbox_norm").alias("__v"))
    pairs = captions.join(c, ["doc_id", "page"])
    return pairs.withColumn("score", G.caption_score(F.col("caption_kind"), F.col("bbox_norm"), F.col("__v"))).where("score >= 0").drop("__v")


def match_greedily(scores: DataFrame) -> DataFrame:
    """JN14: captions in reading order each take the best candidate left on their page."""

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        out = []
        for _, own in rows.sort_values(["reading_order", "block_id"], kind="stable").groupby("block_id", sort=False):
            left = own[~own["candidate_id"].isin(used)]
            if len(left):
                best = left.sort_values(["score", "candidate_id"], ascending=[False, True], kind="stable").iloc[0]
                used.add(best["candidate_id"])
                out.append(best[["doc_id", "page", "block_id", "candidate_id", "score"]])
        return pd.DataFrame(out, columns=["doc_id", "page", "block_id", "candidate_id", "score"])

    slim = scores.select("doc_id", "page", "block_id", "reading_order", "candidate_id", "score")
    schema = "doc_id string, page int, block_id string, candidate_id string, score double"
    return slim.groupBy("doc_id", "page").applyInPandas(page, schema)


def align_in_order(scores: DataFrame) -> DataFrame:
    """JN16: the assignment of captions to visuals of a page and kind that keeps both orders and has the
    largest number of pairs, then the largest sum of scores."""

    def align(rows: pd.DataFrame) -> pd.DataFrame:
        caps = list(rows.sort_values("caption_order")["block_id"].drop_duplicates())
        vis = list(rows.sort_values("visual_order")["candidate_id"].drop_duplicates())
        score = {(r.block_id, r.candidate_id): r.score for r in rows.itertuples()}
        best = [[(0, 0.0)] * (len(vis) + 1) for _ in range(len(caps) + 1)]
        for i, c in enumerate(caps):
            for j, v in enumerate(vis):
                take = (best[i][j][0] + 1, best[i][j][1] + score[c, v]) if (c, v) in score else (-1, 0.0)
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], take)
        out, i, j = [], len(caps), len(vis)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((rows["doc_id"].iloc[0], rows["page"].iloc[0], caps[i], vis[j], score[caps[i], vis[j]]))
        return pd.DataFrame(out, columns=["doc_id", "page", "block_id", "candidate_id", "score"])

    slim = scores.select("doc_id", "page", "caption_kind", "block_id", "caption_order", "candidate_id", "visual_order", "score")
    schema = "doc_id string, page int, block_id string, candidate_id string, score double"
    return slim.groupBy("doc_id", "page", "caption_kind").applyInPandas(align, schema)


def merge_regions(regions: DataFrame, least: float = 0.75) -> DataFrame:
    """RM27: regions of a page that cover each other by 75 % become one; a table stays a table, the first caption too."""
    captions = ["caption"] if "caption" in regions.columns else []

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for r in rows.sort_values(["y0", "x0", "region_id"]).to_dict("records"):
            for k in kept:
                w = min(k["x1"], r["x1"]) - max(k["x0"], r["x0"])
                h = min(k["y1"], r["y1"]) - max(k["y0"], r["y0"])
                both = max(0.0, w) * max(0.0, h)
                size = lambda q: max(1e-9, (q["x1"] - q["x0"]) * (q["y1"] - q["y0"]))
                if both / size(k) > least or both / size(r) > least:
                    k.update(x0=min(k["x0"], r["x0"]), y0=min(k["y0"], r["y0"]), x1=max(k["x1"], r["x1"]), y1=max(k["y1"], r["y1"]))
                    k["kind"] = "table" if "table" in (k["kind"], r["kind"]) else k["kind"]
                    if captions:
                        k["caption"] = k["caption"] or r["caption"]
                    break
            else:
                kept.append(r)
        return pd.DataFrame(kept, columns=list(rows.columns))

    slim = regions.select("doc_id", "page", "region_id", "kind", *[F.col(f"bbox.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")], *captions)
    return slim.groupBy("doc_id", "page").applyInPandas(page, slim.schema)


def detect_regions(pages: DataFrame, tables: DataFrame, graphics: DataFrame, blocks: DataFrame) -> DataFrame:
    """RM28: (doc_id, page, region_id, kind, bbox, caption) of tables, figures, equations and captions without a visual.

    pages: doc_id, page, page_width, page_height; tables and graphics: doc_id, page, region_id, bbox; blocks:
    doc_id, page, block_id, bbox, text.  A region takes in its nearest caption; one of a caption alone reaches
    up its column to the text above.
    """
    key = ["doc_id", "page"]
    size = pages.select(*key, F.col("page_width").cast("double"), F.col("page_height").cast("double"))
    captions = blocks.where(F.col("text").rlike(CAPTION_START))
    named = lambda df, of, kind: df.select(
        *key, F.concat(F.lit(kind[0]), F.lit(":"), F.col(of).cast("string")).alias("region_id"), F.lit(kind).alias("kind"), "bbox"
    )
    seen = nearest_caption(named(tables, "region_id", "table").unionByName(named(graphics, "region_id", "figure")), captions)
    seen = seen.join(captions.select(
        *key, F.col("block_id").alias("caption_id"), F.col("bbox").alias("__c"), F.col("text").alias("caption")
    ), [*key, "caption_id"], "left").join(size, key).withColumn("captioned", F.col("caption").isNotNull())
    seen = seen.where("kind = 'table'").unionByName(region_candidates(seen.where("kind = 'figure'")))
    box, c = F.col("bbox"), F.col("__c")  # least and greatest skip a missing caption
    hull = G.rect(F.least(box["x0"], c["x0"]), F.least(box["y0"], c["y0"]), F.greatest(box["x1"], c["x1"]), F.greatest(box["y1"], c["y1"]))
    slim = lambda df, pad, rect: df.select(
        *key, "region_id", "kind", G.padded(rect, pad, F.col("page_width"), F.col("page_height")).alias("bbox"), "caption"
    )

    text, width = F.col("text"), F.col("page_width")
    compact = (box["y1"] - box["y0"] < 125) & (box["x0"] > width * 0.16) & (box["x1"] < width * 0.84) & (F.length(text) < 220)
    formula = (text.rlike(EQUATION_NUMBER) & text.contains("=")) | (compact & text.rlike(MATH_MARKS))
    equations = blocks.join(size, key).where(formula).withColumns({
        "region_id": F.concat(F.lit("e:"), F.col("block_id").cast("string")), "kind": F.lit("equation"), "caption": text,
    })
    found = slim(seen, 7, hull).unionByName(slim(equations, 8, box))

    alone = captions.join(found.select(*key, F.col("caption").alias("text")), [*key, "text"], "left_anti").join(size, key)
    wide = ((box["x0"] < width * 0.45) & (box["x1"] > width * 0.55)) | (box["x1"] - box["x0"] > width * 0.58)
    left = ~wide & (box["x0"] < width / 2)
    alone = alone.withColumns({
        "__l": F.when(wide | left, F.lit(34.0)).otherwise(width / 2 + 10),
        "__r": F.when(left, width / 2 - 10).otherwise(width - 34),
    })
    above = blocks.where(~text.rlike(CAPTION_START)).select(*key, F.col("bbox").alias("__b"))
    b = F.col("__b")
    shared = F.least(b["x1"], F.col("__r")) - F.greatest(b["x0"], F.col("__l"))
    fits = (b["y1"] <= box["y0"]) & (shared >= 0.35 * F.least(b["x1"] - b["x0"], F.col("__r") - F.col("__l")))
    last = alone.join(above, key).where(fits).groupBy(*key, "block_id").agg(F.max("__b.y1").alias("__last"))
    alone = alone.join(last, [*key, "block_id"], "left")
    top = F.greatest(F.lit(36.0), box["y0"] - 270, F.coalesce(F.col("__last"), box["y0"] - 190) + 3)
    top = F.when(box["y1"] - top < 72, F.greatest(F.lit(36.0), box["y0"] - 150)).otherwise(top)
    alone = alone.withColumns({
        "region_id": F.concat(F.lit("c:"), F.col("block_id").cast("string")), "caption": text,
        "kind": F.when(text.rlike("(?i)^(?:table|algorithm)"), "table").otherwise("figure"),
    })
    found = found.unionByName(slim(alone, 5, G.rect(F.col("__l"), top, F.col("__r"), box["y1"])))
    return merge_regions(found).select(*key, "region_id", "kind", G.rect(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("bbox"), "caption")


def fallback_visual(captions: DataFrame, blocks: DataFrame) -> DataFrame:
    """RM18: where no visual is known, the union of two or more small-font blocks on the nearer side of the caption."""
    b = blocks.select("doc_id", "page", F.col("bbox_norm").alias("__b"), F.col("font_max").alias("__f"))
    near = captions.join(b, ["doc_id", "page"]).where(F.col("__f") <= F.col("body_font") * 0.96)
    above = F.col("__b.y1") <= F.col("bbox_norm.y0")
    side = F.when(above & (F.col("bbox_norm.y0") - F.col("__b.y1") < 0.35), "above").when(
        (F.col("__b.y0") >= F.col("bbox_norm.y1")) & (F.col("__b.y0") - F.col("bbox_norm.y1") < 0.22), "below"
    )
    rows = near.withColumn("side", side).where("side is not null")
    gap = F.min(F.least(F.abs(F.col("bbox_norm.y0") - F.col("__b.y1")), F.abs(F.col("__b.y0") - F.col("bbox_norm.y1"))))
    out = rows.groupBy("doc_id", "page", "block_id", "side").agg(F.count("*").alias("n"), G.union_rect(F.col("__b")).alias("rect"), gap.alias("gap"))
    return out.where("n >= 2").groupBy("doc_id", "page", "block_id").agg(F.min_by("rect", F.struct("gap", "side")).alias("rect"))


def best_region(blocks: DataFrame, regions: DataFrame, least: float = 0.12) -> DataFrame:
    """JN18: the region a block overlaps most; a centre inside adds 0.2."""
    pairs = spatial_join(blocks, regions, lambda a, b: G.intersection_area(a, b) > 0)
    score = G.overlap_ratio(F.col("bbox_norm"), F.col("r_bbox_norm")) + F.when(G.center_inside(F.col("bbox_norm"), F.col("r_bbox_norm")), 0.2).otherwise(0.0)
    return pairs.withColumn("score", score).where(F.col("score") >= least).groupBy("doc_id", "page", "block_id").agg(
        F.max_by("r_region_id", F.struct("score", "r_region_id")).alias("region_id")
    )


def links_on_blocks(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """JN19: (block_id, uri) where a block covers a quarter of a link's rectangle or more."""
    pairs = spatial_join(links, blocks, lambda a, b: G.overlap_ratio(a, b) >= 0.25)
    return pairs.groupBy("doc_id", "page", F.col("r_block_id").alias("block_id")).agg(F.sort_array(F.collect_set("uri")).alias("uris"))


def hyphen_compounds(blocks: DataFrame) -> DataFrame:
    """JN20, RP04: line-break hyphens whose compound is written with a hyphen elsewhere in the document."""
    broken = blocks.select("doc_id", "block_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+-)\s*\n\s*(\p{Ll}+)"), F.lit(0))).alias("raw"))
    broken = broken.withColumn("compound", F.lower(F.regexp_replace("raw", r"\s", "")))
    known = blocks.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+-\p{L}+"), F.lit(0))).alias("c"))
    known = known.select("doc_id", F.lower("c").alias("compound")).distinct()
    return broken.join(known, ["doc_id", "compound"], "left_semi")


def overlay_equations(blocks: DataFrame) -> DataFrame:
    """JN21, RP10: equation fragments that two or more others of the page overlap."""
    e = blocks.where("role = 'equation'")
    pairs = spatial_join(e, e, lambda a, b: (G.overlap_ratio(a, b) >= 0.55)).where("block_id <> r_block_id")
    return pairs.groupBy("doc_id", "page", "block_id").agg(F.count("*").alias("n")).where("n >= 2").drop("n")


def sign_before_equation(blocks: DataFrame, order: str = "reading_order") -> DataFrame:
    """JN22, RP09: an equation takes in a lone sign set on its level just before it."""
    w = W.partitionBy("doc_id", "page").orderBy(order)
    lone = F.lag("text").over(w).rlike(r"^\s*[-+±−=<>≤≥]\s*$")
    level = G.same_line(F.lag("bbox_norm").over(w), F.col("bbox_norm"))
    takes = (F.col("role") == "equation") & lone & level
    return blocks.withColumn("text", F.when(F.coalesce(takes, F.lit(False)), F.concat(F.trim(F.lag("text").over(w)), F.lit(" "), "text")).otherwise(F.col("text"))).withColumn(
        "absorbed_sign", F.coalesce(takes, F.lit(False))
    )


def block_above(equations: DataFrame, blocks: DataFrame) -> DataFrame:
    """JN23, RP11: the nearest block above an equation in its column."""
    pairs = spatial_join(equations, blocks, lambda a, b: (b["y1"] <= a["y0"] + 0.01) & (F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"])))
    return pairs.where("block_id <> r_block_id").groupBy("doc_id", "page", "block_id").agg(
        F.max_by("r_block_id", F.struct("r_bbox_norm.y1", "r_block_id")).alias("anchor_id")
    )


def panel_headings(headings: DataFrame, figures: DataFrame) -> DataFrame:
    """JN24, RP06: two or more headings along the top edge of one figure, each of one figure only."""
    near = spatial_join(headings, figures, lambda h, f: (F.abs(h["y1"] - f["y0"]) <= 0.03) & (h["x0"] >= f["x0"] - 0.02) & (h["x1"] <= f["x1"] + 0.02))
    one = W.partitionBy("doc_id", "page", "block_id")
    per = W.partitionBy("doc_id", "page", "r_object_id")
    return near.withColumn("__f", F.count("*").over(one)).where("__f = 1").withColumn("__h", F.count("*").over(per)).where("__h >= 2").select(
        "doc_id", "page", "block_id", F.col("r_object_id").alias("object_id")
    )


def split_panels(captioned: DataFrame, unlabeled: DataFrame) -> DataFrame:
    """JN25, RP13: an unlabeled neighbour that forms one row with exactly one captioned figure."""
    pairs = spatial_join(captioned, unlabeled, lambda a, b: G.side_by_side(a, b) | G.side_by_side(b, a))
    n = W.partitionBy("doc_id", "page", "r_object_id")
    m = W.partitionBy("doc_id", "page", "object_id")
    return pairs.withColumn("__n", F.count("*").over(n)).withColumn("__m", F.count("*").over(m)).where("__n = 1 and __m = 1").select(
        "doc_id", "page", "object_id", F.col("r_object_id").alias("merged_id"),
        G.rect(F.least("bbox_norm.x0", "r_bbox_norm.x0"), F.least("bbox_norm.y0", "r_bbox_norm.y0"),
               F.greatest("bbox_norm.x1", "r_bbox_norm.x1"), F.greatest("bbox_norm.y1", "r_bbox_norm.y1")).alias("bbox_norm"),
    )


def refine_captions(captions: DataFrame, lines: DataFrame) -> DataFrame:
    """JN26, RP16, RM22: the printed lines of a caption where exactly one line start has its label and place."""
    starts = spatial_join(captions, lines, lambda a, b: G.box_matches(a, b, 0.05) | (G.overlap_ratio(b, a) >= 0.88)).where(
        F.lower(F.regexp_extract("r_text", r"(?i)^\s*((?:Figure|Fig\.?|Table|Algorithm)\s*[\w.\-]+)", 1)) == F.lower("label")
    )
    n = W.partitionBy("doc_id", "page", "block_id")
    return starts.withColumn("__n", F.count("*").over(n)).where("__n = 1").select("doc_id", "page", "block_id", F.col("r_text").alias("text"))


# --------------------------------------------------------------------------- repair passes


def promote_title(blocks: DataFrame) -> DataFrame:
    """RP01: where page 1 has no title, the topmost centred heading above the front boundary becomes it."""
    has = blocks.groupBy("doc_id").agg(F.bool_or((F.col("page") == 1) & (F.col("role") == "title")).alias("__has"))
    centred = F.abs((F.col("bbox_norm.x0") + F.col("bbox_norm.x1")) / 2 - 0.5) < 0.1
    fits = (F.col("page") == 1) & (F.col("role") == "heading") & F.col("number").isNull() & centred & (F.col("bbox_norm.y0") < 0.35)
    out = blocks.join(has, "doc_id").withColumn("__fits", fits & ~F.col("__has"))
    rank = F.row_number().over(W.partitionBy("doc_id", "__fits").orderBy("bbox_norm.y0", "block_id"))
    return out.withColumn("role", F.when(F.col("__fits") & (rank == 1), "title").otherwise(F.col("role"))).drop("__has", "__fits")


def preamble_notes(blocks: DataFrame, order: str = "reading_order") -> DataFrame:
    """RP02: unclassified text of page 1 before the first heading is front matter."""
    w = W.partitionBy("doc_id").orderBy("page", order).rowsBetween(W.unboundedPreceding, 0)
    before = ~F.max(F.col("role") == "heading").over(w) & (F.col("page") == 1)
    return blocks.withColumn("role", F.when(before & (F.col("role") == "paragraph"), "front_matter").otherwise(F.col("role")))


def front_rows(lines: DataFrame, top: Column, bottom: Column) -> DataFrame:
    """RP03: the lines between the title and the abstract, as rows."""
    return line_groups(lines.where((F.col("page") == 1) & (F.col("bbox_norm.y0") >= top) & (F.col("bbox_norm.y1") <= bottom)), ["doc_id", "page"])


def blank_headings(headings: DataFrame) -> DataFrame:
    """RP05: unnumbered headings without ink that stand alike on two or more pages."""
    rows = headings.where(F.col("number").isNull() & ~F.col("has_ink")).withColumn("__t", F.lower(squeeze(F.col("text"))))
    many = rows.groupBy("doc_id", "__t").agg(F.countDistinct("page").alias("n")).where("n >= 2").drop("n")
    return rows.join(many, ["doc_id", "__t"], "left_semi").drop("__t")


def demote_headings(blocks: DataFrame) -> DataFrame:
    """RP07: headings that are references, bullets, brackets, quotes or plate labels become paragraphs."""
    t = F.trim("text")
    wrong = t.rlike(r"^(?:\[\d+\]|[•▪◦‣–—-]\s|[(\[{\"“‘'])") | t.rlike(r"(?i)^(?:plate|panel)\s+\w+$")
    return blocks.withColumn("role", F.when((F.col("role") == "heading") & wrong, "paragraph").otherwise(F.col("role")))


def lowercase_tails(body: DataFrame, least: float = 0.82, order: str = "position") -> DataFrame:
    """WN10, RP08: a tail in lower case joins the block before when an earlier line of the page is that similar.

    Similarity is one minus edit distance over the longer length, natively.
    """
    w = W.partitionBy("doc_id").orderBy(order)
    prev = F.lag("text").over(w)
    tail = F.col("text").rlike(r"^\s*\p{Ll}") & ~prev.rlike(r"[.!?]\s*$") & (F.lag("role").over(w) == F.col("role"))
    like = 1 - F.levenshtein(F.lower("text"), F.lower("printed_tail")) / F.greatest(F.length("text"), F.length("printed_tail"), F.lit(1))
    return body.withColumn("joins_previous", F.coalesce(tail & (like >= least), F.lit(False)))


def reorder(rows: DataFrame, by: list[str], key: Column, out: str = "reading_order") -> DataFrame:
    """WN21-WN22: stable renumbering by a rewritten sort key."""
    w = W.partitionBy(*by).orderBy(key, out, "block_id")
    return rows.withColumn(out, F.row_number().over(w))


def split_after_anchor(blocks: DataFrame, order: str = "position") -> DataFrame:
    """WN23, RP11: the blocks of a paragraph after an anchored equation get a paragraph of their own."""
    w = W.partitionBy("doc_id", "paragraph_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    k = F.coalesce(F.sum(F.col("anchors_equation").cast("int")).over(w), F.lit(0))
    return blocks.withColumn("paragraph_id", F.when(k > 0, F.concat("paragraph_id", F.lit("-t"), k)).otherwise(F.col("paragraph_id")))


def visual_footnotes(blocks: DataFrame, order: str = "position") -> DataFrame:
    """RP17: a footnote far below its visual, after unfinished text of the previous page, is a paragraph."""
    w = W.partitionBy("doc_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role") == "paragraph", F.struct("page", "text")), ignorenulls=True).over(w)
    wrong = (F.col("role") == "footnote") & (F.col("gap_to_visual") > 0.12) & (last["page"] == F.col("page") - 1) & ~last["text"].rlike(r"[.!?]\s*$")
    return blocks.withColumn("role", F.when(F.coalesce(wrong, F.lit(False)), "paragraph").otherwise(F.col("role")))


def join_code_lines(blocks: DataFrame, order: str = "reading_order") -> DataFrame:
    """RP18: adjacent code blocks of one level become one group."""
    w = W.partitionBy("doc_id", "page").orderBy(order)
    same = (F.lag("role").over(w) == "code") & (F.col("role") == "code") & G.same_line(F.lag("bbox_norm").over(w), F.col("bbox_norm"))
    return islands(blocks, ["doc_id", "page"], [order], ~same, "code_group")


def title_guess(candidates: DataFrame) -> DataFrame:
    """SRT09: the longest of the first eight candidates under 220 characters."""
    w = W.partitionBy("doc_id").orderBy("ordinal")
    first = candidates.withColumn("__n", F.row_number().over(w)).where("__n <= 8 and length(text) < 220")
    return first.groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("ordinal"))).alias("title"))


def set_recovered(blocks: DataFrame, recovered: DataFrame, by: list[str]) -> DataFrame:
    """RM23: blocks found again take the recovered text and role, are shown, and lose their old warnings."""
    new = recovered.select(*by, F.col("text").alias("__text"), F.col("role").alias("__role"), F.lit(True).alias("__found"))
    found = F.coalesce(F.col("__found"), F.lit(False))
    return blocks.join(new, by, "left").withColumns({
        "text": F.when(found, F.col("__text")).otherwise(F.col("text")), "role": F.when(found, F.col("__role")).otherwise(F.col("role")),
        "hidden": F.when(found, F.lit(False)).otherwise(F.col("hidden")),
        "warnings": F.when(found, F.array().cast("array<string>")).otherwise(F.col("warnings")),
    }).drop("__text", "__role", "__found")


def flatten_visuals(pages: DataFrame) -> DataFrame:
    """RM31: the visuals of each page (an array of structs) as rows with their page."""
    return pages.select("doc_id", "page", F.posexplode("visuals").alias("k", "visual")).select("doc_id", "page", "k", "visual.*")
