"""Queries of the relational operators: parts stand for boxes on pages, conversations for blocks in order, their turns
for trees; SQL says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import chunking, contracts, events, graph, layout, library, qa, repairs, semantic, translation
from ..session import table
from .registry import query

# --------------------------------------------------------------------------- boxes of parts

_BOXES = """r as (select p_partkey as id, p_partkey // 200 as doc, p_size % 7 as page, p_size, p_brand, p_partkey % 83 / 100.0 as x0, p_partkey % 61 / 100.0 as y0,
  p_partkey % 83 / 100.0 + 0.05 + p_size / 400.0 as x1, p_partkey % 61 / 100.0 + 0.08 as y1 from part)"""
_PAIR = "a.doc = b.doc and a.page = b.page and a.id < b.id"


def _boxes(spark, sf):
    k = F.col("p_partkey")
    x0, y0 = k % 83 / 100.0, k % 61 / 100.0
    return table(spark, sf, "part").select(
        k.alias("id"), F.expr("p_partkey div 200").alias("doc_id"), (F.col("p_size") % 7).cast("int").alias("page"), "p_size", "p_brand",
        k.cast("string").alias("block_id"), G.rect(x0, y0, x0 + 0.05 + F.col("p_size") / 400.0, y0 + 0.08).alias("bbox_norm"),
    )


def _pairs(spark, sf):
    b = _boxes(spark, sf)
    return layout.spatial_join(b, b, lambda x, y: F.lit(True)).where("id < r_id").select("id", F.col("r_id").alias("other"), F.col("bbox_norm").alias("a"), F.col("r_bbox_norm").alias("b"))


_W, _H = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0))", "greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query(f"""with {_BOXES}, p as (select a.id, b.id as other, {_W} * {_H} as shared, (a.x1 - a.x0) * (a.y1 - a.y0) as sa, (b.x1 - b.x0) * (b.y1 - b.y0) as sb from r a join r b on {_PAIR})
  select id, other, shared / (sa + sb - shared) as iou from p where shared > 0""")
def box_iou(spark, sf):
    return _pairs(spark, sf).select("id", "other", G.iou(F.col("a"), F.col("b")).alias("iou")).where("iou > 0")


@query(f"""with {_BOXES}, p as (select a.id, b.id as other, a.x0 as ax0, a.y0 as ay0, a.x1 as ax1, a.y1 as ay1, b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1 from r a join r b on {_PAIR}),
  q as (select *, abs(ax0 - bx0) <= 0.1 and abs(ay0 - by0) <= 0.1 and abs(ax1 - bx1) <= 0.1 and abs(ay1 - by1) <= 0.1 as near,
    (least(ay1, by1) - greatest(ay0, by0)) / least(ay1 - ay0, by1 - by0) >= 0.35 and abs((ay0 + ay1) / 2 - (by0 + by1) / 2) <= 0.012 as line from p)
  select id, other, near, line, line and bx0 - ax1 between -0.012 and 0.035 as follows from q where near or line""")
def box_relations(spark, sf):
    a, b = F.col("a"), F.col("b")
    r = _pairs(spark, sf).select("id", "other", G.box_matches(a, b).alias("near"), G.same_line(a, b).alias("line"), G.fragment_follows(a, b).alias("follows"))
    return r.where("near or line")


@query(f"""with {_BOXES} select doc as doc_id, page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from r group by doc, page""")
def page_hulls(spark, sf):
    return _boxes(spark, sf).groupBy("doc_id", "page").agg(G.union_rect(F.col("bbox_norm")).alias("u")).select("doc_id", "page", "u.*")


@query(f"""with {_BOXES} select id, greatest(0, x0 - 0.02) as left_, least(0.6, x1 + 0.02) as right_, greatest(0, y0 - 0.02) as top, least(0.5, y1 + 0.02) as bottom,
  1 - y1 as flipped, round(x0 / 2, 5) as half from r""")
def box_edges(spark, sf):
    b = F.col("bbox_norm")
    p = G.padded(b, 0.02, F.lit(0.6), F.lit(0.5))
    return _boxes(spark, sf).select("id", p["x0"].alias("left_"), p["x1"].alias("right_"), p["y0"].alias("top"), p["y1"].alias("bottom"),
                                    G.from_bottom_left(b, F.lit(1.0))["y0"].alias("flipped"), G.normalized(b, F.lit(2.0), F.lit(2.0))["x0"].alias("half"))


_KIND = "case p_size % 3 when 0 then 'figure' when 1 then 'table' else 'algorithm' end"


@query(f"""with {_BOXES}, p as (select c.id, v.id as candidate, {_KIND.replace('p_size', 'c.p_size')} as kind,
    greatest(0, least(c.x1, v.x1) - greatest(c.x0, v.x0)) / greatest(0.02, least(c.x1 - c.x0, v.x1 - v.x0)) as overlap, c.y0 - v.y1 as above, v.y0 - c.y1 as below
    from r c join r v on c.doc = v.doc and c.page = v.page and c.p_brand <> v.p_brand),
  q as (select *, case when kind = 'table' then below else above end as first, case when kind = 'table' then above else below end as second, case when kind = 'figure' then 0.35 else 0.22 end as most from p),
  s as (select id, candidate, case when overlap < 0.15 then -1 when first between -0.015 and most then 3.0 + overlap - greatest(0, first) * 6
    when second between -0.015 and 0.12 then 2.85 + overlap - greatest(0, second) * 6 else -1 end as score from q)
  select id, candidate, score from s where score >= 0""")
def caption_candidates(spark, sf):
    b = _boxes(spark, sf)
    kind = F.when(F.col("p_size") % 3 == 0, "figure").when(F.col("p_size") % 3 == 1, "table").otherwise("algorithm")
    c = b.withColumn("caption_kind", kind)
    v = b.select("doc_id", "page", F.struct(F.col("id").alias("id"), F.col("p_brand").alias("brand")).alias("candidate_id"), "bbox_norm")
    s = layout.caption_scores(c, v).where("candidate_id.brand <> p_brand")
    return s.select("id", F.col("candidate_id.id").alias("candidate"), "score")


@query(f"""with {_BOXES}, k as (select *, case when (x1 - x0) > 0.12 then 0 when (x0 + x1) / 2 > 0.45 then 2 else 1 end as side from r)
  select id, row_number() over (partition by doc, page order by side, y0, x0, cast(id as varchar)) as reading_order from k""")
def reading_orders(spark, sf):
    b = _boxes(spark, sf).withColumn("bbox", F.col("bbox_norm")).withColumn("page_width", F.lit(0.9))
    # a fifth of the width spans: the boxes are narrow
    wide = F.col("bbox.x1") - F.col("bbox.x0") > 0.12
    b = b.withColumn("bbox", F.when(wide, G.rect(F.col("bbox.x0"), F.col("bbox.y0"), F.col("bbox.x0") + 0.6, F.col("bbox.y1"))).otherwise(F.col("bbox")))
    return layout.reading_order(b).select("id", F.col("reading_order").cast("long").alias("reading_order"))


@query(f"""with {_BOXES} select id from r where y0 * 1000 >= 34 and y1 * 1000 <= 600 - 28""")
def inside_margins(spark, sf):
    b = _boxes(spark, sf)
    n = F.col("bbox_norm")
    b = b.withColumns({"bbox": G.rect(n["x0"] * 1000, n["y0"] * 1000, n["x1"] * 1000, n["y1"] * 1000), "page_height": F.lit(600.0)})
    return layout.drop_margins(b).select("id")


@query(f"""with {_BOXES}, s as (select id, p_size, (x1 - x0) * 1000 as w, (y1 - y0) * 1000 as h from r)
  select id from s where w * h / 500000.0 >= 0.008 and w >= 45 and h >= 30 and (p_size % 2 = 0 or w * h / 500000.0 >= 0.07)""")
def large_regions(spark, sf):
    n = F.col("bbox_norm")
    b = _boxes(spark, sf).withColumns({
        "bbox": G.rect(n["x0"] * 1000, n["y0"] * 1000, n["x1"] * 1000, n["y1"] * 1000), "page_height": F.lit(1000.0), "page_width": F.lit(500.0), "captioned": F.col("p_size") % 2 == 0,
    })
    return layout.region_candidates(b).select("id")


@query(f"""with {_BOXES}, d as (select * from r where p_size % 2 = 0 and (x1 - x0) * (y1 - y0) >= 0.001), i as (select * from r where p_size % 2 = 1 and (x1 - x0) * (y1 - y0) >= 0.008)
  select id from d union all select id from i a where not exists (select 1 from d b where a.doc = b.doc and a.page = b.page and {_W} * {_H} / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.8)""")
def drawn_or_pictured(spark, sf):
    b = _boxes(spark, sf)
    return layout.visual_candidates(b.where("p_size % 2 = 0"), b.where("p_size % 2 = 1")).select("id")


@query(f"""with {_BOXES}, m as (select *, max(y1) over (partition by doc, page order by y0, cast(id as varchar) rows between unbounded preceding and 1 preceding) as low from r)
  select id, cast(sum(case when low is null or y0 - low > 0.018 then 1 else 0 end) over (partition by doc, page order by y0, cast(id as varchar) rows unbounded preceding) as bigint) as equation_group from m""")
def equation_groups(spark, sf):
    return layout.group_equations(_boxes(spark, sf)).select("id", "equation_group")


@query(f"""with {_BOXES} select p_brand as brand, arg_min(id, (y0, id)) as id, count(*) as n from r group by p_brand""")
def highest_of_brand(spark, sf):
    b = _boxes(spark, sf)
    n = b.groupBy("p_brand").agg(F.count("*").alias("n"))
    top = repairs.top_one(b, ["p_brand"], F.col("bbox_norm.y0"), F.col("id"))
    return top.join(n, "p_brand").select(F.col("p_brand").alias("brand"), "id", "n")


# --------------------------------------------------------------------------- pages of conversations


def _blocks(spark, sf):
    """Turns as blocks: three a page, user turns are headings, levels and numbers from the turn."""
    t = F.col("turn")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), "conv_id", "turn", "text", "role", (F.expr("turn div 3") + 1).cast("int").alias("page"), (t % 3).alias("reading_order"),
        F.format_string("b%04d", t).alias("block_id"), t.alias("position"), F.lit(False).alias("hidden"), (1 - t / 50).alias("confidence"), (t % 4 + 1).cast("int").alias("level"),
        F.concat(F.lit("s"), t.cast("string")).alias("section_id"), F.col("text").alias("title"),
    )


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn // 3, turn % 3) as position from conversations")
def global_positions(spark, sf):
    return layout.global_position(_blocks(spark, sf)).select("conv_id", "turn", F.col("position").cast("long").alias("position"))


@query("select conv_id, turn // 3 + 1 as page, min(1 - turn / 50) as confidence from conversations group by all")
def page_confidences(spark, sf):
    b = _blocks(spark, sf)
    none = b.limit(0)
    return layout.page_confidence(b, none, none).select(F.col("doc_id").alias("conv_id"), F.col("page").cast("long").alias("page"), "confidence")


@query("""with p as (select conv_id, turn // 3 + 1 as page, min(1 - turn / 50) as confidence from conversations group by all),
  w as (select *, row_number() over (partition by conv_id order by page) as n from p where confidence < 0.95) select conv_id, page from w where n <= 2""")
def pages_to_review(spark, sf):
    b = _blocks(spark, sf)
    p = layout.page_confidence(b, b.limit(0), b.limit(0))
    return layout.review_pages(p, 0.95, most=2).select(F.col("doc_id").alias("conv_id"), F.col("page").cast("long").alias("page"))


@query("""with p as (select distinct conv_id, turn // 3 as for_page from conversations), a as (select p.conv_id, for_page, turn, row_number() over (partition by p.conv_id, for_page order by turn desc) as n
  from p join conversations c on c.conv_id = p.conv_id and c.turn // 3 < for_page) select conv_id, for_page + 1 as for_page, turn from a where n <= 4""")
def previous_contexts(spark, sf):
    return layout.previous_context(_blocks(spark, sf), 4).select("conv_id", F.col("for_page").cast("long").alias("for_page"), "turn")


@query("""select a.conv_id, a.turn, arg_max(b.turn, b.turn) as parent from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn < a.turn and b.turn % 4 < a.turn % 4
  and not regexp_matches(lower(trim(b.text)), '^(?:[0-9]+[.)]?\\s*)?(?:references|bibliography)$') group by all""")
def section_tree(spark, sf):
    s = layout.section_parents(_blocks(spark, sf).select("doc_id", "conv_id", "turn", "position", "section_id", "level", "title"))
    return s.select("conv_id", "turn", F.substring("parent_section_id", 2, 9).cast("long").alias("parent"))


@query("""with n as (select p_partkey, p_brand, concat(p_size, '.', p_partkey % 3, case when p_partkey % 2 = 0 then '.7' else '' end) as number from part), f as (select p_brand, number from n group by all)
  select p_partkey, f.number as parent_number from n left join f on n.p_brand = f.p_brand and f.number = regexp_replace(n.number, '[.]?[^.]+$', '')""")
def parents_of_numbers(spark, sf):
    k = F.col("p_partkey")
    number = F.concat(F.col("p_size").cast("string"), F.lit("."), (k % 3).cast("string"), F.when(k % 2 == 0, ".7").otherwise(""))
    s = table(spark, sf, "part").select(k.alias("p_partkey"), F.col("p_brand").alias("doc_id"), number.alias("number"), number.alias("section_id"))
    return layout.parents_by_number(s).select("p_partkey", F.col("parent_section_id").alias("parent_number"))


@query("""with s as (select conv_id, turn, role, case when role = 'user' then concat('sec-', turn % 2 + 1) end as slug from conversations),
  k as (select *, case when slug is not null then case when row_number() over (partition by conv_id, slug order by turn) = 1 then slug else concat(slug, '-', row_number() over (partition by conv_id, slug order by turn)) end end as own from s)
  select conv_id, turn, last_value(own ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as section from k""")
def carried_sections(spark, sf):
    b = _blocks(spark, sf).withColumns({"role": F.when(F.col("role") == "user", "heading").otherwise("paragraph"), "number": (F.col("turn") % 2 + 1).cast("string")}).drop("section_id")
    return layout.carry_section(b).select("conv_id", "turn", F.col("section_id").alias("section"))


# --------------------------------------------------------------------------- spans


@query("""select conv_id, min(turn % 5 + 8.0) as font_min, max(turn % 5 + 8.0) as font_max, bool_or(role = 'user') as bold,
  round_even(sum(case when turn % 3 = 0 then length(text) else 0 end) / greatest(sum(length(text)), 1), 4) as math_ratio from conversations group by conv_id""")
def font_facts(spark, sf):
    s = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ordinal"), "text", (F.col("turn") % 5 + 8.0).cast("double").alias("size"), (F.col("role") == "user").alias("bold"),
                                                F.lit(False).alias("italic"), F.when(F.col("turn") % 3 == 0, "CMMI10").otherwise("Times").alias("font"))
    return layout.font_evidence(s, ["conv_id"]).select("conv_id", "font_min", "font_max", "bold", "math_ratio")


@query("""select conv_id, coalesce(sum(case when role = 'user' then length(trim(text)) else 0 end) / nullif(sum(length(trim(text))), 0), 0.0) as bold_ratio, trim(regexp_replace(string_agg(text, '' order by turn), '\\s+', ' ', 'g')) as text
  from conversations group by conv_id""")
def span_texts(spark, sf):
    s = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ordinal"), "text", F.lit(9.0).alias("size"), (F.col("role") == "user").alias("bold"), F.lit("Times").alias("font"))
    return layout.line_ratios(s, ["conv_id"]).select("conv_id", "bold_ratio").join(layout.block_text(s, ["conv_id"]).select("conv_id", "text"), "conv_id")


@query("select source, list_sort(list(cast(n_chars as double)))[cast(floor(count(*) / 2) as integer) + 1] as median from documents group by source")
def upper_medians(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(layout.upper_median(F.col("n_chars").cast("double")).alias("median"))


# --------------------------------------------------------------------------- assembly


@query("select conv_id, role, string_agg(text, '|' order by turn) as texts from (select conv_id, turn, text, case when role = 'user' then 'author' else 'title' end as role from conversations) group by all")
def front_matters(spark, sf):
    b = _blocks(spark, sf).withColumn("role", F.when(F.col("role") == "user", "author").otherwise("title"))
    f = semantic.front_matter(b)
    return f.select(F.col("doc_id").alias("conv_id"), "role", F.array_join("texts", "|").alias("texts"))


@query("""select conv_id, turn // 3 as paragraph, min(turn) as position, max(turn) as end_position, min(1 - turn / 50) as confidence, count(*) as blocks, arg_min(role, turn) as kind from conversations group by all""")
def paragraph_units(spark, sf):
    none = F.array().cast("array<string>")
    b = _blocks(spark, sf).withColumns({"paragraph_id": F.col("page"), "citations": none, "object_references": none, "reference_label": F.lit(None).cast("string")})
    u = semantic.units_of_groups(b)
    return u.select(F.col("doc_id").alias("conv_id"), (F.col("unit_id") - 1).cast("long").alias("paragraph"), "position", "end_position", "confidence", F.size("source_block_ids").cast("long").alias("blocks"), "kind")


@query("""select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as title, turn // 3 + 1 as page from conversations where role = 'user'""")
def titles_of_sections(spark, sf):
    b = _blocks(spark, sf)
    numbered = b.withColumn("text", F.concat(F.lit("3.1 "), F.col("text")))
    s = b.where("role = 'user'").select("doc_id", "conv_id", "turn", F.col("block_id").alias("title_block_id"))
    return semantic.sections_with_titles(s, numbered).select("conv_id", "turn", "title", F.col("page").cast("long").alias("page"))


@query("""with s as (select distinct conv_id, turn % 3 as k from conversations where role = 'user') select c.conv_id, c.turn, case when s.k is null then 'sec-unassigned' else concat('s', c.turn % 3) end as section
  from conversations c left join s on s.conv_id = c.conv_id and s.k = c.turn % 3""")
def placed_units(spark, sf):
    b = _blocks(spark, sf).withColumn("section_id", F.concat(F.lit("s"), (F.col("turn") % 3).cast("string")))
    return semantic.place_units(b, b.where("role = 'user'")).select("conv_id", "turn", F.col("section_id").alias("section"))


@query("""with a as (select conv_id, turn as p from conversations where turn % 5 = 0), u as (select conv_id, turn // 3 as unit, max(turn) as e from conversations where turn % 4 <> 3 group by all),
  d as (select a.conv_id, a.p, u.unit from a join conversations c on c.conv_id = a.conv_id and c.turn = a.p and c.turn % 4 <> 3 join u on u.conv_id = a.conv_id and u.unit = a.p // 3),
  b as (select a.conv_id, a.p, arg_max(u.unit, u.e) as unit from a join u on u.conv_id = a.conv_id and u.e <= a.p group by all)
  select a.conv_id, a.p, cast(coalesce(d.unit, b.unit) as varchar) as anchor from a left join d using (conv_id, p) left join b using (conv_id, p)""")
def visual_anchors(spark, sf):
    b = _blocks(spark, sf)
    v = b.where("turn % 5 = 0").select("doc_id", "conv_id", F.col("turn").alias("p"), F.col("block_id").alias("object_id"), F.col("block_id").alias("insert_after_block_id"))
    u = b.where("turn % 4 <> 3").groupBy("doc_id", F.expr("turn div 3").alias("k")).agg(F.collect_list("block_id").alias("source_block_ids"), F.max("turn").alias("end_position"))
    u = u.withColumn("unit_id", F.col("k").cast("string"))
    return semantic.anchor_of_visuals(v, b, u).select("conv_id", "p", F.col("anchor_unit_id").alias("anchor"))


@query("""select conv_id, cast(turn as varchar) as unit_id, text as original from conversations where regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' and turn % 2 = 0
  union all select conv_id, 'title', concat('Talk ', conv_id) from (select distinct conv_id from conversations) union all select conv_id, concat('sec', turn), text from conversations where role = 'user' and regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''""")
def units_to_translate(spark, sf):
    b = _blocks(spark, sf)
    d = b.select("doc_id").distinct().withColumn("title", F.concat(F.lit("Talk "), F.col("doc_id").cast("string")))
    s = b.where("role = 'user'").select("doc_id", F.concat(F.lit("sec"), F.col("turn").cast("string")).alias("section_id"), "title", "position")
    u = b.select("doc_id", F.col("turn").cast("string").alias("unit_id"), F.when(F.col("turn") % 2 == 0, "paragraph").otherwise("reference").alias("kind"), F.col("text").alias("original"), "position")
    return semantic.translatable_units(d, s, u).select(F.col("doc_id").alias("conv_id"), "unit_id", "original")


@query("""select conv_id, turn, case when turn // 3 % 2 = 0 then 'reviewed' else role end as role from conversations""")
def reviewed_pages(spark, sf):
    b = _blocks(spark, sf).select("doc_id", "conv_id", "turn", "page", "role")
    r = b.where("page % 2 = 1").withColumn("role", F.lit("reviewed"))
    return semantic.override_pages(b, r, ["doc_id", "page"]).select("conv_id", "turn", "role")


@query("""select conv_id, turn, case when turn % 2 = 0 then concat('a-', turn % 4) end as anchor from conversations""")
def mention_targets(spark, sf):
    b = _blocks(spark, sf)
    u = b.select("doc_id", F.col("turn").alias("unit_id"), F.array(F.concat(F.lit("["), (F.col("turn") % 4).cast("string"), F.lit("]"))).alias("citations"), F.array().cast("array<string>").alias("object_references"))
    t = b.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit("0"), F.lit("2"))).alias("label")).withColumn("anchor", F.concat(F.lit("a-"), "label"))
    return semantic.mention_links(u, t).select(F.col("doc_id").alias("conv_id"), F.col("unit_id").alias("turn"), "anchor")


# --------------------------------------------------------------------------- trees of turns

_TREE = "tree as (select conv_id, turn, case when turn > 0 then (turn - 1) // 2 end as up, role from conversations)"


def _tree(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), "turn", F.when(F.col("turn") > 0, F.expr("(turn - 1) div 2")).alias("up"), "role")


@query(f"""with recursive {_TREE}, w as (select conv_id, turn, '' as path from tree where turn = 0
    union all select t.conv_id, t.turn, concat(w.path, t.turn % 2 + 1) from w join tree t on t.conv_id = w.conv_id and t.up = w.turn)
  select conv_id, turn, row_number() over (partition by conv_id order by replace(replace(path, '2', 'a'), '1', 'b')) as visit from w""")
def tree_walk(spark, sf):
    t = _tree(spark, sf)
    ref = lambda c: F.when(c.isNull(), "#/body").otherwise(F.concat(F.lit("#/t/"), c.cast("string")))
    items = t.select("doc_id", ref(F.col("turn")).alias("ref"), F.lit("body").alias("content_layer"), "turn")
    e = t.select("doc_id", ref(F.col("up")).alias("parent_ref"), ((F.col("turn") + 1) % 2).alias("ordinal"), ref(F.col("turn")).alias("child_ref"))
    return graph.walk(items, e).where("visit is not null").select(F.col("doc_id").alias("conv_id"), "turn", "visit")


@query(f"""with recursive {_TREE}, a as (select conv_id, turn, up as ancestor from tree where up is not null union all select a.conv_id, a.turn, t.up from a join tree t on t.conv_id = a.conv_id and t.turn = a.ancestor where t.up is not null)
  select conv_id, ancestor, turn from a""")
def tree_descendants(spark, sf):
    s = _tree(spark, sf).select("doc_id", F.col("turn").alias("section_id"), F.col("up").alias("parent_section_id"))
    return semantic.descendants(s).select(F.col("doc_id").alias("conv_id"), "ancestor", F.col("section_id").alias("turn"))


@query(f"""with recursive {_TREE}, a as (select conv_id, turn, turn as at from tree union all select a.conv_id, a.turn, t.up from a join tree t on t.conv_id = a.conv_id and t.turn = a.at where t.role <> 'user' and t.up is not null)
  select a.conv_id, a.turn, min(a.at) filter (where t.role = 'user') as anchor from a join tree t on t.conv_id = a.conv_id and t.turn = a.at group by a.conv_id, a.turn""")
def tree_reanchor(spark, sf):
    t = _tree(spark, sf)
    p = t.select("doc_id", F.col("turn").alias("block_id"), F.col("up").alias("parent_id"), (F.col("role") == "user").alias("survives"))
    r = t.select("doc_id", "turn", F.col("turn").alias("anchor"))
    return semantic.reanchor(r, p).select(F.col("doc_id").alias("conv_id"), "turn", "anchor")


@query(f"""with recursive {_TREE}, w as (select conv_id, turn from tree where turn = 0 union all select t.conv_id, t.turn from w join tree t on t.conv_id = w.conv_id and t.up = w.turn where t.turn % 7 <> 3)
  select w.conv_id, w.turn from w join tree t using (conv_id, turn) where t.role = 'user' and w.turn % 3 > 0""")
def tree_actions(spark, sf):
    t = _tree(spark, sf)
    action = F.when((F.col("role") == "user") & (F.col("turn") % 3 > 0), "Launch").when(F.col("role") == "user", "URI")
    o = t.select("doc_id", F.col("turn").alias("object_id"), action.alias("action"), (F.col("turn") == 0).alias("is_root"))
    e = t.where("up is not null and turn % 7 <> 3").select("doc_id", F.col("up").alias("object_id"), F.col("turn").alias("target_id"))
    return contracts.active_objects(o, e).select(F.col("doc_id").alias("conv_id"), F.col("object_id").alias("turn"))


@query(f"""with recursive {_TREE}, d as (select conv_id, turn, turn in (1, 5) as inside from tree where turn = 0 union all select t.conv_id, t.turn, d.inside or t.turn in (1, 5) from d join tree t on t.conv_id = d.conv_id and t.up = d.turn)
  select conv_id, turn from d where inside and turn not in (1, 5) and turn % 6 <> 4""")
def tree_suppressed(spark, sf):
    t = _tree(spark, sf).withColumn("ref", F.col("turn").cast("string"))
    e = t.where("up is not null").select("doc_id", F.col("up").cast("string").alias("parent_ref"), F.col("ref").alias("child_ref"))
    own = t.select("doc_id", "turn", "ref")
    s = graph.suppressed(e, own.where("turn in (1, 5)"), own.where("turn % 6 = 4"), own.where("turn = 0"))
    return s.select(F.col("doc_id").alias("conv_id"), F.col("ref").cast("long").alias("turn"))


# --------------------------------------------------------------------------- events and contracts


@query("select event_id, row_number() over (partition by user_id order by ts, event_id) as sequence from events")
def numbered_events(spark, sf):
    return events.number_events(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("event_id", "sequence")


@query("select user_id, case when arg_max(event_type, event_id) = 'purchase' then case when max(event_id) % 2 = 0 then 'broken' else 'worker_failed' end end as code from events group by user_id")
def failure_codes(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", "failed").otherwise("stage").alias("type"), F.when(F.col("event_id") % 2 == 0, "broken").alias("code"))
    return events.failure_code(e, "user_id", "event_id")


@query("select doc_id, case when length(text) > 100 then concat('[truncated] ', right(text, 100)) else text end as tail from documents")
def tails(spark, sf):
    return table(spark, sf, "documents").select("doc_id", events.tail(F.col("text"), 100).alias("tail"))


@query("select event_id, case when event_id % 3 = 0 then 0.0 else value end as value, event_type from events")
def upserted_metrics(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", "event_type")
    return events.upsert(e, e.where("event_id % 3 = 0").withColumn("value", F.lit(0.0)), ["event_id"])


@query("select doc_id as run_id, lang as role from documents where doc_id % 4 in (1, 2) and lang is not null")
def unequal_artifacts(spark, sf):
    d = table(spark, sf, "documents").where("lang is not null").select(F.col("doc_id").alias("run_id"), F.col("lang").alias("role"), F.col("source").alias("path"), F.lit("text/plain").alias("media_type"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"))
    staged = d.where("run_id % 4 <> 1").withColumn("bytes", F.when(F.col("run_id") % 4 == 2, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return events.artifact_mismatches(d, staged)


@query("select event_id, event_type as type, case when event_id % 5 = 0 then null else cast(user_id as varchar) end as run from events where event_id % 7 <> 0 union all select event_id, null, null from events where event_id % 7 = 0")
def parsed_event_lines(spark, sf):
    e = table(spark, sf, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("type"), F.when(F.col("event_id") % 5 > 0, F.col("user_id").cast("string")).alias("runId")))
    lines = e.select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(line).alias("value"))
    return events.parse_lines(lines).select("event_id", "type", F.col("runId").alias("run"))


@query("""select doc_id, case when doc_id % 5 = 0 then 'idle' when doc_id % 5 = 1 then 'unknown' when doc_id % 5 = 2 then 'stale' when doc_id % 2 = 0 then 'running' else 'starting' end as state from documents""")
def lock_states(spark, sf):
    k, now = F.col("doc_id") % 5, F.timestamp_seconds(F.lit(1_000_000) + F.col("doc_id"))
    d = table(spark, sf, "documents").select("doc_id", F.when(k == 0, 0).when(k == 1, 2).otherwise(1).alias("owners"),
                                            F.timestamp_seconds(F.lit(1_000_000) + F.col("doc_id") - F.when(k == 2, 121).otherwise(120)).alias("heartbeat"), (F.col("doc_id") % 2 == 0).alias("started"))
    return d.select("doc_id", contracts.lock_state(now).alias("state"))


@query("""select conv_id, cast(turn as varchar) as subject, case when turn % 5 = 0 then 'missing' else 'duplicate' end as problem from conversations where turn % 5 = 0 or turn % 7 = 1
  union all select conv_id, 'x', 'unknown' from (select distinct conv_id from conversations)""")
def structure_checks(spark, sf):
    b = _blocks(spark, sf).select("doc_id", F.lit(1).alias("page"), F.col("turn").cast("string").alias("block_id"), "turn")
    p = b.where("turn % 5 <> 0").withColumn("block_id", F.explode(F.when(F.col("turn") % 7 == 1, F.array("block_id", "block_id")).otherwise(F.array("block_id"))))
    p = p.unionByName(b.select("doc_id", "page", F.lit("x").alias("block_id"), F.lit(-1).cast("long").alias("turn")).distinct())
    p = p.withColumn("reading_order", F.monotonically_increasing_id())
    return contracts.structure_problems(b, p).select(F.col("doc_id").alias("conv_id"), "subject", "problem")


@query("select doc_id, n_chars % 3 <> 0 as promoted from documents")
def promotions(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), F.sha2("text", 256).alias("source_sha256"), "n_chars")
    c = d.select("job_id", F.when(F.col("n_chars") % 3 == 0, "other").otherwise(F.col("source_sha256")).alias("source_sha256"), F.lit("p.pdf").alias("path"), F.lit("d").alias("sha256"))
    m = d.withColumns({"promoted_path": F.lit(None).cast("string"), "promoted_sha256": F.lit(None).cast("string")})
    return contracts.promote(m, c).select(F.col("job_id").alias("doc_id"), (F.col("promoted_path").isNotNull() & (F.col("promoted_sha256") == "d")).alias("promoted"))


@query("select doc_id, source as asset from documents where n_chars % 4 <> 0 and lang = 'en'")
def stored_assets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("asset"), F.col("n_chars").alias("bytes"), F.sha2("text", 256).alias("sha256"), "lang").where("asset is not null")
    files = d.withColumn("bytes", F.when(F.col("bytes") % 4 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return contracts.verified_assets(d.where("lang = 'en'"), d, files).select("doc_id", "asset")


@query("select doc_id as run_id, n_chars from documents where doc_id not in (select doc_id from labels)")
def new_runs(spark, sf):
    runs = table(spark, sf, "documents").select(F.col("doc_id").alias("run_id"), "n_chars")
    return contracts.publish(runs, table(spark, sf, "labels").select(F.col("doc_id").alias("run_id")))


@query("select distinct user_id as run_id, event_type as uri from events where user_id not in (select user_id from events where event_id % 2 = 0 and event_type = 'view') or event_type <> 'view'")
def new_addresses(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("uri"), "event_id")
    return contracts.unexpected_uris(e, e.where("event_id % 2 = 0 and uri = 'view'"))


# --------------------------------------------------------------------------- translations, chunks, library, checks


@query("select conv_id, count(*) filter (role = 'user') as translatable, count(*) filter (role = 'user' and turn % 4 <> 2) as translated from conversations group by conv_id")
def translation_progress(spark, sf):
    c = table(spark, sf, "conversations").withColumn("japanese", F.when(F.col("turn") % 4 == 2, " ").otherwise("訳"))
    return chunking.translation_counts(c, ["conv_id"], "japanese", F.col("role") == "user")


@query("select conv_id, turn // 2 as chunk, cast(sum(length(text)) as bigint) as size from conversations group by all")
def chunk_lengths(spark, sf):
    c = table(spark, sf, "conversations").withColumn("chunk", F.expr("turn div 2"))
    return chunking.chunk_sizes(c, ["conv_id"], "text")


@query("select conv_id, turn // 2 as chunk, 1 - turn % 2 as pos, turn as unit_id, role from conversations where (conv_id, turn // 2) in (select (conv_id, turn // 2) from conversations where turn % 2 = 1)")
def units_of_chunks(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_id"), "role")
    chunks = c.where("unit_id % 2 = 1").select("doc_id", F.expr("unit_id div 2").alias("chunk"), F.array(F.col("unit_id"), F.col("unit_id") - 1).alias("unit_ids"))
    return chunking.chunk_units(chunks, c).select(F.col("doc_id").alias("conv_id"), "chunk", F.col("pos").cast("long").alias("pos"), "unit_id", "role")


@query("select conv_id, turn, case when turn % 3 = 0 then concat('ja ', text) else 'old' end as japanese from conversations")
def applied_translations(spark, sf):
    c = table(spark, sf, "conversations").withColumns({"japanese": F.lit("old"), "preserved_terms": F.array().cast("array<string>")})
    t = c.where("turn % 3 = 0").select("conv_id", "turn", F.concat(F.lit("ja "), "text").alias("japanese"), F.array(F.lit("x")).alias("preserved_terms"))
    return translation.apply_translations(c, t, ["conv_id", "turn"]).select("conv_id", "turn", "japanese")


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def latest_events(spark, sf):
    return translation.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("""select doc_id, case when doc_id % 5 = 0 then 'bad_bound' when doc_id % 5 = 1 then 'create' when doc_id % 5 = 2 then 'paper_conflict' when doc_id % 5 = 3 then 'language_conflict' else 'resume' end as action from documents""")
def prepared_jobs(spark, sf):
    k = F.col("job_id") % 5
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), F.col("source").alias("requested_id"), F.lit("ja").alias("target_language")).fillna("none")
    jobs = d.where(k != 1).withColumns({"requested_id": F.when(k == 2, "other").otherwise(F.col("requested_id")), "target_language": F.when(k == 3, "de").otherwise("ja")})
    r = d.withColumn("max_characters", F.when(k == 0, 10).otherwise(2000))
    return translation.prepare(jobs, r).select(F.col("job_id").alias("doc_id"), "action")


@query("""select doc_id, case when doc_id % 3 = 0 then 'pending' when doc_id % 2 = 0 and n_chars % 2 = 1 then 'needs_review' else 'completed' end as final_status from documents""")
def finalized_jobs(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), F.when(F.col("doc_id") % 3 == 0, 2).otherwise(0).alias("remaining"), F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("html").alias("source_type"), "n_chars")
    w = d.where("n_chars % 2 = 1").select("job_id", F.lit(1).alias("n_warnings"))
    return translation.finalize(d.drop("n_chars"), w).select(F.col("job_id").alias("doc_id"), "final_status")


@query("select doc_id, lang in ('en', 'de') as fine, array_to_string(case when lang = 'en' then ['en', 'x'] else [coalesce(lang, 'none'), 'en', 'x'] end, '|') as merged from documents")
def array_sets(spark, sf):
    own = F.array(F.coalesce("lang", F.lit("none")))
    return table(spark, sf, "documents").select(
        "doc_id", translation.covers(F.array(F.lit("en"), F.lit("de")), F.array("lang")).alias("fine"), F.array_join(translation.ordered_distinct(own, F.array(F.lit("en"), F.lit("x"))), "|").alias("merged")
    )


@query("""select doc_id, case when doc_id % 4 = 0 then 'completed' when doc_id % 4 = 1 then 'prepared' else 'needs_review' end as status, doc_id % 4 = 1 as copies, doc_id % 4 = 1 as active from documents""")
def paper_states(spark, sf):
    k = F.col("doc_id") % 4
    s = library.normalize_status(F.when(k == 0, "completed").when(k == 1, "needs_review").otherwise("odd"), F.when(k == 1, "pdf").otherwise("html"), F.lit("none"), F.lit("passed"))
    return table(spark, sf, "documents").select("doc_id", s.alias("status"), library.can_copy_request(s).alias("copies"), library.is_active(s).alias("active"))


@query("select source, cast(sum(n_chars) as bigint) as warnings, count(*) as unresolved, max(n_chars / 2) as worst_overlap from documents group by source")
def layout_report(spark, sf):
    d = table(spark, sf, "documents").select("source", F.col("n_chars").alias("warnings"), F.lit(1).alias("unresolved"), F.lit(0).alias("collisions"), F.lit(0).alias("overflows"), F.lit(0).alias("shrunk"), (F.col("n_chars") / 2).alias("worst_overlap"))
    return qa.layout_totals(d, ["source"]).select("source", "warnings", "unresolved", "worst_overlap")


@query("select lang, count(*) as segments, cast(sum(length(text)) as bigint) as characters from documents group by lang")
def batch_report(spark, sf):
    return qa.batch_stats(table(spark, sf, "documents"), ["lang"])


@query("select conv_id, turn from conversations where turn % 4 = 0")
def unrepresented_blocks(spark, sf):
    c = table(spark, sf, "conversations")
    return qa.unrepresented(c, c.where("turn % 4 <> 0"), ["conv_id", "turn"])


@query("select conv_id as doc_id, count(*) filter (role = 'user') as inline, 0 as row, count(*) filter (role <> 'user') as display, 0 as literal from conversations group by conv_id")
def formula_roles(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "user", "inline").otherwise("display").alias("role"))
    return qa.math_roles(c)


@query("select conv_id as doc_id, count(*) filter (turn % 3 = 1) as moved_nodes, count(*) filter (turn % 3 = 1 and role = 'user') as moved_items from conversations where turn % 3 = 1 group by conv_id")
def moved_nodes(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("node_id"), F.col("turn").alias("parent_id"), F.when(F.col("role") == "user", "li").otherwise("p").alias("tag"))
    return qa.moved(c, c.withColumn("parent_id", F.when(F.col("node_id") % 3 == 1, -1).otherwise(F.col("parent_id"))))
