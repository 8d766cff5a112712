"""Queries of the repair, page and rendering operators over whole tables, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import html, layout, markdown, repairs
from ..session import table
from .registry import query
from .relation_queries import _BOXES, _H, _W, _blocks, _boxes
from .scalar_queries import _LINES, _docs, _lines

_SAME_LINE = "(least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) >= 0.35 and abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= 0.012"
_PAGE = "a.doc = b.doc and a.page = b.page"

# --------------------------------------------------------------------------- boxes


@query(f"""with {_BOXES}, p as (select a.id, b.id as other, {_W} * {_H} as shared, (a.x1 - a.x0) * (a.y1 - a.y0) as sa,
    (a.x0 + a.x1) / 2 between b.x0 - 0.004 and b.x1 + 0.004 and (a.y0 + a.y1) / 2 between b.y0 - 0.004 and b.y1 + 0.004 as inside from r a join r b on {_PAGE} where a.p_size % 2 = 0 and b.p_size % 2 = 1),
  s as (select id, other, shared / sa + case when inside then 0.2 else 0.0 end as score from p where shared > 0)
  select id, arg_max(other, (score, other)) as region from s where score >= 0.12 group by id""")
def best_regions(spark, sf):
    b = _boxes(spark, sf)
    r = layout.best_region(b.where("p_size % 2 = 0"), b.where("p_size % 2 = 1").withColumn("region_id", F.col("id")))
    return r.select(F.col("block_id").cast("long").alias("id"), F.col("region_id").alias("region"))


@query(f"""with {_BOXES} select b.id, string_agg(distinct a.p_brand, '|' order by a.p_brand) as uris from r a join r b on {_PAGE} where {_W} * {_H} / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.25 group by b.id""")
def linked_blocks(spark, sf):
    b = _boxes(spark, sf)
    return layout.links_on_blocks(b.withColumn("uri", F.col("p_brand")), b).select(F.col("block_id").cast("long").alias("id"), F.array_join("uris", "|").alias("uris"))


@query(f"""with {_BOXES} select a.id from r a join r b on {_PAGE} and a.id <> b.id where {_W} * {_H} / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.55 group by a.id having count(*) >= 2""")
def covered_equations(spark, sf):
    return layout.overlay_equations(_boxes(spark, sf).withColumn("role", F.lit("equation"))).select(F.col("block_id").cast("long").alias("id"))


@query(f"""with {_BOXES} select a.id, arg_max(b.id, (b.y1, cast(b.id as varchar))) as anchor from r a join r b on {_PAGE} and a.id <> b.id and b.y1 <= a.y0 + 0.01 and least(a.x1, b.x1) > greatest(a.x0, b.x0) group by a.id""")
def blocks_above(spark, sf):
    b = _boxes(spark, sf)
    return layout.block_above(b, b).select(F.col("block_id").cast("long").alias("id"), F.col("anchor_id").cast("long").alias("anchor"))


@query(f"""with {_BOXES}, p as (select a.id, b.id as figure from r a join r b on {_PAGE} and a.p_size % 3 > 0 and b.p_size % 3 = 0 and abs(a.y1 - b.y0) <= 0.03 and a.x0 >= b.x0 - 0.02 and a.x1 <= b.x1 + 0.02),
  o as (select *, count(*) over (partition by id) as f from p) select id, figure from (select *, count(*) over (partition by figure) as h from o where f = 1) where h >= 2""")
def headings_on_panels(spark, sf):
    b = _boxes(spark, sf)
    f = b.where("p_size % 3 = 0").withColumn("object_id", F.col("id"))
    return layout.panel_headings(b.where("p_size % 3 > 0"), f).select(F.col("block_id").cast("long").alias("id"), F.col("object_id").alias("figure"))


_BESIDE = """least({0}.x1 - {0}.x0, {1}.x1 - {1}.x0) / greatest({0}.x1 - {0}.x0, {1}.x1 - {1}.x0) >= 0.72 and (least({0}.y1, {1}.y1) - greatest({0}.y0, {1}.y0)) / least({0}.y1 - {0}.y0, {1}.y1 - {1}.y0) >= 0.82
  and abs(({0}.y0 + {0}.y1) / 2 - ({1}.y0 + {1}.y1) / 2) <= 0.08 and {1}.x0 - {0}.x1 between 0.0 and 0.12"""


@query(f"""with {_BOXES}, p as (select a.id, b.id as merged, least(a.x0, b.x0) as x0, greatest(a.x1, b.x1) as x1 from r a join r b on {_PAGE} and a.p_size % 2 = 0 and b.p_size % 2 = 1 and (({_BESIDE.format('a', 'b')}) or ({_BESIDE.format('b', 'a')})))
  select id, merged, x0, x1 from (select *, count(*) over (partition by merged) as n, count(*) over (partition by id) as m from p) where n = 1 and m = 1""")
def merged_panels(spark, sf):
    b = _boxes(spark, sf).withColumn("object_id", F.col("id"))
    m = layout.split_panels(b.where("p_size % 2 = 0"), b.where("p_size % 2 = 1"))
    return m.select(F.col("object_id").alias("id"), F.col("merged_id").alias("merged"), "bbox_norm.x0", "bbox_norm.x1")


@query(f"""with {_BOXES}, o as (select *, row_number() over (partition by doc, page order by id) as k, case when p_size % 2 = 0 then ' = ' else concat('x', id) end as t from r)
  select b.id, case when a.id is not null then concat('= ', b.t) else b.t end as text, a.id is not null as absorbed_sign from o b left join o a on {_PAGE} and a.k = b.k - 1 and a.p_size % 2 = 0 and b.p_size % 2 = 1 and {_SAME_LINE}""")
def absorbed_signs(spark, sf):
    odd = F.col("p_size") % 2 == 1
    b = _boxes(spark, sf).withColumns({"reading_order": F.col("id"), "role": F.when(odd, "equation").otherwise("paragraph"), "text": F.when(odd, F.concat(F.lit("x"), F.col("id").cast("string"))).otherwise(" = ")})
    return layout.sign_before_equation(b).select("id", "text", "absorbed_sign")


@query(f"""with {_BOXES}, o as (select *, row_number() over (partition by doc, page order by id) as k from r), s as (select b.*, a.id is not null as same from o b left join o a on {_PAGE} and a.k = b.k - 1 and {_SAME_LINE})
  select id, cast(sum(case when same then 0 else 1 end) over (partition by doc, page order by id rows unbounded preceding) as bigint) as code_group from s""")
def code_lines(spark, sf):
    b = _boxes(spark, sf).withColumns({"reading_order": F.col("id"), "role": F.lit("code")})
    return layout.join_code_lines(b).select("id", "code_group")


@query(f"""with {_BOXES}, c as (select *, abs((x0 + x1) / 2 - 0.5) < 0.1 and y0 < 0.35 and page = 1 as fits from r)
  select id, fits and row_number() over (partition by doc, fits order by y0, cast(id as varchar)) = 1 as title from c""")
def promoted_titles(spark, sf):
    b = _boxes(spark, sf).withColumns({"role": F.lit("heading"), "number": F.lit(None).cast("string")})
    return layout.promote_title(b).select("id", (F.col("role") == "title").alias("title"))


@query(f"""with {_BOXES} select v.id, min(b.y0) is not null as recovered, coalesce(min(b.y0) - 0.005, any_value(v.y1) + 0.25) as bottom from r v left join r b on v.doc = b.doc and v.page = b.page and b.p_size % 2 = 0
    and (least(b.x1, v.x1) - greatest(b.x0, v.x0)) / (b.x1 - b.x0) >= 0.7 and b.y0 >= v.y0 + 0.025 and b.y1 <= v.y1 + 0.25 - 0.025 group by v.id""")
def cut_visuals(spark, sf):
    b = _boxes(spark, sf).withColumn("text", F.when(F.col("p_size") % 2 == 0, "Figure 3: what it shows").otherwise("plain"))
    v = F.col("bbox_norm")
    tall = b.select("id", "doc_id", "page", F.col("id").alias("object_id"), G.rect(v["x0"], v["y0"], v["x1"], v["y1"] + 0.25).alias("bbox_norm"))
    return repairs.overlarge_visuals(tall, b).select("id", "recovered", F.col("bbox_norm.y1").alias("bottom"))


@query(f"""with {_BOXES}, p as (select a.id, c.id as caption, greatest(0, c.id % 61 * 10 - a.id % 61 * 10 - 80, a.id % 61 * 10 - c.id % 61 * 10 - 80) as far from r a join r c on a.doc = c.doc and a.page = c.page and a.p_size % 2 = 0 and c.p_size % 2 = 1
    and least(a.x1, c.x1) - greatest(a.x0, c.x0) >= 0.25 * least(a.x1 - a.x0, c.x1 - c.x0))
  select r.id, arg_min(caption, (far, cast(caption as varchar))) as caption from r left join p on p.id = r.id and far <= case when r.p_size % 4 = 0 then 70 else 95 end where r.p_size % 2 = 0 group by r.id""")
def nearest_captions(spark, sf):
    n = F.col("bbox_norm")
    top = F.col("id") % 61 * 10
    b = _boxes(spark, sf).withColumn("bbox", G.rect(n["x0"], top, n["x1"], top + 80))
    r = b.where("p_size % 2 = 0").withColumns({"region_id": F.col("id"), "kind": F.when(F.col("p_size") % 4 == 0, "table").otherwise("figure")})
    return layout.nearest_caption(r, b.where("p_size % 2 = 1")).select("id", F.col("caption_id").cast("long").alias("caption"))


# --------------------------------------------------------------------------- lines and turns


@query(f"with {_LINES}, t as (select doc_id, k, trim(line) as t from lines) select doc_id, k, regexp_matches(t, '^(?:\\[[0-9]+\\]|[•▪◦‣–—-]\\s|[(\\[{{\"“‘''])') or regexp_matches(t, '(?i)^(?:plate|panel)\\s+\\w+$') as demoted from t")
def demoted_headings(spark, sf):
    b = _lines(spark, sf).select("doc_id", "k", F.col("line").alias("text"), F.lit("heading").alias("role"))
    return layout.demote_headings(b).select("doc_id", "k", (F.col("role") == "paragraph").alias("demoted"))


_STARTS = "(?i)^\\s*(?:figure|fig[.]?|table|algorithm)\\s*(?:[A-Z][.])?[0-9]"


@query(f"""with {_LINES} select doc_id, k, regexp_matches(line, '{_STARTS}') and (k % 5 = 0 or regexp_matches(ltrim(regexp_replace(line, '(?i)^\\s*(?:figure|fig[.]?|table|algorithm)\\s*\\S*?[0-9][\\w.\\-]*', '')), '^(?:$|[:.\\-–—])')) as record from lines""")
def caption_records(spark, sf):
    r = repairs.caption_record(F.col("line"), F.lit("text"), F.col("k") % 5 == 0)
    return _lines(spark, sf).select("doc_id", "k", r.alias("record"))


@query("""with l as (select source, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from documents),
  h as (select *, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) as t from l where k % 2 = 1 and source is not null), m as (select source, t from h group by all having count(distinct doc_id) >= 2)
  select h.source, h.doc_id, h.k from h join m on h.source = m.source and h.t = m.t""")
def inkless_headings(spark, sf):
    h = table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("k", "text"))
    h = h.withColumns({"number": F.lit(None).cast("string"), "has_ink": F.col("k") % 2 == 0})
    return layout.blank_headings(h).select(F.col("doc_id").alias("source"), F.col("page").alias("doc_id"), "k")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents)
  select doc_id, arg_max(line, (length(line), -k)) as title from l where k <= 8 and length(line) < 220 group by doc_id""")
def guessed_titles(spark, sf):
    c = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return layout.title_guess(c)


@query("""select conv_id, turn, case when turn < 3 and not bool_or(turn % 3 = conv_id % 3) over (partition by conv_id order by turn rows unbounded preceding) then 'front_matter' when turn % 3 = conv_id % 3 then 'heading' else 'paragraph' end as role from conversations""")
def preambles(spark, sf):
    b = _blocks(spark, sf).withColumn("role", F.when(F.col("turn") % 3 == F.col("conv_id") % 3, "heading").otherwise("paragraph"))
    return layout.preamble_notes(b).select("conv_id", "turn", "role")


@query("""with s as (select conv_id, turn, turn // 4 as p, coalesce(sum(case when turn % 3 = 0 then 1 else 0 end) over (partition by conv_id, turn // 4 order by turn rows between unbounded preceding and 1 preceding), 0) as k from conversations)
  select conv_id, turn, case when k > 0 then concat('p', p, '-t', k) else concat('p', p) end as paragraph from s""")
def split_paragraphs(spark, sf):
    b = _blocks(spark, sf).withColumns({"paragraph_id": F.concat(F.lit("p"), F.expr("turn div 4").cast("string")), "anchors_equation": F.col("turn") % 3 == 0})
    return layout.split_after_anchor(b).select("conv_id", "turn", F.col("paragraph_id").alias("paragraph"))


@query("""with b as (select conv_id, turn, turn // 3 as page, case when turn % 3 = 2 then 'footnote' else 'paragraph' end as role, text, turn / 10.0 as gap from conversations),
  l as (select *, last_value(case when role = 'paragraph' then page end ignore nulls) over w as lp, last_value(case when role = 'paragraph' then text end ignore nulls) over w as lt from b window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding))
  select conv_id, turn, role = 'footnote' and gap > 0.12 and coalesce(lp = page, false) and not regexp_matches(coalesce(lt, '.'), '[.!?]\\s*$') as wrong from l""")
def wrong_footnotes(spark, sf):
    # a footnote stands on the page after its text here
    b = _blocks(spark, sf).withColumns({"role": F.when(F.col("turn") % 3 == 2, "footnote").otherwise("paragraph"), "gap_to_visual": F.col("turn") / 10.0})
    b = b.withColumn("page", F.when(F.col("role") == "footnote", F.col("page") + 1).otherwise(F.col("page")))
    return layout.visual_footnotes(b).select("conv_id", "turn", ((F.col("turn") % 3 == 2) & (F.col("role") == "paragraph")).alias("wrong"))


@query("""with b as (select conv_id, turn, lower(text) as t, concat(lower(text), repeat('x', cast(turn * 3 as integer))) as tail, lag(text) over w as prev, lag(role) over w = role as same from conversations window w as (partition by conv_id order by turn))
  select conv_id, turn, coalesce(regexp_matches(t, '^\\s*\\p{Ll}') and not regexp_matches(lower(prev), '[.!?]\\s*$') and same and 1 - levenshtein(t, tail) / greatest(length(t), length(tail), 1) >= 0.82, false) as joins from b""")
def joined_tails(spark, sf):
    b = _blocks(spark, sf).withColumn("text", F.lower("text"))
    b = b.withColumn("printed_tail", F.concat("text", F.repeat(F.lit("x"), (F.col("turn") * 3).cast("int"))))
    return layout.lowercase_tails(b).select("conv_id", "turn", F.col("joins_previous").alias("joins"))


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn % 2, turn) as place from conversations")
def reordered_turns(spark, sf):
    b = _blocks(spark, sf).withColumn("reading_order", F.col("turn"))
    return layout.reorder(b, ["doc_id"], F.col("turn") % 2).select("conv_id", "turn", F.col("reading_order").cast("long").alias("place"))


@query("select doc_id, 'multi-scale' as compound from documents where n_chars % 2 = 0")
def broken_compounds(spark, sf):
    t = F.concat(F.replace("text", F.lit("-"), F.lit("~")), F.lit(" multi-\nscale"), F.when(F.col("n_chars") % 2 == 0, " Multi-scale").otherwise(""))
    b = _docs(spark, sf).select("doc_id", F.lit("b").alias("block_id"), t.alias("text"))
    return layout.hyphen_compounds(b).select("doc_id", "compound")


@query("""select a.conv_id, a.turn, arg_max(b.turn, b.turn) as parent from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn < a.turn and b.turn % 4 < a.turn % 4 group by all""")
def rebuilt_sections(spark, sf):
    s = _blocks(spark, sf).select("doc_id", "conv_id", "turn", F.col("turn").alias("pre"), F.col("turn").alias("section_id"), "level")
    return html.rebuild_hierarchy(s).select("conv_id", "turn", F.col("parent_section_id").alias("parent"))


# --------------------------------------------------------------------------- pages


def _pages(spark, sf, head=None, tail=None):
    n = F.col("page_id").cast("string")
    parts = [p for p in (head, F.col("html"), tail) if p is not None]
    return table(spark, sf, "pages").select(n.alias("doc_id"), F.concat(*parts).alias("html"))


@query("select page_id, 'zz' as target from pages union all select page_id, 'k0' from pages where page_id % 3 > 0")
def dangling_links(spark, sf):
    tail = F.concat(F.lit('<p id="k'), (F.col("page_id") % 3).cast("string"), F.lit('"><a href="#k0">x</a><a href="#zz">y</a></p>'))
    return html.broken_links(html.node_table(_pages(spark, sf, tail=tail))).select(F.col("doc_id").cast("long").alias("page_id"), "target")


@query("select page_id, 'q' as id, 2 + page_id % 2 as n from pages")
def repeated_ids(spark, sf):
    tail = F.concat(F.lit('<p id="q">1</p><p id="q">2</p>'), F.when(F.col("page_id") % 2 == 1, '<b id="q">3</b>').otherwise(""))
    return html.duplicate_ids(html.parse_html(_pages(spark, sf, tail=tail))).select(F.col("doc_id").cast("long").alias("page_id"), "id", "n")


@query("""select page_id, len(regexp_extract_all(html, '<[a-z][a-z0-9]*')) as elements, len(regexp_extract_all(html, '<(?:script|animate|set|use|image|a)[ >]')) as active from pages where regexp_matches(html, '<(?:script|animate|set|use|image|a)[ >]')""")
def active_drawings(spark, sf):
    return html.svg_problems(html.parse_html(_pages(spark, sf))).select(F.col("doc_id").cast("long").alias("page_id"), "elements", "active")


@query("""select page_id, len(regexp_extract_all(html, '<(?:a|div|p|span|table|tr|td)[ >]')) + 1 as elements, 1 as safe from pages""")
def raw_markup(spark, sf):
    tail = F.lit('<a href="javascript:x()" onclick="x()" class="c">k</a>')
    n = html.raw_nodes(html.parse_html(_pages(spark, sf, tail=tail)), ["a", "div", "p", "span", "table", "tr", "td"])
    own = (html.attr("class") == "c") & html.attr("href").isNull() & html.attr("onclick").isNull()
    el = n.where("type = 'element'").groupBy("doc_id").agg(F.count("*").alias("elements"), F.count_if((F.col("tag") == "a") & own).cast("int").alias("safe"))
    return el.select(F.col("doc_id").cast("long").alias("page_id"), "elements", "safe")


@query("""select page_id, len(regexp_extract_all(html, '<[a-z][a-z0-9]*')) - len(regexp_extract_all(html, '<(?:script|style|iframe|object|embed|form|input|button|link|meta|base|template)[ >]')) + 1 as elements, 1 as handlers_gone from pages""")
def sanitized_pages(spark, sf):
    tail = F.lit('<b onclick="x()" class="c">k</b>')
    n = html.sanitize(html.node_table(_pages(spark, sf, tail=tail)))
    el = n.where("type = 'element'").groupBy("doc_id").agg(F.count("*").alias("elements"), F.sum(F.when((F.col("tag") == "b") & (html.attr("class") == "c") & html.attr("onclick").isNull(), 1).otherwise(0)).alias("handlers_gone"))
    return el.select(F.col("doc_id").cast("long").alias("page_id"), "elements", F.col("handlers_gone").cast("int").alias("handlers_gone"))


@query("select page_id, case when page_id % 3 = 0 then 'front' else concat('S', page_id % 3) end as section from pages")
def sections_of_items(spark, sf):
    k = (F.col("page_id") % 3).cast("string")
    head = F.when(F.col("page_id") % 3 == 0, F.lit('<p id="it">x</p>')).otherwise(F.concat(F.lit('<section id="S'), k, F.lit('"><section id="inner"><p id="it">x</p></section></section>')))
    n = html.node_table(_pages(spark, sf, head=head))
    return html.section_of(n, n.where(html.attr("id") == "it")).select(F.col("doc_id").cast("long").alias("page_id"), F.col("section_id").alias("section"))


@query("select page_id, concat('n', page_id, '||', 'two') as cells from pages")
def spanned_rows(spark, sf):
    head = F.concat(F.lit('<table><tr><td colspan="2"> n'), F.col("page_id").cast("string"), F.lit("</td><td><b>t</b>wo</td></tr></table>"))
    n = html.node_table(_pages(spark, sf, head=head))
    first = html.table_rows(n)
    return first.where("row_id = 1").select(F.col("doc_id").cast("long").alias("page_id"), F.array_join("cells", "|").alias("cells"))


@query("select page_id, cast([2, 4, 3, 5][page_id % 4 + 1] as integer) as level from pages")
def levels_of_sections(spark, sf):
    k = F.col("page_id") % 4
    c = F.when(k == 0, "ltx_section").when(k == 1, "ltx_subsubsection x").when(k == 2, "ltx_subsection").otherwise("ltx_paragraph")
    return table(spark, sf, "pages").select("page_id", html.section_level(c).alias("level"))


@query("""with t as (select page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as a from pages) select page_id, concat('in ', trim(regexp_replace(regexp_replace(split_part(split_part(a, '</h1>', 1), '<h1>', 2), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))) as title
  from t where not contains(split_part(a, '</h1>', 1), '&') and contains(a, '</h1>')""")
def titles_of_pages(spark, sf):
    n = html.node_table(_pages(spark, sf))
    h = n.where("tag = 'h1'")
    t = html.plain_text(n, html.below(h, n.where("tag = 'article'")))
    raw = table(spark, sf, "pages").where(F.col("html").contains("</h1>") & ~F.substring_index(F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1), "</h1>", 1).contains("&"))
    return t.join(raw.select(F.col("page_id").cast("string").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("page_id"), F.concat(F.lit("in "), "text").alias("title"))


# --------------------------------------------------------------------------- rendering


@query("""select doc_id, case when doc_id % 2 = 0 then 1 else 0 end as duplicate_anchors, case when doc_id % 3 = 0 then '' else 'b' end as unresolved, case when doc_id % 2 = 1 and doc_id % 3 = 0 then 'passed' else 'failed' end as status from documents""")
def markdown_checks(spark, sf):
    plain = F.regexp_replace("text", r"[`\[\]$!]", "")
    m = F.concat(F.lit('<a id="a"></a> [x](#a) [y](#b) `[z](#c)` '), plain, F.when(F.col("doc_id") % 2 == 0, '<a id="a"></a>').otherwise(""), F.when(F.col("doc_id") % 3 == 0, '<a id="b"></a>').otherwise(""))
    q = markdown.markdown_qa(_docs(spark, sf).select("doc_id", m.alias("markdown")))
    return q.select("doc_id", "duplicate_anchors", F.array_join("unresolved", "|").alias("unresolved"), "status")


@query("select conv_id, turn, 4 + row_number() over (partition by conv_id, role order by turn) as start from conversations")
def numbered_lists(spark, sf):
    b = _blocks(spark, sf).withColumns({"list_id": F.col("role"), "pos": F.col("turn"), "start": F.lit(5)})
    return markdown.number_lists(b).select("conv_id", "turn", F.col("start").cast("long").alias("start"))


@query("select conv_id, turn, row_number() over (partition by conv_id order by case when turn % 5 = 0 then null else turn // 2 end nulls last, case when role = 'user' then 0 else 1 end, turn) as pos from conversations")
def semantic_positions(spark, sf):
    b = _blocks(spark, sf).withColumns({"position": F.when(F.col("turn") % 5 > 0, F.expr("turn div 2")), "type": F.when(F.col("role") == "user", "visual").otherwise("unit"), "index": F.col("turn")})
    return markdown.semantic_order(b).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"))


@query("select conv_id, turn, case when turn % 4 in (0, 2) and row_number() over (partition by conv_id, turn % 4 order by turn) = 1 then concat('a', turn % 4) end as anchor from conversations")
def pruned_anchors(spark, sf):
    b = _blocks(spark, sf).withColumns({"anchor": F.concat(F.lit("a"), (F.col("turn") % 4).cast("string")), "pos": F.col("turn")})
    links = b.select("doc_id").distinct().withColumn("target", F.explode(F.array(F.lit("a0"), F.lit("a2"), F.lit("a2"))))
    return markdown.prune_anchors(b, links).select("conv_id", "turn", "anchor")


@query("""select doc_id, concat(regexp_replace(replace(text, 'http', 'xttp'), '([\\\\`*_\\[\\]<>|~$])', '\\\\\\1', 'g'), ' see [https://a.org/x\\_(y)](https://a.org/x_(y))). end') as text from documents""")
def linked_texts(spark, sf):
    t = F.concat(F.replace("text", F.lit("http"), F.lit("xttp")), F.lit(" see https://a.org/x_(y)). end"))
    return _docs(spark, sf).select("doc_id", markdown.with_external_links(t).alias("text"))


@query("select doc_id, concat('See https://a.org/p', doc_id, ' and ', replace(replace(text, 'http', 'xttp'), 'www', 'vvv')) as text from documents")
def annotated_addresses(spark, sf):
    n = F.col("doc_id").cast("string")
    t = F.concat(F.lit("See https://a.o rg/ p"), n, F.lit(" and "), F.replace(F.replace("text", F.lit("http"), F.lit("xttp")), F.lit("www"), F.lit("vvv")))
    uris = F.array(F.lit("https://b.org/"), F.concat(F.lit("https://a.org/p"), n))
    return _docs(spark, sf).select("doc_id", repairs.with_annotated_urls(t, uris).alias("text"))


@query("""select p_brand as doc_id, string_agg(concat('<figure id="', p_partkey, '"><img src="', p_size, '.png"><figcaption>', coalesce(p_brand, ''), '</figcaption></figure>'), chr(10) order by p_size, cast(p_partkey as varchar)) as html from part group by p_brand""")
def visual_sheets(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("page"), F.col("p_partkey").cast("string").alias("object_id"), F.concat(F.col("p_size").cast("string"), F.lit(".png")).alias("asset"), F.col("p_brand").alias("label"))
    return markdown.visual_sheet(p)


@query("""with b as (select conv_id, turn, role = 'user' as head, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as t from conversations)
  select conv_id as doc_id, concat('<!DOCTYPE html><meta charset="utf-8"><meta name="generator" content="v1"><nav><ul>', chr(10), coalesce(string_agg(concat('<li><a href="#t', turn, '">', t, '</a></li>'), chr(10) order by turn) filter (head), ''), chr(10), '</ul></nav>', chr(10),
    string_agg(case when head then concat('<h2 id="t', turn, '">', t, '</h2>') else concat('<p id="t', turn, '">', t, '</p>') end, chr(10) order by turn), chr(10)) as html from b group by conv_id""")
def html_documents(spark, sf):
    b = _blocks(spark, sf).select("doc_id", F.col("turn").alias("pos"), F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("kind"), "text", F.lit(2).alias("level"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("anchor"))
    return markdown.html_page(b, "v1")
