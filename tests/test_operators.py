"""Relational operators on frames shaped like the fixtures."""

import datetime as dt
import html as entities
import random
import re
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.operators import chunking, contracts, evaluation, events, graph, html, layout, library, markdown, plugins, qa, semantic, translation
from foliant.sources import readers, sinks

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_pack(spark):
    u = spark.createDataFrame([("d", i, s) for i, s in enumerate([4, 4, 4, 20, 1, 9, 10])], "doc_id string, pos int, n int")
    got = dict(chunking.pack(u, ["doc_id"], "pos", F.col("n"), 10).select("pos", "chunk").collect())
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 5}


def test_pack_sections_keeps_small_sections_whole(spark):
    u = spark.createDataFrame([("d", i, s, n) for i, (s, n) in enumerate([("a", 3), ("a", 3), ("b", 5), ("a", 2), ("c", 8), ("c", 8)])], "doc_id string, pos int, sec string, n int")
    got = chunking.pack_sections(u, ["doc_id"], "pos", "sec", F.col("n"), 10).orderBy("pos").select("run", "piece", "chunk").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (1, 1, 1), (2, 1, 2), (3, 1, 2), (4, 1, 3), (4, 2, 4)]


def test_chunk_progress(spark):
    u = spark.createDataFrame([("j", 1, "x"), ("j", 1, "y"), ("j", 2, " "), ("k", 1, "z")], "job_id string, chunk int, japanese string")
    c = chunking.chunk_status(u, ["job_id"], "japanese")
    assert rows(chunking.job_progress(c, ["job_id"]), "job_id", "completed", "total", "status") == [("j", 1, 2, "translating"), ("k", 1, 1, "translated")]
    assert rows(chunking.next_pending(c, ["job_id"]), "job_id", "chunk") == [("j", 2)]


def test_patches(spark):
    s = spark.createDataFrame([("a", ["ML", "old"], False, True), ("b", ["x"], True, None)], "slug string, tags array<string>, is_read boolean, favorite boolean")
    p = spark.createDataFrame([("a", None, [" new "], ["OLD"], True, None), ("b", ["t"], ["u"], None, None, None), ("c", ["z", "Z"], None, None, None, None)],
                              "slug string, tags array<string>, add_tags array<string>, remove_tags array<string>, is_read boolean, favorite boolean")
    got = {r.slug: r for r in library.apply_patches(s, p).collect()}
    assert got["a"].tags == ["ML", "new"] and got["a"].is_read and got["a"].favorite
    assert got["b"].problem == "replace_and_mutate" and got["b"].tags == ["x"] and got["c"].tags == ["z"]


def test_manifest_and_jobs(spark):
    m = spark.createDataFrame([("a", 2, "j", "T"), ("a", 1, "j", " "), ("b", 1, "k", "U")], "slug string, priority int, job_id string, title string")
    assert rows(library.pick_manifest(m), "slug", "priority") == [("a", 2), ("b", 1)]
    j = spark.createDataFrame([("j", 1, 5), ("j", 2, 9), ("k", 3, 7)], "job_id string, priority int, updated_at int")
    assert [r.job_id for r in readers.list_jobs(j).collect()] == ["k", "j"]


def test_saves_are_idempotent(spark):
    old = spark.createDataFrame([("c", "1", "x", 1), ("c", "2", "y", 1)], "chunk string, block string, japanese string, saved_at int")
    new = spark.createDataFrame([("c", "1", "x", 2), ("c", "2", "z", 2), ("c", "3", " ", 2), ("c", "4", "w", 2)], old.schema)
    got = {r.block: (r.japanese, r.saved_at, r.action) for r in translation.save(old, new, ["chunk", "block"]).collect()}
    assert got == {"1": ("x", 1, "replay"), "2": ("y", 1, "conflict"), "3": (None, None, "blank"), "4": ("w", 2, "insert")}
    assert {r.action for r in translation.save(old, new, ["chunk", "block"], overwrite=True).collect()} == {"replay", "overwrite", "blank", "insert"}


def test_translate_with_cache_and_retries(spark):
    chunks = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "bad")], "key string, payload string")
    cache = spark.createDataFrame([("a", "cached")], "key string, result string")

    def shout(p):
        if p == "bad":
            raise ValueError
        return p.upper()

    assert rows(translation.translate_chunks(chunks, cache, shout), "key", "result", "source") == [("a", "cached", "cache"), ("b", "TWO", "translator"), ("c", None, "translator")]


def test_payload_and_cache_key(spark):
    u = spark.createDataFrame([("j", 1, 2, "u2", "b"), ("j", 1, 1, "u1", "a")], "job_id string, chunk int, pos int, unit_id string, source_text string")
    p = translation.payloads(u, ["job_id"], "pos").withColumn("k", translation.cache_key(F.col("payload"), "m", "low")).first()
    assert p.payload.index("u1") < p.payload.index("u2") and len(p.k) == 16


def _event(spark, seq):
    return spark.createDataFrame([("r", i + 1, s, dt.datetime(2024, 1, 1, 0, t), k) for i, (s, t, k) in enumerate(seq)], "run_id string, line_no long, sequence long, time timestamp, type string")


@pytest.mark.parametrize("seq,want", [
    ([(1, 0, "started"), (2, 1, "stage"), (3, 2, "completed")], None), ([(1, 0, "stage"), (2, 1, "completed")], "first_not_started"),
    ([(1, 0, "started"), (2, 1, "started"), (3, 2, "completed")], "started_again"), ([(1, 0, "started"), (1, 1, "completed")], "sequence_not_increasing"),
    ([(1, 5, "started"), (2, 1, "completed")], "time_backwards"), ([(1, 0, "started"), (2, 1, "failed"), (3, 2, "stage")], "after_terminal"),
    ([(1, 0, "started"), (2, 1, "stage")], "no_terminal"), ([(1, 0, "started"), (2, 1, "odd"), (3, 2, "completed")], "unknown_type"),
])
def test_event_protocol(spark, seq, want):
    assert events.run_validity(_event(spark, seq)).first()["first_problem"] == want


def test_progress_rules(spark):
    e = spark.createDataFrame([("r", 1, 1, "started", None, None), ("r", 2, 2, "progress", 5, 4)], "run_id string, line_no int, sequence int, type string, completed int, total int").withColumns(
        {"time": F.current_timestamp(), "stage": F.lit("s")})
    assert events.event_problems(e).where("line_no = 2").first()["problems"] == ["bad_progress"]
    assert events.parse_lines(spark.createDataFrame([('{"type":"started","sequence":1}',), ("junk",)], "value string")).where("type is not null").count() == 1


def _blocks(spark):
    data = [
        ("d", 1, "b1", "A Study", 16.0, True, (0.2, 0.1, 0.8, 0.14)), ("d", 1, "b2", "1 Introduction", 12.0, True, (0.1, 0.2, 0.4, 0.22)),
        ("d", 1, "b3", "We see in Figure 1 that it works and", 10.0, False, (0.1, 0.23, 0.45, 0.3)), ("d", 1, "b4", "then it goes on [1].", 10.0, False, (0.1, 0.31, 0.45, 0.35)),
        ("d", 1, "b5", "Figure 1: A plot", 9.0, False, (0.1, 0.7, 0.45, 0.73)), ("d", 1, "b6", "12", 9.0, False, (0.45, 0.96, 0.55, 0.98)),
        ("d", 2, "b7", "References", 12.0, True, (0.1, 0.1, 0.4, 0.12)), ("d", 2, "b8", "[1] Someone.", 10.0, False, (0.1, 0.15, 0.45, 0.2)),
    ]
    schema = f"doc_id string, page int, block_id string, text string, font_max double, bold boolean, bbox_norm {BOX}"
    return spark.createDataFrame(data, schema).withColumns({"fonts": F.array().cast("array<string>"), "math_ratio": F.lit(0.0)})


def test_layout_to_units(spark):
    pages = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page int")
    b = _blocks(spark)
    assert layout.body_font(b).first()["body_font"] == 10.0
    c = layout.classify(b, pages)
    roles = {r.block_id: r.role for r in c.collect()}
    assert roles["b2"] == "heading" and roles["b5"] == "caption" and roles["b6"] == "furniture" and roles["b3"] == "paragraph" and roles["b7"] == "heading"
    order = layout.global_position(c.withColumn("reading_order", F.substring("block_id", 2, 2).cast("int")))
    s = layout.carry_section(order)
    assert dict(s.select("block_id", "section_id").collect())["b4"] == "sec-1" and dict(s.select("block_id", "section_id").collect())["b8"] == "sec-references"
    body = layout.continue_paragraphs(s.where("role = 'paragraph'"))
    para = dict(body.select("block_id", "paragraph").collect())
    assert para["b3"] == para["b4"] != para["b8"]
    u = semantic.units_of_groups(body.withColumn("paragraph_id", F.col("paragraph").cast("string")))
    first = u.orderBy("position").first()
    assert first.original == "We see in Figure 1 that it works and then it goes on [1]." and first.citations == ["[1]"] and first.object_references == ["Figure 1"]


def test_visual_matching(spark):
    s = spark.createDataFrame([("d", 1, "c1", 1, "v1", 3.0), ("d", 1, "c1", 1, "v2", 3.5), ("d", 1, "c2", 2, "v2", 3.9)], "doc_id string, page int, block_id string, reading_order int, candidate_id string, score double")
    assert rows(layout.match_greedily(s), "block_id", "candidate_id") == [("c1", "v2")]
    a = s.withColumns({"caption_kind": F.lit("figure"), "caption_order": F.col("reading_order"), "visual_order": F.substring("candidate_id", 2, 1).cast("int")})
    assert rows(layout.align_in_order(a), "block_id", "candidate_id") == [("c1", "v1"), ("c2", "v2")]


def test_region_merge_and_parents(spark):
    r = spark.createDataFrame([("d", 1, "a", "graphic", (0.0, 0.0, 1.0, 1.0)), ("d", 1, "b", "table", (0.0, 0.1, 1.0, 1.0)), ("d", 1, "c", "graphic", (5.0, 5.0, 6.0, 6.0))], f"doc_id string, page int, region_id string, kind string, bbox {BOX}")
    assert rows(layout.merge_regions(r), "region_id", "kind") == [("a", "table"), ("c", "graphic")]
    s = spark.createDataFrame([("d", 1, "s1", 1, "One"), ("d", 2, "s2", 2, "Two"), ("d", 3, "s3", 1, "References"), ("d", 4, "s4", 2, "Late")], "doc_id string, position int, section_id string, level int, title string")
    assert rows(layout.section_parents(s), "section_id", "parent_section_id") == [("s1", None), ("s2", "s1"), ("s3", None), ("s4", "s1")]


def test_regions_of_a_page(spark):
    page = spark.createDataFrame([("d", 1, 600.0, 800.0)], "doc_id string, page int, page_width double, page_height double")
    box = f"doc_id string, page int, region_id string, bbox {BOX}"
    tables = spark.createDataFrame([("d", 1, "a", (50.0, 100.0, 250.0, 180.0))], box)
    graphics = spark.createDataFrame([("d", 1, "b", (320.0, 100.0, 560.0, 300.0)), ("d", 1, "part", (320.0, 60.0, 560.0, 214.0)), ("d", 1, "tiny", (300.0, 700.0, 320.0, 710.0))], box)
    blocks = spark.createDataFrame([
        ("d", 1, "1", (50.0, 190.0, 250.0, 200.0), "Table 1: sizes"), ("d", 1, "2", (320.0, 310.0, 560.0, 320.0), "Figure 1. plot"),
        ("d", 1, "3", (150.0, 400.0, 300.0, 420.0), "y = a + b"), ("d", 1, "4", (40.0, 500.0, 280.0, 520.0), "Plain words."),
        ("d", 1, "5", (40.0, 640.0, 280.0, 660.0), "Figure 2. no drawing"),
    ], f"doc_id string, page int, block_id string, bbox {BOX}, text string")
    got = {r.region_id: (r.kind, tuple(r.bbox), r.caption) for r in layout.detect_regions(page, tables, graphics, blocks).collect()}
    assert got == {
        "t:a": ("table", (43.0, 93.0, 257.0, 207.0), "Table 1: sizes"), "f:part": ("figure", (313.0, 53.0, 567.0, 327.0), "Figure 1. plot"),
        "e:3": ("equation", (142.0, 392.0, 308.0, 428.0), "y = a + b"), "c:5": ("figure", (29.0, 518.0, 295.0, 665.0), "Figure 2. no drawing"),
    }
    assert layout.detect_regions(page, tables.limit(0), graphics.limit(0), blocks.limit(0)).count() == 0


def test_raw_markup_is_filtered(spark):
    source = (
        '<svg onload="x()" class="c"><use href="#s"></use><use href="a.svg#s"></use><image href="https://x.org/i.png"></image>'
        '<image href="i.png"></image><image href="./assets/i.png"></image><g fill="url(#f)" style="fill:url(https://x.org/f)"><b>t &amp; u</b></g></svg><a href="javascript:x()">k</a>'
    )
    n = html.parse_html(spark.createDataFrame([("d", source), ("e", None)], "doc_id string, html string"))
    got = html.inner_html(html.raw_nodes(n, ["svg", "g", "use", "image", "a"])).collect()
    assert [tuple(r) for r in got] == [("d", (
        '<svg class="c"><use href="#s"></use><use></use><image></image><image></image><image href="assets/i.png"></image>'
        '<g fill="url(#f)">t &amp; u</g></svg><a>k</a>'
    ))]


def test_reference_anchor(spark):
    u = spark.createDataFrame([
        ("d", "u1", "paragraph", "As shown in Figure 1, yes.", [1], 2.0, ["Figure 1"]), ("d", "u2", "paragraph", "Figure 1 shows more.", [2], 9.0, ["Fig. 1"]), ("d", "u3", "paragraph", "Table 2 is here.", [9], 30.0, ["Table 2"]),
    ], "doc_id string, unit_id string, kind string, original string, pages array<int>, end_position double, object_references array<string>")
    v = spark.createDataFrame([("d", "f1", "Figure 1", 5.0, 1), ("d", "t2", "Table 2", 3.0, 1)], "doc_id string, object_id string, label string, position double, page int")
    assert rows(semantic.reference_anchors(v, u), "object_id", "anchor_unit_id") == [("f1", "u1")]
    score = lambda t: u.limit(1).select(semantic.introduction_score(F.lit(t), F.lit("Figure 1"))).first()[0]
    assert [score(t) for t in ("Figure 1 shows x", "outlined in Figure 1", "shown in Fig. 1", "see Figure 1", "")] == [4, 5, 3, 1, 0]


def test_merge_previous(spark):
    new = spark.createDataFrame([("u1", "a", ""), ("u9", "b", ""), ("u3", "c", "")], "unit_id string, original string, japanese string")
    old = spark.createDataFrame([("u1", "a", "A"), ("u2", "b", "B"), ("u4", "c", "C1"), ("u5", "c", "C2")], new.schema)
    assert rows(translation.merge_previous(new, old, [], "unit_id"), "unit_id", "japanese") == [("u1", "A"), ("u3", ""), ("u9", "B")]


PAGE = """<html><head><title>t</title><meta name="citation_author" content="A"></head><body><article class="ltx_document"><h1 class="ltx_title ltx_title_document">Doc</h1>
<section id="S1"><h2 class="ltx_title">One</h2><div class="ltx_para"><p class="ltx_p">See <cite>[1]</cite> and <a href="#x">link</a> [[PTX_0001]].</p></div>
<figure><figcaption><p class="ltx_p">Cap</p></figcaption></figure></section><section class="ltx_bibliography" id="bib"><p class="ltx_p">Ref</p></section></article>
<script>alert(1)</script><p onclick="x()" style="background:url(http://a)">z</p><a href="javascript:1">bad</a></body></html>"""


def test_html(spark):
    n = html.parse_html(spark.createDataFrame([("d", PAGE), ("e", None), ("f", "<p>a<p>b")], "doc_id string, html string")).cache()
    assert rows(html.unit_nodes(n, "classes").where("doc_id = 'd'"), "kind", "source_text") == [("heading", "One"), ("paragraph", "See [1] and link [[PTX_0001]]."), ("title", "Doc")]
    t = html.tokenize_units(n, html.unit_nodes(n, "classes")).where("translation_source like '%See%'").first()
    assert t.translation_source == "See [[PTX_0002]] and [[PTX_0003]] [[PTX_0001]]." and t.placeholders == {"[[PTX_0002]]": "[1]", "[[PTX_0003]]": "link"}
    two = html.parse_html(spark.createDataFrame([("a", "<article><p>in a</p></article>"), ("b", "<div><div><p>out</p></div></div>")], "doc_id string, html string"))
    assert rows(html.unit_nodes(two), "doc_id", "source_text") == [("a", "in a")]
    clean = html.sanitize(n)
    assert clean.where("tag = 'script'").count() == 0 and clean.where("attrs['onclick'] is not null or attrs['style'] is not null").count() == 0
    assert clean.where("attrs['href'] like 'javascript%'").count() == 0
    assert rows(html.broken_links(n), "target") == [("x",)] and html.page_counts(n).where("doc_id = 'd'").first()["sections"] == 2
    assert html.citation_metadata(n).where("doc_id = 'd'").first()["authors"] == ["A"]
    back = html.inner_html(n.where("doc_id = 'f'")).first()["html"]
    assert back == "<p>a</p><p>b</p>"
    assert rows(html.section_of(n, html.unit_nodes(n, "classes")), "source_text", "section_id")[0] == ("Doc", "front")


def test_markdown(spark):
    schema = ("doc_id string, pos int, kind string, text string, level int, anchor string, asset string, caption string, label string, ordered boolean, start int,"
              " language string, rows array<array<string>>, text_is_markdown boolean")
    b = [
        ("d", 1, "heading", "T *x*", 1, "a", None, None, None, None, None, None, None, False), ("d", 2, "paragraph", "p", None, "a", None, None, None, None, None, None, None, False),
        ("d", 3, "list_item", "one", 1, None, None, None, None, False, None, None, None, False), ("d", 4, "list_item", "two", 1, None, None, None, None, True, 2, None, None, False),
        ("d", 5, "code", "x ``` y", None, None, None, None, None, None, None, "py", None, False), ("d", 6, "table", "", None, None, None, "cap", None, None, None, None, [["a", "b|c"], ["d"]], False),
        ("d", 7, "equation", "a=b", None, None, None, None, None, None, None, None, None, False), ("d", 8, "figure", "", None, None, "assets/f.png", "c", "Figure 1", None, None, None, None, False),
    ]
    got = markdown.serialize(spark.createDataFrame(b, schema)).first()["markdown"]
    assert got == (
        '<a id="a"></a>\n\n# T \\*x\\*\n\n<a id="a-2"></a>\n\np\n\n- one\n2. two\n\n````py\nx ``` y\n````\n\n*cap*\n\n| a | b\\|c |\n| --- | --- |\n| d |  |\n\n$$\na=b\n$$\n\n![Figure 1](assets/f.png)\n\n*c*\n'
    )
    q = markdown.markdown_qa(spark.createDataFrame([("d", got), ("e", "[x](#none)\n"), ("f", "```\n[x](#none)\n```\n")], "doc_id string, markdown string"))
    assert rows(q, "doc_id", "status") == [("d", "passed"), ("e", "failed"), ("f", "passed")]
    links = spark.createDataFrame([("see http://a.org/x_(y)). ok",)], "t string").select(markdown.with_external_links("t")).first()[0]
    assert links == r"see [http://a.org/x\_(y)](http://a.org/x_(y))). ok"
    assert "<h1" in markdown.html_page(spark.createDataFrame(b, schema), "v1").first()["html"]


def _document(spark):
    u = spark.createDataFrame([("d", "u1", "paragraph", "s1", "text", ["b1"], ["Figure 1"], 0.9)], "doc_id string, unit_id string, kind string, section_id string, original string, source_block_ids array<string>, object_references array<string>, confidence double")
    v = spark.createDataFrame([("d", "v1", 1, "figure", "Figure 1", (0.1, 0.5, 0.9, 0.9), ["b2"], "assets/v.png")], f"doc_id string, object_id string, page int, kind string, label string, bbox_norm {BOX}, caption_block_ids array<string>, asset string")
    b = spark.createDataFrame([("d", 1, "b1", "text", (0.1, 0.1, 0.9, 0.2)), ("d", 1, "b0", "Head", (0.1, 0.0, 0.9, 0.05)), ("d", 1, "b2", "cap", (0.1, 0.91, 0.9, 0.95))], f"doc_id string, page int, block_id string, text string, bbox_norm {BOX}")
    a = spark.createDataFrame([("d", "b1", "paragraph", False), ("d", "b0", "heading", False), ("d", "b2", "caption", False)], "doc_id string, block_id string, role string, hidden boolean")
    s = spark.createDataFrame([("d", "s1", "b0", None)], "doc_id string, section_id string, title_block_id string, parent_section_id string")
    return {"documents": spark.createDataFrame([("d", "T")], "doc_id string, title string"), "units": u, "visuals": v, "blocks": b, "assignments": a, "sections": s}


def test_qa(spark):
    t = _document(spark)
    assert qa.findings(t).collect() == [] and qa.status(t["documents"], qa.findings(t)).first()["status"] == "passed"
    bad = {
        "block_represented_twice": ("units", lambda d: d.union(d.withColumn("unit_id", F.lit("u2")))), "blank_unit": ("units", lambda d: d.withColumn("original", F.lit(" "))),
        "unknown_section": ("units", lambda d: d.withColumn("section_id", F.lit("zz"))), "block_not_represented": ("units", lambda d: d.withColumn("source_block_ids", F.array().cast("array<string>"))),
        "hidden_block_shown": ("assignments", lambda d: d.withColumn("hidden", F.col("block_id") == "b1")), "asset_not_local": ("visuals", lambda d: d.withColumn("asset", F.lit("http://x"))),
        "unresolved_reference": ("visuals", lambda d: d.withColumn("label", F.lit("Figure 2"))), "text_under_visual": ("visuals", lambda d: d.withColumn("bbox_norm", G.rect(0, 0, 1, 0.3))),
        "no_title": ("documents", lambda d: d.withColumn("title", F.lit(""))), "unknown_parent": ("sections", lambda d: d.withColumn("parent_section_id", F.lit("q"))),
    }
    for rule, (name, change) in bad.items():
        assert rule in {r.rule for r in qa.findings({**t, name: change(t[name])}).collect()}


def test_evaluation(spark):
    g = spark.createDataFrame([("d", 1, "b1", "heading", False), ("d", 1, "b2", "paragraph", False), ("d", 1, "b3", "paragraph", True)], "doc_id string, page int, block_id string, role string, hidden boolean")
    c = spark.createDataFrame([("d", 1, "b1", "heading", False), ("d", 1, "b2", "heading", False), ("d", 2, "b9", "heading", False)], g.schema)
    s = spark.createDataFrame([("d", "s1", "1")], "doc_id string, section_id string, number string")
    v = spark.createDataFrame([("d", 1, "figure", "v1", 1, "Figure 1", (0.0, 0.0, 1.0, 1.0))], f"doc_id string, page int, kind string, object_id string, ordinal int, label string, bbox_norm {BOX}")
    w = spark.createDataFrame([("d", 1, "figure", "w1", 1, "figure 1", (0.0, 0.0, 1.0, 0.5))], v.schema)
    e = evaluation.evaluate({"assignments": g, "sections": s, "visuals": v}, {"assignments": c, "sections": s, "visuals": w}).first()
    assert (e.shared, e.role_accuracy, e.heading_precision, e.heading_recall, e.section_f1, e.matched, e.mean_iou) == (2, 0.5, 0.5, 1.0, 1.0, 1, 0.5)


def test_contracts(spark):
    good = dict(run_id="run-12345678", media_type="application/pdf", sha256="a" * 64, bytes=10, source_language="en", target_language="ja", profile_id="p", provider_id="q", model_id="m",
                prompt_revision="r1", glossary_sha256=None, outputs=["mono"], max_pages=10, max_output_bytes=100, deadline_seconds=60)
    schema = ("run_id string, media_type string, sha256 string, bytes long, source_language string, target_language string, profile_id string, provider_id string, model_id string, prompt_revision string,"
              " glossary_sha256 string, outputs array<string>, max_pages int, max_output_bytes long, deadline_seconds int")
    broken = {"sha256": "x", "target_language": "en", "outputs": ["mono", "mono"], "max_pages": 0, "run_id": None}
    data = [good, *({**good, k: v} for k, v in broken.items())]
    got = [r.p for r in spark.createDataFrame([tuple(d[c.split()[0]] for c in schema.split(", ")) for d in data], schema).select(contracts.request_problem().alias("p")).collect()]
    assert got == [None, "sha256", "same_language", "repeated_output", "max_pages", "run_id"]
    r = spark.createDataFrame([('{"a":1}',), ("[" * 12 + "]" * 12,), ('{"token":"x"}',), ("nope",)], "j string").select(contracts.report_problem(F.col("j")).alias("p")).collect()
    assert [x.p for x in r] == [None, "too_deep", "forbidden_key", "not_json"]
    o = spark.createDataFrame([("d", 1, None, True), ("d", 2, "JavaScript", False), ("d", 3, "Launch", False)], "doc_id string, object_id int, action string, is_root boolean")
    e = spark.createDataFrame([("d", 1, 2), ("d", 2, 1)], "doc_id string, object_id int, target_id int")
    assert rows(contracts.active_objects(o, e), "object_id") == [(2,)]


def test_budget_is_sticky(spark):
    r = spark.createDataFrame([("d", 1, 5), ("d", 2, 20), ("d", 3, 1)], "doc_id string, k int, n int")
    assert [x.allowed for x in contracts.budget(r, ["doc_id"], "k", "n", 10, 10).orderBy("k").collect()] == [True, False, False]


def test_graph(spark):
    items = spark.createDataFrame([("d", r, layer) for r, layer in [("a", "body"), ("b", "body"), ("c", "body"), ("h", "furniture"), ("o", "body")]], "doc_id string, ref string, content_layer string")
    e = spark.createDataFrame([("d", "#/body", 1, "b"), ("d", "#/body", 0, "a"), ("d", "a", 0, "c"), ("d", "c", 0, "a")], "doc_id string, parent_ref string, ordinal int, child_ref string")
    got = graph.walk(items, e).orderBy("order_class", "visit", "ref")
    assert [r.ref for r in got.collect()] == ["a", "c", "b", "o", "h"]
    p = spark.createDataFrame([("d", "t", 0, 1, 0, 5), ("d", "t", 1, 2, 6, 11)], "doc_id string, ref string, ordinal int, page int, span_start int, span_end int")
    s = graph.partition_spans(p, spark.createDataFrame([("d", "t", "hello world")], "doc_id string, ref string, text string"))
    assert rows(s, "part", "sound") == [("hello", True), ("world", True)]


def test_router(spark):
    c = spark.createDataFrame([("p", "1", "pdf", True, "open", "exact", "passed", True, 0.9, 0.0, False), ("p", "2", "official_html", True, "open", "exact", "passed", True, 0.9, 0.0, False),
                               ("p", "3", "native_xml", False, "open", "exact", "passed", True, 0.9, 0.0, False)],
                              "paper_id string, candidate_id string, kind string, available boolean, access string, identity_match string, validation string, full_text boolean, usable_text_ratio double, garbled_ratio double, allow_equivalent boolean")
    assert rows(contracts.route_sources(c), "candidate_id", "rejected", "chosen") == [("1", None, False), ("2", None, True), ("3", "unavailable", False)]


def test_sources_and_sinks(spark, tmp_path):
    s = spark.createDataFrame([('{"a":1,"a":2}',), ('{"a":NaN}',), ("{",), ('{"a":1}',)], "t string").select(readers.strict_json_problem("t").alias("p")).collect()
    assert [r.p for r in s] == ["duplicate_key", "non_finite", "unreadable", None]
    assert spark.range(1).select(readers.lenient_json(F.lit('say {"x":1} end')).isNotNull()).first()[0]
    m = spark.createDataFrame([("r", 1, '{"type":"x","item":{"type":"agent_message","text":"one"}}'), ("r", 2, "junk"), ("r", 3, '{"type":"u","usage":{"input_tokens":3,"output_tokens":4}}')], "run_id string, line_no int, value string")
    assert tuple(readers.model_events(m).first()) == ("r", "one", 3, 4)
    u = readers.url_candidates(spark.createDataFrame([("https://a.org/x/y", "i.png")], "base string, raw string"))
    assert [r.url for r in u.orderBy("k").collect()] == ["https://a.org/x/i.png", "https://a.org/x/y/i.png"]
    df = spark.range(3)
    sinks.write_snapshot(df, str(tmp_path / "t"))
    sinks.write_snapshot(df.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert sinks.bundle([("b", b"1"), ("a", b"2")])[:2] == b"PK"
    assert spark.range(1).select(sinks.page_map(F.lit(2), F.lit(True))).first()[0] == [[1, 2], [3, 4]]


def test_descendants_and_overrides(spark):
    s = spark.createDataFrame([("d", "a", None), ("d", "b", "a"), ("d", "c", "b"), ("d", "x", "y"), ("d", "y", "x")], "doc_id string, section_id string, parent_section_id string")
    assert {("a", "b"), ("a", "c"), ("b", "c")} <= set(rows(semantic.descendants(s), "ancestor", "section_id"))
    base = spark.createDataFrame([("d", 1, "old"), ("d", 2, "old")], "doc_id string, page int, v string")
    assert rows(semantic.override_pages(base, spark.createDataFrame([("d", 2, "new")], base.schema), []), "page", "v") == [(1, "old"), (2, "new")]


def test_closures_have_no_depth_limit(spark):
    n = 120
    chain = [("d", f"n{i}", 0, f"n{i + 1}") for i in range(n)] + [("d", f"n{n}", 0, "n0"), ("d", "#/body", 0, "n0")]
    e = spark.createDataFrame(chain, "doc_id string, parent_ref string, ordinal int, child_ref string")
    items = spark.createDataFrame([("d", f"n{i}", "body") for i in range(n + 1)], "doc_id string, ref string, content_layer string")
    assert [r.ref for r in graph.walk(items, e).orderBy("visit").collect()] == [f"n{i}" for i in range(n + 1)]
    o = spark.createDataFrame([("d", i, "Launch" if i == n else None, i == 0) for i in range(n + 1)], "doc_id string, object_id int, action string, is_root boolean")
    links = spark.createDataFrame([("d", i, i + 1) for i in range(n)] + [("d", n, 0)], "doc_id string, object_id int, target_id int")
    assert rows(contracts.active_objects(o, links), "object_id") == [(n,)]
    s = spark.createDataFrame([("d", f"s{i}", f"s{i - 1}" if i else None) for i in range(n)], "doc_id string, section_id string, parent_section_id string")
    assert semantic.descendants(s).count() == n * (n - 1) // 2
    p = spark.createDataFrame([("d", i, i - 1 if i else None, i == 0) for i in range(n)] + [("d", 900, 901, False), ("d", 901, 900, False)], "doc_id string, block_id int, parent_id int, survives boolean")
    r = spark.createDataFrame([("d", "a", n - 1), ("d", "b", 900), ("d", "c", 77777), ("d", "x", None)], "doc_id string, row string, anchor int")
    assert rows(semantic.reanchor(r, p), "row", "anchor") == [("a", 0), ("b", None), ("c", 77777), ("x", None)]
    v = spark.createDataFrame([("d", "n10")], "doc_id string, ref string")
    gone = graph.suppressed(e, v, spark.createDataFrame([("d", "n50")], v.schema), spark.createDataFrame([("d", "n100")], v.schema))
    free = {f"n{i}" for i in [*range(100, n + 1), *range(10)]}
    assert {r.ref for r in gone.collect()} == {f"n{i}" for i in range(11, n + 1)} - free - {"n50"}


def test_furniture_is_inherited_and_the_rest_follows(spark):
    items = spark.createDataFrame([("d", "a", None), ("d", "f", "furniture"), ("d", "g", None), ("d", "z", None), ("d", "k", None)], "doc_id string, ref string, content_layer string")
    e = spark.createDataFrame([("d", "#/body", 0, "f"), ("d", "f", 0, "g"), ("d", "#/body", 1, "a"), ("d", "#/furniture", 0, "k"), ("d", "a", 0, "nowhere")], "doc_id string, parent_ref string, ordinal int, child_ref string")
    got = {r.ref: (r.visit, r.order_class) for r in graph.walk(items, e).collect()}
    assert got == {"f": (1, 2), "g": (2, 2), "a": (3, 0), "k": (4, 2), "z": (None, 1)}
    d = spark.createDataFrame([("b", 1, None, 0.0, 0.0), ("a", None, 2, 0.5, 0.0), ("c", None, None, 0.0, 0.0), ("e", None, 2, 0.1, 0.9)], "ref string, visit int, page int, y double, x double")
    assert [r.ref for r in d.orderBy(*graph.fallback_order(*[F.col(c) for c in ("visit", "page", "y", "x", "ref")])).collect()] == ["b", "e", "a", "c"]


def test_locks_have_one_owner(spark, tmp_path):
    path = f"file://{tmp_path}/lock"
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda k: sinks.claim(spark, path, f"o{k}"), range(6)))
    assert sum(got) == 1
    owner = f"o{got.index(True)}"
    assert not sinks.release(spark, path, "somebody") and not sinks.claim(spark, path, "late")
    assert sinks.claim(spark, path, "late", stale_seconds=-1) and not sinks.release(spark, path, owner)
    assert sinks.release(spark, path, "late") and sinks.claim(spark, path, "next")


def test_plugins_capture_failures(spark):
    papers = spark.createDataFrame([("p", b"two words"), ("q", b"bad")], "doc_id string, content binary")

    def words(content):
        if content == b"bad":
            raise ValueError("no")
        return [(1, f"b{i}", "body", w, 0.5) for i, w in enumerate(content.decode().split())]

    blocks = plugins.run_parsers(papers, {"words": words, "one": lambda c: [(1, "b", "body", c.decode(), 1.0)]})
    assert rows(plugins.parser_status(blocks), "parser", "papers", "failed", "blocks") == [("one", 2, 0, 2), ("words", 2, 1, 2)]
    assert rows(blocks.where("error is not null"), "doc_id", "error") == [("q", "ValueError")]

    def reviewer(request):
        if '"page":2' in request or not request.startswith('{"page"'):
            raise KeyError(request)
        return "fine"

    asked = spark.createDataFrame([("p", [1, 2, 3], "[]")], "doc_id string, pages array<int>, request string")
    assert rows(plugins.review_pages(asked, reviewer), "page", "proposal", "error") == [(1, "fine", None), (2, None, "KeyError"), (3, "fine", None)]
    base = spark.createDataFrame([("p", 1, "old"), ("p", 2, "old")], "doc_id string, page int, v string")
    sure = spark.createDataFrame([("p", 1, 0.9), ("p", 2, 0.1)], "doc_id string, page int, confidence double")
    assert rows(plugins.selective_review(base, sure, lambda weak: weak.withColumn("v", F.lit("new"))), "page", "v") == [(1, "old"), (2, "new")]


def test_paths_requests_and_recovered_blocks(spark):
    d = spark.createDataFrame([("a/b.html", "html"), ("../x.html", "html"), ("a/../../x.html", "html"), ("/x.html", "html"), ("a/b.md", "html"), ("", "html"), ("C:x.html", "html"), ("a\\b.html", "html"), ("a/../b.HTML", "html")], "p string, k string")
    got = [r.x for r in d.select(contracts.artifact_path_problem(F.col("p"), F.col("k"), {"html": ["html"]}).alias("x")).collect()]
    assert got == [None, "outside", "outside", "absolute", "extension", "empty", "absolute", "character", None]
    s = spark.createDataFrame([("r", ("x", 5, "en", "ja"), ("x", 6, "en", None))], "run string, s struct<sha256:string,bytes:long,source_language:string,target_language:string>, t struct<sha256:string,bytes:long,source_language:string,target_language:string>")
    r = s.select(contracts.candidate_request(F.col("run"), F.col("s"), F.lit("g"), ["mono"], 3, 60).alias("q"), "s", "t").select("q.*", contracts.provenance_mismatches(F.col("s"), F.col("t"), ["sha256", "bytes", "target_language"]).alias("m")).first()
    assert (r.run_id, r.bytes, r.outputs, r.m) == ("r", 5, ["mono"], ["bytes", "target_language"])
    b = spark.createDataFrame([(1, "old", "x", True, ["w"]), (2, "two", "y", True, ["w"])], "id int, text string, role string, hidden boolean, warnings array<string>")
    new = spark.createDataFrame([(1, "new", "body")], "id int, text string, role string")
    assert rows(layout.set_recovered(b, new, ["id"]), "text", "role", "hidden", "warnings") == [("new", "body", False, []), ("two", "y", True, ["w"])]
    p = spark.createDataFrame([("d", 3, [(1, "f"), (2, "t")])], "doc_id string, page int, visuals array<struct<v:int,kind:string>>")
    assert rows(layout.flatten_visuals(p), "page", "k", "v", "kind") == [(3, 0, 1, "f"), (3, 1, 2, "t")]
    assert spark.range(1).select(qa.distinct_authors(F.array(F.lit("A  B"), F.lit(" "), F.lit("a b"), F.lit("C")))).first()[0] == ["A B", "C"]
    x = spark.createDataFrame([("d", 1), ("d", 1), ("d", 2)], "doc_id string, b int")
    assert rows(qa.unrepresented(x, x.where("b = 2"), ["doc_id", "b"]), "b") == [(1,)]


def test_nodes_say_what_the_page_says(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("doc_id", F.col("page_id").cast("string"))
    nodes = {}
    for r in html.parse_html(pages).orderBy("doc_id", "pre").collect():
        nodes.setdefault(r.doc_id, []).append(r)
    for p in pages.collect():
        source = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", "", p.html or "")
        own = nodes.get(p.doc_id, [])
        scripts = re.findall(r"(?s)<(?:script|style)[^>]*>(.*?)</(?:script|style)>", source)
        plain = re.sub(r"(?s)(<(script|style)[^>]*>).*?(</\2>)", r"\1\3", source)
        tags = [t.lower() for t in re.findall(r"<([a-zA-Z][a-zA-Z0-9]*)", plain)]
        assert [r.tag for r in own if r.type == "element"] == tags
        text = "".join(r.text for r in own if r.type == "text" and r.text not in scripts)
        assert text == entities.unescape(re.sub(r"<[^>]+>", "", plain))
        up = {r.node_id: r for r in own}
        for r in own:
            if r.parent_id is not None:
                q = up[r.parent_id]
                assert q.pre < r.pre <= r.post <= q.post and r.depth == q.depth + 1


def test_units_are_headings_and_paragraphs_of_the_article(spark):
    page = "<nav><p>menu</p></nav><article><h1>A &amp; b</h1><p>one <b>two</b></p><figure><p>fig</p></figure><p>12 34</p><p>last</p></article><p>out</p>"
    n = html.node_table(spark.createDataFrame([("d", page), ("e", None)], "doc_id string, html string"))
    got = html.unit_nodes(n).orderBy("unit_id").collect()
    assert [(r.unit_id, r.kind, r.source_text) for r in got] == [("html-0001", "heading", "A & b"), ("html-0002", "paragraph", "one two"), ("html-0003", "paragraph", "last")]


def test_visuals_take_the_best_unused_candidate(spark):
    rng = random.Random(7)
    box = lambda: tuple(sorted(rng.randrange(8) / 8 for _ in range(2)) + sorted(rng.randrange(8) / 8 for _ in range(2)))
    side = lambda n: [("d%d" % rng.randrange(2), rng.randrange(3), rng.choice(["figure", "table"]), rng.choice([None, "", "Fig 1", "FIG 1", "Fig 2"]), i, rng.randrange(9), box()) for i in range(n)]
    gold, other = side(80), side(60)
    schema = "doc_id string, page int, kind string, label string, object_id long, ordinal int, b struct<x0:double,x1:double,y0:double,y1:double>"
    frame = lambda r: spark.createDataFrame(r, schema).withColumn("bbox_norm", F.struct("b.x0", "b.y0", "b.x1", "b.y1")).drop("b")

    def iou(a, b):
        both = max(0, min(a[1], b[1]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[2], b[2]))
        union = (a[1] - a[0]) * (a[3] - a[2]) + (b[1] - b[0]) * (b[3] - b[2]) - both
        return both / union if union > 0 else 0.0

    want, used = set(), set()
    for g in sorted(gold, key=lambda g: (g[5], g[4])):
        own = (g[3] or "").lower()
        fits = [c for c in other if c[:3] == g[:3] and own in ("", (c[3] or "").lower()) and c[4] not in used]
        if fits:
            best = min(fits, key=lambda c: (-iou(g[6], c[6]), c[4]))
            used.add(best[4])
            want.add((g[0], g[1], g[4], best[4], iou(g[6], best[6])))
    got = evaluation.match_visuals(frame(gold), frame(other)).select("doc_id", "page", "object_id", "candidate_id", "iou").collect()
    assert len(got) == len(want) > 20 and {tuple(r) for r in got} == want


def test_a_page_of_many_labelled_visuals_takes_time_in_proportion(spark):
    v = spark.range(20_000).select(
        F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.lit("figure").alias("kind"), F.concat(F.lit("Figure "), F.col("id").cast("string")).alias("label"),
        F.col("id").alias("object_id"), F.col("id").alias("ordinal"), G.rect(0, 0, 1, 1).alias("bbox_norm"))
    begun = time.time()
    m = evaluation.match_visuals(v, v.withColumn("label", F.upper("label")))
    assert m.agg(F.count_if(F.expr("object_id = candidate_id and iou = 1.0")), F.count("*")).first()[:] == (20_000, 20_000)
    assert time.time() - begun < 20
