"""Queries of the source, contract and sink operators over whole tables, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, evaluation, html, library, semantic
from ..sources import readers, sinks
from ..session import table
from .registry import query
from .relation_queries import _BOXES, _H, _W, _blocks, _boxes
from .repair_queries import _pages
from .scalar_queries import _docs

# --------------------------------------------------------------------------- sources


@query("""with u as (select page_id, url as base, case page_id % 4 when 0 then 'img/x.png' when 1 then '/top.png' when 2 then '//cdn.org/y.png' else 'https://z.org/q.png' end as raw from pages),
  c as (select page_id, case when regexp_matches(raw, '^[a-z]+://') then raw when raw like '//%' then concat(regexp_extract(base, '^([a-z]+:)', 1), raw) when raw like '/%' then concat(regexp_extract(base, '^([a-z]+://[^/]+)', 1), raw)
      else concat(regexp_replace(regexp_replace(base, '[?#].*$', ''), '/[^/]*$', '/'), raw) end as a, case when not regexp_matches(raw, '^[a-z]+://|^/') then concat(regexp_replace(base, '[?#].*$|/+$', '', 'g'), '/', raw) end as b from u)
  select page_id, 0 as k, a as url from c union all select page_id, 1, b from c where b is not null and b <> a""")
def asset_urls(spark, sf):
    k = F.col("page_id") % 4
    raw = F.when(k == 0, "img/x.png").when(k == 1, "/top.png").when(k == 2, "//cdn.org/y.png").otherwise("https://z.org/q.png")
    return readers.url_candidates(table(spark, sf, "pages").select("page_id", F.col("url").alias("base"), raw.alias("raw"))).select("page_id", "k", "url")


@query("""select user_id, case when count(*) filter (event_type = 'purchase') > 0 then arg_min(cast(event_id as varchar), event_id) filter (event_type = 'purchase') end as url,
  case when count(*) filter (event_type = 'purchase') = 0 then string_agg(event_type, '; ' order by event_id) end as errors from events group by user_id""")
def first_successes(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("k"), F.col("event_id").cast("string").alias("url"), (F.col("event_type") == "purchase").alias("ok"), F.col("event_type").alias("error"))
    return readers.first_success(e, ["user_id"])


@query("select doc_id, case doc_id % 4 when 0 then 'duplicate_key' when 1 then 'non_finite' when 2 then 'unreadable' end as problem from documents")
def json_problems(spark, sf):
    k = F.col("doc_id") % 4
    own = F.to_json(F.struct("text"))
    t = F.when(k == 0, F.concat(F.lit('{"a":1,"a":'), own, F.lit("}"))).when(k == 1, F.concat(F.lit('{"a":NaN,"b":'), own, F.lit("}"))).when(k == 2, F.concat(F.lit("{"), own)).otherwise(own)
    return _docs(spark, sf).select("doc_id", readers.strict_json_problem(t).alias("problem"))


@query("select doc_id, case when doc_id % 3 < 2 then n_chars end as n from documents")
def lenient_values(spark, sf):
    own = F.to_json(F.struct("n_chars"))
    k = F.col("doc_id") % 3
    t = F.when(k == 0, own).when(k == 1, F.concat(F.lit("here it is:\n"), own, F.lit(" as asked"))).otherwise("none at all")
    return _docs(spark, sf).select("doc_id", F.try_variant_get(readers.lenient_json(t), "$.n_chars", "long").alias("n"))


@query("""select conv_id, arg_max(text, turn) filter (role = 'assistant' and turn % 4 <> 3) as message, cast(sum(case when role = 'user' then turn else 0 end) as bigint) as input_tokens, cast(sum(case when role = 'user' then 1 else 0 end) as bigint) as output_tokens
  from conversations where turn % 4 <> 3 group by conv_id""")
def model_runs(spark, sf):
    c = table(spark, sf, "conversations")
    item = F.when(F.col("role") == "assistant", F.struct(F.lit("agent_message").alias("type"), F.col("text").alias("text")))
    usage = F.when(F.col("role") == "user", F.struct(F.col("turn").alias("input_tokens"), F.lit(1).alias("output_tokens")))
    line = F.to_json(F.struct(F.lit("t").alias("type"), item.alias("item"), usage.alias("usage")))
    lines = c.select("conv_id", "turn", F.when(F.col("turn") % 4 == 3, "junk").otherwise(line).alias("value"))
    return readers.model_events(lines, "conv_id", "turn")


@query("select source as job_id, arg_min(doc_id, (n_chars % 3, -doc_id)) as doc_id from documents where source is not null group by source")
def first_manifests(spark, sf):
    m = _docs(spark, sf).select(F.col("source").alias("job_id"), "doc_id", (F.col("n_chars") % 3).alias("priority"), F.col("doc_id").alias("updated_at"))
    return readers.list_jobs(m).select("job_id", "doc_id")


@query("select source as slug, arg_min(doc_id, n_chars * 10000000 + doc_id) as doc_id from documents where source is not null and lang is not null and lang <> 'de' group by source")
def sound_manifests(spark, sf):
    m = _docs(spark, sf).where("source is not null").select(F.col("source").alias("slug"), "doc_id", F.when(F.col("lang") == "de", " ").otherwise(F.col("lang")).alias("job_id"), F.lit("t").alias("title"), (F.col("n_chars") * 10_000_000 + F.col("doc_id")).alias("priority"))
    return library.pick_manifest(m).select("slug", "doc_id")


@query("select doc_id, case when doc_id % 3 = 0 then 'too_slow' when doc_id % 3 = 1 then 'not_pdf' end as problem from documents")
def upload_checks(spark, sf):
    k = F.col("doc_id") % 3
    body = F.encode(F.concat(F.when(k == 1, "%PS").otherwise("%PDF-1.7 "), "text"), "utf-8")
    return _docs(spark, sf).select("doc_id", readers.upload_problem(body, F.when(k == 0, 61).otherwise(60)).alias("problem"))


@query("select doc_id from documents where text in (select text from documents where doc_id in (select doc_id from labels where quality = 1))")
def known_uploads(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    stored = _docs(spark, sf).join(good, "doc_id", "left_semi").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return readers.duplicate_sources(_docs(spark, sf).select("doc_id", F.col("text").alias("content")), stored).select("doc_id")


@query("select conv_id as doc_id, turn // 3 + 1 as page, turn, role from conversations")
def nested_pages(spark, sf):
    b = _blocks(spark, sf).groupBy("doc_id", F.col("page").cast("long").alias("page")).agg(F.collect_list(F.struct("turn", "role")).alias("blocks"))
    return readers.flatten_pages(b.groupBy("doc_id").agg(F.collect_list(F.struct("page", "blocks")).alias("pages")))


@query("select doc_id, case when doc_id % 2 = 0 then lang end as lang, case when doc_id % 2 = 0 then n_chars end as n from documents")
def typed_documents(spark, sf):
    t = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("lang", "n_chars", "text"))).otherwise("{{")
    d = readers.json_documents(_docs(spark, sf).select("doc_id", t.alias("v")), "v", "lang string, n_chars long")
    return d.select("doc_id", "document.lang", F.col("document.n_chars").alias("n"))


# --------------------------------------------------------------------------- pages


@query("select page_id, concat('T', page_id) as title, 'B A|C' as authors, case when page_id % 2 = 0 then '2024' else '2023' end as date from pages")
def page_citations(spark, sf):
    n = F.col("page_id").cast("string")
    head = F.concat(F.lit('<meta name="citation_title" content="T'), n, F.lit('"><meta name="citation_author" content="B A"><meta name="citation_author" content="C"><meta name="citation_author" content="B A"><meta name="citation_online_date" content="2023">'),
                    F.when(F.col("page_id") % 2 == 0, '<meta name="citation_date" content="2024">').otherwise(""))
    m = html.citation_metadata(html.parse_html(_pages(spark, sf, head=head)))
    return m.select(F.col("doc_id").cast("long").alias("page_id"), "title", F.array_join("authors", "|").alias("authors"), "date")


@query("select page_id, concat('T', page_id) as title, 'B A|C' as authors from pages")
def page_meta_by_pattern(spark, sf):
    head = F.concat(F.lit("<meta  name='citation_title' content='T"), F.col("page_id").cast("string"), F.lit("'><META name=\"citation_author\" content=\"B A\"><meta name=\"citation_author\" content=\"C\">"))
    p = table(spark, sf, "pages").select("page_id", F.concat(head, "html").alias("html"))
    return library.source_metadata(p).select("page_id", F.col("meta_title").alias("title"), F.array_join("meta_authors", "|").alias("authors"))


@query("select page_id, concat('assets/', page_id, '.png') as asset from pages")
def page_assets(spark, sf):
    n = F.col("page_id").cast("string")
    tail = F.concat(F.lit('<img src="assets/'), n, F.lit('.png"><img src="assets/'), n, F.lit('.png"><img src="https://x.org/a.png"><a href="assets/../x">q</a>'))
    return html.local_assets(html.parse_html(_pages(spark, sf, tail=tail))).select(F.col("doc_id").cast("long").alias("page_id"), "asset")


@query("select page_id, case page_id % 3 when 0 then 'x^2' when 1 then 'alt' else 'shown' end as tex from pages")
def page_formulas(spark, sf):
    k = F.col("page_id") % 3
    head = F.when(k == 0, '<math alttext="alt"><mi>shown</mi><annotation encoding="application/x-tex"> x^2 </annotation></math>').when(k == 1, '<math alttext="alt"><mi>shown</mi></math>').otherwise("<math><mi>shown</mi></math>")
    return html.math_source(html.node_table(_pages(spark, sf, head=head))).select(F.col("doc_id").cast("long").alias("page_id"), "tex")


@query("select p_partkey, least(4.0, 8192 / greatest(p_size * 400, p_partkey + 1), sqrt(32000000 / (p_size * 400.0 * (p_partkey + 1)))) as scale from part")
def raster_scales(spark, sf):
    return table(spark, sf, "part").select("p_partkey", html.normalise_scale(F.col("p_size") * 400.0, (F.col("p_partkey") + 1).cast("double")).alias("scale"))


@query("select page_id, 'b' as id from pages union all select page_id, 'c' from pages")
def error_regions(spark, sf):
    head = F.lit('<section><div class="ltx_para" id="a">1</div><div class="ltx_para" id="b"><span class="ltx_ERROR">2</span></div><div class="x ltx_para" id="c">3</div></section>')
    o = html.opaque_siblings(html.node_table(_pages(spark, sf, head=head)))
    return o.select(F.col("doc_id").cast("long").alias("page_id"), html.attr("id").alias("id"))


@query("select page_id, concat('see [[PTX_0002]] and [[PTX_0001]] in [[PTX_0003]] n', page_id) as source, 'one|two w' as texts from pages")
def tokenized_units(spark, sf):
    head = F.concat(F.lit('<article><p id="u">see <code>one</code> and [[PTX_0001]] in <a href="x"><b>two</b> w</a> n'), F.col("page_id").cast("string"), F.lit("</p></article>"))
    n = html.node_table(_pages(spark, sf, head=head))
    u = n.where(html.attr("id") == "u").join(html.plain_text(n, n.where(html.attr("id") == "u")).withColumnRenamed("text", "source_text"), ["doc_id", "node_id"], "inner")
    u = u.drop("text").withColumn("unit_id", F.lit("u"))
    t = html.tokenize_units(n, u)
    return t.select(F.col("doc_id").cast("long").alias("page_id"), F.col("translation_source").alias("source"), F.array_join(F.transform(F.array_sort(F.map_entries("placeholders")), lambda e: e["value"]), "|").alias("texts"))


# --------------------------------------------------------------------------- contracts, evaluation, sinks


@query("""select doc_id, case doc_id % 5 when 0 then 'host' when 1 then 'cross_site' when 2 then 'origin' when 3 then 'media_type' end as problem from documents""")
def request_boundaries(spark, sf):
    k = F.col("doc_id") % 5
    d = _docs(spark, sf).select(
        "doc_id", F.lit("POST").alias("method"), F.when(k == 0, "evil.org:80").otherwise("localhost:3000").alias("host"), F.when(k == 1, "cross-site").otherwise("same-origin").alias("fetch_site"),
        F.when(k == 2, "http://evil.org").otherwise("http://localhost:3000").alias("origin"), F.when(k == 3, "text/plain").otherwise("application/json; charset=utf-8").alias("media_type"),
    )
    return d.select("doc_id", contracts.boundary_problem(["localhost", "127.0.0.1"]).alias("problem"))


@query("""select doc_id, case doc_id % 6 when 0 then 'role' when 1 then 'missing_file' when 2 then 'path' when 3 then 'sha256' when 4 then 'bytes' else case when n_chars > 5 * 100 then 'too_large' end end as problem from documents""")
def result_checks(spark, sf):
    k = F.col("doc_id") % 6
    d = _docs(spark, sf).select(
        "doc_id", F.when(k == 0, "other").otherwise("mono_pdf").alias("role"), F.when(k == 2, "../x").otherwise("a/x.pdf").alias("path"), F.when(k != 1, F.when(k == 3, "e").otherwise("d")).alias("staged_sha256"), F.lit("d").alias("sha256"),
        F.col("n_chars").alias("bytes"), F.when(k == 4, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("staged_bytes"), F.lit(100).alias("source_bytes"),
    )
    return d.select("doc_id", contracts.result_problem().alias("problem"))


@query("""select doc_id, case doc_id % 5 when 0 then 'not_json' when 1 then 'too_deep' when 2 then 'forbidden_key' when 3 then case when octet_length(encode(text)) > 60000 then 'too_large' when length(text) > 1000 then 'long_string' end end as problem from
  (select doc_id, replace(replace(replace(text, '\\', ''), '"', ''), chr(10), ' ') as text from documents)""")
def report_checks(spark, sf):
    k = F.col("doc_id") % 5
    plain = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("")), F.lit('"'), F.lit("")), F.lit("\n"), F.lit(" "))
    j = F.when(k == 0, "{x").when(k == 1, "[" * 12 + "]" * 12).when(k == 2, F.concat(F.lit('{"api_key":'), F.col("doc_id").cast("string"), F.lit("}"))).when(
        k == 3, F.concat(F.lit('{"t":"'), plain, F.lit('"}'))).otherwise(F.concat(F.lit('{"n":'), F.col("n_chars").cast("string"), F.lit("}")))
    return _docs(spark, sf).select("doc_id", contracts.report_problem(j, most=60008).alias("problem"))


@query("""select doc_id, case doc_id % 5 when 0 then 'image_digest' when 1 then 'not_ready' when 2 then 'missing_capability' when 3 then 'version' end as problem from documents""")
def health_checks(spark, sf):
    k = F.col("doc_id") % 5
    d = _docs(spark, sf).select(
        "doc_id", F.when(k == 0, "x").otherwise(F.sha2("text", 256)).alias("image_sha256"), (k != 1).alias("ready"), F.when(k == 2, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("capabilities"),
        F.when(k == 3, 1).otherwise(2).alias("version"), F.lit(True).alias("approved_fork"),
    )
    return d.select("doc_id", contracts.health_problem(["a", "b"], F.lit(2), F.col("version")).alias("problem"))


@query("""select source as doc_id, concat('| ', source, ' | geometry | ', count(*), ' | ', cast(min(n_chars) as varchar), ' |') as line from documents where source is not null group by source""")
def report_lines(spark, sf):
    s = _docs(spark, sf).where("source is not null").groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("assignments"), F.min("n_chars").alias("mean_confidence")).withColumn("parser", F.lit("geometry"))
    lines = evaluation.benchmark_rows(s)
    return lines.select(F.regexp_extract("line", r"^\| (\S+) \|", 1).alias("doc_id"), "line")


@query(f"""with {_BOXES}, p as (select a.id, b.id as other, {_W} * {_H} as shared, (a.x1 - a.x0) * (a.y1 - a.y0) as sa, (b.x1 - b.x0) * (b.y1 - b.y0) as sb from r a join r b on a.id = b.id)
  select id, other, shared / (sa + sb - shared) as iou from p""")
def matched_visuals(spark, sf):
    # every label stands once on each side, so each visual meets its own
    b = _boxes(spark, sf).withColumns({"kind": F.lit("figure"), "label": F.concat(F.lit("Figure "), F.col("id").cast("string")), "object_id": F.col("id"), "ordinal": F.col("id")})
    m = evaluation.match_visuals(b, b.withColumn("label", F.upper("label")))
    return m.select(F.col("object_id").alias("id"), F.col("candidate_id").alias("other"), "iou")


@query("select doc_id, case doc_id % 3 when 0 then 'text/html; charset=utf-8' when 1 then 'image/png' else 'application/octet-stream' end as kind from documents")
def content_types(spark, sf):
    k = F.col("doc_id") % 3
    p = F.concat(F.coalesce("source", F.lit("x")), F.when(k == 0, ".HTML").when(k == 1, ".a.png").otherwise(".bin"))
    return _docs(spark, sf).select("doc_id", sinks.content_type(p).alias("kind"))


@query("select p_partkey, case when p_partkey % 2 = 0 then p_size * 2 else p_size end as pages, case when p_partkey % 2 = 0 then p_size * 2 else p_size end as last from part where p_size > 0")
def page_maps(spark, sf):
    m = F.flatten(sinks.page_map(F.col("p_size"), F.col("p_partkey") % 2 == 0))
    return table(spark, sf, "part").where("p_size > 0").select("p_partkey", F.size(m).cast("long").alias("pages"), F.array_max(m).cast("long").alias("last"))


@query("select conv_id, turn, case when role = 'user' then 5 when turn % 2 = 0 then 3 else 1 end as score from conversations where turn > 0")
def introduction_scores(spark, sf):
    b = _blocks(spark, sf).where("turn > 0")
    plain = F.regexp_replace("text", r"(?i)figure|fig\.|table", "x")
    t = F.when(F.col("role") == "user", F.concat(plain, F.lit(" as outlined in Figure 2 here"))).when(F.col("turn") % 2 == 0, F.concat(plain, F.lit(" is shown in Figure 2 here"))).otherwise(F.concat(plain, F.lit(" and Figure 2 here")))
    return b.select("conv_id", "turn", semantic.introduction_score(t, F.lit("Fig. 2")).alias("score"))
