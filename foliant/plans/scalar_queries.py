"""Queries of the scalar text functions over lines and keys of the driver tables, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import contracts, qa
from ..session import table
from .registry import query

#: Lines of all documents, marked by turns as headings, captions, references and so on.
_LINES = """lines as (select doc_id, k, concat(case (doc_id + k) % 8 when 0 then '2.1 ' when 1 then '[3] ' when 2 then 'Figure 4: ' when 3 then 'Tab. 5 ' when 4 then 'B ' when 5 then '12. ' else '' end, line) as line
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from documents))"""


def _lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    n = (F.col("doc_id") + F.col("k")) % 8
    mark = F.when(n == 0, "2.1 ").when(n == 1, "[3] ").when(n == 2, "Figure 4: ").when(n == 3, "Tab. 5 ").when(n == 4, "B ").when(n == 5, "12. ").otherwise("")
    return d.select("doc_id", "k", F.concat(mark, F.col("line")).alias("line"))


def _docs(spark, sf):
    return table(spark, sf, "documents")


_ID = "concat('24', lpad(cast(doc_id % 12 + 1 as varchar), 2, '0'), '.', lpad(cast(doc_id % 100000 as varchar), 5, '0'))"


def _arxiv():
    return F.concat(F.lit("24"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"))


# --------------------------------------------------------------------------- identities and names


@query(f"select doc_id, case when doc_id % 3 > 0 then concat({_ID}, case when doc_id % 3 = 2 then 'v3' else '' end) end as found from documents")
def resolved_ids(spark, sf):
    k = F.col("doc_id") % 3
    # an identifier that stands alone is found, one inside a longer word is not
    own = F.when(k == 0, F.concat(F.lit("x"), _arxiv(), F.lit("-9"))).otherwise(F.concat(_arxiv(), F.when(k == 2, "V3").otherwise("")))
    return _docs(spark, sf).select("doc_id", X.resolved_id(F.concat(F.lit("Printed under "), own, F.lit(" [cs.CL] "), "text")).alias("found"))


@query("select doc_id, doc_id % 4 in (0, 1, 2) as same from documents")
def same_papers(spark, sf):
    k = F.col("doc_id") % 4
    want = F.when(k == 1, F.concat(_arxiv(), F.lit("v2"))).when(k == 3, F.concat(_arxiv(), F.lit("v1"))).otherwise(_arxiv())
    got = F.when(k == 0, _arxiv()).otherwise(F.concat(_arxiv(), F.lit("v2")))
    return _docs(spark, sf).select("doc_id", X.same_paper(want, got).alias("same"))


@query("""select doc_id, concat('arxiv-', replace(id, '/', '-'), '-ja') as job, regexp_matches(concat('arxiv-', replace(id, '/', '-'), '-ja'), '^[A-Za-z0-9][A-Za-z0-9._-]{0,79}$') as fine
  from (select doc_id, case when doc_id % 2 = 0 then concat('cs.CL/', doc_id) else concat(source, ' ', doc_id) end as id from documents)""")
def job_ids(spark, sf):
    n = F.col("doc_id").cast("string")
    job = X.job_id(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("cs.CL/"), n)).otherwise(F.concat("source", F.lit(" "), n)), suffix="-ja")
    return _docs(spark, sf).select("doc_id", job.alias("job"), X.is_job_id(job).alias("fine"))


_LATIN = ("ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñÝýÿ", "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNnYyy")


@query(f"""select doc_id, coalesce(nullif(trim(substr(trim(regexp_replace(lower(translate(text, '{_LATIN[0]}', '{_LATIN[1]}')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 56), '-'), ''), 'paper') as slug from documents""")
def slugs(spark, sf):
    return _docs(spark, sf).select("doc_id", X.slug(F.col("text")).alias("slug"))


@query("""select doc_id, concat(lpad(cast(doc_id % 100 as varchar), 2, '0'), '-', substr(trim(regexp_replace(text, '[^A-Za-z0-9._-]+', '-', 'g'), '-.'), 1, 48)) as stem,
  trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') as ref from documents""")
def safe_names(spark, sf):
    return _docs(spark, sf).select("doc_id", X.safe_stem(F.col("text"), F.col("doc_id") % 100).alias("stem"), X.safe_ref(F.col("text")).alias("ref"))


# --------------------------------------------------------------------------- lines


@query(f"with {_LINES} select doc_id, k, case when regexp_matches(line, '^\\s*\\[[0-9]+\\]') then regexp_extract(line, '^\\s*\\[([0-9]+)\\]', 1) when regexp_matches(line, '^\\s*[0-9]+[.]') then regexp_extract(line, '^\\s*([0-9]+)[.]', 1) end as label from lines")
def reference_labels(spark, sf):
    return _lines(spark, sf).select("doc_id", "k", X.reference_label(F.col("line")).alias("label"))


_NUMBER = "^([0-9]+(?:[.][0-9]+)*|[A-Z](?:[.][0-9]+)*)[.)]?\\s+\\S"


@query(f"""with {_LINES}, t as (select doc_id, k, trim(regexp_replace(line, '\\s+', ' ', 'g')) as t from lines), n as (select *, regexp_extract(t, '{_NUMBER}', 1) as n from t)
  select doc_id, k, nullif(n, '') as number, cast(least(6, length(n) - length(replace(n, '.', '')) + 1) as integer) as level,
    case when n <> '' then regexp_replace(t, '^(?:[0-9]+(?:[.][0-9]+)*|[A-Z](?:[.][0-9]+)*)[.)]?\\s+', '') else t end as title from n""")
def heading_parts(spark, sf):
    return _lines(spark, sf).select("doc_id", "k", X.heading_details(F.col("line")).alias("h")).select("doc_id", "k", "h.number", "h.level", "h.title")


@query(f"""with {_LINES}, t as (select doc_id, k, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as t from lines)
  select doc_id, k, case when regexp_matches(t, '^\\[[0-9]+\\]\\s') then 'reference'
    when length(t) <= 140 and (regexp_matches(t, '^(?:[0-9]+(?:[.][0-9]+)*|[A-Z])[.]?\\s+[A-Z].{{0,120}}$') or lower(t) in ('abstract','acknowledgement','acknowledgements','acknowledgment','acknowledgments','references','bibliography')
      or 10.0 + k % 3 >= 1.16 * 10.0) then 'heading' else 'paragraph' end as kind from t""")
def line_kinds(spark, sf):
    return _lines(spark, sf).select("doc_id", "k", X.classify_legacy(F.col("line"), F.lit(False), F.lit(10.0) + F.col("k") % 3, F.lit(10.0)).alias("kind"))


@query(f"""with {_LINES}, t as (select doc_id, k, trim(regexp_replace(line, '\\s+', ' ', 'g')) as t from lines)
  select doc_id, k, case when regexp_matches(t, '(?i)arxiv|preprint|copyright|©|doi|published|\\b(?:19|20)[0-9][0-9]\\b') then 'metadata'
    when regexp_matches(t, '(?i)@|universit|institut|department|school|laborator|college|inc[.]|\\bltd') then 'affiliation' else 'author' end as role from t""")
def front_roles(spark, sf):
    return _lines(spark, sf).select("doc_id", "k", X.front_line_role(F.col("line")).alias("role"))


_CAPTION = "(?i)^\\s*(Figure|Fig[.]?|Table|Algorithm)\\s*((?:[A-Z][.])?[0-9]+(?:[.\\-][A-Za-z0-9]+)*)\\s*([:.\\-])?\\s*"


@query(f"""with {_LINES}, c as (select doc_id, k, lower(regexp_extract(line, '{_CAPTION}', 1)) as kind, regexp_extract(line, '{_CAPTION}', 2) as label, regexp_extract(line, '{_CAPTION}', 3) as mark from lines where regexp_matches(line, '{_CAPTION}'))
  select doc_id, k, case when kind in ('fig', 'fig.') then 'figure' else kind end as kind, label from c where kind = 'algorithm' or mark <> '' or 9.0 + k % 2 <= 9.6""")
def caption_lines(spark, sf):
    c = X.caption_match(F.col("line"), F.lit(9.0) + F.col("k") % 2, F.lit(10.0))
    plain = ~F.col("line").rlike(r"(?i)^\s*\([a-z]\)\s+")
    return _lines(spark, sf).where(plain).select("doc_id", "k", c.alias("c")).where("c is not null").select("doc_id", "k", "c.kind", "c.label")


@query(f"""with {_LINES}, w as (select doc_id, k, lower(regexp_extract(line, '^\\s*([A-Za-z]+)', 1)) as w from lines)
  select doc_id, k, case when w like 'fig%' or w in ('picture','image','chart','plate') then 'figure' when w like 'tab%' then 'table' when w like 'alg%' or w in ('code','listing') then 'algorithm'
    when w like 'eq%' or w = 'formula' then 'equation' else 'figure' end as kind from w""")
def visual_kinds(spark, sf):
    return _lines(spark, sf).select("doc_id", "k", X.visual_kind(F.col("line")).alias("kind"))


@query(f"""with {_LINES}, t as (select doc_id, k, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as t from lines), h as (select *, regexp_matches(t, '^(?:[1-9][0-9]*)(?:[.][1-9]?[0-9]*){{0,5}}[.)]?\\s+.+$') as numbered,
    regexp_replace(regexp_extract(t, '^((?:[1-9][0-9]*)(?:[.][1-9]?[0-9]*){{0,5}})[.)]?\\s+(.+)$', 1), '[.]+$', '') as n, regexp_extract(t, '^((?:[1-9][0-9]*)(?:[.][1-9]?[0-9]*){{0,5}})[.)]?\\s+(.+)$', 2) as title from t)
  select doc_id, k, n as number, cast(least(6, length(n) - length(replace(n, '.', '')) + 1) as integer) as level from h
  where numbered and not (starts_with(title, '.') or regexp_matches(title, '^[0-9.%+\\-\\s]+$')) and length(title) <= 150""")
def numbered_headings(spark, sf):
    t = X.strip(F.col("line"))
    h = X.heading(F.col("line"), F.lit(12.0), F.lit(False), F.lit(10.0))
    plain = F.lower(F.regexp_replace(X.squeeze(t), ":+$", "")).isin(X.SPECIAL_HEADINGS)
    return _lines(spark, sf).where(t.rlike(X.NUMBERED_HEADING) & ~plain).select("doc_id", "k", h.alias("h")).where("h.confidence = 0.97").select("doc_id", "k", "h.number", "h.level")


@query("""select doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), lambda x: x), ' ') as joined
  from (select doc_id, replace(text, '-', '~') as text from documents)""")
def joined_lines(spark, sf):
    return _docs(spark, sf).select("doc_id", X.join_lines(F.split(F.replace("text", F.lit("-"), F.lit("~")), "\n")).alias("joined"))


# --------------------------------------------------------------------------- repairs and escapes


@query("select doc_id, concat('na', case doc_id % 2 when 0 then 'ï' else 'ë' end, 've ', replace(text, '¨', '')) as text from documents")
def moved_diaereses(spark, sf):
    t = F.concat(F.lit("na¨ "), F.when(F.col("doc_id") % 2 == 0, "i").otherwise("e"), F.lit("ve "), F.replace("text", F.lit("¨"), F.lit("")))
    return _docs(spark, sf).select("doc_id", X.displaced_diaeresis(t).alias("text"))


@query("""select doc_id, concat('see https://', host, '/', array_to_string(list_transform(range(doc_id % 9), lambda i: concat('p', i)), '/'), ' End ', replace(text, 'http', 'xttp')) as text
  from (select doc_id, text, concat('a', doc_id, '.org') as host from documents)""")
def closed_addresses(spark, sf):
    n = (F.col("doc_id") % 9).cast("int")
    steps = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("p"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    printed = F.concat(F.lit("see https : / / a"), F.col("doc_id").cast("string"), F.lit(" .org"), F.when(n > 0, F.lit("/ ")).otherwise(F.lit("/")), F.array_join(steps, "/ "), F.lit(" End "), F.replace("text", F.lit("http"), F.lit("xttp")))
    return _docs(spark, sf).select("doc_id", X.url_spacing(printed).alias("text"))


@query("select doc_id, trim(regexp_replace(concat('A ', lang, ' & bar ', text), '\\s+', ' ', 'g')) as title from documents")
def display_titles(spark, sf):
    t = F.concat(F.lit("A \\overline {"), F.col("lang"), F.lit("} &amp; bar  "), F.col("text"))
    return _docs(spark, sf).where("lang is not null").select("doc_id", X.display_title(X.decode_entities(t)).alias("title"))


@query("""select page_id, replace(replace(replace(replace(replace(replace(html, '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as text from pages""")
def decoded_entities(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.decode_entities(F.col("html")).alias("text"))


@query("""select o_orderkey, cast(o_orderdate as timestamp) as published from orders""")
def published_dates(spark, sf):
    d = F.date_format("o_orderdate", "yyyy/M/d")
    shown = F.when(F.col("o_orderkey") % 2 == 0, d).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", X.published_at(shown).cast("timestamp_ntz").alias("published"))


@query("""select doc_id, k, regexp_replace(regexp_replace(regexp_replace(x, '([\\\\`*_\\[\\]<>|~$])', '\\\\\\1', 'g'), '^(\\s*)([#+\\-])(\\s|$|#)', '\\1\\\\\\2\\3'), '^(\\s*[0-9]+)([.)])(\\s|$)', '\\1\\\\\\2\\3') as line
  from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from documents) where not regexp_matches(x, '^[ \\t]{4}|^\\s*(=+|-{2,})\\s*$|[\\t\\r]')""")
def escaped_lines(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "x"))
    d = d.where(~F.col("x").rlike(r"^[ \t]{4}|^\s*(=+|-{2,})\s*$|[\t\r]"))
    return d.select("doc_id", "k", X.escape_markdown(F.col("x")).alias("line"))


@query("""select doc_id, doc_id % 5 in (0, 1) as safe, doc_id % 5 = 0 as local from documents""")
def asset_paths(spark, sf):
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    p = F.when(k == 0, F.concat(F.lit("assets/"), n, F.lit(".png"))).when(k == 1, F.concat(n, F.lit("/x.png"))).when(k == 2, F.concat(F.lit("a/%252e%252e/"), n)).when(k == 3, F.concat(F.lit("/"), n)).otherwise(F.concat(F.lit("https://x.org/"), n))
    return _docs(spark, sf).select("doc_id", X.is_safe_asset_path(p).alias("safe"), X.is_local_asset(p).alias("local"))


@query("select page_id, page_id % 4 <> 3 as safe from pages")
def safe_links(spark, sf):
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.col("url")).when(k == 1, "mailto:a@b.org").when(k == 2, "../x.html").otherwise(F.concat(F.lit("data:"), "url"))
    return table(spark, sf, "pages").select("page_id", X.is_safe_link(u).alias("safe"))


@query("""select doc_id, not regexp_matches(text, '`|<[A-Za-z/!]|\\]\\(|\\$|\\n\\s*\\n') as safe, len(regexp_extract_all(replace(text, '\\\\', ''), '\\$')) as dollars from documents""")
def math_safety(spark, sf):
    return _docs(spark, sf).select("doc_id", X.is_safe_math(F.col("text")).alias("safe"), X.unescaped_dollars(F.replace("text", F.lit("\\"), F.lit(""))).cast("long").alias("dollars"))


@query("select doc_id, replace(replace(replace(replace(text, '<', '\\lt '), '>', '\\gt '), '|', '\\vert '), '\\vert \\vert ', '\\Vert ') as tex from documents")
def safe_tex(spark, sf):
    return _docs(spark, sf).select("doc_id", X.markdown_safe_tex(F.col("text")).alias("tex"))


@query("""select doc_id, concat(f, p, v, p, f) as code from (select doc_id, v, repeat('`', n + 1) as f, case when regexp_matches(v, '^`|`$') then ' ' else '' end as p from
  (select doc_id, v, coalesce(list_max(list_transform(regexp_extract_all(v, '`+'), lambda x: length(x))), 0) as n from (select doc_id, concat(repeat('`', cast(doc_id % 4 as integer)), text) as v from documents)))""")
def code_spans(spark, sf):
    return _docs(spark, sf).select("doc_id", X.inline_code(F.concat(F.repeat(F.lit("`"), (F.col("doc_id") % 4).cast("int")), "text")).alias("code"))


@query("""select doc_id, repeat('`', greatest(3, n + 1)) as fence from (select doc_id, coalesce(list_max(list_transform(regexp_extract_all(concat(text, repeat('`', cast(doc_id % 6 as integer))), '`+'), lambda x: length(x))), 0) as n from documents)""")
def code_fences(spark, sf):
    return _docs(spark, sf).select("doc_id", X.code_fence(F.concat("text", F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")))).alias("fence"))


@query("select doc_id, concat(replace(text, 'a', lang), ' done') as text from documents where lang is not null")
def replaced_tokens(spark, sf):
    t = F.concat(F.replace("text", F.lit("a"), F.lit("[[PTX_0001]]")), F.lit(" [[PTX_0002]]"))
    return _docs(spark, sf).where("lang is not null").select("doc_id", X.replace_tokens(t, F.create_map(F.lit("[[PTX_0001]]"), F.col("lang"), F.lit("[[PTX_0002]]"), F.lit("done"))).alias("text"))


# --------------------------------------------------------------------------- media, versions, times


@query("select doc_id, case doc_id % 5 when 0 then 'png' when 1 then 'jpeg' when 2 then 'gif' when 3 then 'webp' end as kind from documents")
def raster_kinds(spark, sf):
    k = F.col("doc_id") % 5
    h = F.when(k == 0, "89504E470D0A1A0A").when(k == 1, "FFD8FFE0").when(k == 2, "474946383961").when(k == 3, "5249464600000000574542505650").otherwise("00000000")
    return _docs(spark, sf).select("doc_id", X.raster_type(F.unhex(F.concat(h, F.hex(F.encode("source", "utf-8"))))).alias("kind"))


@query("select p_partkey, cast(p_partkey % 60000 + 1 as integer) as width, cast(p_size as integer) as height from part")
def raster_sizes(spark, sf):
    word = lambda c: F.lpad(F.hex(c.cast("long")), 4, "0")
    w, h = F.col("p_partkey") % 60000 + 1, F.col("p_size")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lit("0000"), word(w), F.lit("0000"), word(h))
    swap = lambda c: F.concat(F.substring(word(c), 3, 2), F.substring(word(c), 1, 2))
    gif = F.concat(F.lit("474946383961"), swap(w), swap(h), F.lit("0000"))
    return table(spark, sf, "part").select("p_partkey", X.raster_size(F.unhex(F.when(F.col("p_partkey") % 2 == 0, png).otherwise(gif))).alias("s")).select("p_partkey", "s.width", "s.height")


@query("select page_id, page_id % 3 <> 1 as unsafe from pages")
def unsafe_css(spark, sf):
    k = F.col("page_id") % 3
    s = F.when(k == 0, F.concat(F.lit("background: u/**/rl("), "url", F.lit(")"))).when(k == 1, "color: red; fill: url(#a)").otherwise("@im\\port 'x'")
    return table(spark, sf, "pages").select("page_id", X.has_unsafe_css(s).alias("unsafe"))


@query("select p_partkey, row_number() over (partition by p_brand order by p_partkey % 7, p_size, p_partkey % 3, p_partkey % 2 = 0, p_partkey) as place from part")
def version_order(spark, sf):
    # pre-releases (odd keys) stand before their release
    k = F.col("p_partkey")
    v = F.concat_ws(".", (k % 7).cast("string"), F.col("p_size").cast("string"), (k % 3).cast("string"))
    v = F.concat(v, F.when(k % 2 == 0, "+build").otherwise("-rc.1"))
    return table(spark, sf, "part").select("p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy(X.version_key(v), "p_partkey")).cast("long").alias("place"))


@query("select event_id, case when event_id % 3 = 0 then null else date_trunc('second', ts) end as t from events")
def event_times(spark, sf):
    plain = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    shown = F.when(F.col("event_id") % 3 == 0, plain).when(F.col("event_id") % 3 == 1, F.concat(plain, F.lit("Z"))).otherwise(F.concat(plain, F.lit("+00:00")))
    return table(spark, sf, "events").select("event_id", X.event_time(shown).cast("timestamp_ntz").alias("t"))


@query("""select doc_id, substr(array_to_string(list_transform(list_slice(list_filter(string_split(regexp_replace(concat('<path>/f', chr(10), text), '[\\x00-\\x09\\x0B-\\x1F\\x7F]', ' ', 'g'), chr(10)), lambda x: trim(x) <> ''), 1, 5), lambda x: substr(trim(x), 1, 240)), ' | '), 1, 1000) as log from documents""")
def sanitized_logs(spark, sf):
    return _docs(spark, sf).select("doc_id", X.sanitize_log(F.concat(F.lit("/srv/data/f\n"), "text"), ["/srv/data"]).alias("log"))


@query("""select doc_id, cast(greatest(2, ceil(length(text) * 0.45)) as integer) as n, substr('訳文配置確認用', cast(('0x' || substr(sha256(text), 1, 2)) as integer) % 7 + 1, 1) as first from documents""")
def placeholders(spark, sf):
    p = X.layout_placeholder(F.col("text"))
    # a null text has two characters, of which no digest tells the first
    return _docs(spark, sf).select("doc_id", F.coalesce(F.length(p), F.lit(2)).alias("n"), F.substring(p, 1, 1).alias("first"))


@query("select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as content from documents where not contains(text, 'Input:')")
def request_contents(spark, sf):
    d = _docs(spark, sf).where(~F.col("text").contains("Input:"))
    return d.select("doc_id", X.request_content(F.concat(F.lit("Policy. Input: old\nInput: "), "text")).alias("content"))


@query("""select event_id, cast(least(100000, greatest(0, round(value * 1000))) as bigint) as units,
  case when event_type = 'purchase' then 'write' when event_type = 'click' then 'translate' else 'other' end as stage from events""")
def progress_and_stage(spark, sf):
    s = F.when(F.col("event_type") == "purchase", "Save PDF").when(F.col("event_type") == "click", "Translating").otherwise("idle")
    return table(spark, sf, "events").select("event_id", X.progress_units(F.col("value")).alias("units"), X.stage_of(s).alias("stage"))


@query("""select doc_id, case when lang is null then 'Unknown author' when doc_id % 2 = 0 then concat(lang, ' and others') else lang end as authors,
  case when doc_id % 4 = 0 then concat('arXiv:', doc_id) when doc_id % 4 = 1 then 'PDF' when doc_id % 4 = 2 then 'DOCUMENT' else 'HTML' end as source from documents""")
def labels_of_papers(spark, sf):
    a = F.when(F.col("lang").isNull(), F.array().cast("array<string>")).when(F.col("doc_id") % 2 == 0, F.array("lang", F.lit("x"))).otherwise(F.array("lang"))
    k = F.col("doc_id") % 4
    kind = F.when(k == 1, "pdf").when(k == 2, "unknown").otherwise("html")
    return _docs(spark, sf).select("doc_id", X.author_label(a).alias("authors"), X.source_label(F.when(k == 0, F.col("doc_id").cast("string")).otherwise(""), kind).alias("source"))


@query("select p_partkey, case when p_partkey % 2 = 0 then translate(cast(p_partkey as varchar), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') else cast(p_partkey as varchar) end as text from part")
def superscripts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.superscript(F.col("p_partkey").cast("string"), F.col("p_partkey") % 2 == 0).alias("text"))


@query("""with w as (select conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as w from conversations), n as (select conv_id, turn, w, count(*) as n from w group by all),
  p as (select a.conv_id, a.turn, sum(a.n) as own, sum(least(a.n, coalesce(b.n, 0))) as met from n a left join n b on a.conv_id = b.conv_id and a.turn = b.turn + 1 and a.w = b.w group by all)
  select c.conv_id, c.turn, case when p.own is null then 0.0 else p.met / p.own end as coverage from conversations c left join p using (conv_id, turn) where c.turn > 0""")
def token_coverages(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("old"))
    return c.where("turn > 0").join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", X.token_coverage(F.col("text"), F.coalesce("old", F.lit(""))).alias("coverage"))


@query("""select doc_id, case doc_id % 4 when 0 then concat('#/texts/', doc_id) when 1 then concat('#/texts/', doc_id) else null end as ref, case when doc_id % 3 = 0 then 'furniture' else 'body' end as layer,
  case when doc_id % 5 > 0 then cast(doc_id % 5 as integer) end as page, case when doc_id % 2 = 0 then n_chars / 2.0 else 7.0 end as number from documents""")
def coerced_values(spark, sf):
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    ref = F.when(k == 0, F.concat(F.lit('{"$ref":"#/texts/'), n, F.lit('"}'))).when(k == 1, F.concat(F.lit(" #/texts/"), n)).otherwise(n)
    return _docs(spark, sf).select(
        "doc_id", X.ref_value(ref).alias("ref"), X.content_layer(F.when(F.col("doc_id") % 3 == 0, " Furniture").when(F.col("doc_id") % 3 == 1, "")).alias("layer"),
        X.page_number((F.col("doc_id") % 5).cast("string")).alias("page"), X.number_or(F.when(F.col("doc_id") % 2 == 0, (F.col("n_chars") / 2.0).cast("string")).otherwise("none"), 7).alias("number"),
    )


@query("""select page_id, case page_id % 4 when 0 then concat('#p-', page_id) when 1 then url when 2 then concat('<', url, '%20x>') end as target,
  concat('<a id="', page_id, '-x"></a>') as anchor, case page_id % 3 when 0 then concat('$', page_id, '$') when 1 then concat('$$', chr(10), page_id, chr(10), '$$') else concat('`', page_id, '$`') end as math from pages""")
def markdown_bits(spark, sf):
    n, k, m = F.col("page_id").cast("string"), F.col("page_id") % 4, F.col("page_id") % 3
    t = F.when(k == 0, F.concat(F.lit("#"), n)).when(k == 1, F.col("url")).when(k == 2, F.concat("url", F.lit(" x"))).otherwise(F.concat(F.lit("data:"), n))
    tex = F.when(m == 2, F.concat(n, F.lit("$"))).otherwise(n)
    return table(spark, sf, "pages").select("page_id", X.markdown_destination(t, "p-").alias("target"), X.inline_anchor(F.concat(n, F.lit(" x "))).alias("anchor"), X.math_markdown(tex, m == 1).alias("math"))


@query("""select doc_id, case doc_id % 6 when 0 then 'empty' when 1 then 'absolute' when 2 then 'outside' when 3 then 'extension' when 4 then 'character' end as problem from documents""")
def artifact_paths(spark, sf):
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    p = F.when(k == 0, "").when(k == 1, F.concat(F.lit("/"), n, F.lit(".html"))).when(k == 2, F.concat(F.lit("a/../../"), n, F.lit(".html"))).when(k == 3, F.concat(n, F.lit(".md"))).when(
        k == 4, F.concat(n, F.lit("\\x.html"))).otherwise(F.concat(F.lit("a/../"), n, F.lit(".HTML")))
    return _docs(spark, sf).select("doc_id", contracts.artifact_path_problem(p, F.lit("html"), {"html": ["html", "htm"]}).alias("problem"))


@query("""select lang, string_agg(source, '|' order by source) as authors from (select distinct lang, source from documents where source is not null) group by lang""")
def distinct_author_lists(spark, sf):
    g = _docs(spark, sf).groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("a"))
    doubled = F.flatten(F.transform("a", lambda s: F.array(F.concat(F.lit(" "), s), F.lit(" "), F.upper(s))))
    return g.select("lang", F.array_join(qa.distinct_authors(doubled), "|").alias("authors"))
