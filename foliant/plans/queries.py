"""Queries of the engine's own operators over the driver tables, with SQL that says the same.

Documents stand for papers, conversations for ordered units, events for worker runs; columns that the tables
lack are derived from their keys, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import chunking, contracts, evaluation, events, html, layout, library, projection, semantic, translation
from ..session import table
from .registry import oracle_sql, queries, query

__all__ = ["oracle_sql", "queries"]

# --------------------------------------------------------------------------- library

_PAPERS = """papers as (select doc_id, text as title, source as tag, lang,
  case doc_id % 7 when 0 then 'preparing' when 1 then 'prepared' when 2 then 'translating' when 3 then 'needs_review'
    when 4 then 'failed' else 'completed' end as status,
  case when quality is null then 'missing' when quality = 1 then 'passed' else 'failed' end as qa_status,
  coalesce(toxic = 1, false) as favorite, doc_id % 3 = 0 as is_read, doc_id % 11 as completed, 10 as total, n_chars
  from documents left join labels using (doc_id))"""
_REVIEW = "(status in ('needs_review','failed') or qa_status = 'failed' or (status = 'completed' and qa_status = 'missing'))"


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    status = F.element_at(F.array(*map(F.lit, ["preparing", "prepared", "translating", "needs_review", "failed", "completed", "completed"])), (F.col("doc_id") % 7 + 1).cast("int"))
    papers = d.select("doc_id", F.col("text").alias("title"), "lang", status.alias("status"), "n_chars")
    progress = d.select("doc_id", (F.col("doc_id") % 11).alias("completed"), F.lit(10).alias("total"))
    qa = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 1, "passed").otherwise("failed").alias("qa_status"), "toxic")
    state = d.select("doc_id", F.array("source").alias("tags"), (F.col("doc_id") % 3 == 0).alias("is_read"), F.lit(None).cast("boolean").alias("favorite"))
    out = library.summarize(papers, progress, state, qa, "doc_id")
    return out.withColumn("favorite", F.coalesce(F.col("toxic") == 1, F.lit(False)))


@query(f"with {_PAPERS} select doc_id, title, status, qa_status, favorite, is_read, tag, cast(round(least(completed, total) * 10) as integer) as percent from papers where {_REVIEW}")
def library_summary(spark, sf):
    p = _papers(spark, sf).where(library.needs_review(F.col("status"), F.col("qa_status")))
    return p.select("doc_id", "title", "status", "qa_status", "favorite", "is_read", F.get("tags", F.lit(0)).alias("tag"),
                    X.progress_percent(F.least("completed", "total"), F.col("total"), F.col("status")).alias("percent"))


@query(f"""with {_PAPERS} select count(*) as "all", count(*) filter (status in ('preparing','prepared','translating')) as active,
  count(*) filter {_REVIEW.replace('(status', '(where (status', 1)}) as review, count(*) filter (not is_read) as unread, count(*) filter (favorite) as favorites from papers""")
def facet_counts(spark, sf):
    return library.facet_counts(_papers(spark, sf))


@query("select source as tag, count(*) as n from documents where source is not null group by source")
def tag_histogram(spark, sf):
    return library.tag_histogram(_papers(spark, sf))


@query(f"with {_PAPERS} select doc_id, title, tag from papers where not is_read and contains(lower(title), 'the') and tag = 'src1'")
def library_search_sort(spark, sf):
    p = _papers(spark, sf).withColumns({"slug": F.col("doc_id").cast("string"), "authors": F.array("lang"), "requested_id": F.lit(""), "resolved_id": F.lit("")})
    p = p.withColumns({"authors": F.array().cast("array<string>")})
    return library.sort_papers(library.visible(p, "The", "unread", "src1"), "title").select("doc_id", "title", F.get("tags", F.lit(0)).alias("tag"))


@query(f"""with {_PAPERS} select doc_id, status in ('completed','needs_review') and not (lang = 'de' and status = 'needs_review')
  and (lang <> 'en' or doc_id % 2 = 0) as publishable from papers""")
def publishable(spark, sf):
    p = _papers(spark, sf)
    kind = F.when(F.col("lang") == "de", "pdf").when(F.col("lang") == "en", "arxiv").otherwise("html")
    stamp = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("3-"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 12))).otherwise("2-x")
    return p.select("doc_id", library.is_publishable(F.col("status"), kind, F.lit("none"), stamp).alias("publishable"))


@query("""select doc_id, case when doc_id % 5 = 0 then 'failed' when doc_id % 5 = 1 then 'prepared' when doc_id % 5 = 2 then 'needs_review'
  else 'completed' end as status from documents""")
def pipeline_status(spark, sf):
    k = F.col("doc_id") % 5
    return table(spark, sf, "documents").select("doc_id", library.pipeline_status(k == 0, k != 1, k == 2).alias("status"))


# --------------------------------------------------------------------------- chunks

_PACK = """pack as (select conv_id, turn, length(text) as s, length(text) as used, 1 as chunk from conversations where turn = 0
  union all select c.conv_id, c.turn, length(c.text), case when p.used + length(c.text) > 1000 then length(c.text) else p.used + length(c.text) end,
  case when p.used + length(c.text) > 1000 then p.chunk + 1 else p.chunk end from pack p join conversations c on c.conv_id = p.conv_id and c.turn = p.turn + 1)"""


def _packed(spark, sf, most=1000):
    return chunking.pack(table(spark, sf, "conversations"), ["conv_id"], "turn", F.length("text"), most)


@query(f"with recursive {_PACK} select conv_id, turn, cast(chunk as bigint) as chunk from pack")
def chunk_pack(spark, sf):
    return _packed(spark, sf).select("conv_id", "turn", "chunk")


@query(f"""with recursive {_PACK} select conv_id, cast(chunk as bigint) as chunk, cast(sum(s) as bigint) as characters, count(*) as units,
  count(distinct role) as n_roles, string_agg(cast(turn as varchar), ',' order by turn) as turns from pack join conversations using (conv_id, turn) group by all""")
def chunk_stats(spark, sf):
    c = chunking.chunk_stats(_packed(spark, sf), ["conv_id"], "turn", "turn", F.length("text"), "role")
    return c.select("conv_id", "chunk", "characters", F.size("unit_ids").cast("long").alias("units"), F.size("sections").cast("long").alias("n_roles"), F.array_join(F.col("unit_ids").cast("array<string>"), ",").alias("turns"))


_SECTIONS = """runs as (select *, sum(new) over (partition by conv_id order by turn) as run from (select conv_id, turn, length(text) as s,
    case when lag(g) over w is null or lag(g) over w <> g then 1 else 0 end as new from (select *, turn // 3 % 2 as g from conversations) window w as (partition by conv_id order by turn))),
  numbered as (select *, row_number() over (partition by conv_id, run order by turn) as k from runs),
  piece as (select conv_id, run, turn, k, s, s as used, 1 as piece from numbered where k = 1
    union all select n.conv_id, n.run, n.turn, n.k, n.s, case when p.used + n.s > 700 then n.s else p.used + n.s end, case when p.used + n.s > 700 then p.piece + 1 else p.piece end
    from piece p join numbered n on n.conv_id = p.conv_id and n.run = p.run and n.k = p.k + 1),
  whole as (select *, row_number() over (partition by conv_id order by first) as k from (select conv_id, run, piece, sum(s) as s, min(turn) as first from piece group by conv_id, run, piece)),
  pack as (select conv_id, run, piece, k, s as used, 1 as chunk from whole where k = 1
    union all select w.conv_id, w.run, w.piece, w.k, case when p.used + w.s > 700 then w.s else p.used + w.s end, case when p.used + w.s > 700 then p.chunk + 1 else p.chunk end
    from pack p join whole w on w.conv_id = p.conv_id and w.k = p.k + 1)"""


@query(f"with recursive {_SECTIONS} select conv_id, turn, cast(run as bigint) as run, cast(piece as bigint) as piece, cast(chunk as bigint) as chunk from piece join pack using (conv_id, run, piece)")
def section_chunk_pack(spark, sf):
    u = table(spark, sf, "conversations").withColumn("section", F.expr("turn div 3 % 2"))
    return chunking.pack_sections(u, ["conv_id"], "turn", "section", F.length("text"), 700).select("conv_id", "turn", "run", "piece", "chunk")


_DONE = "done as (select conv_id, chunk, bool_and((conv_id + turn) % 9 <> 0) as ok from pack group by all)"


def _chunks(spark, sf):
    u = _packed(spark, sf).withColumn("japanese", F.when((F.col("conv_id") + F.col("turn")) % 9 != 0, F.col("text")).otherwise(" 　"))
    return chunking.chunk_status(u, ["conv_id"], "japanese")


@query(f"""with recursive {_PACK}, {_DONE} select conv_id, count(*) filter (ok) as completed, count(*) as total, count(*) filter (not ok) as remaining,
  case when bool_and(ok) then 'translated' when bool_or(ok) then 'translating' else 'prepared' end as status from done group by conv_id""")
def job_status(spark, sf):
    return chunking.job_progress(_chunks(spark, sf), ["conv_id"])


@query(f"with recursive {_PACK}, {_DONE} select conv_id, cast(min(chunk) as bigint) as chunk from done where not ok group by conv_id")
def next_pending_chunk(spark, sf):
    return chunking.next_pending(_chunks(spark, sf), ["conv_id"])


@query("""select conv_id, turn, cast(sum(new) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as run from
  (select *, case when lag(role) over (partition by conv_id order by turn) = role then 0 else 1 end as new from conversations)""")
def paragraph_islands(spark, sf):
    c = table(spark, sf, "conversations")
    same = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")) == F.col("role")
    return layout.islands(c, ["conv_id"], ["turn"], ~same, "run").select("conv_id", "turn", "run")


@query("""select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as anchor
  from conversations""")
def section_carry(spark, sf):
    c = table(spark, sf, "conversations")
    return layout.nearest_previous(c, ["conv_id"], "turn", "turn", F.col("role") == "user", "anchor").select("conv_id", "turn", "anchor")


@query("select conv_id, count(distinct role) as sections, count(*) as units, cast(sum(length(text)) as bigint) as characters from conversations group by conv_id")
def source_structure(spark, sf):
    return chunking.source_structure(table(spark, sf, "conversations"), ["conv_id"], "role", "text")


# --------------------------------------------------------------------------- translation contract


@query("""with want as (select item_id as id, 1 as n from benchmark), have as (select case when doc_id % 3 = 0 then -1 - doc_id else doc_id end as id, 1 + cast(doc_id % 13 = 0 as integer) as n from documents)
  select id, case when h.n is null then 'missing' when w.n is null then 'unknown' else 'duplicate' end as problem from want w full join have h using (id)
  where h.n is null or w.n is null or h.n > w.n""")
def translation_identity(spark, sf):
    want = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    have = table(spark, sf, "documents").select("doc_id", F.expr("if(doc_id % 3 = 0, -1 - doc_id, doc_id)").alias("k")).select(F.explode(F.array_repeat("k", F.when(F.col("doc_id") % 13 == 0, 2).otherwise(1))).alias("id"))
    return translation.identity_problems(want, have, [], "id")


@query("""with t as (select doc_id, '[[PTX_0001]] x [[PTX_0002]]' as a, case doc_id % 4 when 0 then '[[PTX_0002]] y [[PTX_0001]]' when 1 then '[[PTX_0001]]'
  when 2 then '[[PTX_0001]] [[PTX_0001]]' else '[[PTX_0001]] [[PTX_0002]] [[PTX_12]]' end as b from documents)
  select doc_id, list_sort(regexp_extract_all(a, '\\[\\[PTX_[0-9][0-9][0-9][0-9]\\]\\]')) = list_sort(regexp_extract_all(b, '\\[\\[PTX_[0-9][0-9][0-9][0-9]\\]\\]')) as same from t""")
def token_multiset(spark, sf):
    k = F.col("doc_id") % 4
    b = F.when(k == 0, "[[PTX_0002]] y [[PTX_0001]]").when(k == 1, "[[PTX_0001]]").when(k == 2, "[[PTX_0001]] [[PTX_0001]]").otherwise("[[PTX_0001]] [[PTX_0002]] [[PTX_12]]")
    return table(spark, sf, "documents").select("doc_id", translation.same_tokens(F.lit("[[PTX_0001]] x [[PTX_0002]]"), b).alias("same"))


@query("""with t as (select doc_id, concat(text, ' [', doc_id % 9 + 1, '] API') as o, case when doc_id % 3 = 0 then substr(text, 1, 30) else concat(text, ' [', doc_id % 9 + 1, ']', case when doc_id % 2 = 0 then ' API' else '' end) end as j, doc_id % 9 + 1 as n from documents)
  select doc_id, concat_ws('|', case when doc_id % 3 = 0 then concat('missing citation: [', n, ']') end,
    case when doc_id % 3 = 0 or doc_id % 2 = 1 then 'missing protected terms: API' end,
    case when length(o) > 240 and length(j) < length(o) * 0.18 then 'translation may be incomplete' end) as warnings from t""")
def invariant_warnings(spark, sf):
    d = table(spark, sf, "documents")
    cite = F.concat(F.lit(" ["), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("]"))
    o = F.concat("text", cite, F.lit(" API"))
    j = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 30)).otherwise(F.concat("text", cite, F.when(F.col("doc_id") % 2 == 0, " API").otherwise("")))
    return d.select("doc_id", F.concat_ws("|", X.invariant_warnings(o, j)).alias("warnings"))


@query("""with o as (select doc_id, case when doc_id % 5 = 0 then concat(text, '!') else text end as text, concat('ja', doc_id) as ja from documents where doc_id % 2 = 0),
  once as (select text, min(ja) as ja from o group by text having count(*) = 1)
  select n.doc_id, coalesce(case when a.text = n.text then a.ja else b.ja end, '') as japanese from documents n left join o a on a.doc_id = n.doc_id left join once b on b.text = n.text""")
def merge_previous(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("original"), F.lit("").alias("japanese"))
    old = d.where("doc_id % 2 = 0").withColumns({"original": F.when(F.col("doc_id") % 5 == 0, F.concat("original", F.lit("!"))).otherwise(F.col("original")), "japanese": F.concat(F.lit("ja"), F.col("doc_id").cast("string"))})
    return translation.merge_previous(d, old, [], "doc_id").select("doc_id", "japanese")


@query("""with old as (select conv_id, turn, text as ja, 1 as at from conversations where turn % 3 <> 0),
  new as (select conv_id, turn, case when turn % 4 = 0 then concat(text, '!') when turn % 7 = 6 then '' else text end as ja, 2 as at from conversations where turn % 2 = 0),
  b as (select coalesce(o.conv_id, n.conv_id) as conv_id, coalesce(o.turn, n.turn) as turn, o.ja as oj, n.ja as nj, o.at as oa, n.at as na, o.turn is not null as ho, n.turn is not null as hn
    from old o full join new n on o.conv_id = n.conv_id and o.turn = n.turn),
  a as (select *, case when not hn then 'keep' when trim(nj) = '' then 'blank' when not ho then 'insert' when oj = nj then 'replay' else 'conflict' end as action from b)
  select conv_id, turn, case when action = 'insert' then nj else oj end as japanese, case when action = 'insert' then na else oa end as saved_at, action from a""")
def state_upsert(spark, sf):
    c = table(spark, sf, "conversations")
    old = c.where("turn % 3 <> 0").select("conv_id", "turn", F.col("text").alias("japanese"), F.lit(1).alias("saved_at"))
    ja = F.when(F.col("turn") % 4 == 0, F.concat("text", F.lit("!"))).when(F.col("turn") % 7 == 6, "").otherwise(F.col("text"))
    new = c.where("turn % 2 = 0").select("conv_id", "turn", ja.alias("japanese"), F.lit(2).alias("saved_at"))
    return translation.save(old, new, ["conv_id", "turn"])


@query("select role, count(*) as calls, cast(sum(length(text)) as bigint) as input_tokens, cast(sum(turn) as bigint) as output_tokens, cast(sum(length(text)) + sum(turn) as bigint) as total_tokens from conversations group by role")
def token_usage(spark, sf):
    c = table(spark, sf, "conversations").select("role", F.lit(1).alias("calls"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"),
                                                F.lit(0).alias("cache_hits"), F.lit(0).alias("retries"), F.length("text").alias("characters"))
    return translation.token_usage(c, ["role"]).select("role", "calls", "input_tokens", "output_tokens", "total_tokens")


# --------------------------------------------------------------------------- scalar text

_MARK = "concat(text, ' [', doc_id % 9 + 1, '] Figure ', doc_id % 5 + 1, ' and Table ', doc_id % 3 + 1, ' Figure ', doc_id % 5 + 1)"


def _marked(spark, sf):
    n = lambda k: (F.col("doc_id") % k + 1).cast("string")
    m = F.concat("text", F.lit(" ["), n(9), F.lit("] Figure "), n(5), F.lit(" and Table "), n(3), F.lit(" Figure "), n(5))
    return table(spark, sf, "documents").select("doc_id", "text", m.alias("m"))


_CITED = [p.replace("'", "''") for p in (X.NUMERIC_CITATION, X.AUTHOR_YEAR_CITATION)]
_OBJECT = X.OBJECT_REFERENCE.replace("'", "''")


@query(f"""select doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(m, '{_CITED[0]}'), regexp_extract_all(m, '{_CITED[1]}')))), '|') as found
  from (select doc_id, {_MARK} as m from documents)""")
def citations(spark, sf):
    return _marked(spark, sf).select("doc_id", F.array_join(F.array_sort(X.citations(F.col("m"))), "|").alias("found"))


@query(f"""select doc_id, array_to_string(list_sort(list_distinct(r)), '|') as found, regexp_replace(regexp_replace(lower(r[1]), '^fig(ure|[.])? *[(]?', 'figure '), '[)]$', '') as first
  from (select doc_id, regexp_extract_all({_MARK}, '{_OBJECT}') as r from documents)""")
def object_refs(spark, sf):
    r = X.object_references(F.col("m"))
    return _marked(spark, sf).select("doc_id", F.array_join(F.array_sort(r), "|").alias("found"), X.canonical_reference(F.get(r, F.lit(0))).alias("first"))


@query("select doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t]*\\n[ \\t\\n]*', ' ', 'g'), '[ \\t]+', ' ', 'g')) as clean from documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@query("select doc_id, concat('sec-', coalesce(nullif(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48), ''), 'section')) as slug from documents")
def slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.section_slug(F.lit(None).cast("string"), F.col("text")).alias("slug"))


@query("select doc_id, regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '[0-9]+', '#', 'g') as furniture from documents")
def canonical_furniture(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.canonical_furniture(F.col("text")).alias("furniture"))


@query("""with s as (select doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '[^A-Za-z0-9_.:-]+', '-', 'g'), '-'), ''), 'block') as base from documents)
  select doc_id, case when row_number() over w = 1 then base else concat(base, '-', row_number() over w) end as anchor from s window w as (partition by base order by doc_id)""")
def anchor_suffix(spark, sf):
    from ..operators import markdown

    # the sign in front is dropped again; with it, no document is without an anchor
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("#"), F.coalesce("text", F.lit(""))).alias("anchor"), F.col("doc_id").alias("pos"))
    return markdown.unique_anchors(d.withColumnRenamed("doc_id", "id").withColumn("doc_id", F.lit("all"))).select(F.col("id").alias("doc_id"), "anchor")


@query("""select doc_id, case when doc_id % 3 = 0 then trim(text) else concat('ja ', doc_id) end as shown from
  (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text from documents)""")
def preferred_text(spark, sf):
    ja = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.concat(F.lit("ja "), F.col("doc_id").cast("string")))
    return table(spark, sf, "documents").select("doc_id", X.preferred_text(ja, F.col("text")).alias("shown"))


@query("""with t as (select doc_id, concat('24', lpad(cast(doc_id % 14 as varchar), 2, '0'), '.', lpad(cast(doc_id % 100000 as varchar), 5, '0')) as id from documents)
  select doc_id, case when doc_id % 14 between 1 and 12 then case when doc_id % 4 = 1 then concat(id, 'v2') else id end end as found from t""")
def arxiv_ids(spark, sf):
    raw = F.concat(F.lit("24"), F.lpad((F.col("doc_id") % 14).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"))
    shown = F.when(F.col("doc_id") % 4 == 0, raw).when(F.col("doc_id") % 4 == 1, F.concat(raw, F.lit("V2"))).when(
        F.col("doc_id") % 4 == 2, F.concat(F.lit("https://arxiv.org/abs/"), raw)).otherwise(F.concat(F.lit("https://arxiv.org/pdf/"), raw, F.lit(".pdf")))
    return table(spark, sf, "documents").select("doc_id", X.arxiv_id(shown).alias("found"))


@query("""select doc_id, concat(substr(sha256(u), 1, 10), '-file-', doc_id, '.png') as name from (select doc_id, concat('https://x.org/a/file ', doc_id, '.png?v=1') as u from documents)""")
def asset_names(spark, sf):
    u = F.concat(F.lit("https://x.org/a/file "), F.col("doc_id").cast("string"), F.lit(".png?v=1"))
    return table(spark, sf, "documents").select("doc_id", X.asset_name(u).alias("name"))


@query("""select source, string_agg(tag, '|' order by k) as tags from (select source, tag, min(k) as k from
  (select distinct source, lower(lang) as tag, case lang when 'de' then 1 when 'en' then 2 when 'es' then 3 else 4 end as k from documents) group by all) group by source""")
def normalized_tags(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("l"))
    doubled = F.concat(F.transform("l", lambda t: F.concat(F.lit("  "), t, F.lit(" "))), F.transform("l", lambda t: F.upper(t)), F.array(F.lit(" ")))
    return d.select("source", F.array_join(X.normalize_tags(doubled), "|").alias("tags"))


# --------------------------------------------------------------------------- layout, sets, spatial


@query("""with l as (select source, doc_id, regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '[0-9]+', '#', 'g') as line from
    (select source, doc_id, unnest(string_split(text, chr(10))) as line from documents)),
  n as (select source, line, count(distinct doc_id) as n from l where line <> '' group by all), p as (select source, greatest(2, ceil(count(*) * 0.12)) as least from documents group by source)
  select source, line from n join p using (source) where n >= least""")
def furniture(spark, sf):
    d = table(spark, sf, "documents")
    box = G.rect(0.0, 0.0, 1.0, 0.05)
    b = d.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("text")).withColumn("bbox_norm", box)
    return layout.repeated_furniture(b, d.select(F.col("source").alias("doc_id"))).select(F.col("doc_id").alias("source"), F.col("furniture").alias("line"))


@query("""with b as (select source, 8.0 + length(line) % 9 * 0.5 as size, sum(least(length(line), 500)) as w from (select source, unnest(string_split(text, chr(10))) as line from documents) group by all)
  select source, arg_max(size, w * 1000 - size) as body_font from b group by source""")
def body_bucket(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.explode(F.split("text", "\n")).alias("text"))
    return layout.body_font(d.withColumn("font_max", F.lit(8.0) + F.length("text") % 9 * 0.5)).select(F.col("doc_id").alias("source"), "body_font")


@query("select sha256(text) as digest, count(*) as n, min(doc_id) as first_id from documents group by text having count(*) > 1")
def duplicates(spark, sf):
    d = table(spark, sf, "documents").withColumn("digest", F.sha2("text", 256))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_RECTS = "select p_partkey as id, p_partkey // 200 as doc, p_size % 7 as page, p_partkey % 83 / 100.0 as x0, p_partkey % 61 / 100.0 as y0, p_partkey % 83 / 100.0 + 0.05 + p_size / 400.0 as x1, p_partkey % 61 / 100.0 + 0.08 as y1 from part"


def _rects(spark, sf):
    k = F.col("p_partkey")
    x0, y0 = k % 83 / 100.0, k % 61 / 100.0
    return table(spark, sf, "part").select(
        k.alias("id"), F.expr("p_partkey div 200").alias("doc_id"), (F.col("p_size") % 7).alias("page"),
        G.rect(x0, y0, x0 + 0.05 + F.col("p_size") / 400.0, y0 + 0.08).alias("bbox_norm"),
    )


@query(f"""with r as ({_RECTS}) select a.id, b.id as other from r a join r b on a.doc = b.doc and a.page = b.page and a.id < b.id
  and greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) > 0.625""")
def spatial_pairs(spark, sf):
    r = _rects(spark, sf)
    return layout.spatial_join(r, r, lambda a, b: G.overlap_ratio(a, b) > 0.625).where("id < r_id").select("id", F.col("r_id").alias("other"))


@query(f"""with r as ({_RECTS}) select id from r a where not exists (select 1 from r b where a.doc = b.doc and a.page = b.page and a.id <> b.id
  and (a.x0 + a.x1) / 2 between b.x0 - 0.004 and b.x1 + 0.004 and (a.y0 + a.y1) / 2 between b.y0 - 0.004 and b.y1 + 0.004)""")
def spatial_anti(spark, sf):
    r = _rects(spark, sf)
    tops = r.select(*[F.col(c).alias(f"r_{c}") for c in r.columns])
    on = (r["doc_id"] == tops["r_doc_id"]) & (r["page"] == tops["r_page"]) & (r["id"] != tops["r_id"]) & G.center_inside(r["bbox_norm"], tops["r_bbox_norm"])
    return r.join(tops, on, "left_anti").select("id")


@query("""with e as (select *, row_number() over (partition by user_id order by ts, event_id) as p from events),
  m as (select a.event_id, max(case when b.p < a.p then b.p end) as prev, min(case when b.p >= a.p then b.p end) as next, any_value(a.p) as p from e a left join e b on a.user_id = b.user_id and b.event_type = 'click'
    where a.event_type = 'purchase' group by a.event_id)
  select event_id, case when prev is not null and (next is null or p - prev <= next - p + 4) then prev else next end as anchor from m""")
def asof_anchor(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    w = W.partitionBy("user_id").orderBy("p")
    at = F.when(F.col("event_type") == "click", F.col("p"))
    e = e.withColumns({"prev": F.last(at, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), "next": F.first(at, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))})
    near = F.col("prev").isNotNull() & (F.col("next").isNull() | (F.col("p") - F.col("prev") <= F.col("next") - F.col("p") + 4))
    return e.where("event_type = 'purchase'").select("event_id", F.when(near, F.col("prev")).otherwise(F.col("next")).alias("anchor"))


@query("""select doc_id, count(*) over w as n, cast(sum(strlen(text)) over w as bigint) as used, count(*) over w <= 40 and sum(strlen(text)) over w <= 60000 as allowed
  from documents window w as (partition by source order by doc_id rows unbounded preceding)""")
def budget_cutoff(spark, sf):
    d = table(spark, sf, "documents").withColumn("size", F.octet_length("text"))
    return contracts.budget(d, ["source"], "doc_id", "size", 40, 60000).select("doc_id", "n", "used", "allowed")


@query("""with c as (select doc_id, doc_id // 4 as paper, case when doc_id % 3 = 0 then 'unavailable' when doc_id % 5 = 0 then 'not_full_text' end as rejected,
    case lang when 'en' then 1 when 'de' then 2 when 'fr' then 3 else 4 end as r from documents)
  select doc_id, rejected, rejected is null and row_number() over (partition by paper, rejected is null order by r, doc_id) = 1 as chosen from c""")
def route_source(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.expr("doc_id div 4").alias("paper_id"), F.col("doc_id").alias("candidate_id"), F.col("lang").alias("kind"), (F.col("doc_id") % 3 != 0).alias("available"),
        F.lit("open").alias("access"), F.lit("exact").alias("identity_match"), F.lit("passed").alias("validation"), (F.col("doc_id") % 5 != 0).alias("full_text"),
        F.lit(0.9).alias("usable_text_ratio"), F.lit(0.0).alias("garbled_ratio"), F.lit(False).alias("allow_equivalent"),
    )
    return contracts.route_sources(d, ["en", "de", "fr"]).select("doc_id", "rejected", "chosen")


# --------------------------------------------------------------------------- events

_EV = """e as (select event_id, user_id, row_number() over w as k, case when row_number() over w = 1 and user_id % 10 <> 0 then 'started' when event_type = 'purchase' and user_id % 4 = 0 then 'completed'
    when event_type = 'click' then 'progress' else 'stage' end as type, case when event_id % 97 = 0 then event_id - 50 else event_id end as seq,
    case when event_id % 89 = 0 then ts - interval 3 day else ts end as t from events window w as (partition by user_id order by event_id))"""


def _worker_events(spark, sf):
    e = table(spark, sf, "events")
    w = W.partitionBy("user_id").orderBy("event_id")
    first = (F.row_number().over(w) == 1) & (F.col("user_id") % 10 != 0)
    kind = F.when(first, "started").when((F.col("event_type") == "purchase") & (F.col("user_id") % 4 == 0), "completed").when(F.col("event_type") == "click", "progress").otherwise("stage")
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), kind.alias("type"),
        F.when(F.col("event_id") % 97 == 0, F.col("event_id") - 50).otherwise(F.col("event_id")).alias("sequence"),
        F.when(F.col("event_id") % 89 == 0, F.col("ts") - F.expr("interval 3 days")).otherwise(F.col("ts")).alias("time"), "value",
    )


@query(f"""with {_EV}, m as (select *, max(seq) over b as ms, max(t) over b as mt, max(case when type in ('completed','failed') then 1 else 0 end) over b as done from e window b as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding))
  select event_id, concat_ws('|', case when seq < 1 then 'sequence_not_positive' end, case when seq <= ms then 'sequence_not_increasing' end, case when t < mt then 'time_backwards' end,
    case when done = 1 then 'after_terminal' end, case when k = 1 and type <> 'started' then 'first_not_started' end, case when k > 1 and type = 'started' then 'started_again' end) as problems from m""")
def event_validation(spark, sf):
    return events.event_problems(_worker_events(spark, sf)).select(F.col("line_no").alias("event_id"), F.array_join("problems", "|").alias("problems"))


@query(f"""with {_EV}, m as (select *, max(seq) over b as ms, max(t) over b as mt, max(case when type in ('completed','failed') then 1 else 0 end) over b as done from e window b as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)),
  p as (select *, case when seq < 1 then 'sequence_not_positive' when seq <= ms then 'sequence_not_increasing' when t < mt then 'time_backwards' when done = 1 then 'after_terminal' when k = 1 and type <> 'started' then 'first_not_started' end as problem from m)
  select user_id as run_id, count(*) as n_events, coalesce(arg_min(problem, case when problem is not null then event_id end), case when arg_max(type, event_id) not in ('completed','failed') then 'no_terminal' end) as first_problem from p group by user_id""")
def run_validity(spark, sf):
    return events.run_validity(_worker_events(spark, sf)).select("run_id", "n_events", "first_problem")


@query("select user_id, max(event_id) as event_id, arg_max(value, event_id) as value from events where event_type = 'click' group by user_id")
def last_progress(spark, sf):
    e = _worker_events(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("line_no"), "event_type"), "line_no")
    e = e.withColumn("type", F.when(F.col("event_type") == "click", "progress").otherwise("stage"))
    return events.last_progress(e, "run_id", "line_no", ["line_no", "value"]).select(F.col("run_id").alias("user_id"), F.col("line_no").alias("event_id"), "value")


@query("select event_id from (select event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as p from events) where p is null or p <> event_type")
def dedup_progress(spark, sf):
    return events.changed_progress(table(spark, sf, "events"), "user_id", "event_id", ["event_type"]).select("event_id")


@query("""select user_id, min(ts) as started_at, max(ts) as ended_at, count(*) as stages, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 as whole_seconds
  from events group by user_id""")
def stage_rollup(spark, sf):
    r = events.stage_rollup(table(spark, sf, "events"), "user_id", "ts", "ts")
    return r.select("user_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("ended_at").cast("timestamp_ntz").alias("ended_at"), "stages", (F.unix_seconds(F.col("ended_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))).alias("whole_seconds"))


# --------------------------------------------------------------------------- evaluation


@query("""select d.source, count(*) as assignments, count(*) filter (toxic = 1) as hidden, count(*) filter (quality < 0.7) as low_confidence from documents d join labels using (doc_id) group by d.source""")
def parser_summary(spark, sf):
    a = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("source"), F.col("lang").alias("role"), (F.col("toxic") == 1).alias("hidden"), F.col("quality").cast("double").alias("confidence"))
    v = a.select("source", F.col("role").alias("kind"))
    return evaluation.parser_summary(a, v, ["source"]).select("source", "assignments", "hidden", "low_confidence")


@query("select source, count(*) filter (lang = 'en') as en, count(*) filter (lang = 'de') as de, count(*) filter (lang = 'fr') as fr from documents group by source")
def parser_pivot(spark, sf):
    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return evaluation.parser_pivot(n, "source", "lang", "n", ["en", "de", "fr"]).fillna(0)


@query("""with g as (select source, doc_id from documents join labels using (doc_id) where quality = 1), c as (select source, doc_id from documents where n_chars % 5 <> 0),
  n as (select source, count(g.doc_id) as g, count(c.doc_id) as c, count(*) filter (g.doc_id is not null and c.doc_id is not null) as b from g full join c using (source, doc_id) group by source)
  select source, b / c as label_precision, b / g as label_recall from n where g > 0 and c > 0""")
def evaluate_labels(spark, sf):
    d = table(spark, sf, "documents")
    g = d.join(table(spark, sf, "labels").where("quality = 1"), "doc_id").select("source", "doc_id")
    r = evaluation.precision_recall(g, d.where("n_chars % 5 <> 0").select("source", "doc_id"), ["source"], "doc_id", "label")
    return r.join(g.select("source").distinct(), "source", "left_semi").select("source", "label_precision", "label_recall")


@query("""with s as (select source, count(*) as gold, count(*) filter (doc_id % 4 <> 0) as shared, count(*) filter (doc_id % 4 <> 0 and lang = 'en') as ok from documents group by source)
  select source, gold, shared, shared / gold as coverage, case when shared > 0 then ok / shared else 0.0 end as role_accuracy from s""")
def block_agreement(spark, sf):
    d = table(spark, sf, "documents").select("source", F.col("doc_id").alias("block_id"), F.col("lang").alias("role"), F.lit(False).alias("hidden"))
    c = d.where("block_id % 4 <> 0").withColumn("role", F.lit("en"))
    return evaluation.block_agreement(d, c, ["source"]).select("source", "gold", "shared", "coverage", "role_accuracy")


# --------------------------------------------------------------------------- pages


@query("select page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) as scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) as host, regexp_extract(url, '[?]([^#]*)', 1) as query from pages")
def page_url_parts(spark, sf):
    return table(spark, sf, "pages").withColumn("u", contracts.url_parts(F.col("url"))).select("page_id", "u.scheme", "u.host", "u.query")


@query("select page_id, page_id % 3 = 0 as unsafe from pages")
def unsafe_url(spark, sf):
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("java\tscript:"), "url")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", X.has_unsafe_scheme(u).alias("unsafe"))


@query("""select page_id, len(regexp_extract_all(html, '<p[ >]')) as paragraphs, len(regexp_extract_all(html, '<a[ >]')) as links, len(regexp_extract_all(html, '<h[1-6][ >]')) as headings from pages""")
def html_counts(spark, sf):
    p = table(spark, sf, "pages").withColumn("doc_id", F.col("page_id").cast("string"))
    return html.page_counts(html.parse_html(p)).select(F.col("doc_id").cast("long").alias("page_id"), "paragraphs", "links", "headings")


@query("""select page_id, target from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from pages) group by all""")
def html_link_targets(spark, sf):
    p = table(spark, sf, "pages").withColumn("doc_id", F.col("page_id").cast("string"))
    n = html.parse_html(p).where("tag = 'a'")
    return n.select(F.col("doc_id").cast("long").alias("page_id"), html.attr("href").alias("target")).where("target is not null").distinct()


@query()
def html_nodes(spark, sf):
    return html.parse_html(table(spark, sf, "pages").withColumn("doc_id", F.col("page_id").cast("string"))).select("doc_id", "node_id", "parent_id", "depth", "pre", "post", "type", "tag", "text")


@query()
def page_blocks(spark, sf):
    n = html.node_table(table(spark, sf, "pages").withColumn("doc_id", F.col("page_id").cast("string")))
    return projection.project(n).select(F.col("doc_id").cast("long").alias("page_id"), "pos", "kind", "level", "anchor", "text")


@query()
def html_units(spark, sf):
    n = html.node_table(table(spark, sf, "pages").withColumn("doc_id", F.col("page_id").cast("string")))
    return html.unit_nodes(n).select("doc_id", "unit_id", "kind", "source_text")


@query("""with l as (select conv_id, turn, role, k, regexp_replace(regexp_replace(regexp_replace(x, '([\\\\`*_\\[\\]<>|~$])', '\\\\\\1', 'g'), '^(\\s*)([#+\\-])(\\s|$|#)', '\\1\\\\\\2\\3'), '^(\\s*[0-9]+)([.)])(\\s|$)', '\\1\\\\\\2\\3') as x
    from (select conv_id, turn, role, unnest(string_split(t, chr(10))) as x, generate_subscripts(string_split(t, chr(10)), 1) as k from (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from conversations))),
  b as (select conv_id, turn, role, string_agg(x, chr(10) order by k) as t from l group by all),
  m as (select conv_id, turn, concat('<a id="u', turn, '"></a>', chr(10), chr(10), case when role = 'user' then '## ' else '' end, t) as piece from b)
  select conv_id as doc_id, concat(rtrim(string_agg(piece, chr(10) || chr(10) order by turn), ' ' || chr(10) || chr(9)), chr(10)) as markdown from m group by conv_id""")
def markdown_documents(spark, sf):
    from ..operators import markdown

    c = table(spark, sf, "conversations").withColumns({"doc_id": F.col("conv_id"), "pos": F.col("turn"), "kind": F.when(F.col("role") == "user", "heading").otherwise("paragraph"),
                                                       "japanese": F.lit(""), "original": F.col("text"), "level": F.lit(1), "unit_id": F.concat(F.lit("u"), F.col("turn").cast("string"))})
    return markdown.serialize(markdown.blocks_of_units(c))


@query("select conv_id, string_agg(text, ' ' order by turn) as original, count(*) as parts from (select conv_id, turn, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^[^A-Za-z]+|[^A-Za-z.]+$', '', 'g') as text from conversations) where text <> '' group by conv_id")
def joined_parts(spark, sf):
    t = F.regexp_replace(X.squeeze(F.col("text")), r"^[^A-Za-z]+|[^A-Za-z.]+$", "")
    c = table(spark, sf, "conversations").withColumn("t", t).where("t <> ''")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("r"), F.count("*").alias("parts"))
    return g.select("conv_id", X.join_source_parts(F.transform("r", lambda x: x["t"])).alias("original"), "parts")


@query("select doc_id, 'front_or_body' as kind, row_number() over (partition by source order by n_chars, doc_id) as ordinal from documents")
def content_order(spark, sf):
    d = table(spark, sf, "documents")
    u = d.select(F.col("source").alias("doc_id"), F.format_string("%012d", "doc_id").alias("unit_id"), F.col("n_chars").alias("position"))
    v = u.limit(0).select("doc_id", F.col("unit_id").alias("object_id"), "position", F.lit(1).alias("page"), G.rect(0.0, 0.0, 1.0, 1.0).alias("bbox_norm"))
    return semantic.content_order(u, v).select(F.col("id").cast("long").alias("doc_id"), F.lit("front_or_body").alias("kind"), F.col("ordinal").cast("long").alias("ordinal"))


# the other modules register theirs
from . import relation_queries, repair_queries, scalar_queries, source_queries  # noqa: E402, F401
