"""Queries over the training-data operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ballhash, bytebpe, collocations, divergence, hmm, hnsw, langid, lattice, license_index, mixing, runs, site_templates, viterbi

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality(_table(spark, sf_dir, "documents"))


def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.main_text(_table(spark, sf_dir, "pages"))


def op4_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballhash.simhash_components(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.scan(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_table(spark, sf_dir, "documents"))


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(_table(spark, sf_dir, "documents"))


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.segmentation_digests(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.token_digests(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_embedding_hnsw": op1_embedding_hnsw,
        "op2_quality_divergence": op2_quality_divergence,
        "op3_site_templates": op3_site_templates,
        "op4_simhash_ball": op4_simhash_ball,
        "op5_token_counts": op5_token_counts,
        "op6_license_scan": op6_license_scan,
        "op7_language_id": op7_language_id,
        "op8_hidden_markov": op8_hidden_markov,
        "op9_sampled_pieces": op9_sampled_pieces,
        "op10_mixing": op10_mixing,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_collocations": op12_collocations,
        "op13_byte_bpe": op13_byte_bpe,
        "pipeline": pipeline,
    }


#: Brute force: all pairs of a label in double precision, then reachability.
OP1_SQL = """with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings
    where label is not null and embedding is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)),
  s as (select * from v where isfinite(list_dot_product(e, e)) and list_dot_product(e, e) > 0),
  l as (select a.vec_id as u, b.vec_id as w from s a join s b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.93),
  r as (select vec_id, vec_id as c from embeddings union select r.vec_id, l.w from r join l on r.c = l.u),
  n as (select u, count(*) as n from l group by u)
  select r.vec_id, coalesce(any_value(n.n), 0) as n_links, min(r.c) as component_id, r.vec_id = min(r.c) as kept
  from r left join n on n.u = r.vec_id group by r.vec_id"""

#: All phrases of all levels counted, every cut scored; no pruning.
OP12_SQL = """with t as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
  p as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from t),
  g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as gram
    from p, (values (1), (2), (3), (4)) as v(k) where len(w) >= k),
  f as (select lang, k, gram, count(*) as c from g group by all),
  n as (select lang, sum(c) as n from f where k = 1 group by lang),
  q as (select lang, k, gram, c, string_split(gram, ' ') as w from f where c >= 30 and k > 1),
  cut as (select lang, k, gram, c, unnest(range(1, k)) as j, w from q),
  s as (select cut.lang, cut.k, cut.gram, cut.c, j, l.c as l, r.c as r, cut.c::hugeint * 2000000 // (l.c + r.c) as score from cut
    join f l on l.lang = cut.lang and l.k = j and l.gram = array_to_string(w[1:j], ' ')
    join f r on r.lang = cut.lang and r.k = cut.k - j and r.gram = array_to_string(w[j + 1:], ' ')),
  b as (select lang, k, gram, c, min(struct_pack(score := score, j := j, l := l, r := r)) as m from s group by all),
  h as (select lang, inner_gram, max(c) as most from (select lang, c, unnest(list_transform(range(1, k - z + 2),
      lambda i: array_to_string(w[i:i + z - 1], ' '))) as inner_gram from q, (values (2), (3)) as v(z) where z < k) group by all),
  o as (select b.lang, gram, c, m, row_number() over (partition by b.lang order by m.score desc, c desc, gram) as rank
    from b left join h on h.lang = b.lang and h.inner_gram = b.gram where most is null or 100 * most < 80 * c)
  select o.lang, rank, gram as phrase, c as a, m.l as l, m.r as r, cast(n.n as bigint) as n, cast(m.score as bigint) as score
  from o join n on n.lang = o.lang where rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """The others need XXH64, hash draws, trained models or parsers, which SQL lacks; tests hold them to brute force."""
    return {"op1_embedding_hnsw": OP1_SQL, "op12_collocations": OP12_SQL}
