"""The translation contract: identity checks, merges, saves, caches and payloads (SET01-SET10, JN07-JN09, UPS01-UPS09,
AG13, TR17, CTL01-CTL05, UDF01)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import invariant_warnings, is_blank, layout_placeholder

TOKEN = r"\[\[PTX_\d{4}\]\]"
POLICY_VERSION = "1"


def identity_problems(expected: DataFrame, actual: DataFrame, by: list[str], key: str) -> DataFrame:
    """SET01, SET02, SET04: (by, key, problem) of missing, unknown and duplicate ids; none when the multisets agree."""
    want = expected.groupBy(*by, key).agg(F.count("*").alias("__want"))
    have = actual.groupBy(*by, key).agg(F.count("*").alias("__have"))
    both = want.join(have, [*by, key], "full_outer")
    problem = (
        F.when(F.col("__have").isNull(), "missing").when(F.col("__want").isNull(), "unknown")
        .when(F.col("__have") > F.col("__want"), "duplicate").when(F.col("__have") < F.col("__want"), "missing")
    )
    return both.select(*by, key, problem.alias("problem")).where("problem is not null")


def same_tokens(source: Column, translated: Column) -> Column:
    """SET03: the placeholder tokens agree as multisets."""
    tokens = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)))
    return tokens(source) == tokens(translated)


def ordered_distinct(*arrays: Column) -> Column:
    """SET05: first mentions in order."""
    return F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))


def covers(have: Column, need: Column) -> Column:
    """SET10."""
    return F.size(F.array_except(need, have)) == 0


def difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """SET07, SET08: rows of ``left`` without a partner."""
    return left.join(right, on, "left_anti")


def apply_translations(units: DataFrame, translations: DataFrame, on: list[str]) -> DataFrame:
    """JN07: translations land on their units; units without one keep what they had."""
    t = translations.select(*on, F.col("japanese").alias("__ja"), F.col("preserved_terms").alias("__terms"))
    return units.join(t, on, "left").withColumns({
        "japanese": F.coalesce("__ja", "japanese"), "preserved_terms": F.coalesce("__terms", "preserved_terms"),
    }).drop("__ja", "__terms")


def merge_previous(new: DataFrame, old: DataFrame, by: list[str], key: str, text: str = "original") -> DataFrame:
    """JN08: reuse a translation by id and text, else by text where the old side has it once."""
    done = lambda c: ~is_blank(F.col(c))
    by_id = old.select(*by, key, F.col(text).alias("__t1"), F.col("japanese").alias("__ja1"))
    once = old.groupBy(*by, text).agg(F.count("*").alias("__n"), F.first("japanese").alias("__ja2")).where("__n = 1").drop("__n")
    out = new.join(by_id, [*by, key], "left").join(once, [*by, text], "left")
    same = F.coalesce(F.col("__t1") == F.col(text), F.lit(False))
    found = F.when(same, F.col("__ja1")).otherwise(F.col("__ja2"))
    out = out.withColumn("__found", found)
    return out.withColumn("copied", done("__found")).withColumn(
        "japanese", F.when(F.col("copied"), F.col("__found")).otherwise(F.col("japanese"))
    ).drop("__t1", "__ja1", "__ja2", "__found")


def save(saved: DataFrame, arriving: DataFrame, key: list[str], overwrite: bool = False) -> DataFrame:
    """UPS02: insert, replay (keeps the earlier time), conflict, or overwrite; blank translations are refused.

    Both sides have key, japanese and saved_at; the result adds ``action``.
    """
    old = saved.select(*key, F.col("japanese").alias("__ja"), F.col("saved_at").alias("__at"), F.lit(True).alias("__old"))
    new = arriving.select(*key, F.col("japanese").alias("__nja"), F.col("saved_at").alias("__nat"), F.lit(True).alias("__new"))
    both = old.join(new, key, "full_outer")
    action = (
        F.when(F.col("__new").isNull(), "keep").when(is_blank(F.col("__nja")), "blank")
        .when(F.col("__old").isNull(), "insert").when(F.col("__ja") == F.col("__nja"), "replay")
        .otherwise("overwrite" if overwrite else "conflict")
    )
    takes = F.col("action").isin("insert", "overwrite")
    out = both.withColumn("action", action)
    return out.select(
        *key, F.when(takes, F.col("__nja")).otherwise(F.col("__ja")).alias("japanese"),
        F.when(takes, F.col("__nat")).otherwise(F.col("__at")).alias("saved_at"), "action",
    )


def unit_warnings(old: Column, arriving: Column, original: Column, translated: Column) -> Column:
    """UPS02: earlier, new and invariant warnings, first mentions in order."""
    return ordered_distinct(old, arriving, invariant_warnings(original, translated))


def prepare(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """UPS01: create, resume, or refuse (bad bound, another paper, another language under the same id)."""
    old = jobs.select("job_id", F.col("requested_id").alias("__paper"), F.col("target_language").alias("__lang"), F.lit(True).alias("__old"))
    action = (
        F.when(~F.col("max_characters").between(1000, 30000), "bad_bound").when(F.col("__old").isNull(), "create")
        .when(F.col("requested_id") != F.col("__paper"), "paper_conflict")
        .when(F.col("target_language") != F.col("__lang"), "language_conflict").otherwise("resume")
    )
    return requests.join(old, "job_id", "left").withColumn("action", action).drop("__paper", "__lang", "__old")


def finalize(progress: DataFrame, warnings: DataFrame, source_type: str = "source_type") -> DataFrame:
    """UPS04: complete only when nothing remains; PDF jobs with warnings need review."""
    out = progress.join(warnings, "job_id", "left")
    status = (
        F.when(F.col("remaining") > 0, "pending")
        .when((F.col(source_type) == "pdf") & (F.coalesce("n_warnings", F.lit(0)) > 0), "needs_review").otherwise("completed")
    )
    return out.withColumn("final_status", status)


def payloads(chunked: DataFrame, by: list[str], order: str, glossary: Column | None = None) -> DataFrame:
    """UPS05, TR17: JSON payload of each chunk: policy, glossary and blocks in order."""
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col("unit_id").alias("id"), F.col("source_text").alias("text"))))
    rows = chunked.groupBy(*by, "chunk").agg(blocks.alias("__b"))
    return rows.select(*by, "chunk", F.to_json(F.struct(
        F.lit(POLICY_VERSION).alias("policyVersion"), (glossary if glossary is not None else F.array().cast("array<string>")).alias("glossary"),
        F.transform("__b", lambda b: F.struct(b["id"].alias("id"), b["text"].alias("text"))).alias("blocks"),
    )).alias("payload"))


def cache_key(payload: Column, model: str, effort: str, digits: int = 16) -> Column:
    """UPS09: digest of the canonical request."""
    return F.substring(F.sha2(F.to_json(F.struct(
        F.lit(effort).alias("effort"), F.lit(model).alias("model"), payload.alias("payload"), F.lit(POLICY_VERSION).alias("policy")
    )), 256), 1, digits)


def token_usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """AG13: calls, tokens, cache hits and retries of each run."""
    n = {c: F.sum(c).cast("long").alias(c) for c in ("calls", "input_tokens", "output_tokens", "cache_hits", "retries", "characters")}
    out = calls.groupBy(*by).agg(*n.values())
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


Translator = Callable[[str], str]


def translate_chunks(chunks: DataFrame, cache: DataFrame, translator: Translator, retries: int = 2, workers: int = 4) -> DataFrame:
    """CTL01, CTL02, UDF01: (key, result, source): the cache answers first, then the translator with retries.

    ``chunks`` has key and payload, ``cache`` key and result.  The translator is any picklable function; a
    call that raises is tried again, and after the last one its result is null.
    """
    known = chunks.join(cache, "key").select("key", "result", F.lit("cache").alias("source"))
    todo = chunks.join(cache, "key", "left_anti").select("key", "payload").repartition(workers, "key")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for payload in frame["payload"]:
                result = None
                for _ in range(retries + 1):
                    try:
                        result = translator(payload)
                        break
                    except Exception:  # noqa: BLE001  the contract of the extension point
                        continue
                out.append(result)
            yield pd.DataFrame({"key": frame["key"], "result": out, "source": "translator"})

    return known.unionByName(todo.mapInPandas(run, "key string, result string, source string"))


def stub_translation(text: Column) -> Column:
    """FN50, UDF08: deterministic filler in place of a model."""
    return layout_placeholder(text)


def latest(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """Append and latest wins: the last version of each key."""
    w = W.partitionBy(*key).orderBy(F.desc(at))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
