"""The paper library: summary, facets, tags, search, review and publication (SRC20-SRC22, JN10-JN11, AG19-AG20,
FLT15-FLT18, SRT06-SRT07, UPS03, UPS06-UPS08, SET09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import author_label, is_blank, normalize_tags, squeeze

ACTIVE = ["preparing", "prepared", "translating"]
STATUSES = ["preparing", "prepared", "translating", "translated", "needs_review", "completed", "failed"]
RENDERER_GENERATION = "3"


def pick_manifest(manifests: DataFrame, by: str = "slug") -> DataFrame:
    """SRC19, SRC21: the first manifest, by priority, that has a job id and a title."""
    sound = manifests.where(~is_blank(F.col("job_id")) & ~is_blank(F.col("title")))
    w = W.partitionBy(by).orderBy("priority")
    return sound.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def source_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """SRC22: meta title, authors and date by pattern."""
    meta = lambda name, k: F.regexp_extract_all(
        F.col(html), F.lit(rf"(?is)<meta\s[^>]*name=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']"), F.lit(k)
    )
    return pages.withColumns({
        "meta_title": F.get(meta("citation_title", 1), F.lit(0)), "meta_authors": F.array_distinct(meta("citation_author", 1)),
        "meta_date": F.get(meta("citation_date", 1), F.lit(0)),
    })


def normalize_status(status: Column, source_type: Column, provider: Column, qa: Column) -> Column:
    """UPS07: unknown states need review; an untranslated PDF preview that passed its checks awaits a worker."""
    known = F.when(status.isin(STATUSES), status).otherwise("needs_review")
    waits = (known == "needs_review") & (source_type == "pdf") & (provider == "none") & (qa == "passed")
    return F.when(waits, "prepared").otherwise(known)


def summarize(papers: DataFrame, progress: DataFrame, state: DataFrame, qa: DataFrame, key: str = "slug") -> DataFrame:
    """SRC20, JN10, JN11: one row a paper with progress, state and checks, defaults where a side is missing."""
    out = papers.join(progress, key, "left").join(state, key, "left").join(qa, key, "left")
    return out.withColumns({
        "completed": F.coalesce("completed", F.lit(0)), "total": F.coalesce("total", F.lit(0)),
        "tags": F.coalesce("tags", F.array().cast("array<string>")), "is_read": F.coalesce("is_read", F.lit(False)),
        "favorite": F.coalesce("favorite", F.lit(False)), "qa_status": F.coalesce("qa_status", F.lit("missing")),
    })


def is_active(status: Column) -> Column:
    """FLT16."""
    return status.isin(ACTIVE)


def can_copy_request(status: Column) -> Column:
    """FLT16."""
    return status.isin("prepared", "translating")


def needs_review(status: Column, qa: Column) -> Column:
    """FLT15: missing checks count only for a completed paper."""
    return status.isin("needs_review", "failed") | (qa == "failed") | ((status == "completed") & (qa == "missing"))


def is_publishable(status: Column, source_type: Column, provider: Column, renderer: Column) -> Column:
    """FLT18."""
    done = F.coalesce(status, F.lit("")).isin("completed", "needs_review")
    preview = (source_type == "pdf") & F.coalesce(provider == "none", F.lit(False)) & (status == "needs_review")
    stamped = F.coalesce(renderer, F.lit("")).rlike(rf"^{RENDERER_GENERATION}-[0-9a-f]{{12}}$")
    return done & ~preview & ((source_type != "arxiv") | stamped)


def pipeline_status(failed: Column, translated: Column, warned: Column) -> Column:
    """UPS06: failed, then prepared, then needs_review, then completed."""
    return F.when(failed, "failed").when(~translated, "prepared").when(warned, "needs_review").otherwise("completed")


def facet_counts(papers: DataFrame) -> DataFrame:
    """AG19: independent counts over all papers."""
    return papers.agg(
        F.count("*").alias("all"), F.count_if(is_active(F.col("status"))).alias("active"),
        F.count_if(needs_review(F.col("status"), F.col("qa_status"))).alias("review"),
        F.count_if(~F.col("is_read")).alias("unread"), F.count_if("favorite").alias("favorites"),
    )


def tag_histogram(papers: DataFrame) -> DataFrame:
    """AG20: papers a tag, most first, then by tag."""
    return papers.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def visible(papers: DataFrame, query: str = "", facet: str = "all", tag: str | None = None) -> DataFrame:
    """FLT17: facet, tag, and case-insensitive substring over title, authors, ids and tags."""
    out = papers
    tests = {
        "active": is_active(F.col("status")), "review": needs_review(F.col("status"), F.col("qa_status")),
        "unread": ~F.col("is_read"), "favorites": F.col("favorite"),
    }
    if facet in tests:
        out = out.where(tests[facet])
    if tag:
        out = out.where(F.array_contains("tags", tag))
    needle = query.strip().lower()
    if needle:
        text = [F.array("title"), F.col("authors"), F.array("requested_id", "resolved_id"), F.col("tags")]
        every = F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in text])
        out = out.where(F.exists(every, lambda v: F.coalesce(F.contains(F.lower(v), F.lit(needle)), F.lit(False))))
    return out


def sort_papers(papers: DataFrame, by: str = "updated") -> DataFrame:
    """SRT06, SRT07: newest first, or by title, author or first tag; papers without a tag last."""
    newest = {"updated": "updated_at", "added": "created_at", "published": "published_at"}
    if by in newest:
        return papers.orderBy(F.desc_nulls_last(newest[by]), "slug")
    key = {"title": F.lower("title"), "author": F.lower(author_label(F.col("authors"))), "tag": F.lower(F.get("tags", F.lit(0)))}[by]
    return papers.orderBy(key.asc_nulls_last(), "slug")


def apply_patches(state: DataFrame, patches: DataFrame, key: str = "slug") -> DataFrame:
    """UPS03, SET09: replace tags, or add and remove them; booleans replace; an unsound patch changes nothing.

    ``problem`` names why a patch was refused: no_field, replace_and_mutate or bad_tags.
    """
    p = patches.select(
        key, F.col("tags").alias("__tags"), F.col("add_tags").alias("__add"), F.col("remove_tags").alias("__remove"),
        F.col("is_read").alias("__read"), F.col("favorite").alias("__fav"), F.lit(True).alias("__patch"),
    )
    both = state.join(p, key, "full_outer")
    none = F.array().cast("array<string>")
    have = F.coalesce(normalize_tags(F.col("tags")), none)
    added = normalize_tags(F.concat(have, F.coalesce(normalize_tags(F.col("__add")), none)))
    lower = lambda a: F.transform(F.coalesce(a, none), lambda t: F.lower(squeeze(t)))
    mutated = F.filter(added, lambda t: ~F.array_contains(lower(F.col("__remove")), F.lower(t)))
    tags = F.when(F.col("__tags").isNotNull(), normalize_tags(F.col("__tags"))).otherwise(mutated)
    empty = F.coalesce("__tags", "__add", "__remove").isNull() & F.col("__read").isNull() & F.col("__fav").isNull()
    problem = F.when(F.col("__patch").isNull(), None).when(empty, "no_field").when(
        F.col("__tags").isNotNull() & (F.col("__add").isNotNull() | F.col("__remove").isNotNull()), "replace_and_mutate"
    ).when(tags.isNull() | (F.col("__add").isNotNull() & normalize_tags(F.col("__add")).isNull()), "bad_tags")
    out = both.withColumn("problem", problem)
    ok = F.col("__patch").isNotNull() & F.col("problem").isNull()
    return out.select(
        key, F.when(ok, tags).otherwise(have).alias("tags"),
        F.coalesce(F.when(ok, F.col("__read")), F.col("is_read"), F.lit(False)).alias("is_read"),
        F.coalesce(F.when(ok, F.col("__fav")), F.col("favorite"), F.lit(False)).alias("favorite"), "problem",
    )
