"""Parser summaries and gold evaluation (AG15-AG17, JN27-JN28, SNK13, RM31, CTL07)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def _map_of_counts(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    n = rows.groupBy(*by, F.coalesce(F.col(value), F.lit("unknown")).alias("k")).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("k", "n")))
    return n.groupBy(*by).agg(F.map_from_entries(pairs).alias(out))


def parser_summary(assignments: DataFrame, visuals: DataFrame, by: list[str], low: float = 0.7) -> DataFrame:
    """AG15: assignments, hidden and low-confidence ones, mean confidence to four places, counts of roles and kinds."""
    out = assignments.groupBy(*by).agg(
        F.count("*").alias("assignments"), F.count_if("hidden").alias("hidden"), F.count_if(F.col("confidence") < low).alias("low_confidence"),
        F.bround(F.avg("confidence"), 4).alias("mean_confidence"),
    )
    out = out.join(_map_of_counts(assignments, by, "role", "roles"), by, "left")
    return out.join(_map_of_counts(visuals, by, "kind", "visual_objects"), by, "left")


def parser_pivot(summaries: DataFrame, row: str, parser: str, value: str, parsers: list[str]) -> DataFrame:
    """AG16: a row a paper, a column a parser."""
    return summaries.groupBy(row).pivot(parser, parsers).agg(F.first(value))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def precision_recall(gold: DataFrame, candidate: DataFrame, by: list[str], key: str, prefix: str) -> DataFrame:
    """AG17: precision, recall (1 for empty denominators) and F1 (0) of two sets of keys."""
    g = gold.select(*by, key).distinct().withColumn("__g", F.lit(1))
    c = candidate.select(*by, key).distinct().withColumn("__c", F.lit(1))
    n = g.join(c, [*by, key], "full_outer").groupBy(*by).agg(
        F.count("__g").alias("g"), F.count("__c").alias("c"), F.count_if(F.col("__g").isNotNull() & F.col("__c").isNotNull()).alias("both")
    )
    p = F.when(F.col("c") > 0, F.col("both") / F.col("c")).otherwise(1.0)
    r = F.when(F.col("g") > 0, F.col("both") / F.col("g")).otherwise(1.0)
    return n.select(*by, p.alias(f"{prefix}_precision"), r.alias(f"{prefix}_recall"), _f1(p, r).alias(f"{prefix}_f1"))


def block_agreement(gold: DataFrame, candidate: DataFrame, by: list[str], key: str = "block_id") -> DataFrame:
    """JN27, AG17: coverage, role and hidden accuracy over the shared blocks."""
    c = candidate.select(*by, key, F.col("role").alias("__r"), F.col("hidden").alias("__h"), F.lit(True).alias("__c"))
    both = gold.join(c, [*by, key], "left")
    shared = F.count("__c")
    share = lambda n: F.when(shared > 0, n / shared).otherwise(0.0)
    return both.groupBy(*by).agg(
        F.count("*").alias("gold"), shared.alias("shared"), F.when(F.count("*") > 0, shared / F.count("*")).otherwise(1.0).alias("coverage"),
        share(F.count_if(F.col("role") == F.col("__r"))).alias("role_accuracy"),
        share(F.count_if(F.col("hidden") == F.col("__h"))).alias("hidden_accuracy"),
    )


def match_visuals(gold: DataFrame, candidate: DataFrame) -> DataFrame:
    """JN28: gold visuals in order each take the unused candidate of their page, kind and label with most overlap."""
    c = candidate.select("doc_id", "page", "kind", F.lower(F.coalesce("label", F.lit(""))).alias("__label"), F.col("object_id").alias("candidate_id"), F.col("bbox_norm").alias("__box"))
    g = gold.select("doc_id", "page", "kind", "object_id", "ordinal", F.lower(F.coalesce("label", F.lit(""))).alias("__own"), "bbox_norm")
    # a candidate stands under its label and under none, where visuals without a label look; so the label is a join key
    c = c.withColumn("__own", F.explode(F.array_distinct(F.array("__label", F.lit(""))))).drop("__label")
    pairs = g.join(c, ["doc_id", "page", "kind", "__own"]).select(
        "doc_id", "page", "object_id", "ordinal", "candidate_id", G.iou(F.col("bbox_norm"), F.col("__box")).alias("iou")
    )
    best = F.desc_nulls_last(F.nanvl("iou", F.lit(None).cast("double")))
    rows = pairs.repartition("doc_id", "page").sortWithinPartitions(
        "doc_id", "page", F.asc_nulls_last("ordinal"), F.asc_nulls_last("object_id"), best, F.asc_nulls_last("candidate_id"))

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a page stand together, by gold visual, its best candidate first; only the ids of one page are held."""
        page, met, used = None, set(), set()
        for batch in batches:
            keep = []
            for doc, at, own, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page", "object_id", "candidate_id"))):
                if (doc, at) != page:
                    page, met, used = (doc, at), set(), set()
                keep.append(own is not None and own not in met and other not in used)
                if keep[-1]:
                    met.add(own)
                    used.add(other)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(greedy, pairs.schema)


def evaluate(gold: dict[str, DataFrame], candidate: dict[str, DataFrame]) -> DataFrame:
    """AG17: the whole comparison, a row a document; tables assignments, sections and visuals on both sides."""
    by = ["doc_id"]
    pages = gold["assignments"].select("doc_id", "page").distinct()
    own = candidate["assignments"].join(pages, ["doc_id", "page"], "left_semi")
    head = lambda a: a.where("role = 'heading'")
    name = lambda s: s.select("doc_id", F.lower(F.coalesce("number", "section_id")).alias("section"))
    out = block_agreement(gold["assignments"], own, by)
    out = out.join(precision_recall(head(gold["assignments"]), head(own), by, "block_id", "heading"), by, "left")
    out = out.join(precision_recall(name(gold["sections"]), name(candidate["sections"]), by, "section", "section"), by, "left")
    met = match_visuals(gold["visuals"], candidate["visuals"]).groupBy("doc_id").agg(F.count("*").alias("matched"), F.avg("iou").alias("mean_iou"))
    out = out.join(met, by, "left")
    return out.fillna({"matched": 0, "mean_iou": 0.0})


def benchmark_rows(summaries: DataFrame) -> DataFrame:
    """SNK13: Markdown rows of the report."""
    return summaries.select(F.format_string(
        "| %s | %s | %s | %s |", "doc_id", "parser", F.col("assignments").cast("string"), F.col("mean_confidence").cast("string")
    ).alias("line"))
