"""Sources (SRC01, SRC03, SRC10-SRC19, SRC23-SRC25, SRC28)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.contracts import page_origin_problem

MAX_PAGE_BYTES = 64 * 1024 * 1024


def landed_pages(spark: SparkSession, path: str, url: str = "url", html: str = "html") -> DataFrame:
    """SRC01, SRC03: pages landed by a fetcher, with official origins and sizes only."""
    pages = spark.read.parquet(path)
    return pages.where(page_origin_problem(F.col(url)).isNull() & (F.octet_length(F.col(html)) <= MAX_PAGE_BYTES))


def layout_evidence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC10-SRC13: saved evidence, one JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def flatten_pages(evidence: DataFrame) -> DataFrame:
    """SRC11: one row a block of nested page evidence."""
    return evidence.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.page").alias("page"), F.explode("p.blocks").alias("b")).select("doc_id", "page", "b.*")


def json_documents(texts: DataFrame, value: str, schema: str) -> DataFrame:
    """SRC14: typed documents; unreadable ones get nulls."""
    return texts.withColumn("document", F.from_json(value, schema, {"mode": "PERMISSIVE"}))


@F.pandas_udf(StringType())
def strict_json_problem(text: pd.Series) -> pd.Series:
    """SRC15: duplicate_key, non_finite or unreadable; null for sound JSON."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(keys) != len(set(keys)):
            raise KeyError
        return dict(items)

    def constant(_):
        raise OverflowError

    def one(t):
        try:
            json.loads(t, object_pairs_hook=pairs, parse_constant=constant)
        except KeyError:
            return "duplicate_key"
        except OverflowError:
            return "non_finite"
        except (ValueError, TypeError, RecursionError):
            return "unreadable"
        return None

    return text.map(one)


def lenient_json(text: Column) -> Column:
    """SRC17: a VARIANT of the whole text, else of what stands from the first { to the last }."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))))


def model_events(lines: DataFrame, by: str = "run_id", order: str = "line_no", value: str = "value") -> DataFrame:
    """SRC16: last agent message and summed token usage of each run; bad lines are skipped."""
    schema = "type string, item struct<type:string,text:string>, usage struct<input_tokens:long,output_tokens:long>"
    e = lines.withColumn("e", F.from_json(value, schema)).where("e.type is not null")
    message = F.when(F.col("e.item.type") == "agent_message", F.col(order))
    return e.groupBy(by).agg(
        F.max_by("e.item.text", message).alias("message"), F.coalesce(F.sum("e.usage.input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("e.usage.output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def list_jobs(manifests: DataFrame) -> DataFrame:
    """SRC19: the first readable manifest of each job by kind, newest first."""
    w = W.partitionBy("job_id").orderBy("priority", F.desc("updated_at"))
    first = manifests.where("job_id is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first.orderBy(F.desc("updated_at"), "job_id")


def corpus_files(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """SRC25: the first ``limit`` (1 to 100) files by name."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    names = files.select("path").orderBy("path").limit(limit)  # contents are read of these only
    return files.select("path", "length", "content").join(F.broadcast(names), "path", "left_semi").orderBy("path")


def upload_problem(body: Column, seconds: Column) -> Column:
    """SRC23, SRC28."""
    return F.when(F.octet_length(body) > 51 * 1024 * 1024, "too_large").when(seconds > 60, "too_slow").when(F.substring(body, 1, 5) != F.lit(b"%PDF-"), "not_pdf")


def duplicate_sources(arriving: DataFrame, stored: DataFrame, content: str = "content") -> DataFrame:
    """SRC24: arrivals whose digest is stored already."""
    a = arriving.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    return a.join(stored.select("sha256").distinct(), "sha256", "left_semi")


def url_candidates(refs: DataFrame, base: str = "base", raw: str = "raw") -> DataFrame:
    """SRC08: (.., k, url): the standard join first, then one below the page's own folder."""
    origin = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"/[^/]*$", "/")
    standard = F.when(F.col(raw).rlike("^[a-z]+://"), F.col(raw)).when(F.col(raw).startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), raw)).when(
        F.col(raw).startswith("/"), F.concat(origin, raw)).otherwise(F.concat(folder, raw))
    fallback = F.when(~F.col(raw).rlike("^[a-z]+://|^/"), F.concat(F.regexp_replace(base, r"[?#].*$|/+$", ""), F.lit("/"), raw))
    return refs.select("*", F.posexplode(F.array_distinct(F.array_compact(F.array(standard, fallback)))).alias("k", "url"))


def first_success(attempts: DataFrame, by: list[str]) -> DataFrame:
    """SRC09: the first attempt that succeeded; the joined errors where none did."""
    errors = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "error"))), lambda x: x["error"]), "; ")
    return attempts.groupBy(*by).agg(F.min_by("url", F.when(F.col("ok"), F.col("k"))).alias("url"), errors.alias("errors")).withColumn(
        "errors", F.when(F.col("url").isNull(), F.col("errors"))
    )
