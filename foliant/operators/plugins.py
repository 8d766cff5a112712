"""Extension points: any picklable function as parser or reviewer, with failures as rows (UDF02, UDF04, CTL03-CTL07,
STR09)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .semantic import override_pages

#: A parser: the bytes of one paper to rows of (page, block_id, role, text, confidence).
Parser = Callable[[bytes], list[tuple[int, str, str, str, float]]]
#: A reviewer: JSON of a page's blocks to JSON of its proposal; raises where it has none.
Reviewer = Callable[[str], str]
_BLOCKS = "doc_id string, parser string, page int, block_id string, role string, text string, confidence double, error string"


def run_parsers(papers: DataFrame, parsers: dict[str, Parser], attempts: int = 2) -> DataFrame:
    """UDF04, CTL06, CTL07: blocks of each paper (doc_id, content) by each parser.

    A parser that fails is tried again, and after the last attempt gives one row with the error; others go on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
                for name, parse in parsers.items():
                    rows: list[tuple] = []
                    for k in range(attempts):
                        try:
                            rows = [(doc_id, name, *b, None) for b in parse(content)]
                            break
                        except Exception as e:  # noqa: BLE001  the contract of the extension point
                            if k + 1 == attempts:
                                rows = [(doc_id, name, None, None, None, None, None, type(e).__name__)]
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCKS.split(", ")])

    return papers.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, _BLOCKS)


def parser_status(blocks: DataFrame) -> DataFrame:
    """CTL07: (parser, papers, failed, blocks) of a run."""
    bad = F.col("error").isNotNull()
    return blocks.groupBy("parser").agg(
        F.count_distinct("doc_id").alias("papers"), F.count_distinct(F.when(bad, F.col("doc_id"))).alias("failed"),
        F.sum(F.when(bad, 0).otherwise(1)).cast("long").alias("blocks"),
    )


def review_pages(pages: DataFrame, reviewer: Reviewer) -> DataFrame:
    """UDF02, CTL04: (doc_id, page, proposal, error) for rows (doc_id, pages, request) that hold one or more pages.

    ``pages`` is an array.  A batch of several pages that fails is asked again page by page, with
    ``{"page":p,"request":...}``; a page that fails too has a null proposal and its error.
    """
    kind = pages.schema["doc_id"].dataType.simpleString()

    def ask(request: str) -> tuple[str | None, str | None]:
        try:
            return reviewer(request), None
        except Exception as e:  # noqa: BLE001  the contract of the extension point
            return None, type(e).__name__

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, numbers, request in zip(frame["doc_id"], frame["pages"], frame["request"], strict=True):
                whole = ask(request)
                alone = whole[1] is not None and len(numbers) > 1
                for p in numbers:
                    proposal, error = ask(f'{{"page":{p},"request":{request}}}') if alone else whole
                    out.append((doc_id, int(p), proposal, error))
            yield pd.DataFrame(out, columns=["doc_id", "page", "proposal", "error"])

    return pages.select("doc_id", "pages", "request").mapInPandas(run, f"doc_id {kind}, page int, proposal string, error string")


def selective_review(base: DataFrame, confidence: DataFrame, review: Callable[[DataFrame], DataFrame], least: float = 0.75) -> DataFrame:
    """CTL05: pages (doc_id, page, confidence) under ``least`` are reviewed; reviewed pages replace the baseline's."""
    weak = confidence.where(F.coalesce("confidence", F.lit(0.0)) < least).select("doc_id", "page")
    return override_pages(base, review(base.join(weak, ["doc_id", "page"], "left_semi")), ["doc_id", "page"])


def poll_seconds(active: Column) -> Column:
    """STR09: how long to wait before jobs (while one is active) or health are looked at again."""
    return F.when(active, 4).otherwise(15)
