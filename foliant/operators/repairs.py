"""Repairs from printed evidence: addresses, caption chains, visual splits (FN24-FN25, FLT26, WN15, RM32, RP12, RP14-RP15,
JN34, SRT10, SRT12, GEO11, UDF06)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import geometry as G
from ..functions.text import caption_match, squeeze

_PRINTED_URL = re.compile(r"(?i)\bhttps?\s*:\s*/\s*/|\bwww\s*\.")


def align_url(text: str, start: int, uri: str) -> tuple[bool, float, int] | None:
    """FN24: (complete, share of the address matched, end), comparing ASCII letters and digits only."""
    want = [c for c in uri.lower() if c.isascii() and c.isalnum()]
    if not want:
        return None
    met, end = 0, start
    for at in range(start, len(text)):
        if met == len(want):
            break
        c = text[at]
        if c.isascii() and c.isalnum():
            if c.lower() != want[met]:
                break
            met, end = met + 1, at + 1
    complete = met == len(want)
    if complete and uri.rstrip().endswith("/"):
        slash = re.match(r"\s*/", text[end:])
        end += slash.end() if slash else 0
    elif not complete:
        end = len(text[: end + re.match(r"[\s\-_/]*", text[end:]).end()].rstrip())
    share = met / len(want)
    printed = re.sub(r"\s+", "", text[start:end]).lower()
    dangling = printed.endswith(("-", "_", "/")) and uri.lower().startswith(printed)
    return (complete, share, end) if complete or share >= 0.55 or dangling else None


def restore_urls(text: str, uris: list[str]) -> str:
    """FN25: each printed address gets the best-matching annotation; ties between incomplete matches are left."""
    for start in reversed([m.start() for m in _PRINTED_URL.finditer(text)]):
        found = sorted(((a, u) for u in dict.fromkeys(uris) if (a := align_url(text, start, u))), reverse=True)
        if not found or (len(found) > 1 and not found[0][0][0] and found[0][0] == found[1][0]):
            continue
        text = text[:start] + found[0][1] + text[found[0][0][2] :]
    return text


@F.pandas_udf(StringType())
def with_annotated_urls(text: pd.Series, uris: pd.Series) -> pd.Series:
    """RP15: block text with its link annotations' addresses."""
    return pd.Series([None if t is None else restore_urls(t, list(u) if u is not None else []) for t, u in zip(text, uris, strict=True)])


def caption_record(text: Column, label: Column, owned: Column) -> Column:
    """FLT26: starts with an object label, and is a caption by class, owner or delimiter."""
    rest = F.regexp_replace(text, r"(?i)^\s*(?:figure|fig\.?|table|algorithm)\s*\S*?\d[\w.\-]*", "")
    starts = text.rlike(r"(?i)^\s*(?:figure|fig\.?|table|algorithm)\s*(?:[A-Z]\.)?\d")
    return starts & ((label == "caption") | owned | F.ltrim(rest).rlike(r"^(?:$|[:.\-–—])"))


def internal_caption(text: Column, box: Column, visual: Column) -> Column:
    """FLT26, RP12: a figure caption well inside a tall visual."""
    c = caption_match(text, F.lit(0.0), F.lit(1.0))
    shared = F.greatest(F.lit(0.0), F.least(box["x1"], visual["x1"]) - F.greatest(box["x0"], visual["x0"])) / F.greatest(F.lit(1e-9), box["x1"] - box["x0"])
    return (
        F.coalesce(c["kind"] == "figure", F.lit(False)) & text.rlike(r"(?i)^\s*fig(?:ure|\.)?\s*[\w.]*\d\w*\s*[:.\-–—]") & (F.length(F.trim(text)) >= 12)
        & (visual["y1"] - visual["y0"] >= 0.22) & (shared >= 0.7) & (box["y0"] >= visual["y0"] + 0.025) & (box["y1"] <= visual["y1"] - 0.025)
    )


def overlarge_visuals(visuals: DataFrame, blocks: DataFrame) -> DataFrame:
    """RP12: visuals that a caption inside them cuts; they end where the first such caption begins."""
    b = blocks.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), F.col("bbox_norm").alias("__b"), F.col("text").alias("__t"))
    on = (visuals["doc_id"] == b["__d"]) & (visuals["page"] == b["__p"]) & internal_caption(b["__t"], b["__b"], visuals["bbox_norm"])
    cut = visuals.join(b, on).groupBy("doc_id", "page", "object_id").agg(F.min("__b.y0").alias("__y"))
    out = visuals.join(cut, ["doc_id", "page", "object_id"], "left")
    v = F.col("bbox_norm")
    return out.withColumns({
        "recovered": F.col("__y").isNotNull(), "bbox_norm": F.when(F.col("__y").isNotNull(), G.rect(v["x0"], v["y0"], v["x1"], F.col("__y") - 0.005)).otherwise(v),
    }).drop("__y")


def parallel_splits(visuals: DataFrame, lines: DataFrame, least_gap: float = 0.003, least_side: float = 0.20) -> DataFrame:
    """RP14: wide visuals over which exactly two labels of one family stand side by side become two.

    The cut is halfway between the labels' columns; each side keeps a fifth of the width or more.  ``ink_gap``
    of the visual, where it is known, must be wide enough.
    """
    label = r"(?i)^\s*(Table|Algorithm)\s+([A-Z]?\d[\w.]*)"
    n = lines.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), F.col("bbox_norm").alias("__b"), squeeze(F.col("text")).alias("__t")).where(F.col("__t").rlike(label))
    v = visuals.where(F.col("bbox_norm.x1") - F.col("bbox_norm.x0") >= 0.45)
    near = (n["__b.x1"] >= v["bbox_norm.x0"] - 0.025) & (n["__b.x0"] <= v["bbox_norm.x1"] + 0.025) & (n["__b.y1"] >= v["bbox_norm.y0"] - 0.032) & (n["__b.y0"] <= v["bbox_norm.y1"] + 0.006)
    rows = v.join(n, (v["doc_id"] == n["__d"]) & (v["page"] == n["__p"]) & near)
    name = F.initcap(F.regexp_extract("__t", label, 1))
    center = (F.col("__b.x0") + F.col("__b.x1")) / 2
    first = rows.withColumns({"family": name, "label": F.concat(name, F.lit(" "), F.regexp_extract("__t", label, 2)), "center": center})
    one = first.groupBy("doc_id", "page", "object_id", "bbox_norm", "ink_gap", "family", "label").agg(F.min("center").alias("center"))
    g = one.groupBy("doc_id", "page", "object_id", "bbox_norm", "ink_gap").agg(
        F.countDistinct("family").alias("families"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("center", "label"))).alias("s")
    ).where("families = 1 and n = 2")
    left, right = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    box = F.col("bbox_norm")
    mid, cut = (box["x0"] + box["x1"]) / 2, (left["center"] + right["center"]) / 2
    share = (cut - box["x0"]) / (box["x1"] - box["x0"])
    fits = (left["center"] < mid - 0.035) & (right["center"] > mid + 0.035) & (right["center"] - left["center"] >= 0.18) & share.between(least_side, 1 - least_side)
    g = g.where(fits & (F.coalesce("ink_gap", F.lit(1.0)) >= least_gap))
    sides = F.array(
        F.struct(left["label"].alias("label"), G.rect(box["x0"], box["y0"], cut, box["y1"]).alias("bbox_norm")),
        F.struct(right["label"].alias("label"), G.rect(cut, box["y0"], box["x1"], box["y1"]).alias("bbox_norm")),
    )
    return g.select("doc_id", "page", "object_id", F.explode(sides).alias("x")).select("doc_id", "page", "object_id", "x.label", "x.bbox_norm")


def merge_line_fragments(lines: DataFrame) -> DataFrame:
    """WN15: fragments of one printed line, joined while exactly one neighbour fits in level, size and gap.

    Columns doc_id, page, line_id, text, size, baseline, x0, x1.
    """

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        todo = rows.sort_values(["baseline", "x0", "line_id"]).to_dict("records")
        out = []
        while todo:
            now = todo.pop(0)
            while True:
                fit = [
                    k for k, r in enumerate(todo)
                    if abs(r["baseline"] - now["baseline"]) <= max(0.7, now["size"] * 0.10) and 0.84 <= r["size"] / max(now["size"], 0.01) <= 1.16
                    and -now["size"] * 0.18 <= r["x0"] - now["x1"] <= now["size"] * 1.45
                ]
                if len(fit) != 1:
                    break
                r = todo.pop(fit[0])
                space = " " if r["x0"] - now["x1"] > now["size"] * 0.18 and not now["text"].endswith(" ") and not r["text"].startswith(" ") else ""
                now = {**now, "text": now["text"] + space + r["text"], "x1": max(now["x1"], r["x1"]), "size": max(now["size"], r["size"])}
            out.append(now)
        return pd.DataFrame(out, columns=list(rows.columns))

    return lines.groupBy("doc_id", "page").applyInPandas(page, lines.schema)


def caption_chain(lines: DataFrame, starts: DataFrame, most: int = 7) -> DataFrame:
    """WN15, RM32: lines that go on from a caption's first line, at most ``most``, until one ends a sentence inside the box.

    ``starts`` has doc_id, page, block_id, line_id and the caption's y1; a step without exactly one compatible
    line gives no result (the caption then stays as it was).
    """
    s = starts.select("doc_id", "page", "block_id", F.col("line_id").alias("start_id"), F.col("y1").alias("box_y1"))
    rows = s.join(lines, ["doc_id", "page"])

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "page", "block_id", "text"]
        every = p.to_dict("records")
        now = next((r for r in every if r["line_id"] == r["start_id"]), None)
        if now is None:
            return pd.DataFrame([], columns=columns)
        parts, first = [now["text"]], now
        for _ in range(most):
            if now["y1"] >= now["box_y1"] - max(1.5, now["size"] * 0.2) and re.search(r"[.!?]['\"’”)\]]*\s*$", now["text"]):
                return pd.DataFrame([(now["doc_id"], now["page"], now["block_id"], " ".join(parts))], columns=columns)
            step = [r for r in every if now["baseline"] + max(1.0, now["size"] * 0.38) < r["baseline"] <= now["baseline"] + now["size"] * 1.75]
            if not step:
                break
            level = min(r["baseline"] for r in step)
            fit = [r for r in step if abs(r["baseline"] - level) <= max(1.0, now["size"] * 0.2) and 0.84 <= r["size"] / first["size"] <= 1.16 and abs(r["x0"] - first["x0"]) <= first["size"] * 2.5]
            if len(fit) != 1:
                break
            now = fit[0]
            parts.append(now["text"])
        return pd.DataFrame([], columns=columns)

    return rows.groupBy("doc_id", "page", "block_id").applyInPandas(chain, "doc_id string, page int, block_id string, text string")


def top_one(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """SRT10: the first row of each group by a full order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def cap(values: Column, most: int) -> Column:
    """SRT12: the first entries of a list of findings."""
    return F.slice(values, 1, most)


def render_titles(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """JN34: nodes shown with the text of the unit of their id."""
    u = units.select("doc_id", F.col("unit_id").alias("node_unit"), F.coalesce(F.nullif(F.trim("japanese"), F.lit("")), "original").alias("shown"))
    return nodes.join(u, ["doc_id", "node_unit"], "left")


def is_blank_crop(samples: Column, least: int = 250) -> Column:
    """GEO11: no grey sample of a crop is darker than the limit (samples come from outside)."""
    return ~F.exists(samples, lambda s: s < least)
