"""Native document graphs (TR11-TR12, SRC14, FN56, RM19).

The graph of one document is read in one task, to any depth and with cycles: documents are bounded by the export
limits (``contracts.document_limits``), so one shuffle by document replaces a join for every level.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_document(parts: dict[str, DataFrame], columns: list[str], body: Callable[[dict[str, pd.DataFrame]], list[tuple]], schema: str) -> DataFrame:
    """``body`` on each document's rows of all ``parts`` at once (missing columns are null); (doc_id, *schema) rows.

    Parts hold doc_id and some of ``columns``, which are strings.
    """
    first = next(iter(parts.values()))
    tagged = None
    for name, df in parts.items():
        have = set(df.columns)
        own = df.select(
            "doc_id", F.lit(name).alias("__part"),
            *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in columns],
        )
        tagged = own if tagged is None else tagged.unionByName(own)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = list(parts)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = body({k: rows[rows["__part"] == k] for k in kinds})
        out = pd.DataFrame(found, columns=names)
        out.insert(0, "doc_id", key[0])
        return out

    kind = first.schema["doc_id"].dataType.simpleString()
    return tagged.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, {schema}")


def _children(edges: pd.DataFrame, parent: str, child: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for p, c in zip(edges[parent], edges[child], strict=True):
        out.setdefault(p, []).append(c)
    return out


def reached(starts: list[str], to: dict[str, list[str]], barred: frozenset[str] = frozenset()) -> set[str]:
    """Everything that can be reached from ``starts`` (they included) without entering ``barred``."""
    seen, todo = set(starts), list(starts)
    while todo:
        for c in to.get(todo.pop(), ()):
            if c not in seen and c not in barred:
                seen.add(c)
                todo.append(c)
    return seen


def walk(items: DataFrame, edges: DataFrame, root: str = "#/body", furniture_root: str = "#/furniture") -> DataFrame:
    """TR11: items in pre-order from the root, then from the furniture root; each is visited once.

    Adds visit (null where no walk leads to the item), furniture (said by the item or inherited) and order_class:
    0 visited, 1 left over (they follow by page, place and name, SRT05), 2 furniture.
    """
    e = edges.select("doc_id", "parent_ref", "ordinal", "child_ref")
    layers = items.select("doc_id", "ref", (F.coalesce(F.col("content_layer") == "furniture", F.lit(False))).alias("layer"))

    def body(parts: dict[str, pd.DataFrame]) -> list[tuple]:
        own = parts["edges"].assign(n=lambda x: x["ordinal"].astype(float)).sort_values(["n", "child_ref"], kind="stable")
        to = _children(own, "parent_ref", "child_ref")
        layer = dict(zip(parts["items"]["ref"], parts["items"]["layer"] == "true", strict=True))
        seen: dict[str, bool] = {}
        for top, inherited in ((root, False), (furniture_root, True)):
            todo = [(c, inherited) for c in reversed(to.get(top, []))]
            while todo:
                ref, above = todo.pop()
                if ref in seen or ref not in layer:
                    continue
                seen[ref] = above or layer[ref]
                todo += [(c, seen[ref]) for c in reversed(to.get(ref, []))]
        return [(ref, k + 1, f) for k, (ref, f) in enumerate(seen.items())]

    order = per_document({"edges": e, "items": layers}, ["parent_ref", "ordinal", "child_ref", "ref", "layer"], body, "ref string, visit long, inherited boolean")
    out = items.join(order, ["doc_id", "ref"], "left")
    furniture = F.coalesce("inherited", F.col("content_layer") == "furniture", F.lit(False))
    return out.withColumns({
        "furniture": furniture,
        "order_class": F.when(furniture, 2).when(F.col("visit").isNull(), 1).otherwise(0),
    }).drop("inherited")


def fallback_order(visited: Column, page: Column, y: Column, x: Column, ref: Column) -> list[Column]:
    """SRT05: sort keys: visited items in their order, the others by page (those without one last), place and name."""
    return [F.asc_nulls_last(visited), F.asc_nulls_last(page), F.asc_nulls_last(y), F.asc_nulls_last(x), ref.asc()]


def suppressed(edges: DataFrame, visuals: DataFrame, preserved: DataFrame, roots: DataFrame) -> DataFrame:
    """TR12: what hangs below visuals, less what is preserved and what can be reached without a visual."""

    def body(parts: dict[str, pd.DataFrame]) -> list[tuple]:
        to = _children(parts["edges"], "parent_ref", "child_ref")
        v = frozenset(parts["visuals"]["ref"])
        starts = [r for r in parts["roots"]["ref"] if r not in v]
        free = reached(starts, to, v)
        return [(r,) for r in sorted(reached(list(v), to) - v - free - set(parts["preserved"]["ref"]))]

    return per_document(
        {"edges": edges, "visuals": visuals, "preserved": preserved, "roots": roots}, ["parent_ref", "child_ref", "ref"], body, "ref string"
    )


def reachable(starts: DataFrame, edges: DataFrame, node: str, target: str) -> DataFrame:
    """(doc_id, node) of all that links lead to from the starts, these included, whatever the depth."""

    def body(parts: dict[str, pd.DataFrame]) -> list[tuple]:
        return [(x,) for x in sorted(reached(list(parts["starts"][node]), _children(parts["edges"], node, target)))]

    out = per_document({"starts": starts, "edges": edges}, [node, target], body, f"{node} string")
    return out.withColumn(node, F.col(node).cast(starts.schema[node].dataType))


def ancestors(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """(doc_id, ancestor, node) pairs, transitive; a node in a cycle is no ancestor of itself."""

    def body(parts: dict[str, pd.DataFrame]) -> list[tuple]:
        up = {n: p for n, p in zip(parts["rows"][node], parts["rows"][parent], strict=True) if p is not None}
        out = []
        for n in up:
            seen, at = {n}, up.get(n)
            while at is not None and at not in seen:
                out.append((at, n))
                seen.add(at)
                at = up.get(at)
        return out

    kind = rows.schema[node].dataType
    out = per_document({"rows": rows}, [node, parent], body, f"ancestor string, {node} string")
    return out.withColumns({"ancestor": F.col("ancestor").cast(kind), node: F.col(node).cast(kind)})


def surviving(parents: DataFrame) -> DataFrame:
    """(doc_id, block_id, anchor): the nearest of a block and its ancestors that survives; null where none does.

    ``parents``: doc_id, block_id, parent_id, survives.  A parent without a row of its own survives.
    """

    def body(parts: dict[str, pd.DataFrame]) -> list[tuple]:
        rows = parts["rows"]
        up = dict(zip(rows["block_id"], rows["parent_id"], strict=True))
        fine = dict(zip(rows["block_id"], rows["survives"] != "false", strict=True))
        out = []
        for n in up:
            seen, at = set(), n
            while at is not None and not fine.get(at, True) and at not in seen:
                seen.add(at)
                at = up[at]
            out.append((n, None if at in seen else at))
        return out

    kind = parents.schema["block_id"].dataType
    out = per_document({"rows": parents}, ["block_id", "parent_id", "survives"], body, "block_id string, anchor string")
    return out.withColumns({"block_id": F.col("block_id").cast(kind), "anchor": F.col("anchor").cast(kind)})


def item_text(items: DataFrame) -> DataFrame:
    """RM19: the original text first."""
    return items.withColumn("text", F.coalesce(F.nullif(F.col("orig"), F.lit("")), "text", F.lit("")))


def partition_spans(provenance: DataFrame, items: DataFrame) -> DataFrame:
    """FN56: ordered, non-overlapping character spans of an item's places; a drift of two characters at a word's
    edge is taken up, other gaps make the item's spans unsound."""
    rows = provenance.join(items.select("doc_id", "ref", "text"), ["doc_id", "ref"]).select(
        "doc_id", "ref", "ordinal", "page", F.col("span_start").cast("long"), F.col("span_end").cast("long"), "text"
    )

    def item(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["span_start", "ordinal"])
        text, at, sound = p["text"].iloc[0] or "", 0, True
        starts, ends = [], []
        for a, b in zip(p["span_start"], p["span_end"], strict=True):
            if abs(a - at) <= 2:
                a = at
            sound &= a == at and b >= a
            starts.append(a)
            ends.append(b)
            at = b
        if ends and abs(len(text) - ends[-1]) <= 2:
            ends[-1] = len(text)
        sound &= bool(ends) and ends[-1] == len(text)
        return pd.DataFrame({
            "doc_id": p["doc_id"], "ref": p["ref"], "ordinal": p["ordinal"], "page": p["page"], "span_start": starts, "span_end": ends,
            "part": [text[a:b].strip() for a, b in zip(starts, ends, strict=True)], "sound": sound,
        })

    schema = "doc_id string, ref string, ordinal int, page int, span_start long, span_end long, part string, sound boolean"
    return rows.groupBy("doc_id", "ref").applyInPandas(item, schema)
