"""Packing ordered units into chunks of bounded size (WN01, WN02, AG08-AG12, SRT11, JN09).

A chunk closes when it is not empty and the next unit would exceed the bound; an oversized unit stands
alone.  A document's units are one sorted array folded once; only chunk starts are kept in the fold's state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: Default bounds of the job kinds, and the allowed range.
LEGACY_MAX, SEMANTIC_MAX, JOB_MAX = 14000, 11000, 9000
ALLOWED = (1000, 30000)


def _starts(items: Column, most: int) -> Column:
    """Orders of the units that open a chunk, from an array of struct(o, s) sorted by o."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.transform(F.slice(items, 1, 0), lambda x: x["o"]).alias("starts"))

    def step(a: Column, x: Column) -> Column:
        opens = (a["n"] == 0) | (a["used"] + x["s"] > most)
        return F.struct(
            F.when(opens, x["s"]).otherwise(a["used"] + x["s"]).alias("used"),
            F.lit(1).alias("n"),
            F.when(opens, F.concat(a["starts"], F.array(x["o"]))).otherwise(a["starts"]).alias("starts"),
        )

    return F.aggregate(items, start, step, lambda a: a["starts"])


def pack(units: DataFrame, by: list[str], order: str, size: Column, most: int, out: str = "chunk") -> DataFrame:
    """WN01: adds the 1-based chunk of each unit; ``order`` is unique within ``by``."""
    own = units.withColumn("__s", size.cast("long"))
    row = F.struct(*[own[c] for c in units.columns])
    grouped = own.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__s").alias("s"), row.alias("row")))).alias("__items")
    )
    grouped = grouped.withColumn("__starts", _starts(F.transform("__items", lambda x: F.struct(x["o"].alias("o"), x["s"].alias("s"))), most))
    flat = grouped.select(F.explode("__items").alias("__x"), "__starts")
    return flat.select(
        "__x.row.*", F.size(F.filter("__starts", lambda s: s <= F.col("__x.o"))).cast("long").alias(out)
    )


def adjacent_runs(units: DataFrame, by: list[str], order: str, section: str, out: str = "run") -> DataFrame:
    """Gaps and islands: a section that reappears later starts a new run."""
    w = W.partitionBy(*by).orderBy(order)
    change = F.coalesce((~F.lag(section).over(w).eqNullSafe(F.col(section))).cast("long"), F.lit(1))
    first = F.row_number().over(w) == 1
    return units.withColumn("__new", F.when(first, 1).otherwise(change)).withColumn(
        out, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")
    ).drop("__new")


def pack_sections(units: DataFrame, by: list[str], order: str, section: str, size: Column, most: int) -> DataFrame:
    """WN02: adds run, piece (within its run) and chunk; small sections pack whole, only large ones split."""
    pieces = pack(adjacent_runs(units, by, order, section), [*by, "run"], order, size, most, "piece")
    whole = pieces.groupBy(*by, "run", "piece").agg(F.min(order).alias("__first"), F.sum(size).alias("__size"))
    packed = pack(whole, by, "__first", F.col("__size"), most, "chunk").select(*by, "run", "piece", "chunk")
    return pieces.join(packed, [*by, "run", "piece"])


def untranslated(units: DataFrame, translation: str = "japanese") -> DataFrame:
    """Units without a translation: what HTML jobs re-pack.  PDF jobs pack all, so that ids stay stable."""
    return units.where(is_blank(F.col(translation)))


def chunk_stats(chunked: DataFrame, by: list[str], order: str, unit: str, size: Column, section: str) -> DataFrame:
    """AG08: characters, unit ids in order, section titles in order of first mention."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(unit).alias("u"), F.col(section).alias("s"))))
    return chunked.groupBy(*by, "chunk").agg(F.sum(size).cast("long").alias("characters"), rows.alias("__r")).select(
        *by, "chunk", "characters", F.transform("__r", lambda r: r["u"]).alias("unit_ids"),
        F.array_distinct(F.transform("__r", lambda r: r["s"])).alias("sections"),
    )


def chunk_status(chunked: DataFrame, by: list[str], translation: str) -> DataFrame:
    """AG09, AG11: a chunk is completed when every unit has a translation."""
    return chunked.groupBy(*by, "chunk").agg(
        F.when(F.bool_and(~is_blank(F.col(translation))), "completed").otherwise("pending").alias("status")
    )


def job_progress(chunks: DataFrame, by: list[str]) -> DataFrame:
    """AG09, AG10: completed, total, remaining and a three-state status."""
    out = chunks.groupBy(*by).agg(
        F.count_if(F.col("status") == "completed").alias("completed"), F.count("*").alias("total")
    )
    status = F.when(F.col("completed") == F.col("total"), "translated").when(F.col("completed") > 0, "translating").otherwise("prepared")
    return out.withColumn("remaining", F.col("total") - F.col("completed")).withColumn("status", status)


def next_pending(chunks: DataFrame, by: list[str]) -> DataFrame:
    """SRT11: first chunk that is not completed."""
    return chunks.where("status <> 'completed'").groupBy(*by).agg(F.min("chunk").alias("chunk"))


def translation_counts(units: DataFrame, by: list[str], translation: str, translatable: Column) -> DataFrame:
    """AG12."""
    done = ~is_blank(F.col(translation))
    return units.groupBy(*by).agg(
        F.count_if(translatable).alias("translatable"), F.count_if(translatable & done).alias("translated")
    )


def chunk_units(chunks: DataFrame, units: DataFrame, unit_ids: str = "unit_ids", unit: str = "unit_id") -> DataFrame:
    """JN09: a chunk's units in its order."""
    ids = chunks.select("*", F.posexplode(unit_ids).alias("pos", unit)).drop(unit_ids)
    return ids.join(units, [c for c in ("job_id", "doc_id") if c in chunks.columns and c in units.columns] + [unit])


def source_structure(units: DataFrame, by: list[str], section: str, text: str) -> DataFrame:
    """AG28: distinct sections, units and characters."""
    return units.groupBy(*by).agg(
        F.countDistinct(section).alias("sections"), F.count("*").alias("units"), F.sum(F.length(text)).cast("long").alias("characters")
    )


def chunk_sizes(units: DataFrame, by: list[str], text: str) -> DataFrame:
    """RM44: characters of each chunk."""
    return units.groupBy(*by, "chunk").agg(F.sum(F.length(text)).cast("long").alias("size"))
