"""Shared pieces of the training-data operators.

Words are maximal runs of anything but the six ASCII white-space characters.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialise

__all__ = ["discard", "materialise"]

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[ \\t-\\r]+"

def give_back() -> None:
    """Return what a Python worker has freed to the system, as workers stay between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, as thousands of long texts are too much for a worker's share."""
    now = int("".join(filter(str.isdigit, spark.conf.get(_BATCH))) or 0)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def text_parts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, number) with at most ``most`` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    upto, a = np.cumsum(sizes, dtype=np.int64), 0
    while a < len(sizes):
        done = int(upto[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + most, side="right")))
        yield a, b - a
        a = b


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK_RUN))


def n_words_of(text: Column) -> Column:
    """Number of words of a text (long)."""
    return F.size(words_of(text)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


# --------------------------------------------------------------------------- components


def components_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges and, for each, the smallest vertex of its component."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(ids))
    while len(a):
        pa_, pb = parent[a], parent[b]
        open_ = pa_ != pb
        if not open_.any():
            break
        a, b, pa_, pb = a[open_], b[open_], pa_[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return ids, ids[parent]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by one edge a vertex, to the smallest vertex it reaches there."""
    for batch in batches:
        u, v = (np.asarray(batch.column(i)) for i in (0, 1))
        ids, root = components_of(u, v)
        keep = ids != root
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(root[keep])], names=["u", "v"])


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One large-star or small-star step over edges with u > v.

    The minimum of each neighbourhood is a map-side-combined aggregate; it is written out, so both sides
    of the join that follows are plain exchanges and adaptive execution can split a hub's partition.
    """
    pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    least = materialise(
        pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima"
    )
    met = pairs.join(least, "u")
    if larger:
        new = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    out = materialise(new.where("u > v").distinct(), "star")
    discard(least)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root): every vertex that has an edge, with the smallest vertex it reaches.

    ``edges`` has two long columns.  Alternating large-star and small-star steps; no neighbourhood is ever
    gathered, hubs are handled by partial aggregation and splittable joins.
    """
    e = edges.toDF("u", "v").where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialise(e.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        large = _star(now, True)
        small = _star(large, False)
        discard(large)
        discard(now)
        now = small
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).union(
        now.select("v", F.col("v").alias("root")).distinct()
    )
