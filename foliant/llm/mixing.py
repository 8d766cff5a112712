"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over permuted blocks.

Every source is dealt into blocks by a hash of the document id; a second hash permutes the blocks.  A
source's target is a number of whole passes over it and a part of one more; the part is a prefix of its
permuted blocks, and of the block at the end the documents up to a hash threshold.  The block draws of all
sources are then split among the output shards: at each node of a binary tree, a multivariate hypergeometric
draw says how many of each source's draws go left, so every shard has its exact share and a random
composition.  The leaves' quotas cut each source's permuted draws into disjoint runs, and a shard orders its
documents by a hash.

Only tables with a row a source or a row a block reach the driver; both are bounded (``MAX_BLOCKS``).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, n_words_of

WEIGHTS = (1, 2, 3)
MOST = 3
SHARDS = 16
SEED = 20240607
#: Blocks of all sources together; a source has at least one, and about one for 16 documents.
MAX_BLOCKS = 32768
DOCS_A_BLOCK = 16


def targets_of(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of sum(sizes) by weight; a share over ``most`` sizes stops there and its excess is reshared."""
    total = float(sum(sizes))
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        share = {i: left * weights[i] / weight for i in free}
        over = [i for i in sorted(free) if share[i] > most * sizes[i]]
        if not over:
            for i, s in share.items():
                out[i] = s
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
            free.discard(i)
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources: how many of each source's draws every shard gets; columns add up to the quotas.

    Each shard's total is its exact share of all draws (shares differ by one at most).
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def divide(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        # the first (total mod shards) leaves of a subtree hold one more
        base, extra = divmod(total, hi - lo)
        take = base * (mid - lo) + min(extra, mid - lo)
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if take else np.zeros_like(have)
        divide(lo, mid, left)
        divide(mid, hi, have - left)

    divide(0, shards, np.array(quotas, np.int64))
    return out


def _unit(*columns: Column) -> Column:
    """Uniform hash in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def plan(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sources, draws) for documents with columns doc_id, source, size.

    sources: a row a source with source_size, target, passes, blocks, and where its last pass stops
    (end_block: the permuted rank of the block cut there, end_hash: the largest hash taken of it).
    draws: a row a block with the shard of each of its draws, in order of the passes.
    """
    spark = docs.sparkSession
    rows = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))  # Python compares code points
    sizes = [r["size"] or 0 for r in rows]
    targets = targets_of(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    room = max(1, MAX_BLOCKS // max(1, len(rows)))
    table = []
    for i, r in enumerate(rows):
        passes = min(MOST, int(targets[i] // sizes[i])) if sizes[i] else 0
        part = targets[i] - passes * sizes[i]
        table.append((r[0], i, sizes[i], targets[i], passes, part, max(1, min(room, math.ceil(r["n"] / DOCS_A_BLOCK)))))
    sources = spark.createDataFrame(
        table, "source string, nr int, source_size long, target double, passes int, part double, blocks int"
    )
    placed = docs.join(_small(sources, len(rows)), docs["source"].eqNullSafe(sources["source"])).drop(docs["source"])
    block = _block(F.col("doc_id"), F.col("blocks"), seed)
    sums = (
        placed.groupBy("nr", block.alias("block")).agg(F.sum("size").alias("words"))
        .withColumn("place", F.xxhash64("nr", "block", F.lit(seed), F.lit("place")))
    )
    by_place = W.partitionBy("nr").orderBy("place", "block")  # at most MAX_BLOCKS rows in all
    sums = materialise(
        sums.withColumn("rank", F.row_number().over(by_place) - 1).withColumn(
            "before", F.sum("words").over(by_place) - F.col("words")
        ),
        "blocks",
    )
    part = F.col("part")
    cut = sums.join(_small(sources.select("nr", "part"), len(rows)), "nr")
    full = cut.where(F.col("before") + F.col("words") <= part).groupBy("nr").agg(F.count("*").alias("end_block"))
    full = {r[0]: r[1] for r in full.collect()}
    ends = spark.createDataFrame(
        [(t[1], full.get(t[1], 0), t[5]) for t in table], "nr int, end_block long, part double"
    )
    edge = sums.join(_small(ends, len(rows)), "nr").where(F.col("rank") == F.col("end_block")).select(
        "nr", "block", (F.col("part") - F.col("before")).alias("rest")
    )
    inside = placed.select("nr", "doc_id", "size", block.alias("block"), _order(F.col("doc_id"), seed).alias("h")).join(
        _small(edge, len(rows)), ["nr", "block"]
    )
    by_hash = inside.groupBy("nr", "h").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    upto = F.sum("size").over(W.partitionBy("nr").orderBy("h"))  # the documents of one block of each source
    # a document is taken when that brings the sum nearer to the target than leaving it out
    near = by_hash.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    stop = {r[0]: r[1] for r in near.groupBy("nr").agg(F.max("h")).collect()}
    made = {r[0]: r[1] for r in sums.groupBy("nr").agg(F.count("*")).collect()}
    full_table = [(*t, full.get(t[1], 0), stop.get(t[1]), made.get(t[1], 0)) for t in table]
    sources = spark.createDataFrame(
        full_table,
        "source string, nr int, source_size long, target double, passes int, part double, blocks int,"
        " end_block long, end_hash double, made long",
    )
    # draws of a source: every block once a pass, then the last pass's blocks, the cut one included
    quotas = [t[4] * t[9] + (0 if t[2] == 0 else t[7] + (t[8] is not None)) for t in full_table]
    leaves = split_quotas(quotas, shards, seed)
    ends_of = np.cumsum(leaves, axis=0)  # draw p of source s goes to the first shard whose end is over p
    runs = spark.createDataFrame(
        [(t[1], t[4], t[9], t[7], t[8] is not None, [int(x) for x in ends_of[:, i]]) for i, t in enumerate(full_table)],
        "nr int, passes int, made long, end_block long, cut boolean, ends array<long>",
    )
    joined = sums.join(_small(runs, len(rows)), "nr")
    n_draws = F.col("passes") + F.when(
        (F.col("rank") < F.col("end_block")) | (F.col("cut") & (F.col("rank") == F.col("end_block"))), 1
    ).otherwise(0)
    shard_of = lambda p: F.size(
        F.filter("ends", lambda e: e <= p * F.col("made") + F.col("rank"))
    )
    draws = joined.select(
        "nr", "block", F.col("rank").cast("long").alias("rank"),
        F.when(n_draws > 0, F.transform(F.sequence(F.lit(0), n_draws - 1), shard_of))
        .otherwise(F.array().cast("array<int>")).alias("shards"),
    )
    return sources, draws


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast up to MAX_BLOCKS rows (some hundred bytes each); beyond that an ordinary join."""
    return F.broadcast(df) if rows <= MAX_BLOCKS else df


def _block(doc_id: Column, blocks: Column, seed: int) -> Column:
    return F.floor(_unit(doc_id, F.lit(seed), F.lit("block")) * blocks).cast("int")


def _order(doc_id: Column, seed: int) -> Column:
    return _unit(doc_id, F.lit(seed), F.lit("order"))


def with_draws(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds __size, __source_size, __target and __shards (the shard of each time a document is taken).

    Null texts have size 0 and are taken like others; a null source is a source of its own, the last one.
    Repeated rows are taken together.  Nothing depends on the order or partitioning of the rows.
    """
    sized = docs.withColumn("__size", n_words_of(docs["text"]))
    slim = sized.select("doc_id", "source", F.col("__size").alias("size"))
    sources, draws = plan(slim, shards, seed)
    n_sources = sources.count()
    names = {c: f"__{c}" for c in sources.columns}
    sources = sources.withColumnsRenamed(names)
    out = sized.join(_small(sources, n_sources), sized["source"].eqNullSafe(sources["__source"]))
    out = out.withColumn("__block", _block(F.col("doc_id"), F.col("__blocks"), seed))
    draws = draws.withColumnsRenamed({"nr": "__nr", "block": "__block", "rank": "__rank", "shards": "__draws"})
    out = out.join(_small(draws, max(n_sources, MAX_BLOCKS)), ["__nr", "__block"])
    beyond = (F.col("__rank") == F.col("__end_block")) & (_order(F.col("doc_id"), seed) > F.col("__end_hash"))
    shards_ = F.when(beyond, F.slice("__draws", 1, F.col("__passes"))).otherwise(F.col("__draws"))
    return out.withColumn("__shards", shards_)


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards: one row for each row of ``docs``.

    taken is size times the number of times the document is drawn (three at most); shards names the output
    shard of each draw.  A source of size 0 has target 0.  An empty input gives no rows.
    """
    return with_draws(docs.select("doc_id", "text", "source"), shards, seed).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.size("__shards")).alias("taken"),
        F.col("__shards").alias("shards"),
    )


def mixed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is drawn."""
    drawn = with_draws(docs, shards, seed)
    return drawn.select(*[drawn[c] for c in docs.columns], F.explode("__shards").alias("__shard")).drop("__shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the mix as one folder a shard; each task orders its rows by a hash (the local shuffle)."""
    drawn = with_draws(docs, shards, seed)
    rows = drawn.select(*[drawn[c] for c in docs.columns], F.posexplode("__shards").alias("__pass", "shard"))
    place = F.xxhash64("doc_id", "__pass", F.lit(seed))
    salt = F.pmod(place, F.lit(64))
    rows.repartition("shard", salt).withColumn("__at", place).sortWithinPartitions("shard", "__at").drop(
        "__at", "__pass"
    ).write.partitionBy("shard").parquet(path)
