"""Embedding near-duplicates with hierarchical navigable small-world graphs.

Equal vectors of a label become one point with a multiplicity.  The points of a label are dealt by hash into
shards of about ``SHARD_POINTS``; each shard's graph is built in one task and written to the shared folder.
Then every shard's points query every shard of the label.  Shards are taken in packs of about ``PACK_BYTES``; a
task holds two packs and searches all their pairs in both directions, so a graph travels once a pack and not
once a shard, and tasks are dealt by label and both packs.  Beams widen for queries whose beam is full of links,
and for a pair of shards until an audit against brute force on sampled queries finds ``AUDIT_RECALL`` of the
links (a vector's link to itself is no link); the sample grows until it has seen ``AUDIT_LINKS`` links or an eighth
of the queries.  Candidates are verified by cosine in double precision.  A task reports links as sums and one
edge a point; edges are united by connected components over the shared folder.

Insertion and search run on whole batches of points in numpy: one step expands the best open candidates of
all queries.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components_of, connected_components, give_back, materialise

THRESHOLD = 0.93
SHARD_POINTS = 16384
DEGREE = 12
BUILD_BEAM = 48
BEAM = 48
AUDIT_QUERIES = 64
AUDIT_LINKS = 64
AUDIT_RECALL = 0.98
PACK_BYTES = 48 << 20
BATCH = 512
_EXPAND = 4
#: Single precision may miss a cosine by this much; the verification decides.
_SLACK = 1e-5


def _uniform(n: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


class Graph:
    """Layers of neighbour lists over unit vectors; layer 0 holds all points, higher ones ever fewer."""

    def __init__(self, unit: np.ndarray, links: list[np.ndarray], levels: np.ndarray):
        self.unit, self.links, self.levels = unit, links, levels

    # ------------------------------------------------------------------ build

    @classmethod
    def build(cls, unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> Graph:
        n = len(unit)
        levels = np.minimum((-np.log(_uniform(n)) / math.log(degree)).astype(int), 6)
        # higher points first: a layer's points are a prefix of the order of insertion
        order = np.argsort(-levels, kind="stable")
        self = cls(unit[order], [], levels[order])
        for level in range(int(levels.max(initial=0)) + 1):
            m = int((self.levels >= level).sum())
            self.links.append(np.full((m, 2 * degree if level == 0 else degree), -1, np.int32))
        done, size = 0, 64
        while done < n:
            upto = min(n, done + size)
            self._insert(done, upto, beam)
            done, size = upto, min(BATCH, upto)
        self.order = order
        return self

    def _insert(self, first: int, last: int, beam: int) -> None:
        new = np.arange(first, last)
        q = self.unit[new]
        within = q @ q.T
        np.fill_diagonal(within, -np.inf)
        k = min(beam // 2, len(new) - 1)
        near = np.argpartition(-within, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(new), 0), int)
        near_sim = np.take_along_axis(within, near, axis=1)
        entry = None
        for level in range(len(self.links) - 1, -1, -1):
            old = min(first, len(self.links[level]))
            if old:
                ids, sims = self.search_layer(q, level, beam, entry, old)
                entry = ids[:, :1]
            else:
                ids, sims = np.full((len(new), 0), -1, np.int64), np.zeros((len(new), 0), np.float32)
            mine = np.flatnonzero(self.levels[new] >= level)
            if not len(mine):
                continue
            peers = np.where(self.levels[near[mine] + first] >= level, near[mine] + first, -1)
            cand = np.concatenate([ids[mine], peers], axis=1)
            sim = np.concatenate([sims[mine], np.where(peers >= 0, near_sim[mine], -np.inf)], axis=1)
            links = self.links[level]
            width = links.shape[1]
            chosen = self._select(new[mine], cand, sim, min(width, DEGREE))
            links[new[mine], : chosen.shape[1]] = chosen
            # the other direction: append, and choose again where a list overflows
            to = chosen.ravel()
            of = np.repeat(new[mine], chosen.shape[1])
            of, to = of[to >= 0], to[to >= 0]
            by = np.argsort(to, kind="stable")
            of, to = of[by], to[by]
            points, at, count = np.unique(to, return_index=True, return_counts=True)
            if not len(points):
                continue
            slot = np.arange(len(to)) - np.repeat(at, count)
            more = np.full((len(points), int(count.max())), -1, np.int64)
            more[np.repeat(np.arange(len(points)), count), slot] = of
            for a in range(0, len(points), BATCH):
                p = points[a : a + BATCH]
                every = np.concatenate([links[p].astype(np.int64), more[a : a + BATCH]], axis=1)
                sim = np.einsum("pd,pkd->pk", self.unit[p], self.unit[every])
                sim = np.where(every >= 0, sim, -np.inf)
                links[p] = self._select(p, every, sim, width)

    def _select(self, own: np.ndarray, cand: np.ndarray, sim: np.ndarray, width: int) -> np.ndarray:
        """Neighbours: nearest first, passing over those nearer to a chosen one, then filled up with these."""
        # one place a candidate: repeats count once
        order = np.argsort(cand, axis=1, kind="stable")
        sorted_ = np.take_along_axis(cand, order, axis=1)
        again = np.zeros_like(cand, bool)
        again[:, 1:] = sorted_[:, 1:] == sorted_[:, :-1]
        repeat = np.zeros_like(again)
        np.put_along_axis(repeat, order, again, axis=1)
        sim = np.where(repeat | (cand < 0) | (cand == own[:, None]), -np.inf, sim)
        order = np.argsort(-sim, axis=1, kind="stable")[:, : max(width * 3, width)]
        cand, sim = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sim, order, axis=1)
        n, k = cand.shape
        vectors = self.unit[np.maximum(cand, 0)]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        good = np.zeros((n, k), bool)
        for j in range(k):
            nearer = (between[:, j, :j] > sim[:, j, None]) & good[:, :j]
            good[:, j] = (sim[:, j] > -np.inf) & ~nearer.any(axis=1) & (good.sum(axis=1) < width)
        rank = np.where(good, 0, np.where(sim > -np.inf, 1, 2)) * k + np.arange(k)
        order = np.argsort(rank, axis=1, kind="stable")[:, :width]
        out = np.where(np.take_along_axis(sim, order, axis=1) > -np.inf, np.take_along_axis(cand, order, axis=1), -1)
        if out.shape[1] < width:
            out = np.concatenate([out, np.full((n, width - out.shape[1]), -1)], axis=1)
        return out

    # ------------------------------------------------------------------ search

    def search_layer(
        self, q: np.ndarray, level: int, beam: int, entry: np.ndarray | None, limit: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Best ``beam`` points of a layer for each query, nearest first (-1 where there are fewer)."""
        links, n = self.links[level], len(q)
        beam = min(beam, limit)
        if entry is None:
            entry = np.zeros((n, 1), np.int64)
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        seen = np.zeros((n, limit + 1), bool)
        seen[:, -1] = True  # where -1 points to
        ids[:, :1] = entry
        sims[:, 0] = np.einsum("qd,qd->q", q, self.unit[entry[:, 0]])
        open_[:, 0] = True
        seen[np.arange(n), entry[:, 0]] = True
        live = np.arange(n)
        while len(live):
            score = np.where(open_[live], sims[live], -np.inf)
            width = min(_EXPAND, beam)
            pick = np.argpartition(-score, width - 1, axis=1)[:, :width]
            real = np.take_along_axis(score, pick, axis=1) > -np.inf
            on = real.any(axis=1)
            live, pick, real = live[on], pick[on], real[on]
            if not len(live):
                break
            chosen = np.where(real, ids[live[:, None], pick], -1)
            open_[live[:, None], pick] = False
            near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(live), -1).astype(np.int64)
            near[near >= limit] = -1
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = ~seen[live[:, None], near]
            near = np.where(fresh, near, -1)
            seen[live[:, None], near] = True
            used = fresh.any(axis=0)
            near = near[:, used]
            sim = np.einsum("qd,qkd->qk", q[live], self.unit[near])
            sim = np.where(near >= 0, sim, -np.inf)
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_sims = np.concatenate([sims[live], sim], axis=1)
            all_open = np.concatenate([open_[live], near >= 0], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(all_ids, best, axis=1)
            sims[live] = np.take_along_axis(all_sims, best, axis=1)
            open_[live] = np.take_along_axis(all_open, best, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = None
        for level in range(len(self.links) - 1, 0, -1):
            ids, _ = self.search_layer(q, level, 1, entry, len(self.links[level]))
            entry = ids[:, :1]
        return self.search_layer(q, 0, beam, entry, len(self.unit))

    def within(self, q: np.ndarray, least: float, beam: int, batch: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, point) found at ``least`` or more; beams full of links are widened, up to all points."""
        n = len(self.unit)
        for a in range(0, len(q), batch):
            todo, width = np.arange(a, min(len(q), a + batch)), beam
            while len(todo):
                if width >= n // 4:  # the beam is most of the shard: compare with all of it
                    for b in range(0, len(todo), 128):
                        rows = todo[b : b + 128]
                        i, p = np.nonzero(q[rows] @ self.unit.T >= least)
                        yield rows[i], p
                    break
                ids, sims = self.search(q[todo], width)
                hit = sims >= least
                full = hit.all(axis=1)
                i, p = np.nonzero(hit & ~full[:, None])
                yield todo[i], ids[i, p]
                todo, width = todo[full], width * 4


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return (wide / np.sqrt((wide * wide).sum(axis=1))[:, None]).astype(np.float32)


def audited_beam(
    graph: Graph, q: np.ndarray, least: float, own: bool = False, recall: float = AUDIT_RECALL
) -> tuple[int, int, int]:
    """Smallest beam of the widening series whose links of sampled queries reach ``recall`` of brute force, the
    links of the sample, and how many of them that beam finds.

    With ``own`` the queries are the graph's points; a point's link to itself does not count.
    """
    order, size, sample, true = np.argsort(_uniform(len(q)), kind="stable"), AUDIT_QUERIES, 0, 0
    while sample < len(q) and true < AUDIT_LINKS and (not sample or sample * 8 < len(q)):
        upto = min(len(q), size)
        for a in range(sample, upto, 256):
            true += int((q[order[a : min(upto, a + 256)]] @ graph.unit.T >= least).sum())
        true -= own * (upto - sample)
        sample, size = upto, size * 2
    order, beam, found = order[:sample], BEAM, 0
    while True:
        found = 0
        for i, p in graph.within(q[order], least, beam):
            found += int((order[i] != p).sum()) if own else len(i)
        if found >= recall * true or beam >= len(graph.unit):
            return beam, true, found
        beam *= 2


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _build_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.combine_chunks().sort_by([("hash", "ascending"), ("hash2", "ascending")])
    values = table["embedding"].combine_chunks()
    vectors = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
    graph = Graph.build(_unit(vectors))
    blob = _pack(
        vectors=vectors[graph.order], levels=graph.levels, point=table["point"].to_numpy()[graph.order],
        times=table["times"].to_numpy()[graph.order], **{f"links{i}": x for i, x in enumerate(graph.links)},
    )
    give_back()
    return pa.table({
        "label": pa.array([key[0].as_py()], pa.string()), "dim": pa.array([key[1].as_py()], pa.int32()),
        "shard": pa.array([key[2].as_py()], pa.int32()), "graph": pa.array([blob], pa.binary()),
    })


def _read_shard(blob: bytes) -> tuple[Graph, dict[str, np.ndarray]]:
    data = dict(np.load(io.BytesIO(blob)))
    links = [data[f"links{i}"] for i in range(sum(k.startswith("links") for k in data))]
    return Graph(_unit(data["vectors"]), links, data["levels"]), data


def _verified(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        x, y = a[i[k : k + (1 << 16)]].astype(np.float64), b[j[k : k + (1 << 16)]].astype(np.float64)
        cos = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
        out[k : k + (1 << 16)] = cos >= threshold
    return out


def _link_two(left: tuple, right: tuple, same: bool, threshold: float) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int, int]]]:
    """(points, their links, the smallest point of each one's component) of two shards, and the audits."""
    (g, a), (h, b) = left, right
    codes, audits = [], []
    for index, queries in ((h, g), *(() if same else ((g, h),))):
        audits.append(audited_beam(index, queries.unit, threshold - _SLACK, same))
        for i, j in index.within(queries.unit, threshold - _SLACK, audits[-1][0]):
            if index is not h:
                i, j = j, i
            if same:
                i, j = np.minimum(i, j), np.maximum(i, j)
                i, j = i[i != j], j[i != j]
            codes.append(i.astype(np.int64) * len(h.unit) + j)
    code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
    i, j = code // len(h.unit), code % len(h.unit)
    good = _verified(a["vectors"], b["vectors"], i, j, threshold)
    i, j = i[good], j[good]
    u, v = a["point"][i], b["point"][j]
    points, root = components_of(u, v)
    times = np.concatenate([b["times"][j], a["times"][i]])
    n = np.zeros(len(points), np.int64)
    np.add.at(n, np.searchsorted(points, np.concatenate([u, v])), times)
    return (points, n, root), audits


def _link(threshold: float):
    """The links between all shards of two packs; a pack meets itself once."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, high = key[2].as_py(), key[3].as_py()
        rows = sorted(zip(table["shard"].to_pylist(), table["pack"].to_pylist(), range(len(table)), strict=True))
        blobs = table["graph"]
        out: list[tuple[np.ndarray, ...]] = []
        first = [(shard, _read_shard(blobs[k].as_py())) for shard, pack, k in rows if pack == low]
        for n, (shard, one) in enumerate(first):
            if low == high:
                for other, two in first[n:]:
                    out.append(_link_two(one, two, shard == other, threshold)[0])
        for _, pack, k in rows:
            if low != high and pack == high:
                two = _read_shard(blobs[k].as_py())
                for _, one in first:
                    out.append(_link_two(one, two, False, threshold)[0])
        columns = [np.concatenate([x[c] for x in out]) if out else np.zeros(0, np.int64) for c in range(3)]
        first.clear()
        give_back()
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("point", "n", "root"), columns, strict=True)})

    return run


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, shard_points: int = SHARD_POINTS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``rows`` (vec_id, embedding, label).

    Vectors link when their labels are equal and not null and their cosine reaches ``threshold``; rows with
    a null id or repeated ids are vectors like others (each links with its equals).  Vectors that are null,
    empty, zero, or hold null or non-finite components, and those of other lengths, link with nothing.
    component_id is the smallest vec_id reachable; other columns are ignored.
    """
    sound = (
        F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    wide = rows.schema["embedding"].dataType.simpleString() == "array<double>"
    own = rows.select(
        "vec_id", F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"),
        F.col("label").cast("string").alias("label"),
    )
    own = own.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # two 64-bit hashes stand for a vector, within its label
    own = materialise(own.select(
        "vec_id", "sound", F.when(F.col("sound"), F.col("label")).alias("label"),
        F.when(F.col("sound"), F.col("embedding")).alias("embedding"),
        F.when(F.col("sound"), F.xxhash64("embedding")).alias("hash"),
        F.when(F.col("sound"), F.xxhash64(F.lit("second"), "embedding")).alias("hash2"),
    ), "vectors")
    vector = ["label", "hash", "hash2"]
    points = own.where("sound").groupBy(*vector).agg(
        F.first("embedding").alias("embedding"), F.count("*").alias("times"), F.min("vec_id").alias("least"),
    ).withColumns({"dim": F.size("embedding"), "point": F.monotonically_increasing_id()})
    points = materialise(points, "points")
    sizes = points.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_points).cast("int").alias("shards"))
    dealt = points.join(sizes, ["label", "dim"]).withColumn(
        "shard", F.pmod(F.xxhash64("hash", "hash2", F.lit("shard")), F.col("shards")).cast("int")
    )
    shards = materialise(
        dealt.select("label", "dim", "shard", "point", "hash", "hash2", "times", "embedding").groupBy("label", "dim", "shard")
        .applyInArrow(_build_shard, "label string, dim int, shard int, graph binary"),
        "graphs",
    )
    # a row for every pack that a shard's pack meets; only shards of other packs travel again
    each = shards.agg(F.max(F.length("graph"))).first()[0] or 1
    pack_of = lambda shard: F.floor(shard / F.lit(max(1, PACK_BYTES // each))).cast("int")
    packed = shards.join(sizes, ["label", "dim"]).withColumns({
        "pack": pack_of(F.col("shard")), "other": F.explode(F.sequence(F.lit(0), pack_of(F.col("shards") - 1)))
    })
    pairs = packed.select(
        "label", "dim", F.least("pack", "other").alias("low"), F.greatest("pack", "other").alias("high"), "shard", "pack", "graph"
    )
    links = materialise(
        pairs.groupBy("label", "dim", "low", "high").applyInArrow(_link(threshold), "point long, n long, root long"), "links"
    )
    roots = connected_components(links.select("point", "root")).toDF("point", "top")
    sums = links.groupBy("point").agg(F.sum("n").alias("n"))
    placed = points.select(*vector, "point", "times", "least").join(sums, "point", "left").join(roots, "point", "left")
    placed = materialise(placed.select(
        *vector, (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "least",
        F.coalesce("top", "point").alias("top"),
    ), "placed")
    ids = materialise(placed.groupBy("top").agg(F.min("least").alias("component_id")), "ids")
    of_point = materialise(placed.join(ids, "top").select(*vector, "n_links", "component_id"), "of")
    linked = own.where("sound").select("vec_id", *vector).join(of_point, vector).select("vec_id", "n_links", "component_id")
    alone = own.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
