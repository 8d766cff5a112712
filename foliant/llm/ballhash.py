"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most four bits exactly when some 64-bit word lies within two bits of both.
So every fingerprint emits all 2,081 words within two bits (half the radius); those that meet in a word are
linked, and by the triangle inequality all members of a word are within four bits of each other.  One edge
from each member to the smallest one keeps every link's component without writing pairs.

The words are routed by a linear code, the parities of r groups of bits: the bucket of ``f ^ mask`` is
``bucket(f) ^ bucket(mask)``, and two flipped bits change two parities at most, so a ball touches 1 + r + r(r-1)/2
of the 2^r buckets (22 of 64, 211 of a million).  Only the fingerprint travels, once to each bucket its ball
touches; the task of the bucket rebuilds the words that fall into it, slice by slice, sorts them and finds the
ones that meet.  Copies are one fingerprint, so no group of copies heats one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components_of, connected_components, give_back, materialise, small_batches

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Words of a slice that a task sorts at once, and words of a bucket before more buckets are made.
SLICE_WORDS = 1 << 21
BUCKET_WORDS = 1 << 25


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' XXH64; zero for a text without words."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = [n + i for i, n in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(64, np.int64), len(words) - shingle + 1
    for k in range(0, count, 1 << 16):
        m = min(1 << 16, count - k)
        hashes = np.fromiter(
            (digest(flat[s:e], SEED) for s, e in zip(starts[k : k + m], ends[k + shingle - 1 :], strict=False)),
            np.uint64, m,
        )
        # eight byte-wide counters a machine word; they hold 255 additions
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        sums = np.add.reduceat(bits, np.arange(0, m, 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    found = pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
    give_back()
    return found


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Adds the fingerprint of each text as a long (the same 64 bits)."""
    small_batches(docs.sparkSession)
    udf = F.pandas_udf(_fingerprints, "long")
    return docs.withColumn(out, udf(docs[text].cast("binary")))


def ball(radius: int) -> np.ndarray:
    """All 64-bit masks with at most ``radius`` bits."""
    one = [1 << i for i in range(64)]
    return np.array(
        [sum(c) for r in range(radius + 1) for c in combinations(one, r)], np.uint64
    )


def _code(bits: int) -> np.ndarray:
    """Parity checks of the routing code: every ``bits``-th bit."""
    return np.array([sum(1 << p for p in range(k, 64, bits)) for k in range(bits)], np.uint64)


def _slices(bits: int) -> np.ndarray:
    """Further checks that cut a bucket's words into slices."""
    return np.random.default_rng(20240601).integers(1, 1 << 63, bits, np.uint64, endpoint=True) | np.uint64(1)


def syndrome(words: np.ndarray, checks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for i, c in enumerate(checks):
        out |= (np.bitwise_count(words & c) & 1).astype(np.int64) << i
    return out


def _meetings(own: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest fingerprint that meets it) of the words held by two or more."""
    in_order = np.sort(words)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if not len(twice):
        return own[:0], own[:0]
    spread = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)
    seen = np.zeros(1 << 22, bool)
    seen[spread(twice)] = True
    maybe = np.flatnonzero(seen[spread(words)])
    at = np.minimum(np.searchsorted(twice, words[maybe]), len(twice) - 1)
    hit = twice[at] == words[maybe]
    at, f = at[hit], own[maybe[hit]]
    least = np.full(len(twice), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, at, f)
    to = least[at]
    real = (f != to) & (np.bitwise_count(f ^ to) <= RADIUS)
    return f[real], to[real]


def _in_bucket(bucket: int, prints: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among the fingerprints whose words meet in this bucket."""
    masks = ball(radius // 2)
    more = 0
    while len(prints) * len(masks) >> (bits + more) > SLICE_WORDS and more < 16:
        more += 1
    checks = np.concatenate([_code(bits), _slices(more)])
    of_mask, of_print = syndrome(masks, checks), syndrome(prints, checks)
    order = np.argsort(of_print, kind="stable")
    prints, of_print = prints[order], of_print[order]
    classes, first = np.unique(of_print, return_index=True)
    last = np.append(first[1:], len(prints))
    by = np.argsort(of_mask, kind="stable")
    masks, of_mask = masks[by], of_mask[by]
    u, v = [], []
    for high in range(1 << more):
        want = classes ^ (bucket | high << bits)
        lo, hi = np.searchsorted(of_mask, want), np.searchsorted(of_mask, want, side="right")
        own, words = [], []
        for a, b, i, j in zip(first, last, lo, hi, strict=True):
            if i < j:
                part = prints[a:b]
                words.append((part[:, None] ^ masks[None, i:j]).ravel())
                own.append(np.repeat(part, j - i))
        if words:
            f, to = _meetings(np.concatenate(own), np.concatenate(words))
            if len(f):
                ids, root = components_of(f, to)
                u.append(ids[ids != root])
                v.append(root[ids != root])
    if not u:
        return prints[:0], prints[:0]
    ids, root = components_of(np.concatenate(u), np.concatenate(v))
    return ids[ids != root], root[ids != root]


def _route(bits: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checks = _code(bits)
        touched = np.unique(syndrome(ball(radius // 2), checks))
        for batch in batches:
            prints = np.asarray(batch.column(0)).view(np.uint64)
            for k in range(0, len(prints), 8192):
                part = prints[k : k + 8192]
                own = syndrome(part, checks)
                if len(touched) == 1 << bits:  # every ball touches every bucket
                    blob = part.tobytes()
                    names, blobs = np.arange(1 << bits), [blob] * (1 << bits)
                else:
                    to = (own[:, None] ^ touched[None, :]).ravel()
                    order = np.argsort(to, kind="stable")
                    names, first = np.unique(to[order], return_index=True)
                    who = np.repeat(part, len(touched))[order]
                    blobs = [x.tobytes() for x in np.split(who, first[1:])]
                for i in range(0, len(names), 64):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[i : i + 64], pa.int64()), pa.array(blobs[i : i + 64], pa.binary())],
                        names=["bucket", "prints"],
                    )

    return run


def _join_bucket(bits: int, radius: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        prints = np.frombuffer(b"".join(table.column("prints").to_pylist()), np.uint64)
        u, v = _in_bucket(key[0].as_py(), prints, bits, radius)
        give_back()
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def links_within(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints differing in at most ``radius`` bits.

    ``prints`` has one long column without repeats; ``radius`` is even.
    """
    n = prints.count()
    bits = 6
    while n * len(ball(radius // 2)) >> bits > BUCKET_WORDS and bits < 20:
        bits += 1
    routed = prints.mapInArrow(_route(bits, radius), "bucket long, prints binary")
    return routed.groupBy("bucket").applyInArrow(_join_bucket(bits, radius), "u long, v long")


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of ``docs``.

    component_id is the smallest doc_id reachable by links of at most ``radius`` bits.  Null and blank texts
    have fingerprint zero and link like any other; null ids never become a component's id unless all of its
    ids are null; repeated rows come back as often as they came in.  Other columns are ignored.
    """
    own = materialise(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"), "prints")
    of_print = _components(own, radius)
    return own.join(of_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _components(own: DataFrame, radius: int) -> DataFrame:
    """fp, root, component_id: a row a fingerprint of ``own`` (doc_id, fp)."""
    prints = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    # written out, so that no task has two Python workers
    links = materialise(links_within(prints.select("fp"), radius), "links")
    roots = connected_components(links).toDF("fp", "root")
    placed = materialise(
        prints.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "placed"
    )
    ids = materialise(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "ids")
    return materialise(placed.join(ids, "root").select("fp", "root", "component_id"), "component")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The document with the smallest id of each component, with all its columns.

    Of repeated rows with that id one stays; a component without any id keeps one row.
    """
    own = materialise(with_fingerprint(docs, out="__fp").withColumn("__row", F.monotonically_increasing_id()), "printed")
    ids = own.select("doc_id", F.col("__fp").alias("fp"), "__row")
    found = ids.join(_components(ids.select("doc_id", "fp"), radius), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "__row"))
    heads = found.groupBy("root").agg(first.alias("h")).select("h.__row")
    return own.join(heads, "__row", "left_semi").drop("__row", "__fp")  # the texts are shuffled once
