"""Periodic runs of words, by the algorithm of Kolpakov and Kucherov, one text a call, texts in parallel.

A run is a maximal stretch of words with smallest period q whose length is at least ``min_length`` and
``min_exponent`` times q.  The steps for one sequence of n words, each linear in n:

1. its LZ factorisation from its suffix automaton: a factor is a new word, or the longest stretch from here on
   that also begins earlier;
2. Main's algorithm: runs that touch the start b of a factor u reach less than 2|u'|+|u| to the left, u' being the
   factor before, so two pairs of prefix tables over that window give all of them, by period;
3. other runs lie strictly inside a factor and are copied from its earlier occurrence, left to right.

Only stretches that can hold a run are looked at: every k words of one occur twice in it, where k follows
from the two bounds (5 for 6 words and exponent 4, 1 for exponent 2), so a text is first cut at k-grams that it
holds once.  That loses no run, and prose has few such stretches.

Null and blank texts have no words and no runs.  Rows are taken as they come; equal rows give equal results.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, give_back, let, small_batches, words_of

MIN_EXPONENT = 4
MIN_LENGTH = 6
Run = tuple[int, int, int]


def factors(seq: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start) of each LZ factor; a new word has length 1 and earlier start -1.

    The automaton keeps one transition a state in arrays and further ones in dictionaries.
    """
    most = 2 * len(seq) + 2
    link, size, first_end = (array("i", bytes(4 * most)) for _ in range(3))
    label, target = (array("i", b"\xff" * (4 * most)) for _ in range(2))
    more: dict[int, dict[int, int]] = {}
    link[0], states, last = -1, 1, 0
    for i, c in enumerate(seq):
        now, p = states, last
        states += 1
        size[now], first_end[now] = size[last] + 1, i
        q = -1
        while p != -1:
            q = target[p] if label[p] == c else more[p].get(c, -1) if p in more else -1
            if q != -1:
                break
            if target[p] == -1:
                label[p], target[p] = c, now
            else:
                more.setdefault(p, {})[c] = now
            p = link[p]
        if p == -1:
            link[now] = 0
        elif size[p] + 1 == size[q]:
            link[now] = q
        else:
            twin = states
            states += 1
            size[twin], first_end[twin], link[twin] = size[p] + 1, first_end[q], link[q]
            label[twin], target[twin] = label[q], target[q]
            if q in more:
                more[twin] = dict(more[q])
            while p != -1:
                if label[p] == c and target[p] == q:
                    target[p] = twin
                elif p in more and more[p].get(c) == q:
                    more[p][c] = twin
                else:
                    break
                p = link[p]
            link[q] = link[now] = twin
        last = now
    out, i, n = [], 0, len(seq)
    while i < n:
        j, state, earlier = i, 0, -1
        while j < n:
            c = seq[j]
            state = target[state] if label[state] == c else more[state][c]
            if first_end[state] >= j:
                break
            earlier = first_end[state] - (j - i)
            j += 1
        out.append((i, max(j - i, 1), earlier))
        i = max(j, i + 1)
    return out


def _common_prefixes(s: list[int]) -> list[int]:
    """For each position, the length of the longest common prefix of ``s`` and its rest from there (the Z table)."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _touching(seq: list[int], b: int, before: int, u: int) -> Iterator[Run]:
    """(start, end, period) of the maximal repetitions that touch ``b``, within ``before`` words left and ``u`` right of it."""
    n, low, high = len(seq), b - before, b + u
    left, right = seq[low:b], seq[b:high]
    ahead = _common_prefixes([*right, -1, *left, *right])[u + 1 :]  # of the words from b and from low + i
    back = left[::-1]
    behind = _common_prefixes([*back, -1, *right[::-1], *back])[before + 1 :]  # of those up to b and up to high - i
    for p in range(1, before + 1):  # a whole period left of b
        r, s = ahead[before - p], behind[u + p] if p < before else 0
        if r + s >= p:
            yield from _whole(seq, b - p - s, b + r, p, low, high, n)
    for p in range(1, u + 1):  # a whole period right of b
        r, s = ahead[before + p] if p < u else 0, behind[u - p] if before else 0
        if r + s >= p:
            yield from _whole(seq, b - s, b + p + r, p, low, high, n)


def _whole(seq: list[int], start: int, end: int, p: int, low: int, high: int, n: int) -> Iterator[Run]:
    """The repetition unless the window cuts it; then it is found at another factor."""
    if start == low > 0 and seq[start - 1] == seq[start - 1 + p]:
        return
    if end == high < n and seq[end] == seq[end - p]:
        return
    yield start, end, p


def maximal_repetitions(seq: list[int]) -> list[Run]:
    """(start, length, smallest period) of all runs of exponent 2 or more, by start and period."""
    n = len(seq)
    parts = factors(seq)
    found: dict[tuple[int, int], int] = {}
    size_before = 0
    for start, size, _ in [*parts, (n, 0, -1)]:
        for s, e, p in _touching(seq, start, min(start, 2 * size_before + size), size):
            if p < found.get((s, e), n + 1):
                found[s, e] = p  # multiples of the smallest period give the same stretch
        size_before = size
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (s, e), p in found.items():
        by_start.setdefault(s, []).append((e, p))
    for start, size, earlier in parts:
        if earlier < 0:
            continue
        shift, inside = start - earlier, earlier + size
        for s in range(earlier + 1, inside):
            if s in by_start:
                copies = [(e + shift, p) for e, p in by_start[s] if e < inside and (s + shift, e + shift) not in found]
                if copies:
                    found.update({(s + shift, e): p for e, p in copies})
                    by_start.setdefault(s + shift, []).extend(copies)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def gram_size(min_exponent: int, min_length: int) -> int:
    """The largest k for which every k words of any such run stand in it twice."""
    return max(1, min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 2)))


def _stretches(ids: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches in which every k-gram occurs twice or more in the whole (equal hashes count as equal)."""
    m = len(ids) - k + 1
    if m < 2:
        return
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + m].astype(np.uint64) + np.uint64(1)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(m + 2, bool)
    twice[order[1:][same] + 1] = True
    twice[order[:-1][same] + 1] = True
    edges = np.flatnonzero(twice[1:] != twice[:-1])
    for a, b in edges.reshape(-1, 2):
        yield int(a), int(b) + k - 1


def runs_of(words: list, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> list[Run]:
    """(start, length, smallest period) of the runs of a sequence of words, by start and period."""
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    out = []
    for a, b in _stretches(ids, gram_size(min_exponent, min_length)):
        if b - a >= min_length:
            found = maximal_repetitions(ids[a:b].tolist())
            out += [(a + s, n, p) for s, n, p in found if n >= max(min_length, min_exponent * p)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


def find_runs(
    docs: DataFrame, text: str = "text", key: str = "doc_id", min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH
) -> DataFrame:
    """The key of each row of ``docs`` with n_words, runs (array of start, length, period) and collapsed (the text
    without the words that a run holds after its first period, joined by single spaces)."""
    small_batches(docs.sparkSession)
    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    of_key = own.schema["key"].dataType.simpleString()
    of_run = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def one(value: bytes | None) -> tuple[int, list, bytes]:
        words = (value or b"").split()
        runs = runs_of(words, min_exponent, min_length)
        return len(words), runs, b" ".join(collapsed(words, runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, texts = zip(*map(one, batch.column(1).cast(pa.binary()).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in row] for row in runs]
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(rows, of_run), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "runs", "collapsed"])
            give_back()

    kind = f"key {of_key}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return own.mapInArrow(run, kind).withColumnRenamed("key", key)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equal ones; null without runs."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda a, b: F.when(better(a, b), b).otherwise(a))


def with_planted_repeats(doc_id: Column, text: Column) -> Column:
    """The text of the contract: for one id in ten, the words from some place on repeat those there.

    With h = crc32 of the decimal id (empty for a null one), g = h div 10 and n words: where h mod 10 is 0, word
    i from a = g mod n on is word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, at(i)))
        return F.concat_ws(" ", moved)

    chosen = (h % 10 == 0) & (F.btrim(text, F.lit(BLANKS)) != "")
    return F.when(chosen, let(words_of(text), planted)).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the strongest run, runs_sha256,
    collapsed_sha256: one row for each row of ``docs``, after ``with_planted_repeats``."""
    own = docs.select("doc_id", with_planted_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(own)
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = found.withColumn("__b", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "__b.start", "__b.length", "__b.period",
        F.expr("1000 * __b.length div __b.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
