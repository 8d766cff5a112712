"""Phrase collocations by level-wise (Apriori) passes over all documents.

Pass k counts the phrases of k words.  What travels to it is the set of frequent phrases of k - 1 words, as a
filter of hashed bits whose size is bounded whatever the corpus; a phrase is emitted only where both of its
phrases of k - 1 words are in it.  A false positive of the filter costs a row and changes nothing, as every
emitted phrase is counted exactly and compared with the bound afterwards.  Phrases are counted within a batch
first (in numpy, by the batch's own word numbers, so without hash collisions), then by a map-side combined
aggregate.  Cuts are scored by joins with the level tables.

Texts are lower-cased in A-Z and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, these at ``[\\x20\\x09]+`` into words;
phrases stay within a piece.  A null language is ``und``; null texts are empty.  Repeated rows count again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialise, small_batches

LEAST = 30
MOST_WORDS = 4
TOP = 2000
#: A phrase goes where a longer candidate that holds it has this share of its count, in hundredths.
HELD = 80
#: Words counted at once by a task, and bounds of the filter in bits (16 MB at most).
BLOCK_WORDS = 1 << 21
#: Phrases written at once.
SLICE = 1 << 17
FILTER_BITS = (16, 27)
BITS_A_PHRASE = 16
PROBES = 3
#: Ranks are taken in this many parts of a language first.
RANK_PARTS = 64

_CHARS = bytes(
    10 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_U = np.uint64


class _Words(dict):
    """word of one language -> its number in the block; -1 for an end of a piece, -2 for nothing."""

    def __init__(self, lang: str, words: list[bytes], langs: list[str]):
        super().__init__({b"\n": -1, b"": -2})
        self.lang, self.words, self.langs = lang, words, langs

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return number


class _Block:
    """Words of some documents as numbers, with an end (-1) after every piece and document."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.tables: dict[str, _Words] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        joined = b"\n".join(t.translate(_CHARS) for t in texts) + b"\n"
        tokens = joined.replace(b"\n", b" \n ").split(b" ")
        table = self.tables.setdefault(lang, _Words(lang, self.words, self.langs))
        ids = np.fromiter(map(table.__getitem__, tokens), np.int32, len(tokens))
        self.parts.append(ids[ids != -2])
        self.size += len(self.parts[-1])

    def ids(self) -> np.ndarray:
        return np.concatenate([np.array([-1], np.int32), *self.parts, np.full(MOST_WORDS, -1, np.int32)]).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Blocks of about BLOCK_WORDS words from (lang, text); a longer document is one block."""
    block = _Block()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        by_lang: dict[str, list[bytes]] = {}
        held = 0
        for lang, text in zip(langs, texts, strict=True):
            by_lang.setdefault(lang, []).append(text)
            held += len(text)
            if held > 2 * BLOCK_WORDS:
                for k, v in by_lang.items():
                    block.add(k, v)
                by_lang, held = {}, 0
                if block.size >= BLOCK_WORDS:
                    yield block
                    block = _Block()
        for k, v in by_lang.items():
            block.add(k, v)
        if block.size >= BLOCK_WORDS:
            yield block
            block = _Block()
    if block.size:
        yield block


def _word_hashes(langs: list[str], words: list[bytes]) -> np.ndarray:
    """Hash of each word in its language."""
    seeds = {lang: xxhash.xxh64_intdigest(lang.encode()) for lang in set(langs)}
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seeds[g]) for g, w in zip(langs, words, strict=True)), _U, len(words))


def _joined(hashes: list[np.ndarray]) -> np.ndarray:
    """Hash of each phrase, from the hashes of its first words, second words and so on."""
    h = hashes[0]
    for other in hashes[1:]:
        h = (h ^ (h >> _U(29))) * _U(0x9E3779B97F4A7C15) + other
    return h ^ (h >> _U(32))


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of a phrase in a filter of 2^bits bits."""
    step = (h >> _U(32)) | _U(1)
    for j in range(PROBES):
        yield (h + _U(j) * step) & _U((1 << bits) - 1)


def _in_filter(h: np.ndarray, blocks: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(h), bool)
    for at in _probes(h, bits):
        found &= (blocks[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)
    return found


def _filter_of(level: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bits of the frequent phrases (lang, gram); at most 2^(bits - 6) rows of 64 bits reach the driver."""
    bits = min(max((BITS_A_PHRASE * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])

    def places(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            grams = [g.split(b" ") for g in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = list(zip(*grams, strict=True))
            langs = batch.column(0).to_pylist()
            hashes = [_word_hashes(langs, c) for c in columns]
            at = np.concatenate(list(_probes(_joined(hashes), bits)))
            bit = np.left_shift(_U(1), at & _U(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> _U(6)).astype(np.int64)), pa.array(bit)], names=["block", "bit"])

    rows = level.select("lang", "gram").mapInArrow(places, "block long, bit long").groupBy("block").agg(F.bit_or("bit").alias("bit")).toArrow()
    blocks = np.zeros(1 << (bits - 6), np.int64)
    blocks[rows["block"].to_numpy()] = rows["bit"].to_numpy()
    return blocks.view(_U), bits


def _candidates(block: _Block, ids: np.ndarray, k: int, held) -> np.ndarray:
    """Places where a phrase of k words stands whose two phrases of k - 1 words are in the filter."""
    m = len(ids) - k + 1
    real = ids[:m] >= 0
    for j in range(1, k):
        real &= ids[j : j + m] >= 0
    if k == 1:
        return np.flatnonzero(real)
    own = _word_hashes(block.langs, block.words)
    at = own[np.maximum(ids, 0)]
    shorter = _in_filter(_joined([at[j : j + m + 1] for j in range(k - 1)]), *held)
    return np.flatnonzero(real & shorter[:m] & shorter[1 : m + 1])


def _phrases(ids: np.ndarray, starts: np.ndarray, k: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct phrase of k words, and its number of places; exact."""
    key = ids[starts]
    if k == 1:
        first = np.zeros(n_words, np.int64)
        first[key[::-1]] = starts[::-1]
        return first, np.bincount(key, minlength=n_words)
    top = n_words
    for j in range(1, k):
        if top > (1 << 62) // n_words:
            _, key = np.unique(key, return_inverse=True)
            top = len(starts)
        key = key * n_words + ids[starts + j]
        top *= n_words
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return starts[first], count


def _level(words: DataFrame, k: int, least: int, held) -> DataFrame:
    """lang, gram, c of the phrases of k words with ``least`` places; for k = 1 also a null gram with all words."""
    spark = words.sparkSession
    sent = spark.sparkContext.broadcast(held)

    def rows(langs, grams, n) -> pa.RecordBatch:
        columns = [pa.array(langs, pa.string()), grams, pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "c"])

    def count(batches):
        for block in _blocks(batches):
            ids = block.ids()
            if block.words:
                at, n = _phrases(ids, _candidates(block, ids, k, sent.value), k, len(block.words))
                known = pa.array(block.words, pa.binary())
                of_lang = pa.array(block.langs, pa.string())
                for a in range(0, len(at), SLICE):
                    own = at[a : a + SLICE]
                    parts = [known.take(pa.array(ids[own + j])) for j in range(k)]
                    grams = pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]
                    yield rows(of_lang.take(pa.array(ids[own])), grams.cast(pa.string()), n[a : a + SLICE])
                if k == 1:
                    langs = sorted(block.tables)
                    number = {lang: i for i, lang in enumerate(langs)}
                    sizes = np.bincount([number[g] for g in block.langs], np.bincount(ids[ids >= 0], minlength=len(block.langs)), len(langs))
                    yield rows(langs, pa.nulls(len(langs), pa.string()), sizes.astype(np.int64))
            give_back()

    sums = words.mapInArrow(count, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    return materialise(sums.where((F.col("c") >= least) | F.col("gram").isNull()), f"phrases{k}")


def levels(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS) -> list[DataFrame]:
    """For k = 1, 2, ..., the table (lang, gram, c) of the phrases of k words that stand at ``least`` places of a
    language; the first table also has a row with a null gram and the number of all words for each language."""
    if most_words > MOST_WORDS:
        raise ValueError(f"phrases have at most {MOST_WORDS} words")
    small_batches(docs.sparkSession)
    words = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    out: list[DataFrame] = []
    held = None
    for k in range(1, most_words + 1):
        if k > 1:
            frequent = out[-1].where("gram is not null")
            n = frequent.count()
            if n == 0:
                break
            held = _filter_of(frequent, n)
        out.append(_level(words, k, least, held))
    return out


def _scored(found: list[DataFrame]) -> DataFrame:
    """lang, gram, a, l, r, score: every phrase of two words or more at its lowest-scoring cut."""
    every = found[0].where("gram is not null")
    for level in found[1:-1]:
        every = every.union(level)
    longer = found[1]
    for level in found[2:]:
        longer = longer.union(level)
    w = F.split("gram", " ")
    at = lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(w, 1, k), " ").alias("head"), F.array_join(F.slice(w, k + 1, F.size(w) - k), " ").alias("rest")
    )
    cuts = longer.select("lang", "gram", F.col("c").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - 1), at)).alias("cut"))
    sides = cuts.select(
        "lang", "gram", "a", F.col("cut.k").alias("k"),
        F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("cut.head").alias("part")), F.struct(F.lit("r").alias("side"), F.col("cut.rest").alias("part")))).alias("s"),
    ).select("lang", "gram", "a", "k", "s.side", "s.part")
    known = every.select("lang", F.col("gram").alias("part"), "c")
    met = sides.join(known.hint("merge"), ["lang", "part"])
    whole = met.groupBy("lang", "gram", "a", "k").agg(
        F.sum(F.when(F.col("side") == "l", F.col("c"))).alias("l"), F.sum(F.when(F.col("side") == "r", F.col("c"))).alias("r")
    )
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)")
    best = whole.withColumn("score", score).groupBy("lang", "gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "gram", "a", "b.l", "b.r", "b.score")


def _held_by_longer(found: list[DataFrame]) -> DataFrame | None:
    """lang, gram, most: each phrase of two words or more that a longer candidate holds, with the largest count of these."""
    if len(found) < 3:
        return None
    longer = found[2]
    for level in found[3:]:
        longer = longer.union(level)
    w = F.split("gram", " ")
    of_size = lambda n: F.transform(
        F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")
    )
    inner = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), of_size)))
    return longer.select("lang", F.explode(inner).alias("gram"), "c").groupBy("lang", "gram").agg(F.max("c").alias("most"))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, held: int = HELD
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases.

    a, l and r are the places of the phrase and of the two sides of its lowest-scoring cut (the first of equal
    ones), n all words of the language, score floor(2000000 a / (l + r)).  Phrases that stand in a longer
    candidate with ``held`` hundredths of their count or more are left out.  Order: score and a descending,
    phrase by code point.
    """
    found = levels(docs, text, lang, least, most_words)
    kind = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if len(found) < 2:
        return docs.sparkSession.createDataFrame([], kind)
    kept = _scored(found)
    inside = _held_by_longer(found)
    if inside is not None:
        kept = kept.join(inside, ["lang", "gram"], "left").where(f"most is null or 100 * most < {int(held)} * a")
    order = [F.desc("score"), F.desc("a"), F.asc("gram")]
    part = F.pmod(F.xxhash64("gram"), F.lit(RANK_PARTS))
    kept = kept.withColumn("__part", part).withColumn("__r", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order)))
    kept = kept.where(F.col("__r") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = found[0].where("gram is null").select("lang", F.col("c").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")
