"""Language-model scores by a hidden Markov model.

Symbols are the ``SYMBOLS`` most frequent training words, an end symbol, and suffix classes for all other
words; within its class a word has its smoothed unigram share, so every word has a probability and no count
is left out.  Baum-Welch trains the states: each partition runs scaled forward-backward over its documents
and emits its expected counts, a native aggregate adds them, and the driver (which holds the model only,
``STATES`` x symbols) divides.  All ``ROUNDS`` rounds run over all training documents, which are read into
symbols once.  Scoring is the scaled forward recursion over each whole text, many texts at a time.

The vocabulary grows with the corpus and is never broadcast.  At most ``FREQUENT`` of the most frequent words
(those over a count that a histogram of counts gives) travel with the tasks; each other word of a document
becomes a row (document, word, times) that meets the count table in a shuffled join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, crc_mod, discard, give_back, materialise, text_parts

STATES = 8
SYMBOLS = 16384
CLASSES = 2048
FREQUENT = 131072
ROUNDS = 8
PRIOR_COUNTS = 20.0
SEED = 42
#: Distinct words a counting task holds; tokens a training task holds, and of one forward-backward run; bytes
#: of text read at once, and scored at once.
COUNT_WORDS = 200_000
HELD_TOKENS = 4_000_000
RUN_TOKENS = 500_000
READ_BYTES = 2 << 20
SCORE_BYTES = 16 << 20
#: Histogram of counts: steps of a doubling.
STEPS = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[[ord(c) for c in BLANKS]] = False


@dataclass
class Words:
    """Words of some texts: the distinct ones, and which of them stand where."""

    distinct: pa.Array
    code: np.ndarray
    #: number of words of each text
    counts: np.ndarray


def words_in(texts: pa.Array) -> Words:
    """Words of binary texts (null: none), ASCII letters lower-cased, split at ASCII white space."""
    texts = pc.fill_null(texts, b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    if bounds[-1] == bounds[0]:
        return Words(pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(len(texts), np.int64))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    solid = _SOLID[data]
    first, last = solid.copy(), solid.copy()
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[bounds] = True
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    offsets = np.append(0, np.cumsum(last - first + 1)).astype(np.int32)
    packed = _LOWER[data[solid]]
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(), np.diff(np.searchsorted(first, bounds)))


def class_of(word: bytes, classes: int = CLASSES) -> int:
    h = xxhash.xxh64_intdigest(word[-3:], SEED)
    return (h - (1 << 64) if h >> 63 else h) % classes


def _class(word: Column, classes: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(word, -3, 3)), F.lit(classes)).cast("int")


def training(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5) != 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        for a, n in text_parts(batch.column(0), READ_BYTES):
            w = words_in(batch.column(0).slice(a, n))
            held.append(pa.table({"word": w.distinct, "n": pa.array(np.bincount(w.code, minlength=len(w.distinct)), pa.int64())}))
            size += len(w.distinct)
            if size > 2 * COUNT_WORDS:
                held = [_summed(held)]
                size = len(held[0])
                if size > COUNT_WORDS:
                    yield from held.pop().to_batches()
                    size = 0
    if held:
        yield from _summed(held).to_batches()
    held.clear()
    give_back()


def _summed(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
    return pa.table({"word": found["word"], "n": found["n_sum"]})


@dataclass
class Lexicon:
    """What tasks need to read a text: frequent words with counts, and the classes' totals."""

    words: bytes
    counts: np.ndarray
    docs: int
    tokens: int
    distinct: int
    symbols: int
    #: per class: log10 of the denominator of a word's share
    class_log: np.ndarray
    #: training count of each symbol: end, words, classes
    symbol_counts: np.ndarray

    def open(self) -> _Reader:
        return _Reader(self)


class _Reader:
    def __init__(self, lex: Lexicon):
        self.lex = lex
        self.words = pa.array(lex.words.split(b" ") if lex.words else [], pa.binary())
        self.classes = len(lex.class_log)
        n, m = len(self.words), lex.symbols
        self.symbol = np.arange(1, n + 1, dtype=np.int32)
        self.symbol[m:] = 1 + m + self.class_of_each(self.words.slice(m))
        self.log_count = np.log10(lex.counts + 0.5)
        #: what a frequent word outside the symbols adds to the score besides its class symbol
        self.in_class = np.zeros(n)
        self.in_class[m:] = self.log_count[m:] - lex.class_log[self.symbol[m:] - 1 - m]

    def class_of_each(self, words: pa.Array) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.int32)
        ends = pc.binary_slice(words, -3).dictionary_encode()
        each = np.array([class_of(w, self.classes) for w in ends.dictionary.to_pylist()], np.int32)
        return each[ends.indices.to_numpy()]

    def read(self, texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words; for each distinct one its rank (-1: not frequent) and its class; then the symbols of all
        texts end to end, with their ends, and the number of symbols of each text."""
        w = words_in(texts)
        rank = pc.fill_null(pc.index_in(w.distinct, value_set=self.words), -1).to_numpy().astype(np.int64)
        symbol, of_class = np.zeros(len(rank), np.int32), np.zeros(len(rank), np.int32)
        known, rare = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
        symbol[known] = self.symbol[rank[known]]
        of_class[rare] = self.class_of_each(w.distinct.take(pa.array(rare)))
        symbol[rare] = 1 + self.lex.symbols + of_class[rare]
        lengths = w.counts + 1
        flat = np.zeros(int(lengths.sum()), np.int32)
        flat[np.arange(len(w.code)) + np.repeat(np.arange(len(lengths)), w.counts)] = symbol[w.code]
        return w, rank, of_class, flat, lengths


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    #: symbols x states
    emit: np.ndarray


class _Steps:
    """Texts side by side: the symbols of step t stand from ``base[t]`` on, the longest text's first."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        """``flat``: the texts' symbols end to end; all texts have one at least."""
        self.order = np.argsort(-lengths, kind="stable")
        size = lengths[self.order]
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")
        self.base = np.append(0, np.cumsum(active)).tolist()
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.array(self.base)[at]
        at += np.repeat(rank, lengths)
        self.symbols = np.empty(len(flat), np.int32)
        self.symbols[at] = flat


def forward(flat: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each symbol sequence; ``flat`` has them end to end, all have at least the end."""
    out = np.zeros(len(lengths))
    if not len(lengths):
        return out
    steps = _Steps(flat, lengths)
    total = np.zeros(len(lengths))
    one = np.ones(len(model.start))
    now = None
    for i, j in zip(steps.base, steps.base[1:], strict=False):
        seen = model.emit[steps.symbols[i:j]]
        now = model.start * seen if now is None else (now[: j - i] @ model.move) * seen
        scale = now @ one
        now /= scale[:, None]
        total[: j - i] += np.log10(scale)
    out[steps.order] = total
    return out


def expected_counts(flat: np.ndarray, lengths: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (start, moves, emissions) and the log10 likelihood of some sequences.

    Steps are in single precision, sums in double.
    """
    k, symbols = len(model.start), len(model.emit)
    move_sum, emit_sum = np.zeros((k, k)), np.zeros((symbols, k))
    steps = _Steps(flat, lengths)
    base = steps.base
    start, move, emit = (np.ascontiguousarray(x, np.float32) for x in (model.start, model.move, model.emit))
    back, one = np.ascontiguousarray(move.T), np.ones(k, np.float32)
    alpha = np.empty((len(flat), k), np.float32)
    scales = np.empty((len(flat), 1), np.float32)
    seen_all = emit[steps.symbols]
    for i, j in zip(base, base[1:], strict=False):
        now = np.matmul(alpha[last : last + j - i], move) if i else np.repeat(start[None], j, axis=0)  # noqa: F821
        now *= seen_all[i:j]
        scale = (now @ one)[:, None]
        np.divide(now, scale, out=alpha[i:j])
        scales[i:j] = scale
        last = i
    like = float(np.log10(scales, dtype=np.float64).sum())
    seen_all /= scales
    beta = np.ones((len(lengths), k), np.float32)
    for t in range(len(base) - 2, 0, -1):
        i, j = base[t], base[t + 1]
        own = beta[: j - i]
        ahead = seen_all[i:j]
        ahead *= own
        alpha_before = alpha[base[t - 1] : base[t - 1] + j - i]
        move_sum += alpha_before.T @ ahead
        alpha[i:j] *= own
        np.matmul(ahead, back, out=own)
    alpha[: len(lengths)] *= beta
    start_sum = alpha[: len(lengths)].sum(axis=0, dtype=np.float64)
    for s in range(k):
        emit_sum[:, s] = np.bincount(steps.symbols, alpha[:, s], symbols)
    return start_sum, move_sum * model.move, emit_sum, like


_open: dict[str, tuple[_Reader, Model | None]] = {}


def _opened(key: str, held) -> tuple[_Reader, Model | None]:
    """The reader and model of a broadcast, made once a worker."""
    if key not in _open:
        lex, model = held.value
        old = next((r for k, (r, _) in _open.items() if r.lex.words == lex.words), None)
        _open.clear()
        _open[key] = (old or lex.open(), model)
    return _open[key]


def _symbols(key: str, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, _ = _opened(key, held)
        for batch in batches:
            for a, n in text_parts(batch.column(0), READ_BYTES):
                *_, flat, lengths = reader.read(batch.column(0).slice(a, n))
                offsets = np.append(0, 4 * np.cumsum(lengths)).astype(np.int32)
                seqs = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([seqs], names=["seq"])
        give_back()

    return run


def _expect(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        k = len(model.start)
        start, move, emit, like = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape), 0.0

        def work(texts: list[np.ndarray]) -> None:
            nonlocal like
            if texts:
                a, b, c, d = expected_counts(np.concatenate(texts), np.array([len(t) for t in texts]), model)
                start[:] += a
                move[:] += b
                emit[:] += c
                like += d

        def flush(held_texts: list[np.ndarray]) -> None:
            # texts of like length share a run, so that few steps have a short list of active texts
            held_texts.sort(key=len, reverse=True)
            part, size = [], 0
            for t in held_texts:
                part.append(t)
                size += len(t)
                if size > RUN_TOKENS:
                    work(part)
                    part, size = [], 0
            work(part)

        texts, size = [], 0
        for batch in batches:
            for seq in batch.column(0).to_pylist():
                texts.append(np.frombuffer(seq, np.int32))
                size += len(texts[-1])
                if size > HELD_TOKENS:
                    flush(texts)
                    texts, size = [], 0
        flush(texts)
        texts.clear()
        give_back()
        seen = np.flatnonzero(emit.any(axis=1))
        # rows: -1 starts, -2 - s moves from state s, -100 likelihood, otherwise a symbol's emissions
        rows = np.concatenate([start[None], move, np.full((1, k), like), emit[seen]])
        names = np.concatenate([[-1], -2 - np.arange(k), [-100], seen])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), *[pa.array(np.ascontiguousarray(rows[:, s])) for s in range(k)]],
            names=["symbol", *[f"s{s}" for s in range(k)]],
        )

    return run


def _round(texts: DataFrame, lex: Lexicon, model: Model) -> tuple[Model, float]:
    """One Baum-Welch round over a DataFrame with one binary column, the symbols of a text."""
    k, symbols = len(model.start), len(model.emit)
    held = texts.sparkSession.sparkContext.broadcast(model)
    names = [f"s{s}" for s in range(k)]
    schema = "symbol long, " + ", ".join(f"{n} double" for n in names)
    rows = (
        texts.mapInArrow(_expect(held), schema)
        .groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # a row a symbol
    )
    held.unpersist()
    at = rows["symbol"].to_numpy()
    values = np.column_stack([rows[n].to_numpy() for n in names])
    pick = lambda s: values[at == s][0] if (at == s).any() else np.zeros(k)
    emit = np.zeros((symbols, k))
    emit[at[at >= 0]] = values[at >= 0]
    prior = (lex.symbol_counts + 0.5) / (lex.symbol_counts + 0.5).sum()
    emit += PRIOR_COUNTS * prior[:, None]
    start, move = pick(-1) + 0.1, np.array([pick(-2 - s) for s in range(k)]) + 0.1
    made = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return made, float(pick(-100)[0])


def first_model(lex: Lexicon, states: int, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    prior = (lex.symbol_counts + 0.5) / (lex.symbol_counts + 0.5).sum()
    emit = prior[:, None] * rng.gamma(2.0, 0.5, (len(prior), states))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def lexicon(counts: DataFrame, docs: int, symbols: int, frequent: int, classes: int) -> tuple[Lexicon, Column]:
    """The lexicon of a count table, and the condition that holds for the words it leaves out."""
    # a row a step of a doubling: how many words have such counts
    step = F.floor(F.log2("n") * STEPS).cast("int")
    found = counts.groupBy(step.alias("step")).agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.min("n").alias("least")).collect()
    total = sum(r["v"] for r in found), sum(r["n"] for r in found)
    room, cut = frequent, None
    for r in sorted(found, key=lambda r: -r["step"]):
        if r["v"] > room:
            break
        room, cut = room - r["v"], r["least"]
    top = counts.where(F.col("n") >= cut if cut is not None else F.lit(False)).toArrow()  # ``frequent`` rows at most
    words, n = top["word"].to_pylist(), top["n"].to_numpy().astype(np.int64)
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n = [words[i] for i in order], n[order]
    symbols = min(symbols, len(words))

    def beyond(rank: int) -> Column:
        if rank >= len(words):
            return F.lit(False)
        last, word = int(n[rank - 1]) if rank else None, words[rank - 1] if rank else None
        if last is None:
            return F.lit(True)
        return (F.col("n") < last) | ((F.col("n") == last) & (F.col("word") > F.lit(bytearray(word))))

    sums = counts.where(beyond(symbols)).groupBy(_class(F.col("word"), classes).alias("c")).agg(
        F.sum("n").alias("n"), F.count("*").alias("v")
    ).collect()  # a row a class
    class_n, class_v = np.zeros(classes), np.zeros(classes)
    for r in sums:
        class_n[r["c"]], class_v[r["c"]] = r["n"], r["v"]
    lex = Lexicon(
        b" ".join(words), n, docs, total[1] + docs, total[0] + (docs > 0), symbols,
        np.log10(class_n + 0.5 * (class_v + 1)),
        np.concatenate([[docs], n[:symbols], class_n]),
    )
    return lex, F.lit(True) if cut is None else F.col("n") < cut


def _score(key: str, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, model = _opened(key, held)
        lex = reader.lex
        share = math.log10(lex.tokens + 0.5 * (lex.distinct + 1))
        end = math.log10(lex.docs + 0.5)
        names = ["rid", "kind", "word", "times", "doc_id", "n_tokens", "n_known", "base_score", "score"]
        none = lambda t, size: pa.nulls(size, t)
        for whole in batches:
            for a, size in text_parts(whole.column(2), SCORE_BYTES):
                batch = whole.slice(a, size)
                n_known, base, inner = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
                flats, every = [], []
                rids = batch.column(0).to_numpy()
                for b, m in text_parts(batch.column(2), READ_BYTES):
                    w, rank, of_class, flat, lengths = reader.read(batch.column(2).slice(b, m))
                    flats.append(flat)
                    every.append(lengths)
                    row = np.repeat(np.arange(m), w.counts)
                    of = rank[w.code]
                    known = of >= 0
                    n_known[b : b + m] = np.bincount(row[known], minlength=m)
                    base[b : b + m] = np.bincount(row[known], reader.log_count[of[known]], m)
                    inner[b : b + m] = np.bincount(row[known], reader.in_class[of[known]], m)
                    # the other words: how often each stands in each text
                    pair, times = np.unique(row[~known] * max(1, len(rank)) + w.code[~known], return_counts=True)
                    row, code = np.divmod(pair, max(1, len(rank)))
                    inner[b : b + m] -= np.bincount(row, times * lex.class_log[of_class[code]], m)
                    if len(pair):
                        k = len(pair)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(rids[b + row]), pa.array(np.ones(k, np.int32)), w.distinct.take(pa.array(code)),
                            pa.array(times, pa.int64()), *[none(pa.int64(), k)] * 3, *[none(pa.float64(), k)] * 2,
                        ], names=names)
                lengths = np.concatenate(every)
                score = forward(np.concatenate(flats), lengths, model) + inner
                # a text's own row has a word that spreads it and meets nothing
                spread = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), size, [None, pa.py_buffer(np.ascontiguousarray(rids))])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(np.zeros(size, np.int32)), spread.cast(pa.binary()), none(pa.int64(), size),
                    batch.column(1), pa.array(lengths), pa.array(n_known + (lex.docs > 0)), pa.array(base + end - lengths * share),
                    pa.array(score),
                ], names=names)
        give_back()

    return run


def score_documents(
    docs: DataFrame, states: int = STATES, symbols: int = SYMBOLS, frequent: int = FREQUENT, classes: int = CLASSES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``.

    A null text counts as empty and has the end token only.  Repeated rows come back as often as they came
    in.  Without training documents all counts are zero.  Other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    learn = own.where(training(F.col("doc_id")))
    counts = materialise(
        learn.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words"
    )
    n_learn = learn.count()
    lex, left_out = lexicon(counts, n_learn, symbols, frequent, classes)
    model = first_model(lex, states)
    if n_learn:
        held = spark.sparkContext.broadcast((lex, None))
        key = f"e{held._jbroadcast.id()}-{spark.sparkContext.applicationId}"
        seqs = materialise(learn.select("text").mapInArrow(_symbols(key, held), "seq binary"), "symbols")
        held.unpersist()
        for _ in range(rounds):
            model, _like = _round(seqs, lex, model)
        discard(seqs)
    held = spark.sparkContext.broadcast((lex, model))
    key = f"s{held._jbroadcast.id()}-{spark.sparkContext.applicationId}"
    rows = own.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(
        _score(key, held),
        "rid long, kind int, word binary, times long, doc_id long, n_tokens long, n_known long, base_score double, score double",
    )
    known = counts.where(left_out).select(F.lit(1).alias("kind"), "word", F.col("n").alias("c"))
    met = rows.join(known, ["kind", "word"], "left")
    log_count = F.when(F.col("kind") == 1, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).otherwise(0.0)
    found = F.when((F.col("kind") == 1) & (F.col("c") > 0), F.col("times")).otherwise(0)
    done = met.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(found)).cast("long").alias("n_known"),
        (F.max("base_score") + F.sum(log_count)).alias("base_score"),
        (F.max("score") + F.sum(log_count)).alias("score"),
    )
    return done.select(
        "doc_id", (~training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known",
        F.lit(lex.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
