"""Token counts by count-only Viterbi over a unigram piece vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each character; dynamic programming carries the
best score and its number of pieces, never the pieces themselves.  As no piece crosses the start of a run
of spaces or a line end, the optimum of a text is the sum of the optima of these chunks, and a chunk's
(count, score) is remembered, in a table of bounded size.

Rules of the tokenizer: a space is put before the text; the best sum of scores wins; of equal sums the one
whose last piece is longest; a character that is no piece itself may be passed at the least score minus 10
and counts as its UTF-8 bytes.  Sums are exact (the file's scores are integers), where the library's own sums
are in single precision.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import MARKER, MODEL_PATH, Vocabulary, parse, read_model

#: Chunks remembered by a worker before it starts afresh.
MEMO_SIZE = 200_000


class Counter(dict):
    """chunk -> complex(pieces, score), filled on demand."""

    def __init__(self, vocabulary: Vocabulary, memo_size: int = MEMO_SIZE):
        super().__init__()
        self.vocabulary = vocabulary
        self.memo_size = memo_size
        self.matches = vocabulary.automaton(lambda s, i, score: (len(s), score)).iter
        self.single = {s for s in vocabulary.pieces if len(s) == 1}

    def __missing__(self, chunk: str) -> complex:
        n, unknown, single = len(chunk), self.vocabulary.unknown_score, self.single
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        done = 0

        def settle(upto: int, done: int) -> int:
            # after the pieces that end before ``upto``: characters that are no pieces
            while done < upto:
                c = chunk[done]
                if c not in single:
                    score = best[done] + unknown
                    if best[done + 1] is None or score > best[done + 1]:
                        best[done + 1] = score
                        count[done + 1] = count[done] + (len(c.encode()) if self.vocabulary.bytes_ else 1)
                done += 1
            return done

        for end, (length, score) in self.matches(chunk):
            end += 1
            if done < end - 1:
                done = settle(end - 1, done)
            start = end - length
            total = best[start] + score
            now = best[end]
            # longer pieces of an end come first, so equal sums keep the longest last piece
            if now is None or total > now:
                best[end], count[end] = total, count[start] + 1
        settle(n, done)
        found = complex(count[n], best[n])
        if len(self) >= self.memo_size:
            self.clear()
        if n <= 64:
            self[chunk] = found
        return found

    def of(self, text: str | None) -> tuple[int, float]:
        """(pieces, score) of a text; (0, 0) for null and empty texts."""
        if not text:
            return 0, 0.0
        if MARKER in text:
            text = text.replace(MARKER, " ")  # the tokenizer cannot tell them apart
        total = sum(map(self.__getitem__, self.vocabulary.cut.findall(" " + text)), 0j)
        return int(total.real), total.imag


_counters: dict[int, Counter] = {}


def _counter(model: bytes) -> Counter:
    key = hash(model)
    if key not in _counters:
        _counters[key] = Counter(parse(model))
    return _counters[key]


def pieces_of(docs: DataFrame, text: str = "text", path: str = MODEL_PATH) -> Column:
    """struct(n_pieces, score) of each text."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))  # a file of fixed size

    def run(texts: pd.Series) -> pd.DataFrame:
        counter = _counter(model.value)
        found = [counter.of(t if isinstance(t, str) else None) for t in texts]
        return pd.DataFrame({"n_pieces": [n for n, _ in found], "score": [s for _, s in found]})

    return F.pandas_udf(run, "n_pieces long, score double")(docs[text])


def count_tokens(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id, n_pieces, score: one row for each row of ``docs``; null and empty texts have no pieces."""
    own = docs.select("doc_id", "text")
    return own.select("doc_id", pieces_of(own, "text", path).alias("__p")).select("doc_id", "__p.n_pieces", "__p.score")
