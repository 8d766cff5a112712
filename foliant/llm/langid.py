"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams of lower-cased text per language are gathered from labelled documents, and a
matrix of log-probabilities (one row a hash bucket, one column a language) is broadcast.  Scoring adds the
rows of a text's n-grams; a batch of texts is scored as one gather and one segmented sum in numpy.

Sizes: a broadcast matrix never exceeds ``MATRIX_BYTES``, which is 256 languages.  More of them are several
matrices, one after the other: each pass keeps a text's best language so far and the sum of likelihoods, so
predictions do not depend on the split.  The likelihoods are fitted on at most about ``per_language`` labelled
documents of each language, chosen by a hash of their id (of their text where the id is null); the priors count all
labelled documents.  Counts reach the driver as Arrow columns of ``GATHER_LANGUAGES`` languages at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, materialise, small_batches

ORDERS = 3
BUCKET_BITS = 16
MATRIX_BYTES = 64 << 20
GATHER_LANGUAGES = 32
PER_LANGUAGE = 3000
SMOOTHING = 0.05
UNDETERMINED = "und"
#: Characters scored at once.
BLOCK_CHARS = 1 << 18
_MULTIPLIER = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass
class Model:
    languages: list[str]
    #: buckets x languages, float32
    log_prob: np.ndarray
    log_prior: np.ndarray
    bits: int


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of texts with about BLOCK_CHARS characters; a longer text is cut with ORDERS - 1 of overlap later."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        if run and size + len(t) > BLOCK_CHARS:
            yield first, run
            run, size, first = [], 0, i
        run.append(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32))
        size += len(t)
    if run:
        yield first, run


def _hashes(chars: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position."""
    n = len(chars) - order + 1
    h = chars[:n] * _MULTIPLIER[0] + np.uint32(order)
    for k in range(1, order):
        h = (h ^ (h >> np.uint32(15))) * _MULTIPLIER[k] + chars[k : k + n]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    return h >> np.uint32(32 - bits)


def _segments(lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have an n-gram, and the bounds of their n-grams in the joined block."""
    ends = np.cumsum(lengths)
    has = np.flatnonzero(lengths >= order)
    return has, np.column_stack([(ends - lengths)[has], ends[has] - order + 1]).ravel()


def _sums(run: list[np.ndarray], model: Model) -> np.ndarray:
    """Per text and language, the summed log-probability of its n-grams."""
    out = np.zeros((len(run), len(model.languages)))
    lengths = np.array([len(r) for r in run])
    chars = np.concatenate(run)
    step = max(1 << 14, (32 << 20) // (8 * len(model.languages)))
    if len(chars) > step:  # one long text, or many languages: text by text, in pieces
        for i, r in enumerate(run):
            for order in range(1, ORDERS + 1):
                for k in range(0, len(r) - order + 1, step):
                    h = _hashes(r[k : k + step + order - 1], order, model.bits)
                    out[i] += model.log_prob[h].sum(axis=0, dtype=np.float64)
        return out
    for order in range(1, ORDERS + 1):
        has, bounds = _segments(lengths, order)
        if len(has):
            rows = model.log_prob[_hashes(chars, order, model.bits)]
            rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])
            out[has] += np.add.reduceat(rows, bounds, axis=0, dtype=np.float64)[::2]
    return out


def _best(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text its best language (-1 for none), that one's log-likelihood, and the sum of all relative to it."""
    at, top, total = np.full(len(texts), -1), np.full(len(texts), -np.inf), np.zeros(len(texts))
    real = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.languages else []
    for first, run in _blocks([texts[i].lower() for i in real]):
        logp = _sums(run, model) + model.log_prior
        best = logp.argmax(axis=1)  # ties: the first language by code point
        rows = real[first : first + len(run)]
        at[rows], top[rows] = best, logp[np.arange(len(run)), best]
        total[rows] = np.exp(logp - top[rows][:, None]).sum(axis=1)
    return at, top, total


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text; ``und`` and 0 without a letter or without a model."""
    at, _, total = _best(texts, model)
    return [model.languages[i] if i >= 0 else UNDETERMINED for i in at], np.divide(1, total, out=np.zeros(len(texts)), where=total > 0)


def _counter(bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                counts = np.zeros(1 << bits, np.int64)
                for _, texts in _blocks([t.lower() for t in part["text"]]):
                    for chars in texts:
                        for order in range(1, ORDERS + 1):
                            if len(chars) >= order:
                                counts += np.bincount(_hashes(chars, order, bits), minlength=1 << bits)
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": counts[at]})

    return run


def fit(docs: DataFrame, label: str = "lang", per_language: int = PER_LANGUAGE) -> list[Model]:
    """Models of up to 256 languages each, in code point order, from the rows whose text and label are not null."""
    known = docs.where(f"text is not null and `{label}` is not null")
    totals = {r[0]: r[1] for r in known.groupBy(label).count().collect()}  # a row a language
    languages = sorted(totals)
    if not languages:
        return [Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0), BUCKET_BITS)]
    shares = known.sparkSession.createDataFrame([(k, min(1.0, per_language / n)) for k, n in totals.items()], "__lang string, __share double")
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.col("doc_id").cast("long"))
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit("fit")), 11) / F.lit(float(1 << 53))
    sample = known.join(F.broadcast(shares), F.col(label) == F.col("__lang")).where(draw < F.col("__share")).select("__lang", "text")
    rows = (
        sample.toDF("lang", "text").mapInPandas(_counter(BUCKET_BITS), "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    if len(languages) > GATHER_LANGUAGES:
        rows = materialise(rows, "ngrams")
    each = MATRIX_BYTES // (4 << BUCKET_BITS)
    prior = np.log(np.array([totals[k] for k in languages], float) / sum(totals.values()))
    models = []
    for a in range(0, len(languages), each):
        own = languages[a : a + each]
        log_prob = np.empty((1 << BUCKET_BITS, len(own)), np.float32)
        for b in range(0, len(own), GATHER_LANGUAGES):
            part = own[b : b + GATHER_LANGUAGES]
            found = rows.where(F.col("lang").isin(part)).toArrow()  # at most buckets x GATHER_LANGUAGES
            counts = np.zeros((1 << BUCKET_BITS, len(part)))
            column = pc.index_in(found["lang"], value_set=pa.array(part)).to_numpy()
            counts[found["bucket"].to_numpy(), column] = found["n"].to_numpy()
            smooth = counts + SMOOTHING
            log_prob[:, b : b + len(part)] = np.log(smooth) - np.log(smooth.sum(axis=0))
        models.append(Model(own, log_prob, prior[a : a + each], BUCKET_BITS))
    return models


def _part_of(sent, kind: str):
    def part(texts: pd.Series) -> pd.DataFrame:
        at, top, total = _best([t if isinstance(t, str) else None for t in texts], sent.value)
        give_back()
        return pd.DataFrame({"pred": [sent.value.languages[i] if i >= 0 else None for i in at], "top": top, "total": total})

    return F.pandas_udf(part, kind)


def with_language(docs: DataFrame, models: list[Model], name: str = "lang_found", text: str = "text") -> DataFrame:
    """``docs`` with a column struct(lang_pred, score) of each text."""
    small_batches(docs.sparkSession)
    if len(models) == 1:
        held = docs.sparkSession.sparkContext.broadcast(models[0])

        def run(texts: pd.Series) -> pd.DataFrame:
            names, scores = predict([t if isinstance(t, str) else None for t in texts], held.value)
            give_back()
            return pd.DataFrame({"lang_pred": names, "score": scores})

        return docs.withColumn(name, F.pandas_udf(run, "lang_pred string, score double")(docs[text]))
    kind = "pred string, top double, total double"
    out = docs.withColumn("__best", F.lit(None).cast(f"struct<{kind}>".replace(" ", ":").replace(",:", ", ")))
    for model in models:  # one matrix in a worker at a time
        out = out.withColumn("__next", _part_of(docs.sparkSession.sparkContext.broadcast(model), kind)(out[text]))
        old, new = F.col("__best"), F.col("__next")
        higher = F.when(old["pred"].isNull() | (new["top"] > old["top"]), new).otherwise(old)
        total = F.coalesce(old["total"] * F.exp(old["top"] - higher["top"]), F.lit(0.0)) + new["total"] * F.exp(new["top"] - higher["top"])
        best = F.when(new["pred"].isNull(), old).otherwise(F.struct(higher["pred"].alias("pred"), higher["top"].alias("top"), total.alias("total")))
        out = materialise(out.withColumn("__best", best).drop("__next"), "languages")
    found = F.struct(F.coalesce("__best.pred", F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce(1 / F.col("__best.total"), F.lit(0.0)).alias("score"))
    return out.withColumn(name, found).drop("__best")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 4) == 2


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of ``docs``.

    Learns from the labelled documents that are not held out (crc32 of the id modulo 4 is 2); the prediction
    sees the text only.  Null texts and texts without a letter give ``und`` with score 0, and so does an
    input without labels.  Ties go to the first language by code point.  Other columns are ignored.
    """
    models = fit(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    own = with_language(docs.select("doc_id", "text"), models)
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_found.lang_pred", "lang_found.score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose language is determined with at least that probability."""
    models = fit(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    found = with_language(docs, models, "__lang_found")
    keep = (F.col("__lang_found.lang_pred") != UNDETERMINED) & (F.col("__lang_found.score") >= least)
    return found.where(keep).drop("__lang_found")
