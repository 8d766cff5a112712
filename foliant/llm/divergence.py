"""Quality rules by distribution divergence, in DataFrame operations only.

Two histograms of a document are compared to language references by Jensen-Shannon distance (base 2, so
between 0 and 1): classes of the characters of its words, and the most common words of the language with one
bin for the rest.  The references are summed counts over all labelled documents; a document is held against
each language's reference and the nearest counts.  Every labelled language has a reference, however small.
A histogram of a short document says little, so each comparison waits for a minimum length.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, discard, let, materialise, words_of

#: Fixed rules of the base verdict.
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"

COMMON_WORDS = 40
#: References of up to this many languages are written into the plan; more of them are a table, in packs.
IN_PLAN, PACK = 32, 64
#: Classes of the characters of words, taken off one after the other; what is left is a class of its own.
CLASSES = {
    "lower": "[a-z]+",
    "letter": "[\\p{L}\\p{M}&&[^\\p{ASCII}]]+",
    "stop": "[.,;:?'\"()\\-]+",
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "symbol": "[\\p{ASCII}]+",
}
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.27
MIN_COMPARED_WORDS, MAX_WORD_DISTANCE = 60, 0.38


def with_base(docs: DataFrame) -> DataFrame:
    """Adds __words, __classes, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumns({
        "__words": words_of(docs["text"]), "__solid": F.regexp_replace(text, "[ \\t-\\r]+", "")
    })
    out = with_classes(out, "__solid", lambda rest: {
        "n_symbols": (F.length(rest) - F.length(F.regexp_replace(rest, SYMBOLS, ""))).cast("long")
    })
    wordy = lambda x: F.filter(x, lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    lines = let(F.split(text, "\n"), lambda x: F.when(F.size(x) == F.size(F.array_distinct(x)), 0).otherwise(
        let(wordy(x), lambda y: F.size(y) - F.size(F.array_distinct(y)))
    ))
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length("__solid").cast("long"),
        "n_dup_lines": lines.cast("long"),
        "n_repeat_words": _repeat_words(F.col("__words")).cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return out.withColumn("base_failed", failed).drop("__solid")


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of eight words that occur twice or more in the text."""
    windows = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.slice(
            F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])),
            1, F.size(h) - (WINDOW - 1),
        ),
    )

    def covered(win: Column) -> Column:
        # sort (hash, place); a place repeats when a neighbour has its hash; then sum the union of the windows
        in_order = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = let(in_order, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"],
        )))
        return let(at, lambda d: F.aggregate(
            F.transform(d, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(d, k + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x,
        ))

    return F.when(F.size(words) < WINDOW, 0).otherwise(
        let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))
    )


def with_classes(docs: DataFrame, solid: str, extra=lambda rest: {}) -> DataFrame:
    """Adds __classes, the characters of each class in column ``solid`` (a text without white space).

    ``extra`` makes further columns from what is left once lower-case letters are gone, a short string.
    """
    out, n = docs.withColumn("__rest_0", F.col(solid)), len(CLASSES)
    for k, pattern in enumerate(CLASSES.values()):
        out = out.withColumn(f"__rest_{k + 1}", F.regexp_replace(f"__rest_{k}", pattern, ""))
        if k == 0:
            out = out.withColumns(extra(F.col("__rest_1")))
        out = out.withColumn(f"__long_{k}", F.length(f"__rest_{k}"))
    out = out.withColumn(f"__long_{n}", F.length(f"__rest_{n}"))
    sizes = [F.col(f"__long_{k}") - F.col(f"__long_{k + 1}") for k in range(n)] + [F.col(f"__long_{n}")]
    out = out.withColumn("__classes", F.array(*[x.cast("double") for x in sizes]))
    return out.drop(*[f"__{x}_{k}" for x in ("rest", "long") for k in range(n + 1)])


def references(docs: DataFrame, common_words: int = COMMON_WORDS, in_plan: int = IN_PLAN) -> list[dict] | DataFrame:
    """Per language: share of each character class, and of its most common words (as they are written).

    One count of all words of all labelled documents gives both.  Up to ``in_plan`` languages the driver gets
    a row a language and ``common_words`` rows a language; references of more languages stay a table.
    """
    words = docs.where("lang is not null and text is not null").select(
        "lang", F.explode(words_of(F.col("text"))).alias("word")
    )
    counts = materialise(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    n = len(CLASSES) + 1
    table = materialise(with_classes(counts, "word").groupBy("lang").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("__classes", F.lit(k)) * F.col("n")).alias(f"c{k}") for k in range(n)]
    ), "sums")
    # a limit by rank is applied before the exchange, so a task sees common_words rows of each map task
    by_count = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    common = counts.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= common_words)
    sums = sorted(table.limit(in_plan + 1).collect(), key=lambda r: r["lang"])
    if len(sums) > in_plan:
        made = materialise(_reference_table(table, common, n), "references")
        discard(counts)
        discard(table)
        return made
    top = common.collect() if sums else []
    discard(counts)
    discard(table)
    out = []
    for r in sums:
        chars = sum(r[f"c{k}"] for k in range(n))
        own = sorted((w for w in top if w["lang"] == r["lang"]), key=lambda w: w["rank"])
        out.append({
            "lang": r["lang"],
            "chars": [r[f"c{k}"] / chars for k in range(n)],
            "words": {w["word"]: w["n"] / r["n"] for w in own},
        })
    return out


def _reference_table(sums: DataFrame, common: DataFrame, n: int) -> DataFrame:
    """lang and r (q, e, words, known): a row a language."""
    own = common.groupBy("lang").agg(F.collect_list(F.struct("word", F.col("n").alias("k"))).alias("own"))
    counts = F.array(*[F.col(f"c{k}") for k in range(n)])
    out = sums.join(own, "lang").withColumns({
        "q": let(counts, lambda c: let(_total(c), lambda t: F.transform(c, lambda x: x / t))),
        "words": F.map_from_entries(F.transform("own", lambda w: F.struct(w["word"], w["k"] / F.col("n")))),
    })
    return out.select("lang", F.struct(
        "q", _total(F.transform("q", _x_log_x)).alias("e"), "words", _total(F.map_values("words")).alias("known")
    ).alias("r"))


def _x_log_x(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _root(divergence: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), divergence))


def char_distance(refs: list[dict]) -> Column:
    """Least Jensen-Shannon distance of __classes to a reference; null without references.

    The divergence is half the sums of x log x of both histograms, less that of their mean.
    """
    if not refs:
        return F.lit(None).cast("double")
    known = F.array(*[
        F.struct(
            F.array(*map(F.lit, r["chars"])).alias("q"),
            F.lit(math.fsum(q * math.log2(q) for q in r["chars"] if q > 0)).alias("e"),
        )
        for r in refs
    ])
    return _char_distance(known)


def _char_distance(known: Column) -> Column:
    """The least distance to an array of (q, e)."""
    shares = let(F.col("__classes"), lambda c: let(_total(c), lambda n: F.transform(c, lambda x: x / n)))

    def least(p: Column) -> Column:
        each = let(_total(F.transform(p, _x_log_x)), lambda e: F.transform(known, lambda r: (
            (e + r["e"]) / 2 - _total(F.zip_with(p, r["q"], lambda x, y: _x_log_x((x + y) / 2)))
        )))
        return _root(F.array_min(each))

    return let(shares, least)


def word_distance(refs: list[dict], words: Column, n_words: Column) -> Column:
    """Least Jensen-Shannon distance of the common words (and the rest) to a reference; null without any.

    Only the document's own common words are looked at: sorted, counted by runs, and looked up in each
    language's table; a common word that is absent adds half its share of the reference.
    """
    every = sorted({w for r in refs for w in r["words"]})
    if not every:
        return F.lit(None).cast("double")
    kept = F.sort_array(F.filter(words, lambda w: w.isin(every)))
    runs = let(kept, lambda s: let(
        F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1))),
        lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda i, k: F.struct(
            F.get(s, i).alias("w"), ((F.get(at, k + 1) - i) / n_words).alias("p")
        )),
    ))

    each = lambda found: F.array_min(F.array(*[
        _word_distance(F.from_json(F.lit(json.dumps(r["words"])), "map<string,double>"), F.lit(math.fsum(r["words"].values())), found)
        for r in refs
    ]))
    return let(runs, each)


def _word_distance(shares: Column, known: Column, found: Column) -> Column:
    """Distance of found words (w, p) to a language's table of shares, which add up to ``known``."""
    start = F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    bin_ = lambda p, q: _x_log_x(p) + _x_log_x(q) - 2 * _x_log_x((p + q) / 2)

    def add(a: Column, x: Column) -> Column:
        return let(F.try_element_at(shares, x["w"]), lambda q: F.when(q.isNull(), a).otherwise(F.struct(
            (a["js"] + bin_(x["p"], q)).alias("js"), (a["p"] + x["p"]).alias("p"), (a["q"] + q).alias("q")
        )))

    def finish(a: Column) -> Column:
        absent = known - a["q"]  # a share q met by nothing adds q
        return _root((a["js"] + absent + bin_(1 - a["p"], 1 - known)) / 2)

    return F.aggregate(found, start, add, finish)


def _with_distances(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds both distances to documents with base counts, by references in a table.

    Histograms without texts meet packs of references; the planner broadcasts the packs or, where they are
    too large, makes a partitioned product.
    """
    docs = materialise(docs.drop("__words").withColumn("__rid", F.monotonically_increasing_id()), "based")
    packs = F.lit(max(1, math.ceil(refs.count() / PACK)))
    packed = refs.groupBy(F.pmod(F.xxhash64("lang"), packs).alias("pack")).agg(F.collect_list("r").alias("__refs"))
    common = refs.select(F.explode(F.map_keys("r.words")).alias("word")).distinct()
    wordy, solid = F.col("n_words") >= MIN_COMPARED_WORDS, F.col("word_chars") >= MIN_CHARS
    found = (
        docs.where(wordy).select("__rid", "n_words", F.explode(words_of(F.col("text"))).alias("word"))
        .groupBy("__rid", "n_words", "word").count().join(common, "word")
        .groupBy("__rid").agg(F.collect_list(
            F.struct(F.col("word").alias("w"), (F.col("count") / F.col("n_words")).alias("p"))
        ).alias("__found"))
    )
    slim = docs.where(wordy | solid).select("__rid", "__classes", "n_words", "word_chars").join(found, "__rid", "left")
    none = F.array().cast("array<struct<w:string,p:double>>")
    words = let(F.coalesce("__found", none), lambda x: F.array_min(
        F.transform("__refs", lambda r: _word_distance(r["words"], r["known"], x))
    ))
    least = slim.crossJoin(packed.select("__refs")).select(
        "__rid", F.when(solid, _char_distance(F.col("__refs"))).alias("c"), F.when(wordy, words).alias("w")
    ).groupBy("__rid").agg(F.min("c").alias("char_distance"), F.min("w").alias("word_distance"))
    return docs.join(least, "__rid", "left").drop("__rid")


def with_quality(docs: DataFrame, refs: list[dict] | DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, lang) plus the base counts, both distances and kept.

    Null and blank texts have no words and fail the base rules.  Distances are null for documents under the
    minimum length and for inputs without labelled documents; a null distance passes.
    """
    refs = references(docs) if refs is None else refs
    out = with_base(docs)
    if isinstance(refs, DataFrame):
        out = _with_distances(out, refs)
    else:
        out = out.withColumns({
            "char_distance": F.when(F.col("word_chars") >= MIN_CHARS, char_distance(refs)),
            "word_distance": F.when(
                F.col("n_words") >= MIN_COMPARED_WORDS, word_distance(refs, F.col("__words"), F.col("n_words"))
            ),
        })
    fine = F.coalesce(F.col("char_distance") <= MAX_CHAR_DISTANCE, F.lit(True)) & F.coalesce(
        F.col("word_distance") <= MAX_WORD_DISTANCE, F.lit(True)
    )
    return out.withColumn("kept", ~F.col("base_failed") & fine)


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, char_distance, word_distance: one row for each row."""
    own = with_quality(docs.select("doc_id", "text", "lang"))
    return own.select("doc_id", *_BASE, "kept", "char_distance", "word_distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    slim = docs.select("text", "lang", F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    # a filter would be pushed below the projections and repeat their work for every use of a column
    judged = materialise(with_quality(slim, references(docs)).select("__row", "kept"), "judged")
    return judged.where("kept").select("__row.*")
