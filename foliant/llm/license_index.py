"""Licence scans with a positional index of rare words, in DataFrame operations only.

Templates are short notices and opening sentences of well-known licences.  The index lists, for each word
of a template that is rare enough in the scanned corpus (inverse document frequency over all documents), the
templates and positions it stands at.  A file's rare licence words are looked up; each hit votes for
(template, place of the file word minus place of the template word), so the votes of one copy of a template
agree on one offset.  The share of a template's rare weight that agrees is its score at that offset, and a
label is given where the score is high enough and the template's mandatory phrase stands in the file where that offset
puts it, or some words beside.

Votes are rows of a shuffle keyed by document, template and offset, and so are the offsets that an occurrence of
the mandatory phrase vouches for, so any number of hits and copies is handled whole, in time linear in the text.

The templates are a parameter: (label, mandatory phrase, text) triples, or a table of them read by
``templates_of``.  They travel in the plan, which is why their words are bounded by ``MOST_WORDS``.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# Fixed values of the base scan: phrase and label.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Public licence notices (label, mandatory phrase, text).
TEMPLATES = [
    ("apache-2.0", "apache license version 2 0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "general public license version 3",
     "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "general public license version 2",
     "This program is licensed under the GNU General Public License, version 2"),
    ("gpl-notice", "gnu general public license",
     "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
     " the Free Software Foundation"),
    ("lgpl", "lesser general public license",
     "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "affero general public license",
     "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("mit-notice", "mit license", "Released under the MIT License"),
    ("mit-text", "permission is hereby granted free of charge",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
     " documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("bsd-text", "redistribution and use in source and binary forms",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
     " the following conditions are met"),
    ("isc-text", "permission to use copy modify and or distribute this software",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
     " granted"),
    ("mpl-2.0", "mozilla public license",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "cc by 4 0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-text", "creative commons attribution",
     "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]

#: Characters between words, with capitals counted as letters.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: A licence word is rare when at most this share of the documents has it.
MAX_DOCUMENT_SHARE = 0.1
MIN_SCORE = 0.7
#: The mandatory phrase may stand so many words from the place that the offset gives.
SLACK = 8
#: Words of all templates together.
MOST_WORDS = 5000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: str) -> list[str]:
    """Words of a licence text, lower-cased."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def words_of_file(text: Column) -> Column:
    """Words of a file as they are written (capitals kept; see ``folded``)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def folded(word: Column) -> Column:
    return F.translate(word, CAPITALS, SMALL)


def _hits(words: Column, wanted: list[str]) -> Column:
    """array<struct(i, w)>: places of the wanted words.  ``lower`` is a superset test, ``translate`` decides."""
    at = F.filter(
        F.transform(words, lambda w, i: F.when(F.lower(w).isin(wanted), i)), lambda i: i.isNotNull()
    )
    rows = let(words, lambda a: F.transform(at, lambda i: F.struct(i.alias("i"), folded(F.get(a, i)).alias("w"))))
    return F.filter(rows, lambda h: h["w"].isin(wanted))


def _stands(words: Column, at: Column, phrase: list[str]) -> Column:
    """Whether the phrase's words stand from place ``at`` on."""
    return reduce(
        lambda a, b: a & b, [F.coalesce(folded(F.get(words, at + k)) == w, F.lit(False)) for k, w in enumerate(phrase)]
    )


def _base_places(words: Column, hits: Column, phrase: list[str], k: int, label: str) -> Column:
    """array<struct(i, label)>: where the phrase starts, looked for at its k-th word."""
    there = F.filter(hits, lambda h: (h["w"] == phrase[k]) & _stands(words, h["i"] - k, phrase))
    return F.transform(there, lambda h: F.struct((h["i"] - k).alias("i"), F.lit(label).alias("label")))


def _less(places: Column, by: int) -> Column:
    return F.transform(places, lambda b: b["i"] - by)


def _place(phrase: list[str], words: list[str]) -> int:
    """Where the phrase stands in the words of its template."""
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def templates_of(table: DataFrame) -> list[tuple[str, str, str]]:
    """Templates from a table (label, phrase, text) of at most ``MOST_WORDS`` rows; others are an error."""
    rows = table.select("label", "phrase", "text").limit(MOST_WORDS + 1).collect()
    return checked([tuple(r) for r in sorted(rows, key=lambda r: tuple(map(str, r)))])


def checked(templates: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The templates, if each has a label, and a phrase of its own words in a row; else ValueError."""
    if not templates:
        raise ValueError("no templates")
    for label, phrase, text in templates:
        words, m = plain_words(text or ""), (phrase or "").split()
        if not label or not m or not any(words[i : i + len(m)] == m for i in range(len(words))):
            raise ValueError(f"the mandatory phrase of template {label!r} does not stand in its text")
    if sum(len(plain_words(t)) for _, _, t in templates) > MOST_WORDS:
        raise ValueError(f"templates have at most {MOST_WORDS} words together")
    return list(templates)


def document_shares(docs: DataFrame, wanted: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and how many of them have each of the (at most some hundred) licence words."""
    hits = docs.select(F.array_distinct(F.transform(_hits(words_of_file(docs[text]), wanted), lambda h: h["w"])).alias("w"))
    rows = hits.select(F.explode_outer("w").alias("w"), F.lit(None).alias("none")).groupBy("w").count().collect()
    found = {r["w"]: r["count"] for r in rows if r["w"] is not None}
    return docs.count(), found


def index_of(
    n_docs: int, found: dict[str, int], share: float = MAX_DOCUMENT_SHARE, templates: list[tuple[str, str, str]] = TEMPLATES
) -> dict[str, tuple[float, list]]:
    """word -> (idf, postings of (template, place)) of the rare words; each template keeps its rarest word."""
    idf = lambda w: math.log((n_docs + 1) / (found.get(w, 0) + 0.5))
    rare: set[str] = set()
    for _, _, text in templates:
        words = plain_words(text)
        own = [w for w in words if found.get(w, 0) <= share * n_docs]
        rare.update(own or [max(words, key=lambda w: (idf(w), w))])
    out: dict[str, tuple[float, list]] = {w: (idf(w), []) for w in sorted(rare)}
    for t, (_, _, text) in enumerate(templates):
        for p, w in enumerate(plain_words(text)):
            if w in out:
                out[w][1].append((t, p))
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each row of ``docs``.

    base: places where a phrase of BASE stands.  labels adds the templates found; score is the best template's
    share of rare weight (0 without a hit).  Null texts are empty files; a file without a label has empty
    strings.  Repeated rows come back as often as they came in.  Other columns are ignored.
    """
    templates = checked(templates)
    vocabulary = sorted({w for _, _, t in templates for w in plain_words(t)})
    n_docs, found = document_shares(docs.select("text"), vocabulary)
    index = index_of(n_docs, found, templates=templates)
    anchors = {p: max(range(len(p.split())), key=lambda k: (p.split()[k] in ("license", "cc"), -k)) for p, _ in BASE}
    phrases = [m.split() for _, m, _ in templates]
    # a mandatory phrase is looked for at the word that the fewest documents have
    keys = [min(range(len(m)), key=lambda k: (found.get(m[k], 0), k)) for m in phrases]
    wanted = sorted({*index, *(p.split()[k] for p, k in anchors.items()), *(m[k] for m, k in zip(phrases, keys, strict=True))})

    own = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", words_of_file(docs["text"]).alias("words")
    )
    own = own.select("rid", "doc_id", "words", _hits(F.col("words"), wanted).alias("hits"))
    words, hits = F.col("words"), F.col("hits")

    base = F.flatten(F.array(*[
        _base_places(words, hits, p.split(), anchors[p], label) for p, label in BASE
    ]))
    # the offsets that a mandatory phrase vouches for: where it lets its template begin, and up to SLACK words beside
    beside = F.array(*[F.lit(d) for d in range(-SLACK, SLACK + 1)])

    def vouch(t: int, starts: Column) -> Column:
        row = lambda o: F.struct(F.lit(t).alias("t"), o.alias("o"), F.lit(0.0).alias("v"), F.lit(True).alias("near"))
        return F.flatten(F.transform(starts, lambda o: F.transform(beside, lambda d: row(o + d))))

    vouched = [
        vouch(t, _less(_base_places(words, hits, m, k, ""), _place(m, plain_words(x))))
        for t, (m, k, (_, _, x)) in enumerate(zip(phrases, keys, templates, strict=True))
    ]
    idf = F.create_map(*[x for w, (v, _) in index.items() for x in (F.lit(w), F.lit(v))])
    postings = F.create_map(*[
        x for w, (_, ps) in index.items()
        for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps]))
    ])
    # idf and postings of a hit are looked up in the row; only hits of index words make votes
    votes = F.flatten(F.transform(
        F.filter(hits, lambda h: h["w"].isin(sorted(index))),
        lambda h: F.transform(F.try_element_at(postings, h["w"]), lambda x: F.struct(
            x["t"].alias("t"), (h["i"] - x["p"]).alias("o"), F.try_element_at(idf, h["w"]).alias("v"), F.lit(False).alias("near")
        )),
    ))
    some = F.size(hits) > 0
    facts = own.select(
        "rid", "doc_id", F.size(words).cast("long").alias("n_words"),
        F.when(some, base).alias("base"),
        F.when(some, F.concat(votes, *vouched)).alias("votes"),
    )
    # what a vote carries has a bounded size: arrays of a file stay below the explosion
    brief = facts.select(
        "rid", "doc_id", "n_words",
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["i"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["i"])).cast("long").alias("last_word"),
        F.array_distinct(F.transform("base", lambda b: b["label"])).alias("base_set"), "votes",
    )
    fixed = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_set"]
    flat = brief.select("rid", *fixed, F.explode_outer("votes").alias("vote"))
    by_offset = flat.groupBy("rid", "vote.t", "vote.o").agg(
        *[F.first(c).alias(c) for c in fixed], F.sum("vote.v").alias("v"), F.max("vote.near").alias("near")
    )
    whole = F.array(*[F.lit(math.fsum(index[w][0] for w in plain_words(t) if w in index)) for _, _, t in templates])
    scored = by_offset.withColumn(
        "s", F.when(F.col("t").isNotNull(), F.least(F.lit(1.0), F.col("v") / F.get(whole, F.col("t"))))
    )
    names = F.array(*[F.lit(label) for label, _, _ in templates])
    good = (F.col("s") >= MIN_SCORE) & F.col("near")
    done = scored.groupBy("rid").agg(
        *[F.first(c).alias(c) for c in fixed],
        F.max("s").alias("score"),
        F.collect_set(F.when(good, F.get(names, F.col("t")))).alias("found"),  # at most one a template
    )
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    empty = F.array().cast("array<string>")
    base_set = F.coalesce("base_set", empty)
    return done.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", join(base_set).alias("base_labels"),
        join(F.concat(base_set, F.coalesce("found", empty))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
