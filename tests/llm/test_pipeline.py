"""Language identification, mixing and the pipeline against plain versions of themselves."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import divergence, langid, lattice, mixing, pieces
from tests.llm.test_documents import WORDS, _components, _print, _quality

EN = "the of and to in is that it for was on with as be by this are at from or".split()
DE = "der die und den von zu das mit sich auf ist im dem nicht ein eine als auch es an".split()


def _prose(seed, words, n=90):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(words) if rng.random() < 0.6 else "".join(rng.choice(list("abdeghilmnorstu"), 6)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(70):
        lang = ("en", "de")[i % 2]
        out.append((i, _prose(i, EN if i % 2 == 0 else DE, 70 + i), lang if i % 9 else None, ["s1", "s2", None][i % 3], 1))
    out += [(100 + i, out[i][1], "en", "s1", 1) for i in range(0, 20, 2)]  # exact copies
    out += [(200 + i, out[40][1] + " tail" * (i % 2), "en", "s2", 1) for i in range(6)]
    out += [(300, None, "en", "s1", 1), (301, "", "de", "s2", 1), (302, "too short", "en", "s1", 1), (303, "#$%& " * 60, "en", "s1", 1),
            (304, "123 456 " * 3 + " ".join(str(k) for k in range(60)), "en", "s2", 1), (None, _prose(999, EN), "en", "s1", 1), out[3]]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _kept(rows):
    """The quality rule, from counts over all labelled rows."""
    known = [(t, lang) for _, t, lang, *_ in rows if t is not None and lang is not None]
    words, chars = collections.defaultdict(collections.Counter), collections.defaultdict(lambda: np.zeros(7))

    def classes(solid):
        out, rest = [], solid
        for p in (r"[a-z]+", r"[^\W\d_a-zA-Z]+", r"[.,;:?'\"()\-]+", r"[A-Z]+", r"[0-9]+", r"[\x00-\x7f]+"):
            short = re.sub(p, "", rest)
            out.append(len(rest) - len(short))
            rest = short
        return np.array([*out, len(rest)], float)

    for t, lang in known:
        own = WORDS.findall(t)
        words[lang].update(own)
        chars[lang] += classes("".join(own))

    def js(p, q):
        m = (p + q) / 2
        part = lambda d: sum(x * math.log2(x / y) for x, y in zip(d, m, strict=True) if x > 0)
        return math.sqrt(max(0.0, (part(p) + part(q)) / 2))

    top = {k: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: divergence.COMMON_WORDS]) for k, c in words.items()}

    def verdict(t):
        own = WORDS.findall(t or "")
        if _quality(t)[-1]:
            return False
        solid = "".join(own)
        if len(solid) >= 200 and chars:
            p = classes(solid)
            if min(js(p / p.sum(), q / q.sum()) for q in chars.values()) > 0.27:
                return False
        if len(own) >= 60 and top:
            c, far = collections.Counter(own), []
            for k, common in top.items():
                n = sum(words[k].values())
                q = np.array([v / n for v in common.values()])
                p = np.array([c[w] / len(own) for w in common])
                far.append(js(np.append(p, 1 - p.sum()), np.append(q, 1 - q.sum())))
            if min(far) > 0.38:
                return False
        return True

    return [r for r in rows if verdict(r[1])]


def _grams(text, bits):
    """Buckets of all 1- to 3-grams, one at a time."""
    mask = 0xFFFFFFFF
    chars = [ord(c) for c in text.lower()]
    for order in (1, 2, 3):
        for i in range(len(chars) - order + 1):
            h = (chars[i] * 0x9E3779B1 + order) & mask
            for k in range(1, order):
                h = (((h ^ (h >> 15)) * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[k]) + chars[i + k]) & mask
            h ^= h >> 16
            yield ((h * 0x7FEB352D) & mask) >> (32 - bits)


def _languages(rows):
    """(language, probability) of each row by counts over labelled rows that are not held out."""
    bits = langid.BUCKET_BITS
    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for i, t, lang, *_ in rows:
        if t is not None and lang is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 4 != 2:
            counts[lang].update(_grams(t, bits))
            docs[lang] += 1
    total = {k: sum(c.values()) + langid.SMOOTHING * (1 << bits) for k, c in counts.items()}
    out = []
    for _, t, *_ in rows:
        if not t or not any(map(str.isalpha, t)):
            out.append(("und", 0.0))
            continue
        own = collections.Counter(_grams(t, bits))
        s = {k: math.log(docs[k] / sum(docs.values())) + sum(n * math.log((counts[k][g] + langid.SMOOTHING) / total[k]) for g, n in own.items()) for k in sorted(counts)}
        best = max(s, key=s.get)
        out.append((best, 1 / sum(math.exp(v - s[best]) for v in s.values())))
    return out


def _draws(spark, rows):
    """How often each row is taken, source by source; only the hashes come from Spark."""
    seed = mixing.SEED
    keys = sorted({r[0] for r in rows}, key=lambda x: (x is None, x))
    u = spark.createDataFrame([(k,) for k in keys], "doc_id long").select(
        "doc_id", mixing._unit(F.col("doc_id"), F.lit(seed), F.lit("block")).alias("b"), mixing._order(F.col("doc_id"), seed).alias("h")
    ).collect()
    unit, order = {r.doc_id: r.b for r in u}, {r.doc_id: r.h for r in u}
    size = lambda r: len(WORDS.findall(r[1] or ""))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r) for r in rows if r[3] == s) for s in names]
    targets = mixing.targets_of(sizes, [1 + i % 3 for i in range(len(names))])
    taken = {}
    for nr, s in enumerate(names):
        own = [r for r in rows if r[3] == s]
        blocks = max(1, math.ceil(len(own) / mixing.DOCS_A_BLOCK))
        block = {r[0]: int(unit[r[0]] * blocks) for r in own}
        made = sorted(set(block.values()))
        place = {r.b: r.p for r in spark.createDataFrame([(nr, b) for b in made], "nr int, b int").select(
            "b", F.xxhash64("nr", F.col("b"), F.lit(seed), F.lit("place")).alias("p")).collect()}
        passes = min(3, int(targets[nr] // sizes[nr])) if sizes[nr] else 0
        part = targets[nr] - passes * sizes[nr]
        chosen, upto, cut = set(), 0, None
        for b in sorted(made, key=lambda b: (place[b], b)):
            words = sum(size(r) for r in own if block[r[0]] == b)
            if upto + words <= part:
                chosen.add(b)
                upto += words
            else:
                cut = b
                break
        inside = collections.defaultdict(int)
        for r in own:
            if block[r[0]] == cut:
                inside[order[r[0]]] += size(r)
        at, last = 0, -1.0
        for h in sorted(inside):
            at += inside[h]
            if at - inside[h] / 2 <= part - upto:
                last = h
        for r in own:
            taken[r] = passes + (block[r[0]] in chosen or block[r[0]] == cut and order[r[0]] <= last)
    return taken


def test_quality_verdicts_by_hand(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = lambda r: (r[0] is None, r[0], r[1] or "")
    assert sorted((tuple(r) for r in divergence.keep_good(df).collect()), key=key) == sorted(_kept(rows), key=key)


def test_languages_by_hand(spark, rows):
    want = collections.defaultdict(list)
    for r, found in zip(rows, _languages(rows), strict=True):
        want[r[0]].append(found)
    for r in langid.predict_languages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        assert any(r.lang_pred == k and r.score == pytest.approx(s, abs=1e-4) for k, s in want[r.doc_id])


def test_draws_by_hand(spark, rows):
    want = collections.Counter({(r[0], n * len(WORDS.findall(r[1] or ""))): 0 for r, n in _draws(spark, rows).items()})
    taken = _draws(spark, rows)
    for r in rows:
        want[r[0], taken[r] * len(WORDS.findall(r[1] or ""))] += 1
    got = collections.Counter((r.doc_id, r.taken) for r in mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == want


def test_shards_hold_the_draws_in_a_local_order(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    mixing.write_shards(df, str(tmp_path / "mix"), shards=4)
    got = collections.Counter((r.doc_id, r.shard) for r in spark.read.parquet(str(tmp_path / "mix")).collect())
    assert got == collections.Counter((r.doc_id, s) for r in mixing.mix(df, shards=4).collect() for s in r.shards)


def test_pipeline_by_hand(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    good = _kept(rows)
    known = [r for r, (k, s) in zip(good, _languages(good), strict=True) if k != "und" and s >= 0.5]
    prints = [_print(r[1]) for r in known]
    group = _components(range(len(known)), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    parts = collections.defaultdict(list)
    for i, r in enumerate(known):
        parts[group[i]].append(r)
    heads = [min((r for r in g if r[0] is not None), default=g[0], key=lambda r: r[0]) for g in parts.values()]
    assert 30 < len(heads) < len(known) < len(good) + 1 < len(rows)
    taken = _draws(spark, heads)
    sampler = lattice.Sampler(pieces.read_model())
    found = sampler.encode([r[1] for r in heads], [r[0] or 0 for r in heads])
    want = collections.Counter()
    for r, ids in zip(heads, found, strict=True):
        if taken[r]:
            want[r[0], r[2], r[3], tuple(ids.tolist()), True] += taken[r]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.lang, r.source, tuple(r.piece_ids), r.lossless) for r in out) == want
    assert all(r.n_pieces == len(r.piece_ids) for r in out)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
