"""Runs, collocations and byte-level BPE: brute-force versions, the library itself, and the odd rows."""

import base64
import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import public_tokenizers
import pytest
import tiktoken

from foliant.llm import bytebpe, collocations, runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _repetitions(seq, exponent, length):
    n, out = len(seq), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and seq[j] == seq[j + p]:
                j += 1
            if j - i >= p:
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items() if e - s >= max(length, exponent * p))


def test_repetitions_against_brute_force():
    rng = random.Random(3)
    for _ in range(4000):
        n, letters = rng.randint(0, 45), rng.choice([1, 2, 2, 3, 4])
        s = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.4:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 9)
            s = [s[i if i < a else a + (i - a) % p] for i in range(n)]
        assert runs.maximal_repetitions(s) == _repetitions(s, 2, 2)
        for exponent, length in ((4, 6), (3, 5), (2, 9), (6, 2)):
            assert runs.runs_of(s, exponent, length) == sorted(_repetitions(s, exponent, length), key=lambda r: (r[0], r[2]))


def test_factors_are_the_longest_that_begin_earlier():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.randrange(3) for _ in range(rng.randint(1, 30))]
        at = 0
        for start, size, earlier in runs.factors(s):
            assert start == at
            longest = max((k for k in range(len(s) - at + 1) if any(s[v : v + k] == s[at : at + k] for v in range(at))), default=0)
            assert size == max(1, longest)
            assert (earlier < 0) == (longest == 0) and (earlier < 0 or earlier < at and s[earlier : earlier + size] == s[at : at + size])
            at += size
        assert at == len(s)


def test_runs_of_long_texts_stay_linear():
    assert runs.runs_of(["a"] * 60000) == [(0, 60000, 1)]
    block = [f"w{i * i % 997}" for i in range(2500)]
    whole = [r for r in runs.runs_of(["x", *block * 12, "y"]) if r[1] == 30000]
    assert len(whole) == 1 and whole[0][0] == 1 and 2500 % whole[0][2] == 0
    with pytest.raises(ValueError, match="twice"):
        runs.runs_of(["a"], 1)


def _digest_of(doc_id, text):
    words = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = sorted(_repetitions(words, 4, 6), key=lambda r: (r[0], r[2]))
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join("%d,%d,%d\n" % r for r in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(kept)


def test_run_digests(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("ab cd ef gh ij kl Ünï 日本".split()) for _ in range(n))
    texts = [prose(rng.randint(1, 120)) for _ in range(120)] + [None, "", " \t\n", "a " * 300, "x\x0by\x0cz q \x1c", "a b " * 3 + "a", "a b " * 4, "a a a a a a b b b b b b"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "a " * 9, "clash", 2), (5, texts[5], "clash", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    got = sorted(map(tuple, runs.run_digests(df).collect()), key=str)
    assert got == sorted(((r[0], *_digest_of(r[0], r[1])) for r in rows), key=str)
    assert any(r[1] for r in got)
    whole = {r.doc_id: r for r in runs.find_runs(df.where("doc_id = 123")).collect()}
    assert [tuple(x) for x in whole[123].runs] == [(0, 300, 1)] and whole[123].collapsed == "a" and whole[123].n_words == 300


def _collocations(rows, least, top, held):
    f = collections.defaultdict(collections.Counter)
    n = collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        rated = []
        for g, a in found.items():
            score, _, left, right = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            inside = any(len(h) > len(g) and 100 * b >= held * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in found.items())
            if not inside:
                rated.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rated)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(6)
    vocabulary = "The of New York city ein Öl und日 a b c d".split()
    rows = []
    for i in range(90):
        t = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", " ", "; "]) for _ in range(rng.randint(0, 150)))
        rows.append((i, t + " new york city hall" * (i % 3), [None, "en", "de", "und"][i % 4], "x"))
    rows += [(91, None, "en", "y"), (92, "", None, "y"), (93, " . ,\n", "fr", "y"), (94, "word " * 4000, "en", "z"), (95, "k" * 70000 + " \x00 a", "en", "z"), rows[3]]
    return rows


@pytest.mark.parametrize(("least", "top", "held"), [(30, 2000, 80), (3, 25, 80), (10, 2000, 30)])
def test_collocations_against_brute_force(spark, phrases, least, top, held):
    df = spark.createDataFrame(phrases, "doc_id long, text string, lang string, gram string").repartition(3)
    want = _collocations([(r[1], r[2]) for r in phrases], least, top, held)
    assert want and sorted(map(tuple, collocations.collocations(df, least=least, top=top, held=held).collect())) == want


def test_collocations_with_a_full_filter(spark, phrases, monkeypatch):
    """Results do not depend on how selective the filter is."""
    monkeypatch.setattr(collocations, "FILTER_BITS", (6, 6))
    df = spark.createDataFrame(phrases, "doc_id long, text string, lang string, gram string").repartition(5)
    want = _collocations([(r[1], r[2]) for r in phrases], 8, 100, 80)
    assert sorted(map(tuple, collocations.collocations(df, least=8, top=100).collect())) == want


def test_collocations_of_nothing(spark):
    kind = "doc_id long, text string, lang string"
    empty = spark.createDataFrame([], kind)
    assert collocations.collocations(empty).collect() == []
    rare = spark.createDataFrame([(1, "a b c " * 5, "en")], kind)
    out = collocations.collocations(rare)
    assert out.collect() == [] and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    alone = spark.createDataFrame([(1, "a. " * 50, "en")], kind)
    assert collocations.collocations(alone).collect() == []


@pytest.fixture(scope="module")
def library():
    with open(bytebpe.RANKS_PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts():
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "日", "。", "ー", "한", "7", "٣", " ", " ", "\n", "\t", " ", " ", "\x1c", "\x85", "'s", "'", "!", "\U0001f600", "́", "　", "<|endoftext|>"]
    mixed = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    return [
        *(mixed(rng.randint(0, 60)) for _ in range(300)), mixed(2000), "", " ", "x" * 3000, " " * 900, "\n" * 900 + "a", "日本語" * 700 + "。" + "テスト" * 500,
        " " * 700 + "\n" + "end", ("word " * 90 + "12ab!? ") * 9, "a" + " " * 500 + "b" + "\t" * 400, "'s" * 800, "don't " * 300,
    ]


def test_parts_are_what_the_library_gives_for_whole_texts(monkeypatch, library):
    with open(bytebpe.RANKS_PATH, "rb") as f:
        ranks = f.read()
    monkeypatch.setattr(bytebpe, "PART", 16)
    monkeypatch.setattr(bytebpe, "_LONG_SPACE", re.compile(f"[{bytebpe._SPACE}]{{16,}}"))
    own = bytebpe.Encoder(ranks, public_tokenizers.PATTERN)
    for t in _texts():
        ids = library.encode_ordinary(t)
        assert own.encode(t) == ids and own.decode(ids) == t.encode()
    assert max(len(list(own.parts(t))) for t in _texts()) > 20
    assert own.decode([10**6]) is None and own.decode([]) == b""


def test_white_space_that_exhausts_the_library():
    with open(bytebpe.RANKS_PATH, "rb") as f:
        own = bytebpe.Encoder(f.read(), public_tokenizers.PATTERN)
    for t in (" " * 1_500_000 + "end", "a" + "\n" * 1_500_000):
        assert own.decode(own.encode(t)) == t.encode()


def test_token_digests_and_columns(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(_texts())] + [(None, None, "clash"), (3, "again", None), (3, "again", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(4)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, bytebpe.token_digests(df).collect()), key=str) == sorted(want, key=str)
    tokens = df.withColumn("ids", bytebpe.encoded(df))
    back = tokens.withColumn("bytes", bytebpe.decoded(tokens)).collect()
    assert all((r.text is None and r.ids is None and r.bytes is None) or bytes(r.bytes) == r.text.encode() for r in back)
    odd = spark.createDataFrame([([1, None],), ([999999],), ([],), (None,)], "ids array<int>")
    assert [r.b for r in odd.select(bytebpe.decoded(odd).alias("b")).collect()] == [None, None, b"", None]
