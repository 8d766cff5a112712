"""Operators over documents: brute-force versions, and nulls, blanks, long texts, ties, repeats, empty tables, clashing columns."""

import collections
import math
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from foliant.llm import ballhash, bytebpe, divergence, hmm, langid, lattice, license_index, mixing, pieces, runs, viterbi

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp string, size double, score string, words string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _text(seed, n=60, words="the of and to in is that it for was on with as be by this are at from er".split()):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(words) if rng.random() < 0.5 else "w%d" % rng.integers(500) for _ in range(n))


def _rows():
    near = _text(7, 400)
    texts = [
        _text(1), _text(1), None, "", " \n\t ", "word", "a b c", _text(2, 5000), "x" * 20000, near, near + " tail", "Ünï ß 日本語 ▁ \U0001F600",
        "same line here\nsame line here\n\nother line\nsame line here", " ".join(["buy now and save big today only friends"] * 20),
        "Licensed under the Apache License, Version 2.0. " + _text(3), "MIT LICENSE mit license", "!!! ??? 123", "K" * 3 + "K license",
    ]
    langs = ["en", "de", None, "en"]
    rows = [(i, t, langs[i % 4], ["a", "b", None][i % 3], 1, True, "f", 1.0, "s", "w") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[7], (None, "no id here at all", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"]) for r in df.collect())


@pytest.mark.parametrize("run", [
    divergence.quality, ballhash.simhash_components, viterbi.count_tokens, license_index.scan, langid.predict_languages,
    hmm.score_documents, lattice.segmentation_digests, mixing.mix, runs.run_digests, bytebpe.token_digests,
])
def test_every_row_once_and_empty_tables(docs, empty, run):
    assert _ids(run(docs)) == sorted((r[0] is None, r[0]) for r in _rows())
    assert run(empty).collect() == []


@pytest.mark.parametrize("keep", [divergence.keep_good, langid.keep_identified, ballhash.keep_one, mixing.mixed])
def test_stages_keep_columns(docs, empty, keep):
    out = keep(docs)
    assert out.columns == docs.columns
    known = {tuple(r) for r in _rows()}
    assert {tuple(r) for r in out.collect()} <= known
    assert keep(empty).collect() == []


def _quality(text):
    t = text or ""
    w = WORDS.findall(t)
    win = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_base(docs):
    want = {(r[0], r[1]): _quality(r[1]) for r in _rows()}
    by_id = {k[0]: v for k, v in want.items()}
    for r in divergence.quality(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == by_id[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_quality_distances(spark):
    clean = [(i, _text(i, 200), "en") for i in range(40)]
    odd = [(100, " ".join("w%d" % i for i in range(200)), "en"), (101, " ".join("#w%d!!&&&" % i for i in range(200)), "en")]
    df = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")
    refs = divergence.references(df)
    got = {r.doc_id: r for r in divergence.quality(df).collect()}
    assert all(got[i].kept for i, _, _ in clean) and not got[101].kept

    def js(p, q):
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
        part = lambda d: sum(v * math.log2(v / m[k]) for k, v in d.items() if v > 0)
        return math.sqrt(max(0, (part(p) + part(q)) / 2))

    ref = refs[0]["words"]
    for i, t, _ in clean[:5] + odd:
        c = collections.Counter(WORDS.findall(t))
        n = sum(c.values())
        p = {w: c[w] / n for w in ref if c[w]}
        p[""] = 1 - sum(p.values())
        assert got[i].word_distance == pytest.approx(js(p, {**ref, "": 1 - math.fsum(ref.values())}), abs=1e-6)


def test_a_small_language_keeps_its_clean_documents(spark):
    small = "и в не на что он как это по но из за то все так его мы было она они".split()
    rows = [(i, _text(i, 2000), "en") for i in range(40)] + [(100 + i, _text(900 + i, 100, small), "ru") for i in range(2)]
    rows += [(200, _text(5, 70), None), (201, "short", "de"), (202, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in divergence.quality(df).collect()}
    assert got[100].kept and got[101].kept and got[100].char_distance < 0.27
    refs = divergence.references(df, in_plan=2)
    assert [r["lang"] for r in divergence.references(df)] == ["de", "en", "ru"] and refs.count() == 3
    by_table = divergence.with_quality(df, refs).collect()
    assert len(by_table) == len(rows)
    for r in by_table:
        for c in ("char_distance", "word_distance"):
            assert (r[c] is None) == (got[r.doc_id][c] is None) and r[c] == pytest.approx(got[r.doc_id][c], abs=1e-9)
        assert r.kept == got[r.doc_id].kept


def _print(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = WORDS.findall(w)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(ids, linked):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if linked(i, j):
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash_brute_force(docs):
    rows = _rows()
    fps = [_print(r[1]) for r in rows]
    comp = _components([r[0] for r in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    want = sorted((str(r[0]), f"{f:016x}", str(c)) for r, f, c in zip(rows, fps, comp, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in ballhash.simhash_components(docs).collect())
    assert got == want


def test_each_component_keeps_one_row_whatever_its_ids(spark):
    a, b, c = (_text(k, 100) for k in (11, 12, 13))
    rows = [(None, a), (None, a), (None, b), (5, b + " tail"), (7, c), (7, _text(14, 100)), (7, c), (9, c), (None, c), (None, _text(15, 100))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [_print(t) for _, t in rows]
    group = _components(range(len(rows)), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    parts = {}
    for i, r in enumerate(rows):
        parts.setdefault(group[i], []).append(r)
    got = [tuple(r) for r in ballhash.keep_one(df).collect()]
    assert len(got) == len(parts) >= 5
    for own in parts.values():
        least = min((i for i, _ in own if i is not None), default=None)
        assert sum(r in own and r[0] == least for r in got) == 1


def test_ball_hashing_links_all_pairs_within_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    prints = set(base.tolist())
    for f in base.tolist():
        for r in range(1, 7):
            prints.add(f ^ sum(1 << int(b) for b in rng.choice(64, r, replace=False)))
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in prints], "fp long").repartition(3)
    from foliant.llm.common import connected_components

    got = {int(np.int64(r.v).view(np.uint64)): r.root for r in connected_components(ballhash.links_within(df)).collect()}
    comp = _components(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    for i, j in combinations(range(len(prints)), 2):
        a, b = got.get(prints[i], prints[i]), got.get(prints[j], prints[j])
        assert (a == b) == (comp[i] == comp[j])


def test_bucket_slices_agree():
    prints = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 300, np.uint64))
    prints = np.unique(np.concatenate([prints, prints[:50] ^ np.uint64(0b1011)]))
    for bits in (2, 6, 12):
        edges = set()
        for b in range(1 << bits):
            if bits < 12 or b % 97 == 0:
                u, v = ballhash._in_bucket(b, prints, bits, 4)
                edges |= set(zip(u.tolist(), v.tolist(), strict=True))
        if bits < 12:
            assert len({max(e) for e in edges}) == 50


def test_token_counts_against_the_library(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = pieces.read_model()
    m = proto.ModelProto()
    m.ParseFromString(model)
    m.trainer_spec.model_type = 1
    sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    c = viterbi.Counter(pieces.parse(model), memo_size=50)
    for t in [_text(i, 12) for i in range(60)] + ["the quick brown fox", "Ünïcode ß naïve", "thestionon theast"]:
        best = sp.nbest_encode_as_pieces(t, 2)[0]  # its exact lattice search
        n, score = c.of(t)
        assert score == pytest.approx(sum(sp.get_score(sp.piece_to_id(p)) for p in best))
        assert n == len(best)


def _viterbi(text, voc):
    s = " " + text.replace(pieces.MARKER, " ")
    best = [(0.0, 0)] + [None] * len(s)
    for e in range(1, len(s) + 1):
        for a in range(max(0, e - 20), e):
            if best[a] is None:
                continue
            if s[a:e] in voc.pieces:
                cand = (best[a][0] + voc.pieces[s[a:e]][1], best[a][1] + 1)
            elif e - a == 1:
                cand = (best[a][0] + voc.unknown_score, best[a][1] + len(s[a].encode()))
            else:
                continue
            if best[e] is None or cand[0] > best[e][0]:
                best[e] = cand
    return best[-1][1], best[-1][0]


def test_token_counts_brute_force(docs):
    voc = pieces.parse(pieces.read_model())
    want = {r[0]: (0, 0.0) if not r[1] else _viterbi(r[1], voc) for r in _rows() if not r[1] or len(r[1]) < 6000}
    for r in viterbi.count_tokens(docs).collect():
        if r.doc_id in want:
            assert (r.n_pieces, r.score) == want[r.doc_id]


def test_sampled_pieces_are_lossless_and_reproducible(docs):
    rows = {(r.doc_id, r.n_pieces, r.pieces_hash) for r in lattice.segmentation_digests(docs).collect()}
    assert all(r.lossless for r in lattice.segmentation_digests(docs).collect())
    assert rows == {(r.doc_id, r.n_pieces, r.pieces_hash) for r in lattice.segmentation_digests(docs.repartition(7)).collect()}
    other = {(r.doc_id, r.n_pieces, r.pieces_hash) for r in lattice.segmentation_digests(docs, seed=8).collect()}
    assert rows != other


@pytest.mark.parametrize("word", ["thing", "nation"])
def test_sampling_follows_the_lattice(word):
    s = lattice.Sampler(pieces.read_model(), alpha=0.6)
    voc = s.vocabulary

    def every(t):
        if not t:
            yield ()
        for k in range(1, len(t) + 1):
            if t[:k] in voc.pieces:
                for r in every(t[k:]):
                    yield (voc.pieces[t[:k]][0], *r)

    weight = {p: math.exp(sum(s.table.log_weight[i] for i in p)) for p in every(" " + word)}
    total, n = sum(weight.values()), 40000
    got = collections.Counter(tuple(x.tolist()) for x in s.encode([word] * n, list(range(n))))
    assert set(got) <= set(weight)
    big = [(got[p], n * w / total) for p, w in weight.items() if n * w / total > 8]
    chi = sum((o - e) ** 2 / e for o, e in big)
    assert chi < len(big) + 4 * math.sqrt(2 * len(big)) + 4


def _points(words):
    flat = np.array([ord(c) + 1 for w in words for c in w], np.uint64)
    sizes = np.array([len(w) for w in words])
    return flat, np.cumsum(sizes) - sizes, sizes


def test_long_chunks_agree_with_short_ones():
    s = lattice.Sampler(pieces.read_model())
    word = "internationalization" * 2
    s.table.add(*_points([" " + word]))
    short = s.table.share[: s.table.n_edges].copy()
    s.table.reset()
    s.table._add(_points([" " + word])[0], np.array([41]), True)
    assert np.allclose(short, s.table.share[: s.table.n_edges])


def test_shares_are_forward_sums():
    s = lattice.Sampler(pieces.read_model(), alpha=0.5)
    voc, t = s.vocabulary, s.table
    words = [" nation", "the", " ßen", "\n", " a", " 😀x", "x" * 60]
    ends = t.add(*_points(words))
    name = {i: p for p, (i, _) in voc.pieces.items()}
    for word, end in zip(words, ends.tolist(), strict=True):
        forward = [1.0]
        options = []
        for e in range(1, len(word) + 1):
            own = {}
            for a in range(max(0, e - t.longest), e):
                if word[a:e] in voc.pieces:
                    own[word[a:e]] = forward[a] * math.exp(t.log_weight[voc.pieces[word[a:e]][0]])
                elif e - a == 1:
                    own[word[a:e]] = forward[a] * math.exp(t.log_weight[voc.bytes_[0]])
            forward.append(sum(own.values()))
            options.append(own)
        node, at = end, len(word)
        while node >= 0:  # along the first edges back to the start
            e, left, seen = int(t.first[node]), 1.0, []
            while True:
                seen.append((int(t.piece[e]), float(t.share[e])))
                if seen[-1][1] > 1:
                    break
                left -= seen[-1][1]
                e += 1
            own = options[at - 1]
            assert len(seen) == len(own)
            for i, share in seen:
                w = name.get(i, word[at - 1 : at])
                assert (left if share > 1 else share) == pytest.approx(own[w] / forward[at], abs=1e-9)
            first = name.get(seen[0][0])
            node = int(t.back[t.first[node]])
            at -= len(first) if first else 1
            if first is None:  # a lone character: its other bytes come one by one
                while node >= 0 and t.share[t.first[node]] > 1 and int(t.piece[t.first[node]]) in voc.bytes_[128:]:
                    node = int(t.back[t.first[node]])
        assert at == 0


def test_runs_and_tables_change_no_piece(monkeypatch):
    texts = [_text(k, 300) + " ünï 日本語 \n\n  x" + "q" * (k * 20) for k in range(12)] + [None, "", " ", "\n", " \n a  b"]
    keys = list(range(len(texts)))
    whole = [x.tolist() for x in lattice.Sampler(pieces.read_model()).encode(texts, keys)]
    monkeypatch.setattr(lattice, "RUN_BYTES", 500)
    monkeypatch.setattr(lattice, "TABLE_EDGES", 3000)
    monkeypatch.setattr(lattice, "_TOGETHER", 3)
    s = lattice.Sampler(pieces.read_model())
    assert [x.tolist() for x in s.encode(texts, keys)] == whole
    assert [x.tolist() for x in s.encode(texts[::-1], keys[::-1])] == whole[::-1]
    counts = np.array([len(x) for x in whole])
    flat = np.array([i for x in whole for i in x], np.int32)
    assert [t.decode() for t in s.decode(flat, counts).to_pylist()] == [t or "" for t in texts]


def test_chunk_table_keeps_and_finds():
    t = lattice.Sampler(pieces.read_model()).table
    h = np.unique(np.random.default_rng(1).integers(1, 1 << 63, 5000, np.uint64))
    h[:50] = np.arange(1, 51, dtype=np.uint64)  # all in one slot
    t.keep(h[:4000], np.arange(4000))
    assert t.lookup(h).tolist() == [*range(4000), *[-1] * (len(h) - 4000)]


def test_decoding_and_other_columns(spark, docs):
    found = lattice.with_pieces(docs)
    assert found.columns == [*docs.columns, "piece_ids", "lossless"]
    back = lattice.decode(found.select("doc_id", "text", "piece_ids", "lossless"), out="again").collect()
    assert len(back) == len(_rows()) and all(r.lossless and r.again == (r.text or "") for r in back)


def _licences(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(license_index.CAPITALS, license_index.SMALL)))
    at, labels = [], set()
    for p, label in license_index.BASE:
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licences(docs, spark):
    by_id = {r[0]: _licences(r[1]) for r in _rows()}
    for r in license_index.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == by_id[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    filler = [(i, _text(i, 300)) for i in range(10, 40)]
    texts = [(i, _text(i, 300) + " " + t + " " + _text(i + 50, 20)) for i, (_, _, t) in enumerate(license_index.TEMPLATES)]
    got = {r.doc_id: r for r in license_index.scan(spark.createDataFrame(texts + [(100 + i, t) for i, t in filler], "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(license_index.TEMPLATES):
        assert label in got[i].labels.split(",")
    assert all(got[100 + i].labels == "" for i, _ in filler)
    # the phrase far from the rest of the notice gives no label, and near it does
    body = "redistribution and use in source and binary forms"
    notice = next(t for label, _, t in license_index.TEMPLATES if label == "bsd-text")
    broken = notice.lower().replace("source and binary", "binary and source")
    moved = [(1, broken + " " + _text(1, 60) + " " + body), (2, _text(2, 50) + " oh " + notice), (3, _text(3, 50) + " " + broken)]
    got = {r.doc_id: r for r in license_index.scan(spark.createDataFrame(moved + [(100 + i, t) for i, t in filler], "doc_id long, text string")).collect()}
    assert "bsd-text" not in got[1].labels and "bsd-text" in got[2].labels and "bsd-text" not in got[3].labels


def test_predictions_do_not_depend_on_the_matrices(spark, monkeypatch):
    rows = [(i, _text(i, 25, [f"{chr(97 + k)}{j}x" for j in range(12)]), f"l{k:02d}") for i in range(260) for k in [i % 13]]
    rows += [(None, "a1x b2x a3x", "l00"), (500, None, "l01"), (501, "123", "l02"), (502, "zz yy", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted(map(tuple, langid.predict_languages(df).collect()), key=str)
    monkeypatch.setattr(langid, "MATRIX_BYTES", 5 * (4 << langid.BUCKET_BITS))
    monkeypatch.setattr(langid, "GATHER_LANGUAGES", 2)
    assert len(langid.fit(df)) == 3
    split = sorted(map(tuple, langid.predict_languages(df).collect()), key=str)
    assert [r[:3] for r in split] == [r[:3] for r in whole] and len({r[2] for r in whole}) > 10
    assert np.allclose([r[3] for r in split], [r[3] for r in whole], atol=1e-9)
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == sum(r[3] >= 0.5 for r in whole)


def test_many_notices_in_one_file(spark):
    filler = [(100 + i, _text(i, 300)) for i in range(40)]
    rows = [(1, "Released under the MIT License. " * 20_000), (2, "MIT License. " * 5_000), (3, "permission is hereby granted free of charge " * 3_000)]
    began = time.monotonic()
    got = {r.doc_id: r for r in license_index.scan(spark.createDataFrame(rows + filler, "doc_id long, text string")).collect()}
    assert time.monotonic() - began < 120
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (100_000, 20_000, 3, 99_998, "mit,mit-notice")
    assert got[2].n_base == 5_000 and got[2].labels == "mit" and got[3].labels == "" and 0 < got[3].score < 0.7


def test_own_licences(spark):
    table = spark.createDataFrame([("house", "our house terms", "Use is subject to our house terms, of May"), ("other", "other terms", "under other terms")], "label string, phrase string, text string")
    own = license_index.templates_of(table)
    docs = spark.createDataFrame([(i, _text(i, 80)) for i in range(30)] + [(50, "x use is subject to our house terms of may"), (51, "MIT license")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_index.scan(docs, own).collect()}
    assert got[50] == "house" and got[51] == "mit" and got[3] == ""
    for bad in ([("a", "not there", "text")], [("a", "", "text")], [(None, "text", "text")], [], [("a", "w", "w " * 6000)]):
        with pytest.raises(ValueError, match="template"):
            license_index.checked(bad)


def test_languages_held_out(spark):
    sets = {"en": "the of and to in is that it for was".split(), "de": "der die und den von zu das mit sich auf".split()}
    rows = [(i, " ".join(np.random.default_rng(i).choice(sets[k], 30)), k) for i in range(200) for k in [("en", "de")[i % 2]]]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "the and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict_languages(df).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(got[i].lang_pred == k for i, _, k in rows[:200])
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert got[1002].lang_pred == "en"
    none = langid.predict_languages(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).first()
    assert none.lang_pred == "und"


def test_language_scores_do_not_depend_on_batches():
    rng = np.random.default_rng(0)
    m = langid.Model(["a", "b"], rng.normal(-5, 1, (1 << 12, 2)).astype(np.float32), np.log([0.5, 0.5]), 12)
    texts = ["abc", "", "a", "hello world" * 50, "x" * 40000, "ab"]
    one = [langid.predict([t], m) for t in texts]
    names, scores = langid.predict(texts, m)
    assert names == [n[0] for n, _ in one] and np.allclose(scores, [s[0] for _, s in one])


def test_hidden_markov_base_counts(docs):
    rows = _rows()
    tokens = lambda t: (t or "").encode().lower().split()
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    c, n_docs = collections.Counter(), 0
    for r in rows:
        if train(r[0]):
            c.update(tokens(r[1]))
            n_docs += 1
    n, v = sum(c.values()) + n_docs, len(c) + 1
    log = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    want = {r[0]: (len(tokens(r[1])) + 1, 1 + sum(w in c for w in tokens(r[1])), sum(log(c[w]) for w in tokens(r[1])) + log(n_docs)) for r in rows}
    for options in ({}, {"symbols": 5, "frequent": 10, "classes": 7}):
        for r in hmm.score_documents(docs, rounds=1, **options).collect():
            t, k, b = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (t, k, n, not train(r.doc_id))
            assert r.base_score == pytest.approx(b) and math.isfinite(r.score) and r.score < 0


def test_forward_and_baum_welch_by_enumeration():
    rng = np.random.default_rng(5)
    draw = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s))
    m = hmm.Model(draw(3), draw(3, 3), draw(3, 4).T)
    seqs = [np.array(s) for s in ([1], [0, 2, 3], [3, 3, 1, 0])]
    paths = lambda n: np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
    total, counts = [], np.zeros((4, 3))
    for s in seqs:
        ps = paths(len(s))
        p = m.start[ps[:, 0]] * np.prod(m.emit[s[None, :], ps], axis=1) * np.prod(m.move[ps[:, :-1], ps[:, 1:]], axis=1)
        total.append(math.log10(p.sum()))
        for t, o in enumerate(s):
            for k in range(3):
                counts[o, k] += p[ps[:, t] == k].sum() / p.sum()
    side = np.concatenate(seqs), np.array([len(s) for s in seqs])
    assert np.allclose(hmm.forward(*side, m), total)
    start, move, emit, like = hmm.expected_counts(*side, m)
    assert np.allclose(emit, counts, rtol=1e-4) and like == pytest.approx(sum(total), rel=1e-5)
    assert start.sum() == pytest.approx(3, rel=1e-5) and move.sum() == pytest.approx(sum(len(s) - 1 for s in seqs), rel=1e-5)


def test_words_of_arrow_texts():
    texts = [r[1] for r in _rows()] + [" A\x0bb\tC\n", "end", "Start"]
    held = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    for part in (held, held.slice(3, 9)):
        w = hmm.words_in(part)
        flat = [w.distinct[int(c)].as_py() for c in w.code]
        want = [(t or b"").lower().split() for t in part.to_pylist()]
        assert flat == [x for t in want for x in t] and w.counts.tolist() == [len(t) for t in want]


def test_every_training_round_sees_all_training_documents(spark, monkeypatch):
    rows = [(i, f"w{i % 50} x{i % 7} y{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows)
    seen, likes, real = [], [], hmm._round

    def spy(texts, lex, model):
        seen.append(texts.count())
        model, like = real(texts, lex, model)
        likes.append(like)
        return model, like

    monkeypatch.setattr(hmm, "_round", spy)
    assert hmm.score_documents(df).count() == len(rows)
    assert seen == [train] * 8 and all(b > a - 1 for a, b in zip(likes, likes[1:], strict=False))


def test_mix_targets():
    assert mixing.targets_of([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.targets_of([10, 100, 1000], [1, 2, 3]) == pytest.approx([30, 300, 780])
    assert mixing.targets_of([0, 5], [1, 2]) == pytest.approx([0, 5])
    assert mixing.targets_of([], []) == []


def test_splitting_tree_is_exact():
    q = [5, 0, 17, 100, 3]
    out = mixing.split_quotas(q, 8)
    assert out.sum(axis=0).tolist() == q
    assert np.ptp(out.sum(axis=1)) <= 1


def test_mix_is_near_its_targets(spark):
    rows = [(i, _text(i, 5 + i % 40), ["a", "b", "c", None][i % 4]) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    by = collections.defaultdict(list)
    of = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.size * len(r.shards) and r.size == len(WORDS.findall(rows[r.doc_id][1]))
        by[of[r.doc_id]].append(r)
    sizes = [sum(r.size for r in by[s]) for s in ("a", "b", "c", None)]
    for s, t in zip(("a", "b", "c", None), mixing.targets_of(sizes, [1, 2, 3, 1]), strict=True):
        assert by[s][0].target == pytest.approx(t) and by[s][0].source_size == sum(r.size for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - t) <= 45
    assert mixing.mixed(df).count() == sum(len(r.shards) for r in got)
