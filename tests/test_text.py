"""Scalar functions, one value a row."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as X


@pytest.fixture(scope="module")
def value(spark):
    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return run


@pytest.mark.parametrize("raw,want", [
    ("2401.01234", "2401.01234"), (" 2401.01234V2 ", "2401.01234v2"), ("https://arxiv.org/abs/2401.01234v3", "2401.01234v3"), ("https://arxiv.org/pdf/2401.01234.pdf", "2401.01234"),
    ("HEP-TH/9901001", "hep-th/9901001"), ("2413.01234", None), ("http://arxiv.org/abs/2401.01234", None), ("https://evil.org/abs/2401.01234", None), ("x", None),
])
def test_arxiv_id(value, raw, want):
    assert value(X.arxiv_id(F.lit(raw))) == want


def test_same_paper(value):
    assert value(X.same_paper(F.lit("2401.01234"), F.lit("2401.01234v2")))
    assert not value(X.same_paper(F.lit("2401.01234v1"), F.lit("2401.01234v2")))


@pytest.mark.parametrize("f,raw,want", [
    (X.clean_text, "soft­hyphen trans-\nlation and\nmore  blanks", "softhyphen translation and more blanks"),
    (X.canonical_furniture, "  Page 12  of 300 ", "page # of #"), (X.canonical_reference, "Figs. 3.a", "figure 3.a"), (X.canonical_reference, "Eq. (4)", "equation 4"),
    (X.canonical_reference, "Other", "other"), (X.reference_label, "[12] A. Author", "12"), (X.reference_label, "7. B", "7"), (X.reference_label, "none", None),
    (X.display_title, r"A \overline{B}  C", "A B C"), (X.decode_entities, "&lt;a&gt; &amp;lt;", "<a> &lt;"), (X.anchor_id, " a b!c ", "a-b-c"), (X.anchor_id, "!!", "block"),
    (X.inline_code, "a``b", "```a``b```"), (X.inline_code, "`x", "`` `x ``"), (X.slug, "Café: A Test.pdf", "cafe-a-test-pdf"), (X.displaced_diaeresis, "Schr¨odinger", "Schrödinger"),
    (X.request_content, "head Input: a Input: b ", "b"), (X.safe_ref, "#/texts/12", "texts-12"), (X.preferred_text and X.strip, "　x ", "x"),
])
def test_strings(value, f, raw, want):
    assert value(f(F.lit(raw))) == want


def test_references_and_citations(value):
    t = F.lit("See [1, 2] and (Smith et al., 2020) in Figure 3, Fig. 3 and Table A.1; Figures 1, 2 and 4.")
    assert value(X.citations(t)) == ["[1, 2]", "(Smith et al., 2020)"]
    assert value(X.object_references(t))[:3] == ["Figure 3", "Fig. 3", "Table A.1"]
    assert {"figure 1", "figure 2", "figure 4"} <= set(value(X.expanded_references(t)))


@pytest.mark.parametrize("text,font,bold,want", [
    ("Abstract:", 10.0, False, (None, 1, 0.99)), ("2.1 Method", 12.0, False, ("2.1", 2, 0.97)), ("2.1 Method", 10.0, True, ("2.1", 2, 0.97)), ("2.1 Method", 10.0, False, None),
    ("3 .5 %", 12.0, True, None), ("Appendix B More", 12.0, False, ("B", 1, 0.9)), ("Bold Title", 11.0, True, (None, 1, 0.9)), ("A sentence.", 11.0, True, None),
])
def test_heading(value, text, font, bold, want):
    got = value(X.heading(F.lit(text), F.lit(font), F.lit(bold), F.lit(10.0)))
    assert (tuple(got) if got else None) == want


def test_caption_and_equation(value):
    c = lambda t, f=10.0: value(X.caption_match(F.lit(t), F.lit(f), F.lit(10.0)))
    assert tuple(c("Fig. 2: A plot")) == ("figure", "2") and c("Table 3 shows") is None and tuple(c("Table 3 shows", 9.0)) == ("table", "3")
    box = G.rect(0.2, 0.1, 0.6, 0.2)
    e = lambda t, r=0.0: value(X.looks_like_equation(F.lit(t), box, F.lit(10.0), F.lit(10.0), F.array().cast("array<string>"), F.lit(r)))
    assert e("a = b + c (3)") and e("xyz", 0.5) and not e("where a = b + c (3)") and not e("plain words here only")


def test_join_source_parts(value):
    j = lambda *p: value(X.join_source_parts(F.array(*map(F.lit, p))))
    assert j("trans-", "lation", " of ", "text", ".") == "trans" + "lation of text."
    assert j("see [1,", "2]") == "see [1,2]" and j("x", "²") == "x²" and j('he said "', "hi", '"') == 'he said "hi"' and j("(", "a", ")") == "(a)"
    assert j("it's", "fine") == "it's fine" and j() == ""


def test_tags(value):
    n = lambda *t: value(X.normalize_tags(F.array(*map(F.lit, t))))
    assert n(" ML ", "ml", "a  b", "") == ["ML", "a b"] and n("x" * 33) is None and n(*map(str, range(13))) is None


def test_warnings(value):
    w = lambda o, j: value(X.invariant_warnings(F.lit(o), F.lit(j)))
    assert w("a [1] b", "a") == ["missing citation: [1]"] and w("BERT and API", "x API") == ["missing protected terms: BERT"]
    assert w("doi 10.1234/abc", "none") == ["missing DOI: 10.1234/abc"] and w("y" * 300, "y") == ["translation may be incomplete"] and w("a [1]", "b [1]") == []


def test_markdown_escapes(value):
    e = lambda t: value(X.escape_markdown(F.lit(t)))
    assert e("# a *b*") == r"\# a \*b\*" and e("1. x") == r"1\. x" and e("state-of-the-art") == "state-of-the-art" and e("- x") == r"\- x"
    assert e("    code") == "&#32;" * 4 + "code" and e("a\r\nb") == "a\nb" and e("[x](y)") == r"\[x\](y)"


@pytest.mark.parametrize("url,bad", [("javascript:x", True), ("java\tscript:x", True), ("https://a", False), ("/rel", False), ("mailto:a@b", False), ("data:x", True)])
def test_schemes(value, url, bad):
    assert value(X.has_unsafe_scheme(F.lit(url))) is bad


def test_paths_math_versions(value):
    ok = lambda p: value(X.is_local_asset(F.lit(p)))
    assert ok("assets/a.png") and not ok("assets/../x") and not ok("assets/%2e%2e/x") and not ok("/assets/a") and not ok("assets/a?x")
    assert value(X.is_safe_display_math(F.lit(r"a $b$ c"))) and not value(X.is_safe_display_math(F.lit("a $ b"))) and not value(X.is_safe_math(F.lit("`x`")))
    v = lambda s: X.version_key(F.lit(s))
    assert value(v("1.2.3-rc1") < v("1.2.3")) and value(v("1.10.0") > v("1.9.9")) and value(v("1.2")) is None


def test_binary_headers(value):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x00\x10\x00\x00\x00\x20"
    gif = b"GIF89a\x05\x00\x07\x00"
    assert value(X.raster_type(F.lit(png))) == "png" and tuple(value(X.raster_size(F.lit(png)))) == (16, 32)
    assert value(X.raster_type(F.lit(gif))) == "gif" and tuple(value(X.raster_size(F.lit(gif)))) == (5, 7)
    assert value(X.raster_type(F.lit(b"no"))) is None


def test_numbers(value):
    assert value(X.progress_percent(F.lit(1), F.lit(3), F.lit("x"))) == 33 and value(X.progress_percent(F.lit(0), F.lit(0), F.lit("completed"))) == 100
    assert value(X.token_coverage(F.lit("a a b"), F.lit("a c"))) == pytest.approx(1 / 3)
    assert len(value(X.layout_placeholder(F.lit("x" * 20)))) == 9 and len(value(X.layout_placeholder(F.lit("x")))) == 2
    assert value(X.published_at(F.lit("2024-3-5"))).strftime("%Y-%m-%d") == "2024-03-05" and value(X.published_at(F.lit("junk"))) is None
    assert value(X.event_time(F.lit("2024-01-01T00:00:00Z"))) is not None and value(X.event_time(F.lit("2024-01-01T00:00:00"))) is None


def test_rectangles(value):
    a, b = G.rect(0, 0, 2, 2), G.rect(1, 1, 3, 3)
    assert value(G.intersection_area(a, b)) == 1 and value(G.iou(a, b)) == pytest.approx(1 / 7) and value(G.overlap_ratio(a, b)) == 0.25
    assert value(G.overlap_ratio(G.rect(0, 0, 0, 0), b)) == 0 and value(G.center_inside(G.rect(1, 1, 2, 2), b)) and not value(G.center_inside(a, G.rect(5, 5, 6, 6)))
    s = lambda k, c, v: value(G.caption_score(F.lit(k), c, v))
    assert s("figure", G.rect(0.1, 0.5, 0.9, 0.55), G.rect(0.1, 0.2, 0.9, 0.5)) == pytest.approx(4.0)
    assert s("table", G.rect(0.1, 0.5, 0.9, 0.55), G.rect(0.1, 0.2, 0.9, 0.5)) == pytest.approx(3.85)
    assert s("figure", G.rect(0.1, 0.5, 0.2, 0.55), G.rect(0.8, 0.2, 0.9, 0.5)) == -1
    assert tuple(value(G.from_bottom_left(G.rect(1, 2, 3, 5), F.lit(10.0)))) == (1, 5, 3, 8)
    assert value(G.box_matches(a, G.rect(0.05, 0, 2, 2.09))) and not value(G.box_matches(a, b)) and value(G.side_by_side(G.rect(0, 0, 1, 1), G.rect(1.05, 0, 2.05, 1)))


def test_coercions_and_markdown_bits(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    L = F.lit
    assert [one(X.ref_value(L(v))) for v in ('{"$ref": "#/a/1"}', "#/b", "b")] == ["#/a/1", "#/b", None]
    assert [one(X.content_layer(L(v))) for v in (" Furniture ", "", None)] == ["furniture", "body", "body"]
    assert [one(X.page_number(L(v))) for v in ("3", "0", "-1", "x", "1.5")] == [3, None, None, None, None]
    assert [one(X.number_or(L(v), 2)) for v in ("1e2", "nan", "", "-.5")] == [100.0, 2.0, 2.0, -0.5]
    assert [one(X.relative_asset(L(v))) for v in ("./a\\b.png", "../x", "https://x")] == ["a/b.png", None, None]
    assert [one(X.markdown_destination(L(v), "p-")) for v in ("#a b", "#", "https://x.org/a b", "javascript:x", "a.html")] == ["#p-a-b", None, "<https://x.org/a%20b>", None, "a.html"]
    assert one(X.inline_anchor(L("x y"))) == '<a id="x-y"></a>'
    assert [one(X.math_markdown(L(t), L(d))) for t, d in (("x^2", False), ("x^2", True), ("a`b", False))] == ["$x^2$", "$$\nx^2\n$$", "``a`b``"]
    assert [one(X.media_fallback(L(a), L(b), L("cap"))) for a, b in (("", None), ("a*b", "t"))] == ["[cap]", "[a\\*b]"]
    assert [one(X.attribute_text(L(v))) for v in ('["a","b"]', "a b", "[x")] == ["a b", "a b", "[x"]


def test_addresses_close_up_however_many_spaces(spark):
    one = lambda t: spark.range(1).select(X.url_spacing(F.lit(t))).first()[0]
    long = "see https : // a.org" + "".join(f"/ p{i}" for i in range(30)) + " end"
    assert one(long) == "see https://a.org" + "".join(f"/p{i}" for i in range(30)) + " end"
    assert one("https://a .org and B / c") == "https://a.org and B / c" and one("a. b https://x.org/ Y") == "a. b https://x.org/ Y"


def test_filler_takes_time_in_proportion_to_the_text(spark):
    texts = ["", "x", "ab\n", "é" * 20, "x" * 21, *(c * 7 for c in "abcdefgh"), "ü-" * 150_000]
    begun = time.time()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.layout_placeholder(F.col("t")).alias("p")).collect()
    assert time.time() - begun < 30  # a digest for every character of the filler takes minutes
    for t, row in zip(texts, got):
        n, at = max(2, -(-len(t) * 45 // 100)), hashlib.sha256(t.encode()).digest()[0]
        assert row.p == "".join("訳文配置確認用"[(at + i) % 7] for i in range(n))


def test_strip_and_blank_by_runs(spark):
    texts = ["", " ", "a", " a", "a ", "  a b 　", "\n\na\r\n\n", "a  ", "  \u0085 ", "a  b  c  ", "\U0001f600 ", "​", "\x1c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        X.strip(F.col("t")).alias("s"), X.is_blank(F.col("t")).alias("b"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("old")).collect()
    assert all(r.s == r.old and r.b == (r.old == "") for r in rows)
    begun = time.time()
    long = spark.createDataFrame([("a" + " " * 200_000 + "b ",)], "t string").select(F.length(X.strip(F.col("t"))), X.is_blank(F.lit(None).cast("string"))).first()
    assert tuple(long) == (200_002, True) and time.time() - begun < 20
