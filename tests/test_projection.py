"""Pages to Markdown blocks, against blocks worked out by hand and a plain recursive walk of given pages."""

import re

import pytest
from pyspark.sql import functions as F

from foliant.operators import html, markdown, projection

PAGE = """<html><body><nav>menu</nav><article class="ltx_document"><h1 class="ltx_title" id="T">A <em>new</em> *title*</h1>
<div class="ltx_authors"><span class="x">Ann <b>B</b></span></div>
<section id="S1"><h2>One</h2><div id="S1.p1"><p id="p1">See <a href="#E2">eq <i>two</i></a>, <a href="javascript:x">bad</a> and <a href="#tab">table</a>.<br>
  <math alttext="a&lt;b"><mi>a</mi></math> with <code>x`y</code> <span class="ltx_font_bold">bold <del>no</del></span><script>gone</script></p></div>
 <table class="ltx_equationgroup" id="E"><tbody id="EB"><tr class="ltx_eqn_row" id="E1"><td><math id="m1"><annotation encoding="application/x-tex">x=1</annotation></math></td>
  <td><span class="ltx_tag_equation">(1)</span></td></tr><tr class="ltx_eqn_row" id="E2"><td><math><annotation encoding="application/x-tex">y</annotation></math><math><annotation encoding="application/x-tex">z](1)</annotation></math></td></tr></tbody></table>
 <div class="ltx_equation" id="E3"><math><annotation encoding="application/x-tex">q</annotation></math><span class="ltx_tag_equation">(3)</span></div>
 <math display="block" alttext="k > 1"></math><math alttext="n"></math>
</section>
<section id="S2"><section><h3 id="own">Two.one</h3></section>
 <ul id="L"><li id="i1"><span class="ltx_tag_item">-</span>first <a href="#i3">third</a><ol start="4"><li>four</li><li>five<div class="ltx_listing" id="ls"><div class="ltx_listingline" id="l1">a  <math alttext="m"></math></div><div class="ltx_listingline" id="l2">b</div></div></li></ol></li>
 <li id="i2"></li><li id="i3">third <svg><rect width="1" onload="x"></rect></svg></li></ul>
 <table id="tab"><thead id="th"><tr><th>h|1</th><th colspan="2">h2</th></tr></thead><tr><td><b>c</b></td><td>d</td><td>e</td></tr></table>
 <table><tr><td rowspan="2" style="x" onclick="y">tall</td></tr></table>
 <pre id="code">  two
 lines</pre><code class="ltx_verbatim"> </code>
</section>
<figure id="F1" class="ltx_figure"><img src="assets/a.png" alt="A"><figcaption id="fc">Cap <i>one</i></figcaption><figure id="F1a"><img src="http://x/y.png" alt="sub"></figure></figure>
<figure id="F2" class="ltx_table"><table><tr><td>1</td></tr></table><figcaption>Tab</figcaption></figure>
<figure id="F3"><div><figure><svg><g></g></svg></figure></div><figcaption>outer</figcaption></figure>
<figure id="F4"> only   text </figure>
<figure id="F5"><div class="ltx_listing"><div class="ltx_listingline">run</div></div><figcaption>Lst</figcaption></figure>
<ul class="ltx_biblist"><li id="b1" class="ltx_bibitem">Ref 1</li></ul>
</article></body></html>"""

WANT = [
    ("heading", "A *new* \\*title\\*", 1, "T"), ("paragraph", "Ann **B**", None, None),
    ("heading", "One", 2, "S1"), ("paragraph", None, None, "S1.p1"),
    ("paragraph", 'See [eq *two*](#E2), bad and [table](#tab). $a\\lt{}b$ with ``x`y`` **bold ~~no~~**', None, "p1"),
    ("paragraph", None, None, "E"), ("paragraph", None, None, "EB"), ("paragraph", None, None, "m1"), ("equation", "x=1", None, "E1", "(1)"),
    ("paragraph", None, None, "E"), ("paragraph", None, None, "EB"), ("equation", "y\n\\qquad\nz]{}(1)", None, "E2"),
    ("equation", "q", None, "E3", "(3)"), ("equation", "k \\gt{} 1", None, None), ("paragraph", "$n$", None, None),
    ("heading", "Two.one", 3, "own"), ("paragraph", None, None, "L"),
    ("list_item", "first [third](#i3)", 1, "i1"), ("list_item", "four", 2, None), ("list_item", "five<a id=\"ls\"></a><a id=\"l1\"></a>a $m$<a id=\"l2\"></a>b", 2, None), ("code", "a $m$\nb", None, "ls"),
    ("paragraph", None, None, "l1"), ("paragraph", None, None, "l2"), ("paragraph", None, None, "i2"),
    ("list_item", 'third <svg><rect width="1"></rect></svg>', 1, "i3"), ("figure", '<svg><rect width="1"></rect></svg>', None, None),
    ("paragraph", None, None, "th"), ("table", None, None, "tab"), ("table", '<table><tr><td rowspan="2" style="x">tall</td></tr></table>', None, None),
    ("code", "  two\n lines", None, "code"),
    ("figure", None, None, "F1", '<a id="fc"></a>Cap *one*'), ("figure", "sub", None, "F1a"), ("table", None, None, "F2", "Tab"),
    ("figure", "<svg><g></g></svg>", None, None), ("figure", None, None, "F3", "outer"), ("figure", "only text", None, "F4"),
    ("figure", None, None, "F5", "Lst"), ("code", "run", None, None), ("reference", "Ref 1", 1, "b1"),
]


UNITS = (
    "<article><h1 id='h'>Old</h1><p id='u1'>see <b><math alttext='x'></math></b> and <cite>C <span id='u2'>note <code>k</code></span></cite> end</p>"
    "<p id='u3'>one <i>plain</i></p><p id='u4'>lost <math alttext='y'></math></p></article>"
)


@pytest.fixture(scope="module")
def nodes(spark):
    own = spark.createDataFrame([("a", PAGE), ("b", "<article><p>no title</p></article>"), ("c", ""), ("d", None), ("u", UNITS)], "doc_id string, html string")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.concat(F.lit("page"), "page_id").alias("doc_id"), "html")
    return html.node_table(own.union(pages))


@pytest.fixture(scope="module")
def ids(nodes):
    return {r["attrs"]["id"]: r.node_id for r in nodes.where("doc_id = 'u'").collect() if r.attrs and "id" in r["attrs"]}


@pytest.fixture(scope="module")
def projected(spark, nodes, ids):
    units = spark.createDataFrame([
        ("u", ids["h"], "新_題", "Old", None), ("u", ids["u1"], "[[PTX_0003]] は [[PTX_0002]]  を", "x", {"[[PTX_0002]]": "x", "[[PTX_0003]]": "C"}),
        ("u", ids["u2"], "", "note [[PTX_0001]]", {}), ("u", ids["u3"], None, "one plain [[PTX_0009]]", {}), ("u", ids["u4"], "without", "y", {"[[PTX_0001]]": "y"}),
    ], "doc_id string, node_id long, japanese string, translation_source string, placeholders map<string,string>")
    return projection.all_blocks(nodes, units)


def test_blocks_by_hand(projected):
    blocks, problems = projected
    got = [r for r in blocks.where("doc_id = 'a'").orderBy("pos").collect()]
    show = [(r.kind, r.text, r.level, r.anchor, r.caption) for r in got]
    want = [(*w, None)[:5] for w in WANT]
    assert show == want
    by = {r.anchor: r for r in got if r.kind in ("table", "list_item", "figure", "reference")}
    assert by["tab"].rows == [["h\\|1", "h2", ""], ["**c**", "d", "e"]] and by["F2"].rows == [["1"]]
    assert (by["F1"].asset, by["F1"].label, by["F1a"].asset) == ("assets/a.png", "A", None)
    assert [(r.ordered, r.start) for r in got if r.kind == "list_item"] == [(False, 1), (True, 4), (True, 5), (False, 3)]
    assert {r.doc_id: r.problem for r in problems.collect() if r.doc_id != "u"} == {"b": "no heading of level 1"}


def test_readable_blocks(projected):
    out = projection.sound(*projected)
    rows = out.where("doc_id not like 'page%'").orderBy("pos").collect()
    assert {r.doc_id for r in rows} == {"a"}
    assert {r.anchor for r in rows if r.anchor} == {"E2", "tab", "i3"}
    assert not any(r.kind == "paragraph" and not r.text for r in rows) and all("<a id" not in (r.text or "") + (r.caption or "") for r in rows)
    text = markdown.serialize(out.where("doc_id = 'a'")).first().markdown
    assert text.startswith("# A *new*") and "| h\\|1 | h2 |" in text and "    4. four" in text and '<a id="E2"></a>' in text


def test_units_with_tokens(projected, ids):
    blocks, problems = projected
    assert [r.text for r in blocks.where("doc_id = 'u' and text is not null").orderBy("pos").collect()] == [
        "新\\_題", 'C <a id="u2"></a>note `k` は $x$ を', "one plain \\[\\[PTX\\_0009\\]\\]", "without"
    ]
    assert [r.problem for r in problems.where("doc_id = 'u'").collect()] == [f"tokens of node {ids['u4']} do not match its protected elements"]


def _walk(rows, node):
    """Inline Markdown of the inside of a node of the given pages (headings, paragraphs, bold, breaks)."""
    def one(r):
        if r.type == "text":
            return re.sub(r"([\\`*_\[\]<>|~$])", r"\\\1", r.text)
        inner = _walk(rows, r)
        return "  \n" if r.tag == "br" else f"**{inner}**" if r.tag == "b" and inner else inner
    parts = [one(r) for r in sorted((r for r in rows if r.parent_id == node.node_id), key=lambda r: r.ordinal)]
    return re.sub(r"[\t\r\n ]+", " ", "".join(parts)).strip()


def test_given_pages_by_a_plain_walk(nodes, projected):
    got = {}
    for r in projection.sound(*projected).where("doc_id like 'page%'").orderBy("pos").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.level, r.text))
    by = {}
    for r in nodes.where("doc_id like 'page%'").collect():
        by.setdefault(r.doc_id, []).append(r)
    assert len(by) > 10 and set(got) == set(by)
    for doc, rows in by.items():
        article = next(r for r in rows if r.tag == "article")
        tops = sorted((r for r in rows if r.parent_id == article.node_id and r.tag in ("h1", "p")), key=lambda r: r.pre)
        want = [("heading" if r.tag == "h1" else "paragraph", 1 if r.tag == "h1" else None, _walk(rows, r)) for r in tops]
        plain = lambda t: re.sub(r"\\(?=[#>+\-.)=])", "", t)  # noqa: E731 - marks at line starts are escaped, too
        assert [(k, n, plain(t)) for k, n, t in got[doc]] == [w for w in want if w[2]]
