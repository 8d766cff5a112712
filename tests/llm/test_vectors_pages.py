"""Embeddings and pages against brute force, with unsound rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import hnsw, site_templates
from tests.llm.test_documents import _components


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(500):
        v = base[i % 30] + rng.normal(size=16) * rng.choice([0.05, 0.3, 1.0])
        rows.append((i, v.astype(np.float32).tolist(), int(i % 3), "x"))
    rows += [(600 + i, rows[5][1], rows[5][2], "copy") for i in range(20)]
    rows += [rows[7], (700, None, 1, "n"), (701, [0.0] * 16, 1, "z"), (702, [float("nan")] + [1.0] * 15, 1, "q"), (703, [None] + [1.0] * 15, 1, "m"),
             (704, [float("inf")] + [1.0] * 15, 1, "i"), (705, rows[3][1], None, "l"), (706, [], 1, "e"), (707, [1.0, 2.0], 1, "d"), (708, [2.0, 4.0], 1, "d")]
    return rows


@pytest.mark.parametrize("shard", [64, 16384])
def test_hnsw_against_brute_force(spark, vectors, shard):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, point string").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df, shard_points=shard).collect())

    def sound(r):
        return r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    def cosine(a, b):
        a, b = (np.array(x[1], np.float32).astype(float) for x in (a, b))
        return (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))

    linked = lambda i, j: bool(
        sound(vectors[i]) and sound(vectors[j]) and vectors[i][2] == vectors[j][2] and len(vectors[i][1]) == len(vectors[j][1])
        and cosine(vectors[i], vectors[j]) >= 0.93
    )
    n = len(vectors)
    links = [[j for j in range(n) if j != i and linked(i, j)] for i in range(n)]
    comp = _components([v[0] for v in vectors], lambda i, j: j in links[i])
    want = sorted((v[0], len(k), c, v[0] == c) for v, k, c in zip(vectors, links, comp, strict=True))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))  # no link below the threshold
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) >= 0.95
    assert hnsw.near_duplicates(df.limit(0)).collect() == []


def test_recall_without_brute_force():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 24))
    x = hnsw._unit((np.repeat(base, 10, axis=0) + 0.15 * rng.normal(size=(4000, 24))).astype(np.float32))
    g = hnsw.Graph.build(x)
    true = np.argwhere(g.unit @ g.unit.T >= 0.93)
    found = {(int(i), int(j)) for a, b in g.within(g.unit, 0.93, 48) for i, j in zip(a, b, strict=True)}
    assert len(found) >= 0.97 * len(true)


def test_the_audit_counts_no_link_of_a_point_to_itself():
    rng = np.random.default_rng(9)
    x = hnsw._unit(rng.normal(size=(3000, 32)).astype(np.float32))
    g = hnsw.Graph.build(x)
    assert hnsw.audited_beam(g, g.unit, 0.93, True)[1:] == (0, 0)
    x[::2] = hnsw._unit((x[1::2] + 0.02 * rng.normal(size=(1500, 32))).astype(np.float32))
    g = hnsw.Graph.build(x)
    beam, true, found = hnsw.audited_beam(g, g.unit, 0.93, True)
    assert true >= hnsw.AUDIT_LINKS and found >= 0.98 * true and beam >= hnsw.BEAM


def test_packs_doubles_and_string_labels(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 12))
    rows = [(i, (base[i % 60] + 0.02 * rng.normal(size=12)).tolist(), "ab"[i % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    whole = sorted(tuple(r) for r in hnsw.near_duplicates(df).collect())
    monkeypatch.setattr(hnsw, "PACK_BYTES", 20_000)
    assert sorted(tuple(r) for r in hnsw.near_duplicates(df, shard_points=50).collect()) == whole
    assert all(r[1] == 9 and r[2] == r[0] % 60 for r in whole)


ARTICLE = "<article><h1>Head &amp; {0}</h1><p>First {0}<b>bold</b>\n  text<br>more<p>Second &eacute; {0}</article>"


def test_main_text_rules(spark):
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><a>x</a></nav><!-- c -->"
        "<div class='ad'>buy</div><div id=\"cookie-notice\">ok</div><aside>side</aside>" + ARTICLE.format(1) + "<div class=comments><p>me too</p></div><form>f</form><footer>end</footer>"
    )
    rows = [
        (0, "http://a.org/1", page, "x"), (1, None, page, "x"), (2, "http://a.org/2", None, "x"), (3, "http://a.org/3", "", "x"),
        (4, "http://b.org/", "plain text only", "x"), (5, "http://b.org/2", "<p>a<p>b &lt;c&gt; <unclosed", "x"), (6, "http://c.org", "<div>" * 3000 + "deep", "x"), (0, "http://a.org/1", page, "x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in site_templates.main_text(df).collect()}
    assert site_templates.main_text(df).count() == len(rows)
    assert got[0].text == "Head & 1\n\nFirst 1bold text more\n\nSecond é 1" == got[1].text
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert got[4].text == "plain text only" and got[6].text == "deep"
    assert got[5].text.startswith("a\n\nb <c>")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert site_templates.main_text(df.limit(0)).collect() == []


def test_recurring_subtrees_go_and_copies_stay(spark):
    promo = "<p>Read our <b>weekly</b> digest every day.</p>"
    body = lambda i: f"<article><h1>Title {i}</h1><p>Body of page {i} with words.</p>{promo}</article>"
    rows = [(i, f"https://news.org/{i}", body(i)) for i in range(40)]
    rows += [(100 + i, f"https://copy.org/{i}", body(999)) for i in range(40)]
    rows += [(200, "https://small.org/", body(200))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in site_templates.main_text(df).collect()}
    assert all(got[i] == f"Title {i}\n\nBody of page {i} with words." for i in range(40))
    assert all(got[100 + i].endswith("digest every day.") for i in range(40)) and got[200].endswith("digest every day.")
    joined = {r.page_id: r.text for r in site_templates.main_text(df, broadcast_rows=-1).collect()}
    assert joined == got


def test_all_articles_and_the_lead_stay_and_named_parts_go():
    text = lambda html: site_templates.blocks(site_templates.parse(html))[0]
    assert text("<article><p>one</p></article><div>x</div><article><p>two</p></article>") == ["one", "two"]
    assert text("<main><p>lead</p><article><p>one</p></article></main><footer>f</footer>") == ["lead", "one"]
    assert text("<article><p>one</p></article><article class=comment><p>me too</p></article>") == ["one"]
    kept = "<article><p>one</p><p class='alert'>mind</p><div class='share-of-market'>two</div><div class='share-buttons'>s</div></article>"
    assert text(kept) == ["one", "mind", "two"]
    assert text("<div class='ad-banner'>a</div><div id='cookie-notice'>c</div><p>body</p>") == ["body"]


def test_templates_are_counted_as_by_hand(spark):
    menu = lambda i: "<div class='strip'>" + "".join(f"<a href='/{i}{k}'>go {i} {k}</a>" for k in range(2 + i % 3)) + "</div>"
    line = "<p>Same line on each page.</p>"
    page = lambda i: f"{menu(i)}<article><h1>T {i}</h1><p>Body {i}.</p>{line if i % 2 else ''}</article><div>tail {i}</div>"
    rows = [(i, f"https://a.org/{i}", page(i)) for i in range(30)] + [(100 + i, f"https://b.org/{i}", page(i)) for i in range(2)]
    rows += [(200 + i, "https://a.org/copy", page(3)) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    on, pages = {}, {}
    for _, url, html in rows:
        host, root = site_templates.host_of(url), site_templates.parse(html)
        own = "\n".join(site_templates.blocks(root)[0])
        pages.setdefault(host, set()).add(own)
        for key, _ in site_templates.keys_of(root, host):
            on.setdefault((host, key), set()).add(own)
    want = {k for (h, k), v in on.items() if (len(v) >= 3 and 2 * len(v) >= len(pages[h]) if k & 1 else len(v) >= 10 and len(v) >= 0.3 * len(pages[h]))}
    found = {r.key for r in site_templates.templates(df.selectExpr("page_id as rid", "url", "html")).collect()}
    assert {k for k in found if k & 3 != site_templates.PLACE} == want and want
    got = {r.page_id: r for r in site_templates.main_text(df).collect()}
    assert all(got[i].text == f"T {i}\n\nBody {i}." and got[i].n_templates >= 2 for i in range(30))
    assert got[101].text.endswith("Same line on each page.") and got[101].n_templates == 0


def test_templates_alone_strip_the_given_pages(spark):
    """Without any rule about tags and names the texts are the same, and without templates too none is."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    text = lambda **k: {r.page_id: r.text for r in site_templates.main_text(pages, **k).collect()}
    hosts = pages.groupBy(F.regexp_extract("url", "//([^/]*)", 1).alias("h")).count().where("count >= 3").select("h")
    shared = {r.page_id for r in pages.join(hosts, F.regexp_extract("url", "//([^/]*)", 1) == F.col("h")).collect()}
    whole, alone, nothing = text(), text(rules=False), text(rules=False, min_share=9.0, min_frame_share=9.0)
    assert len(shared) > 100 and all(alone[i] == whole[i] != nothing[i] for i in shared)


def test_the_content_of_a_host_is_found_without_names(spark):
    line = lambda i, k: " ".join(f"w{i * j * k % 97}" for j in range(25))
    page = lambda i: (
        f"<div><div><a>menu {i}</a><a>more {i}</a></div><div class=x{i}><p>{line(i, 3)}</p><p>{line(i, 5)}</p></div><div><i>tail {i}</i></div></div>"
    )
    rows = [(i, "http://a.org/", page(i)) for i in range(1, 13)] + [(99, "http://one.org/", page(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for run in ({"rules": False}, {}, {"rules": False, "broadcast_rows": -1}):
        got = {r.page_id: r for r in site_templates.main_text(df, **run).collect()}
        assert all(got[i].text == f"{line(i, 3)}\n\n{line(i, 5)}" and got[i].n_templates == 2 for i in range(1, 13))
        assert got[99].text.startswith("menu 1more 1") and got[99].n_templates == 0


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<div>" * 90_000 + "</p>" * 130_000, "<a '>" * 200_000, '<a "' * 250_000, "<b><article>" + "<i>" * 100_000 + "</b>" * 150_000,
    "<li>" * 100_000, "<table>" + "<tr><td>" * 60_000, "<p>" * 150_000, "<article>x</article>" * 50_000, "<!--" * 250_000, "<" * 1_000_000, "<article>" * 60_000 + "x",
])
def test_long_malformed_pages_take_linear_time(page):
    began = time.process_time()
    root = site_templates.parse(page)
    site_templates.blocks(root, {1}, "host")
    assert time.process_time() - began < 20


def test_quotes_that_never_close():
    text = lambda html: site_templates.blocks(site_templates.parse(html))[0]
    assert text("<p title='a>b'>one</p><p title=\"it>two</p><p title='x'>three</p>") == ["one", "two", "three"]
    assert text("<p>a < b and <c") == ["a < b and <c"] and text("x<!-- never ends <p>y</p>") == ["x"] and text("<!doctype html><p>z") == ["z"]
