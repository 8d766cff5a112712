"""Repairs and the job tool surface."""

from pyspark.sql import functions as F

from foliant.operators import repairs
from foliant.plans.engine import Engine

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_printed_urls():
    assert repairs.restore_urls("see https : //a.org/ x-y. Then", ["https://a.org/x-y"]) == "see https://a.org/x-y. Then"
    assert repairs.restore_urls("see https://a.org/long-pre- fix", ["https://bbbbbbbbbbbb.org/"]) == "see https://a.org/long-pre- fix"
    assert repairs.align_url("http://ab", 0, "http://ab/") == (True, 1.0, 9)


def test_overlarge_and_parallel(spark):
    v = spark.createDataFrame([("d", 1, "v", (0.1, 0.1, 0.9, 0.8), None), ("d", 2, "w", (0.1, 0.1, 0.9, 0.5), 0.01)], f"doc_id string, page int, object_id string, bbox_norm {BOX}, ink_gap double")
    b = spark.createDataFrame([("d", 1, "Figure 2: Inner caption text", (0.2, 0.5, 0.8, 0.53))], f"doc_id string, page int, text string, bbox_norm {BOX}")
    got = {r.object_id: r for r in repairs.overlarge_visuals(v, b).collect()}
    assert got["v"].recovered and abs(got["v"].bbox_norm.y1 - 0.495) < 1e-9 and not got["w"].recovered
    n = spark.createDataFrame([("d", 2, "Table 1 Left", (0.12, 0.08, 0.4, 0.1)), ("d", 2, "Table 2 Right", (0.6, 0.08, 0.88, 0.1))], b.schema)
    assert sorted(r.label for r in repairs.parallel_splits(v, n).collect()) == ["Table 1", "Table 2"]


def test_lines(spark):
    lines = spark.createDataFrame([("d", 1, "a", "Figure 1.", 10.0, 100.0, 10.0, 50.0, 102.0), ("d", 1, "b", "A plot of", 10.0, 100.2, 53.0, 90.0, 102.0), ("d", 1, "c", "something.", 10.0, 112.0, 10.0, 60.0, 114.0)],
                                  "doc_id string, page int, line_id string, text string, size double, baseline double, x0 double, x1 double, y1 double")
    m = repairs.merge_line_fragments(lines)
    assert sorted(r.text for r in m.collect()) == ["Figure 1. A plot of", "something."]
    starts = spark.createDataFrame([("d", 1, "blk", "a", 114.0)], "doc_id string, page int, block_id string, line_id string, y1 double")
    assert repairs.caption_chain(m, starts).first()["text"] == "Figure 1. A plot of something."


def test_engine(spark, tmp_path):
    page = "<article><h1>Title</h1><section id='S1'><h2>One</h2><p>" + "First words. " * 60 + "</p><p>" + "Second [1]. " * 60 + "</p></section></article>"
    pages = spark.createDataFrame([("j", "https://arxiv.org/html/2401.00001", page), ("x", "http://other.org/", page)], "job_id string, url string, html string")
    e = Engine(spark, str(tmp_path / "jobs"), 1000)
    units = e.acquire(pages)
    e.prepare(units)
    e.prepare(units)
    assert e.units().count() == 4 and tuple(e.status().select("completed", "total").first()) == (0, 2)
    print_ = e.fingerprint()
    for _ in range(2):
        chunk = e.next_chunks().first()["chunk"]
        rows = e.units().where(F.col("chunk") == chunk).select("unit_id", F.concat(F.lit("訳 "), "original").alias("japanese"))
        assert [r.problem for r in e.save("j", chunk, rows.limit(0))] == ["missing"] * rows.count()
        assert e.save("j", chunk, rows) == [] and e.save("j", chunk, rows) == []
    assert {r.problem for r in e.save("j", 1, e.units().where("chunk = 1").select("unit_id", F.lit("other").alias("japanese")))} == {"conflict"}
    assert e.next_chunks().count() == 0 and e.fingerprint() == print_
    e.compact()
    assert e.fingerprint() == print_ and e.status().first()["remaining"] == 0
    assert e.finalize().first()["markdown"].startswith('<a id="html-0001"></a>\n\n# ') or "訳 Title" in e.finalize().first()["markdown"]
