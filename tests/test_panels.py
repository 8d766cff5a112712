"""Split figures made whole: what is merged, suppressed, reparented and relinked, and what is left alone."""

import pytest

from foliant.operators import panels

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
CAPTION = "Figure 1: Alpha test (left) and Beta test ( right )."


def _doc(doc, *, caption=CAPTION, headers=("Alpha  test", "beta test"), others=((0.52, 0.2, 0.8, 0.4),), tail="goes on here", ends="", picture=(0.1, 0.2, 0.4, 0.4)):
    """One page: a cut sentence, a captioned left panel, panels without label, headings that open sections, and more text."""
    visuals = [(doc, 1, "f1", 0, "figure", "Figure 1", picture, ["c1"], "p0")]
    visuals += [(doc, 1, f"u{i}", i + 1, "figure", None, b, [], "p0") for i, b in enumerate(others)]
    visuals += [(doc, 1, "t1", 9, "table", None, (0.1, 0.7, 0.4, 0.8), [], "p0")]
    blocks = [("p1", "A sentence that is" + ends, (0.1, 0.1, 0.8, 0.15)), ("c1", caption, (0.1, 0.42, 0.8, 0.46)), ("p2", tail, (0.1, 0.5, 0.8, 0.6)), ("p3", "More of it.", (0.1, 0.6, 0.8, 0.65)), ("p4", "Other.", (0.1, 0.66, 0.8, 0.69))]
    blocks += [(f"h{i}", t, (0.12 + 0.45 * i, 0.19, 0.3 + 0.45 * i, 0.21)) for i, t in enumerate(headers)]
    roles = [("p1", "paragraph", "s1", "para1"), *[(f"h{i}", "heading", f"sh{i}", None) for i in range(len(headers))], ("c1", "caption", f"sh{len(headers) - 1}", None)]
    roles += [("p2", "paragraph", f"sh{len(headers) - 1}", "para2"), ("p3", "paragraph", f"sh{len(headers) - 1}", "para2"), ("p4", "paragraph", "s2", "para3")]
    rows = [(doc, 1, b, i, r, s, p, None, False) for i, (b, r, s, p) in enumerate(roles)]
    sections = [(doc, "s1", None, "x"), (doc, "s2", f"sh{len(headers) - 1}", "y")] + [(doc, f"sh{i}", "s1", f"h{i}") for i in range(len(headers))]
    return visuals, [(doc, 1, *b) for b in blocks], rows, sections


def _run(spark, docs, ink=None):
    v, b, a, s = ([r for d in docs for r in d[k]] for k in range(4))
    return panels.merge_split_panels(
        spark.createDataFrame(v, f"doc_id string, page int, object_id string, visual_order int, kind string, label string, bbox_norm {BOX}, caption_ids array<string>, insert_after string"),
        spark.createDataFrame(b, f"doc_id string, page int, block_id string, text string, bbox_norm {BOX}"),
        spark.createDataFrame(a, "doc_id string, page int, block_id string, reading_order int, role string, section_id string, paragraph_id string, continues_from string, hidden boolean"),
        spark.createDataFrame(s, "doc_id string, section_id string, parent_id string, title_id string"),
        None if ink is None else spark.createDataFrame(ink, f"doc_id string, object_id string, bbox_norm {BOX}"),
    )


@pytest.fixture(scope="module")
def merged(spark):
    return _run(spark, [
        _doc("good"), _doc("two", others=((0.52, 0.2, 0.8, 0.4), (0.45, 0.2, 0.75, 0.4))), _doc("bare", headers=("Alpha test", "Gamma")), _doc("plain", caption="Figure 1: One."),
        _doc("wide", picture=(0.1, 0.2, 0.8, 0.4), others=()), _doc("alone", others=((0.52, 0.5, 0.8, 0.7),)), _doc("ended", ends="."), _doc("upper", tail="New start"),
    ])


def test_what_is_merged(merged):
    got = {r.doc_id: r for r in merged.merges.collect()}
    assert sorted(got) == ["ended", "good", "upper"]
    g = got["good"]
    assert (g.merged_ids, g.header_ids, g.relinked_ids, g.reparented_ids) == (["u0", "f1"], ["h0", "h1"], ["p2", "p3"], ["s2"])
    assert got["ended"].relinked_ids == got["upper"].relinked_ids == []
    left = {}
    for r in merged.unresolved.collect():
        left.setdefault(r.doc_id, set()).add(r.object_id)
    assert left == {"two": {"f1", "u0", "u1"}, "bare": {"f1", "u0"}, "alone": {"f1"}}
    assert merged.dangling.count() == 0


def test_tables_after_the_merge(merged):
    v = {r.object_id: r for r in merged.visuals.where("doc_id = 'good'").collect()}
    assert sorted(v) == ["f1", "t1"] and tuple(v["f1"].bbox_norm) == (0.1, 0.19, 0.8, 0.4) and v["f1"].insert_after == "p1" and v["t1"].insert_after == "p0"
    a = {r.block_id: r for r in merged.assignments.where("doc_id = 'good'").collect()}
    assert all((a[h].role, a[h].hidden, a[h].section_id) == ("noise", True, None) for h in ("h0", "h1"))
    assert [(a[p].paragraph_id, a[p].section_id, a[p].continues_from) for p in ("p2", "p3", "p4")] == [("para1", "s1", "p1"), ("para1", "s1", "p2"), ("para3", "s2", None)]
    assert a["c1"].section_id == "s1" and len(a) == 7
    assert {(r.section_id, r.parent_id) for r in merged.sections.where("doc_id = 'good'").collect()} == {("s1", None), ("s2", "s1")}
    ended = {r.block_id: r for r in merged.assignments.where("doc_id = 'ended'").collect()}
    assert (ended["p2"].paragraph_id, ended["p2"].section_id, ended["p2"].continues_from) == ("para2", "s1", None)
    for doc, n in (("two", 4), ("bare", 3), ("plain", 3), ("wide", 2), ("alone", 3)):
        assert merged.visuals.where(f"doc_id = '{doc}'").count() == n
        assert merged.sections.where(f"doc_id = '{doc}'").count() == 4 and not merged.assignments.where(f"doc_id = '{doc}' and hidden").count()


def test_one_neighbour_goes_to_the_first_and_ink_decides(spark):
    v, b, a, s = _doc("d")
    v.append(("d", 1, "f2", 5, "figure", "Figure 2", (0.1, 0.2, 0.41, 0.4), ["c1"], "p0"))
    got = _run(spark, [(v, b, a, s)])
    assert [r.object_id for r in got.merges.collect()] == ["f1"] and {r.object_id for r in got.unresolved.collect()} == {"f2", "u0"}
    inked = _run(spark, [(v, b, a, s)], ink=[("d", "f2", (0.11, 0.2, 0.79, 0.39))])
    assert [r.object_id for r in inked.merges.collect()] == ["f2"]
    assert tuple(inked.visuals.where("object_id = 'f2'").first().bbox_norm) == (0.11, 0.2, 0.79, 0.39)
    nothing = _run(spark, [([], [], [], [])])
    assert nothing.visuals.count() == nothing.merges.count() == nothing.unresolved.count() == 0
