"""Every core query against its SQL at the smallest scale; the entry points without the optional subpackage."""

import os
import subprocess
import sys
import time

import duckdb
import pandas as pd
import pytest

from foliant.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(df):
    show = lambda v: "NULL" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    got = Q.queries()[name](spark, SF).toPandas()
    sql = Q.oracle_sql().get(name)
    assert sql or len(got) > 0
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_entry_imports_without_the_optional_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['foliant.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def _same_as_sql(spark, tmp_path, name, texts):
    con = duckdb.connect()
    con.register("d", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    con.execute(f"copy (select doc_id, cast(text as varchar) as text from d) to '{tmp_path}/documents.parquet'")
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    got, want = Q.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_placeholders_of_odd_texts(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "placeholders", [None, "", " ", "a", "x" * 100, "\n\n", "é" * 41])


def test_anchors_of_odd_texts(spark, tmp_path):
    # blank texts have an anchor, too; a long run of spaces inside a text takes time in proportion
    run = "a" + " " * 200_000 + "b"
    begun = time.time()
    _same_as_sql(spark, tmp_path, "anchor_suffix", [None, "", " \n", "--", "block", "é à", "Ab c", " Ab\tc!", "_.:-x", "x٣y", run, run, None])
    assert time.time() - begun < 30
