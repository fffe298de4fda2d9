"""Each registered query against its SQL, over the smallest test tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
ORACLE = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def shape(rows):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, SF_DIR)
    rel = tables.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = shape(df.select(*columns).collect())
    want = shape(rel.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want


def both_over(spark, folder, name, texts):
    """What a query and its SQL give over documents of these texts, six of each so that all kinds of chunk occur."""
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(t for t in texts for _ in range(6))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    return shape(df.select(*columns).collect()), shape(con.sql(ORACLE[name]).select(*columns).fetchall())


LONG = "\n".join("w" * (i * 37 % 170) for i in range(60))


def test_groups_of_empty_texts(spark, tmp_path):
    got, want = both_over(spark, tmp_path, "line_groups_overlap", ["", "\n", " \n\n", LONG, None])
    assert got == want and repr((0, 0, 0, 0)) in got


def test_sections_of_empty_texts(spark, tmp_path):
    got, want = both_over(spark, tmp_path, "markdown_sections", ["", "\n", " \n\n", LONG, None])
    assert got == want and repr((5, "en", 1, 0, "", 1)) in got


def test_parts_of_empty_and_missing_texts(spark, tmp_path):
    got, want = both_over(spark, tmp_path, "split_oversized", ["", "\n", " \n\n", LONG, None])
    assert got == want and repr((1, "0", None, None, 1)) in got and any("part" in r for r in got)


def test_every_query_has_a_callable():
    known = __spark_entry__.queries()
    assert set(ORACLE) <= set(known) and all(map(callable, known.values()))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["qid", "id", "score", "rank"]
