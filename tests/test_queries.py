"""Every core query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

from lexweave.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(map(repr, pdf[cols].astype(object).where(pdf[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(catalogue.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Nulls in every column, empty, blank and very long texts, repeated rows, extra columns; and empty tables."""
    import datetime

    from pyspark.sql import functions as F

    from lexweave.operators.store import SCHEMA

    now = datetime.datetime(2024, 1, 1)
    base = (2, 1, 1, 1, 1, "English", "Some source text.", "French", "Un texte.", 5, 90, "m", now)
    rows = [(None,) * 13, (1, *[None] * 12), base, base, (3, 1, 1, 1, 2, "English", "", "French", "", -1, -1, "", now), (4, 1, 1, 1, 3, "@", " \n", "French", "​", 0, 0, None, None),
            (5, 1, 1, 2, 0, "English", "# " + "word " * 5_000, "French", "*mot* " * 5_000, 1, 1, "m", now), (6, 1, 1, 2, 1, "English", "a\x01<b>", "French", "<b>**__~~`", 1, 1, "m", now)]
    memory = spark.createDataFrame(rows, SCHEMA)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "# H\n\ntext. text. text"), (None, "x"), (3, "# H\n\ntext. text. text"), (4, "w " * 5_000)], "doc_id long, text string")
    chapters = spark.createDataFrame([(1, 1, ["a", None, "", "12"]), (1, 2, None), (None, None, [])], "book long, chapter int, paragraphs array<string>")
    books = spark.createDataFrame([(1, "English", "French"), (None, None, None)], "book long, source_lang string, target_lang string")
    out = []
    for keep in (True, False):
        d = tmp_path_factory.mktemp("odd")
        for name, df in {"translations": memory, "documents": docs, "chapters": chapters, "books": books}.items():
            df = df.withColumns({"text_": F.lit("x"), "context": F.lit(1), "rank": F.lit(1), "n": F.lit(1)})
            (df if keep else df.limit(0)).write.parquet(f"{d}/{name}.parquet")
        out.append(str(d))
    return out


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_odd_rows(spark, odd_tables, name):
    full, empty = odd_tables
    catalogue.QUERIES[name](spark, full).collect()
    assert catalogue.QUERIES[name](spark, empty).count() == 0
