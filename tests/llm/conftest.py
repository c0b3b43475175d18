import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text) of the small documents table, by id."""
    return duckdb.execute(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet') ORDER BY doc_id").fetchall()


@pytest.fixture
def twin(spark):
    """Run a registered query and its DuckDB twin; return both as sorted row lists."""
    from skillgrid.llm.queries import ORACLE, QUERIES

    def run(name, sf_dir=SF):
        df = QUERIES[name](spark, sf_dir)
        cols = sorted(df.columns)
        con = duckdb.connect()
        for f in os.listdir(sf_dir):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
        rel = con.execute(ORACLE[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        other = [tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()]
        mine = [tuple(r[c] for c in cols) for r in df.collect()]
        return sorted(mine, key=str), sorted(other, key=str)
    return run


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (6, "two words"), (7, "a b c " * 400),
    (8, "Ärger über ß — \U0001F600 " * 30), (None, "no id here at all"), (None, None), (9, "x" * 50_000), (10, "a b c " * 400),
]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "x", 1, 2, 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, start int, ord int, n_words int")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
