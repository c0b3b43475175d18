"""Every registered query with a DuckDB twin gives the same rows at sf0.001."""

import hashlib
import math

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(lines)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    df = E.queries()[name](spark, SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    rel = duck.execute(E.oracle_sql()[name])
    d_cols, d_rows = [d[0] for d in rel.description], rel.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert _digest(s_cols, s_rows) == _digest(d_cols, d_rows)
