"""Registered queries: one per inventory row, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (through the binding views) and runs
the library's operators over the whole table.  ``ORACLE`` holds the DuckDB
twin of each query that SQL can express.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures as X
from .fixtures import INGESTION_TIME
from ..operators import catalog as CAT
from ..sources.materialize import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _json_text(sql: str) -> str:
    """DuckDB's ``to_json`` returns the JSON type; cast each call to VARCHAR like Spark's string."""
    out, i = [], 0
    while True:
        j = sql.find("to_json(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len("to_json")
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j] + "CAST(" + _json_text(sql[j:k + 1].replace("to_json(", "\0", 1)).replace("\0", "to_json(", 1)
                   + " AS VARCHAR)")
        i = k + 1


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _json_text(sql)
        return fn
    return deco


_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def _once(fn):
    """A shared table of an input folder: its plan is built, and the table looked up, once per application."""
    @functools.wraps(fn)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        ident = (fn.__name__, spark.sparkContext.applicationId, sf_dir)
        if ident not in _SHARED or _SHARED[ident].sparkSession is not spark:
            _SHARED[ident] = fn(spark, sf_dir)
        return _SHARED[ident]
    return get


@_once
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified catalogue, materialised as a table (one write per application)."""
    built = CAT.build_catalog(X.courses(spark, sf_dir), INGESTION_TIME)
    return materialize(built, f"catalog@{sf_dir}", "table")


@_once
def catalog_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's search postings (V6), materialised as a table once per application."""
    from ..operators import recommend as R
    return materialize(R.catalog_postings(R.search_text(catalog(spark, sf_dir))), f"catalog_postings@{sf_dir}", "table")


# Importing the query modules fills QUERIES / ORACLE.
from . import q_catalog  # noqa: E402,F401
from . import q_scalar  # noqa: E402,F401
from . import q_skills  # noqa: E402,F401
from . import q_relational  # noqa: E402,F401
from . import q_search  # noqa: E402,F401
from . import q_recommend  # noqa: E402,F401
from . import q_pages  # noqa: E402,F401
from . import q_io  # noqa: E402,F401
from . import q_stream  # noqa: E402,F401
from . import q_more  # noqa: E402,F401
