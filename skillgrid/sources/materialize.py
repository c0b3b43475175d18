"""S11 materialisations: view, table, checkpoint.

``table`` writes parquet under the shared checkpoint folder
(``spark.checkpoint.dir``) and reads it back: lineage is cut, executors lost
later only recompute from the written files, and downstream scans get column
pruning and filter pushdown on the stored model.
"""

from __future__ import annotations

import hashlib
import threading
import uuid

from pyspark.sql import DataFrame

from ..session import scratch_path

_WRITTEN: dict[tuple[str, str, str], str] = {}
_LOCKS: dict[tuple[str, str, str], threading.Lock] = {}
_GUARD = threading.Lock()          # queries may be submitted from several driver threads


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a folder of its own under the shared checkpoint directory and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, f"stored/{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str, kind: str = "table", key: str | None = None) -> DataFrame:
    """Persist a model the way the reference's model config asks for.

    * ``view``: a temp view, recomputed by every reader;
    * ``table``: parquet in the shared checkpoint folder, read back; written
      once per application, name and plan, so another input gets another table;
    * ``incremental``: a keyed table with a commit log (``keyed.py``) under one
      name and schema, which outlives the application: rows whose ``key`` it does
      not hold yet are added, and of several such rows the greatest by JSON text;
    * ``checkpoint``: reliable checkpoint (also in the shared folder).
    """
    spark = df.sparkSession
    if kind == "view":
        df.createOrReplaceTempView(name.replace(".", "_").replace("/", "_"))
        return df
    if kind == "checkpoint":
        return df.checkpoint(eager=True)
    if kind not in ("table", "incremental"):
        raise ValueError(kind)
    if kind == "incremental":
        if key is None:
            raise ValueError("an incremental table needs its key column")
        from .keyed import KeyedTable
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        place = "incremental/" + hashlib.sha256(f"{name}\n{schema}\n{key}".encode()).hexdigest()[:32]
        table = KeyedTable(spark, scratch_path(spark, place), schema, key)
        table.insert_new(df)
        return table.read()
    # 32 bits of the plan's meaning are not enough alone: the schema and the plan's text are part of the name
    shown = df._jdf.queryExecution().analyzed().canonicalized().toString()
    plan = hashlib.sha256(f"{df.semanticHash()}\n{df.schema.json()}\n{shown}".encode()).hexdigest()[:32]
    ident = (spark.sparkContext.applicationId, name, plan)
    with _GUARD:
        lock = _LOCKS.setdefault(ident, threading.Lock())
    with lock:                     # only writers of the same table wait for each other
        path = _WRITTEN.get(ident)
        if path is None:
            path = scratch_path(spark, f"tables/{ident[0]}/" + hashlib.sha1(f"{name} {plan}".encode()).hexdigest()[:16])
            df.write.mode("overwrite").parquet(path)
            _WRITTEN[ident] = path
    return spark.read.schema(df.schema).parquet(path)
