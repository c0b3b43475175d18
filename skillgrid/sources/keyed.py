"""Keyed tables with a commit log: hash buckets of Parquet files under numbered manifests.

Layout below one folder of the shared store:

* ``data/<write>/bucket=<b>/``: Parquet files; never changed once written;
* ``log/<version>.json``: the folders of every bucket in that version.

A change reads and writes only the buckets that its keys fall into; the other
buckets' files go on as they are.  Its manifest is put down last and only if no
other writer has taken that number; then the version is there as a whole, or
not at all.  A writer that comes too late looks at what was committed in
between: if none of its buckets was touched, its files are good and only the
manifest is made anew; else the change is worked out again on the newer
buckets.  Readers are pinned to the version they opened.  What a broken writer
leaves below ``data`` is in no manifest.

Creating a file that must not exist has to be atomic in the store (local and
NFS folders: hard link; HDFS: rename without overwrite).
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .materialize import stored


class SharedFolder:
    """Small files of a folder in the shared store, listed, read and created by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._at = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(self._conf)

    def _child(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        if not self._fs.exists(self._at):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._child(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """Create a file with its whole text, or return False if it is there; never both for two writers."""
        self._fs.mkdirs(self._at)
        draft = f".draft-{uuid.uuid4().hex}"
        if self._fs.getScheme() == "file":
            folder = urlparse(self.path).path if "://" in self.path or self.path.startswith("file:") else self.path
            with open(f"{folder}/{draft}", "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(f"{folder}/{draft}", f"{folder}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{folder}/{draft}")
        out = self._fs.create(self._child(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._child(draft), self._child(name), options)
            return True
        except Exception as e:  # the only expected failure; all others go on
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._fs.delete(self._child(draft), False)
            return False


class Snapshot:
    """One version of a keyed table; later commits do not show in it."""

    def __init__(self, table: "KeyedTable", version: int, files: dict[str, list[str]]):
        self.table, self.version, self.files = table, version, files

    def read(self, buckets=None) -> DataFrame:
        wanted = self.files if buckets is None else {b: self.files.get(str(b), []) for b in buckets}
        folders = [f"{self.table.path}/{f}" for b in sorted(wanted, key=int) for f in wanted[b]]
        spark = self.table.spark
        return spark.read.schema(self.table.schema).parquet(*folders) if folders else spark.createDataFrame([], self.table.schema)


class KeyedTable:
    """A table of unique keys below ``path``; a null in a key column keeps a row out."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key, buckets: int = 32):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key = [key] if isinstance(key, str) else list(key)
        self.log = SharedFolder(spark, f"{self.path}/log")
        first = self._manifest(1)
        self.buckets = first["buckets"] if first else buckets     # fixed by the first version

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "KeyedTable | None":
        """The table below ``path`` with the schema and key of its first version, or None if there is none."""
        log = SharedFolder(spark, f"{path.rstrip('/')}/log")
        first = f"{1:012d}.json"
        if first not in log.names():
            return None
        made = json.loads(log.read(first))
        return cls(spark, path, made["schema"], made["key"])

    def _manifest(self, version: int) -> dict | None:
        name = f"{version:012d}.json"
        return json.loads(self.log.read(name)) if name in self.log.names() else None

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an earlier one by number; version 0 is empty."""
        if version is None:
            known = [int(n[:-5]) for n in self.log.names() if n.endswith(".json") and not n.startswith(".")]
            version = max(known, default=0)
        if version == 0:
            return Snapshot(self, 0, {})
        found = self._manifest(version)
        if found is None:
            raise ValueError(f"no version {version} of {self.path}")
        return Snapshot(self, version, found["files"])

    def read(self, version: int | None = None) -> DataFrame:
        return self.snapshot(version).read()

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        known = F.lit(True)
        for k in self.key:
            known = known & F.col(k).isNotNull()
        return rows.filter(known).withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _winners(self, rows: DataFrame, order) -> DataFrame:
        """One row per key: the greatest by ``order``, then by its JSON text; written once, with its bucket."""
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        whole = F.struct(*[F.col(c) for c in columns])
        rank = F.struct(*[F.col(c) for c in order], F.to_json(whole))
        best = self._bucketed(rows).groupBy(*self.key).agg(F.max_by(whole, rank).alias("_row")).select("_row.*")
        return stored(self._bucketed(best), "keyed-batch")

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows (with ``bucket``) once; the new folder of every bucket that got rows."""
        name = f"data/{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        made = [n for n in SharedFolder(self.spark, f"{self.path}/{name}").names() if n.startswith("bucket=")]
        return {n.split("=")[1]: [f"{name}/{n}"] for n in made}

    def _commit(self, touched: list[int], change) -> int:
        """``change(snapshot)`` gives the new folder lists of the touched buckets; tried until the manifest is in."""
        base, made = self.snapshot(), None
        while True:
            if made is None:
                made = change(base)
            files = {**base.files, **made}
            text = json.dumps({"version": base.version + 1, "buckets": self.buckets, "key": self.key, "schema": self.schema, "files": {b: f for b, f in files.items() if f}})
            if self.log.put_if_absent(f"{base.version + 1:012d}.json", text):
                return base.version + 1
            newer = self.snapshot()
            if any(newer.files.get(str(b)) != base.files.get(str(b)) for b in touched):
                made = None                        # another writer changed a bucket of ours: work it out again
            base = newer

    @staticmethod
    def _touched(rows: DataFrame) -> list[int]:
        return sorted(r.bucket for r in rows.select("bucket").distinct().collect())     # at most one row per bucket

    def upsert(self, updates: DataFrame, order=()) -> int:
        """Rows replace those of equal key, new keys are added; of several updates of a key the last by ``order`` wins."""
        rows = self._winners(updates, order)
        touched = self._touched(rows)

        def change(base: Snapshot):
            kept = self._bucketed(base.read(touched)).join(rows.select(*self.key), self.key, "left_anti")
            return self._write(kept.unionByName(rows))
        return self._commit(touched, change) if touched else self.snapshot().version

    def insert_new(self, batch: DataFrame, order=()) -> int:
        """Rows whose key is not held are added, in files of their own; nothing is rewritten, and a repeat adds nothing."""
        rows = self._winners(batch, order)
        touched = self._touched(rows)

        def change(base: Snapshot):
            fresh = rows.join(base.read(touched).select(*self.key), self.key, "left_anti")
            return {b: base.files.get(b, []) + f for b, f in self._write(fresh).items()}
        return self._commit(touched, change) if touched else self.snapshot().version

    def delete(self, keys: DataFrame) -> int:
        """Keys leave the table; buckets without any of them are not read."""
        gone = stored(self._bucketed(keys.select(*self.key)).distinct(), "keyed-deletes")
        touched = self._touched(gone)

        def change(base: Snapshot):
            kept = self._bucketed(base.read(touched)).join(gone.select(*self.key), self.key, "left_anti")
            return {**{str(b): [] for b in touched}, **self._write(kept)}
        return self._commit(touched, change) if touched else self.snapshot().version

    def compact(self, most: int = 8) -> int:
        """Buckets of more than ``most`` folders are written as one."""
        touched = [int(b) for b, f in self.snapshot().files.items() if len(f) > most]

        def change(base: Snapshot):
            return self._write(self._bucketed(base.read(touched)))
        return self._commit(touched, change) if touched else self.snapshot().version
