"""Backlog ranges: few jobs, each range committed once."""
import uuid

from pyspark.sql import functions as F

from skillgrid.operators.enrich import BacklogRun
from skillgrid.session import scratch_path


def test_backlog_jobs_grow_slower_than_ranges(spark):
    df = spark.range(-40, 1000).select("id", F.concat(F.lit("t"), "id").alias("t")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 'x'"))
    run = BacklogRun(spark, scratch_path(spark, f"backlog-{uuid.uuid4().hex}"), "id", 10)
    calls = []

    def derive(rows):
        calls.append(1)
        return rows.selectExpr("id", "upper(t) AS u")
    assert run.run(df, derive, limit=2) == 2 and run.run(df, derive) == 102 and run.run(df, derive) == 0
    assert len(calls) <= 16 and sorted(run.committed()) == list(range(-4, 100))
    assert sorted((r.id, r.u, r.batch_id) for r in run.read().collect()) == [(i, f"T{i}", i // 10) for i in range(-40, 1000)]


def test_backlog_ranges_of_two_runners_are_committed_once(spark):
    path = scratch_path(spark, f"backlog-{uuid.uuid4().hex}")
    df = spark.range(0, 200).toDF("id")
    calls = []

    def late(rows):
        calls.append(1)
        if len(calls) == 4:                    # the other runner commits some of this job's ranges first
            BacklogRun(spark, path, "id", 10).run(df, lambda r: r, limit=2)
        return rows
    BacklogRun(spark, path, "id", 10).run(df, late)
    assert sorted((r.id, r.batch_id) for r in BacklogRun(spark, path, "id", 10).read().collect()) == [(i, i // 10) for i in range(200)]
