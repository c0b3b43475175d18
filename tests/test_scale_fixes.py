"""Sequential ids over several partitions, materialised tables by plan, backlog ids of any size."""

import pytest
from pyspark.sql import functions as F

from skillgrid.operators import enrich as E
from skillgrid.operators.joins import merge_update
from skillgrid.operators.windows import sequential_ids
from skillgrid.sources import materialize as M

SETTINGS = [
    {},
    {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"},
    {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"},
]


@pytest.mark.parametrize("settings", SETTINGS)
def test_sequential_ids_are_gapless_in_order(spark, settings):
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
        n = rows.count()
        out = sequential_ids(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], prefix="")
        out = M.stored(out.withColumn("i", F.col("seq_id").cast("long")), "test-ids")
        assert out.agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i")).first() == (n, n, 1, n)
        later = out.select((F.col("i") - 1).alias("i"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("later"))
        here = out.select("i", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("here"))
        assert here.join(later, "i").where("here > later").count() == 0
        updated = merge_update(out, out.select("i", F.lit("x").alias("v")), "i", "seq_id", "v")
        assert updated.where("seq_id = 'x'").count() == n
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_materialised_tables_follow_their_plan(spark):
    a, b = (M.materialize(spark.range(n), "same-name") for n in (3, 5))
    assert (a.count(), b.count()) == (3, 5)
    before = len(M._WRITTEN)
    assert M.materialize(spark.range(3), "same-name").count() == 3 and len(M._WRITTEN) == before


def test_incremental_table_keeps_first_rows(spark):
    schema = "id long, v string"
    M.materialize(spark.createDataFrame([(1, "a"), (2, "b"), (None, "x")], schema), "inc", "incremental", "id")
    out = M.materialize(spark.createDataFrame([(2, "z"), (3, "c")], schema), "inc", "incremental", "id")
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_backlog_ids_of_any_size(spark):
    df = spark.createDataFrame([(5, None, "x"), (250_000, None, "y"), (4_582_612, None, "z"), (7, "done", "w")], "id long, p string, d string")
    out = E.fill_backlog(df, "id", "p", ["d"], F.upper("d"), batch_width=100)
    assert sorted((r.id, r.p, r.batch_id) for r in out.collect()) == [(5, "X", 0), (250_000, "Y", 2500), (4_582_612, "Z", 45826)]
