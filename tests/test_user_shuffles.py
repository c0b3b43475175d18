"""Rows that the per-user queries shuffle for each user."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skillgrid.plans.registry import catalog_postings

USERS = 500


def _tables(spark, path, users):
    """40 courses and ``users`` users, each with four ratings, two orders and four lines."""
    k = F.col("id")
    words = ("data", "cloud", "nurse", "systems", "software", "advanced", "courses")
    types = ("ECONOMY", "SMALL", "MEDIUM", "LARGE", "PROMO")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    tables = {
        "documents": spark.range(40).select(k.alias("doc_id"), F.concat_ws(" ", pick(words, k), pick(words, k * 3 + 1), F.lit("text")).alias("text"),
                                            F.lit("en").alias("lang")),
        "part": spark.range(40).select(k.alias("p_partkey"), F.concat_ws(" ", pick(words, k * 2), F.lit("part")).alias("p_name"),
                                       F.concat(F.lit("Brand"), k % 7).alias("p_brand"), pick(types, k).alias("p_type"), (k % 50).cast("int").alias("p_size")),
        "customer": spark.range(users).select(k.alias("c_custkey")),
        "orders": spark.range(2 * users).select(k.alias("o_orderkey"), (k % users).alias("o_custkey")),
        "lineitem": spark.range(4 * users).select((k % (2 * users)).alias("l_orderkey"), (k % 40).alias("l_partkey")),
        "events": spark.range(4 * users).select(k.alias("event_id"), F.timestamp_seconds(k).alias("ts"), (k % users).alias("user_id"), F.lit("view").alias("event_type"),
                                                F.concat(F.lit('{"k": '), k, F.lit("}")).alias("props")),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return _tables(spark, tmp_path_factory.mktemp("users"), USERS)


def _shuffled_rows(spark, run):
    sc = spark.sparkContext._jsc.sc()
    none, quantiles = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(none, False, False, quantiles, none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for stage, n in stages().items() if stage not in before)


# Each user's own rows: ratings or required and held skills, the parts by which users are alike, one row of the result's join.
LIMITS = {
    "need_order": 40,
    "missing_levels": 15,
    "fallback_courses": 40,
    "text_search_users": 15,
    "level_counts_per_user": 15,
    "missing_levels_gap": 15,
    "advanced_backfill_gap": 20,
    "plan_rebalance": 40,
}


@pytest.mark.parametrize("name", LIMITS)
def test_users_bring_no_courses_to_the_shuffles(spark, tables, name):
    catalog_postings(spark, tables)          # shared by the queries: not counted
    query, old = entry.queries()[name], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")         # as for tables too large to broadcast
    try:
        n = _shuffled_rows(spark, lambda: query(spark, tables).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert n / USERS <= LIMITS[name]
