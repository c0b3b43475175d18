"""Vectors of two texts of a row, made and multiplied within the row."""
import random
from collections import Counter

from skillgrid.operators import vectors as V


def _texts(rng, n):
    return " ".join(rng.choice(["a", "b", "data", "Köln", "12", "zz"]) + rng.choice("xyz") for _ in range(n))


def test_row_similarity_stays_within_rows_and_equals_the_join(spark):
    rng = random.Random(3)
    rows = [(f"k{i}", _texts(rng, rng.choice([0, 1, 5, 60])), _texts(rng, rng.choice([0, 1, 4]))) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, a string, b string")
    got = V.same_row_similarity(df, "id", "a", "b")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rounded = lambda d: Counter((r.id, None if r.similarity is None else round(r.similarity, 9) + 0.0) for r in d.collect())
    assert rounded(got) == rounded(V._by_key(df, "id", "a", "b"))
    odd = spark.createDataFrame([*rows, rows[3], ("k4", "other words", "data"), (None, "data", "data"), (None, "x", "x")], df.schema)
    assert rounded(V.same_row_similarity(odd, "id", "a", "b")) == rounded(V._by_key(odd, "id", "a", "b"))
